"""End-to-end jobs: corpus preparation, splitting, sampling and scoring.

Each job is scan -> DataFrame operators -> sink; nothing passes through the
driver except counts, thresholds and the (at most 3 rows per score type)
aggregate report.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from precis.constants import (
    ARTICLES_TAG,
    BY_LENGTH,
    DEFAULT_ROUGE_TYPES,
    DEFAULT_SPLIT_RATIO,
    NEWS_TAG,
    STORIES_TAG,
    SUMMARIES_TAG,
    TEST_TAG,
    TRAIN_TAG,
    VAL_TAG,
)
from precis.functions.text import newlines_to_space
from precis.functions.tokens import whitespace_tokens
from precis.operators.bootstrap import aggregate_report, aggregate_scores
from precis.operators.corpus import records_to_pairs, stories_to_pairs
from precis.operators.lines import map_lines
from precis.operators.rouge import example_report, score_pairs
from precis.operators.split import ratio_split, sample_pairs, sample_share, size_split
from precis.operators.vocab import build_vocabulary, encode
from precis.sources.files import (
    read_aligned_records,
    read_documents,
    read_lines,
    read_records,
    read_scoring_pairs,
    read_stories,
)
from precis.sources.sinks import (
    write_aggregate_csv,
    write_example_csv,
    write_lines,
    write_pairs_text,
    write_sample,
    write_split,
    write_split_text,
)
from precis.session import written


def prepare_stories(spark: SparkSession, story_dirs, target_dir: str, tag: str = STORIES_TAG,
                    language: str = "english") -> DataFrame:
    """Story directories -> cleaned pairs -> ``<target_dir>/<tag>.articles|summaries``."""
    pairs = stories_to_pairs(read_stories(spark, story_dirs), language=language)
    write_pairs_text(pairs, target_dir, tag)
    return pairs


def prepare_news(spark: SparkSession, source, target_dir: str, lexicon: DataFrame | None = None,
                 lemmatize: bool = True, tag: str = NEWS_TAG, language: str = "russian") -> DataFrame:
    """JSON-lines news records -> cleaned pairs (title kept raw) -> text files."""
    pairs = records_to_pairs(read_records(spark, source), lexicon=lexicon, language=language, lemmatize=lemmatize)
    write_pairs_text(pairs, target_dir, tag)
    return pairs


def process_articles(spark: SparkSession, data_path, save_path: str, lexicon: DataFrame | None = None,
                     language: str = "russian") -> DataFrame:
    """Whole files as single articles -> normalised text on one line each
    (HTML -> text -> clean-up -> lemmas -> stop words / punctuation)."""
    docs = read_documents(spark, data_path)
    ranked = docs.select(F.col("path").alias("id"), F.col("text"), F.lit("").alias("title"))
    out = records_to_pairs(ranked, lexicon=lexicon, language=language).select(
        F.col("id").alias("path"), newlines_to_space(F.col("article")).alias("article")
    )
    out.select("article").write.mode("errorifexists").text(save_path)
    return out


def map_file_lines(spark: SparkSession, input_path: str, worker, payload=(), output_path: str | None = None,
                   skip_lines: int = 0) -> int:
    """User function over every line of one or several files (after ``skip_lines``
    header lines each); ``None`` results are dropped; the kept lines are written in
    input order (file name, line) when ``output_path`` is given. Returns the number
    of kept lines. The function is called once per line."""
    lines = read_lines(spark, input_path, skip_lines=skip_lines, split_all_breaks=True)
    place = ["file", "line", "sub"]
    out = written(map_lines(lines, worker, *payload, id_col=place), "mapped-lines")
    if output_path:
        write_lines(out, output_path, place)
    return out.count()


def corpus_vocabularies(pairs: DataFrame, only_source: bool = False, split_col: str = "split",
                        train_tag: str = "train", min_count: int = 1) -> dict:
    """Vocabularies built over the training split: ``articles`` (source) and,
    unless ``only_source``, ``summaries`` (target); white-space tokens.

    One pass over the pairs: both sides are tokenized into one (side, token)
    stream, counted per (side, token) and ranked once; a side's ids are its
    ranks minus the side's first rank."""
    train = pairs.where(F.col(split_col) == train_tag) if split_col in pairs.columns else pairs
    sides = [(ARTICLES_TAG, "article")] + ([] if only_source else [(SUMMARIES_TAG, "summary")])
    tagged = train.select(F.explode(F.array(*[
        F.struct(F.lit(tag).alias("side"), whitespace_tokens(F.col(col)).alias("t")) for tag, col in sides
    ])).alias("s")).select("s.side", "s.t")
    vocab = build_vocabulary(tagged, "t", min_count, by="side")
    return {tag: vocab.where(F.col("side") == tag).select("token", "count", "id") for tag, _ in sides}


def encode_pairs(pairs: DataFrame, vocabularies: dict, unk_id: int = -1, keep: list[str] | None = None) -> DataFrame:
    """Integer-id arrays per split for the article (and summary) columns; beside
    them the columns of ``pairs``, or only those of ``keep``."""
    sides = [(ARTICLES_TAG, "article", "article_ids"), (SUMMARIES_TAG, "summary", "summary_ids")]
    sides = [side for side in sides if side[0] in vocabularies]
    names = pairs.columns if keep is None else list(keep)
    names += [ids for _, _, ids in sides if ids not in names]
    # a column of ids holds the tokens first, so that they are not carried beside them
    out = pairs.withColumns({ids: whitespace_tokens(F.col(text)) for _, text, ids in sides}).select(*names)
    for tag, _, ids in sides:
        out = encode(out, ids, vocabularies[tag], unk_id=unk_id, out_col=ids)
    return out.select(*names)


def read_aligned(spark: SparkSession, articles_path: str, summaries_path: str) -> DataFrame:
    """Line files, or folders of part files, -> (id, article, summary) by (file
    rank, line); files of unequal length raise ``ValueError``."""
    return read_aligned_records(spark, articles_path, summaries_path, "\n", ("article", "summary"))


def split_files(spark: SparkSession, articles_path: str, summaries_path: str, target: str,
                ratio=DEFAULT_SPLIT_RATIO, as_text: bool = False) -> DataFrame:
    """Ratio split of aligned files: Parquet by split, or ``as_text`` the files
    ``{train,val,test}.articles`` and ``.summaries``."""
    pairs = ratio_split(written(read_aligned(spark, articles_path, summaries_path), "aligned"), "id", ratio)
    _write_splits(pairs, target, as_text, (TRAIN_TAG, VAL_TAG, TEST_TAG))
    return pairs


def _write_splits(pairs: DataFrame, target: str, as_text: bool, splits) -> None:
    if as_text:
        write_split_text(pairs, target, splits)
    else:
        write_split(pairs, target)


def split_by_size(spark: SparkSession, articles_path: str, summaries_path: str, target: str,
                  train_size: int, test_size: int, overlap: bool = False, as_text: bool = False) -> DataFrame:
    aligned = written(read_aligned(spark, articles_path, summaries_path), "aligned")
    pairs = size_split(aligned, train_size, test_size, "id", overlap)
    _write_splits(pairs, target, as_text, ("train", "test", "valid"))
    return pairs


def sample_files(spark: SparkSession, articles_path: str, summaries_path: str, target_dir: str = "sampled",
                 method: str = BY_LENGTH, **kwargs) -> float | None:
    """Keep pairs whose article is shorter than ``length`` bytes (with its
    newline); returns the kept share in percent (two decimals)."""
    pairs = written(read_aligned(spark, articles_path, summaries_path), "aligned")
    kept = sample_pairs(pairs, method, **kwargs)
    write_sample(kept, target_dir)
    return sample_share(pairs, kwargs[BY_LENGTH]).first()["share"]


def score_files(spark: SparkSession, target_pattern: str, prediction_pattern: str, output: str,
                rouge_types=DEFAULT_ROUGE_TYPES, use_stemmer: bool = False, aggregate: bool = True,
                delimiter: str = "\n", method: str = "tree", per_example_output: str | None = None,
                n_samples: int = 1000, confidence: float = 0.95, seed: int = 0):
    """Scoring job: files -> aligned pairs -> long score table -> bootstrap
    intervals (CSV) and/or per-example scores (CSV)."""
    pairs = read_scoring_pairs(spark, target_pattern, prediction_pattern, delimiter)
    result = None
    if aggregate:
        scores = score_pairs(pairs, rouge_types, use_stemmer)
        iv = aggregate_scores(scores, method, types=list(rouge_types), n_samples=n_samples,
                              confidence=confidence, seed=seed)
        result = write_aggregate_csv(aggregate_report(iv), output)
    if per_example_output or not aggregate:
        write_example_csv(example_report(pairs, rouge_types, use_stemmer), per_example_output or output)
    return result


__all__ = [
    "prepare_stories", "prepare_news", "process_articles", "map_file_lines", "corpus_vocabularies",
    "encode_pairs", "read_aligned", "split_files", "split_by_size", "sample_files", "score_files",
]
