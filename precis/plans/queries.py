"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame over
the whole driver tables (or frames Spark derives from them).

Conversation pairs: target = a user turn, prediction = the assistant turn
that follows it; pair id = conv_id * 2^32 + turn of the user turn. The pair
join is an equi-join on (conv_id, turn) - no window over a conversation, so a
single huge conversation does not land in one task.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from precis.constants import HIGHLIGHT_MARKER
from precis.functions.text import (
    cleanup,
    cleanup_lines,
    newlines_to_space,
    split_sentences,
    squeeze_spaces,
    with_html_text,
)
from precis.functions.tokens import (
    drop_punct_tokens,
    drop_stopwords_by_lang,
    explode_tokens,
    rouge_tokens,
    split_space,
    stopwords,
    whitespace_tokens,
)
from precis.operators import bootstrap as B
from precis.operators import measures as M
from precis.operators.bleu import corpus_bleu, corpus_bleu_13a
from precis.operators.corpus import lemmatize_tokens, normalize_articles, records_to_pairs, stories_to_pairs
from precis.operators.align import align, ordinals, pair_by_rank, role_counts
from precis.operators.ids import global_index, join_per_group, with_dense_ids
from precis.operators.lines import map_lines, score_with
from precis.operators.rouge import example_report, ngram_table, score_columns, score_pairs, stem_word
from precis.operators.split import head_tail, ratio_split, sample_pairs, sample_share, size_split
from precis.operators.vocab import build_vocabulary, encode
from precis.plans import params as P
from precis.plans.jobs import corpus_vocabularies, encode_pairs
from precis.session import shared_path, spread, written
from precis.sources.files import parse_generation_log

MEASURES = ("precision", "recall", "fmeasure")


# Text tables and their id columns: spread over the cores when the scan has
# fewer splits than that (the test files are one row group each).
SPREAD_KEYS = {"documents": ["doc_id"], "pages": ["page_id"], "conversations": ["conv_id", "turn"], "benchmark": ["item_id"]}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    key = SPREAD_KEYS.get(name)
    return spread(df, key) if key else df


def r9(df: DataFrame, cols) -> DataFrame:
    return df.select(*[F.round(F.col(c), 9).alias(c) if c in cols else F.col(f"`{c}`") for c in df.columns])


def conversation_pairs(spark, sf_dir) -> DataFrame:
    conv = table(spark, sf_dir, "conversations")
    u = conv.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("target"))
    a = conv.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("prediction")
    )
    return u.join(a, ["conv_id", "turn"]).select(
        (F.col("conv_id") * F.lit(1 << 32) + F.col("turn")).alias("id"), "target", "prediction"
    )


def story_frame(spark, sf_dir) -> DataFrame:
    """documents rendered as story files: body, then two highlights."""
    d = table(spark, sf_dir, "documents")
    nl = F.lit("\n")
    content = F.concat(
        F.col("text"), nl, nl, F.lit(HIGHLIGHT_MARKER), nl, nl, F.split(F.col("text"), "\n", -1)[0],
        nl, nl, F.lit(HIGHLIGHT_MARKER), nl, F.lit("source "), F.col("source"), F.lit(" in "), F.col("lang"), F.lit("!"), nl,
    )
    return d.select(F.col("doc_id").alias("id"), content.alias("content"))


def clean_doc(c="text"):
    return squeeze_spaces(newlines_to_space(cleanup(F.col(c))))


# --------------------------------------------------------------------------- text

def q_clean_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", clean_doc().alias("cleaned"))


def q_missing_period(spark, sf_dir):
    # every line of every document: clean-up, then the missing-period fix
    # (computed over whole texts, then split: same lines, fewer regex calls)
    d = table(spark, sf_dir, "documents").select("doc_id", cleanup_lines(F.col("text")).alias("c"))
    lines = explode_tokens(d, F.split("c", "\n", -1), "line", "line_no", keep=["doc_id"])
    return lines.select("doc_id", F.col("line_no").cast("long").alias("line_no"), "line")


def q_html_to_text(spark, sf_dir):
    return with_html_text(table(spark, sf_dir, "pages").select("page_id", "html"), "html", "text").select("page_id", "text")


def q_normalize_articles(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "html")
    return normalize_articles(pages, "html", "article", stopwords("english")).select("page_id", "article")


def q_story_to_pairs(spark, sf_dir):
    return stories_to_pairs(story_frame(spark, sf_dir), language="english")


def q_records_to_pairs(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    as_json = pages.select("page_id", F.to_json(F.struct(F.col("html").alias("text"), F.col("url").alias("title"))).alias("line"))
    records = as_json.select(F.col("page_id").alias("id"), F.from_json("line", "text string, title string").alias("r")).select(
        "id", "r.text", "r.title"
    )
    return records_to_pairs(records, language="english")


def q_records_to_pairs_lemmas(spark, sf_dir):
    """The news job as it runs by default: with a lexicon."""
    pages = table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("id"), F.col("html").alias("text"), F.col("url").alias("title"))
    lexicon = spark.createDataFrame(P.LEXICON, "form string, lemma string")
    return records_to_pairs(pages, lexicon=lexicon, language="english")


def q_lemmatize_corpus(spark, sf_dir, way=None):
    d = table(spark, sf_dir, "documents").select("doc_id", split_space(clean_doc()).alias("tokens"))
    lex = spark.createDataFrame(P.LEXICON, "form string, lemma string")
    out = lemmatize_tokens(d, "tokens", lex, way=way)
    return out.select("doc_id", F.array_join("tokens", " ").alias("lemmatized"))


def q_lemmatize_corpus_joined(spark, sf_dir):
    """As ``lemmatize_corpus``, by the way for lexicons beyond memory."""
    return q_lemmatize_corpus(spark, sf_dir, way="join")


def q_stopword_filter(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.array_join(drop_stopwords_by_lang(split_space(clean_doc()), F.col("lang")), " ").alias("filtered"))


def q_punct_filter(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", drop_punct_tokens(split_space(cleanup(F.col("text")))).alias("k"))
    return d.select("doc_id", F.array_join("k", " ").alias("kept"), F.size("k").cast("long").alias("n_kept"))


def q_score_tokens(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", rouge_tokens(F.col("text")).alias("t"))
    return d.select("doc_id", F.array_join("t", " ").alias("tokens"), F.size("t").cast("long").alias("n_tokens"))


def q_stem_vocabulary(spark, sf_dir):
    # distinct-vocabulary job: every distinct scoring token is stemmed once
    docs = table(spark, sf_dir, "documents")
    toks = explode_tokens(docs, rouge_tokens(F.col("text")), "token").distinct()
    return toks.select("token", stem_word(F.col("token")).alias("stem"))


def q_sentence_split(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.posexplode(split_sentences(F.col("text"))).alias("sent_no", "sentence")).select(
        "doc_id", F.col("sent_no").cast("long").alias("sent_no"), "sentence"
    )


def q_after_marker_window(spark, sf_dir):
    """Per story line: is it a highlight (after the first marker line, not a
    marker, not empty)? The running "seen a marker" flag equals
    ``line_no >= first marker line``; a document is one row, so its first
    marker is found in its own line array (``array_position``) before the
    lines are exploded - one narrow stage, no window, join or shuffle, and a
    huge document stays one row's work."""
    s = story_frame(spark, sf_dir).select("id", cleanup_lines(F.col("content"), strip=True).alias("c"))
    lines = s.select("id", F.split("c", "\n", -1).alias("lines"))
    marked = lines.select(
        "id", "lines",
        F.array_position(F.transform("lines", lambda l: l.startswith(HIGHLIGHT_MARKER)), True).alias("first"))
    c = explode_tokens(marked, "lines", "line", "line_no", keep=[F.col("id").alias("doc_id"), "first"])
    flag = ((F.col("first") > 0) & (F.col("line_no") + 1 > F.col("first"))
            & ~F.col("line").startswith(HIGHLIGHT_MARKER) & (F.col("line") != ""))
    return c.select("doc_id", F.col("line_no").cast("long").alias("line_no"), flag.cast("long").alias("is_highlight"))


# --------------------------------------------------------------------------- ids / alignment

def _line_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, count): lines per document, from the text itself."""
    breaks = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    return docs.select("doc_id", (breaks + 1).cast("long").alias("count"))


def q_line_ids(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    lines = d.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line")).select(
        "doc_id", F.col("line_no").cast("long").alias("line_no"), (F.octet_length("line") + 1).cast("long").alias("n_bytes")
    )
    # global line number = lines of earlier documents + position in the document
    return with_dense_ids(lines, "line_id", "doc_id", "line_no", _line_counts(d)).select(
        "doc_id", "line_no", "line_id", "n_bytes")


def _role(conv: DataFrame, role: str) -> DataFrame:
    return conv.where(F.col("role") == role)


def q_file_pairs(spark, sf_dir):
    # a conversation stands for a file of targets (user turns) and one of predictions
    conv = table(spark, sf_dir, "conversations")
    names = [_role(conv, role).select(F.col("conv_id").alias(name)).distinct()
             for role, name in (("user", "target_conv"), ("assistant", "prediction_conv"))]
    return pair_by_rank(*names, "target_conv", "prediction_conv")


def q_positional_join(spark, sf_dir):
    conv = table(spark, sf_dir, "conversations")
    k = written(ordinals(conv, ["conv_id", "role"], "turn"), "ordinals")
    sides = []
    for role, name in (("user", "target"), ("assistant", "prediction")):
        texts = _role(conv, role).select("conv_id", "turn", F.col("text").alias(name))
        sides.append(align(_role(k, role).select("conv_id", "turn", "k"), texts, ["conv_id", "turn"]).drop("turn"))
    return align(*sides, ["conv_id", "k"]).select("conv_id", "k", "target", "prediction")


def q_alignment_check(spark, sf_dir):
    conv = table(spark, sf_dir, "conversations")
    return role_counts(conv, "conv_id", {"n_targets": F.col("role") == "user", "n_predictions": F.col("role") == "assistant"})


def q_generation_log_pairs(spark, sf_dir):
    pairs = conversation_pairs(spark, sf_dir)
    render = lambda c: F.replace(F.regexp_replace(F.col(c), r"[\t\n\r]", " "), F.lit("ing "), F.lit(" ##ing "))
    tab = F.lit("\t")
    lines = pairs.select(F.concat(F.lit("T-"), F.col("id").cast("string"), tab, render("target")).alias("value")).unionByName(
        pairs.select(F.concat(F.lit("H-"), F.col("id").cast("string"), tab, F.lit("-0.5"), tab, render("prediction")).alias("value"))
    )
    return parse_generation_log(lines)


# --------------------------------------------------------------------------- scoring

def rouge_scores(spark, sf_dir, types):
    return score_pairs(conversation_pairs(spark, sf_dir), types)


def q_ngram_counts(spark, sf_dir):
    return ngram_table(conversation_pairs(spark, sf_dir), (1, 2, 3))


def q_rouge_n(spark, sf_dir):
    return r9(rouge_scores(spark, sf_dir, ["rouge1", "rouge2", "rouge3"]), MEASURES)


def q_rouge_n_stemmed(spark, sf_dir):
    return r9(score_pairs(conversation_pairs(spark, sf_dir), ["rouge1", "rouge2"], use_stemmer=True), MEASURES)


def q_rouge_l(spark, sf_dir):
    return r9(rouge_scores(spark, sf_dir, ["rougeL"]), MEASURES)


def q_rouge_lsum(spark, sf_dir):
    return r9(rouge_scores(spark, sf_dir, ["rougeLsum"]), MEASURES)


def _boot_scores(spark, sf_dir):
    return rouge_scores(spark, sf_dir, ["rouge1", "rouge2"])


def q_bootstrap_exact(spark, sf_dir):
    iv = B.bootstrap_exact(_boot_scores(spark, sf_dir), P.BOOT_SAMPLES, P.BOOT_CONFIDENCE, P.BOOT_SEED)
    return r9(iv, ("low", "mid", "high"))


def q_bootstrap_tree(spark, sf_dir):
    iv = B.bootstrap_tree(_boot_scores(spark, sf_dir), P.BOOT_SAMPLES, P.BOOT_CONFIDENCE, P.BOOT_SEED, P.BOOT_LEAF_ROWS)
    return r9(iv, ("low", "mid", "high"))


def q_bootstrap_poisson(spark, sf_dir):
    types = ["rouge1", "rouge2"]
    wide = score_columns(conversation_pairs(spark, sf_dir), types)
    iv = B.bootstrap_poisson_wide(wide, types, P.BOOT_SAMPLES, P.BOOT_CONFIDENCE, P.BOOT_SEED)
    return r9(iv, ("low", "mid", "high"))


def q_aggregate_report(spark, sf_dir):
    iv = B.bootstrap_exact(_boot_scores(spark, sf_dir), P.BOOT_SAMPLES, P.BOOT_CONFIDENCE, P.BOOT_SEED)
    return r9(B.aggregate_report(iv).select("score_type", "low", "mid", "high"), ("low", "mid", "high"))


def q_example_report(spark, sf_dir):
    wide = example_report(conversation_pairs(spark, sf_dir), ["rouge1", "rouge2", "rougeL"])
    return r9(wide, [c for c in wide.columns if c != "id"])


def q_sorted_scores(spark, sf_dir):
    s = rouge_scores(spark, sf_dir, ["rouge1", "rouge2", "rouge3"]).select("score_type", "id", "fmeasure")
    ix = global_index(s, ["score_type", F.col("fmeasure").desc(), "id"], "gi")
    first = ix.groupBy("score_type").agg(F.min("gi").alias("g0"))
    out = join_per_group(ix, first, "score_type", salt_from=[F.col("id")]).select(
        "score_type", "id", F.round("fmeasure", 9).alias("fmeasure"), (F.col("gi") - F.col("g0")).alias("rank")
    )
    return out


def q_corpus_bleu(spark, sf_dir):
    pairs = conversation_pairs(spark, sf_dir)
    out = corpus_bleu(pairs, hypothesis="prediction", reference="target")
    return r9(out, ("bleu", "p1", "p2", "p3", "p4", "bp", "ratio"))


def q_corpus_bleu_13a(spark, sf_dir):
    """Predictions against two references: the target, and the target without its commas."""
    pairs = conversation_pairs(spark, sf_dir).withColumn("plain", F.replace("target", F.lit(","), F.lit("")))
    out = corpus_bleu_13a(pairs, "prediction", ["target", "plain"])
    return r9(out, ("bleu", "p1", "p2", "p3", "p4", "bp", "ratio"))


class _UnigramOverlap:
    """A user-supplied scorer: plain-Python unigram F1 on lower-cased words."""

    def score(self, target, prediction):
        t, p = [x.split() for x in (target.lower(), prediction.lower())]
        common = sum(min(t.count(w), p.count(w)) for w in set(t))
        pr = common / len(p) if p else 0.0
        rc = common / len(t) if t else 0.0
        f = 2 * pr * rc / (pr + rc) if pr + rc > 0 else 0.0
        return {"unigram": (pr, rc, f)}


def q_custom_scorer(spark, sf_dir):
    return r9(score_with(conversation_pairs(spark, sf_dir), _UnigramOverlap()), MEASURES)


# --------------------------------------------------------------------------- splits / samples / vocabulary

def _article_pairs(spark, sf_dir) -> DataFrame:
    """(doc_id, article, summary): a document and its first line."""
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.col("text").alias("article"), F.substring_index("text", "\n", 1).alias("summary"))


def q_ratio_split(spark, sf_dir):
    return ratio_split(_article_pairs(spark, sf_dir), "doc_id", P.SPLIT_RATIO)


def q_size_split(spark, sf_dir):
    return size_split(_article_pairs(spark, sf_dir), P.TRAIN_SIZE, P.TEST_SIZE, "doc_id")


def q_size_split_overlap(spark, sf_dir):
    return size_split(_article_pairs(spark, sf_dir), P.TRAIN_SIZE, P.TEST_SIZE, "doc_id", overlap=True)


def q_lm_split(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return size_split(docs, P.TRAIN_SIZE, P.TEST_SIZE, "doc_id").select("doc_id", "split", clean_doc().alias("article"))


def q_head_tail(spark, sf_dir):
    return head_tail(_article_pairs(spark, sf_dir), P.HEAD_N, "doc_id")


def q_sample_by_length(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("article"))
    kept = sample_pairs(d, length=P.MAX_LENGTH)
    return kept.select("doc_id", "article", (F.octet_length("article") + 1).cast("long").alias("n_bytes"))


def q_sample_share(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("text").alias("article"))
    return sample_share(d, P.MAX_LENGTH)


def _split_stories(spark, sf_dir) -> DataFrame:
    """Story pairs with their split. The split is told by the id alone, before the
    stories are cleaned, so that only the wanted parts are."""
    stories = ratio_split(story_frame(spark, sf_dir), "id", P.SPLIT_RATIO)
    return stories_to_pairs(stories, language="english", keep=["split"])


def q_train_vocabulary(spark, sf_dir):
    """Source and target vocabularies over the training split of the story
    pairs (ratio split by pair id), white-space tokens."""
    vocabs = corpus_vocabularies(_split_stories(spark, sf_dir))
    parts = [v.select(F.lit(side).alias("side"), "token", "count", "id") for side, v in sorted(vocabs.items())]
    return parts[0].unionByName(parts[1])


def q_encode_splits(spark, sf_dir):
    """Every split of the story pairs encoded with the training vocabularies
    (tokens unseen in training get the unknown id)."""
    # the split pairs feed both the vocabularies and the encoding: write once
    pairs = written(_split_stories(spark, sf_dir), "split-pairs")
    enc = encode_pairs(pairs, corpus_vocabularies(pairs), unk_id=P.UNK_ID, keep=["id", "split"])
    return enc.select("id", "split", _ids_text("article_ids").alias("article_ids"),
                      _ids_text("summary_ids").alias("summary_ids"))


def q_encode_articles(spark, sf_dir):
    """Articles only, as for a language model: the source vocabulary of the training
    part (size split) and every part encoded with it."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), clean_doc().alias("article"))
    parts = written(size_split(docs, P.TRAIN_SIZE, P.TEST_SIZE, "id"), "lm-parts")
    enc = encode_pairs(parts, corpus_vocabularies(parts, only_source=True), unk_id=P.UNK_ID, keep=["id", "split"])
    return enc.select("id", "split", _ids_text("article_ids").alias("article_ids"))


def _ids_text(c):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), " ")


def _vocab_tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", whitespace_tokens(clean_doc()).alias("tokens"))


def q_vocabulary(spark, sf_dir):
    return build_vocabulary(_vocab_tokens(spark, sf_dir), "tokens", min_count=P.VOCAB_MIN_COUNT)


def q_encode_corpus(spark, sf_dir, way=None):
    toks = _vocab_tokens(spark, sf_dir)
    vocab = build_vocabulary(toks, "tokens", min_count=P.VOCAB_MIN_COUNT)
    enc = encode(toks.withColumnRenamed("tokens", "ids"), "ids", vocab, unk_id=P.UNK_ID, way=way)
    return enc.select(
        "doc_id",
        _ids_text("ids").alias("ids"),
        F.size(F.filter("ids", lambda x: x == P.UNK_ID)).cast("long").alias("n_unk"),
    )


def q_encode_corpus_joined(spark, sf_dir):
    """As ``encode_corpus``, by the way for vocabularies beyond memory."""
    return q_encode_corpus(spark, sf_dir, way="join")


def q_corpus_union(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.lit("documents").alias("corpus"), F.col("doc_id").alias("id"), "text")
    b = table(spark, sf_dir, "benchmark").select(F.lit("benchmark").alias("corpus"), F.col("item_id").alias("id"), "text")
    return d.unionByName(b).select("corpus", "id", F.octet_length("text").cast("long").alias("n_bytes"))


def _shout_long_lines(line, suffix):
    return None if len(line) < 20 else line.replace("a", "A") + suffix


def q_map_lines(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    lines = d.select(F.posexplode(F.split("text", "\n", -1)).alias("ln", "value"), "doc_id")
    lines = with_dense_ids(lines, "line", "doc_id", "ln", _line_counts(d)).select("line", "value")
    return map_lines(lines, _shout_long_lines, "!")


class _Words(NamedTuple):
    target: int
    prediction: int
    ratio: float
    common: int
    jaccard: float


class _Sizes:
    """A user-supplied scorer with scores of five and of two measures."""

    def score(self, target, prediction):
        t, p = target.split(" "), prediction.split(" ")
        common, either = len(set(t) & set(p)), len(set(t) | set(p))
        return {"words": _Words(len(t), len(p), len(t) / len(p), common, common / either),
                "chars": (len(target), len(prediction))}


def _sizes(spark, sf_dir):
    return M.score_measures(conversation_pairs(spark, sf_dir), _Sizes())


def q_custom_measures(spark, sf_dir):
    return r9(M.long_measures(_sizes(spark, sf_dir)), ("value",))


def q_measure_intervals(spark, sf_dir):
    state = M.score_state(_sizes(spark, sf_dir), P.BOOT_SAMPLES, P.BOOT_SEED)
    return r9(M.state_intervals(state, P.BOOT_CONFIDENCE), ("mean", "low", "mid", "high"))


def q_accumulated_scores(spark, sf_dir):
    """ROUGE scores added shard by shard to a stored state, which then gives the intervals."""
    scores = M.packed_scores(rouge_scores(spark, sf_dir, ["rouge1", "rouge2"]))
    scores, folder = written(scores, "scores"), shared_path(spark, "score-state")
    for shard in range(P.SCORE_SHARDS):
        M.add_scores(scores.where(F.pmod(F.xxhash64("id"), F.lit(P.SCORE_SHARDS)) == shard), folder, str(shard), P.BOOT_SAMPLES, P.BOOT_SEED)
    return r9(M.state_intervals(M.read_state(spark, folder), P.BOOT_CONFIDENCE), ("mean", "low", "mid", "high"))


QUERIES = {
    "clean_text": q_clean_text,
    "missing_period": q_missing_period,
    "html_to_text": q_html_to_text,
    "normalize_articles": q_normalize_articles,
    "story_to_pairs": q_story_to_pairs,
    "records_to_pairs": q_records_to_pairs,
    "records_to_pairs_lemmas": q_records_to_pairs_lemmas,
    "lemmatize_corpus": q_lemmatize_corpus,
    "lemmatize_corpus_joined": q_lemmatize_corpus_joined,
    "stopword_filter": q_stopword_filter,
    "punct_filter": q_punct_filter,
    "score_tokens": q_score_tokens,
    "stem_vocabulary": q_stem_vocabulary,
    "ngram_counts": q_ngram_counts,
    "line_ids": q_line_ids,
    "file_pairs": q_file_pairs,
    "positional_join": q_positional_join,
    "alignment_check": q_alignment_check,
    "generation_log_pairs": q_generation_log_pairs,
    "rouge_n": q_rouge_n,
    "rouge_n_stemmed": q_rouge_n_stemmed,
    "rouge_l": q_rouge_l,
    "rouge_lsum": q_rouge_lsum,
    "bootstrap_exact": q_bootstrap_exact,
    "bootstrap_tree": q_bootstrap_tree,
    "bootstrap_poisson": q_bootstrap_poisson,
    "aggregate_report": q_aggregate_report,
    "example_report": q_example_report,
    "sorted_scores": q_sorted_scores,
    "corpus_bleu": q_corpus_bleu,
    "corpus_bleu_13a": q_corpus_bleu_13a,
    "custom_scorer": q_custom_scorer,
    "ratio_split": q_ratio_split,
    "size_split": q_size_split,
    "size_split_overlap": q_size_split_overlap,
    "lm_split": q_lm_split,
    "head_tail": q_head_tail,
    "sample_by_length": q_sample_by_length,
    "sample_share": q_sample_share,
    "vocabulary": q_vocabulary,
    "train_vocabulary": q_train_vocabulary,
    "encode_splits": q_encode_splits,
    "encode_articles": q_encode_articles,
    "encode_corpus": q_encode_corpus,
    "encode_corpus_joined": q_encode_corpus_joined,
    "corpus_union": q_corpus_union,
    "sentence_split": q_sentence_split,
    "after_marker_window": q_after_marker_window,
    "map_lines": q_map_lines,
    "custom_measures": q_custom_measures,
    "measure_intervals": q_measure_intervals,
    "accumulated_scores": q_accumulated_scores,
}
