"""Quality rules: base counts of a text and a hashed n-gram likelihood ratio.

Two multinomials over hashed token unigrams and bigrams are counted: one over the
trusted target (every row labelled good) and one over all of the raw corpus. A text's score is the mean log-likelihood ratio of its n-grams, so
long and short texts compare; every text below a fixed threshold is rejected,
with no random draw.

Counting is one narrow pass: a task adds up its texts in two arrays of fixed size
and hands on a row per bucket it has seen, so the shuffle doesn't depend on the
length of the texts. The table of ratios has a fixed size as well and is broadcast.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from precis import session
from precis.llm.common import ASCII_SPACE, bits_for, key_bitmap, maybe_in, quoted, word_slices
from precis.llm.text_hash import word_ngram_buckets
from precis.session import measured_bytes, written

#: Buckets of hashed n-grams (2**17), so the counts are at most 131,072 rows.
BITS = 17
#: Counts added to every bucket on both sides: rare n-grams say little.
SMOOTHING = 8.0
#: Texts with a mean log-likelihood ratio below this are rejected.
THRESHOLD = -0.25

#: Signs that the rules count, words of a window, and limits.
SYMBOLS = "#*$%&|<>"
WINDOW_WORDS, LEAST_WORDS, MOST_REPEATED_PERCENT = 5, 10, 20


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a text."""
    text = text or ""
    seen: dict[bytes, int] = {}
    ids = [np.fromiter((seen.setdefault(w, len(seen)) for w in words), dtype=np.int64, count=len(words))
           for words in word_slices(text.encode())]  # bytes: ASCII white space only
    ids = np.concatenate(ids) if ids else np.zeros(0, dtype=np.int64)
    chars = len(text) - sum(text.count(c) for c in ASCII_SPACE)
    symbols = sum(text.count(c) for c in SYMBOLS)
    lines: set[str] = set()
    n_lines = 0
    for line in io.StringIO(text, newline="\n"):  # ends lines at \n alone
        line = line.removesuffix("\n")
        if line.strip(ASCII_SPACE):
            n_lines += 1
            lines.add(line)
    return len(ids), chars, symbols, n_lines - len(lines), repeated_words(ids)


def repeated_words(ids: np.ndarray) -> int:
    """How many words (numbered, equal ones alike) lie in windows found twice or more. Windows are
    numbered from the numbers of their halves, so no window is held as an object."""
    if len(ids) <= WINDOW_WORDS:
        return 0

    def numbered(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        _, number, times = np.unique(left * (len(ids) + 1) + right, return_inverse=True, return_counts=True)
        return number, times

    pairs, times = numbered(ids[:-1], ids[1:])
    if len(times) == len(pairs):
        return 0
    fours, times = numbered(pairs[:-2], pairs[2:])
    if len(times) == len(fours):
        return 0
    windows, times = numbered(fours[:-1], ids[4:])
    twice = times[windows] > 1
    covered = np.zeros(len(ids), dtype=bool)
    for i in range(WINDOW_WORDS):
        covered[i:i + len(windows)] |= twice
    return int(covered.sum())


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < LEAST_WORDS or 100 * n_repeat_words > MOST_REPEATED_PERCENT * n_words


def trusted_ids(labels: DataFrame, id_col: str = "doc_id", quality_col: str = "quality") -> DataFrame:
    """Ids of the trusted rows: all that are labelled good."""
    good = labels.where((quoted(quality_col) == 1) & quoted(id_col).isNotNull())
    return good.select(quoted(id_col).alias("_trusted")).distinct()


def ngram_counts(docs: DataFrame, trusted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(bucket, raw, target) counts over all of ``docs`` and its trusted rows.

    The ids are broadcast under a measured size. Beyond it a bitmap of them lets all other
    texts be counted where they are; only those that may be trusted are shuffled, in a join
    that adaptive execution may split for an id with many rows."""
    rows = docs.select(quoted(id_col).alias("_id"), quoted(text_col).alias("_text"))
    trusted = written(trusted, "trusted")
    same = F.col("_id") == F.col("_trusted")
    if measured_bytes(trusted) <= session.BROADCAST_BYTES:
        rows = rows.join(F.broadcast(trusted), same, "left")
    else:
        hashed = F.xxhash64(F.col("_trusted").cast("string"))
        bits = bits_for(trusted.count())
        marked = maybe_in(rows.withColumn("_hash", F.xxhash64(F.col("_id").cast("string"))), "_hash",
                          key_bitmap(trusted.select(hashed.alias("_hash")), "_hash", bits), bits, "_maybe")
        others = marked.where("not _maybe").select("_id", "_text", F.lit(None).cast(trusted.schema["_trusted"].dataType).alias("_trusted"))
        rows = others.unionByName(marked.where("_maybe").select("_id", "_text").join(trusted.hint("merge"), same, "left"))
    rows = rows.select("_text", F.col("_trusted").isNotNull().alias("_good"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 << BITS), dtype=np.int64)
        for batch in batches:
            good = batch.column(1).to_numpy(zero_copy_only=False)
            held: tuple[list[np.ndarray], list[np.ndarray]] = ([], [])
            for i, text in enumerate(batch.column(0)):
                held[int(good[i])].append(word_ngram_buckets(text.as_py(), BITS))
                if i % 500 == 499 or i == batch.num_rows - 1:
                    for side, parts in enumerate(held):
                        if parts:
                            total[side] += np.bincount(np.concatenate(parts), minlength=1 << BITS)
                            parts.clear()
        seen = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(seen.astype(np.int32)), pa.array(total.sum(axis=0)[seen]), pa.array(total[1][seen])],
            names=["bucket", "raw", "target"])

    counts = rows.mapInArrow(count, "bucket int, raw long, target long")
    return counts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratios(counts: DataFrame) -> np.ndarray:
    """Log of target over raw probability per bucket (0 where nothing is known)."""
    table = counts.toPandas()  # a row per bucket, 2**BITS at most
    raw, target = np.zeros(1 << BITS), np.zeros(1 << BITS)
    raw[table.bucket], target[table.bucket] = table.raw, table.target
    if not target.sum():
        return np.zeros(1 << BITS)
    return np.log((target + SMOOTHING) / (raw * (target.sum() / raw.sum()) + SMOOTHING))


def with_verdict(docs: DataFrame, ratios: np.ndarray, text_col: str, name: str, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` plus a struct: base counts, ``base_failed``, ``score`` and ``kept``."""
    shared = docs.sparkSession.sparkContext.broadcast(ratios)

    @F.pandas_udf("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
                  "base_failed boolean, score double, kept boolean")
    def judge(texts: pd.Series) -> pd.DataFrame:
        table, rows = shared.value, []
        for text in texts:
            counts = base_counts(text)
            failed = base_failed(counts[0], counts[4])
            grams = word_ngram_buckets(text, BITS)
            score = float(table[grams].mean()) if len(grams) else 0.0
            rows.append((*counts, failed, score, not failed and score >= threshold))
        return pd.DataFrame(rows, columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                           "base_failed", "score", "kept"])

    return docs.withColumn(name, judge(quoted(text_col)))


def quality_verdicts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: id, base counts, ``base_failed``, ``score`` and
    ``kept`` (false if the base rules fail, else whether the score reaches the threshold).

    A null or wordless text has counts 0, fails the base rules and scores 0; null
    ids stay null and are never trusted; repeated rows stay repeated; other columns
    are not read. Without trusted rows every score is 0; an empty table gives an
    empty result."""
    ratios = log_ratios(ngram_counts(docs, trusted_ids(labels), id_col, text_col))
    rows = docs.select(quoted(id_col).alias("_id"), quoted(text_col).alias("_text"))
    rows = with_verdict(rows, ratios, "_text", "_verdict", threshold)
    return rows.select(F.col("_id").alias(id_col), "_verdict.*")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns.

    A null or empty text has no words and goes; repeated rows are judged alike, each on its
    own; rows with a null id are judged but never trusted; an empty table gives an empty result."""
    ratios = log_ratios(ngram_counts(docs, trusted_ids(labels), id_col, text_col))
    held = docs.select(F.struct(*[quoted(c) for c in docs.columns]).alias("_row"), quoted(text_col).alias("_text"))
    return with_verdict(held, ratios, "_text", "_verdict", threshold).where("_verdict.kept").select("_row.*")
