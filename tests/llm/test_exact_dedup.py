"""Exact deduplication against a plain grouping."""

import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from precis.llm import exact_dedup
from precis.llm.exact_dedup import drop_exact_duplicates, exact_duplicates

LONG = "word " * 5000
ROWS = [
    (1, "same", "a", 1), (2, "same", "b", 2), (9, "same", "c", 3), (9, "same", "c", 3),  # a repeated row
    (3, None, "d", 4), (4, "", "e", 5), (5, " ", "f", 6),
    (6, LONG + "x", "g", 7), (7, LONG + "y", "h", 8), (8, LONG + "x", "i", 9),  # equal length and prefix
    (None, "no id", "j", 10), (None, "no id", "k", 11), (None, "same", "l", 12), (10, "alone", None, None),
    (11, "Same", "m", 13), (12, "é", "n", 14), (13, "é", "o", 15),
]
SCHEMA = "doc_id long, text string, _row string, _len long"  # names that the plan uses itself


def groups():
    out = defaultdict(list)
    for row in ROWS:
        out[row[1] or ""].append(row[0])
    return out


def test_rows(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    out = exact_duplicates(docs, carry={"text_sha256": digest}).collect()
    assert len(out) == len(ROWS)
    by_digest = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups().items()}
    kept = defaultdict(int)
    for r in out:
        ids = by_digest[r.text_sha256]
        known = [i for i in ids if i is not None]
        assert r.group_size == len(ids)
        assert r.keep_id == (max(known) if known else None)
        assert not r.kept or r.doc_id == r.keep_id
        kept[r.text_sha256] += r.kept
    assert set(kept.values()) == {1} and len(kept) == len(by_digest)


def test_drop_keeps_one_row_with_all_columns(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    out = drop_exact_duplicates(docs).collect()
    assert {tuple(r) for r in out} <= set(ROWS)
    assert len(out) == len(groups())
    for r in out:
        known = [i for i in groups()[r.text or ""] if i is not None]
        assert r.doc_id == (max(known) if known else None)


def test_a_full_bitmap_changes_nothing(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"t{i % 40}") for i in range(100)], "doc_id long, text string")
    want = sorted(map(tuple, exact_duplicates(docs).collect()))
    monkeypatch.setattr(exact_dedup, "BITMAP_BITS_LOG2", 15)
    monkeypatch.setattr(exact_dedup, "PREFIX_CHARS", 1)
    assert sorted(map(tuple, exact_duplicates(docs).collect())) == want
    assert drop_exact_duplicates(docs).count() == 40


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert exact_duplicates(docs).collect() == []
    assert drop_exact_duplicates(docs).columns == docs.columns and drop_exact_duplicates(docs).count() == 0
