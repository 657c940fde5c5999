"""BLEU as commonly printed: 13a tokens, smoothing and several references, by hand."""

import math

import pytest
from pyspark.sql import functions as F

from precis.functions.tokens import overlap_with_any, tokens_13a
from precis.operators.bleu import corpus_bleu_13a


def test_tokens(spark):
    want = {"Hello, world.": ["Hello", ",", "world", "."], "1,000.5 is 3.": ["1,000.5", "is", "3", "."], "a-b 3-4": ["a-b", "3", "-", "4"],
            "&quot;x&quot; &amp;lt;": ['"', "x", '"', "<"], "cut-\nting\nline": ["cutting", "line"], "<skipped>a": ["a"], "": [],
            "(a) $5 it's": ["(", "a", ")", "$", "5", "it's"], "é, 5,x": ["é", ",", "5", ",", "x"], " \t ": []}
    frame = spark.createDataFrame([(t,) for t in want], "t string")
    assert {r.t: r.k for r in frame.select("t", tokens_13a("t").alias("k")).collect()} == want


def test_overlap_with_the_largest_count_of_any(spark):
    frame = spark.createDataFrame([(list("aaabbc"), list("ab"), list("aabbbx")), ([], ["a"], ["b"]), (["a"], [], [])],
                                  "h array<string>, r array<string>, s array<string>")
    assert [r[0] for r in frame.select(overlap_with_any("h", ["r", "s"])).collect()] == [4, 0, 0]


def test_score_by_hand(spark):
    rows = [("the cat sat on the mat", "the cat is on the mat", "a cat sat on a mat there"), ("no match here", "x y z w", None)]
    r = corpus_bleu_13a(spark.createDataFrame(rows, "hypothesis string, target string, other string"),
                        references=["target", "other"]).first()
    # 6 + 0 of 9 words; bigrams: the cat, cat sat, sat on, on the, the mat; trigrams: cat sat on, on the mat; no 4-gram of 3
    p = [6 / 9, 5 / 7, 2 / 5, 1 / (2 * 3)]
    assert [r.p1, r.p2, r.p3, r.p4] == pytest.approx([100 * x for x in p])
    assert (r.sys_len, r.ref_len) == (9, 6 + 4) and r.bp == pytest.approx(math.exp(1 - 10 / 9))
    assert r.bleu == pytest.approx(100 * r.bp * math.exp(sum(map(math.log, p)) / 4))
    frame = spark.createDataFrame(rows, "hypothesis string, target string, other string")
    assert corpus_bleu_13a(frame, references=["target", "other"], smoothing="none").first().bleu == 0
    same = corpus_bleu_13a(frame.withColumn("target", F.col("hypothesis"))).first()
    assert same.bleu == pytest.approx(100) and same.bp == 1
    assert corpus_bleu_13a(frame.where("false")).first().bleu == 0
    with pytest.raises(ValueError):
        corpus_bleu_13a(frame, smoothing="floor")
