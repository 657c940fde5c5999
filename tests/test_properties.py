"""Property checks: results independent of the partition layout; the clean-up
chain equals the rule-by-rule statement on generated text."""

import os
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as E
from precis.constants import CLEANUP_RULES
from precis.functions.text import cleanup, cleanup_lines

from .conftest import SF001

ALPHABET = 'ab .,!?:#;-_ \n\r\t"()|&=*%+xé’”)/htp'


def py_cleanup(s):
    s = s.lower()
    for pat, rep in CLEANUP_RULES:
        s = re.sub(pat, rep, s, flags=re.MULTILINE)
    return s


def py_line_fix(line):
    if line == "" or line[-1] in ".!?'`\"’":
        return line
    return line + " ."


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet=ALPHABET, max_size=60), min_size=40, max_size=40))
def test_cleanup_generated(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    got = df.select("i", cleanup(F.col("t")).alias("c"), cleanup_lines(F.col("t")).alias("l")).orderBy("i").collect()
    for t, r in zip(texts, got):
        assert r["c"] == py_cleanup(t)
        assert r["l"] == "\n".join(py_line_fix(py_cleanup(x)) for x in t.split("\n"))


def rows_of(df):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())


@pytest.mark.skipif(not os.path.exists(SF001), reason="test data not present")
@pytest.mark.parametrize("name", ["rouge_n", "bootstrap_poisson", "vocabulary", "ratio_split", "line_ids", "story_to_pairs"])
def test_partition_independent(spark, name):
    q = E.queries()[name]
    base = rows_of(q(spark, SF001))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        assert rows_of(q(spark, SF001)) == base
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
