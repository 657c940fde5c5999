"""Clean-up chain, period fix, strip, line splitting, HTML: against plain-Python
statements of each rule on fixed and random strings."""

import html
import random
import re

import pytest
from pyspark.sql import functions as F

from precis.constants import CLEANUP_RULES, END_TOKENS
from precis.functions import text as T


def py_cleanup(s):
    s = s.lower()
    for pat, rep in CLEANUP_RULES:
        s = re.sub(pat, rep, s, flags=re.MULTILINE)
    return s


def py_fix(line):
    if line == "":
        return line
    if line[-1] in END_TOKENS:
        return line
    return line + " ."


ALPHABET = 'ab .,!?:#;-_ \n\r\t"()|&=*%+xé’”)http://w.c/ \x85'


def random_strings(n, seed=7, max_len=40):
    rnd = random.Random(seed)
    return [
        "".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, max_len)))
        for _ in range(n)
    ] + ["", "http://a.b/c x\ny", "a . b . c . d", " !  ! ! ! ", "Visit https://x.y/z\r\n\nnext line"]


def run(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v string")
    return [r["o"] for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


def test_cleanup_matches_python_re(spark):
    values = random_strings(3000)
    got = run(spark, values, T.cleanup)
    assert got == [py_cleanup(v) for v in values]


def test_compiled_rules_equal_rule_by_rule():
    rules = T.compiled_cleanup_rules()
    assert len(rules) < len(CLEANUP_RULES)
    for v in random_strings(5000, seed=11):
        fast = v.lower()
        for pat, rep in rules:
            fast = re.sub(pat, rep.replace("$1", r"\1"), fast)
        assert fast == py_cleanup(v)


def test_fix_missing_period_cases(spark):
    values = ["", "a", "a.", "a!", "a?", "a'", "a`", 'a"', "a’", "a”", "a)", "a...", "é", "  "]
    assert run(spark, values, T.fix_missing_period) == [py_fix(v) for v in values]


def test_fix_missing_period_lines(spark):
    text = "one\n\ntwo.\nthree ”\n"
    got = run(spark, [text], T.fix_missing_period_lines)[0]
    assert got == "\n".join(py_fix(x) for x in text.split("\n"))



def test_html_to_text(spark):
    page = (
        "<!DOCTYPE html><html><head><title>T &amp; U</title><style>p{x:1}</style>"
        "<script>var a='</p>';</script></head><body><!-- c --><p>A&nbsp;B &copy; &middot; &quot;q&quot;</p>"
        "<p>&lt;tag&gt; &amp;lt; &#39;s</p></body></html>"
    )
    odd = "<p>x &amp y &eacute; &#233; &am z</p>"
    got = run(spark, [page, odd], T.html_to_text)
    assert got[0] == "T & UA B © · \"q\"<tag> &lt; 's"
    assert got[1] == html.unescape("x &amp y &eacute; &#233; &am z")


def test_sentences_and_wordpieces(spark):
    assert run(spark, ["a\n\nb c\n"], T.split_sentences)[0] == ["a", "b c"]
    assert run(spark, ["new s ##ite opens"], T.join_wordpieces)[0] == "new site opens"
    df = spark.createDataFrame([(["x y", "z"],)], "a array<string>")
    assert df.select(T.wrap_sentences(F.col("a")).alias("o")).first()["o"] == "<s> x y </s> <s> z </s>"


def test_punctuation_and_stopword_filters(spark):
    from string import punctuation

    from precis.functions.tokens import drop_punct_tokens, drop_stopwords, stopwords

    toks = ["", "()", "./:", "..", "!?", " a", "　.　", "word", "\n", "x\ny"]
    df = spark.createDataFrame([(toks,)], "t array<string>")
    got = df.select(drop_punct_tokens(F.col("t")).alias("o")).first()["o"]
    assert got == [t for t in toks if t != " " and t.strip() not in punctuation]
    assert "()" not in got and ".." in got and "!?" in got
    words = stopwords("english")
    assert len(words) == 181 and "don't" in words and len(stopwords("russian")) == 151
    df2 = spark.createDataFrame([(["the", "cat", "the", "cat", "is", "a", "dog"],)], "t array<string>")
    kept = df2.select(drop_stopwords(F.col("t"), words).alias("o")).first()["o"]
    assert kept == ["cat", "cat", "dog"]  # order and duplicates kept


def test_strict_end_list_option(spark):
    values = ["a”", "a)", "a."]
    assert run(spark, values, T.fix_missing_period) == ["a” .", "a) .", "a."]
    assert run(spark, values, lambda c: T.fix_missing_period(c, strict=True)) == ["a”", "a)", "a."]
