"""Base counts against their definitions; the likelihood ratio against brute force."""

import math
import random
import re
from collections import Counter

from precis.llm import quality_rules as Q
from precis.llm.text_hash import token_hashes, word_ngram_buckets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    seen, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if seen[w] > 1:
            covered.update(range(i, i + 5))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_base_counts():
    rnd = random.Random(1)
    parts = ["a", "b", "é", "#", "a|b", " ", " x", "word"]
    gaps = [" ", "\n", " \n", "\t", "\r\n", "\x0b", "\n\n"]
    texts = [None, "", " ", "\n", "a " * 4, "a " * 5, "a " * 6]
    texts += ["".join(rnd.choice(parts) + rnd.choice(gaps) for _ in range(rnd.randint(0, 60))) for _ in range(500)]
    for text in texts:
        assert Q.base_counts(text) == plain_counts(text), repr(text)


def test_tokens_are_hashed_by_their_content_alone(monkeypatch):
    a, b = token_hashes("The cat*** sat"), token_hashes("sat THE *** é_1")
    assert len(a) == 4 and len(b) == 4
    assert a[0] == b[1] and a[2] == b[2] and a[3] == b[0] and a[1] not in b
    text = "some words, and more! " * 500
    whole = token_hashes(text)
    monkeypatch.setattr("precis.llm.text_hash.WINDOW", 1000)
    assert (token_hashes(text) == whole).all()
    assert len(token_hashes(None)) == len(token_hashes(" \n")) == 0


def corpus():
    rnd = random.Random(2)
    good = [f"w{i}" for i in range(80)]
    rows = [(i, " ".join(rnd.choice(good) for _ in range(rnd.randint(12, 60)))) for i in range(160)]
    rows += [(200 + i, " ".join(rnd.choice(good) + "***" for _ in range(30))) for i in range(40)]
    return rows + [(300, None), (301, ""), (302, "one two"), (None, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11")]


def test_verdicts(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, True) for i, t in rows], "doc_id long, text string, kept boolean")
    labels = spark.createDataFrame([(i, 1 if i < 160 else 0, 0) for i, _ in rows if i is not None and i % 2 == 0]
                                   + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in Q.quality_verdicts(docs, labels).collect()}
    assert len(out) == len(rows)
    raw, target = Counter(), Counter()
    for i, t in rows:
        grams = word_ngram_buckets(t, Q.BITS).tolist()
        raw.update(grams)
        if i is not None and i % 2 == 0 and i < 160:
            target.update(grams)
    scale = sum(target.values()) / sum(raw.values())
    for i, t in rows:
        grams = word_ngram_buckets(t, Q.BITS).tolist()
        each = [math.log((target[g] + Q.SMOOTHING) / (raw[g] * scale + Q.SMOOTHING)) for g in grams]
        want = sum(each) / len(each) if each else 0.0
        counts = plain_counts(t)
        failed = counts[0] < 10 or 100 * counts[4] > 20 * counts[0]
        r = out[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts
        assert abs(r.score - want) < 1e-9 and r.base_failed == failed
        assert r.kept == (not failed and r.score >= Q.THRESHOLD)
    assert all(out[i].kept for i in range(160)) and not any(out[i].kept for i in range(200, 240))
    stay = Q.keep_good(docs, labels)
    assert stay.columns == docs.columns
    assert sorted(r.doc_id or -1 for r in stay.collect()) == sorted(i or -1 for i, r in out.items() if r.kept)


def test_without_labels_or_documents(spark):
    docs = spark.createDataFrame([(i, t) for i, t in corpus()], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = Q.quality_verdicts(docs, labels).collect()
    assert all(r.score == 0 and r.kept != r.base_failed for r in out)
    none = spark.createDataFrame([], "doc_id long, text string")
    assert Q.quality_verdicts(none, labels).collect() == [] and Q.keep_good(none, labels).collect() == []


def test_every_trusted_row_counts(spark, monkeypatch):
    labels = spark.range(60_000).selectExpr("id as doc_id", "1 as quality", "0 as toxic")
    assert Q.trusted_ids(labels).count() == 60_000
    docs = spark.range(60_000).selectExpr("id as doc_id", "concat('w', id % 7) as text")
    for limit in (64 << 20, 0):  # broadcast, and the join of the rows that a bitmap of the ids lets through
        monkeypatch.setattr("precis.session.BROADCAST_BYTES", limit)
        counts = Q.ngram_counts(docs, Q.trusted_ids(labels), "doc_id", "text")
        plan = counts._jdf.queryExecution().optimizedPlan().toString()
        assert ("strategy=merge" in plan) == (not limit) and ("_page" in plan) == (not limit)
        rows = counts.collect()
        assert sum(r.target for r in rows) == sum(r.raw for r in rows) == 60_000


def test_tokens_of_texts_beyond_a_window(monkeypatch):
    import numpy as np

    from precis.llm import text_hash as T

    rng = np.random.default_rng(1)
    texts = ["\t".join(["word"] * 60), "x" * 500 + "," * 700 + "y" * 300, " " * 400 + "é" * 90, "a",
             "".join(rng.choice(list("ab ,.\t\né"), 3000)), "z" * 64, "z" * 65 + " q"]
    whole = [T.token_hashes(t) for t in texts]
    monkeypatch.setattr(T, "WINDOW", 64)
    monkeypatch.setattr(T, "_powers", [])
    for t, want in zip(texts, whole):
        assert (T.token_hashes(t) == want).all() and len(T.token_hashes(t)) == len(want)
    assert len(set(whole[0].tolist())) == 1 and len(whole[0]) == 60


def test_base_counts_in_slices(monkeypatch):
    import random
    from collections import Counter

    from precis.llm import common

    def plain(text):
        words = [w.decode() for w in text.encode().split()]
        windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
        seen = Counter(windows)
        covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(5)}
        lines = [x for x in text.split("\n") if x.strip(" \t\n\r\x0b\x0c")]
        return (len(words), sum(map(len, words)), sum(text.count(c) for c in Q.SYMBOLS), len(lines) - len(set(lines)), len(covered))

    rnd = random.Random(4)
    gaps = [" ", "\n", "\r\n", "\t", "\u2028", "\x0b", "\n\n"]
    texts = ["".join(rnd.choice(["a", "b", "é", "#x", "c d"]) + rnd.choice(gaps) for _ in range(rnd.randint(0, 300)))
             for _ in range(80)] + ["x" * 500, " " * 90, "\n" * 40, "a b c d e", "a b c d e a b c d e", "a a a a a a"]
    for size in (common.SLICE, 7):
        monkeypatch.setattr(common, "SLICE", size)
        for text in texts:
            assert Q.base_counts(text) == plain(text), text


def test_very_long_texts_and_repeated_rows(spark):
    long = "one two three four five six\t" * 300_000
    docs = spark.createDataFrame([(1, long), (2, "fine words " * 3), (2, "fine words " * 3)], "doc_id long, text string")
    rows = Q.quality_verdicts(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
    assert sorted((r.doc_id, r.n_words, r.base_failed) for r in rows) == [(1, 1_800_000, True), (2, 6, True), (2, 6, True)]
