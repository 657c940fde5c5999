"""ROUGE-N / L / Lsum: hand-computed goldens, plain-Python cross-checks, LCS helpers."""

import random
import re
from collections import Counter

import pytest

from precis.functions.lcs import lcs_indices, lcs_length, lsum_hits
from precis.functions.porter import stem
from precis.operators.rouge import check_rouge_types, score_pairs


def scores(spark, pairs, types, stem_=False):
    df = spark.createDataFrame([(i, t, p) for i, (t, p) in enumerate(pairs)], "id long, target string, prediction string")
    out = {}
    for r in score_pairs(df, types, stem_).collect():
        out[(r["id"], r["score_type"])] = (r["precision"], r["recall"], r["fmeasure"])
    return out


def f1(p, r):
    return 2 * p * r / (p + r) if p + r > 0 else 0.0


def test_docstring_pair(spark):
    s = scores(spark, [("The quick brown fox jumps over the lazy dog", "The quick brown dog jumps on the log.")],
               ["rouge1", "rougeL"])
    assert s[(0, "rouge1")][:2] == pytest.approx((6 / 8, 6 / 9))
    assert s[(0, "rougeL")][:2] == pytest.approx((5 / 8, 5 / 9))


def test_fixture_table(spark):
    pairs = [
        ("one two three", "one two"),
        ("one two five six", "seven eight"),
        ("", "one"),
        ("президент сирии", "президент сирии"),
        ("a a b", "a b b"),
        ("one two\nthree", "three\none two"),
    ]
    s = scores(spark, pairs, ["rouge1", "rouge2", "rougeL", "rougeLsum"])
    assert s[(0, "rouge1")] == pytest.approx((1.0, 2 / 3, 0.8))
    for ty in ("rouge1", "rouge2", "rougeL", "rougeLsum"):
        assert s[(1, ty)] == (0.0, 0.0, 0.0)
        assert s[(2, ty)] == (0.0, 0.0, 0.0)
        assert s[(3, ty)] == (0.0, 0.0, 0.0)
    assert s[(4, "rouge1")][:2] == pytest.approx((2 / 3, 2 / 3))
    assert s[(5, "rougeLsum")] == pytest.approx((1.0, 1.0, 1.0))
    assert s[(5, "rougeL")][:2] == pytest.approx((2 / 3, 2 / 3))


def test_bad_types():
    for bad in ("rouge0", "rouge10", "rougeX"):
        with pytest.raises(ValueError):
            check_rouge_types([bad])


def toks(s):
    return [t for t in re.split(r"\s+", re.sub(r"[^a-z0-9]+", " ", s.lower())) if t]


def ngram_score(t, p, n):
    ct = Counter(tuple(t[i:i + n]) for i in range(len(t) - n + 1))
    cp = Counter(tuple(p[i:i + n]) for i in range(len(p) - n + 1))
    hit = sum(min(c, cp[g]) for g, c in ct.items())
    pr, rc = hit / max(sum(cp.values()), 1), hit / max(sum(ct.values()), 1)
    return pr, rc, f1(pr, rc)


def textbook_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            t[i][j] = t[i - 1][j - 1] + 1 if a[i - 1] == b[j - 1] else max(t[i - 1][j], t[i][j - 1])
    return t


def textbook_path(a, b):
    t = textbook_lcs(a, b)
    i, j, out = len(a), len(b), []
    while i > 0 and j > 0:
        if a[i - 1] == b[j - 1]:
            out.append(i - 1)
            i, j = i - 1, j - 1
        elif t[i][j - 1] > t[i - 1][j]:
            j -= 1
        else:
            i -= 1
    return out[::-1]


def sequential_lsum(rs, cs):
    """Plain statement of the summary-level rule with the sequential clipping loop."""
    if not rs or not cs:
        return 0
    cr, cc = Counter(t for s in rs for t in s), Counter(t for s in cs for t in s)
    hits = 0
    for r in rs:
        union = sorted(set().union(*[textbook_path(r, c) for c in cs]))
        for tok in (r[i] for i in union):
            if cc[tok] > 0 and cr[tok] > 0:
                hits += 1
                cc[tok] -= 1
                cr[tok] -= 1
    return hits


def test_lcs_helpers_property():
    rnd = random.Random(3)
    for _ in range(400):
        a = [rnd.choice("abcde") for _ in range(rnd.randint(0, 25))]
        b = [rnd.choice("abcde") for _ in range(rnd.randint(0, 25))]
        L = textbook_lcs(a, b)[-1][-1] if a and b else 0
        assert lcs_length(a, b) == L == lcs_length(b, a)
        assert lcs_indices(a, b) == textbook_path(a, b)
        rs = [a[: len(a) // 2], a[len(a) // 2:]]
        cs = [b[: len(b) // 3], b[len(b) // 3:]]
        assert lsum_hits(rs, cs) == sequential_lsum(rs, cs)


def test_random_pairs_against_plain_python(spark):
    rnd = random.Random(5)
    words = "the cat sat on a mat dog ran fast slow".split()
    pairs = []
    for _ in range(60):
        t = " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 15)))
        p = " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 15)))
        pairs.append((t.replace(" mat ", " mat\n"), p.replace(" dog ", " dog\n")))
    s = scores(spark, pairs, ["rouge1", "rouge2", "rouge3", "rougeL", "rougeLsum"])
    for i, (t, p) in enumerate(pairs):
        tt, pp = toks(t), toks(p)
        for n in (1, 2, 3):
            assert s[(i, f"rouge{n}")] == pytest.approx(ngram_score(tt, pp, n))
        L = textbook_lcs(tt, pp)[-1][-1] if tt and pp else 0
        exp = (L / len(pp), L / len(tt)) if tt and pp else (0.0, 0.0)
        assert s[(i, "rougeL")][:2] == pytest.approx(exp)
        rs = [toks(x) for x in t.split("\n") if x]
        cs = [toks(x) for x in p.split("\n") if x]
        m, n = sum(map(len, rs)), sum(map(len, cs))
        h = sequential_lsum(rs, cs) if m and n else 0
        exp = (h / n, h / m) if m and n else (0.0, 0.0)
        assert s[(i, "rougeLsum")][:2] == pytest.approx(exp)
        # identical pair scores 1, swapping sides swaps P and R
    s2 = scores(spark, [(p, t) for t, p in pairs], ["rouge1", "rougeL"])
    for i in range(len(pairs)):
        for ty in ("rouge1", "rougeL"):
            assert s2[(i, ty)][0] == pytest.approx(s[(i, ty)][1])


def test_porter_paper_examples():
    cases = {
        "caresses": "caress", "ponies": "poni", "cats": "cat", "feed": "feed", "agreed": "agre",
        "plastered": "plaster", "motoring": "motor", "sing": "sing", "conflated": "conflat",
        "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi",
        "relational": "relat", "conditional": "condit", "rational": "ration", "valenci": "valenc",
        "digitizer": "digit", "triplicate": "triplic", "formative": "form", "electriciti": "electr",
        "revival": "reviv", "allowance": "allow", "adjustment": "adjust", "adoption": "adopt",
        "controll": "control", "roll": "roll", "generalization": "gener", "oscillators": "oscil",
    }
    for w, s in cases.items():
        assert stem(w) == s, w


def test_stemmer_in_scores(spark):
    s = scores(spark, [("the cats were running", "a cat runs")], ["rouge1"], stem_=True)
    # tokens: the cat were run / a cat run -> hits cat, run
    assert s[(0, "rouge1")][:2] == pytest.approx((2 / 3, 2 / 4))


def test_stemmer_with_summary_level(spark):
    s = scores(spark, [("the cats were running\nfast dogs", "a cat runs\nfast dog")],
               ["rouge1", "rougeLsum"], stem_=True)
    # stemmed sentences: [the cat were run] [fast dog] / [a cat run] [fast dog]
    # union LCS hits: cat, run (sentence 1) + fast, dog (sentence 2) = 4 of m=6, n=5
    assert s[(0, "rougeLsum")][:2] == pytest.approx((4 / 5, 4 / 6))
    assert s[(0, "rouge1")][:2] == pytest.approx((4 / 5, 4 / 6))


def test_unicode_tokens_option(spark):
    from precis.operators.rouge import score_pairs

    df = spark.createDataFrame([(0, "президент сирии", "президент Сирии")], "id long, target string, prediction string")
    ascii_rows = {r["score_type"]: r["fmeasure"] for r in score_pairs(df, ["rouge1", "rougeLsum"]).collect()}
    uni_rows = {r["score_type"]: r["fmeasure"] for r in score_pairs(df, ["rouge1", "rougeLsum"], ascii_only=False).collect()}
    assert ascii_rows == {"rouge1": 0.0, "rougeLsum": 0.0}
    assert uni_rows == {"rouge1": 1.0, "rougeLsum": 1.0}


def test_extended_stemmer():
    # the additions, and words on which both forms agree
    cases = {"ties": "tie", "dies": "die", "tied": "tie", "cried": "cri", "skies": "sky", "dying": "die", "news": "news",
             "enjoy": "enjoy", "happy": "happi", "possibly": "possibl", "hopefully": "hope", "biologically": "biolog",
             "apologi": "apolog", "innings": "inning", "proceed": "proceed", "caresses": "caress", "running": "run"}
    for w, s in cases.items():
        assert stem(w, True) == s, w
    assert stem("enjoy") == "enjoi" and stem("ties") == "ti"


def test_short_tokens_are_not_stemmed(spark):
    from precis.operators.rouge import stem_word

    words = ["was", "his", "gas", "use", "runs", "cats", None]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert [r.s for r in df.select(stem_word("w").alias("s")).collect()] == ["was", "his", "gas", "use", "run", "cat", None]


def test_lcs_path_memory_of_long_sentences():
    import tracemalloc

    rnd = random.Random(8)
    for n, words, most in ((10_000, 8, 2e6), (60_000, 20_000, 12e6)):  # a bit per cell: 12.5 and 450 MB
        a, b = ([rnd.randrange(words) for _ in range(n)] for _ in range(2))
        tracemalloc.start()
        path = lcs_indices(a, b)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert len(path) == lcs_length(a, b)
        assert peak < most


def test_lcs_path_over_blocks_of_rows(monkeypatch):
    from precis.functions import lcs

    monkeypatch.setattr(lcs, "SMALL_TABLE", 0)
    monkeypatch.setattr(lcs, "SMALL_SIDE", 0)
    rnd = random.Random(9)
    for _ in range(600):
        letters = "abcdefgh"[: rnd.randint(1, 8)]
        a, b = ([rnd.choice(letters) for _ in range(rnd.randint(0, 40))] for _ in range(2))
        assert lcs_indices(a, b) == (textbook_path(a, b) if a and b else [])
        assert lcs_length(a, b) == len(lcs_indices(a, b))


def test_ngram_table_counts(spark):
    from precis.operators.rouge import ngram_table

    pairs = [("a b a b c", "b a b"), ("", "x"), ("", ""), ("one", None)]
    df = spark.createDataFrame([(i, t, p) for i, (t, p) in enumerate(pairs)], "id long, target string, prediction string")
    got = {(r.id, r.n, r.ngram): (r.tc, r.pc) for r in ngram_table(df.where("prediction is not null"), (1, 2)).collect()}
    want = {}
    for i, (t, p) in enumerate(pairs[:3]):
        for side, text in enumerate((t, p)):
            ws = text.split()
            for n in (1, 2):
                for j in range(len(ws) - n + 1):
                    want.setdefault((i, n, " ".join(ws[j:j + n])), [0, 0])[side] += 1
    assert got == {k: tuple(v) for k, v in want.items()}
    plan = ngram_table(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_stems_of_lists(spark):
    from precis.operators.rouge import stem_sentence_tokens, stem_tokens

    rows = [(["running", "cats", None, "Dogs", "été", "was", "running"],), ([],), (None,), ([None],)]
    df = spark.createDataFrame(rows, "t array<string>")
    stems = [["run", "cat", "was", "run"], [], None, []]
    assert [r.s for r in df.select(stem_tokens("t").alias("s")).collect()] == stems
    nested = spark.createDataFrame([([r[0] for r in rows],), ([],), (None,)], "t array<array<string>>")
    assert [r.s for r in nested.select(stem_sentence_tokens("t").alias("s")).collect()] == [stems, [], None]
