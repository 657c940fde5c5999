"""Mixing against a plain walk over sorted rows."""

import hashlib
import random
import re

from precis.llm.mixing import mix_sources, repeat_to_mix, word_count

SCHEMA = "doc_id long, source string, text string, _copies string"


def plain_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, open_, target = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        parts = sum(weight[s] for s in open_)
        over = {s for s in open_ if 2 * sizes[s] * parts < weight[s] * left}
        if not over:
            target.update({s: weight[s] * left / parts for s in open_})
            break
        target.update({s: 2.0 * sizes[s] for s in over})
        left -= sum(2 * sizes[s] for s in over)
        open_ -= over
    return target


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def plain_mix(rows):
    sizes = {}
    for _, s, t, _ in rows:
        sizes[s] = sizes.get(s, 0) + words(t)
    target, out = plain_targets(sizes), []
    for source, size in sizes.items():
        mine = [(i, t) for i, s, t, _ in rows if s == source]
        key = lambda r: int(hashlib.md5(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:15], 16)
        mine.sort(key=lambda r: (key(r), r[0] is not None, str(r[0]), words(r[1])))
        passes = int(target[source] // size) if size else 0
        rest, ahead = target[source] - passes * size, 0
        for i, t in mine:
            n = words(t)
            out.append((i, n, size, target[source], n * (passes + (2 * ahead + n <= 2 * rest)) if n else 0))
            ahead += n
    return out


def corpus():
    rnd = random.Random(9)
    rows = []
    for i in range(400):
        source = rnd.choice(["b"] * 6 + ["a", "é", "Z", None, "tiny"])
        n = 2 if source == "tiny" else rnd.choice([0, 1, 3, 10, 50, 400])
        rows.append((i, source, rnd.choice([None, ""]) if n == 0 else "  w x\n" * n, "x"))
    rows.append((None, "b", "one two three", "x"))
    return rows


def test_matches_a_plain_walk(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    key = lambda r: (r[0] is None, r)
    out = sorted(map(tuple, mix_sources(docs).collect()), key=key)
    assert out == sorted(plain_mix(rows), key=key)
    again = sorted(map(tuple, mix_sources(docs.repartition(7)).collect()), key=key)
    assert again == out
    by_source = {}
    for (i, s, _, _), r in zip(sorted(rows, key=key), out):
        t = by_source.setdefault(s, [0, r[3], 0])
        t[0] += r[4]
        t[2] = max(t[2], r[1])
        assert r[4] <= 2 * r[1]
    assert all(abs(taken - target) <= largest for taken, target, largest in by_source.values())


def test_repeated_rows_of_the_mix(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    mix = repeat_to_mix(docs)
    assert mix.columns == docs.columns
    times = {}
    for r in mix.collect():
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    assert times == {i: taken // n for i, n, _, _, taken in plain_mix(rows) if taken}


def test_many_sources_are_joined_not_broadcast(spark, monkeypatch):
    from precis.llm import mixing

    docs = spark.createDataFrame(corpus(), SCHEMA)
    want = sorted(map(str, mix_sources(docs).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(map(str, mix_sources(docs).collect())) == want


def test_repeated_rows_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a", "x y", None)] * 5 + [(2, "a", "z", None)], SCHEMA)
    assert mix_sources(docs).count() == 6
    none = spark.createDataFrame([], SCHEMA)
    assert mix_sources(none).collect() == [] and repeat_to_mix(none).collect() == []
    blank = spark.createDataFrame([(1, "a", " ", None), (2, None, None, None)], SCHEMA)
    assert [r.taken for r in mix_sources(blank).collect()] == [0, 0]


def test_a_cut_among_rows_of_one_place(spark):
    rows = [(None, "a", "one two three", "x")] * 1000
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    out = mix_sources(docs).collect()
    assert len(out) == 1000 and sum(r.taken for r in out) == 4500 and {r.taken for r in out} == {3, 6}
    assert repeat_to_mix(docs).count() == 1500
    other = [(None, s, t, str(i % 2)) for i in range(90) for s, t in (("a", "p q"), ("b", "r s t"), ("a", "v w"))]
    docs = spark.createDataFrame(other, SCHEMA)
    taken = sorted(r.taken for r in mix_sources(docs).collect())
    assert taken == sorted(t for *_, t in plain_mix(other))
    words_in = sum(words(r.text) for r in repeat_to_mix(docs).collect())
    assert words_in == sum(taken)


def test_word_count(spark):
    texts = ["", None, " a", "a b", "\x1fa\x0bb c\x85", "a\r\n b\x0c", "x" * 100000]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.n for r in frame.select("i", word_count(frame.t).alias("n")).orderBy("i").collect()]
    assert got == [words(t) for t in texts]
