"""SimHash fingerprints, bit-sliced comparison and components against brute force."""

import random
import re

import numpy as np
import xxhash

from precis.llm import simhash
from precis.llm.components import component_roots
from precis.llm.simhash import block_links, block_masks, drop_near_duplicates, fingerprint, simhash_components


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(pairs, linked):
    """{key: smallest key reachable} of (key, value) pairs."""
    parent = list(range(len(pairs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(pairs)):
        for j in range(i + 1, len(pairs)):
            if linked(pairs[i][1], pairs[j][1]):
                parent[find(j)] = find(i)
    best = {}
    for i, (key, _) in enumerate(pairs):
        best.setdefault(find(i), []).append(key)
    return [min((k for k in best[find(i)] if k is not None), default=None) for i in range(len(pairs))]


def near(a, b):
    return bin(a ^ b).count("1") <= 4


def test_fingerprints(monkeypatch):
    rnd = random.Random(5)
    words = ["the", "Cat", "ÉÈ", "a", "b", "sat", "x y", " ", "Z"]
    gaps = [" ", "\n", "\t", "  ", "\x0b", "\r\n"]
    texts = [None, "", " \n", "one", "One two", "a b c d", "a b c d e"]
    texts += ["".join(rnd.choice(words) + rnd.choice(gaps) for _ in range(rnd.randint(0, 700))) for _ in range(60)]
    for text in texts:
        assert fingerprint(text) == plain_fingerprint(text), text
    # any slices of a text give the same
    monkeypatch.setattr("precis.llm.common.SLICE", 5)
    for text in texts:
        assert fingerprint(text) == plain_fingerprint(text), text
    assert fingerprint("a b c", 1) == fingerprint("c b a", 1) and fingerprint("a b", 3) == fingerprint("A\nB", 3)


def test_very_long_text(spark):
    text = "some words that go on " * 200_000
    docs = spark.createDataFrame([(1, text), (2, text.replace(" ", "\n")), (3, "other")], "doc_id long, text string")
    rows = sorted(tuple(r) for r in simhash_components(docs).select("doc_id", "component_id").collect())
    assert rows == [(1, 1), (2, 1), (3, 3)]


def clustered(n, seed):
    rnd = random.Random(seed)
    centres = [rnd.getrandbits(64) for _ in range(12)]
    out = set()
    while len(out) < n:
        x = rnd.choice(centres) if rnd.random() < 0.7 else rnd.getrandbits(64)
        for _ in range(rnd.randint(0, 12)):
            x ^= 1 << rnd.randrange(64)
        out.add(x)
    return sorted(out)


def test_block_links_span_all_links():
    fps = clustered(700, 1)
    a, b = block_links(np.array(fps, dtype=np.uint64), 4)
    assert all(y < x for x, y in zip(a.tolist(), b.tolist()))
    root = dict(zip(a.tolist(), b.tolist()))
    want = plain_components([(x, x) for x in fps], near)
    assert [root.get(x, x) for x in fps] == want


def test_every_pair_within_the_radius_shares_a_choice_of_blocks():
    rnd = random.Random(2)
    for blocks in (5, 6, 7, 8):
        masks = block_masks(blocks, 4)
        for _ in range(300):
            x = rnd.getrandbits(64)
            y = x
            for b in rnd.sample(range(64), 4):
                y ^= 1 << b
            assert any(x & m == y & m for m in masks)


def test_near_links_with_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 16)
    monkeypatch.setattr(simhash, "BLOCK", 32)
    fps = clustered(500, 3)
    frame = spark.createDataFrame([(simhash._signed(x),) for x in fps], "fp long")
    links = [(r.a % 2**64, r.b % 2**64) for r in simhash.near_links(frame, 4, len(fps)).collect()]
    assert all(x != y for x, y in links)
    roots = {r.node: r.root for r in component_roots(spark.createDataFrame(
        [(simhash._signed(a), simhash._signed(b)) for a, b in links], "a long, b long")).collect()}
    signed = sorted(simhash._signed(x) for x in fps)
    assert [roots.get(x, x) for x in signed] == plain_components([(x, x) for x in signed], lambda a, b: near(a % 2**64, b % 2**64))


def test_component_roots(spark):
    rnd = random.Random(4)
    chain = [(i, i + 1) for i in range(60)] + [(100, 100)]
    links = chain + [(1000 + rnd.randrange(80), 1000 + rnd.randrange(80)) for _ in range(60)]
    rnd.shuffle(links)
    got = {r.node: r.root for r in component_roots(spark.createDataFrame(links + links[:9], "a long, b long")).collect()}
    nodes = sorted({x for pair in links for x in pair})
    both = {frozenset(pair) for pair in links}
    want = dict(zip(nodes, plain_components([(x, x) for x in nodes], lambda a, b: frozenset((a, b)) in both)))
    assert got == {k: v for k, v in want.items() if k != v}
    assert component_roots(spark.createDataFrame([], "a long, b long")).collect() == []


def documents():
    rnd = random.Random(6)
    rows = []
    for i in range(30):
        words = [rnd.choice("abcdefgh") + rnd.choice("xyz") * 3 for _ in range(400)]
        for k in range(rnd.choice([1, 1, 3])):
            if k:
                words[rnd.randrange(400)] = "changed"
            rows.append((len(rows), " ".join(words), "t"))
    rows += [(900, None, "t"), (901, "", "t"), (902, " \n", None), (None, rows[0][1], "t"), (903, "tiny text", "t"),
             (903, "tiny text", "t"), (None, "no id at all", "t"), (904, rows[5][1] + " ", "t")]
    rnd.shuffle(rows)
    return rows


def test_documents(spark):
    rows = documents()
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")
    out = simhash_components(docs).collect()
    want = plain_components([(i, plain_fingerprint(t)) for i, t, _ in rows], near)
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, out), key=key) == sorted(
        ((i, f"{plain_fingerprint(t):016x}", c) for (i, t, _), c in zip(rows, want)), key=key)
    stay = drop_near_duplicates(docs).collect()
    assert {tuple(r) for r in stay} <= set(rows)
    groups = {}
    for (i, t, _), c in zip(rows, want):
        groups.setdefault(c if c is not None else ("null", t), []).append(i)
    assert sorted(key((r.doc_id,)) for r in stay) == sorted(key((c if not isinstance(c, tuple) else None,)) for c in groups)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash_components(docs).collect() == []
    assert drop_near_duplicates(docs).collect() == []
