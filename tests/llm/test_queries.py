"""The registered queries: rows, columns, SQL and plans; the pipeline against brute force."""

import hashlib

import duckdb
import pytest
import sentencepiece

import __spark_entry__ as E
import corpus_pipeline
from precis.llm.oracle import ORACLES
from precis.llm.queries import QUERIES, vocabulary_path
from precis.llm.simhash import fingerprint
from tests.llm.test_mixing import plain_targets, words

SF = "/root/testdata/sf0.001"
TABLES = {"op5_host_reputation": "pages", "op11_warc": "pages", "op12_whitening": "embeddings", "op13_conversation_repair": "conversations"}


def test_registered():
    names = set(E.queries())
    assert set(QUERIES) | {"pipeline"} <= names
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14))
    assert set(ORACLES) == {"op1_exact_dedup", "op5_host_reputation", "op6_license_scan", "op7_mixing", "op11_warc",
                            "op13_conversation_repair"}


def number(v):
    return repr(round(v, 9)) if isinstance(v, float) else repr(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_whole_table_and_sql(spark, name):
    df = E.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    base = spark.read.parquet(f"{SF}/{TABLES.get(name, 'documents')}.parquet")
    per_row = 4 if name == "op12_whitening" else 1  # a row for each component
    assert len(rows) == per_row * (base.select("conv_id").distinct() if name.startswith("op13_") else base).count()
    if name in ORACLES:
        con = duckdb.connect()
        for t in ("documents", "pages", "labels", "conversations"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
        cur = con.execute(ORACLES[name])
        cols = [d[0] for d in cur.description]
        assert sorted(cols) == sorted(df.columns)
        want = sorted("|".join(number(r[cols.index(c)]) for c in df.columns) for r in cur.fetchall())
        assert sorted("|".join(map(number, r)) for r in rows) == want


def test_pipeline_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, verdicts = docs.columns, {r.doc_id: r.kept for r in QUERIES["op8_quality_rules"](spark, SF).collect()}
    outs = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).cache()
        outs.append(docs.collect())
    good, unique, far, mixed, tokens = outs
    assert all(list(r.asDict()) == columns for rows in outs[:-1] for r in rows)
    assert sorted(r.doc_id for r in good) == sorted(i for i, kept in verdicts.items() if kept)
    last = {}
    for r in good:
        last[r.text] = max(last.get(r.text, -1), r.doc_id)
    assert sorted(r.doc_id for r in unique) == sorted(last.values())
    parent = {r.doc_id: r.doc_id for r in unique}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    prints = [(r.doc_id, fingerprint(r.text)) for r in sorted(unique, key=lambda r: r.doc_id)]
    for i, (a, x) in enumerate(prints):
        for b, y in prints[i + 1:]:
            if bin(x ^ y).count("1") <= 4:
                lo, hi = sorted((find(a), find(b)))
                parent[hi] = lo
    assert sorted(r.doc_id for r in far) == sorted({find(i) for i, _ in prints})
    sizes, taken, largest = {}, {}, {}
    for r in far:
        sizes[r.source] = sizes.get(r.source, 0) + words(r.text)
        largest[r.source] = max(largest.get(r.source, 0), words(r.text))
    for r in mixed:
        taken[r.source] = taken.get(r.source, 0) + words(r.text)
    target = plain_targets(sizes)
    assert all(abs(taken.get(s, 0) - target[s]) <= largest[s] for s in sizes)
    assert {tuple(r) for r in mixed} <= {tuple(r) for r in far}
    lib = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path())
    want = sorted((r.doc_id, lib.encode(r.text)) for r in mixed)
    assert sorted((r.doc_id, list(r.ids)) for r in tokens) == want
    assert all(r.ids_sha256 == hashlib.sha256(",".join(map(str, r.ids)).encode()).hexdigest() for r in tokens)
    run = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r.doc_id, r.ids_sha256) for r in run) == sorted((r.doc_id, r.ids_sha256) for r in tokens)


def test_pipeline_on_odd_tables(spark, tmp_path):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    spark.read.parquet(f"{SF}/labels.parquet").where("false").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
    text = " ".join(f"word{i}" for i in range(30))
    odd = [(None, text, None, None, None), (1, text, None, None, None), (1, text, None, None, None), (2, None, "en", "s", 0),
           (3, text + " " + text[::-1], "en", "s", -1), (4, "", "en", None, 0)]
    docs = spark.createDataFrame(odd, schema)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
    # of 90 words 135 are wanted: all of the null source once, the other one twice
    assert sorted(r.doc_id for r in docs.collect()) == [1, 3, 3]
