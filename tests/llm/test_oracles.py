"""The SQL of the URL filter and the licence scan against their queries, on tables that exercise them:
reputations that block, listed suffixes, addresses, and licences under all kinds of notices."""

import random

import duckdb

from precis.llm.oracle import ORACLES
from precis.llm.queries import QUERIES
from tests.llm.test_queries import number
from tests.llm.test_urls_and_licenses import ISC


def both(spark, folder, name, **tables):
    con = duckdb.connect()
    for table, frame in tables.items():
        frame.coalesce(1).write.parquet(f"{folder}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet/*.parquet')")
    df = QUERIES[name](spark, str(folder))
    cur = con.execute(ORACLES[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    want = sorted("|".join(number(r[cols.index(c)]) for c in df.columns) for r in cur.fetchall())
    rows = df.collect()
    assert sorted("|".join(map(number, r)) for r in rows) == want
    return rows


def test_url_filter(spark, tmp_path):
    rng = random.Random(8)
    bad_rate = {"bad.co.in": 0.95, "shop.bad.com": 0.9, "10.0.3.4": 0.97, "u@[::1]:80": 0.9, "x.www.ck": 0.8, "a.b.c.ck": 0.1,
                "good.com": 0.03, "www.good.com": 0.1, "名.公司.香港": 0.9, "n.ne.jp.": 0.85, "localhost": 0.9, "": 0.2}
    names = [name for name in bad_rate for _ in range(25)]
    names += [f"s{k}.{rng.choice(['co.in', 'com', 'bad.com', 'gov.uk', 'ck'])}" for k in range(90)] + [f"10.9.{k}.4:8080" for k in range(30)]
    pages, labels = [(None, "http://q.org/fr/1", "")], [(None, 1, 1), (5, None, 0)]
    for i, name in enumerate(names):
        pages.append((i, f"http://{name}/{i}", ""))
        if rng.random() < 0.8:
            bad = rng.random() < bad_rate.get(name, 0.3)
            labels.append((i, 0, 0) if bad and i % 2 else (i, 1, int(bad)))
    pages += [(9000 + i, u, "") for i, u in enumerate([None, "none", "http://new.bad.co.in/", "http://10.8.7.6/", "http://a.example.net/en/"])]
    rows = both(spark, tmp_path, "op5_host_reputation", pages=spark.createDataFrame(pages, "page_id long, url string, html string"),
                labels=spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    blocked = {r.host for r in rows if r.rule is None and r.verdict == "block"}
    assert {"bad.co.in", "10.0.3.4", "shop.bad.com"} <= blocked and not blocked & {"good.com", "10.8.7.6"}


def test_licence_scan(spark, tmp_path):
    notices = ["", "Copyright (c) 2020 Some One\n\n", "Copyright The Regents of the University of California.\n", "# COPYRIGHT: Some One\n",
               " * Copyright Ångström AB\nCopyright Node.js contributors\n(c) 2021 Other\n", "ISC License\n\n© Any\n", "copyright holders only\n",
               "copyright the\n software\n", "copyright\n", "Copyright - \n"]
    texts = [n + ISC for n in notices] + [ISC + "\n" + n for n in notices] + [ISC.replace("above copyright", "above\ncopyright"), None, "", "x" * 50_000]
    rows = both(spark, tmp_path, "op6_license_scan", documents=spark.createDataFrame(
        [(i, t, "en", "s", 1) for i, t in enumerate(texts)] + [(None, ISC, None, None, None)],
        "doc_id long, text string, lang string, source string, n_chars long"))
    found = {r.doc_id: r.license for r in rows}
    assert [found[i] for i in range(6)] == ["ISC"] * 6 and found[6] is None and found[None] == "ISC"
