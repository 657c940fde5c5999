"""Dense ids, file line positions, splits and samples."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from precis.operators.ids import global_index, prefix_offsets
from precis.operators.split import head_tail, ratio_split, sample_pairs, sample_share, size_split
from precis.sources.files import count_lines, read_delimited, read_lines


def test_global_index_dense_any_partitioning(spark):
    rng = np.random.default_rng(0)
    ids = [int(x) for x in rng.permutation(5000) * 3]
    df = spark.createDataFrame([(i,) for i in ids], "id long").repartition(7)
    out = global_index(df, ["id"]).collect()
    got = sorted((r["id"], r["idx"]) for r in out)
    assert [g[1] for g in got] == list(range(5000))


def test_file_positions_across_splits(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"f{k}.txt").write_text("".join(f"file{k} line{i}\n" for i in range(4000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        df = read_lines(spark, str(tmp_path))
        rows = df.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(rows) == 12000
    for r in rows:
        k = int(r["file"][-5])
        assert r["value"] == f"file{k} line{r['line']}"


def test_line_rules(spark, tmp_path):
    p = tmp_path / "a.txt"
    p.write_text("h\nx\n\ny")  # unterminated last line counts
    assert count_lines(spark, str(p)) == 4
    q = tmp_path / "b.txt"
    q.write_text("one\x0btwo\rthree\nfour\n")
    lines = read_lines(spark, str(q), skip_lines=0, split_all_breaks=True).orderBy("line", "sub").collect()
    assert [r["value"] for r in lines] == "one\x0btwo\rthree\nfour\n".splitlines()
    d = tmp_path / "c.txt"
    d.write_text("r1||r2||r3||")
    recs = read_delimited(spark, str(d), "||").orderBy("line").collect()
    assert [r["value"] for r in recs] == ["r1", "r2", "r3"]
    e = tmp_path / "e.txt"
    e.write_bytes(b"x\r\ny\rz\n\n")
    recs = read_delimited(spark, str(e)).orderBy("line").collect()
    assert [r["value"] for r in recs] == ["x", "y", "z", ""]
    f = tmp_path / "f.txt"
    f.write_bytes(b"a\r\nb||c")
    recs = read_delimited(spark, str(f), "||").orderBy("line").collect()
    assert [r["value"] for r in recs] == ["a\nb", "c"]


def ids_frame(spark, n):
    return spark.createDataFrame([(i * 2, f"a{i}") for i in range(n)], "id long, article string")


def test_ratio_split_disjoint_cover(spark):
    for n, ratio in [(10, (80, 10, 10)), (97, (80, 10, 10)), (10, (80, 0, 20)), (33, (1, 1, 1))]:
        out = ratio_split(ids_frame(spark, n), "id", ratio).collect()
        assert len(out) == n and len({r["id"] for r in out}) == n
        counts = {s: sum(r["split"] == s for r in out) for s in ("train", "val", "test")}
        total = sum(ratio)
        t1 = ratio[0] / total * n
        assert counts["train"] == int(np.ceil(t1))
        if ratio[1] == 0:
            assert counts["val"] == 0


def test_size_split_overlap(spark):
    df = ids_frame(spark, 10)
    plain = size_split(df, 4, 3).collect()
    assert sorted(r["split"] for r in plain).count("train") == 4
    ov = size_split(df, 4, 3, overlap=True).collect()
    by = {s: sorted(r["id"] // 2 for r in ov if r["split"] == s) for s in ("train", "test", "valid")}
    # head -n 4 / tail -n +4 | head -n 3 / tail -n +3 of that
    assert by == {"train": [0, 1, 2, 3], "test": [3, 4, 5], "valid": [5, 6, 7, 8, 9]}


def test_head_tail_and_sampling(spark):
    df = ids_frame(spark, 20)
    parts = head_tail(df, 5).collect()
    assert sum(r["part"] == "head" for r in parts) == 5
    texts = spark.createDataFrame([(0, "é" * 10), (1, "abc"), (2, "x" * 30)], "id long, article string")
    kept = sample_pairs(texts, length=21).collect()  # 20 bytes + newline is not < 21
    assert sorted(r["id"] for r in kept) == [1]
    assert sample_share(texts, 21).first()["share"] == pytest.approx(33.33)
    with pytest.raises(NotImplementedError):
        sample_pairs(texts, method="random", length=3)


def test_prefix_offsets_blocks(spark):
    rng = np.random.default_rng(2)
    counts = [int(x) for x in rng.integers(0, 9, 1000)]
    df = spark.createDataFrame([(f"f{i:04d}", c) for i, c in enumerate(counts)], "file string, n long").repartition(5)
    got = {r["file"]: r["offset"] for r in prefix_offsets(df, "file", "n").collect()}
    running = 0
    for i, c in enumerate(counts):
        assert got[f"f{i:04d}"] == running
        running += c


def test_spread_only_when_scan_is_narrow(spark, tmp_path):
    from precis.session import spread

    one = spark.range(1000).coalesce(1)
    spread_one = spread(one, "id", min_partitions=4)
    assert spread_one.rdd.getNumPartitions() == 4
    assert sorted(r["id"] for r in spread_one.collect()) == list(range(1000))
    many = spark.range(1000).repartition(6)
    assert spread(many, "id", min_partitions=4) is many


def test_with_dense_ids_both_paths(spark, monkeypatch):
    from precis import session
    from precis.operators.ids import with_dense_ids

    rows = [(f"g{g}", i) for g in range(7) for i in range(g + 1)]
    df = spark.createDataFrame(rows, "file string, line long").repartition(3)
    expect, running = {}, 0
    for g in range(7):
        for i in range(g + 1):
            expect[(f"g{g}", i)] = running + i
        running += g + 1
    got = {(r["file"], r["line"]): r["id"] for r in with_dense_ids(df).collect()}
    assert got == expect
    monkeypatch.setattr(session, "BROADCAST_BYTES", 0)
    got = {(r["file"], r["line"]): r["id"] for r in with_dense_ids(df).collect()}
    assert got == expect


def test_join_per_group_salted_path(spark, monkeypatch):
    from precis import session
    from precis.operators.ids import join_per_group

    rows = spark.createDataFrame([("hot", i) for i in range(200)] + [("cold", 0)], "g string, i long")
    per = spark.createDataFrame([("hot", 10), ("cold", 20)], "g string, v long")
    plain = sorted(tuple(r) for r in join_per_group(rows, per, "g", [F.col("i")]).collect())
    monkeypatch.setattr(session, "BROADCAST_BYTES", 0)
    salted = join_per_group(rows, per, "g", [F.col("i")])
    assert "_salt" not in salted.columns
    assert sorted(tuple(r) for r in salted.collect()) == plain
    assert len(plain) == 201


def test_keys_at_ranks(spark):
    from precis.operators.ids import keys_at

    df = spark.createDataFrame([(i * 3,) for i in range(1000)], "id long").repartition(6)
    assert keys_at(df, "id", [0, 999, 500, 1000, 7]) == [0, 2997, 1500, None, 21]
    assert keys_at(df.where("false"), "id", [0, 1]) == [None, None]
    names = spark.createDataFrame([("b",), ("a",), ("é",)], "id string")
    assert keys_at(names, "id", [2, 0]) == ["é", "a"]


def test_splits_do_not_shuffle_text(spark):
    df = spark.range(0, 5000).selectExpr("id", "repeat('x', 50) as article").repartition(3)
    for out in (ratio_split(df), size_split(df, 100, 20), size_split(df, 100, 20, overlap=True), head_tail(df, 10)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and plan.count("Exchange") == 1  # the repartition above
    assert ratio_split(df).groupBy("split").count().collect()


def test_a_cluster_without_a_shared_folder_is_refused(monkeypatch):
    from types import SimpleNamespace

    from precis import session

    def fake(master, configured=None):
        sc = SimpleNamespace(master=master, getCheckpointDir=lambda: None, set=[],
                             getConf=lambda: SimpleNamespace(get=lambda key, default=None: configured))
        sc.setCheckpointDir = sc.set.append
        return SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda key, default=None: configured))

    for master in ("yarn", "spark://x:1", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            session.ensure_checkpoint_dir(fake(master))
    shared = fake("yarn", "hdfs://x/ckpt")
    session.ensure_checkpoint_dir(shared)
    assert shared.sparkContext.set == ["hdfs://x/ckpt"]
    local = fake("local[4]")
    session.ensure_checkpoint_dir(local)
    assert len(local.sparkContext.set) == 1


def test_written_tables_are_fixed_and_can_be_discarded(spark):
    import os

    from precis.session import discard, measured_bytes, written

    df = written(spark.createDataFrame([(1, "abc"), (2, None)], "id long, t string"))
    assert df.count() == 2 and measured_bytes(df) == 2 * 8 + 3 + 2 * 16
    path = df._written_at.removeprefix("file:")
    assert os.path.isdir(path)
    discard(df)
    assert not os.path.exists(path)


def test_generation_log_pairs_repeated_keys_in_order(spark):
    from precis.sources.files import parse_generation_log

    lines = ["T-1\tone", "H-1\t-0.1\tuno", "x", "T-2\ttwo", "T-1\tone ##s", "H-2\t-1\tdos", "H-1\t-0.2\tunos", "T-9\talone"]
    table = spark.createDataFrame(list(enumerate(lines)), "line long, value string").repartition(3)
    rows = sorted(tuple(r) for r in parse_generation_log(table, order_col="line").collect())
    assert rows == [("-1", "one", "uno"), ("-1", "ones", "unos"), ("-2", "two", "dos")]
    uneven = spark.createDataFrame([(0, "T-1\ta"), (1, "T-1\tb"), (2, "H-1\t0\tc")], "line long, value string")
    with pytest.raises(ValueError, match="generation log"):
        parse_generation_log(uneven, order_col="line")


def test_keys_at_by_histograms_and_by_sort(spark):
    import random

    from precis.operators import ids

    rng = random.Random(3)
    edge = [-(2**63), 2**63 - 1, 0, -1, 1, 2**62, -(2**62)]
    for keys in (list(range(5000)), edge, sorted({rng.randrange(-(2**63), 2**63) for _ in range(3000)}), [7],
                 [10**12 + 3 * i for i in range(9000)]):
        want = sorted(keys)
        ranks = [0, len(want) - 1, len(want) // 2, len(want) // 3, len(want), -1]
        table = spark.createDataFrame([(k,) for k in rng.sample(want, len(want))], "k long")
        expected = [want[r] if 0 <= r < len(want) else None for r in ranks]
        assert ids.keys_at(table, "k", ranks) == expected
    text = spark.createDataFrame([(f"k{i:04d}",) for i in range(300)], "k string")
    assert ids.keys_at(text, "k", [0, 299, 300]) == ["k0000", "k0299", None]
