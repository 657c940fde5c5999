"""Scores of any shape, and state that grows shard by shard."""

import collections

import pytest
from pyspark.sql import functions as F

from precis.operators import measures as M
from precis.operators.lines import score_with

Five = collections.namedtuple("Five", "a b c d e")


class Odd:
    def score(self, target, prediction):
        out = {"five": Five(len(target), len(prediction), 1, 2, 3), "two": (0.5, len(target)), "one": 7, "map": {"x y": 1.5}}
        return out if target else {"two": (0.0, 0.0)}


def pairs(spark, n):
    return spark.createDataFrame([(i, "t" * (i % 5), "p" * i) for i in range(n)], "id long, target string, prediction string")


def test_named_values():
    assert M.named_values(Five(1, 2, 3, 4, 5)) == [("a", 1.0), ("b", 2.0), ("c", 3.0), ("d", 4.0), ("e", 5.0)]
    assert M.named_values((1, 2)) == [("0", 1.0), ("1", 2.0)] and M.named_values(3) == [("value", 3.0)]
    assert M.named_values({"k": 2}) == [("k", 2.0)] and M.named_values([]) == []


def test_any_shape_reaches_reports_and_intervals(spark):
    packed = M.score_measures(pairs(spark, 12), Odd())
    rows = {(r.id, r.score_type, r.measure): r.value for r in M.long_measures(packed).collect()}
    assert rows[1, "five", "b"] == 1 and rows[2, "two", "1"] == 2 and rows[3, "one", "value"] == 7 and rows[4, "map", "x y"] == 1.5
    assert {k[1] for k in rows if k[0] == 5} == {"two"}
    wide = {r.id: r for r in M.measure_report(packed, [("five", "a"), ("two", "0"), ("none", "x")]).collect()}
    assert wide[1]["five-a"] == 1 and wide[5]["five-a"] is None and wide[5]["two-0"] == 0 and wide[1]["none-x"] is None
    found = {(r.score_type, r.measure): r for r in M.state_intervals(M.score_state(packed, 60, 3)).collect()}
    assert len(found) == 5 + 2 + 1 + 1 and found["one", "value"].low == found["one", "value"].high == 7
    two = found["two", "0"]  # pairs without a target have 0
    assert abs(two["mean"] - 9 * 0.5 / 12) < 1e-12 and two.low <= two.mid <= two.high and two.low < two.high


def test_other_shapes_are_refused_where_three_are_wanted(spark):
    with pytest.raises(Exception, match="use score_measures"):
        score_with(pairs(spark, 2), Odd()).collect()


@pytest.mark.parametrize("shards", [1, 4])
def test_any_sharding_equals_one_pass(spark, tmp_path, shards):
    packed = M.score_measures(pairs(spark, 40), Odd())
    folder = str(tmp_path / "state")
    for k in range(shards):
        M.add_scores(packed.where(F.pmod("id", F.lit(shards)) == k), folder, str(k), 50, 9)
    key = lambda r: (r.score_type, r.measure, r.resample)
    added = {key(r): (r.weight, r.total) for r in M.read_state(spark, folder).collect()}
    once = {key(r): (r.weight, r.total) for r in M.score_state(packed, 50, 9).collect()}
    assert added.keys() == once.keys() and len(once) > 9 * 40
    assert all(added[k] == pytest.approx(once[k], abs=1e-9) for k in once)
    with pytest.raises(Exception, match="(?i)exist"):
        M.add_scores(packed, folder, "0", 50, 9)
    M.add_scores(packed, folder, "other", 51, 9)
    with pytest.raises(ValueError, match="different draws"):
        M.read_state(spark, folder)


def test_no_pairs(spark):
    empty = M.score_measures(pairs(spark, 3).where("false"), Odd())
    assert M.score_state(empty, 10).collect() == [] and M.state_intervals(M.score_state(empty, 10)).collect() == []
