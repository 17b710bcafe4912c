"""Joins by overlap against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from quillon.operators import ranges as N


def intervals(rng, n):
    out = []
    for i in range(n):
        a = rng.randrange(-200, 3000)
        length = rng.choice([0, 0, 1, 3, 17, 64, 127, 128, 129, 1000, 5000])
        out.append((i, a, a + length, rng.choice(["x", "y", None])))
    return out + [(n, None, 5, "x"), (n + 1, 5, None, "x"), (n + 2, 50, 40, "y"), (n + 3, 50, 40, "y"), (n + 3, 50, 40, "y")]


@pytest.mark.parametrize("hot", [3, 20_000])
def test_overlaps_by_all_pairs(spark, hot):
    rng = random.Random(hot)
    ls, rs = intervals(rng, 150), intervals(rng, 120)
    left = spark.createDataFrame(ls, "l int, a long, b long, lk string")
    right = spark.createDataFrame(rs, "r int, c long, d long, rk string")
    meet = lambda x, y: None not in (x[1], x[2], y[1], y[2]) and x[1] <= y[2] and y[1] <= x[2]
    want = sorted((x[0], y[0]) for x in ls for y in rs if meet(x, y))
    assert sorted((r["l"], r["r"]) for r in N.overlapping(left, right, ("a", "b"), ("c", "d"), hot=hot).collect()) == want
    want = sorted((x[0], y[0]) for x in ls for y in rs if meet(x, y) and x[3] is not None and x[3] == y[3])
    assert sorted((r["l"], r["r"]) for r in N.overlapping(left, right, ("a", "b"), ("c", "d"), [("lk", "rk")], hot).collect()) == want
    assert N.overlapping(left.where("false"), right, ("a", "b"), ("c", "d")).count() == 0


def test_overlaps_of_other_kinds(spark):
    left = spark.createDataFrame([(1, 0.2, 0.4), (2, 0.4, 0.9)], "l int, a double, b double")
    right = spark.createDataFrame([(1, 0.45, 0.5), (2, -3.0, 0.3)], "r int, c double, d double")
    assert sorted((r["l"], r["r"]) for r in N.overlapping(left, right, ("a", "b"), ("c", "d")).collect()) == [(1, 2), (2, 1)]
    point = "struct<stage:int,round:int>"
    records = spark.createDataFrame([(1, [((2, 1), (3, 5))]), (2, [((4, 1), (4, 2)), ((5, 1), (9, 7))]), (3, [])], f"k int, ranges array<struct<start:{point},end:{point}>>")
    references = spark.createDataFrame([("a", [((3, 5), (3, 6)), ((4, 2), (5, 1))], None), ("b", [((1, 1), (4, 1))], (4, 1)), ("c", [((1, 1), (9, 9))], (10, 1)), ("d", None, None)], f"ref string, windows array<struct<start:{point},end:{point}>>, since {point}")
    got = {tuple(r) for r in N.reference_pool(records, references, "k", "ref", "ranges", "windows", "since").collect()}
    assert got == {(1, "a"), (2, "a"), (2, "b")}


def test_no_join_of_all_pairs(spark):
    left = spark.range(10).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    right = left.toDF("c", "d")
    plan = N.overlapping(left, right, ("a", "b"), ("c", "d"))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_sparse_rows_are_entered_once(spark, monkeypatch):
    """Where bins have few rows, all meet at one level, in one join and without a salt, whatever their lengths; crowded bins keep theirs."""
    levels, salts = [], []
    entries, salted = N._entries, N._salted
    monkeypatch.setattr(N, "_entries", lambda *x: levels.append(x[2]) or entries(*x))
    monkeypatch.setattr(N, "_salted", lambda *x: salts.append(salted(*x)) or salts[-1])
    rng = random.Random(5)
    make = lambda n: [(i, a, a + rng.choice([0, 1, 3, 17, 100, 1000]), i % 7) for i in range(n) for a in [rng.randrange(100_000)]]
    ls, rs = make(300), make(200)
    left, right = spark.createDataFrame(ls, "l int, a long, b long, lk int"), spark.createDataFrame(rs, "r int, c long, d long, rk int")
    want = sorted((x[0], y[0]) for x in ls for y in rs if x[1] <= y[2] and y[1] <= x[2] and x[3] == y[3])
    assert sorted((r["l"], r["r"]) for r in N.overlapping(left, right, ("a", "b"), ("c", "d"), [("lk", "rk")]).collect()) == want and want
    assert levels == [[10], [10]] and [x[2] for x in salts] == [["_level", "_bin", "_k0"]]
    levels.clear(), salts.clear()
    thick = spark.range(400).selectExpr("cast(id as int) as r", "id % 5 as c", "id % 5 + if(id % 50 = 0, 1000, 1) as d", "cast(3 as int) as rk")
    dense = spark.range(500).selectExpr("cast(id as int) as l", "id % 5 as a", "id % 5 as b", "cast(3 as int) as lk")
    got = N.overlapping(dense, thick, ("a", "b"), ("c", "d"), [("lk", "rk")], hot=20)
    assert got.count() == dense.crossJoin(thick).where("a <= d and c <= b").count() and got.distinct().count() == got.count()
    assert len(levels[0]) > 1 and any("_salt" in x[2] for x in salts)
