"""The similarity join against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators import resolve as R
from quillon.operators import similar as S


def catalogues(spark, seed, n_left=60, n_right=90):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(0, 7)))
    right = [(i, f"{word()} {word()}".strip(), " ".join(word() for _ in range(6)), rng.choice(["x", "y", "z", None]), rng.choice([1, 2, 3, None])) for i in range(n_right)]
    left = []
    for i in range(n_left):
        _, name, effect, kind, cost = rng.choice(right)
        if i % 3:
            name = name.replace("a", "b", 1)
            effect = effect[3:]
        if i % 7 == 0:
            name, effect, kind = "", None, None
        if i % 11 == 0:
            name, effect = "qqq www", "vvv"
        left.append((f"l{i}", name, effect, kind, cost))
    r = spark.createDataFrame(right, "r int, rname string, reffect string, rkind string, rcost int").withColumn("rgrams", T.bigrams(F.col("rname"))).withColumn("regrams", T.bigrams(F.col("reffect")))
    l = spark.createDataFrame(left, "l string, lname string, leffect string, lkind string, lcost int").withColumn("lgrams", T.bigrams(F.col("lname"))).withColumn("legrams", T.bigrams(F.col("leffect")))
    return l, r


SCORES = {
    "dice": S.Score([(1.0, [S.Dice("legrams", "regrams")]), (0.25, [S.Dice("lgrams", "rgrams"), S.Dice("legrams", "rgrams")])], [(0.15, "lkind", "rkind"), (0.1, "lcost", "rcost")]),
    "edit": S.Score([(0.55, [S.Edit("lname", "rname")]), (0.25, [S.Edit("leffect", "reffect")])], [(0.1, "lkind", "rkind"), (0.05, "lcost", "rcost")]),
    "name": S.Score([(1.0, [S.Edit("lname", "rname")])]),
}


def all_pairs(left, right, score):
    return left.crossJoin(right).withColumn("score", score.value())


@pytest.mark.parametrize("kind", sorted(SCORES))
def test_most_similar_by_all_pairs(spark, kind):
    left, right = catalogues(spark, len(kind))
    score, n = SCORES[kind], 4
    want = {}
    for r in all_pairs(left, right, score).select("l", "r", "score").collect():
        want.setdefault(r["l"], []).append((-round(r["score"], 12), r["r"]))
    want = {(x, i + 1): (r, -s) for x, rows in want.items() for i, (s, r) in enumerate(sorted(rows)[:n])}
    found = S.most_similar(left, right, "l", "r", score, n)
    got = {(r["l"], r["rank"]): (r["r"], round(r["score"], 12)) for r in found.collect()}
    assert got == want
    assert {"lname", "rname"} <= set(found.columns)


@pytest.mark.parametrize("kind", sorted(SCORES))
def test_at_least_by_all_pairs(spark, kind):
    left, right = catalogues(spark, 5)
    for bound in (0.3, 0.62):
        want = {(r["l"], r["r"]) for r in all_pairs(left, right, SCORES[kind]).select("l", "r", "score").collect() if round(r["score"], 12) >= bound}
        assert {(r["l"], r["r"]) for r in S.at_least(left, right, "l", "r", SCORES[kind], bound).collect()} == want


def test_similar_edges(spark):
    left, right = catalogues(spark, 3, 6, 2)
    score = SCORES["dice"]
    assert S.most_similar(left, right, "l", "r", score, 3).count() == 12
    assert S.most_similar(left.where("false"), right, "l", "r", score, 3).count() == 0
    assert S.most_similar(left, right.where("false"), "l", "r", score, 3).count() == 0
    with pytest.raises(ValueError):
        S.at_least(left, right, "l", "r", score, 0.2)


def test_no_join_of_all_pairs(spark):
    left, right = catalogues(spark, 1)
    plans = [S.most_similar(left, right, "l", "r", SCORES["edit"], 3), R.identity_search(left, right, "l", "r", {"kind": (F.col("lkind"), F.col("rkind"))}, ("kind",), SCORES["edit"])]
    for df in plans:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_pairs_looked_up(spark):
    """With good partners about, only a part of the pairs is looked at: of 400 names with 400 near copies not all 160,000, nor a tenth of them."""
    rng = random.Random(6)
    names = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(14)) for _ in range(400)]
    left = spark.createDataFrame([(f"l{i}", x) for i, x in enumerate(names)], "l string, lname string")
    right = spark.createDataFrame([(i, x[:5] + "!" + x[6:]) for i, x in enumerate(names)], "r int, rname string")
    index = S._Index(left, right, "l", "r", SCORES["name"])
    found = index.reaching(left.select(F.col("l").alias("id"), F.lit(0.8).alias("bound"))).distinct()
    assert 400 <= found.count() < 16_000
