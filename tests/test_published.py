"""Publications: all or nothing, and what was visible stays so."""

import pytest
from pyspark.sql import functions as F

from quillon.sources import published as P


def test_versions(spark, tmp_path):
    root = str(tmp_path / "out")
    assert P.current(spark, root) is None
    with pytest.raises(ValueError, match="not published"):
        P.read(spark, root, "a")
    a, b = spark.range(5).toDF("k"), spark.range(3).select(F.col("id").alias("n"), F.lit(None).cast("string").alias("s"))
    first = P.publish({"a": a, "b": b}, root)
    old = P.read(spark, root, "a")
    assert P.problems(spark, root).count() == 0
    second = P.publish({"a": a.limit(0), "b": b}, root)
    assert (first.number, second.number) == (1, 2)
    assert P.read(spark, root, "a").count() == 0 and P.read(spark, root, "a").columns == ["k"]
    assert old.count() == 5  # a reader keeps the version it began with

    with pytest.raises(ValueError, match="not published"):
        P.publish({"a": a, "b": b}, root, lambda t: t["b"].where("n = 2"))
    with pytest.raises(Exception, match="boom"):
        P.publish({"a": a.where(F.raise_error(F.lit("boom")) == 1)}, root)
    assert P.current(spark, root).version == second.version
    assert sorted(p.name for p in (tmp_path / "out" / "versions").iterdir()) == sorted([first.version, second.version])

    assert P.prune(spark, root, 1) == 1 and P.prune(spark, root, 1) == 0
    assert P.read(spark, root, "b").count() == 3
    b.write.mode("append").parquet(f"{root}/versions/{second.version}/b")
    assert [tuple(r) for r in P.problems(spark, root).collect()] == [("b", "changed")]


def test_two_publishers(spark, tmp_path, monkeypatch):
    root, a = str(tmp_path / "out"), spark.range(2).toDF("k")
    P.publish({"a": a}, root)
    monkeypatch.setattr(P, "_numbers", lambda spark, root: [])
    with pytest.raises(ValueError, match="at the same time"):
        P.publish({"a": a}, root)
