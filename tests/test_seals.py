"""The hash tree of evidence: what changed is named, and only its path is hashed again."""

import pytest
from pyspark.sql import functions as F

from quillon.operators import align as A
from quillon.operators import seals as S

COLUMNS = ["evidence_id", "source_id", "value"]


def evidence(spark, n=40):
    return spark.createDataFrame([(f"E{i}", f"R{i % n:02d}", f"s{i % 3}", str(i * i)) for i in range(5 * n)], "evidence_id string, review string, source_id string, value string")


@pytest.mark.parametrize("fan", [2, 3, 16])
def test_tree(spark, fan):
    rows = evidence(spark)
    nodes = S.tree(rows, "review", COLUMNS, fan)
    n, sizes = 40, [40]
    while n > 1:
        n = -(-n // fan)
        sizes.append(n)
    assert sorted((r["level"], r["count"]) for r in nodes.groupBy("level").count().collect()) == list(enumerate(sizes))
    assert {tuple(r) for r in S.tree(rows.repartition(7, "value"), "review", COLUMNS, fan).collect()} == {tuple(r) for r in nodes.collect()}
    assert S.differences(nodes, rows, "review", COLUMNS, fan).count() == 0

    other = rows.where("review <> 'R07'").withColumn("value", F.when(F.col("evidence_id") == "E3", "changed").otherwise(F.col("value"))).unionByName(rows.limit(1).withColumn("review", F.lit("R99")))
    found = {tuple(r) for r in S.differences(nodes, other, "review", COLUMNS, fan).collect()}
    assert {("R03", "changed"), ("R07", "missing"), ("R99", "added")} <= found and all(r in ("R00", "R03", "R07", "R99") for r, _ in found)
    forged = nodes.withColumn("digest", F.when((F.col("level") == 1) & (F.col("node") == 0), "x").otherwise(F.col("digest")))
    assert {r["problem"] for r in S.differences(forged, rows, "review", COLUMNS, fan).collect()} == {"broken"}


def test_override_reseals_its_path(spark):
    rows = evidence(spark)
    manifest = spark.createDataFrame([("s0", "A", None), ("s1", "B", "x")], "source_id string, tier string, note string")
    nodes = S.tree(rows, "review", COLUMNS, 4)
    overrides = spark.createDataFrame([("R11", "42")], "review string, value string")
    more, sources = S.override_evidence(rows, manifest, overrides, "review", F.concat_ws(":", "review", F.lit("cost")), {"source_id": "manual", "tier": "E"})
    assert more.count() == rows.count() + 1 and [tuple(r) for r in sources.where("source_id = 'manual'").collect()] == [("manual", "E", None)]
    assert S.override_evidence(more, sources, overrides, "review", F.col("review"), {"source_id": "manual"})[1].count() == sources.count()
    again = S.resealed(nodes, more.where("review = 'R11'"), "review", COLUMNS, 4)
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in S.tree(more, "review", COLUMNS, 4).collect()}
    old = {(r["level"], r["node"]): r["digest"] for r in nodes.collect()}
    assert sorted((r["level"], r["node"]) for r in again.collect() if old[r["level"], r["node"]] != r["digest"]) == [(0, 11), (1, 2), (2, 0), (3, 0)]
    before, after = (S.seal(x, m, rows).first() for x, m in ((nodes, manifest), (again, sources)))
    assert before["evidence_digest"] != after["evidence_digest"] and before["manifest_digest"] != after["manifest_digest"] and before["baseline_digest"] == after["baseline_digest"]
    with pytest.raises(ValueError, match="not sealed"):
        S.resealed(nodes, more.limit(1).withColumn("review", F.lit("R99")), "review", COLUMNS, 4)
    assert S.tree(rows.where("false"), "review", COLUMNS).count() == 0 and len(S.root(S.tree(rows.where("false"), "review", COLUMNS)).first()["digest"]) == 64


def test_json_diff(spark):
    pairs = [
        (1, '{"a": 1, "b": {"x": [1, {"y": null}], "z": true}, "same": [1]}', '{"a": 1.0, "b": {"x": [1, {"y": 0}, "new"], "z": 1}, "same": [1]}'), (2, '{"a": null}', "{}"), (3, "[1, 2]", '{"0": 1}'), (4, "{}", "{}"), (5, '{"a": []}', '{"a": {}}'), (6, "[]", "[[]]"), (7, None, "1"), (8, '{"é.x": "ü"}', '{"é.x": "u"}')]
    got = {tuple(r) for r in A.json_diff(spark.createDataFrame(pairs, "k int, o string, n string"), "k", "o", "n").collect()}
    assert got == {(1, "b.x[1].y", "null", "0"), (1, "b.x[2]", None, '"new"'), (1, "b.z", "true", "1"), (2, "a", "null", None), (3, "", "[1,2]", '{"0":1}'), (5, "a", "[]", "{}"), (6, "[0]", None, "[]"), (7, "", None, "1"), (8, "é.x", '"ü"', '"u"')}
