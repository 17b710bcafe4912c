"""Frozen evidence as a hash tree: a seal that tells which review changed, and that is renewed along one path only.

Each review's rows have one digest, whatever their order; digests are hashed in groups of FAN, groups of groups alike, up to a root, which is sealed
together with the manifest of sources and the baseline. Reviews keep their places, so a change is hashed again in as many groups as the
tree is high. Nodes are rows (level, node, digest, review); no review and no level is gathered in one place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators.saved import numbered, saved
from quillon.operators.validate import digest

FAN = 16


def review_digests(evidence: DataFrame, review: str, columns: Sequence[str]) -> DataFrame:
    """(review, rows, digest) of the rows of each review: a sum of row digests, so that rows needn't be sorted or held."""
    one = F.conv(F.substring(F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    sums = evidence.groupBy(F.col(review).cast("string").alias("review")).agg(F.count("*").alias("rows"), F.sum(one).alias("_sum"))
    return sums.select("review", "rows", F.sha2(F.concat_ws("|", "review", F.col("rows").cast("string"), F.col("_sum").cast("string")), 256).alias("digest"))


def _parents(children: DataFrame, fan: int) -> DataFrame:
    """(node, digest) of the groups of (node, digest): the digest of theirs in order."""
    group = F.floor(F.col("node") / fan).cast("long")
    return children.groupBy(group.alias("node")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", "digest"))), lambda c: c["digest"]), "|"), 256).alias("digest"))


def _level(rows: DataFrame, level: int) -> DataFrame:
    names = rows.columns
    return rows.select(F.lit(level).alias("level"), "node", "digest", F.col("review") if "review" in names else F.lit(None).cast("string").alias("review"))


def tree(evidence: DataFrame, review: str, columns: Sequence[str], fan: int = FAN) -> DataFrame:
    """(level, node, digest, review) of all nodes; level 0 are reviews in order of their names, the last level is the root. No evidence, no nodes."""
    leaves = numbered(review_digests(evidence, review, columns).select("review", "digest"), [F.col("review")], "node").withColumn("node", F.col("node") - 1)
    return _grown(saved(leaves, "leaves"), fan)


def _grown(leaves: DataFrame, fan: int) -> DataFrame:
    out, level, below = _level(leaves, 0), 0, leaves
    while below.count() > 1:
        level += 1
        below = saved(_parents(below, fan), "nodes")
        out = out.unionByName(_level(below, level))
    return out


def root(nodes: DataFrame) -> DataFrame:
    """(digest) of the root, one row; of an empty tree the digest of nothing."""
    return nodes.agg(F.coalesce(F.max_by("digest", "level"), F.sha2(F.lit(""), 256)).alias("digest"))


def seal(nodes: DataFrame, manifest: DataFrame, baseline: DataFrame) -> DataFrame:
    """One row: the digests of the tree's root, the manifest and the baseline, and of the three together."""
    parts = [root(nodes).withColumnRenamed("digest", "evidence_digest"), *(digest(df, sorted(df.columns)).select(F.col("rows").alias(f"{n}_rows"), F.col("digest").alias(f"{n}_digest")) for n, df in (("manifest", manifest), ("baseline", baseline)))]
    out = parts[0].crossJoin(parts[1]).crossJoin(parts[2])  # single rows
    return out.withColumn("bundle_digest", F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in out.columns]), 256))


def differences(nodes: DataFrame, evidence: DataFrame, review: str, columns: Sequence[str], fan: int = FAN) -> DataFrame:
    """(review, problem) of evidence that isn't what was sealed (changed, missing, added), and (null, broken) for nodes that aren't their children's digest."""
    now = review_digests(evidence, review, columns).select("review", F.col("digest").alias("_now"))
    both = nodes.where("level = 0").select("review", F.col("digest").alias("_then")).join(now, "review", "full_outer")
    problem = F.when(F.col("_then").isNull(), "added").when(F.col("_now").isNull(), "missing").when(F.col("_then") != F.col("_now"), "changed")
    out = both.select("review", problem.alias("problem")).where("problem is not null")
    group = F.floor(F.col("node") / fan).cast("long")
    made = nodes.groupBy((F.col("level") + 1).alias("level"), group.alias("node")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", "digest"))), lambda c: c["digest"]), "|"), 256).alias("_made"))
    broken = nodes.where("level > 0").join(made, ["level", "node"], "left").where(~F.col("digest").eqNullSafe(F.col("_made")))
    return out.unionByName(broken.select(F.lit(None).cast("string").alias("review"), F.lit("broken").alias("problem")))


def resealed(nodes: DataFrame, changed: DataFrame, review: str, columns: Sequence[str], fan: int = FAN) -> DataFrame:
    """nodes after reviews have new evidence: changed holds all rows of the changed reviews. Only their paths are hashed again.

    Reviews of changed that the tree doesn't have are refused: they would move others, and ask for a new tree.
    """
    fresh = review_digests(changed, review, columns).select("review", F.col("digest").alias("_new"))
    own = nodes.where("level = 0").select("node", "review")
    moved = saved(fresh.join(own, "review", "left"), "moved")
    if not moved.where("node is null").isEmpty():
        raise ValueError("a review that was not sealed: seal all of them anew")
    touched = moved.select(F.lit(0).alias("level"), "node", F.col("_new").alias("digest"))
    height = nodes.agg(F.max("level")).first()[0] or 0
    for level in range(height):
        paths = touched.where(F.col("level") == level).select(F.floor(F.col("node") / fan).cast("long").alias("_parent")).distinct()
        below = nodes.where(F.col("level") == level).select("node", "digest").withColumn("_parent", F.floor(F.col("node") / fan).cast("long")).join(paths, "_parent", "left_semi")
        new = touched.where(F.col("level") == level).select("node", F.col("digest").alias("_new"))
        again = _parents(below.join(new, "node", "left").select("node", F.coalesce("_new", "digest").alias("digest")), fan)
        touched = saved(touched.unionByName(again.select(F.lit(level + 1).alias("level"), "node", "digest")), "touched")
    new = touched.select("level", "node", F.col("digest").alias("_new"))
    return nodes.join(new, ["level", "node"], "left").select("level", "node", F.coalesce("_new", "digest").alias("digest"), "review")


def override_evidence(evidence: DataFrame, manifest: DataFrame, overrides: DataFrame, review: str, key: Column, source: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """evidence and manifest with what a manual override leaves behind: a row for each override, and the source that it is from, once.

    overrides: (review, value); evidence has at least (evidence_id, review, source_id, value); key tells an override apart, and its id is made of it. Other columns
    of evidence and manifest are null, or what source (by column name, source_id among them) says.
    """
    made = {"evidence_id": F.concat(F.lit("MANUAL-"), F.substring(F.sha2(key.cast("string"), 256), 1, 12)), review: F.col(review), "value": F.col("value")}
    cell = lambda f: made[f.name] if f.name in made else F.lit(source.get(f.name))
    rows = overrides.select(*[cell(f).cast(f.dataType).alias(f.name) for f in evidence.schema])
    known = manifest.where(F.col("source_id") == source["source_id"]).limit(1)
    one = evidence.sparkSession.range(1).select(*[F.lit(source.get(f.name)).cast(f.dataType).alias(f.name) for f in manifest.schema])
    return evidence.unionByName(rows), manifest.unionByName(one.join(known.select("source_id"), "source_id", "left_anti").select(*manifest.columns))
