"""Clusters of items that share keys, and what a reviewer needs to know of each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators.saved import numbered as in_order
from quillon.operators.saved import saved

#: Scores from which a candidate is worth showing, and from which it is strong. Neither ever confirms an identity.
RELEVANT, STRONG = 0.2, 0.8


def shared_key_clusters(items: DataFrame, item: str, keys: Column) -> DataFrame:
    """(item, cluster): items linked by a common key, directly or through others; the label is the cluster's least item.

    Items and keys are the two sides of a graph; the least label goes from items to keys and back until
    nothing changes. An item without keys is a cluster of its own.
    """
    # long keys travel as 128-bit digests
    key = F.when(F.length("key") > 32, F.md5("key")).otherwise(F.concat(F.lit("="), "key"))
    pairs = saved(items.select(F.col(item).alias("item"), F.explode(F.array_distinct(keys)).alias("key")).where("key is not null and key <> ''").withColumn("key", key), "pairs")
    labels = saved(items.select(F.col(item).alias("item"), F.col(item).alias("cluster")).distinct(), "labels")
    while True:
        by_key = pairs.join(labels, "item").groupBy("key").agg(F.min("cluster").alias("least"))
        offered = pairs.join(by_key, "key").groupBy("item").agg(F.min("least").alias("offer"))
        moved = labels.join(offered, "item", "left").select("item", F.least("cluster", F.coalesce("offer", "cluster")).alias("near"))
        # the label's own label may be less still: halves the way along chains
        jumped = moved.join(moved.select(F.col("item").alias("near"), F.col("near").alias("far")), "near", "left").select("item", F.least("near", F.coalesce("far", "near")).alias("cluster"))
        new = saved(jumped, "labels")
        if new.join(labels.withColumnRenamed("cluster", "old"), "item").where("cluster <> old").isEmpty():
            return new.withColumnRenamed("item", item)
        labels = new


def numbered(clusters: DataFrame, order: list[Column], pattern: str = "R-%03d") -> DataFrame:
    """clusters with an id by rank; however many there are, they aren't sorted in one task."""
    return in_order(clusters, order, "_n").withColumn("cluster_id", F.format_string(pattern, F.col("_n"))).drop("_n")


def _list_of(best: DataFrame) -> str:
    """The type of a list of candidates."""
    return f"array<struct<id:{best.schema['id'].dataType.simpleString()},score:{best.schema['score'].dataType.simpleString()}>>"


def cluster_review(items: DataFrame, first_source: str, relevant: float = RELEVANT, strong: float = STRONG) -> DataFrame:
    """One row per cluster of what review needs.

    items: (item, cluster, source, source_key, exact_id, variant_of, confirmed, candidates array<struct<id, score>>); item
    gives the order. Returns cluster, members, source_key (of the first item), rank (0 with the first source, 1 confirmed,
    2 variant, 3 other), priority (P0 to P3 alike), candidates (each id once with its best score, best first), n_relevant,
    n_strong, targets (exact ids), action (same_identity for one exact id; source_variant for one base and no exact id; else
    insufficient_evidence), target, confidence and genuine (needs a person's judgement).
    """
    best = items.select("cluster", F.inline("candidates").alias("id", "score")).groupBy("cluster", "id").agg(F.max("score").alias("score"))
    ranked = best.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("n"), "id"))).alias("_c"))
    sums = items.groupBy("cluster").agg(
        F.count("*").alias("members"), F.min_by("source_key", "item").alias("source_key"), F.max(F.col("source") == first_source).alias("_first"), F.max(F.coalesce("confirmed", F.lit(False))).alias("_confirmed"),
        F.array_sort(F.collect_set("exact_id")).alias("targets"), F.array_sort(F.collect_set("variant_of")).alias("_bases"))
    out = sums.join(ranked, "cluster", "left").withColumn("candidates", F.coalesce(F.transform("_c", lambda c: F.struct(c["id"].alias("id"), (-c["n"]).alias("score"))), F.array().cast(_list_of(best))))
    rank = F.when(F.col("_first"), 0).when(F.col("_confirmed"), 1).when(F.size("_bases") > 0, 2).otherwise(3)
    action = F.when(F.size("targets") == 1, "same_identity").when((F.size("targets") == 0) & (F.size("_bases") == 1), "source_variant").otherwise("insufficient_evidence")
    out = out.withColumn("rank", rank).withColumn("priority", F.concat(F.lit("P"), F.col("rank").cast("string"))).withColumn("action", action)
    out = out.withColumn("n_relevant", F.size(F.filter("candidates", lambda c: c["score"] >= relevant))).withColumn("n_strong", F.size(F.filter("candidates", lambda c: c["score"] >= strong)))
    sure = F.col("action") != "insufficient_evidence"
    out = out.withColumn("target", F.when(F.col("action") == "same_identity", F.get("targets", 0))).withColumn("confidence", F.when(sure, "strong").when(F.col("n_relevant") > 0, "supporting_only").otherwise("low"))
    return out.withColumn("genuine", (F.col("rank") <= 1) | sure).drop("_c", "_first", "_confirmed", "_bases")


def questions(review: DataFrame, templates: dict[str, str], other: str) -> DataFrame:
    """review with the question to ask: the priority's template, or the other one, filled with the source key."""
    text = F.format_string(other, "source_key")
    for priority, template in templates.items():
        text = F.when(F.col("priority") == priority, F.format_string(template, "source_key")).otherwise(text)
    return review.withColumn("question", text)


def supporting(clusters: DataFrame, others: DataFrame, name: str, cost: str, category: str) -> DataFrame:
    """(cluster, name, follow_up): rows of another source of the same name support a cluster; a differing cost or category is to be followed up.

    Never a confirmation: the clusters' own columns stay as they are. clusters: (cluster, name, cost, category).
    """
    o = others.select(name, F.col(cost).alias("_cost"), F.col(category).alias("_category"))
    differs = lambda a, b: F.coalesce(a != b, F.lit(False))
    parts = F.array_compact(F.array(F.when(differs(F.col(cost), F.col("_cost")), F.lit("cost")), F.when(differs(F.col(category), F.col("_category")), F.lit("category"))))
    return clusters.join(o, name).select("cluster", name, F.array_join(parts, ",").alias("follow_up"))
