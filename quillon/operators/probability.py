"""Equal-weight probabilities relative to a pool. The pool's size never depends on what a search found in it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def equal_weight(pool: DataFrame, target: Column) -> DataFrame:
    """(pool_size, target_count, target_probability, per_record_probability); probabilities of an empty pool are 0."""
    sums = pool.agg(F.count("*").alias("pool_size"), F.count_if(F.coalesce(target, F.lit(False))).alias("target_count"))
    return sums.withColumn("target_probability", F.coalesce(F.try_divide("target_count", "pool_size"), F.lit(0.0))).withColumn("per_record_probability", F.coalesce(F.try_divide(F.lit(1), "pool_size"), F.lit(0.0)))


def by_slot(pool: DataFrame, target: Column, forced: Column, slot: str = "uncertain") -> DataFrame:
    """One row per mode: ordinary over the whole pool, forced over its forced part; an uncertain slot gives both, unblended."""
    if slot not in ("ordinary", "forced", "uncertain"):
        raise ValueError(slot)
    hit, own = F.coalesce(target, F.lit(False)), F.coalesce(forced, F.lit(False))
    sums = pool.agg(F.count("*").alias("n"), F.count_if(hit).alias("k"), F.count_if(own).alias("fn"), F.count_if(hit & own).alias("fk"))
    modes = {"ordinary": ("n", "k"), "forced": ("fn", "fk")}
    rows = [F.struct(F.lit(m).alias("mode"), F.col(n).alias("pool_size"), F.col(k).alias("target_count"), F.coalesce(F.try_divide(k, n), F.lit(0.0)).alias("target_probability")) for m, (n, k) in modes.items() if slot in (m, "uncertain")]
    return sums.select(F.inline(F.array(*rows)))


def per_record(records: DataFrame, eligible: Column) -> DataFrame:
    """records with probability: one over the number of eligible ones, 0 for others. The count is one row, joined by broadcast."""
    n = records.agg(F.count_if(F.coalesce(eligible, F.lit(False))).alias("_n"))
    p = F.when(F.coalesce(eligible, F.lit(False)), 1 / F.col("_n")).otherwise(0.0)
    return records.crossJoin(F.broadcast(n)).withColumn("probability", p).drop("_n")


def per_card(pool: DataFrame, forced: Column, slot: str) -> DataFrame:
    """pool with each record's probability in a slot: ordinary, forced, or uncertain, where a card shows that of the ordinary slot."""
    return per_record(pool, forced) if slot == "forced" else per_record(pool, F.lit(True))
