"""A stream published version by version: each micro-batch is merged into the published table, and becomes visible whole or not at all."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillon.sources import published


def keep_last(key: str, order: str) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """A merge that keeps the row of the highest order for each key, of what is published and what comes; at equal order what is published stays."""

    def merge(before: DataFrame, batch: DataFrame) -> DataFrame:
        both = before.withColumn("_new", F.lit(0)).unionByName(batch.withColumn("_new", F.lit(1)))
        rest = [c for c in before.columns if c != key]
        best = both.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(F.col(order).isNotNull().alias("has"), F.col(order).alias("order"), (-F.col("_new")).alias("old"))).alias("_row"))
        return best.select(key, "_row.*").select(*before.columns)

    return merge


def publish_stream(stream: DataFrame, root: str, checkpoint: str, merge: Callable[[DataFrame, DataFrame], DataFrame], checks: Callable[[dict[str, DataFrame]], DataFrame] | None = None, keep: int = 2, **trigger) -> StreamingQuery:
    """Starts a query that publishes merge(published rows, micro-batch) as the table `rows` of root, once for each micro-batch.

    The number of a batch is in the manifest, so a batch that is run again after a failure changes nothing. A batch that fails
    a check stops the query, and readers keep what they had. Older versions but `keep` are removed; a reader that outlasts them must begin anew.
    """
    if not stream.isStreaming:
        raise ValueError("not a stream")

    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        found = published.current(spark, root)
        if found and found.note.get("batch", -1) >= number:
            return
        before = published.read(spark, root, "rows") if found else spark.createDataFrame([], batch.schema)
        published.publish({"rows": merge(before, batch)}, root, checks, {"batch": number})
        published.prune(spark, root, keep)

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
