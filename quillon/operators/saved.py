"""Tables in the folder that the driver and all executors share: what cuts lineage, and numbers rows without one task for all."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.

    Only on a single machine (tests), where it may be unset, a folder of this application stands in; a cluster without it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints", spark.sparkContext.applicationId)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there is removed when the driver ends."""
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"

    def remove() -> None:
        try:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the JVM may be gone; this is scratch space
            pass

    atexit.register(remove)
    return path


def saved(df: DataFrame, name: str = "table") -> DataFrame:
    """df, written and read back, so that lost executors cost no recomputation."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df dealt out to a few tasks a core: for a small file whose rows are much work, which would be one task's."""
    return df.repartition(3 * df.sparkSession.sparkContext.defaultParallelism)


def numbered(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """df with the place of each row, from 1, in an order. Rows are sorted over all tasks; only a count per task meets in one place."""
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(name, F.monotonically_increasing_id())
    placed = saved(placed, "sorted").withColumn("_task", F.shiftright(name, 33))
    before, starts = 0, []
    for task, n in sorted(tuple(r) for r in placed.groupBy("_task").agg(F.count("*")).collect()):
        starts += [F.lit(task).cast("long"), F.lit(before).cast("long")]
        before += n
    start = F.create_map(*starts)[F.col("_task")] if starts else F.lit(0)
    return placed.withColumn(name, start + F.col(name).bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_task")
