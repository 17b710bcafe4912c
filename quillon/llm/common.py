"""Shared helpers of the training-data operators: reading tables, shared storage, word hashing."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of Arrow data handed to Python at once; long texts then come in smaller batches.
ARROW_BATCH_BYTES = 1 << 20
ARROW_BATCH_ROWS = 2048

_U = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, through Spark's reader only (the path can be in any store)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds, in rows and in bytes, whatever the length of the texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BATCH_BYTES))


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.

    Only on a single machine (tests), where it may be unset, a folder of this process is used; a cluster without it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints", spark.sparkContext.applicationId)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver's Python ends."""
    path = f"{shared_root(spark)}/quillon-{name}-{uuid.uuid4().hex[:12]}"

    def remove() -> None:
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the JVM may be gone; the folder is scratch space
            pass

    atexit.register(remove)
    return path


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Cut the lineage: write to the shared folder and read back, so lost executors cost no recomputation."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def needs(df: DataFrame, *names: str) -> DataFrame:
    """Only the columns an operator reads, so extra or clashing names elsewhere can't get in its way."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*[F.col(f"`{n}`") for n in names])


# ---------------------------------------------------------------- hashing of words, vectorised over bytes

_BASE = _U(0x9E3779B97F4A7C15)
_POWERS = np.array([pow(int(_BASE), i, 1 << 64) for i in range(1 << 12)], dtype=np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    while len(_POWERS) < n:
        _POWERS = np.concatenate([_POWERS, _POWERS * _U(pow(int(_BASE), len(_POWERS), 1 << 64))])
    return _POWERS


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit words."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_hashes(data: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the words `[^\\x20\\x09-\\x0D]+` of UTF-8 bytes, with their starts and ends.

    A word's hash is a polynomial of its bytes over 2**64 with its length mixed in; each word is
    weighed by its own offset, so equal words hash alike wherever they stand.
    """
    none = np.empty(0, dtype=np.int64)
    if not len(data):
        return np.empty(0, dtype=np.uint64), none, none
    if lower:
        data = _LOWER[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], _SPACE[data], [True]]).view(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    if not len(starts):
        return np.empty(0, dtype=np.uint64), none, none
    lengths = ends - starts
    longest = int(lengths.max())
    powers = _powers(longest + 1)
    # position of every byte within its word; bytes between words count as nothing
    offset = np.arange(len(data), dtype=np.int64)
    owner = np.zeros(len(data), dtype=np.int64)
    owner[starts[1:]] = np.diff(starts)
    offset -= np.cumsum(owner) + starts[0]
    np.clip(offset, 0, longest, out=offset)
    value = (data.astype(np.uint64) + _U(1)) * powers[offset]
    value[_SPACE[data]] = 0
    sums = np.add.reduceat(value, starts)
    return mix(sums + lengths.astype(np.uint64) * _U(0xD6E8FEB86659FD93)), starts, ends
