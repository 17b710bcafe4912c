"""What the operators on embeddings share: reading vectors, classes of equal ones."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import bounded_batches, needs


def matrix(raw: list[bytes]) -> np.ndarray:
    """Vectors of one length from their bytes (doubles)."""
    return np.frombuffer(b"".join(raw), dtype=np.float64).reshape(len(raw), -1) if raw else np.zeros((0, 0))


def usable(values: list | None) -> np.ndarray | None:
    """A vector in double precision; None if it is null, empty, zero or holds null or non-finite components."""
    if not values or None in values:
        return None
    v = np.array(values, dtype=np.float64)
    return v if np.isfinite(v).all() and v.any() else None


def scaled(v: np.ndarray) -> np.ndarray:
    """v times the power of two that brings its largest component near one: squares of very small and very large components keep their value, and cosines stay the same to the bit."""
    return np.ldexp(v, -np.frexp(np.abs(v).max())[1])


def read(df: DataFrame, key: str, vector: str, *more: str) -> DataFrame:
    """(id, more..., dim, same, vec) of each row: same is a digest of the components as doubles, vec holds them scaled; null if unusable."""
    bounded_batches(df.sparkSession)
    names = [f"m{i}" for i in range(len(more))]
    narrow = needs(df, key, vector, *more).select(F.col(f"`{key}`").cast("long").alias("id"), *[F.col(f"`{m}`").alias(n) for m, n in zip(more, names, strict=True)], F.col(f"`{vector}`").cast("array<double>").alias("vec"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [usable(v) for v in batch.column(batch.num_columns - 1).to_pylist()]
            raw = [None if v is None else (v + 0.0).tobytes() for v in got]
            same = [None if v is None else hashlib.blake2b(v, digest_size=16).digest() for v in raw]
            dims = [None if v is None else len(v) for v in got]
            raw = [None if v is None else scaled(v + 0.0).tobytes() for v in got]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(dims, pa.int32()), pa.array(same, pa.binary()), pa.array(raw, pa.binary())], names=["id", *names, "dim", "same", "vec"])

    kinds = "".join(f", {n} {narrow.schema[n].dataType.simpleString()}" for n in names)
    out = narrow.mapInArrow(run, f"id long{kinds}, dim int, same binary, vec binary")
    return out.select("id", *[F.col(n).alias(m) for n, m in zip(names, more, strict=True)], "dim", "same", "vec")

