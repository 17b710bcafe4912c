"""The pool filter on a stream: it keeps no state, so it is the same predicate."""

from __future__ import annotations

from pyspark.sql import DataFrame

from quillon.operators.pool import Columns, Criteria, predicate


def stream_pool(records: DataFrame, criteria: Criteria, columns: Columns = Columns()) -> DataFrame:
    if not records.isStreaming:
        raise ValueError("not a stream")
    p = predicate(criteria, columns)
    return records if p is None else records.where(p)
