"""Deterministic sinks: fixed order, write-once, publication by digest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators.validate import digest
from quillon.sources import published


def json_lines(rows: DataFrame, order: list[Column | str]) -> DataFrame:
    """One JSON text per row, nulls included, in a fixed order."""
    return rows.orderBy(*order).select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value"))


def write_json(rows: DataFrame, path: str, order: list[Column | str], mode: str = "overwrite") -> None:
    """Files in order of rows; one file only if the rows fit one partition, so that large tables stay spread."""
    json_lines(rows, order).write.mode(mode).text(path)


def write_once(rows: DataFrame, path: str) -> None:
    """Frozen evidence: an existing path is an error."""
    rows.write.mode("errorifexists").parquet(path)


def unchanged(before: DataFrame, after: DataFrame, columns: list[str]) -> bool:
    """Whether two tables hold the same rows, by digest."""
    return tuple(digest(before, columns).first()) == tuple(digest(after, columns).first())


def publish(rows: DataFrame, path: str) -> DataFrame:
    """Publishes rows as the only table of a folder, and returns them as readers see them: compared before they are visible."""
    published.publish({"rows": rows}, path)
    return published.read(rows.sparkSession, path, "rows")
