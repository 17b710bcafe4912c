"""Several tables published at once: staged as a version, checked as they lie there, and made visible by one rename.

A folder holds versions/<version>/<table> and manifests/<number>.json. A manifest names the files of each table, with
count and digest. Readers resolve tables through the manifest of the highest number, so they see all of a publication or
nothing, and never rows that failed a check. A manifest is written aside and renamed to its number; a number that is taken is an
error, so of two publishers at one time one fails.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from quillon.operators.validate import digest


@dataclass(frozen=True)
class Manifest:
    number: int
    version: str
    tables: dict
    note: dict


def _fs(spark: SparkSession, path: str) -> tuple:
    """Hadoop's file system and path, so that any store that Spark knows will do."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _numbers(spark: SparkSession, root: str) -> list[int]:
    fs, p = _fs(spark, f"{root}/manifests")
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def current(spark: SparkSession, root: str) -> Manifest | None:
    """The manifest that readers see; null if nothing is published."""
    numbers = _numbers(spark, root)
    if not numbers:
        return None
    text = spark.read.text(f"{root}/manifests/{numbers[-1]:012d}.json", wholetext=True).first()[0]
    return Manifest(numbers[-1], **json.loads(text))


def read(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A published table, of the current version; it stays that version's however long it is read."""
    found = current(spark, root)
    if found is None or name not in found.tables:
        raise ValueError(f"not published: {name} in {root}")
    table = found.tables[name]
    return spark.read.schema(StructType.fromJson(table["schema"])).parquet(f"{root}/{table['path']}")


def _state(rows: DataFrame) -> list[str]:
    return [str(x) for x in digest(rows, rows.columns).first()]


def publish(tables: dict[str, DataFrame], root: str, checks: Callable[[dict[str, DataFrame]], DataFrame] | None = None, note: dict | None = None) -> Manifest:
    """Stage tables, compare them with what was to be written, run checks over them, and make all of them visible.

    checks gets the staged tables and returns violations; any row of it stops the publication, as does a difference. What was
    visible then stays so; the staged version is removed. Tables that aren't named are not part of the new version.
    note is kept in the manifest as it is.
    """
    spark = next(iter(tables.values())).sparkSession
    version = uuid.uuid4().hex
    stage = f"{root}/versions/{version}"
    try:
        said = {}
        for name, rows in tables.items():
            rows.write.mode("errorifexists").parquet(f"{stage}/{name}")
        staged = {name: spark.read.schema(rows.schema).parquet(f"{stage}/{name}") for name, rows in tables.items()}
        for name, rows in tables.items():
            state = _state(staged[name])
            if state != _state(rows):
                raise ValueError(f"staged rows differ: {name}")
            said[name] = {"path": f"versions/{version}/{name}", "digest": state, "schema": json.loads(rows.schema.json())}
        if checks is not None and (bad := checks(staged).limit(5).collect()):
            raise ValueError(f"not published: {bad}")
        numbers = _numbers(spark, root)
        number = numbers[-1] + 1 if numbers else 1
        aside, target = f"{root}/manifests/.{version}", f"{root}/manifests/{number:012d}.json"
        fs, p = _fs(spark, aside)
        out = fs.create(p, False)
        out.write(json.dumps({"version": version, "tables": said, "note": note or {}}).encode())
        out.close()
        goal = _fs(spark, target)[1]
        if fs.exists(goal) or not fs.rename(p, goal):
            fs.delete(p, False)
            raise ValueError(f"published by another at the same time: {number}")
    except BaseException:
        fs, p = _fs(spark, stage)
        fs.delete(p, True)
        raise
    return Manifest(number, version, said, note or {})


def problems(spark: SparkSession, root: str) -> DataFrame:
    """(name, problem) of published tables whose files no longer hold what the manifest says."""
    found = current(spark, root)
    rows = []
    for name, table in (found.tables if found else {}).items():
        fs, p = _fs(spark, f"{root}/{table['path']}")
        if not fs.exists(p):
            rows.append((name, "missing"))
        elif _state(read(spark, root, name)) != table["digest"]:
            rows.append((name, "changed"))
    return spark.createDataFrame(rows, "name string, problem string")


def prune(spark: SparkSession, root: str, keep: int = 2) -> int:
    """Remove manifests and versions but the newest ones, of which there is one at least; returns how many manifests went."""
    numbers = _numbers(spark, root)
    old = numbers[: -max(1, keep)]
    for n in old:
        text = spark.read.text(f"{root}/manifests/{n:012d}.json", wholetext=True).first()[0]
        for path in (f"{root}/manifests/{n:012d}.json", f"{root}/versions/{json.loads(text)['version']}"):
            fs, p = _fs(spark, path)
            fs.delete(p, True)
    return len(old)
