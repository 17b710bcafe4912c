"""Reading catalogues: explicit schemas, never inferred; union-typed values as strings of JSON, then typed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

POINT = "struct<stage:int,round:int>"
RANGE = f"struct<start:{POINT},end:{POINT}>"
SOURCE = "struct<sourceId:string,verifiedAt:string,confidence:string>"
#: A record as it is written; value and the two knowledge fields are raw JSON.
RECORD = f"id string, name string, name_en string, category string, cost double, least_gold double, ranges array<{RANGE}>, effects struct<normal:string,second:string,third:string>, conditions array<struct<type:string,operator:string,value:variant,text:string,text_en:string,evaluable:boolean>>, once variant, cooldown variant, concepts array<string>, synonyms array<string>, sources map<string,{SOURCE}>, patch string"


def typed_value(v: Column) -> dict[str, Column]:
    """The value of a condition in the column of its type; the others are null."""
    kind = F.schema_of_variant(v)
    number = kind.rlike("^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL)")
    return {"v_num": F.when(number, F.try_variant_get(v, "$", "double")), "v_str": F.when(kind == "STRING", F.try_variant_get(v, "$", "string")), "v_bool": F.when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean")), "v_arr": F.when(kind.startswith("ARRAY"), F.try_variant_get(v, "$", "array<string>"))}


def typed_condition(r: Column) -> Column:
    return F.struct(r["type"].alias("type"), r["operator"].alias("operator"), *[c.alias(n) for n, c in typed_value(r["value"]).items()], r["text"].alias("text"), r["evaluable"].alias("evaluable"))


def knowledge(v: Column, kind: str) -> Column:
    """(status, value) of a bare value, null, or {status, value}; a confirmed null differs from unknown."""
    status = F.try_variant_get(v, "$.status", "string")
    inner = F.when(status == "confirmed", F.try_variant_get(v, "$.value", kind)).when(status.isNull(), F.try_variant_get(v, "$", kind))
    return F.struct(F.when(status.isNotNull(), status).when(v.isNotNull() & ~F.is_variant_null(v), F.lit("confirmed")).alias("status"), inner.alias("value"))


def read_dataset(spark: SparkSession, path: str, schema: str = RECORD, records: str = "records", envelope: str = "patch string, status string, verifiedAt string") -> tuple[DataFrame, DataFrame]:
    """(records, envelope) of one JSON file; records have `ord`, their place in it. A missing file raises."""
    whole = spark.read.schema(f"{envelope}, {records} array<struct<{_colons(schema)}>>").option("multiLine", True).json(path)
    rows = whole.select(F.posexplode(records).alias("ord", "r")).select("ord", "r.*")
    return rows, whole.select(*[c.split()[0] for c in envelope.split(", ")], F.size(records).alias("n"))


def _colons(schema: str) -> str:
    """Top-level `name type` pairs of a schema as `name:type`."""
    out, depth, part = [], 0, ""
    for ch in schema + ",":
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            name, kind = part.strip().split(" ", 1)
            out.append(f"{name}:{kind}")
            part = ""
        else:
            part += ch
    return ",".join(out)


def by_id(records: DataFrame, value: object, key: str = "id") -> DataFrame:
    """The first record of an id."""
    return records.where(F.col(key) == value).limit(1)


def catalogue_rows(entries: DataFrame, icon: str, marker: str, columns: Sequence[str]) -> DataFrame:
    """Rows of a client's catalogue whose icon names the marker."""
    return entries.where(F.lower(F.col(icon)).contains(marker)).select(*columns)


def fetch_status(requests: DataFrame, fetched: DataFrame, key: str) -> DataFrame:
    """requests with status fetched or blocked; what was fetched is never overwritten by a failure."""
    return requests.join(fetched.select(key, F.lit(True).alias("_f")).distinct(), key, "left").withColumn("status", F.when(F.col("_f"), "fetched").otherwise("blocked")).drop("_f")


def expect_count(rows: DataFrame, n: int, what: str = "rows") -> DataFrame:
    """rows, which fail when read if there aren't n of them: one counted row is joined to all."""
    text = F.format_string(f"{what}: expected {n}, found %d", "_n")
    gate = rows.agg(F.count("*").alias("_n")).select(F.when(F.col("_n") == n, True).otherwise(F.raise_error(text).cast("boolean")).alias("_ok"))
    return rows.crossJoin(F.broadcast(gate)).where("_ok").drop("_ok")
