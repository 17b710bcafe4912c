"""Projections of records and of a nested rules dataset for display."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.intervals import stage_ranges
from quillon.functions.text import derived_id, distinct_second, strip_tags, variant_kind
from quillon.operators.resolve import last_wins


def rules_for(datasets: DataFrame, patch: str) -> DataFrame:
    return datasets.where(F.col("patch") == patch)


def rule_rows(records: DataFrame, conditions: Column, once: Column, cooldown: Column, least_gold: Column, sources: Column | None = None, fields: Sequence[str] = ()) -> DataFrame:
    """records with has_special_rules, and the confidence of each field by its provenance."""
    special = (F.coalesce(F.size(conditions), F.lit(0)) > 0) | F.coalesce(once, F.lit(False)) | cooldown.isNotNull() | least_gold.isNotNull()
    out = records.withColumn("has_special_rules", special)
    for f in fields:
        out = out.withColumn(f"{f}_confidence", F.try_element_at(sources, F.lit(f))["confidence"])
    return out


def milestones(rules: DataFrame, mapping: str, labels: dict[str, str] | None = None) -> DataFrame:
    """(level, effect, label) rows of a map, levels as numbers."""
    out = rules.select(F.explode(mapping).alias("level", "effect")).select(F.col("level").cast("int").alias("level"), "effect")
    label = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])[F.col("effect")] if labels else F.col("effect")
    return out.withColumn("label", label)


def templated(rules: DataFrame, rows: Sequence[tuple[str, str, str, Sequence[Column]]]) -> DataFrame:
    """(id, text, confidence) rows: printf templates filled from one rules row."""
    cells = F.array(*[F.struct(F.lit(i).alias("id"), F.format_string(t, *a).alias("text"), F.lit(c).alias("confidence")) for i, t, c, a in rows])
    return rules.select(F.inline(cells))


def index_order(ranges: str, name: str, key: str, collation: str | None = None) -> list[Column]:
    """First start, then name, then id."""
    n = F.collate(F.col(name), collation) if collation else F.col(name)
    return [F.get(F.col(ranges), 0)["start"].asc_nulls_last(), n.asc_nulls_last(), F.col(key).asc_nulls_last()]


def index_order_by_name(name: str, collation: str) -> list[Column]:
    """By name alone, as a language's dictionary has it."""
    return [F.collate(F.col(name), collation).asc_nulls_last()]


def labels_of(column: Column, labels: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])[column]


def card(records: DataFrame, labels: dict[str, str], ranges_text: Column, once: Column, cooldown: Column) -> DataFrame:
    """What a result card shows: the category's label, windows as text, flags with defaults for unknown values."""
    return records.select("*", labels_of(F.col("category"), labels).alias("category_label"), ranges_text.alias("windows"), F.coalesce(once, F.lit(False)).alias("once"), cooldown.alias("cooldown"))


def confirmed_elsewhere(records: DataFrame, other: DataFrame, key: str, flag: str) -> DataFrame:
    """Fills an unknown flag as confirmed only where another source explicitly says so."""
    o = other.where(F.col(flag)).select(key, F.lit(True).alias("_yes")).distinct()
    filled = F.when(F.col(flag).isNull() & F.col("_yes"), F.struct(F.lit("confirmed").alias("status"), F.lit(True).alias("value"))).when(F.col(flag).isNotNull(), F.struct(F.lit("confirmed").alias("status"), F.col(flag).alias("value"))).otherwise(F.struct(F.lit("unknown").alias("status"), F.lit(None).cast("boolean").alias("value")))
    return records.join(o, key, "left").withColumn(flag, filled).drop("_yes")


def normalised(rows: DataFrame, clients: DataFrame, english: DataFrame, key: str, join: str, windows: str, remap: dict[str, str]) -> DataFrame:
    """Source rows as normalised records: id, client, name_en, category, second, ranges, requirements, and the source of each field.

    rows: key, name, position, category, labels array, upgrade, and the column join, which clients (join, api_name, text) share;
    english: (api_name, name_en). A base client row of the name counts, else the first by id; the second text is the upgrade's, if the
    client's upgrade says something else than its base. Labels are windows behind a prefix, or requirements.
    """
    kind = variant_kind(F.col("api_name"))
    per = clients.groupBy(join).agg(F.min_by("api_name", F.struct((kind != "base").alias("later"), "api_name")).alias("client"), F.min(F.when(kind == "base", F.col("text"))).alias("_base"), F.min(F.when(kind == "upgrade", F.col("text"))).alias("_up"))
    out = rows.join(per, join, "left").join(last_wins(english, "api_name", F.col("name_en")).withColumnRenamed("api_name", "client"), "client", "left")
    is_window = lambda x: x.startswith(windows)
    ranges = stage_ranges(F.array_join(F.filter("labels", is_window), ", "))
    from_client = F.when(F.col("client").isNotNull(), "client").otherwise("catalogue")
    sources = F.create_map(*[x for f, s in {"id": from_client, "name": from_client, "name_en": F.when(F.col("name_en").isNotNull(), "client").otherwise("catalogue"), "category": F.lit("catalogue"), "ranges": F.lit("catalogue"), "requirements": F.lit("catalogue")}.items() for x in (F.lit(f), s)])
    category = F.col("category")
    for a, b in remap.items():
        category = F.when(F.col("category") == a, b).otherwise(category)
    return out.select(key, derived_id(F.coalesce("client", F.lit("")), F.col("position"), F.col("name")).alias("id"), "client", F.coalesce("name_en", "name").alias("name_en"), category.alias("category"), F.when(distinct_second(F.col("_base"), F.col("_up")).isNotNull(), F.nullif(strip_tags(F.col("upgrade")), F.lit(""))).alias("second"), ranges.alias("ranges"), F.filter("labels", lambda x: ~is_window(x)).alias("requirements"), sources.alias("sources"))
