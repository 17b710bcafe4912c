"""Set operations, snapshot differences, and the alignment of two catalogues."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import catalogue_key, client_family, is_variant
from quillon.operators.saved import saved


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, change): added, removed or changed; equal rows are left out. Nulls equal nulls."""
    a = before.select(key, F.struct(*fields).alias("_a"), F.lit(True).alias("_in_a"))
    b = after.select(key, F.struct(*fields).alias("_b"), F.lit(True).alias("_in_b"))
    change = F.when(F.col("_in_a").isNull(), "added").when(F.col("_in_b").isNull(), "removed").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    return a.join(b, key, "full_outer").select(key, change.alias("change")).where("change is not null")


def field_diff(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, old, new) of each differing leaf of rows in both snapshots; values as strings. One join, no unpivot before it."""
    a = before.select(key, *[F.col(f).cast("string").alias(f"_a{i}") for i, f in enumerate(fields)])
    b = after.select(key, *[F.col(f).cast("string").alias(f"_b{i}") for i, f in enumerate(fields)])
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"_a{i}").alias("old"), F.col(f"_b{i}").alias("new")) for i, f in enumerate(fields)])
    return a.join(b, key).select(key, F.inline(F.filter(cells, lambda c: ~c["old"].eqNullSafe(c["new"]))))


def leaves(value: Column, kind, path: str = "") -> list[tuple[str, Column]]:
    """Paths and columns of the leaves of a struct, by its schema; arrays are leaves."""
    from pyspark.sql.types import StructType

    if not isinstance(kind, StructType):
        return [(path, value)]
    return [leaf for f in kind.fields for leaf in leaves(value[f.name], f.dataType, f"{path}.{f.name}" if path else f.name)]


def _number(v: Column) -> Column:
    """A variant's number, null for anything else."""
    return F.when(F.schema_of_variant(v).rlike("^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(v, "$", "double"))


def _unlike(a: Column, b: Column) -> Column:
    """Whether two variants differ; one that isn't there equals only another that isn't."""
    same = F.to_json(a).eqNullSafe(F.to_json(b)) | F.coalesce(_number(a) == _number(b), F.lit(False))
    return ~same


def _children(a: Column, b: Column) -> Column:
    """(step, a, b) of the parts of two objects by the union of their keys, or of two arrays by place; null for other pairs."""
    maps = [F.try_variant_get(v, "$", "map<string,variant>") for v in (a, b)]
    lists = [F.try_variant_get(v, "$", "array<variant>") for v in (a, b)]
    part = lambda step, x, y: F.struct(step.alias("step"), x.alias("a"), y.alias("b"))
    keyed = F.transform(F.array_union(F.map_keys(maps[0]), F.map_keys(maps[1])), lambda k: part(F.concat(F.lit("."), k), F.try_element_at(maps[0], k), F.try_element_at(maps[1], k)))
    longest = F.greatest(F.size(lists[0]), F.size(lists[1]))
    placed = F.transform(F.filter(F.sequence(F.lit(0), longest), lambda i: i < longest), lambda i: part(F.concat(F.lit("["), i.cast("string"), F.lit("]")), F.get(lists[0], i), F.get(lists[1], i)))
    return F.when(maps[0].isNotNull() & maps[1].isNotNull(), keyed).when(lists[0].isNotNull() & lists[1].isNotNull(), placed)


def json_diff(pairs: DataFrame, key: str, old: str, new: str) -> DataFrame:
    """(key, path, old, new) of every place at which two JSON texts differ, as JSON; what isn't there is null, a null one the text null.

    Objects are compared by the union of their keys, arrays by place, numbers by value. Level by level, parts that differ are taken apart; equal ones go at once.
    All of it is expressions over variants within a row: no join, and no text leaves the JVM. A text that can't be parsed is as if not there.
    """
    todo = pairs.select(F.col(key).alias("_key"), F.lit("").alias("path"), F.try_parse_json(old).alias("a"), F.try_parse_json(new).alias("b")).where(_unlike(F.col("a"), F.col("b")))
    out = None
    while True:
        opened = saved(todo.withColumn("_parts", _children(F.col("a"), F.col("b"))), "level")
        leaf = opened.where("_parts is null").select(F.col("_key").alias(key), "path", F.to_json("a").alias("old"), F.to_json("b").alias("new"))
        out = leaf if out is None else out.unionByName(leaf)
        deeper = opened.where("_parts is not null")
        if deeper.isEmpty():
            return out
        todo = deeper.select("_key", "path", F.inline("_parts")).where(_unlike(F.col("a"), F.col("b"))).select("_key", F.when(F.col("path") == "", F.regexp_replace("step", r"^\.", "")).otherwise(F.concat("path", "step")).alias("path"), "a", "b")


def nested_diff(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, path, old, new) of each leaf that differs between two snapshots' nested records.

    One join; only records that differ as a whole are taken apart. Values are JSON; added and removed records are snapshot_diff()'s.
    """
    a = before.select(key, F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("_a"))
    b = after.select(key, F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("_b"))
    return json_diff(a.join(b, key).where("_a <> _b"), key, "_a", "_b")


def same_set(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(only_left, only_right, repeated, equal) in one row: equal means the same keys, each once on either side."""
    n = a.select(key, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionAll(b.select(key, F.lit(0).alias("_a"), F.lit(1).alias("_b"))).groupBy(key).agg(F.sum("_a").alias("a"), F.sum("_b").alias("b"))
    sums = n.agg(F.count_if(F.col("b") == 0).alias("only_left"), F.count_if(F.col("a") == 0).alias("only_right"), F.count_if((F.col("a") > 1) | (F.col("b") > 1)).alias("repeated"))
    return sums.withColumn("equal", (F.col("only_left") == 0) & (F.col("only_right") == 0) & (F.col("repeated") == 0))


def last_value_first_place(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key: the last row's values, at the place of the first."""
    rest = [c for c in rows.columns if c not in (*keys, order)]
    out = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_row"), F.min(order).alias(order))
    return out.select(*keys, "_row.*", order)


def align(old: DataFrame, fresh: DataFrame, position: str, stable: str, name: str) -> DataFrame:
    """(old_position, fresh_position, status) of each old row, and of fresh rows that none claims (fresh_only, ambiguous_fresh).

    A row matches by a stable identity that only one fresh row has, else by a name that is unique on both
    sides. Each old row has one target at most; the first old row by position claims it. Stable identities travel as
    digests, and rows without one are spread by their position instead of meeting in one task.
    """
    stable_key = F.when(F.coalesce(F.col(stable).cast("string"), F.lit("")) != "", F.md5(F.col(stable).cast("string")))
    o = saved(old.select(F.col(position).alias("o"), stable_key.alias("s"), catalogue_key(F.col(name)).alias("k")), "old")
    f = saved(fresh.select(F.col(position).alias("f"), stable_key.alias("s"), catalogue_key(F.col(name)).alias("k")), "fresh")
    spread = lambda c, p: F.coalesce(F.nullif(F.col(c), F.lit("")), F.concat(F.lit("\0"), F.col(p).cast("string")))
    by_stable = f.where("s is not null").groupBy(F.col("s").alias("_s")).agg(F.min("f").alias("sf"), F.count("*").alias("sn"), F.min("k").alias("sk"))
    old_names = o.where("k <> ''").groupBy(F.col("k").alias("_k")).agg(F.count("*").alias("on"))
    fresh_names = f.where("k <> ''").groupBy(F.col("k").alias("_k")).agg(F.min("f").alias("nf"), F.count("*").alias("nn"))
    m = o.withColumn("_s", spread("s", "o")).join(by_stable, "_s", "left").withColumn("_k", spread("k", "o")).join(old_names.join(fresh_names, "_k", "left"), "_k", "left").drop("_s", "_k")
    named = (F.col("on") == 1) & (F.col("nn") == 1)
    target = F.when(F.col("sn") == 1, F.col("sf")).when(named, F.col("nf"))
    unclear = target.isNull() & ((F.coalesce("sn", F.lit(0)) > 1) | (F.coalesce("nn", F.lit(0)) >= 1))
    m = m.select("o", "s", "k", target.alias("f"), unclear.alias("unclear"), ((F.col("sn") == 1) & ((F.col("sk") != F.col("k")) | (F.col("k") == ""))).alias("renamed"))
    m = saved(m, "targets")
    first = m.where("f is not null").groupBy("f").agg(F.min("o").alias("first"))
    with_target = m.where("f is not null").join(first, "f").withColumn("claims", F.col("o") == F.col("first")).drop("first")
    m = with_target.unionByName(m.where("f is null").withColumn("claims", F.lit(False)))
    status = F.when(F.col("unclear"), "ambiguous").when(F.col("f").isNull() | ~F.col("claims"), "old_only").when(F.col("renamed"), "renamed").when(F.col("o") == F.col("f"), "unchanged").otherwise("shifted")
    mapped = saved(m.select("o", "s", "k", F.when(F.col("claims"), F.col("f")).alias("f"), F.coalesce(status, F.lit("old_only")).alias("status")), "mapped")
    doubtful = mapped.where("status = 'ambiguous'")
    suspects = f.join(doubtful.select("k").where("k <> ''").distinct(), "k", "left_semi").select("f").union(f.join(doubtful.select("s").where("s is not null").distinct(), "s", "left_semi").select("f")).distinct()
    claimed = mapped.where("f is not null").select("f")
    free = f.join(claimed, "f", "left_anti").join(suspects.withColumn("_doubt", F.lit(True)), "f", "left")
    extra = free.select(F.lit(None).cast("long").alias("old_position"), F.col("f").cast("long").alias("fresh_position"), F.when(F.col("_doubt").isNotNull(), "ambiguous_fresh").otherwise("fresh_only").alias("status"))
    return mapped.select(F.col("o").cast("long").alias("old_position"), F.col("f").cast("long").alias("fresh_position"), "status").unionByName(extra)


def classify(rows: DataFrame, clients: DataFrame, known: DataFrame, name: str, api: str = "api_name", reviewed: DataFrame | None = None) -> DataFrame:
    """rows with client, base identity and classification: existing, missing, variant or unresolved.

    A row resolves to the one client of its name, or to the one base among several. known: one column of
    names and ids that the catalogue has already. reviewed: (api_name, id) mappings by people; one of the row's base or client is a
    target too, if the catalogue knows the id.
    """
    c = clients.select(catalogue_key(F.col("name")).alias("_k"), F.col(api).alias("_api"))
    per = c.groupBy("_k").agg(F.count("*").alias("_n"), F.min("_api").alias("_any"), F.count_if(~is_variant(F.col("_api"))).alias("_bases"), F.min(F.when(~is_variant(F.col("_api")), F.col("_api"))).alias("_base"))
    client = F.when(F.col("_n") == 1, F.col("_any")).when(F.col("_bases") == 1, F.col("_base"))
    r = rows.withColumn("_k", catalogue_key(F.col(name))).join(per, "_k", "left").withColumn("client", client).withColumn("base_identity", client_family(F.col("client")))
    r = r.withColumn("_b", catalogue_key(F.col("base_identity"))).withColumn("_c", catalogue_key(F.col("client")))
    have = known.select(catalogue_key(F.col(known.columns[0])).alias("_h")).distinct()
    targets = {"_by_name": (have, "_k"), "_by_id": (have, "_b")}
    if reviewed is not None:
        mapped = reviewed.withColumn("_h", catalogue_key(F.col("id"))).join(have, "_h", "left_semi").select(catalogue_key(F.col("api_name")).alias("_h")).distinct()
        targets |= {"_by_base_review": (mapped, "_b"), "_by_client_review": (mapped, "_c")}
    has = F.lit(False)
    for flag, (keys, on) in targets.items():
        r = r.join(keys.select(F.col("_h").alias(on), F.lit(True).alias(flag)), on, "left")
        has = has | F.col(flag).isNotNull()
    kind = F.when(F.col("client").isNull(), "unresolved").when(is_variant(F.col("client")), "variant").when(has, "existing").otherwise("missing")
    return r.select(*rows.columns, "client", "base_identity", kind.alias("classification"))


def delta_report(classified: DataFrame, clients: DataFrame, proposals: DataFrame, key: str, api: str = "api_name") -> DataFrame:
    """(key, classification, base, upgrades, prismatics, cluster) of rows that only the fresh catalogue has.

    classified: what classify() gives; its base identity's family of clients is listed by kind. proposals: (identity, cluster).
    """
    family = clients.select(client_family(F.col(api)).alias("base_identity"), F.col(api).alias("_api")).distinct()
    suffix = lambda s: F.array_sort(F.collect_set(F.when(F.col("_api").rlike(f"(?i)_{s}$"), F.col("_api"))))
    per = family.groupBy("base_identity").agg(F.min(F.when(~is_variant(F.col("_api")), F.col("_api"))).alias("base"), suffix("upgrade").alias("upgrades"), suffix("prismatic").alias("prismatics"))
    p = proposals.groupBy(catalogue_key(F.col("identity")).alias("_i")).agg(F.min("cluster").alias("cluster"))
    out = classified.join(per, "base_identity", "left").withColumn("_i", catalogue_key(F.col("base_identity"))).join(p, "_i", "left")
    none = F.array().cast("array<string>")
    return out.select(key, "classification", "base", F.coalesce("upgrades", none).alias("upgrades"), F.coalesce("prismatics", none).alias("prismatics"), "cluster")


def delta_balance(alignment: DataFrame, report: DataFrame) -> DataFrame:
    """One row: fresh rows less old ones, counts by classification, renamed rows, and whether the counts add up.

    Every row that only the fresh catalogue has must be of exactly one class, and the catalogues must differ by as many rows as
    fresh ones are without an old one, less old ones without a fresh one.
    """
    a = alignment.agg((F.count("fresh_position") - F.count("old_position")).alias("row_delta"), F.count_if(F.col("status") == "renamed").alias("renamed"), F.count_if(F.col("status") == "fresh_only").alias("_fresh_only"), F.count_if(F.col("old_position").isNull()).alias("_only_fresh"), F.count_if(F.col("fresh_position").isNull()).alias("_only_old"))
    r = report.agg(F.count("*").alias("_all"), *[F.count_if(F.col("classification") == c).alias(c) for c in ("missing", "variant", "existing", "unresolved")])
    adds_up = (F.col("_all") == F.col("_fresh_only")) & (F.col("missing") + F.col("variant") + F.col("existing") + F.col("unresolved") == F.col("_all")) & (F.col("row_delta") == F.col("_only_fresh") - F.col("_only_old"))
    return a.crossJoin(r).select("row_delta", "missing", "variant", "existing", "renamed", "unresolved", adds_up.alias("balanced"))


def impact(classification: Column, base: Column) -> Column:
    """What a changed row says of the hypothesis that its identity is missing."""
    return F.when(F.coalesce(classification, F.lit("unresolved")) == "unresolved", "unresolved").when(classification == "existing", "weakened").when((classification == "missing") & ~is_variant(base), "supported").otherwise("unresolved")


def overlay(layers: list[DataFrame], key: str) -> DataFrame:
    """Of rows with one key the one of the last layer that has it."""
    tagged = reduce(DataFrame.unionByName, [df.withColumn("_layer", F.lit(i)) for i, df in enumerate(layers)])
    rest = [c for c in layers[0].columns if c != key]
    return tagged.groupBy(key).agg(F.max_by(F.struct(*rest), "_layer").alias("_row")).select(key, "_row.*")


def multiplicity(expected: DataFrame, assigned: DataFrame, key: str) -> DataFrame:
    """(key, n, problem) of keys that aren't assigned exactly once: missing, repeated or unexpected."""
    n = assigned.groupBy(key).agg(F.count("*").alias("n"))
    both = expected.select(key).distinct().withColumn("_e", F.lit(True)).join(n, key, "full_outer")
    problem = F.when(F.col("_e").isNull(), "unexpected").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "repeated")
    return both.select(key, F.coalesce("n", F.lit(0)).alias("n"), problem.alias("problem")).where("problem is not null")


