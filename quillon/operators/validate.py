"""Validation as rows: every check gives (key, path, problem) rows, and nothing means valid."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import let

Check = tuple[str, Column, str]


def errors(records: DataFrame, key: str, checks: Sequence[Check]) -> DataFrame:
    """(key, path, problem) of each check whose condition isn't surely true; all checks in one pass."""
    cells = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.struct(F.lit(path).alias("path"), F.lit(problem).alias("problem"))) for path, ok, problem in checks]))
    return records.select(key, F.inline(cells))


def repeated(records: DataFrame, key: str) -> DataFrame:
    return records.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").select(key, F.lit(key).alias("path"), F.lit("repeated").alias("problem"))


def allowed(column: str, values: Sequence) -> Check:
    return (column, F.col(column).isin(*values), "not an allowed value")


def required(column: str) -> Check:
    return (column, F.coalesce(F.col(column).cast("string"), F.lit("")) != "", "missing")


def ordered_ranges(column: str) -> Check:
    return (column, (F.size(column) > 0) & F.forall(column, lambda r: r["start"] <= r["end"]), "not a list of ordered ranges")


def condition_fits(r: Column) -> Column:
    """Whether a typed condition's operator and value go together; of one that nobody evaluates only the operator must be a known one, or none."""
    op = r["operator"]
    number = r["v_num"].isNotNull() & ~F.isnan(r["v_num"]) & (F.abs(r["v_num"]) < float("inf"))
    fits = F.when(op.isin(*ORDERING), number).when(op.isin(*EQUALITY), number | r["v_str"].isNotNull() | r["v_bool"].isNotNull()).when(op == "in", (F.size(r["v_arr"]) > 0) & ~F.exists(r["v_arr"], lambda x: x.isNull())).when(op.isin(*STATES), F.trim(r["v_str"]) != "").otherwise(False)
    return F.when(r["evaluable"], F.coalesce(fits, F.lit(False))).otherwise(op.isNull() | op.isin(*OPERATORS))


#: Operators of conditions by what they compare with.
ORDERING, EQUALITY, STATES = (">", ">=", "<", "<="), ("=", "!="), ("active", "inactive")
OPERATORS = (*ORDERING, *EQUALITY, "in", *STATES)
#: The parts of a condition as datasets name them.
PARTS = {"type": "type", "text": "textZh", "second": "textEn", "evaluable": "machineEvaluable", "operator": "operator", "value": "value"}


def _part(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "variant")


def _kind(v: Column) -> Column:
    """Of a variant: what it is; null if there is none."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def _shows(text: Column) -> Column:
    """Whether there is a text that isn't blank."""
    return F.coalesce(F.regexp_replace(text, r"(?U)^[\s\uFEFF]+", "") != "", F.lit(False))


#: Kinds of variants that are numbers.
NUMBERS = ("BIGINT", "INT", "SMALLINT", "TINYINT", "DOUBLE", "FLOAT", "DECIMAL")


def requirement_problems(value: Column, path: str, parts: dict[str, str] = PARTS) -> Column:
    """Of a JSON text that should be a list of conditions: an array of (path, problem), with the path of each element's part.

    A condition is an object with a type, a text, perhaps a second text, and whether it is to be evaluated. Its operator must be a known one if it
    has any; if it is evaluated it must have one, and a value that goes with it: a finite number to be compared by order, a text,
    number or truth to be compared by equality, a list of texts to be in, a text for what is active. A value nobody evaluates may be anything.
    """
    problem = lambda at, says: F.struct(at.alias("path"), says.alias("problem"))
    alone = lambda says: F.array(problem(F.lit(path), F.lit(says)))

    def facts(x: Column) -> Column:
        """What the checks ask of a condition, each made once: its parts, what kinds they are, and what they say."""
        made = let(F.struct(*[_part(x, p).alias(n) for n, p in parts.items()]), lambda c: F.struct(*[F.struct(c[n].alias("v"), F.schema_of_variant(c[n]).alias("schema")).alias(n) for n in parts]))
        kind = lambda c: F.regexp_extract(c["schema"], "^[A-Z]+", 0)
        number = lambda c: F.coalesce(kind(c).isin(*NUMBERS) & (F.abs(F.try_variant_get(c["v"], "$", "double")) < float("inf")), F.lit(False))
        text = lambda c: F.when(kind(c) == "STRING", F.try_variant_get(c["v"], "$", "string"))
        said = lambda c: F.struct(*[kind(c[n]).alias(f"{n}_kind") for n in parts], *[_shows(text(c[n])).alias(f"{n}_text") for n in ("type", "text", "value")], text(c["operator"]).alias("name"), number(c["value"]).alias("number"),
                                  F.coalesce(c["value"]["schema"] == "ARRAY<STRING>", F.lit(False)).alias("texts"), F.coalesce(F.when(kind(c["evaluable"]) == "BOOLEAN", F.try_variant_get(c["evaluable"]["v"], "$", "boolean")), F.lit(False)).alias("asked"))
        return let(made, said)

    def checked(c: Column, at: Column) -> Column:
        name, asked, there = c["name"], c["asked"], lambda n: c[f"{n}_kind"].isNotNull()
        known = F.coalesce(name.isin(*OPERATORS), F.lit(False))
        plain = F.coalesce(c["value_kind"].isin("STRING", "BOOLEAN"), F.lit(False)) | c["number"]
        checks = [
            ("type", ~c["type_text"], "must be a text"), ("text", ~c["text_text"], "must be a text"), ("second", there("second") & (c["second_kind"] != "STRING"), "must be a text if it is there"),
            ("evaluable", F.coalesce(c["evaluable_kind"] != "BOOLEAN", F.lit(True)), "must be true or false"), ("operator", there("operator") & ~known, "unknown operator"), ("operator", asked & ~known, "needs a known operator"),
            ("value", asked & known & name.isin(*ORDERING) & ~c["number"], "must be a finite number"), ("value", asked & known & name.isin(*EQUALITY) & ~plain, "must be a text, number or truth"),
            ("value", asked & known & (name == "in") & ~c["texts"], "must be a list of texts"), ("value", asked & known & name.isin(*STATES) & ~c["value_text"], "must be a text")]
        return F.array_compact(F.array(*[F.when(wrong, problem(F.concat(at, F.lit(f".{parts[part]}")), F.lit(says))) for part, wrong, says in checks]))

    def of(x: Column, i: Column) -> Column:
        at = F.concat(F.lit(f"{path}["), i.cast("string"), F.lit("]"))
        return F.when(_kind(x) == "OBJECT", let(facts(x), lambda c: checked(c, at))).otherwise(F.array(problem(at, F.lit("must be an object"))))

    elements = lambda v: F.when(_kind(v) == "ARRAY", F.try_variant_get(v, "$", "array<variant>"))
    listed = let(F.try_parse_json(value), elements)
    return F.coalesce(F.flatten(F.transform(listed, of)), alone("must be a list"))


def dangling(rows: DataFrame, reference: str, targets: DataFrame, target: str, key: str, path: str | None = None) -> DataFrame:
    """(key, path, value): references that no target has; nulls refer to nothing."""
    t = targets.select(F.col(target).alias(reference)).distinct()
    return rows.where(F.col(reference).isNotNull()).join(t, reference, "left_anti").select(key, F.lit(path or reference).alias("path"), F.col(reference).cast("string").alias("value"))


def provenance_problems(entries: DataFrame, manifest: DataFrame, key: str, stale: str | None = None) -> DataFrame:
    """(key, field, source_id, problem). entries: (key, field, source_id, confidence, locale); manifest: (source_id, confidence, locales, use_for).

    stale: a pattern; with it the manifest has `note` too (address and warnings), and sources whose id or note match are stale_source.
    """
    m = manifest.select("source_id", F.col("confidence").alias("_c"), F.col("locales").alias("_l"), F.col("use_for").alias("_u"), F.lit(True).alias("_m"), *([F.col("note").alias("_note")] if stale else []))
    known = F.col("_m").isNotNull()
    checks = [(~known, "unknown_source"), (known & ~F.col("confidence").eqNullSafe(F.col("_c")), "confidence_drift"), (known & F.col("locale").isNotNull() & ~F.array_contains("_l", F.col("locale")), "locale_mismatch"), (known & ~F.array_contains("_u", F.col("field")), "use_not_allowed")]
    if stale:
        checks.append((known & F.concat_ws(" ", "source_id", "_note").rlike(stale), "stale_source"))
    problems = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for c, n in checks]))
    return entries.join(m, "source_id", "left").select(key, "field", "source_id", F.explode(problems).alias("problem"))


#: Fixed value: a placeholder that a client fills in.
PLACEHOLDER = r"@[A-Za-z][A-Za-z0-9_]*(?:\s*\*\s*100)?@"
#: Kinds of values that a decision may give a field.
SHAPES = ("text", "category", "amount", "effect", "ranges", "requirements", "unknown", "omitted")


def shape_problem(kind: Column, value: Column, categories: Sequence[str]) -> Column:
    """What is wrong with a decided value (a JSON text, null if omitted) of a kind; null if nothing is.

    text: not empty; category: a known one; amount: a finite number from 0 on; effect: text without unresolved placeholders; ranges:
    a non-empty list of ordered windows; requirements: a list of conditions, of which the first problem is told with its path; unknown: an
    object that says so; omitted: nothing at all.
    """
    v = F.try_parse_json(value)
    text = F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))
    blank = F.coalesce(F.trim(text), F.lit("")) == ""
    number = F.when(F.schema_of_variant(v).rlike("^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(v, "$", "double"))
    point = "struct<stage:int,round:int>"
    ranges = F.try_variant_get(v, "$", f"array<struct<start:{point},end:{point}>>")
    good = lambda r: (r["start"]["stage"] >= 1) & (r["start"]["round"] >= 1) & (r["end"]["stage"] >= 1) & (r["end"]["round"] >= 1) & (r["start"] <= r["end"])
    checks = {
        "text": (blank, "empty text"), "category": (~F.coalesce(text.isin(*categories), F.lit(False)), "unknown category"), "amount": (~F.coalesce((number >= 0) & (number < float("inf")), F.lit(False)), "not an amount"),
        "effect": (blank | F.coalesce(text.rlike(PLACEHOLDER), F.lit(False)), "empty or unresolved text"), "ranges": (~F.coalesce((F.size(ranges) > 0) & F.forall(ranges, lambda r: F.coalesce(good(r), F.lit(False))), F.lit(False)), "not ordered windows"),
        "unknown": (~F.coalesce(F.try_variant_get(v, "$.status", "string") == "unknown", F.lit(False)), "not marked unknown"), "omitted": (value.isNotNull(), "must be left out")}
    out = F.lit("unknown field")
    for name, (wrong, problem) in checks.items():
        out = F.when(kind == name, F.when(wrong, problem)).otherwise(out)
    first = F.get(requirement_problems(value, "value"), 0)
    return F.when(kind == "requirements", F.when(first.isNotNull(), F.concat_ws(": ", first["path"], first["problem"]))).otherwise(out)


def production_problems(records: DataFrame, key: str, alternate: str, name: str, sources: str, fields: Sequence[str], placeholder: str, evidence: DataFrame) -> DataFrame:
    """(key, path, problem) of a catalogue that is to be published.

    repeated alternate ids; names that match the placeholder pattern; fields without provenance in the map of sources; names that
    no row of evidence (source_id, name) of their source shows.
    """
    twice = records.where(F.col(alternate).isNotNull()).groupBy(alternate).agg(F.count("*").alias("_n")).where("_n > 1").select(alternate)
    repeats = records.join(twice, alternate, "left_semi").select(key, F.lit(alternate).alias("path"), F.lit("repeated").alias("problem"))
    checks = [(name, ~F.coalesce(F.col(name), F.lit("")).rlike(placeholder), "placeholder")] + [(f"{sources}.{f}", F.try_element_at(F.col(sources), F.lit(f)).isNotNull(), "no provenance") for f in fields]
    source = F.try_element_at(F.col(sources), F.lit(name))["source_id"]
    claimed = records.select(key, source.alias("source_id"), F.col(name).alias("name")).where("source_id is not null")
    unseen = claimed.join(evidence.select("source_id").distinct(), "source_id", "left_semi").join(evidence.select("source_id", "name").distinct(), ["source_id", "name"], "left_anti")
    return all_of(repeats, errors(records, key, checks), unseen.select(key, F.lit(name).alias("path"), F.lit("no evidence").alias("problem")))


def dataset_problems(dataset: DataFrame, conflicts: DataFrame, normalised: DataFrame, published: DataFrame, key: str, search: Sequence[str], open_as: str = "needs_review") -> DataFrame:
    """(path, problem) of a dataset as a whole, before it is released.

    dataset: one row (ready, status). A dataset with a conflict whose resolution is open must say that it isn't ready (null says nothing, and is
    refused too), and must have a status. What is published must be the normalised records but for the columns that search adds; a
    record that is only on one side, or differs, is named by its key. Tables are compared by a full join on the key.
    """
    waiting = conflicts.where(F.col("resolution") == open_as).limit(1).agg(F.count("*").alias("_open"))
    state = dataset.crossJoin(waiting)  # two single rows
    checks = [("ready", (F.col("_open") == 0) | F.coalesce(~F.col("ready"), F.lit(False)), "ready while conflicts are open"), ("status", F.trim(F.coalesce("status", F.lit(""))) != "", "missing")]
    whole = errors(state.withColumn("_one", F.lit(1)), "_one", checks).select("path", "problem")
    core = [c for c in normalised.columns if c != key and c not in search]
    theirs = [c for c in published.columns if c != key and c not in search]
    form = lambda df, name: df.select(key, F.to_json(F.struct(*[c for c in sorted({*core, *theirs}) if c in df.columns]), {"ignoreNullFields": "false"}).alias(name))
    both = form(normalised, "_a").join(form(published, "_b"), key, "full_outer").where(~F.col("_a").eqNullSafe(F.col("_b")))
    differs = F.when(F.col("_a").isNull(), "not in the normalised records").when(F.col("_b").isNull(), "not published").otherwise("differs from the normalised record")
    return whole.unionByName(both.select(F.concat(F.lit("records."), F.col(key).cast("string")).alias("path"), differs.alias("problem")))


def rules_problems(rules: DataFrame, records: DataFrame, categories: Sequence[str], milestones: Sequence[int], effects: Sequence[str], positive: Sequence[str], flags: Sequence[str], model: str, denied: Sequence[str] = (), truths: Sequence[str] = (), stated: dict[str, str] | None = None, unknown: Sequence[str] | None = None) -> DataFrame:
    """(path, problem) of a nested rules dataset of one row: patch, categories in order, whole positive numbers, flags, milestones, model.

    rules: patch, categories array, milestones map (level as text to effect), model; the columns in positive; those in flags, which must be
    true, in denied, which must be false, and in truths, which must be one of both; those in stated, which must be that text; unknown_models, which
    must be the list `unknown` if that is given. records: patch of every record, which must be the rules'. Levels are read as numbers, so their order is given.
    """
    patches = records.agg(F.count("*").alias("_n"), F.count_if(F.col("patch").isNotNull()).alias("_with"), F.min("patch").alias("_least"), F.max("patch").alias("_most"))
    r = rules.crossJoin(patches)  # two single rows
    levels = F.transform(F.map_keys("milestones"), lambda k: k.try_cast("int"))
    checks = [("patch", F.trim("patch") != "", "empty"), ("records", (F.col("_n") > 0) & (F.col("_with") == F.col("_n")) & (F.col("_least") == F.col("patch")) & (F.col("_most") == F.col("patch")), "records of another patch"), ("categories", F.col("categories") == F.array(*map(F.lit, categories)), "not the categories in order")]
    checks += [(c, (F.col(c) > 0) & (F.col(c) == F.floor(c)), "not a whole positive number") for c in positive] + [(c, F.col(c), "must be true") for c in flags]
    checks += [(c, ~F.col(c), "must be false") for c in denied] + [(c, F.col(c).isNotNull(), "must be true or false") for c in truths] + [(c, F.col(c) == x, f"must be {x}") for c, x in (stated or {}).items()]
    checks += [("milestones", F.array_sort(levels) == F.array(*map(F.lit, milestones)), "not the milestones"), ("milestones", F.forall(F.map_values("milestones"), lambda e: e.isin(*effects)), "unknown effect"), ("model", F.col("model") == model, "unknown model")]
    if unknown is not None:
        checks.append(("unknown_models", F.col("unknown_models") == F.array(*map(F.lit, unknown)), "not the unknown models"))
    return errors(r.withColumn("_one", F.lit(1)), "_one", checks).select("path", "problem")


def lexicon_problems(concepts: DataFrame, synonyms: DataFrame, taxonomy: DataFrame, groups: DataFrame, membership: DataFrame, patch: str, same: Sequence[str] = ("patch", "version", "digest", "records")) -> DataFrame:
    """(part, key, problem) of a search lexicon: whether its artifacts fit the dataset and each other, and refer to concepts that exist.

    concepts, synonyms: one row of metadata each; taxonomy: (key, label); groups: (group, aliases, concepts); membership: (key, concepts).
    """
    a = concepts.select(*[F.col(c).cast("string").alias(f"_a_{c}") for c in same])
    b = synonyms.select(*[F.col(c).cast("string").alias(f"_b_{c}") for c in same])
    differs = F.array_compact(F.array(*[F.when(~F.col(f"_a_{c}").eqNullSafe(F.col(f"_b_{c}")), F.lit(c)) for c in same], *[F.when(~F.col(f"_{x}_patch").eqNullSafe(F.lit(patch)), F.lit(f"{x}:patch")) for x in "ab"]))
    meta = a.crossJoin(F.broadcast(b)).select(F.lit("metadata").alias("part"), F.explode(differs).alias("key"), F.lit("different").alias("problem"))
    twice = taxonomy.groupBy("key").agg(F.count("*").alias("_n")).where("_n > 1").select(F.lit("taxonomy").alias("part"), "key", F.lit("repeated").alias("problem"))
    empty = taxonomy.where("coalesce(key, '') = '' or coalesce(label, '') = ''").select(F.lit("taxonomy").alias("part"), F.coalesce("key", F.lit("")).alias("key"), F.lit("empty").alias("problem"))
    known = taxonomy.select(F.col("key").alias("_concept")).distinct()
    refers = lambda df, part, key: df.select(F.lit(part).alias("part"), F.col(key).alias("key"), F.explode(F.array_distinct("concepts")).alias("_concept")).join(known, "_concept", "left_anti").select("part", "key", F.lit("unknown concept").alias("problem")).distinct()
    return all_of(meta, twice, empty, refers(groups, "groups", "group"), refers(membership, "membership", "key"))


def publication_problems(pairs: Sequence[tuple[str, DataFrame, DataFrame]], counts: Sequence[tuple[str, DataFrame, int]]) -> DataFrame:
    """(name, problem): published tables that differ from what they were made from, by digest, and tables of another size than agreed."""
    out = [digest(a, sorted(a.columns)).alias("a").crossJoin(digest(b, sorted(a.columns)).alias("b")).select(F.lit(n).alias("name"), F.when(F.col("a.digest") != F.col("b.digest"), "different").alias("problem")) for n, a, b in pairs]
    out += [df.agg(F.count("*").alias("_n")).select(F.lit(n).alias("name"), F.when(F.col("_n") != want, F.format_string(f"%d rows, not {want}", "_n")).alias("problem")) for n, df, want in counts]
    return all_of(*out).where("problem is not null")


def all_of(*tables: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def digest(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(rows, digest): an order-free digest of a table, to tell whether a regenerated one is the same."""
    one = F.conv(F.substring(F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return rows.agg(F.count("*").alias("rows"), F.coalesce(F.sum(one), F.lit(0)).cast("string").alias("digest"))
