"""Identity resolution between sources: exact cascades that use each row once, and fuzzy candidates that never confirm."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.text import bigrams
from quillon.operators.saved import saved
from quillon.operators.similar import DIGITS, Dice, Edit, Score, at_least, most_similar, scored


def unique_index(rows: DataFrame, key: Column, name: str = "key") -> DataFrame:
    """Rows whose key no other row has; null and empty keys are left out. Counted by a combined aggregate, not a window."""
    keyed = rows.withColumn(name, key).where(F.coalesce(F.col(name), F.lit("")) != "")
    single = keyed.groupBy(name).agg(F.count("*").alias("_n")).where("_n = 1").select(name)
    return keyed.join(single, name, "left_semi")


def last_wins(rows: DataFrame, key: str | list[str], order: Column) -> DataFrame:
    """Of rows with one key the last by order."""
    keys = [key] if isinstance(key, str) else key
    rest = [c for c in rows.columns if c not in keys]
    picked = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_row"))
    return picked.select(*keys, "_row.*")


def enrich(left: DataFrame, right: DataFrame, key: str, order: Column) -> DataFrame:
    """Left join by key; of several right rows the last by order counts."""
    return left.join(last_wins(right, key, order), key, "left")


def pick_base(left: DataFrame, right: DataFrame, key: str, is_base: Column, order: Column) -> DataFrame:
    """Left join by key; of several right rows a base one, else the first by order."""
    rest = [c for c in right.columns if c != key]
    picked = right.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct((~is_base).alias("later"), order.alias("order"))).alias("_row")).select(key, "_row.*")
    return left.join(picked, key, "left")


def cascade(left: DataFrame, right: DataFrame, stages: Sequence[tuple[str, Column, Column, bool]], left_id: str, right_id: str) -> DataFrame:
    """(left_id, right_id, method): stage after stage, exact matches of rows that no earlier stage used.

    A stage is (method, left key, right key, left must be unique). Right keys must be unique. A left row has
    one target per stage at most, so the first left row by id claims it. Keys are made once for all stages and travel as
    digests of 128 bits; a stage's matches are written, so that the next one doesn't find them again.
    """
    digest = lambda key: F.when(F.coalesce(key, F.lit("")) != "", F.md5(key))
    lefts = saved(left.select(F.col(left_id).alias("_l"), *[digest(x[1]).alias(f"_k{i}") for i, x in enumerate(stages)]), "left")
    rights = saved(right.select(F.col(right_id).alias("_r"), *[digest(x[2]).alias(f"_k{i}") for i, x in enumerate(stages)]), "right")
    found = None
    for i, (method, _, _, unique_left) in enumerate(stages):
        # the row of a key that only one row has: a combined aggregate
        targets = rights.where(f"_k{i} is not null").groupBy(F.col(f"_k{i}").alias("_k")).agg(F.min("_r").alias("_r"), F.count("*").alias("_n")).where("_n = 1").drop("_n")
        sources = lefts.where(f"_k{i} is not null").select(F.col(f"_k{i}").alias("_k"), "_l")
        if unique_left:
            sources = sources.groupBy("_k").agg(F.min("_l").alias("_l"), F.count("*").alias("_n")).where("_n = 1").drop("_n")
        if found is not None:
            targets, sources = targets.join(found, "_r", "left_anti"), sources.join(found, "_l", "left_anti")
        hit = sources.join(targets, "_k").groupBy("_r").agg(F.min("_l").alias("_l")).select("_l", "_r", F.lit(method).alias("method"))
        found = saved(hit if found is None else found.unionByName(hit), "found")
    return found.select(F.col("_l").alias(left_id), F.col("_r").alias(right_id), "method")


def fuzzy_candidates(left: DataFrame, right: DataFrame, left_id: str, right_id: str, score: Score, n: int = 3) -> DataFrame:
    """The n best targets of each left row by score, then id, with rank; found through rare common grams, not by scoring all pairs."""
    return most_similar(left, right, left_id, right_id, score, n)


def with_bigrams(rows: DataFrame, key: Column, name: str) -> DataFrame:
    """rows with the bigrams of a key, which is made once."""
    return rows.withColumn("_key", key).withColumn(name, bigrams(F.col("_key"))).drop("_key")


def discovery_score(effect: Dice, names: Sequence[Dice], category: tuple[str, str], cost: tuple[str, str]) -> Score:
    """Weights of a candidate search: similar effects, names (the best of several), equal category, equal cost. It never confirms."""
    return Score([(1.0, [effect]), (0.25, list(names))], [(0.15, *category), (0.10, *cost)])


def margins(candidates: DataFrame, left_id: str, least_margin: float = 0.1, least_score: float = 0.5, left: DataFrame | None = None) -> DataFrame:
    """(left_id, best, margin, status, unresolved) of each left row: best minus second; a lone candidate has no margin.

    left: all left rows; those without a candidate are unresolved candidates without a best score.
    """
    sums = candidates.groupBy(left_id).agg(F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("best"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("second"))
    if left is not None:
        sums = left.select(left_id).distinct().join(sums, left_id, "left")
    margin = F.col("best") - F.col("second")
    return sums.withColumn("margin", margin).withColumn("status", F.when(margin < least_margin, "ambiguous").otherwise("candidate")).withColumn("unresolved", F.coalesce(F.col("best") < least_score, F.lit(True))).drop("second")


def _payloads(rows: DataFrame, key: str, raw: Column, canonical: Column) -> DataFrame:
    sums = rows.groupBy(key).agg(F.count("*").alias("rows"), F.count_distinct(raw).alias("raws"), F.count_distinct(canonical).alias("canonicals"))
    status = F.when(F.col("rows") == 1, "single").when(F.col("raws") == 1, "exact_duplicate").when(F.col("canonicals") == 1, "equivalent_duplicate").otherwise("conflicting_duplicate")
    return sums.select(key, "rows", status.alias("status"))


def duplicate_audit(rows: DataFrame, key: str, raw: Column, canonical: Column) -> DataFrame:
    """(key, rows, status, blocked) of keys with several rows: exact, equivalent or conflicting duplicates; conflicting ones are blocked."""
    return _payloads(rows, key, raw, canonical).where("rows > 1").withColumn("blocked", F.col("status") == "conflicting_duplicate")


def safe_rows(rows: DataFrame, key: str, raw: Column, canonical: Column, order: str) -> DataFrame:
    """The first row by order of each key whose rows don't conflict."""
    first = rows.groupBy(key).agg(F.min_by(F.struct(*[c for c in rows.columns if c != key]), order).alias("_row"))
    blocked = duplicate_audit(rows, key, raw, canonical).where("blocked").select(key)
    return first.join(blocked, key, "left_anti").select(key, "_row.*").select(*rows.columns)


def collisions(rows: DataFrame, canonical: Column, name: str) -> DataFrame:
    """(canonical, names): canonical keys that more than one raw name comes to. Names that come to nothing have no key and don't collide."""
    return rows.withColumn("canonical", canonical).where("canonical <> ''").groupBy("canonical").agg(F.array_sort(F.collect_set(name)).alias("names")).where(F.size("names") > 1)


def canonical_index(safe: DataFrame, canonical: Column, name: str) -> DataFrame:
    """safe with its canonical key, of keys that one name and one row come to: what may be looked up."""
    keyed = safe.withColumn("canonical", canonical).where("canonical <> ''")
    one = keyed.groupBy("canonical").agg(F.count("*").alias("_n"), F.count_distinct(name).alias("_names")).where("_n = 1 and _names = 1").select("canonical")
    return keyed.join(one, "canonical", "left_semi")


def duplicate_metrics(rows: DataFrame, key: str, raw: Column, canonical: Column, kind: Column, base_key: Column, order: str) -> DataFrame:
    """One row of fourteen counts: rows and safe names in all and by kind, groups by status, collisions, indexed identities, rows saved.

    kind and base_key (null for variants) are expressions of the key.
    """
    groups = _payloads(rows, key, raw, canonical).withColumn("_kind", kind).withColumn("_canonical", base_key)
    groups = groups.withColumn("_safe", F.col("status") != "conflicting_duplicate")
    n = lambda c: F.count_if(c)
    of = lambda k: F.coalesce(F.sum(F.when(F.col("_kind") == k, F.col("rows"))), F.lit(0)).alias(f"raw_{k}")
    sums = groups.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("raw_rows"), *[of(k) for k in ("base", "upgrade", "prismatic")], F.count("*").alias("names"), *[n(F.col("_safe") & (F.col("_kind") == k)).alias(f"safe_{k}") for k in ("base", "upgrade", "prismatic")],
        *[n(F.col("status") == s).alias(s) for s in ("exact_duplicate", "equivalent_duplicate", "conflicting_duplicate")], F.coalesce(F.sum(F.when(F.col("_safe"), F.col("rows") - 1)), F.lit(0)).alias("rows_saved"))
    per = groups.where("_safe and _canonical is not null and _kind = 'base'").groupBy("_canonical").agg(F.count("*").alias("_n"))
    return sums.crossJoin(per.agg(n(F.col("_n") > 1).alias("canonical_collisions"), n(F.col("_n") == 1).alias("base_identities")))


def proposal_score(names: Sequence[Edit], effects: Sequence[Edit], category: tuple[str, str], cost: tuple[str, str], stage: tuple[str, str] | None = None) -> Score:
    """Weights of an identity search. Of several names, and of several effects, the most similar counts."""
    groups = [(0.55, list(names)), *([(0.25, list(effects))] if effects else [])]
    return Score(groups, [(0.10, *category), (0.05, *cost), *([(0.05, *stage)] if stage else [])])


def identity_search(left: DataFrame, right: DataFrame, left_id: str, right_id: str, tiers: dict[str, tuple[Column, Column]], binding: Sequence[str], score: Score, least_name: float = 0.6, least_score: float = 0.62, n_unresolved: int = 10, n_best: int = 5) -> DataFrame:
    """Per left row: the targets of each exact tier, those that bind, plausible others that remain unresolved, and the best by score.

    tiers: of each exact tier its name and the keys of both sides, which match where they are equal and not null; the targets of those in
    binding are what policy allows. Plausible is what scores at least least_score, or has a name (the first group of score) as similar as least_name.
    Tiers are joins by key, the rest goes through rare common grams. left and right have no column in common, their ids no repeats.
    """
    matched = None
    for name, (a, b) in tiers.items():
        l_keys = left.select(F.col(left_id).alias("id"), a.alias("_k")).where("_k is not null")
        r_keys = right.select(F.col(right_id).alias("r"), b.alias("_k")).where("_k is not null")
        one = l_keys.join(r_keys, "_k").select("id", "r", F.lit(name).alias("tier"))
        matched = one if matched is None else matched.unionByName(one)
    matched = saved(matched, "tiers")
    of = lambda c, name: F.array_sort(F.collect_set(F.when(c, F.col("r")))).alias(name)
    exact = matched.groupBy("id").agg(*[of(F.col("tier") == t, t) for t in tiers], of(F.col("tier").isin(*binding), "targets"))

    named = Score([(1.0, score.groups[0][1])])
    near = at_least(left, right, left_id, right_id, named, least_name).select(F.col(left_id).alias("id"), F.col(right_id).alias("r"))
    near = scored(near, left, right, left_id, right_id, score).select(left_id, right_id, "score")
    plausible = near.unionByName(at_least(left, right, left_id, right_id, score, least_score)).groupBy(left_id, right_id).agg(F.max("score").alias("score"))
    bound = matched.where(F.col("tier").isin(*binding)).select(F.col("id").alias(left_id), F.col("r").alias(right_id)).distinct()
    w = Window.partitionBy(left_id).orderBy(F.round("score", DIGITS).desc(), right_id)
    plausible = plausible.join(bound, [left_id, right_id], "left_anti").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n_unresolved)
    listed = lambda rows, name: rows.groupBy(F.col(left_id).alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", right_id))), lambda c: c[right_id]).alias(name))
    best = listed(most_similar(left, right, left_id, right_id, score, n_best), "best")

    none = F.array().cast(f"array<{right.schema[right_id].dataType.simpleString()}>")
    out = left.select(F.col(left_id).alias("id")).join(best, "id", "left").join(exact, "id", "left").join(listed(plausible, "unresolved"), "id", "left")
    return out.select(F.col("id").alias(left_id), *[F.coalesce(c, none).alias(c) for c in (*tiers, "targets", "unresolved", "best")])


def proposals(candidates: DataFrame, left_id: str, targets: Column, confirmed: Column, support: Column, exclusion: Column, unresolved: Column | None = None) -> DataFrame:
    """One compliant target means the same identity; else there isn't enough evidence, with how strong the case for a missing one is.

    It is a case at all only for a confirmed member without any target; moderate if candidates remain (unresolved, their
    number); strong with two pieces of support and one of exclusion.
    """
    one, none = F.size(targets) == 1, F.size(targets) == 0
    left = F.lit(0) if unresolved is None else unresolved
    missing = F.when(one | ~none | ~confirmed, "none").when((left == 0) & (support >= 2) & (exclusion >= 1), "strong").otherwise("moderate")
    return candidates.select(left_id, F.when(one, "same_identity").otherwise("insufficient_evidence").alias("action"), F.when(one, F.element_at(targets, 1)).alias("target"), missing.alias("missing_hypothesis"))


def conditional_edges(candidates: DataFrame, left_id: str, strong: float = 0.8, lead: float = 0.05) -> DataFrame:
    """Best candidates that are strong and ahead of the second by more than lead."""
    w = Window.partitionBy(left_id).orderBy(F.desc("score"), "rank")
    return candidates.withColumn("_next", F.lead("score").over(w)).where((F.col("rank") == 1) & (F.col("score") >= strong) & (F.col("_next").isNull() | (F.col("score") - F.col("_next") > lead))).drop("_next")


def review_union(queues: Sequence[tuple[str, DataFrame]], key: str, keep: Sequence[str] = ()) -> DataFrame:
    """(key, reasons, keep...): reasons in the order of the queues, each once; the columns in keep as the first queue has them."""
    rows = None
    for i, (name, df) in enumerate(queues):
        part = df.select(key, *keep, F.lit(i).alias("_i"), F.lit(name).alias("_name"))
        rows = part if rows is None else rows.unionByName(part)
    first = [F.min(F.struct("_i", *keep)).alias("_row")] if keep else []
    found = rows.groupBy(key).agg(F.array_sort(F.collect_set(F.struct("_i", "_name"))).alias("_r"), *first)
    return found.select(key, F.transform("_r", lambda r: r["_name"]).alias("reasons"), *[F.col(f"_row.{c}").alias(c) for c in keep])


def unmatched_queue(rows: DataFrame, key: str, candidates: DataFrame, evidence: DataFrame, names: DataFrame, n: int = 3) -> DataFrame:
    """rows with what may match them: the n best candidates (key, target, score), client evidence (key, client), other names (key, other).

    What is recommended is always insufficient_evidence: a queue never decides.
    """
    w = Window.partitionBy(key).orderBy(F.desc("score"), "target")
    best = candidates.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_rank", "target"))), lambda c: c["target"]).alias("candidates"))
    client = evidence.groupBy(key).agg(F.min("client").alias("client"))
    other = names.groupBy(key).agg(F.array_sort(F.collect_set("other")).alias("names"))
    out = rows.join(best, key, "left").join(client, key, "left").join(other, key, "left")
    return out.select(*rows.columns, *[F.coalesce(F.transform(c, lambda x: x.cast("string")), F.array().cast("array<string>")).alias(c) for c in ("candidates", "names")], "client", F.lit("insufficient_evidence").alias("action"))


def presence(ids: DataFrame, key: str, sources: dict[str, DataFrame]) -> DataFrame:
    """ids with a flag per source, and `seen`: in how many sources a row is."""
    out = ids
    for name, df in sources.items():
        out = out.join(df.select(key).distinct().withColumn(name, F.lit(True)), key, "left").withColumn(name, F.coalesce(name, F.lit(False)))
    total = F.lit(0)
    for name in sources:
        total = total + F.col(name).cast("int")
    return out.withColumn("seen", total)


def compared(left: Column, right: Column, comparable: Column | None = None) -> Column:
    """agreement, conflict, or a matter of judgement where values aren't comparable."""
    ok = comparable if comparable is not None else left.isNotNull() & right.isNotNull()
    return F.when(~F.coalesce(ok, F.lit(False)), "semantic_review").when(left == right, "agreement").otherwise("conflict")


def presence_audit(*flags: Column) -> Column:
    """all_present, all_absent, or presence_conflict among any number of sources; null counts as absent."""
    told = F.array(*[F.coalesce(f, F.lit(False)) for f in flags])
    return F.when(F.forall(told, lambda x: x), "all_present").when(~F.exists(told, lambda x: x), "all_absent").otherwise("presence_conflict")


#: What a condition's text states, first pattern of a kind first.
FACTS = (
    ("gold", (r"(?i)(?:at least\s*)?(\d+)\s*gold\b", r"(?:至少拥有?\s*)?(\d+)\s*金币")),
    ("player_health", (r"(?i)(?:at least\s*)?(\d+)\s*(?:player\s*)?(?:health|hp)\b", r"生命值(?:至少|高于)?\s*(\d+)", r"(?:至少拥有?\s*)?(\d+)\s*(?:玩家)?生命值")),
    ("level", (r"(?i)(?:level|等级(?:达到)?)\s*(\d+)",)),
    ("board_count", (r"(?i)(?:at least|至少|不少于)\s*(\d+)\s*(?:[^;]{0,20})(?:on board|在场|弈子)",)),
)


def facts(text: Column, patterns: Sequence[tuple[str, Sequence[str]]] = FACTS, active: str = r"(?i)(?:trait active|羁绊.*激活|激活.*羁绊)") -> Column:
    """Typed facts of a text: an array of (type, operator, value)."""
    made = lambda kind, op, v: F.struct(F.lit(kind).alias("type"), F.lit(op).cast("string").alias("operator"), v.alias("value"))
    out = []
    for kind, forms in patterns:
        value = F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")).try_cast("double") for p in forms])
        out.append(F.when(value.isNotNull(), made(kind, ">=", value)))
    out.append(F.when(text.rlike(active), made("trait_active", None, F.lit(1.0))))
    return F.array_compact(F.array(*out))


