"""Concept tagging by rules, a human decision overlay on top, materialisation, and the gate that compares both.

Machine output and human decisions are separate tables joined by key; neither overwrites the other.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import nfkc_each
from quillon.operators import terms

#: So many patterns are simply tried one after the other, in the JVM.
FEW = 16


@dataclass(frozen=True)
class Rule:
    """A concept, the pattern that shows it, and where it may: which fields, which records."""

    concept: str
    pattern: str
    confidence: str = "high"
    flag: str | None = None
    fields: Column | None = None
    records: Column | None = None


def _element(name: str):
    return lambda x, i: F.struct(F.format_string(f"{name}[%d]", i).alias("field"), i.alias("position"), x.alias("text"))


def unpivot_fields(records: DataFrame, key: str, scalars: dict[str, Column], lists: dict[str, Column] | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """(key, field, position, text) of each searchable field; elements of lists are field[i].part, empty texts are left out."""
    cells = [F.struct(F.lit(n).alias("field"), F.lit(None).cast("int").alias("position"), c.alias("text")) for n, c in scalars.items()]
    array = F.array(*cells)
    for name, c in (lists or {}).items():
        array = F.concat(array, F.transform(F.coalesce(c, F.array().cast("array<string>")), _element(name)))
    return records.select(key, *carry, F.inline(array)).where("coalesce(text, '') <> ''")


def tag(fields: DataFrame, key: str, rules: Sequence[Rule]) -> DataFrame:
    """(key, field, rule, concept, confidence, flag, evidence) of each hit; evidence is the first match.

    All rules are tested in one pass over the fields; hits are exploded, not fields times rules. Of more than FEW rules a text only meets those
    of which a literal occurs in it, found by one automaton, and those that have none.
    """
    if len(rules) > FEW:
        return _tag_tried(fields, key, rules)
    hits = []
    for i, r in enumerate(rules):
        test = F.col("text").rlike(r.pattern)
        for guard in (r.fields, r.records):
            test = test if guard is None else test & guard
        hits.append(F.when(test, F.struct(F.lit(i).alias("rule"), F.lit(r.concept).alias("concept"), F.lit(r.confidence).alias("confidence"), F.lit(r.flag).cast("string").alias("flag"), F.regexp_extract(F.col("text"), f"({r.pattern})", 1).alias("evidence"))))
    return fields.select(key, "field", F.inline(F.array_compact(F.array(*hits))))


def _tag_tried(fields: DataFrame, key: str, rules: Sequence[Rule]) -> DataFrame:
    rows = [(i, r.pattern, r.concept, r.confidence, r.flag) for i, r in enumerate(rules)]
    table = fields.sparkSession.createDataFrame(rows, "rule int, _pattern string, concept string, confidence string, flag string")
    each = fields.withColumn("rule", F.explode(terms.tried([r.pattern for r in rules])(F.col("text")))).join(F.broadcast(table), "rule")
    guard = F.lit(True)
    for i, r in enumerate(rules):
        own = [g for g in (r.fields, r.records) if g is not None]
        if own:
            guard = guard & ((F.col("rule") != i) | F.coalesce(reduce(lambda a, b: a & b, own), F.lit(False)))
    hit = each.where(guard & F.rlike(F.col("text"), F.col("_pattern")))
    return hit.select(key, "field", "rule", "concept", "confidence", "flag", F.call_function("regexp_extract", F.col("text"), F.concat(F.lit("("), F.col("_pattern"), F.lit(")")), F.lit(1)).alias("evidence"))


def assignments(tags: DataFrame, key: str) -> DataFrame:
    """(key, concept, confidence, flag, evidence): one row per pair; confidence and flag of its first rule, evidence in order."""
    first = F.min_by(F.struct("confidence", "flag"), F.struct("rule", "field"))
    lists = F.transform(F.array_sort(F.collect_set(F.struct("rule", "field", "evidence"))), lambda e: e["evidence"])
    return tags.groupBy(key, "concept").agg(first.alias("_f"), lists.alias("evidence")).select(key, "concept", "_f.confidence", "_f.flag", "evidence")


def guards(fields: DataFrame, key: str, groups: dict[str, str]) -> DataFrame:
    """(key, field, risk): fields that a risk group's pattern makes a matter for review, whatever rules say."""
    if len(groups) > FEW:
        return _tag_tried(fields, key, [Rule(n, p) for n, p in groups.items()]).select(key, "field", F.col("concept").alias("risk"))
    risks = F.array_compact(F.array(*[F.when(F.col("text").rlike(p), F.lit(n)) for n, p in groups.items()]))
    return fields.select(key, "field", F.explode(risks).alias("risk"))


def alias_collisions(aliases: DataFrame, alias: Column, group: str) -> DataFrame:
    """(alias, groups) of aliases that more than one group claims."""
    return aliases.select(alias.alias("alias"), group).groupBy("alias").agg(F.array_sort(F.collect_set(group)).alias("groups")).where(F.size("groups") > 1)


def effective(generated: DataFrame, decisions: DataFrame, key: str, concept: str = "concept") -> DataFrame:
    """(key, concept) after decisions: approved ones as they are, modified ones replaced, rejected and undecided ones gone."""
    d = decisions.select(key, concept, "action", "replacement")
    out = generated.select(key, concept).join(d, [key, concept]).where(F.col("action").isin("approved", "modified"))
    return out.select(key, F.when(F.col("action") == "modified", F.col("replacement")).otherwise(F.col(concept)).alias(concept)).where(F.col(concept).isNotNull()).distinct()


def overlay_violations(generated: DataFrame, decisions: DataFrame, key: str, concept: str = "concept", actions: Sequence[str] = ("approved", "rejected", "modified")) -> DataFrame:
    """(key, concept, problem): undecided, stale, repeated, of an unknown action, or modified without a replacement."""
    d = decisions.groupBy(key, concept).agg(F.count("*").alias("_n"), F.min("action").alias("_a"), F.min("replacement").alias("_r"))
    both = generated.select(key, concept).distinct().withColumn("_g", F.lit(True)).join(d, [key, concept], "full_outer")
    checks = [(F.col("_n").isNull(), "undecided"), (F.col("_g").isNull(), "stale"), (F.col("_n") > 1, "repeated"), (F.col("_n").isNotNull() & ~F.coalesce(F.col("_a").isin(*actions), F.lit(False)), "unknown_action"), ((F.col("_a") == "modified") & F.col("_r").isNull(), "no_replacement")]
    problems = F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in checks]))
    return both.select(key, concept, F.explode(problems).alias("problem"))


def stale_problems(reviewed: DataFrame, current: DataFrame, columns: Sequence[str] = ("patch", "version", "digest")) -> DataFrame:
    """(column, problem) where a review was made against another state than the current one: one row of metadata each."""
    both = reviewed.select(*[F.col(c).alias(f"_r_{c}") for c in columns]).crossJoin(F.broadcast(current.select(*[F.col(c).alias(f"_c_{c}") for c in columns])))
    return both.select(F.explode(F.array_compact(F.array(*[F.when(~F.col(f"_r_{c}").eqNullSafe(F.col(f"_c_{c}")), F.lit(c)) for c in columns]))).alias("column")).withColumn("problem", F.lit("stale"))


def alias_problems(groups: DataFrame, decisions: DataFrame, group: str = "group") -> DataFrame:
    """(group, problem) of decisions on the aliases of expansion groups.

    groups: (group, aliases); decisions: (group, approved, rejected array<struct<alias, reason>>). Every group must be decided once
    (undecided, repeated, unknown_group); what is approved must be exactly the group's aliases (not_in_draft, not_approved), no alias
    may be listed twice (repeated_alias) or both approved and rejected (contradictory), and a rejection needs a reason (no_reason).
    """
    form = lambda c: F.transform(c, lambda x: F.lower(F.trim(x)))
    n = decisions.groupBy(group).agg(F.count("*").alias("_n"))
    g = groups.select(group, form(nfkc_each(F.col("aliases"))).alias("_draft"))
    d = decisions.select(group, form(nfkc_each(F.col("approved"))).alias("_yes"), form(nfkc_each(F.transform("rejected", lambda r: r["alias"]))).alias("_no"), F.transform("rejected", lambda r: r["reason"]).alias("_why"))
    both = g.join(d.join(n, group), group, "full_outer")
    decided = F.col("_n").isNotNull() & F.col("_draft").isNotNull()
    unlike = lambda a, b: decided & (F.size(F.array_except(a, b)) > 0)
    checks = [
        (F.col("_n").isNull(), "undecided"), (F.col("_draft").isNull(), "unknown_group"), (F.col("_n") > 1, "repeated"), (unlike("_yes", "_draft"), "not_in_draft"), (unlike("_draft", "_yes"), "not_approved"),
        ((F.size("_yes") > F.size(F.array_distinct("_yes"))) | (F.size("_no") > F.size(F.array_distinct("_no"))), "repeated_alias"), (F.size(F.array_intersect("_yes", "_no")) > 0, "contradictory"), (F.exists("_why", lambda w: F.coalesce(w, F.lit("")) == ""), "no_reason")]
    return both.select(group, F.explode(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(p)) for c, p in checks]))).alias("problem")).distinct()


def materialise(records: DataFrame, assigned: DataFrame, key: str, concept: str = "concept", name: str = "concepts") -> DataFrame:
    """records with a sorted array of concepts, empty where there are none; all else unchanged."""
    lists = assigned.groupBy(key).agg(F.array_sort(F.collect_set(concept)).alias(name))
    return records.join(lists, key, "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))


def compatibility(records: DataFrame, lexicon: DataFrame, key: str, name: str = "concepts") -> DataFrame:
    """(key, problem) where published records and the lexicon's membership (key, concepts) differ: fail closed on any row."""
    a = records.select(key, F.array_sort(name).alias("_a"), F.lit(True).alias("_in"))
    b = lexicon.select(key, F.array_sort(name).alias("_b"), F.lit(True).alias("_lex"))
    problem = F.when(F.col("_in").isNull(), "unknown_record").when(F.col("_lex").isNull() & (F.size("_a") > 0), "missing_membership").when(F.col("_lex").isNotNull() & ~F.col("_a").eqNullSafe(F.col("_b")), "different_concepts")
    return a.join(b, key, "full_outer").select(key, problem.alias("problem")).where("problem is not null")


def require_none(violations: DataFrame, what: str) -> None:
    """Raises if there is a violation; shows the first few."""
    rows = violations.limit(5).collect()
    if rows:
        raise ValueError(f"{what}: {rows}")
