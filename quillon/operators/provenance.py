"""Evidence by field: comparison, selection by provenance, decisions and their fulfilment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Observations that never count as evidence of a value.
EXCLUDED = ("not_observed", "representation_only", "acquisition_metadata", "queue_discovery")


def compare(evidence: DataFrame, keys: list[str], value: Column, proposed: Column, state: str = "state") -> DataFrame:
    """keys with values, proposals and status: missing, decision_ready, target_selection, or a kind of conflict."""
    seen = ~F.coalesce(F.col(state).isin(*EXCLUDED), F.lit(False))
    used = F.when(seen & value.isNotNull(), value)
    sums = evidence.groupBy(*keys).agg(F.array_sort(F.collect_set(used)).alias("values"), F.array_sort(F.collect_set(F.when(seen & value.isNotNull(), proposed))).alias("proposals"))
    numeric = F.forall("values", lambda v: v.try_cast("double").isNotNull())
    same = F.size(F.array_distinct(F.transform("values", lambda v: F.lower(F.trim(v))))) == 1
    status = F.when(F.size("values") == 0, "missing").when((F.size("values") == 1) & (F.size("proposals") <= 1), "decision_ready").when(F.size("values") == 1, "target_selection").when(same, "representation_conflict").when(numeric, "numeric_conflict").otherwise("semantic_conflict")
    return sums.withColumn("status", status)


def pick(evidence: DataFrame, keys: list[str], tier: str, locale: str, source: str) -> DataFrame:
    """Of each key's evidence the best: lowest tier, single-locale first, then source id. A minimum, combined before the shuffle."""
    rank = F.struct(F.col(tier).alias("t"), F.coalesce(F.col(locale) == "multi", F.lit(False)).alias("m"), F.col(source).alias("s"))
    rest = [c for c in evidence.columns if c not in keys]
    return evidence.groupBy(*keys).agg(F.min_by(F.struct(*rest), rank).alias("_row")).select(*keys, "_row.*")


def consolidate(issues: DataFrame, record: str, reasons: Column, logical: Column, proposition: Column) -> DataFrame:
    """(record, field, proposition, reasons): one row per matter, with its distinct reasons sorted."""
    rows = issues.select(record, F.explode(reasons).alias("reason"), proposition.alias("proposition"))
    return rows.withColumn("field", logical).groupBy(record, "field", "proposition").agg(F.array_sort(F.collect_set("reason")).alias("reasons"))


def readiness(decisions: DataFrame, key: str, field: str, required: Sequence[str], valid: Column) -> DataFrame:
    """(key, decided, ready): ready when each required field has exactly one valid decision."""
    per = decisions.where(F.col(field).isin(*required)).groupBy(key, field).agg(F.count_if(F.coalesce(valid, F.lit(False))).alias("_n"))
    return per.groupBy(key).agg(F.count_if(F.col("_n") == 1).alias("decided")).withColumn("ready", F.col("decided") == len(required))


def assemble(decisions: DataFrame, key: str, field: str, value: str, fields: Sequence[str]) -> DataFrame:
    """One record per key from its decided fields; a field without a decision is unknown, a decided null is confirmed."""
    cells = [F.max_by(F.struct(F.lit("confirmed").alias("status"), F.col(value).alias("value")), F.when(F.col(field) == f, 1)).alias(f) for f in fields]
    unknown = F.struct(F.lit("unknown").alias("status"), F.lit(None).cast("string").alias("value"))
    out = decisions.groupBy(key).agg(*cells)
    return out.select(key, *[F.coalesce(F.col(f), unknown).alias(f) for f in fields])


def amended(layers: list[DataFrame], review: str) -> DataFrame:
    """Later amendments replace earlier decisions of the same review."""
    from quillon.operators.align import overlay

    return overlay(layers, review)


def amendment_problems(amendments: DataFrame, targets: DataFrame, review: str) -> DataFrame:
    """(review, problem) where amendments aren't exactly the targets, each once: missing, not_allowed or repeated."""
    n = amendments.groupBy(review).agg(F.count("*").alias("_n"))
    both = targets.select(review).distinct().withColumn("_t", F.lit(True)).join(n, review, "full_outer")
    problem = F.when(F.col("_t").isNull(), "not_allowed").when(F.col("_n").isNull(), "missing").when(F.col("_n") > 1, "repeated")
    return both.select(review, problem.alias("problem")).where("problem is not null")


def override_problems(overrides: DataFrame, allowed: DataFrame, decisions: DataFrame, key: str) -> DataFrame:
    """(key, problem) of manual overrides: not_allowed, repeated, wrong_value, not_unresolved, or missing.

    overrides and allowed: (key, value); decisions: (key, action). Exactly the allowed targets may be overridden, each once, with
    the allowed value, and each must be a decision that is still unresolved.
    """
    o = overrides.groupBy(key).agg(F.count("*").alias("_n"), F.min("value").alias("_v"), F.max("value").alias("_w"))
    a = allowed.select(key, F.col("value").alias("_a"), F.lit(True).alias("_ok"))
    d = decisions.groupBy(key).agg(F.min("action").alias("_d"), F.count("*").alias("_m"))
    both = o.join(a, key, "full_outer").join(d, key, "left")
    made = F.col("_n").isNotNull()
    open_ = F.coalesce((F.col("_d") == "unresolved") & (F.col("_m") == 1), F.lit(False))
    checks = [(made & F.col("_ok").isNull(), "not_allowed"), (F.col("_n") > 1, "repeated"), (made & F.col("_ok") & ~(F.col("_v").eqNullSafe(F.col("_a")) & F.col("_w").eqNullSafe(F.col("_a"))), "wrong_value"), (made & F.col("_ok") & ~open_, "not_unresolved"), (~made, "missing")]
    return both.select(key, F.explode(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for c, n in checks]))).alias("problem"))


def apply_overrides(decisions: DataFrame, overrides: DataFrame, key: str) -> DataFrame:
    """decisions (key, action, value) where an override approves its explicit value; check override_problems() first."""
    o = overrides.select(key, F.col("value").alias("_v"), F.lit(True).alias("_o"))
    out = decisions.join(o, key, "left")
    rest = [c for c in decisions.columns if c not in (key, "action", "value")]
    return out.select(key, F.when(F.col("_o"), "approve_explicit_value").otherwise(F.col("action")).alias("action"), F.when(F.col("_o"), F.col("_v")).otherwise(F.col("value")).alias("value"), *rest)


def identity_status(decisions: DataFrame, production: DataFrame, mappings: DataFrame, key: str = "client") -> DataFrame:
    """(key, status, target, problem) of identity decisions: fulfilled or pending_apply.

    decisions: (key, action, target); production: (id, key); mappings: (key, id) reviewed by people. The targets of a decision are
    the records with its key and those mapped to it. Problems: missing_target (mapped to no record), wrong_identity (mapped to a
    record with another key), ambiguous (more than one target, or one listed twice), other_target (not the approved one).
    """
    p = production.select("id", F.col(key).alias("_own"))
    direct = p.where("_own is not null").select(F.col("_own").alias(key), "id", F.lit("direct").alias("how"))
    mapped = mappings.select(key, "id").join(p, "id", "left").join(production.select("id", F.lit(True).alias("_there")).distinct(), "id", "left")
    faults = mapped.groupBy(key).agg(F.max(F.col("_there").isNull()).alias("_gone"), F.max(F.coalesce(F.col("_own") != F.col(key), F.lit(False))).alias("_wrong"))
    both = direct.unionByName(mapped.select(key, "id", F.lit("mapped").alias("how")))
    per = both.groupBy(key).agg(F.count_distinct("id").alias("_n"), F.min("id").alias("_t"), F.count_if(F.col("how") == "direct").alias("_direct"), F.count_if(F.col("how") == "mapped").alias("_mapped"))
    d = decisions.select(key, "action", F.col("target").alias("_approved")).join(per, key, "left").join(faults, key, "left")
    unlike = (F.col("action") == "same_identity") & (F.col("_n") == 1) & ~F.col("_t").eqNullSafe(F.col("_approved"))
    problem = F.when(F.col("_gone"), "missing_target").when(F.col("_wrong"), "wrong_identity").when((F.col("_n") > 1) | (F.col("_direct") > 1) | (F.col("_mapped") > 1), "ambiguous").when(unlike, "other_target")
    done = (F.col("_n") == 1) & problem.isNull()
    return d.select(key, F.when(F.coalesce(done, F.lit(False)), "fulfilled").otherwise("pending_apply").alias("status"), F.col("_t").alias("target"), problem.alias("problem"))


def mutations(before: DataFrame, after: DataFrame, key: str, fields: Sequence[str], approvals: DataFrame) -> DataFrame:
    """(key, field, problem) of changes between two states that nobody approved.

    approvals: (key, field, value, source); a state has each field as a struct (value, source). Problems: deleted (the whole
    record), unapproved (changed without approval), wrong_value (changed to another value than approved), provenance_drift
    (the value may stay, but its source changed to one that isn't approved).
    """
    cells = lambda df, n: df.select(key, F.lit(True).alias(f"_in{n}"), F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"{f}.value").cast("string").alias(f"_v{n}"), F.col(f"{f}.source").alias(f"_s{n}")) for f in fields])))
    a = approvals.select(key, "field", F.col("value").cast("string").alias("_value"), F.col("source").alias("_source"), F.lit(True).alias("_ok"))
    both = cells(before, 0).join(cells(after, 1), [key, "field"]).join(a, [key, "field"], "left")
    changed, moved = ~F.col("_v0").eqNullSafe(F.col("_v1")), ~F.col("_s0").eqNullSafe(F.col("_s1"))
    problem = F.when(changed & F.col("_ok").isNull(), "unapproved").when(changed & ~F.col("_v1").eqNullSafe(F.col("_value")), "wrong_value").when(moved & ~F.coalesce(F.col("_ok") & F.col("_s1").eqNullSafe(F.col("_source")), F.lit(False)), "provenance_drift")
    gone = before.join(after.select(key), key, "left_anti").select(key, F.lit("*").alias("field"), F.lit("deleted").alias("problem"))
    return both.select(key, "field", problem.alias("problem")).where("problem is not null").unionByName(gone)


def binding_problems(decisions: DataFrame, items: DataFrame, review: str, bundle_digest: Column) -> DataFrame:
    """(review, problem) of decisions against the frozen items that they decide on.

    decisions: (review, field, action, value, refs, digest); items: (review, field, candidates, refs, absent, production). Problems:
    stale_evidence (another digest than bundle_digest, which the items' frozen() digests give), target_drift (another field),
    unbound_evidence (a reference that the item hasn't), not_derived (an approved value that is no candidate), ambiguous_proposal
    (a proposal approved among several candidates), no_evidence (an approval without references), unknown_with_value,
    unsupported_absence, no_record (to keep the current value of a record that isn't there).
    """
    i = items.select(review, F.col("field").alias("_f"), F.col("candidates").alias("_c"), F.col("refs").alias("_r"), F.col("absent").alias("_absent"), F.col("production").alias("_p"))
    d = decisions.join(i, review)
    approves, action = F.col("action").isin("approve_proposal", "approve_explicit_value"), F.col("action")
    derived = F.coalesce(F.array_contains("_c", F.col("value")), F.lit(False))
    checks = [
        (~F.col("digest").eqNullSafe(bundle_digest), "stale_evidence"), (~F.col("field").eqNullSafe(F.col("_f")), "target_drift"), (F.size(F.array_except("refs", "_r")) > 0, "unbound_evidence"), (approves & ~derived, "not_derived"),
        ((action == "approve_proposal") & (F.size("_c") != 1), "ambiguous_proposal"), (approves & (F.coalesce(F.size("refs"), F.lit(0)) <= 0), "no_evidence"), ((action == "accepted_unknown") & F.col("value").isNotNull(), "unknown_with_value"),
        ((action == "confirmed_absent") & ~F.coalesce("_absent", F.lit(False)), "unsupported_absence"), ((action == "retain_current") & F.col("_p").isNull(), "no_record")]
    return d.select(review, F.explode(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for c, n in checks]))).alias("problem"))


def review_packet(records: DataFrame, evidence: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """(key, field, n_evidence, values, status): one review unit per record and field, with its evidence compared; without evidence, missing.

    records: (key); evidence: (key, field, value, proposed, state).
    """
    units = records.select(key, F.explode(F.array(*map(F.lit, fields))).alias("field"))
    told = compare(evidence, [key, "field"], F.col("value"), F.col("proposed"))
    n = evidence.groupBy(key, "field").agg(F.count("*").alias("n_evidence"))
    out = units.join(told, [key, "field"], "left").join(n, [key, "field"], "left")
    return out.select(key, "field", F.coalesce("n_evidence", F.lit(0)).alias("n_evidence"), F.coalesce("values", F.array().cast("array<string>")).alias("values"), F.coalesce("status", F.lit("missing")).alias("status"))


def fulfilment(changes: DataFrame, approvals: DataFrame, keys: list[str]) -> DataFrame:
    """keys with status: fulfilled, wrong_value, unapproved (changed without approval) or pending. changes: keys, new; approvals: keys, value."""
    both = changes.select(*keys, F.col("new").alias("_new"), F.lit(True).alias("_c")).join(approvals.select(*keys, F.col("value").alias("_value"), F.lit(True).alias("_a")), keys, "full_outer")
    status = F.when(F.col("_a").isNull(), "unapproved").when(F.col("_c").isNull(), "pending").when(F.col("_new").eqNullSafe(F.col("_value")), "fulfilled").otherwise("wrong_value")
    return both.select(*keys, status.alias("status"))


def decision_problems(decisions: DataFrame, expected: DataFrame, review: str, allowed: Sequence[str], action: str = "action", evidence: str = "evidence") -> DataFrame:
    """(review, problem): missing, orphan, repeated, of an unknown action, or without evidence."""
    d = decisions.groupBy(review).agg(F.count("*").alias("_n"), F.min(action).alias("_a"), F.min(F.size(evidence)).alias("_e"))
    both = expected.select(review).distinct().withColumn("_x", F.lit(True)).join(d, review, "full_outer")
    checks = [(F.col("_n").isNull(), "missing"), (F.col("_x").isNull(), "orphan"), (F.col("_n") > 1, "repeated"), (F.col("_n").isNotNull() & ~F.coalesce(F.col("_a").isin(*allowed), F.lit(False)), "unknown_action"), (F.col("_e") == 0, "no_evidence")]
    return both.select(review, F.explode(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for c, n in checks]))).alias("problem"))


def frozen(evidence: DataFrame, review: str, order: list[Column], payload: list[str]) -> DataFrame:
    """Evidence numbered within each review, with a digest of each row. A review's rows are sorted (with spill), never gathered in memory."""
    i = F.row_number().over(Window.partitionBy(review).orderBy(*order))
    out = evidence.withColumn("_i", i).withColumn("_p", F.struct(*payload))
    return out.select(F.format_string("%s-E%02d", F.col(review).cast("string"), F.col("_i")).alias("evidence_id"), F.col(review), *[F.col(c) for c in payload if c != review], F.sha2(F.to_json("_p", {"ignoreNullFields": "false"}), 256).alias("digest"))


def bundle(frozen_evidence: DataFrame, manifest: DataFrame, baseline: DataFrame) -> DataFrame:
    """One row that seals frozen evidence: counts and digests of evidence, source manifest and production baseline, and a digest of these.

    The digests don't depend on the order of rows, so no rows are gathered; the bundle's own digest tells that nothing changed.
    """
    from quillon.operators.validate import digest

    parts = [digest(df, sorted(df.columns)).select(F.col("rows").alias(f"{n}_rows"), F.col("digest").alias(f"{n}_digest")) for n, df in (("evidence", frozen_evidence), ("manifest", manifest), ("baseline", baseline))]
    out = parts[0].crossJoin(parts[1]).crossJoin(parts[2])
    return out.withColumn("bundle_digest", F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in out.columns]), 256))


def bundle_intact(sealed: DataFrame) -> DataFrame:
    """sealed bundles with `intact`: whether a bundle's own digest is that of its parts."""
    parts = [c for c in sealed.columns if c != "bundle_digest"]
    return sealed.withColumn("intact", F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in parts]), 256) == F.col("bundle_digest"))
