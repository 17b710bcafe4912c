"""Decisions, amendments, overrides, frozen evidence, and the checks before anything is published."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators import concepts as C
from quillon.operators import provenance as V
from quillon.operators import seals as E
from quillon.operators.saved import saved, spread
from quillon.operators import validate as W
from quillon.plans.registry import Tables, query

@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'third' WHEN o_orderkey % 3 = 0 THEN 'second' ELSE 'first' END AS action FROM orders")
def q_amended(t: Tables) -> DataFrame:
    """Later amendments replace earlier decisions of the same review."""
    layer = lambda name, n: t.orders.where(F.col("o_orderkey") % n == 0).select("o_orderkey", F.lit(name).alias("action"))
    return V.amended([layer("first", 1), layer("second", 3), layer("third", 5)], "o_orderkey")


@query("SELECT k, problem FROM (SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'not_allowed' WHEN a.k IS NULL THEN 'missing' WHEN n > 1 THEN 'repeated' END AS problem FROM (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1) a FULL JOIN (SELECT c_custkey AS k FROM customer WHERE c_custkey % 4 <> 0) b ON a.k = b.k) WHERE problem IS NOT NULL")
def q_amendment_problems(t: Tables) -> DataFrame:
    """Amendments must be of exactly the targets, each once."""
    return V.amendment_problems(t.orders.select(F.col("o_custkey").alias("k")), t.customer.where("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("k")), "k")


def overrides(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Manual overrides, some of them faulty, what is allowed, and the decisions that they are to resolve."""
    k = F.col("p_partkey")
    made = t.part.where(k % 7 < 5).select(k.alias("k"), F.when(k % 7 == 1, "other").otherwise(F.col("p_type")).alias("value"))
    made = made.union(made.where(F.col("k") % 7 == 2))
    allowed = t.part.where(k % 7 != 3).select(k.alias("k"), F.col("p_type").alias("value"))
    decisions = t.part.select(k.alias("k"), F.when(k % 7 == 4, "approve_proposal").otherwise("unresolved").alias("action"), F.lit(None).cast("string").alias("value"))
    return made, allowed, decisions


@query("SELECT p_partkey AS k, CASE p_partkey % 7 WHEN 1 THEN 'wrong_value' WHEN 2 THEN 'repeated' WHEN 3 THEN 'not_allowed' WHEN 4 THEN 'not_unresolved' ELSE 'missing' END AS problem FROM part WHERE p_partkey % 7 > 0")
def q_override_problems(t: Tables) -> DataFrame:
    return V.override_problems(*overrides(t), "k")


@query("SELECT p_partkey AS k, CASE WHEN p_partkey % 7 = 0 THEN 'approve_explicit_value' WHEN p_partkey % 7 = 4 THEN 'approve_proposal' ELSE 'unresolved' END AS action, CASE WHEN p_partkey % 7 = 0 THEN p_type END AS value FROM part")
def q_overrides_applied(t: Tables) -> DataFrame:
    """Those overrides that have no problem, applied to the decisions."""
    made, allowed, decisions = overrides(t)
    good = made.join(V.override_problems(made, allowed, decisions, "k").select("k").distinct(), "k", "left_anti")
    return V.apply_overrides(decisions, good, "k")


@query("SELECT p_partkey AS client, CASE p_partkey % 8 WHEN 1 THEN 'fulfilled' WHEN 2 THEN 'fulfilled' ELSE 'pending_apply' END AS status, CASE p_partkey % 8 WHEN 3 THEN 'missing_target' WHEN 4 THEN 'wrong_identity' WHEN 5 THEN 'ambiguous' WHEN 6 THEN 'other_target' END AS problem FROM part")
def q_identity_status(t: Tables) -> DataFrame:
    """Decisions without target; done by the record's own key; by a mapping; mapped to nothing, to another's record, to two; to another than approved; undone."""
    k = F.col("p_partkey")
    name = lambda x: F.concat(F.lit("r"), (k + x).cast("string"))
    far = 10_000_000
    direct = t.part.where(k % 8 == 1).select(name(0).alias("id"), k.alias("client"))
    others = t.part.where((k % 8).isin(2, 5, 6)).select(name(0).alias("id"), F.lit(None).cast("long").alias("client"))
    taken = t.part.where(k % 8 == 4).select(name(0).alias("id"), (k + far).alias("client"))
    twins = t.part.where(k % 8 == 5).select(name(far).alias("id"), F.lit(None).cast("long").alias("client"))
    mapped = t.part.where((k % 8).isin(2, 3, 4, 5, 6)).select(k.alias("client"), name(0).alias("id")).union(t.part.where(k % 8 == 5).select(k.alias("client"), name(far).alias("id")))
    approved = F.when(k % 8 == 6, "another").when((k % 8).isin(1, 2), name(0))
    decisions = t.part.select(k.alias("client"), F.when(approved.isNotNull(), "same_identity").otherwise("missing_base_identity").alias("action"), approved.alias("target"))
    return V.identity_status(decisions, direct.union(others).union(taken).union(twins), mapped).select("client", "status", "problem")


@query("SELECT o_orderkey, field, problem FROM (SELECT o_orderkey, 'a' AS field, CASE WHEN o_orderkey % 7 = 1 THEN 'unapproved' WHEN o_orderkey % 7 = 2 THEN 'wrong_value' WHEN o_orderkey % 7 = 4 THEN 'provenance_drift' END AS problem FROM orders WHERE o_orderkey % 7 <> 5 UNION ALL SELECT o_orderkey, '*', 'deleted' FROM orders WHERE o_orderkey % 7 = 5) WHERE problem IS NOT NULL")
def q_mutations(t: Tables) -> DataFrame:
    """Changes between two states: none, unapproved, to another value than approved, as approved, of the source alone, and deletions."""
    k = F.col("o_orderkey") % 7
    cell = lambda v, s: F.struct(v.alias("value"), s.alias("source"))
    before = t.orders.select("o_orderkey", cell(F.col("o_orderstatus"), F.lit("s1")).alias("a"), cell(F.lit("b"), F.lit("s1")).alias("b"))
    after = t.orders.where(k != 5).select("o_orderkey", cell(F.when(k.isin(1, 2, 3), "new").otherwise(F.col("o_orderstatus")), F.when(k.isin(3, 4), "s2").otherwise("s1")).alias("a"), cell(F.lit("b"), F.lit("s1")).alias("b"))
    approvals = t.orders.where(k.isin(2, 3)).select("o_orderkey", F.lit("a").alias("field"), F.when(k == 2, "else").otherwise("new").alias("value"), F.lit("s2").alias("source"))
    return V.mutations(before, after, "o_orderkey", ["a", "b"], approvals)


PROBLEMS = ("stale_evidence", "target_drift", "unbound_evidence", "not_derived", "ambiguous_proposal", "no_evidence", "unknown_with_value", "unsupported_absence", "no_record")


@query("SELECT o_orderkey, CASE o_orderkey % 11 " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(PROBLEMS)) + " END AS problem FROM orders WHERE o_orderkey % 11 < 9")
def q_binding_problems(t: Tables) -> DataFrame:
    """Decisions that don't hold against the frozen items: one fault of each kind, and two kinds without any."""
    k, text = F.col("o_orderkey") % 11, lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    items = t.orders.select("o_orderkey", F.lit("cost").alias("field"), F.when(k == 4, text("v", "w")).otherwise(text("v")).alias("candidates"), text("E1", "E2").alias("refs"), F.lit(False).alias("absent"), F.when(k != 8, F.lit("r")).alias("production"))
    action = F.when(k == 4, "approve_proposal").when(k == 6, "accepted_unknown").when(k == 7, "confirmed_absent").when(k.isin(8, 9), "retain_current").otherwise("approve_explicit_value")
    value = F.when(k == 3, "x").when(k.isin(7, 8, 9), F.lit(None)).otherwise("v")
    decisions = t.orders.select("o_orderkey", F.when(k == 1, "category").otherwise("cost").alias("field"), action.alias("action"), value.alias("value"), F.when(k == 2, text("E1", "E9")).when(k == 5, text()).otherwise(text("E1")).alias("refs"), F.when(k == 0, "old").otherwise("now").alias("digest"))
    return V.binding_problems(decisions, items, "o_orderkey", F.lit("now"))


@query("SELECT c_custkey, field, count(o_orderkey) AS n_evidence, coalesce(array_to_string(list_sort(list(DISTINCT v) FILTER (v IS NOT NULL)), ','), '') AS vals, CASE WHEN count(v) = 0 THEN 'missing' WHEN count(DISTINCT v) = 1 THEN 'decision_ready' ELSE 'semantic_conflict' END AS status FROM (SELECT c_custkey, field, o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN CASE field WHEN 'priority' THEN o_orderpriority ELSE o_orderstatus END END AS v FROM customer CROSS JOIN (SELECT unnest(['priority', 'status']) AS field) LEFT JOIN orders ON o_custkey = c_custkey) GROUP BY 1, 2")
def q_review_packet(t: Tables) -> DataFrame:
    """One unit of review per record and field, with its evidence compared."""
    cells = F.array(F.struct(F.lit("priority").alias("field"), F.col("o_orderpriority").alias("value")), F.struct(F.lit("status").alias("field"), F.col("o_orderstatus").alias("value")))
    evidence = t.orders.select(F.col("o_custkey").alias("c_custkey"), F.when(F.col("o_orderstatus") == "P", "not_observed").otherwise("observed").alias("state"), F.inline(cells)).withColumn("proposed", F.col("value"))
    # what was proposed isn't told apart here: every value proposes itself
    out = V.review_packet(t.customer.select("c_custkey"), evidence, "c_custkey", ["priority", "status"])
    return out.select("c_custkey", "field", "n_evidence", F.array_join("values", ",").alias("vals"), "status")


@query("SELECT k, CASE k % 4 WHEN 0 THEN 'representation_conflict' WHEN 1 THEN 'numeric_conflict' WHEN 2 THEN 'semantic_conflict' ELSE 'decision_ready' END AS status FROM (SELECT c_custkey AS k FROM customer)")
def q_evidence_kinds(t: Tables) -> DataFrame:
    """Values that differ in writing only, in number, in meaning, or not at all."""
    k = F.col("c_custkey") % 4
    both = F.when(k == 0, F.array(F.lit("Gold "), F.lit("gold"))).when(k == 1, F.array(F.lit("3"), F.lit("4.5"))).when(k == 2, F.array(F.lit("3"), F.lit("gold"))).otherwise(F.array(F.lit("x"), F.lit("x")))
    evidence = t.customer.select(F.col("c_custkey").alias("k"), F.explode(both).alias("v"), F.lit("observed").alias("state"))
    return V.compare(evidence, ["k"], F.col("v"), F.lit("p")).select("k", "status")


@query("SELECT (SELECT count(*) FROM orders) AS evidence_rows, 5::BIGINT AS manifest_rows, (SELECT count(*) FROM nation) AS baseline_rows, intact, name FROM (VALUES (true, 'sealed'), (false, 'changed')) v(intact, name)")
def q_evidence_bundle(t: Tables) -> DataFrame:
    """Frozen evidence sealed with the manifest and the baseline; a changed part no longer fits the bundle's own digest."""
    evidence = V.frozen(t.orders, "o_custkey", [F.col("o_orderkey")], ["o_orderkey", "o_orderstatus"])
    sealed = V.bundle(evidence, t.region, t.nation)
    changed = sealed.withColumn("baseline_digest", F.lit("0"))
    both = V.bundle_intact(sealed).withColumn("name", F.lit("sealed")).union(V.bundle_intact(changed).withColumn("name", F.lit("changed")))
    return both.select("evidence_rows", "manifest_rows", "baseline_rows", "intact", "name")


#: A condition that holds, and what is made of it to fail: the pattern to replace, by what, and the parts that then have problems.
CONDITION = '{"type":"gold","operator":">=","value":5,"textZh":"x","machineEvaluable":true}'
FAULTS = [
    ("^.*$", "null", [("", "must be an object")]), ('"gold"', '" "', [(".type", "must be a text")]), ('"textZh":"x"', '"textEn":1', [(".textZh", "must be a text"), (".textEn", "must be a text if it is there")]),
    ('true', '"yes"', [(".machineEvaluable", "must be true or false")]), ('">=","value":5(.*)true', '"~"$1false', [(".operator", "unknown operator")]), ('">="', '"~"', [(".operator", "unknown operator"), (".operator", "needs a known operator")]),
    ('"operator":">=",', '', [(".operator", "needs a known operator")]), ('5', '"5"', [(".value", "must be a finite number")]), ('">=","value":5', '"!=","value":[1]', [(".value", "must be a text, number or truth")]),
    ('">=","value":5', '"in","value":["a",1]', [(".value", "must be a list of texts")]), ('">=","value":5', '"in","value":[]', [(".value", "must be a list of texts")]), ('">=","value":5', '"active","value":" "', [(".value", "must be a text")]),
    ('5(.*)true', '"any"$1false', []), ('">=","value":5', '"in","value":["a","b"]', []), ('">=","value":5', '"=","value":false', [])]
_FAULTY = " UNION ALL ".join(f"SELECT p_partkey, 'requirements[' || (p_size % 3) || ']{path}' AS path, '{says}' AS problem FROM part WHERE p_partkey % {len(FAULTS) + 1} = {i}" for i, (_, _, found) in enumerate(FAULTS) for path, says in found)


@query(f"{_FAULTY} UNION ALL SELECT p_partkey, 'requirements', 'must be a list' FROM part WHERE p_partkey % {len(FAULTS) + 1} = {len(FAULTS)}")
def q_requirement_problems(t: Tables) -> DataFrame:
    """Lists of conditions of which one has a fault, at another place in each, and texts that are no list."""
    k = F.col("p_partkey") % (len(FAULTS) + 1)
    bad = F.lit('{"no": "list"}')
    for i, (pattern, by, _) in enumerate(FAULTS):
        bad = F.when(k == i, F.regexp_replace(F.lit(CONDITION), pattern, by)).otherwise(bad)
    at = F.col("p_size") % 3
    listed = F.concat(F.lit("["), F.array_join(F.concat(F.array_repeat(F.lit(CONDITION), at.cast("int")), F.array(bad), F.array_repeat(F.lit(CONDITION), (2 - at).cast("int"))), ","), F.lit("]"))
    value = F.when(k == len(FAULTS), bad).otherwise(listed)
    return spread(t.part).select("p_partkey", F.inline(W.requirement_problems(value, "requirements")))


@query("""SELECT 'ready' AS path, 'ready while conflicts are open' AS problem WHERE (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') > 0 UNION ALL SELECT 'status', 'missing'
UNION ALL SELECT 'records.' || p_partkey, CASE WHEN p_size % 10 = 1 THEN 'not published' WHEN p_size % 10 = 2 THEN 'not in the normalised records' ELSE 'differs from the normalised record' END FROM part WHERE p_size % 10 IN (1, 2, 3)""")
def q_dataset_problems(t: Tables) -> DataFrame:
    """A dataset that says it is ready though conflicts are open, has no status, and is published with other records than the normalised ones; search columns may differ."""
    dataset = t._spark.range(1).select(F.lit(True).alias("ready"), F.lit(" ").alias("status"))
    conflicts = t.orders.select(F.when(F.col("o_orderstatus") == "O", "needs_review").otherwise("resolved").alias("resolution"))
    k = F.col("p_size") % 10
    published = t.part.where(k != 1).select("p_partkey", F.when(k == 3, F.concat("p_name", F.lit("!"))).otherwise(F.col("p_name")).alias("p_name"), "p_type", F.array("p_brand").alias("synonyms"))
    return W.dataset_problems(dataset, conflicts, t.part.where(k != 2).select("p_partkey", "p_name", "p_type"), published, "p_partkey", ["synonyms"])


@query("SELECT p_partkey, problem FROM (SELECT p_partkey, CASE p_partkey % 16 WHEN 1 THEN 'empty text' WHEN 3 THEN 'unknown category' WHEN 5 THEN 'not an amount' WHEN 7 THEN 'empty or unresolved text' WHEN 9 THEN 'not ordered windows' WHEN 11 THEN 'value[1].value: must be a finite number' WHEN 13 THEN 'not marked unknown' WHEN 15 THEN 'must be left out' END AS problem FROM part) WHERE problem IS NOT NULL")
def q_field_shapes(t: Tables) -> DataFrame:
    """A good and a bad value of each kind that a decision may give a field."""
    window = '{"start":{"stage":%d,"round":1},"end":{"stage":3,"round":2}}'
    good_bad = [("text", '"x"', '" "'), ("category", '"PROMO"', '"none"'), ("amount", "3.5", "-1"), ("effect", '"gain 3"', '"gain @Gold*100@"'), ("ranges", f"[{window % 2}]", f"[{window % 4}]"), ("requirements", f"[{CONDITION}]", f"[{CONDITION}, {CONDITION.replace('5', 'true')}]"), ("unknown", '{"status":"unknown"}', '{"status":"confirmed","value":1}'), ("omitted", None, "1")]
    k = (F.col("p_partkey") % 16 + 1).cast("int")
    kinds = F.array(*[F.lit(kind) for kind, _, _ in good_bad for _ in range(2)])
    values = F.array(*[F.lit(v).cast("string") for _, good, bad in good_bad for v in (good, bad)])
    return t.part.select("p_partkey", W.shape_problem(F.element_at(kinds, k), F.element_at(values, k), ("PROMO", "SMALL")).alias("problem")).where("problem is not null")


@query("""SELECT p_partkey, path, problem FROM part, (VALUES ('alternate', 'repeated'), ('name', 'placeholder'), ('sources.cost', 'no provenance'), ('name', 'no evidence')) v(path, problem)
WHERE CASE problem WHEN 'repeated' THEN p_size % 10 = 3 AND (SELECT count(*) FROM part p WHERE p.p_size = part.p_size) > 1 WHEN 'placeholder' THEN p_size % 10 = 4 WHEN 'no provenance' THEN p_size % 10 = 5 ELSE p_size % 10 IN (4, 6) END""")
def q_production_problems(t: Tables) -> DataFrame:
    """Repeated alternate ids, placeholder names, fields without provenance, names that their source doesn't show."""
    k = F.col("p_size") % 10
    source = F.struct(F.lit("s1").alias("source_id"), F.lit("official").alias("confidence"))
    entries = F.when(k == 5, F.create_map(F.lit("name"), source)).otherwise(F.create_map(F.lit("name"), source, F.lit("cost"), source))
    rows = t.part.select("p_partkey", F.when(k == 3, F.col("p_size")).otherwise(F.when(k < 3, F.col("p_partkey") + 1000)).alias("alternate"), F.when(k == 4, "TBD: to be checked").when(k == 6, "nowhere").otherwise(F.col("p_name")).alias("name"), entries.alias("sources"))
    return W.production_problems(rows, "p_partkey", "alternate", "name", "sources", ["name", "cost"], "(?i)TBD|placeholder", t.part.select(F.lit("s1").alias("source_id"), F.col("p_name").alias("name")))


@query("SELECT event_id, event_type AS field, 's' || (user_id % 3) AS source_id, 'stale_source' AS problem FROM events WHERE user_id % 3 > 0")
def q_stale_source(t: Tables) -> DataFrame:
    """Sources that say of themselves, by name or note, that they show a test version."""
    entries = t.events.select("event_id", F.col("event_type").alias("field"), F.concat(F.lit("s"), (F.col("user_id") % 3).cast("string")).alias("source_id"), F.lit("official").alias("confidence"), F.lit(None).cast("string").alias("locale"))
    kinds = [r[0] for r in t.events.select("event_type").distinct().collect()]  # a handful
    rows = [("s0", "official", ["en"], kinds, "live"), ("s1", "official", ["en"], kinds, "from the PBE"), ("s2", "official", ["en"], kinds, "http://x/pbe/1")]
    manifest = t._spark.createDataFrame(rows, "source_id string, confidence string, locales array<string>, use_for array<string>, note string")
    return W.provenance_problems(entries, manifest, "event_id", stale="(?i)pbe")


_RULES = [("patch", "empty"), ("records", "records of another patch"), ("categories", "not the categories in order"), ("interval", "not a whole positive number"), ("rightmost", "must be true"), ("claimed", "must be false"), ("tracks", "must be true or false"), ("observed", "must be seen"), ("milestones", "not the milestones"), ("milestones", "unknown effect"), ("model", "unknown model"), ("unknown_models", "not the unknown models")]


@query("SELECT r_name AS rules, path, problem FROM region, (VALUES " + ", ".join(map(str, _RULES)) + ") v(path, problem) WHERE r_regionkey % 2 = 1")
def q_rules_problems(t: Tables) -> DataFrame:
    """A rules dataset for each region, good and bad ones in turn, against the records' patch."""
    good = F.col("r_regionkey") % 2 == 0
    of = lambda a, b: F.when(good, F.lit(a)).otherwise(F.lit(b))
    listed = lambda *x: F.array(*map(F.lit, x))
    rules = t.region.select(
        "r_name", of("1.2", " ").alias("patch"), F.when(good, listed("a", "b")).otherwise(listed("b", "a")).alias("categories"), of(2.0, 1.5).alias("interval"), of(True, False).alias("rightmost"), of(False, True).alias("claimed"), F.when(good, False).alias("tracks"),
        of("seen", "guessed").alias("observed"), F.when(good, F.create_map(*map(F.lit, ("5", "y", "3", "x")))).otherwise(F.create_map(*map(F.lit, ("3", "x", "6", "z")))).alias("milestones"), of("equal", "other").alias("model"), F.when(good, listed("m", "n")).otherwise(listed("m")).alias("unknown_models"))
    records = t.part.select(F.lit("1.2").alias("patch"))
    names = [r[0] for r in t.region.select("r_name").collect()]  # one dataset each
    out = [W.rules_problems(rules.where(F.col("r_name") == n), records, ("a", "b"), (3, 5), ("x", "y"), ["interval"], ["rightmost"], "equal", ["claimed"], ["tracks"], {"observed": "seen"}, ("m", "n")).select(F.lit(n).alias("rules"), "path", "problem") for n in names]
    return W.all_of(*out)


@query("SELECT * FROM (VALUES ('groups', 'g2', 'unknown concept'), ('membership', '1', 'unknown concept'), ('metadata', 'b:patch', 'different'), ('metadata', 'patch', 'different'), ('metadata', 'records', 'different'), ('taxonomy', 'ASIA', 'repeated'), ('taxonomy', 'x', 'empty')) v(part, key, problem)")
def q_lexicon_problems(t: Tables) -> DataFrame:
    """A lexicon whose artifacts differ, whose taxonomy repeats a key, and which refers to concepts that aren't there."""
    spark = t._spark
    meta = "patch string, version string, digest string, records long"
    taxonomy = t.region.select(F.col("r_name").alias("key"), F.col("r_name").alias("label"))
    taxonomy = taxonomy.union(spark.createDataFrame([("ASIA", "again"), ("x", "")], "key string, label string"))
    groups = spark.createDataFrame([("g1", ["a"], ["ASIA"]), ("g2", ["b"], ["ATLANTIS", "EUROPE"])], "group string, aliases array<string>, concepts array<string>")
    membership = t.nation.select(F.col("n_nationkey").cast("string").alias("key"), F.when(F.col("n_nationkey") == 1, F.array(F.lit("ATLANTIS"))).otherwise(F.array(F.lit("EUROPE"))).alias("concepts"))
    return W.lexicon_problems(spark.createDataFrame([("1.2", "v", "d", 3)], meta), spark.createDataFrame([("1.1", "v", "d", 4)], meta), taxonomy, groups, membership, "1.2")


@query("""SELECT 'g' || p_partkey AS grp, problem FROM part, (VALUES (2, 'not_approved'), (3, 'not_in_draft'), (4, 'undecided'), (5, 'contradictory'), (5, 'no_reason'), (6, 'unknown_group'), (7, 'repeated'), (8, 'repeated_alias')) v(k, problem) WHERE p_partkey % 9 = k""")
def q_alias_decisions(t: Tables) -> DataFrame:
    """Decisions on each part's aliases: exact (full width and case apart), incomplete, beyond the draft, missing, contradictory, of no group, twice."""
    k, name = F.col("p_partkey") % 9, F.concat(F.lit("g"), F.col("p_partkey").cast("string")).alias("group")
    wide = F.translate("p_name", "abcdefghijklmnopqrstuvwxyz", "ａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ")
    groups = t.part.where(k != 6).select(name, F.array(F.upper("p_name"), "p_brand").alias("aliases"))
    approved = F.when(k == 2, F.array("p_name")).when(k == 3, F.array("p_name", "p_brand", "p_type")).when(k == 8, F.array("p_name", "p_brand", "p_brand")).otherwise(F.array(wide, "p_brand"))
    reject = F.when(k == 5, F.array(F.struct(F.col("p_brand").alias("alias"), F.lit("").alias("reason")))).otherwise(F.array().cast("array<struct<alias:string,reason:string>>"))
    decisions = t.part.where(k != 4).select(name, approved.alias("approved"), reject.alias("rejected"), F.explode(F.when(k == 7, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    return C.alias_problems(groups, decisions.drop("col")).withColumnRenamed("group", "grp")


@query("SELECT 'digest' AS \"column\", 'stale' AS problem")
def q_stale_review(t: Tables) -> DataFrame:
    """A review against an earlier digest of the input must be repeated."""
    state = lambda df: W.digest(df, ["p_partkey", "p_size"]).select(F.lit("1.2").alias("patch"), F.lit("v3").alias("version"), "digest")
    return C.stale_problems(state(t.part), state(t.part.withColumn("p_size", F.col("p_size") * 2)))


@query("SELECT 'parts with another size' AS name, 'different' AS problem UNION ALL SELECT 'regions', (SELECT count(*) FROM region) || ' rows, not 7'")
def q_publication_problems(t: Tables) -> DataFrame:
    """Published tables against what they were made from, and fixed numbers of rows."""
    part = t.part.select("p_partkey", "p_size")
    pairs = [("parts", part, part.repartition(2)), ("parts with another size", part, part.withColumn("p_size", F.col("p_size") + 1))]
    return W.publication_problems(pairs, [("nations", t.nation, 25), ("regions", t.region, 7)])


def order_evidence(t: Tables) -> DataFrame:
    """Orders as evidence of what their customers' reviews decide."""
    return t.orders.select(F.format_string("O%d", "o_orderkey").alias("evidence_id"), F.col("o_custkey").cast("string").alias("review"), F.col("o_orderpriority").alias("source_id"), F.col("o_orderstatus").alias("value"))


SEALED = ("evidence_id", "source_id", "value")


@query("SELECT o_custkey::VARCHAR AS review, CASE WHEN o_custkey % 50 = 7 THEN 'missing' ELSE 'changed' END AS problem FROM orders WHERE o_custkey % 50 = 7 OR (o_orderkey % 97 = 0 AND o_orderstatus <> 'X') GROUP BY ALL")
def q_sealed_differences(t: Tables) -> DataFrame:
    """Which reviews no longer have the evidence that was sealed: some lost all of it, in others a value changed."""
    rows = order_evidence(t)
    now = rows.where(F.col("review").cast("long") % 50 != 7).withColumn("value", F.when(F.substring("evidence_id", 2, 20).cast("long") % 97 == 0, "X").otherwise(F.col("value")))
    return E.differences(E.tree(rows, "review", SEALED), now, "review", SEALED)


@query("""WITH r AS (SELECT review, row_number() OVER (ORDER BY review) - 1 AS node, review::BIGINT % 10 = 3 AS moved FROM (SELECT DISTINCT o_custkey::VARCHAR AS review FROM orders)),
levels AS (SELECT l AS level FROM range(0, 9) t(l) WHERE l <= (SELECT ceil(ln(count(*)) / ln(16)) FROM r))
SELECT level::INT AS level, count(DISTINCT node // (16 ** level)::BIGINT) AS nodes, count(DISTINCT node // (16 ** level)::BIGINT) FILTER (moved) AS renewed, true AS as_anew FROM r, levels GROUP BY level""")
def q_resealed(t: Tables) -> DataFrame:
    """Overrides leave evidence and a source, and only the paths of their reviews are hashed again: nodes of each level, those renewed, and whether all are as if sealed anew."""
    rows, manifest = order_evidence(t), t.orders.select(F.col("o_orderpriority").alias("source_id"), F.lit("B").alias("tier")).distinct()
    nodes = saved(E.tree(rows, "review", SEALED), "tree")
    reviews = rows.select("review").distinct().where(F.col("review").cast("long") % 10 == 3)
    more, sources = E.override_evidence(rows, manifest, reviews.withColumn("value", F.lit("F")), "review", F.col("review"), {"source_id": "manual", "tier": "E"})
    again = saved(E.resealed(nodes, more.join(reviews, "review", "left_semi"), "review", SEALED), "tree")
    anew = E.tree(more, "review", SEALED)
    both = again.join(nodes.select("level", "node", F.col("digest").alias("old")), ["level", "node"]).join(anew.select("level", "node", F.col("digest").alias("anew")), ["level", "node"], "full_outer")
    return both.groupBy("level").agg(F.count("*").alias("nodes"), F.count_if(F.col("digest") != F.col("old")).alias("renewed"), F.coalesce(F.min(F.col("digest") == F.col("anew")), F.lit(False)).alias("as_anew"))
