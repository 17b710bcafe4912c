"""Counts, histograms, tagging, decisions, validation and provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.functions.conditions import knowledge_state
from quillon.operators import audit as A
from quillon.operators import concepts as C
from quillon.operators import provenance as V
from quillon.operators import rules as U
from quillon.operators import terms as M
from quillon.operators import validate as W
from quillon.plans.registry import Tables, norm, query

TYPES = ("STANDARD", "MEDIUM", "ECONOMY", "PROMO", "LARGE", "SMALL", "UNSEEN")


@query(f"SELECT v AS p_type, (SELECT count(*) FROM part WHERE p_type = v) AS n, (i - 1)::INT AS position FROM (SELECT unnest({list(TYPES)}) AS v, generate_subscripts({list(TYPES)}, 1) AS i)")
def q_counts_zero_fill(t: Tables) -> DataFrame:
    return A.counts_with_zeros(t.part, F.col("p_type"), TYPES, "p_type").withColumn("position", F.col("position").cast("int"))


@query("WITH w AS (SELECT user_id, min(ts) AS a FROM events GROUP BY 1) SELECT h AS first_hour, (SELECT count(*) FROM w WHERE hour(a) = h) AS n FROM range(0, 24) r(h)")
def q_counts_first_window(t: Tables) -> DataFrame:
    first = t.events.groupBy("user_id").agg(F.min("ts").alias("a"))
    return A.counts_with_zeros(first, F.hour("a").cast("long"), list(range(24)), "first_hour").drop("position")


@query("SELECT count(*) AS rows, count(*) FILTER (text <> '') AS with_text, count(*) FILTER (lang = 'de') AS german, count(*) FILTER (n_chars > 2000) AS long FROM documents")
def q_coverage(t: Tables) -> DataFrame:
    return A.coverage(t.documents, with_text=A.non_empty("text"), german=F.col("lang") == "de", long=F.col("n_chars") > 2000)


@query("SELECT (SELECT count(*) FROM documents) + greatest(0, (SELECT count(*) FROM benchmark) - (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels))) AS least")
def q_lower_bound(t: Tables) -> DataFrame:
    unlabelled = t.documents.join(t.labels, "doc_id", "left_anti").agg(F.count("*").alias("u"))
    sums = t.documents.agg(F.count("*").alias("k")).crossJoin(unlabelled).crossJoin(t.benchmark.agg(F.count("*").alias("i")))
    return sums.select(A.lower_bound(F.col("k"), F.col("u"), F.col("i")).alias("least"))


def judged(t: Tables) -> DataFrame:
    """Documents with labels as knowledge: unlabelled is unknown or missing, a toxic 0 is a confirmed null."""
    return t.documents.join(t.labels, "doc_id", "left")


@query("""WITH d AS (SELECT * FROM documents LEFT JOIN labels USING (doc_id)), x AS (SELECT 'quality' AS field, CASE WHEN quality = 1 THEN 'confirmed_value' WHEN quality = 0 THEN 'confirmed_null' WHEN lang = 'en' THEN 'unknown' WHEN lang = 'de' THEN 'legacy_value' WHEN lang = 'fr' THEN 'legacy_null' ELSE 'unknown' END AS state FROM d
UNION ALL SELECT 'toxic', CASE WHEN toxic = 1 THEN 'confirmed_true' WHEN toxic = 0 THEN 'confirmed_false' WHEN lang = 'en' THEN 'unknown' WHEN n_chars > 2000 THEN 'legacy_true' ELSE 'legacy_false' END FROM d),
b AS (SELECT 'quality' AS field, unnest(['confirmed_value', 'confirmed_null', 'unknown', 'legacy_value', 'legacy_null']) AS state UNION ALL SELECT 'toxic', unnest(['confirmed_true', 'confirmed_false', 'unknown', 'legacy_true', 'legacy_false']))
SELECT field, state, (SELECT count(*) FROM x WHERE x.field = b.field AND x.state = b.state) AS n FROM b""")
def q_knowledge_hist(t: Tables) -> DataFrame:
    """Five buckets a field: confirmed by label, unknown by status or because it isn't there, or a plain older value."""
    lang = F.col("lang")
    quality = knowledge_state(F.when(F.col("quality").isNotNull(), "confirmed").when(lang == "en", "unknown"), F.nullif(F.col("quality"), F.lit(0)), F.when(lang == "de", F.col("n_chars")), lang.isin("de", "fr"))
    toxic = knowledge_state(F.when(F.col("toxic").isNotNull(), "confirmed"), F.col("toxic") == 1, F.when(lang != "en", F.col("n_chars") > 2000), flag=True)
    return A.knowledge_histogram(judged(t), {"quality": quality, "toxic": toxic}, flags=("toxic",))


@query("SELECT field, confidence, count(*) AS n FROM (SELECT 'text' AS field, CASE WHEN lang = 'en' THEN 'official' ELSE 'observed' END AS confidence FROM documents UNION ALL SELECT 'source', CASE WHEN length(source) = 4 THEN 'official' ELSE 'unverified' END FROM documents) GROUP BY 1, 2")
def q_confidence_hist(t: Tables) -> DataFrame:
    entry = lambda c: F.struct(c.alias("confidence"))
    sources = F.create_map(F.lit("text"), entry(F.when(F.col("lang") == "en", "official").otherwise("observed")), F.lit("source"), entry(F.when(F.length("source") == 4, "official").otherwise("unverified")))
    return A.map_histogram(t.documents, sources, "confidence")


@query("SELECT criterion, met, CASE WHEN bool_and(met) OVER () THEN 'ready' ELSE 'blocked' END AS verdict FROM (SELECT 'has_rows' AS criterion, count(*) > 0 AS met FROM documents UNION ALL SELECT 'all_labelled', count(*) = (SELECT count(*) FROM labels) FROM documents UNION ALL SELECT 'no_empty', count(*) FILTER (text = '') = 0 FROM documents)")
def q_verdict(t: Tables) -> DataFrame:
    sums = t.documents.agg(F.count("*").alias("n"), F.count_if(F.col("text") == "").alias("empty")).crossJoin(t.labels.agg(F.count("*").alias("labels")))
    return A.verdict(sums, {"has_rows": F.col("n") > 0, "all_labelled": F.col("n") == F.col("labels"), "no_empty": F.col("empty") == 0})


ALIASES = ("licensed", "all rights reserved", "que", "never there")


@query("SELECT term, n FROM (" + " UNION ALL ".join(f"SELECT '{a}' AS term, count(*) FILTER (contains({norm('text')}, '{a}')) AS n FROM documents" for a in ALIASES) + ")")
def q_alias_audit(t: Tables) -> DataFrame:
    return A.occurrences(t.documents, F.col("text"), ALIASES)


@query(f"SELECT term, doc_id, field FROM (SELECT doc_id, 'text' AS field, {norm('text')} AS f FROM documents UNION ALL SELECT doc_id, 'source', {norm('source')} FROM documents), (SELECT unnest({[*ALIASES, 'src3']}) AS term) WHERE contains(f, term)")
def q_alias_list(t: Tables) -> DataFrame:
    """Where each alias occurs, besides how often."""
    return A.occurrence_list(t.documents, "doc_id", {"text": F.col("text"), "source": F.col("source")}, (*ALIASES, "src3"))


@query(f"WITH w AS (SELECT DISTINCT unnest(string_split({norm('text')}, ' ')) AS term FROM benchmark), t AS (SELECT term FROM w WHERE length(term) >= 4 UNION SELECT DISTINCT {norm('p_name')} FROM part), f AS (SELECT {norm('text')} AS f FROM documents) SELECT term, count(f) AS n FROM t LEFT JOIN f ON contains(f, term) GROUP BY term")
def q_alias_audit_many(t: Tables) -> DataFrame:
    """How many documents hold each of a large list of terms, all of them found in one pass."""
    words = t.benchmark.select(F.explode(T.tokens(F.col("text"))).alias("term")).where("char_length(term) >= 4")
    terms = M.listed(words.unionByName(t.part.select(T.normalize(F.col("p_name")).alias("term"))))
    return A.occurrences(t.documents, F.col("text"), terms)


@query("SELECT count(*) AS records, count(*) FILTER (p_size > 30) AS special, count(DISTINCT p_type) FILTER (p_size > 30) AS special_categories FROM part")
def q_rules_summary(t: Tables) -> DataFrame:
    return A.rules_summary(t.part.withColumn("special", F.col("p_size") > 30), "special", "p_type")


def rules() -> tuple[C.Rule, ...]:
    """Rules of all kinds: plain, flagged, and guarded by record or by field."""
    return (C.Rule("licence", "(?i)licen[sc]ed? under"), C.Rule("licence", "All rights reserved", "needs_review", "wording"), C.Rule("contact", r"[\w.]+@[\w.]+", "needs_review", "personal"), C.Rule("shout", "[A-Z]{4,}!!"), C.Rule("german", "und", records=F.col("lang") == "de"), C.Rule("source_zero", "^src0$", fields=F.col("field") == "source"))


_TAGS = [("licence", "(?i)licen[sc]ed? under", "high", "NULL", "true"), ("licence", "All rights reserved", "needs_review", "'wording'", "true"), ("contact", r"[\w.]+@[\w.]+", "needs_review", "'personal'", "true"), ("shout", "[A-Z]{4,}!!", "high", "NULL", "true"), ("german", "und", "high", "NULL", "lang = 'de'"), ("source_zero", "^src0$", "high", "NULL", "field = 'source'")]
FIELDS = "f AS (SELECT doc_id, lang, 'text' AS field, text FROM documents WHERE text <> '' UNION ALL SELECT doc_id, lang, 'source', source FROM documents WHERE source <> '')"
TAGS = "tags AS (" + " UNION ALL ".join(f"SELECT doc_id, field, {i} AS rule, '{c}' AS concept, '{conf}' AS confidence, {flag} AS flag, regexp_extract(text, '({p})', 1) AS evidence FROM f WHERE regexp_matches(text, '{p}') AND {guard}" for i, (c, p, conf, flag, guard) in enumerate(_TAGS)) + ")"
ASSIGNED = "asg AS (SELECT doc_id, concept, arg_min(confidence, (rule, field)) AS confidence FROM tags GROUP BY 1, 2)"


def fields(t: Tables) -> DataFrame:
    return C.unpivot_fields(t.documents, "doc_id", {"text": F.col("text"), "source": F.col("source")}, carry=("lang",))


def tags(t: Tables) -> DataFrame:
    return C.tag(fields(t), "doc_id", rules())


@query("SELECT doc_id, 'text' AS field, NULL::INT AS position, text FROM documents WHERE text <> '' UNION ALL SELECT doc_id, 'words[' || i || ']', i::INT, w FROM (SELECT doc_id, unnest(string_split(source, 'c')) AS w, generate_subscripts(string_split(source, 'c'), 1) - 1 AS i FROM documents) WHERE w <> ''")
def q_field_unpivot(t: Tables) -> DataFrame:
    return C.unpivot_fields(t.documents, "doc_id", {"text": F.col("text")}, {"words": F.split("source", "c")})


@query(f"WITH {FIELDS}, {TAGS} SELECT doc_id, field, concept, confidence, flag, evidence FROM tags")
def q_tag_rules(t: Tables) -> DataFrame:
    return tags(t).select("doc_id", "field", "concept", "confidence", "flag", "evidence")


@query(f"WITH {FIELDS}, {TAGS}, {ASSIGNED} SELECT * FROM asg")
def q_assignments(t: Tables) -> DataFrame:
    return C.assignments(tags(t), "doc_id").select("doc_id", "concept", "confidence")


@query(f"WITH {FIELDS}, {TAGS}, {ASSIGNED} SELECT c AS concept, (SELECT count(*) FROM asg WHERE concept = c) AS n FROM (SELECT unnest(['licence', 'contact', 'shout', 'german', 'unused']) AS c)")
def q_assignments_per_concept(t: Tables) -> DataFrame:
    return A.counts_with_zeros(C.assignments(tags(t), "doc_id"), F.col("concept"), ("licence", "contact", "shout", "german", "unused"), "concept").drop("position")


@query(f"WITH {FIELDS} SELECT doc_id, field, 'legal' AS risk FROM f WHERE regexp_matches(text, '(?i)licen[sc]e') UNION ALL SELECT doc_id, field, 'numbers' FROM f WHERE regexp_matches(text, '[0-9]{{8,}}')")
def q_ambiguity_guards(t: Tables) -> DataFrame:
    return C.guards(fields(t), "doc_id", {"legal": "(?i)licen[sc]e", "numbers": "[0-9]{8,}"})


@query("SELECT lower(p_name) AS alias, array_to_string(list_sort(list(DISTINCT p_type)), ',') AS groups FROM part GROUP BY 1 HAVING count(DISTINCT p_type) > 1")
def q_alias_collisions(t: Tables) -> DataFrame:
    return C.alias_collisions(t.part, F.lower("p_name"), "p_type").select("alias", F.array_join("groups", ",").alias("groups"))


DECISIONS = "dec AS (SELECT doc_id, CASE WHEN doc_id % 6 = 5 THEN 'ghost' ELSE concept END AS concept, CASE doc_id % 4 WHEN 0 THEN 'approved' WHEN 1 THEN 'modified' WHEN 2 THEN 'rejected' ELSE 'maybe' END AS action, CASE WHEN doc_id % 8 = 1 THEN 'replaced' END AS replacement FROM asg WHERE doc_id % 10 <> 9)"


def decisions(assigned: DataFrame) -> DataFrame:
    """Made-up decisions on most assignments, some of them faulty."""
    k = F.col("doc_id")
    action = F.when(k % 4 == 0, "approved").when(k % 4 == 1, "modified").when(k % 4 == 2, "rejected").otherwise("maybe")
    return assigned.where(k % 10 != 9).select("doc_id", F.when(k % 6 == 5, "ghost").otherwise(F.col("concept")).alias("concept"), action.alias("action"), F.when(k % 8 == 1, "replaced").alias("replacement"))


@query(f"WITH {FIELDS}, {TAGS}, {ASSIGNED}, {DECISIONS} SELECT DISTINCT a.doc_id, CASE WHEN action = 'modified' THEN replacement ELSE a.concept END AS concept FROM asg a JOIN dec d ON a.doc_id = d.doc_id AND a.concept = d.concept WHERE action = 'approved' OR (action = 'modified' AND replacement IS NOT NULL)")
def q_overlay_effective(t: Tables) -> DataFrame:
    assigned = C.assignments(tags(t), "doc_id")
    return C.effective(assigned, decisions(assigned), "doc_id")


@query(f"""WITH {FIELDS}, {TAGS}, {ASSIGNED}, {DECISIONS}, d AS (SELECT doc_id, concept, count(*) AS n, min(action) AS a, min(replacement) AS r FROM dec GROUP BY 1, 2), b AS (SELECT coalesce(g.doc_id, d.doc_id) AS doc_id, coalesce(g.concept, d.concept) AS concept, g.doc_id AS g, n, a, r FROM asg g FULL JOIN d ON g.doc_id = d.doc_id AND g.concept = d.concept)
SELECT doc_id, concept, 'undecided' AS problem FROM b WHERE n IS NULL UNION ALL SELECT doc_id, concept, 'stale' FROM b WHERE g IS NULL UNION ALL SELECT doc_id, concept, 'repeated' FROM b WHERE n > 1 UNION ALL SELECT doc_id, concept, 'unknown_action' FROM b WHERE n IS NOT NULL AND a NOT IN ('approved', 'rejected', 'modified') UNION ALL SELECT doc_id, concept, 'no_replacement' FROM b WHERE a = 'modified' AND r IS NULL""")
def q_overlay_violations(t: Tables) -> DataFrame:
    assigned = C.assignments(tags(t), "doc_id")
    return C.overlay_violations(assigned, decisions(assigned), "doc_id")


@query(f"""WITH {FIELDS}, {TAGS}, {ASSIGNED}, {DECISIONS}, b AS (SELECT g.doc_id AS g, d.doc_id AS d, action FROM asg g FULL JOIN dec d ON g.doc_id = d.doc_id AND g.concept = d.concept)
SELECT count(g) AS generated, count(d) AS decided, count(*) FILTER (g IS NOT NULL AND action = 'approved') AS approved, count(*) FILTER (g IS NOT NULL AND action = 'rejected') AS rejected, count(*) FILTER (g IS NOT NULL AND action = 'modified') AS modified, count(*) FILTER (d IS NULL) AS unreviewed, count(*) FILTER (g IS NULL) AS stale FROM b""")
def q_review_summary(t: Tables) -> DataFrame:
    assigned = C.assignments(tags(t), "doc_id")
    return A.decision_summary(assigned, decisions(assigned), ["doc_id", "concept"])


@query(f"WITH {FIELDS}, {TAGS}, {ASSIGNED} SELECT doc_id, coalesce((SELECT string_agg(concept, ',' ORDER BY concept) FROM asg WHERE asg.doc_id = documents.doc_id), '') AS concepts FROM documents")
def q_materialise(t: Tables) -> DataFrame:
    done = C.materialise(t.documents.select("doc_id"), C.assignments(tags(t), "doc_id"), "doc_id")
    return done.select("doc_id", F.array_join("concepts", ",").alias("concepts"))


@query(f"WITH {FIELDS}, {TAGS}, {ASSIGNED} SELECT doc_id, 'different_concepts' AS problem FROM asg GROUP BY 1 HAVING bool_or(concept = 'shout') UNION ALL SELECT DISTINCT doc_id, 'missing_membership' FROM asg WHERE doc_id NOT IN (SELECT doc_id FROM asg WHERE concept = 'shout') AND doc_id IN (SELECT doc_id FROM documents WHERE lang = 'fr')")
def q_compat_gate(t: Tables) -> DataFrame:
    assigned = C.assignments(tags(t), "doc_id")
    published = C.materialise(t.documents.select("doc_id", "lang"), assigned, "doc_id")
    lexicon = published.where("size(concepts) > 0 and (lang <> 'fr' or array_contains(concepts, 'shout'))").select("doc_id", F.filter("concepts", lambda c: c != "shout").alias("concepts"))
    return C.compatibility(published, lexicon, "doc_id")


@query("""SELECT c_custkey, 'c_acctbal' AS path, 'negative' AS problem FROM customer WHERE c_acctbal < 0 UNION ALL SELECT c_custkey, 'c_mktsegment', 'not an allowed value' FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')""")
def q_validate_errors(t: Tables) -> DataFrame:
    checks = [("c_acctbal", F.col("c_acctbal") >= 0, "negative"), W.required("c_name"), W.allowed("c_mktsegment", ("BUILDING", "MACHINERY"))]
    return W.all_of(W.errors(t.customer, "c_custkey", checks), W.repeated(t.customer, "c_custkey"))


@query("SELECT l_orderkey, 'l_partkey' AS path, l_partkey::VARCHAR AS value FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_type <> 'PROMO') UNION ALL SELECT l_orderkey, 'l_suppkey', l_suppkey::VARCHAR FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)")
def q_dangling_refs(t: Tables) -> DataFrame:
    return W.all_of(W.dangling(t.lineitem, "l_partkey", t.part.where("p_type <> 'PROMO'"), "p_partkey", "l_orderkey"), W.dangling(t.lineitem, "l_suppkey", t.supplier.where("s_acctbal > 0"), "s_suppkey", "l_orderkey"))


@query("""SELECT event_id, field, source_id, problem FROM (SELECT event_id, event_type AS field, 'u' || user_id % 9 AS source_id, user_id % 9 AS u, value FROM events) e, (SELECT unnest(['unknown_source', 'confidence_drift', 'locale_mismatch', 'use_not_allowed']) AS problem) WHERE CASE problem WHEN 'unknown_source' THEN u >= 5 WHEN 'confidence_drift' THEN u < 5 AND (value > 30) <> (u % 2 = 0) WHEN 'locale_mismatch' THEN u < 5 AND u = 3 WHEN 'use_not_allowed' THEN u < 5 AND field NOT IN ('click', 'view', 'error') END""")
def q_provenance_problems(t: Tables) -> DataFrame:
    u = F.col("user_id") % 9
    entries = t.events.select("event_id", F.col("event_type").alias("field"), F.concat(F.lit("u"), u.cast("string")).alias("source_id"), F.when(F.col("value") > 30, "official").otherwise("observed").alias("confidence"), F.when(u == 3, "zh").otherwise("en").alias("locale"))
    rows = [(f"u{i}", "official" if i % 2 == 0 else "observed", ["en"], ["click", "view", "error"]) for i in range(5)]
    manifest = t._spark.createDataFrame(rows, "source_id string, confidence string, locales array<string>, use_for array<string>")
    return W.provenance_problems(entries, manifest, "event_id")


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY floor(value / 10), event_id % 3 = 0, event_id) AS n FROM events) WHERE n = 1")
def q_provenance_pick(t: Tables) -> DataFrame:
    evidence = t.events.select("user_id", "event_type", "event_id", "value", F.floor(F.col("value") / 10).alias("tier"), F.when(F.col("event_id") % 3 == 0, "multi").otherwise("en").alias("locale"))
    return V.pick(evidence, ["user_id", "event_type"], "tier", "locale", "event_id").select("user_id", "event_type", "event_id", "value")


@query("""WITH v AS (SELECT o_custkey, list_sort(list(DISTINCT o_orderpriority) FILTER (o_orderstatus <> 'F')) AS vs, list_sort(list(DISTINCT o_orderkey % 2) FILTER (o_orderstatus <> 'F')) AS ps FROM orders GROUP BY 1)
SELECT o_custkey, CASE WHEN coalesce(len(vs), 0) = 0 THEN 'missing' WHEN len(vs) = 1 AND len(ps) <= 1 THEN 'decision_ready' WHEN len(vs) = 1 THEN 'target_selection' ELSE 'semantic_conflict' END AS status, coalesce(array_to_string(vs, ','), '') AS candidates FROM v""")
def q_evidence_compare(t: Tables) -> DataFrame:
    evidence = t.orders.withColumn("state", F.when(F.col("o_orderstatus") == "F", "not_observed").otherwise("observed"))
    found = V.compare(evidence, ["o_custkey"], F.col("o_orderpriority"), (F.col("o_orderkey") % 2).cast("string"))
    return found.select("o_custkey", "status", F.array_join("values", ",").alias("candidates"))


@query("WITH p AS (SELECT user_id, event_type, count(*) FILTER (value > 100) AS n FROM events WHERE event_type IN ('click', 'view', 'purchase') GROUP BY 1, 2) SELECT user_id, count(*) FILTER (n = 1) AS decided, count(*) FILTER (n = 1) = 3 AS ready FROM p GROUP BY 1")
def q_readiness(t: Tables) -> DataFrame:
    return V.readiness(t.events, "user_id", "event_type", ("click", "view", "purchase"), F.col("value") > 100)


@query("SELECT o_custkey, o_orderstatus AS field, o_orderpriority AS proposition, string_agg(DISTINCT o_orderstatus || ':' || (o_orderkey % 2), ',' ORDER BY o_orderstatus || ':' || (o_orderkey % 2)) AS reasons FROM orders GROUP BY 1, 2, 3")
def q_consolidate(t: Tables) -> DataFrame:
    reasons = F.array(F.concat_ws(":", "o_orderstatus", (F.col("o_orderkey") % 2).cast("string")))
    return V.consolidate(t.orders, "o_custkey", reasons, F.substring_index("reason", ":", 1), F.col("o_orderpriority")).withColumn("reasons", F.array_join("reasons", ","))


@query("SELECT user_id, count(*) FILTER (event_type = 'click') > 0 AS click_known, count(*) FILTER (event_type = 'signup' AND value > 200) > 0 AS signup_known FROM events WHERE event_type <> 'signup' OR value > 200 GROUP BY 1")
def q_assemble(t: Tables) -> DataFrame:
    decided = t.events.where("event_type <> 'signup' or value > 200").withColumn("v", F.col("value").cast("string"))
    out = V.assemble(decided, "user_id", "event_type", "v", ("click", "signup"))
    return out.select("user_id", (F.col("click.status") == "confirmed").alias("click_known"), (F.col("signup.status") == "confirmed").alias("signup_known"))


@query("SELECT coalesce(c.k, a.k) AS k, CASE WHEN a.k IS NULL THEN 'unapproved' WHEN c.k IS NULL THEN 'pending' WHEN c.v = a.v THEN 'fulfilled' ELSE 'wrong_value' END AS status FROM (SELECT c_custkey AS k, c_nationkey AS v FROM customer WHERE c_acctbal > 0) c FULL JOIN (SELECT s_suppkey AS k, s_nationkey AS v FROM supplier) a ON a.k = c.k")
def q_fulfilment(t: Tables) -> DataFrame:
    changes = t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("new"))
    return V.fulfilment(changes, t.supplier.select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("value")), ["k"])


@query("""SELECT k, problem FROM (SELECT coalesce(e.k, d.k) AS k, e.k AS x, d.* EXCLUDE (k) FROM (SELECT DISTINCT c_custkey AS k FROM customer WHERE c_custkey % 3 <> 0) e FULL JOIN (SELECT o_custkey AS k, count(*) AS n, min(o_orderstatus) AS a FROM orders GROUP BY 1) d ON d.k = e.k), (SELECT unnest(['missing', 'orphan', 'repeated', 'unknown_action']) AS problem)
WHERE CASE problem WHEN 'missing' THEN n IS NULL WHEN 'orphan' THEN x IS NULL WHEN 'repeated' THEN n > 1 ELSE n IS NOT NULL AND a NOT IN ('F', 'O') END""")
def q_decision_problems(t: Tables) -> DataFrame:
    made = t.orders.select(F.col("o_custkey").alias("k"), F.col("o_orderstatus").alias("action"), F.array("o_orderkey").alias("evidence"))
    return V.decision_problems(made, t.customer.where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("k")), "k", ("F", "O"))


@query("SELECT o_custkey || '-E' || lpad(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::VARCHAR, 2, '0') AS evidence_id, o_custkey, o_orderkey, o_orderstatus FROM orders")
def q_freeze_evidence(t: Tables) -> DataFrame:
    return V.frozen(t.orders, "o_custkey", [F.col("o_orderkey")], ["o_orderkey", "o_orderstatus"]).select("evidence_id", "o_custkey", "o_orderkey", "o_orderstatus")


@query("SELECT max(ts) AS latest FROM events")
def q_latest(t: Tables) -> DataFrame:
    return A.latest(t.events, F.col("ts").cast("string")).select(F.col("latest").cast("timestamp_ntz").alias("latest"))


@query("SELECT 'negative_balance' AS kind, 'high' AS severity, true AS blocks, (SELECT count(*) FROM customer WHERE c_acctbal < 0) AS n, CASE WHEN (SELECT count(*) FROM customer WHERE c_acctbal < 0) > 0 THEN 'needs_review' ELSE 'resolved' END AS resolution UNION ALL SELECT 'no_segment', 'low', false, 0, 'resolved'")
def q_conflict_ledger(t: Tables) -> DataFrame:
    sums = t.customer.agg(F.count_if(F.col("c_acctbal") < 0).alias("neg"), F.count_if(F.col("c_mktsegment").isNull()).alias("seg"))
    return A.ledger(sums, [("negative_balance", "high", True, F.col("neg")), ("no_segment", "low", False, F.col("seg"))])


@query("SELECT p_partkey, p_size > 30 OR p_type = 'PROMO' OR p_retailprice > 990 AS has_special_rules, CASE WHEN p_size > 20 THEN 'official' ELSE 'observed' END AS p_name_confidence FROM part")
def q_rule_rows(t: Tables) -> DataFrame:
    sources = F.create_map(F.lit("p_name"), F.struct(F.when(F.col("p_size") > 20, "official").otherwise("observed").alias("confidence")))
    conditions = F.when(F.col("p_size") > 30, F.array("p_size")).otherwise(F.array().cast("array<int>"))
    out = U.rule_rows(t.part, conditions, F.col("p_type") == "PROMO", F.when(F.col("p_retailprice") > 990, 3), F.lit(None), sources, ["p_name"])
    return out.select("p_partkey", "has_special_rules", "p_name_confidence")


@query("SELECT r_regionkey::INT AS level, r_name AS effect, CASE r_name WHEN 'ASIA' THEN 'the east' END AS label FROM region")
def q_milestones(t: Tables) -> DataFrame:
    rules = t.region.agg(F.map_from_entries(F.collect_list(F.struct(F.col("r_regionkey").cast("string"), "r_name"))).alias("m"))
    return U.milestones(rules, "m", {"ASIA": "the east"})


@query("SELECT 'nations' AS id, count(*) || ' nations' AS text, 'official' AS confidence FROM nation UNION ALL SELECT 'top', 'up to ' || max(n_regionkey), 'observed' FROM nation")
def q_templated_rules(t: Tables) -> DataFrame:
    sums = t.nation.agg(F.count("*").alias("n"), F.max("n_regionkey").alias("top"))
    return U.templated(sums, [("nations", "%d nations", "official", [F.col("n")]), ("top", "up to %d", "observed", [F.col("top")])])


@query("SELECT doc_id, CASE WHEN lang = 'de' THEN 'confirmed' WHEN doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN 'confirmed' ELSE 'unknown' END AS status FROM documents")
def q_confirmed_elsewhere(t: Tables) -> DataFrame:
    own = t.documents.select("doc_id", F.when(F.col("lang") == "de", False).alias("once"))
    other = t.labels.select("doc_id", (F.col("toxic") == 1).alias("once"))
    return U.confirmed_elsewhere(own, other, "doc_id", "once").select("doc_id", F.col("once.status").alias("status"))


@query("SELECT (SELECT count(*) FROM part) AS rows, true AS same, false AS other")
def q_regeneration_check(t: Tables) -> DataFrame:
    cols = ["p_partkey", "p_name", "p_size"]
    a, b = W.digest(t.part, cols), W.digest(t.part.orderBy(F.desc("p_partkey")), cols).select(F.col("digest").alias("d2"))
    c = W.digest(t.part.withColumn("p_size", F.col("p_size") + 1), cols).select(F.col("digest").alias("d3"))
    return a.crossJoin(b).crossJoin(c).select("rows", (F.col("digest") == F.col("d2")).alias("same"), (F.col("digest") == F.col("d3")).alias("other"))

