"""Pool filters, conditions, probabilities and form inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions import conditions as C
from quillon.functions import intervals as I
from quillon.functions import text as T
from quillon.operators import pool as P
from quillon.operators import ranges as N
from quillon.operators import probability as Pr
from quillon.plans.registry import Tables, norm, query

PART = P.Columns(id="p_partkey", category="p_type", cost="p_retailprice", least_gold="least")
DOC = P.Columns(id="doc_id", category="lang", cost="n_chars")


@query(f"SELECT doc_id, {norm('text')} AS form FROM documents")
def q_normalize(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.normalize(F.col("text")).alias("form"))


@query(f"SELECT doc_id, len(list_distinct(list_filter(string_split({norm('text')}, ' '), lambda x: x <> '')))::INT AS n_distinct FROM documents")
def q_tokens_distinct(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.size(T.tokens(F.col("text"))).alias("n_distinct"))


@query("SELECT doc_id, n_chars FROM documents WHERE lang IN ('en', 'fr') AND n_chars BETWEEN 500 AND 2500")
def q_pool_range(t: Tables) -> DataFrame:
    return P.candidate_pool(t.documents, P.Criteria(categories=("en", "fr"), min_cost=500, max_cost=2500), DOC).select("doc_id", "n_chars")


@query("SELECT p_partkey, p_type FROM part WHERE p_type IN ('PROMO', 'SMALL') AND p_partkey NOT IN (1, 3, 5, 7, 11)")
def q_pool_category(t: Tables) -> DataFrame:
    return P.candidate_pool(t.part, P.Criteria(categories=("PROMO", "SMALL"), excluded=(1, 3, 5, 7, 11)), PART).select("p_partkey", "p_type")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def q_exclude_anti(t: Tables) -> DataFrame:
    out = t.customer.where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return P.exclude(t.orders, out, "o_custkey").select("o_orderkey", "o_custkey")


def windows(t: Tables) -> DataFrame:
    """Each user's windows: from first to last event of each type. There are as many as types of events, so a list stays short."""
    spans = t.events.groupBy("user_id", "event_type").agg(F.min("ts").alias("start"), F.max("ts").alias("end"))
    return spans.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("ranges"))


WINDOWS = 'w AS (SELECT user_id, event_type, min(ts) AS a, max(ts) AS b FROM events GROUP BY 1, 2)'


@query(f"WITH {WINDOWS} SELECT user_id FROM w GROUP BY user_id HAVING bool_or(a <= TIMESTAMP '2024-01-02 00:00:00' AND TIMESTAMP '2024-01-02 00:00:00' <= b)")
def q_point_in_window(t: Tables) -> DataFrame:
    point = F.lit("2024-01-02 00:00:00").cast("timestamp_ntz")
    return P.candidate_pool(windows(t), P.Criteria(point=point), P.Columns(id="user_id", ranges="ranges")).select("user_id")


@query(f"WITH {WINDOWS} SELECT user_id FROM w GROUP BY user_id HAVING bool_or(a <= TIMESTAMP '2024-01-01 01:00:00' AND TIMESTAMP '2024-01-01 00:10:00' <= b)")
def q_window_overlap(t: Tables) -> DataFrame:
    a, b = (F.lit(x).cast("timestamp_ntz") for x in ("2024-01-01 00:10:00", "2024-01-01 01:00:00"))
    return P.candidate_pool(windows(t), P.Criteria(range=(a, b)), P.Columns(id="user_id", ranges="ranges")).select("user_id")


@query(f"WITH {WINDOWS} SELECT user_id, greatest(a, TIMESTAMP '2024-01-02 12:00:00') AS start_at, b AS end_at FROM w WHERE b >= TIMESTAMP '2024-01-02 12:00:00'")
def q_remaining_windows(t: Tables) -> DataFrame:
    left = I.remaining(F.col("ranges"), F.lit("2024-01-02 12:00:00").cast("timestamp_ntz"))
    return windows(t).select("user_id", F.inline(left).alias("start_at", "end_at"))


@query(f"WITH {WINDOWS}, r AS (SELECT greatest(a, TIMESTAMP '2024-01-01 06:00:00') AS a, b FROM w WHERE user_id = 7 AND b >= TIMESTAMP '2024-01-01 06:00:00') SELECT DISTINCT w.user_id FROM w JOIN r ON w.a <= r.b AND r.a <= w.b")
def q_reference_overlap(t: Tables) -> DataFrame:
    users = windows(t)
    rows = users.where("user_id = 7").select(F.inline("ranges")).collect()  # a record's few windows
    at = lambda x: F.lit(x).cast("timestamp_ntz")
    criteria = P.Criteria(reference_ranges=[(at(r["start"]), at(r["end"])) for r in rows], reference_from=at("2024-01-01 06:00:00"))
    return P.candidate_pool(users, criteria, P.Columns(id="user_id", ranges="ranges")).select("user_id")


@query("""SELECT l_orderkey, l_linenumber, o_orderkey FROM lineitem JOIN orders ON l_suppkey = o_custkey AND l_shipdate::TIMESTAMP <= o_orderdate::TIMESTAMP + to_days((o_orderkey % 9)::INT) AND o_orderdate::TIMESTAMP <= l_shipdate::TIMESTAMP + to_days(l_linenumber::INT)""")
def q_range_join(t: Tables) -> DataFrame:
    """Deliveries that run while an order of the same number as their supplier is open: windows of two whole tables, by key."""
    day = lambda c, n: F.col(c).cast("timestamp_ntz") + F.make_dt_interval(n.cast("int"))
    left = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_suppkey").cast("long").alias("supplier"), F.col("l_shipdate").cast("timestamp_ntz").alias("l_from"), day("l_shipdate", F.col("l_linenumber")).alias("l_to"))
    right = t.orders.select("o_orderkey", F.col("o_custkey").cast("long").alias("customer"), F.col("o_orderdate").cast("timestamp_ntz").alias("o_from"), day("o_orderdate", F.col("o_orderkey") % 9).alias("o_to"))
    return N.overlapping(left, right, ("l_from", "l_to"), ("o_from", "o_to"), [("supplier", "customer")]).select("l_orderkey", "l_linenumber", "o_orderkey")


@query(f"WITH {WINDOWS}, r AS (SELECT event_type || (user_id % 5) AS ref, min(ts) AS a, min(ts) + INTERVAL 30 MINUTE AS b FROM events GROUP BY 1), f AS (SELECT ref, greatest(a, TIMESTAMP '2024-01-01 00:10:00') AS a, b FROM r WHERE b >= TIMESTAMP '2024-01-01 00:10:00') SELECT DISTINCT user_id, ref FROM w JOIN f ON w.a <= f.b AND f.a <= w.b")
def q_reference_pools(t: Tables) -> DataFrame:
    """Users with a window that meets what remains of any of a table of references, all references at once."""
    ref = t.events.groupBy(F.concat("event_type", (F.col("user_id") % 5).cast("string")).alias("ref")).agg(F.min("ts").alias("a")).select("ref", F.array(F.struct(F.col("a").alias("start"), (F.col("a") + F.expr("interval 30 minutes")).alias("end"))).alias("windows"), F.lit("2024-01-01 00:10:00").cast("timestamp_ntz").alias("since"))
    return N.reference_pool(windows(t), ref, "user_id", "ref", "ranges", "windows", "since")


def priced(t: Tables) -> DataFrame:
    return t.part.withColumn("least", F.when(F.col("p_size") > 25, F.col("p_retailprice") + F.col("p_size")))


@query("SELECT p_partkey FROM part WHERE 960.5 >= coalesce(CASE WHEN p_size > 25 THEN p_retailprice + p_size END, p_retailprice)")
def q_affordable(t: Tables) -> DataFrame:
    return P.candidate_pool(priced(t), P.Criteria(gold=960.5), PART).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE p_retailprice >= 950")
def q_affordable_off(t: Tables) -> DataFrame:
    return P.candidate_pool(priced(t), P.Criteria(gold=10, affordable_only=False, min_cost=950), PART).select("p_partkey")


@query("SELECT doc_id FROM documents WHERE coalesce(regexp_extract(text, 'licen[sc]e', 0), '') <> ''")
def q_variant_only(t: Tables) -> DataFrame:
    docs = t.documents.withColumn("variant", F.regexp_extract("text", "licen[sc]e", 0))
    return P.candidate_pool(docs, P.Criteria(variant_only=True), P.Columns(id="doc_id", variant="variant")).select("doc_id")


def conditioned(t: Tables) -> DataFrame:
    """Events with conditions of several kinds made from their columns."""
    none = {"v_num": F.lit(None).cast("double"), "v_str": F.lit(None).cast("string"), "v_bool": F.lit(None).cast("boolean"), "v_arr": F.lit(None).cast("array<string>")}
    made = lambda kind, op, ok=F.lit(True), **v: F.struct(F.lit(kind).alias("type"), F.lit(op).alias("operator"), *[x.alias(n) for n, x in (none | v).items()], ok.alias("evaluable"))
    k = F.get_json_object("props", "$.k").cast("double")
    rows = [made("gold", ">=", v_num=k), made("level", "<", F.col("value") < 50, v_num=F.col("value")), made("kind", "=", v_str=F.col("event_type")), made("mode", "in", v_arr=F.array(F.col("event_type"), F.lit("view"))), made("trait", "active", v_str=F.col("event_type")), made("missing", "=", v_num=k)]
    return t.events.withColumn("conditions", F.array(*rows))


STATE = {"gold": 60, "level": 20, "mode": "view", "trait": ["click", "view", "error"]}


@query("SELECT event_id FROM events WHERE NOT (60 < CAST(json_extract_string(props, '$.k') AS DOUBLE)) AND NOT (value < 50 AND NOT (20 < value)) AND event_type IN ('click', 'view', 'error')")
def q_condition_3vl(t: Tables) -> DataFrame:
    return P.candidate_pool(conditioned(t), P.Criteria(state=STATE), P.Columns(id="event_id", conditions="conditions")).select("event_id")


@query("""SELECT event_id, i::INT AS place, CASE i WHEN 0 THEN 60 >= CAST(json_extract_string(props, '$.k') AS DOUBLE) WHEN 1 THEN CASE WHEN value < 50 THEN 20 < value END WHEN 2 THEN NULL WHEN 3 THEN true WHEN 4 THEN event_type IN ('click', 'view', 'error') ELSE NULL END AS outcome FROM events, range(0, 6) r(i)""")
def q_condition_outcomes(t: Tables) -> DataFrame:
    return conditioned(t).select("event_id", F.posexplode(F.transform("conditions", lambda r: C.evaluate(r, STATE))).alias("place", "outcome"))


@query(f"SELECT p_partkey, p_name FROM part WHERE {norm('p_name')} LIKE '%ring%' AND p_type = 'SMALL' AND p_size > 10")
def q_rule_filter(t: Tables) -> DataFrame:
    rows = t.part.withColumn("has_special_rules", F.col("p_size") > 10)
    return rows.where(P.named_like("p_name", "RING!", "SMALL", True, P.Columns(category="p_type"))).select("p_partkey", "p_name")


@query("SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%bolt%' ORDER BY p_partkey LIMIT 6")
def q_suggestions(t: Tables) -> DataFrame:
    return P.suggestions(t.part, "p_name", "Bolt", "p_partkey").select("p_partkey", "p_name")


@query("SELECT count(*) AS pool_size, count(*) FILTER (p_size <= 5) AS target_count, round(count(*) FILTER (p_size <= 5) / count(*), 12) AS target_probability, round(1 / count(*), 12) AS per_record_probability FROM part WHERE p_retailprice BETWEEN 910 AND 990")
def q_probability(t: Tables) -> DataFrame:
    pool = P.candidate_pool(priced(t), P.Criteria(min_cost=910, max_cost=990), PART)
    return Pr.equal_weight(pool, F.col("p_size") <= 5).withColumns({c: F.round(c, 12) for c in ("target_probability", "per_record_probability")})


@query("SELECT 0::BIGINT AS pool_size, 0::BIGINT AS target_count, 0::DOUBLE AS target_probability, 0::DOUBLE AS per_record_probability")
def q_probability_empty(t: Tables) -> DataFrame:
    return Pr.equal_weight(P.candidate_pool(priced(t), P.Criteria(min_cost=1e9), PART), F.lit(True))


@query("""SELECT 'ordinary' AS mode, count(*) AS pool_size, count(*) FILTER (p_size <= 5) AS target_count, round(count(*) FILTER (p_size <= 5) / count(*), 12) AS target_probability FROM part
UNION ALL SELECT 'forced', count(*), count(*) FILTER (p_size <= 5), round(count(*) FILTER (p_size <= 5) / count(*), 12) FROM part WHERE p_type = 'PROMO'""")
def q_probability_slot(t: Tables) -> DataFrame:
    return Pr.by_slot(t.part, F.col("p_size") <= 5, F.col("p_type") == "PROMO").withColumn("target_probability", F.round("target_probability", 12))


@query("SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN round(1 / (SELECT count(*) FROM part WHERE p_type = 'PROMO'), 12) ELSE 0 END AS probability FROM part")
def q_probability_per_row(t: Tables) -> DataFrame:
    return Pr.per_record(t.part, F.col("p_type") == "PROMO").select("p_partkey", F.round("probability", 12).alias("probability"))


@query("SELECT (SELECT count(*) FROM documents WHERE lang = 'en') AS pool_size, count(*) AS target_count FROM documents WHERE lang = 'en' AND lower(text) LIKE '%licensed%'")
def q_pool_vs_search(t: Tables) -> DataFrame:
    return Pr.equal_weight(P.candidate_pool(t.documents, P.Criteria(categories=("en",)), DOC), T.normalize(F.col("text")).contains("licensed")).select("pool_size", "target_count")


@query("SELECT p_partkey, CASE WHEN p_size BETWEEN 20 AND 57 AND p_size % 10 BETWEEN 1 AND 7 THEN p_size // 10 END::INT AS stage, CASE WHEN p_size BETWEEN 20 AND 57 AND p_size % 10 BETWEEN 1 AND 7 THEN p_size % 10 END::INT AS turn FROM part")
def q_playable_round(t: Tables) -> DataFrame:
    text = F.concat(F.floor(F.col("p_size") / 10).cast("string"), F.lit("-"), (F.col("p_size") % 10).cast("string"))
    return t.part.select("p_partkey", I.playable_round(text).alias("p")).select("p_partkey", F.col("p.stage").alias("stage"), F.col("p.round").alias("turn"))


@query("SELECT event_id, CASE WHEN event_type = 'click' THEN NULL WHEN event_type = 'view' THEN value END AS number FROM events")
def q_form_number(t: Tables) -> DataFrame:
    text = F.when(F.col("event_type") == "click", "x1").when(F.col("event_type") == "view", F.concat(F.lit(" "), F.col("value").cast("string"))).when(F.col("event_type") == "error", "-3").otherwise("")
    return t.events.select("event_id", I.optional_number(text).alias("number"))


@query("SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'ring') AND p_size > 10")
def q_index_filter_compatible(t: Tables) -> DataFrame:
    """Names in full width match a plain term."""
    rows = t.part.withColumn("has_special_rules", F.col("p_size") > 10).withColumn("wide", F.translate(F.upper("p_name"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺ"))
    return rows.where(P.named_like("wide", "Ring", special_only=True)).select("p_partkey", "p_name")


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (1, 2, 3)")
def q_exclude_keeps_null(t: Tables) -> DataFrame:
    """A row without id is none of the excluded ones, whether these are few or many."""
    orders = t.orders.withColumn("o_custkey", F.nullif("o_custkey", F.lit(0)))
    few = P.candidate_pool(orders, P.Criteria(excluded=(1, 2, 3)), P.Columns(id="o_custkey"))
    many = P.candidate_pool(orders, P.Criteria(excluded=(1, 2, 3, *range(-2000, 0))), P.Columns(id="o_custkey"))
    return few.join(many.select("o_orderkey"), "o_orderkey", "left_semi").select("o_orderkey")


@query("SELECT p_partkey FROM part WHERE p_size % 2 = 0 OR p_size <= 20")
def q_condition_missing_list(t: Tables) -> DataFrame:
    """A missing list of conditions rejects nothing."""
    none = {"v_str": "string", "v_bool": "boolean", "v_arr": "array<string>"}
    condition = F.struct(F.lit("gold").alias("type"), F.lit(">=").alias("operator"), F.col("p_size").cast("double").alias("v_num"), *[F.lit(None).cast(k).alias(n) for n, k in none.items()], F.lit(True).alias("evaluable"))
    rows = t.part.withColumn("conditions", F.when(F.col("p_size") % 2 == 1, F.array(condition)))
    return P.candidate_pool(rows, P.Criteria(state={"gold": 20}), P.Columns(id="p_partkey", conditions="conditions")).select("p_partkey")


@query("""WITH f AS (SELECT p_partkey, p_partkey % 4 AS k, p_size // 10 AS s, p_size % 10 AS r FROM part),
v AS (SELECT *, k <> 3 AND s >= 2 AND r BETWEEN 1 AND 7 AS good, s + 1 BETWEEN 2 AND 9 AND (s + 1 > 2 OR r >= 3) AND r BETWEEN 1 AND 7 AS ranged FROM f)
SELECT p_partkey, CASE WHEN k IN (0, 3) OR NOT good THEN NULL ELSE s || '-' || r END AS point, CASE WHEN k IN (1, 2) AND good OR NOT ranged THEN NULL ELSE '2-3 to ' || (s + 1) || '-' || r END AS span, CASE k WHEN 0 THEN 7.5::DOUBLE WHEN 1 THEN 16 END AS gold,
CASE WHEN k IN (1, 2, 3) AND NOT good THEN 'the point can''t be read' WHEN NOT ranged THEN 'the range can''t be read' WHEN k > 1 THEN 'not a number: gold' END AS message FROM v""")
def q_form_criteria(t: Tables) -> DataFrame:
    """What forms come to: an exact point suppresses the range; a field that can't be read is as if not asked, with advice. Digits of other scripts can't."""
    k, s, r = F.col("p_partkey") % 4, F.floor(F.col("p_size") / 10).cast("string"), (F.col("p_size") % 10).cast("string")
    point = F.concat(s, F.lit("-"), r)
    wide = F.translate(point, "0123456789", "０１２３４５６７８９")
    forms = t.part.select("p_partkey", F.when(k == 0, "").when(k == 3, wide).otherwise(F.concat(F.lit(" "), point)).alias("stage"), F.lit("2-3").alias("from"), F.concat((F.floor(F.col("p_size") / 10) + 1).cast("string"), F.lit("-"), r).alias("to"), F.element_at(F.array(*map(F.lit, (" 7.5 ", "0x10", "1_0", "１２"))), (k + 1).cast("int")).alias("gold"))
    return P.form_rows(forms, "p_partkey").select("p_partkey", "point", "span", "gold", "message")


@query("SELECT p_partkey, round(1 / (SELECT count(*) FROM part), 12) AS probability FROM part")
def q_card_probability(t: Tables) -> DataFrame:
    """In an uncertain slot a card shows the ordinary slot's probability."""
    return Pr.per_card(t.part, F.col("p_type") == "PROMO", "uncertain").select("p_partkey", F.round("probability", 12).alias("probability"))


@query("SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN p_size WHEN p_size % 4 = 1 THEN -p_size END AS known FROM part")
def q_known_value(t: Tables) -> DataFrame:
    """A confirmed value, a plain one; null for what is unknown or confirmed to be nothing."""
    k = F.col("p_size") % 4
    status = F.when(k == 0, "confirmed").when(k == 2, "unknown").when(k == 3, "confirmed")
    return t.part.select("p_partkey", C.known_value(status, F.when(k == 0, F.col("p_size")), -F.col("p_size")).alias("known"))


@query("SELECT p_partkey, problem IS NULL AS fits FROM (SELECT p_partkey, CASE p_size % 8 WHEN 1 THEN 'x' WHEN 4 THEN 'x' WHEN 6 THEN 'x' WHEN 7 THEN 'x' END AS problem FROM part)")
def q_condition_fits(t: Tables) -> DataFrame:
    """Which operators go with which values: number with >=, none with <, text with =, list with in, an empty list, a name with active, none with inactive, no operator where a machine should decide."""
    from quillon.operators.validate import condition_fits

    k, null = F.col("p_size") % 8, F.lit(None)
    op = F.element_at(F.array(*map(F.lit, (">=", "<", "=", "in", "in", "active", "inactive", None))), (k + 1).cast("int"))
    r = F.struct(op.alias("operator"), F.when(k == 0, 1.0).alias("v_num"), F.when(k.isin(2, 5), "t").alias("v_str"), null.cast("boolean").alias("v_bool"), F.when(k == 3, F.array(F.lit("a"))).when(k == 4, F.array().cast("array<string>")).alias("v_arr"), F.lit(True).alias("evaluable"))
    return t.part.select("p_partkey", F.coalesce(condition_fits(r), F.lit(False)).alias("fits"))
