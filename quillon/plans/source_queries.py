"""Sources, sinks and projections: what is written as JSON and read again, order, labels, statuses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions import intervals as I
from quillon.functions import text as T
from quillon.operators import align as A
from quillon.operators import rules as U
from quillon.operators.saved import scratch
from quillon.plans.registry import Tables, query
from quillon.sources import catalogue, published, sinks
from quillon.streaming.publish import keep_last, publish_stream


def dataset(t: Tables, name: str, rows: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """rows (few) as one JSON document with an envelope, written and read back with an explicit schema: (records, envelope)."""
    path = scratch(t._spark, name)
    whole = rows.agg(F.array_sort(F.collect_list(F.struct(*rows.columns))).alias("records")).select(F.lit("1.2").alias("patch"), F.lit("ready").alias("status"), F.lit("2024-01-02").alias("verifiedAt"), "records")
    whole.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).coalesce(1).write.text(path)
    return catalogue.read_dataset(t._spark, path, schema)


def nations(t: Tables) -> tuple[DataFrame, DataFrame]:
    return dataset(t, "nations", t.nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), "n_regionkey"), "id long, name string, n_regionkey long")


def regions(t: Tables) -> tuple[DataFrame, DataFrame]:
    return dataset(t, "regions", t.region.select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name")), "id long, name string")


@query("SELECT (row_number() OVER (ORDER BY n_nationkey) - 1)::INT AS ord, n_nationkey::BIGINT AS id, n_name AS name FROM nation")
def q_dataset_load(t: Tables) -> DataFrame:
    return nations(t)[0].select("ord", "id", "name")


@query("SELECT '1.2' AS patch, count(*)::INT AS n FROM nation")
def q_dataset_envelope(t: Tables) -> DataFrame:
    return nations(t)[1].select("patch", "n")


@query("SELECT n_nationkey::BIGINT AS id, n_name AS name FROM nation WHERE n_nationkey = 7")
def q_point_lookup(t: Tables) -> DataFrame:
    return catalogue.by_id(nations(t)[0], 7).select("id", "name")


@query("SELECT n_name AS name, r_name AS region FROM nation JOIN region ON r_regionkey = n_regionkey")
def q_parallel_load(t: Tables) -> DataFrame:
    """Two documents, read independently of each other and joined."""
    regions_ = regions(t)[0].select(F.col("id").alias("n_regionkey"), F.col("name").alias("region"))
    return nations(t)[0].join(regions_, "n_regionkey").select("name", "region")


@query("SELECT c_custkey, c_name, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS balance FROM customer")
def q_json_sink(t: Tables) -> DataFrame:
    """JSON lines in a fixed order, nulls included, read back."""
    rows = t.customer.select("c_custkey", "c_name", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("balance"))
    path = scratch(t._spark, "lines")
    sinks.write_json(rows, path, ["c_custkey"])
    return t._spark.read.schema(rows.schema).json(path)


@query("SELECT s_suppkey, s_name FROM supplier")
def q_publish(t: Tables) -> DataFrame:
    """Published rows are read back and compared by digest before anyone reads them."""
    return sinks.publish(t.supplier.select("s_suppkey", "s_name"), scratch(t._spark, "published"))


@query("SELECT p_partkey, p_size + 1 AS p_size, 'part' AS of FROM part UNION ALL SELECT s_suppkey, 2, 'supplier' FROM supplier")
def q_publish_together(t: Tables) -> DataFrame:
    """Two tables in one publication, a second version of both, and a third that a check refuses: readers see the second whole."""
    root = scratch(t._spark, "together")
    for n in range(3):
        tables = {"part": t.part.select("p_partkey", (F.col("p_size") + n).alias("p_size")), "supplier": t.supplier.select("s_suppkey", F.lit(1 + n).cast(t.part.schema["p_size"].dataType).alias("level"))}
        try:
            published.publish(tables, root, lambda staged: staged["supplier"].where("level > 2"))
        except ValueError:
            refused = n
    part, supplier = published.read(t._spark, root, "part"), published.read(t._spark, root, "supplier")
    return part.withColumn("of", F.lit("part")).union(supplier.withColumn("of", F.lit("supplier"))).where(F.lit(refused) == 2)


@query("SELECT o_custkey, max(o_orderkey) AS last_order, arg_max(o_orderstatus, o_orderkey) AS status FROM orders GROUP BY 1")
def q_stream_published(t: Tables) -> DataFrame:
    """A stream of all orders, published as the last order of each customer; read as readers see it."""
    orders = t.orders.select(F.col("o_custkey"), F.col("o_orderkey").alias("last_order"), F.col("o_orderstatus").alias("status"))
    incoming, root = scratch(t._spark, "incoming"), scratch(t._spark, "stream")
    orders.repartition(2, "last_order").write.parquet(incoming)
    stream = t._spark.readStream.schema(orders.schema).option("maxFilesPerTrigger", 1).parquet(incoming)
    publish_stream(stream, root, scratch(t._spark, "offsets"), keep_last("o_custkey", "last_order")).awaitTermination()
    return published.read(t._spark, root, "rows")


@query("SELECT name, problem FROM (VALUES ('part', 'changed'), ('supplier', 'missing')) v(name, problem) WHERE (SELECT count(*) FROM part) > 0 AND (SELECT count(*) FROM region) > 0")
def q_published_problems(t: Tables) -> DataFrame:
    """What was published is compared with its manifest: rows added to one table afterwards, and the files of another gone."""
    root = scratch(t._spark, "tampered")
    found = published.publish({"part": t.part, "region": t.region, "supplier": t.supplier}, root)
    t.part.write.mode("append").parquet(f"{root}/{found.tables['part']['path']}")
    fs, gone = published._fs(t._spark, f"{root}/{found.tables['supplier']['path']}")
    fs.delete(gone, True)
    return published.problems(t._spark, root)


@query("SELECT r_regionkey, true AS refused FROM region")
def q_write_once(t: Tables) -> DataFrame:
    """Frozen evidence isn't overwritten: the second write is refused, the first stays."""
    rows, path, refused = t.region.select("r_regionkey"), scratch(t._spark, "frozen"), False
    sinks.write_once(rows, path)
    try:
        sinks.write_once(rows.limit(0), path)
    except Exception as e:  # noqa: BLE001 - Spark's own error class differs between versions
        refused = "already exists" in str(e).lower()
    return t._spark.read.schema(rows.schema).parquet(path).withColumn("refused", F.lit(refused))


@query("SELECT r_regionkey, (SELECT count(*) FROM region) AS n FROM region")
def q_count_gate(t: Tables) -> DataFrame:
    """Rows that may only be read if there are as many as agreed."""
    rows = catalogue.expect_count(t.region, t.region.count(), "regions")
    return rows.select("r_regionkey").crossJoin(F.broadcast(t.region.agg(F.count("*").alias("n"))))


@query("SELECT 'part' AS name, true AS same UNION ALL SELECT 'part with another size', false")
def q_artifact_guard(t: Tables) -> DataFrame:
    """Whether protected tables hold the same rows before and after, in whatever order."""
    cols = ["p_partkey", "p_name", "p_size"]
    rows = [("part", sinks.unchanged(t.part, t.part.repartition(3, "p_size"), cols)), ("part with another size", sinks.unchanged(t.part, t.part.withColumn("p_size", F.col("p_size") + 1), cols))]
    return t._spark.createDataFrame(rows, "name string, same boolean")


@query("SELECT p_partkey, p_name FROM part WHERE p_size % 3 = 1")
def q_rules_for_patch(t: Tables) -> DataFrame:
    rows = t.part.withColumn("patch", F.concat(F.lit("18."), (F.col("p_size") % 3).cast("string")))
    return U.rules_for(rows, "18.1").select("p_partkey", "p_name")


@query("SELECT p_partkey, p_name FROM part WHERE p_type = 'PROMO'")
def q_catalogue_rows(t: Tables) -> DataFrame:
    """Rows of a client's catalogue by what their icon's path names."""
    entries = t.part.withColumn("icon", F.concat(F.lit("ASSETS/UX/"), "p_type", F.lit("_Icon.tex")))
    return catalogue.catalogue_rows(entries, "icon", "promo_icon", ["p_partkey", "p_name"])


@query("SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN 'fetched' ELSE 'blocked' END AS status FROM customer")
def q_fetch_status(t: Tables) -> DataFrame:
    return catalogue.fetch_status(t.customer.select("c_custkey"), t.orders.select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


LABELS = {"PROMO": "on offer", "SMALL": "small things"}


@query("SELECT p_partkey, CASE p_type WHEN 'PROMO' THEN 'on offer' WHEN 'SMALL' THEN 'small things' END AS category_label, '2-1 to 3-' || (1 + p_size % 7) AS windows, p_size % 2 = 0 AS once, CASE WHEN p_size % 3 = 0 THEN p_size END AS cooldown FROM part")
def q_card(t: Tables) -> DataFrame:
    """A card: label, windows as text, and flags; unknown ones count as false."""
    rows = t.part.withColumn("category", F.col("p_type"))
    windows = I.stage_text(I.stage_ranges(F.format_string("2-1 ~ 3-%d", 1 + F.col("p_size") % 7)))
    out = U.card(rows, LABELS, windows, F.when(F.col("p_size") % 2 == 0, True), F.when(F.col("p_size") % 3 == 0, F.col("p_size")))
    return out.select("p_partkey", "category_label", "windows", "once", "cooldown")


@query("SELECT p_partkey, CASE p_type WHEN 'PROMO' THEN 'on offer' WHEN 'SMALL' THEN 'small things' END AS label FROM part")
def q_labels(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", U.labels_of(F.col("p_type"), LABELS).alias("label"))


@query("SELECT o_orderkey, path, value FROM (SELECT o_orderkey, unnest([{'path': 'status', 'value': o_orderstatus}, {'path': 'who.id', 'value': o_custkey::VARCHAR}, {'path': 'who.tags', 'value': '[a, ' || o_orderstatus || ']'}], recursive := true) FROM orders)")
def q_leaf_paths(t: Tables) -> DataFrame:
    """Leaves of a nested record by path, from its schema; an array is one leaf."""
    who = F.struct(F.col("o_custkey").alias("id"), F.array(F.lit("a"), F.col("o_orderstatus")).alias("tags"))
    rows = t.orders.select("o_orderkey", F.struct(F.col("o_orderstatus").alias("status"), who.alias("who")).alias("r"))
    cells = [F.struct(F.lit(p).alias("path"), c.cast("string").alias("value")) for p, c in A.leaves(F.col("r"), rows.schema["r"].dataType)]
    return rows.select("o_orderkey", F.inline(F.array(*cells)))


@query("SELECT p_partkey, row_number() OVER (ORDER BY p_size % 4, lower(replace(p_name, ' ', '_')), p_partkey) AS place FROM part")
def q_index_order(t: Tables) -> DataFrame:
    """First window, then name by a collation (without regard to case), then id; rows are numbered without one task for all."""
    from quillon.operators.saved import numbered

    ranges = F.array(F.struct((F.col("p_size") % 4).alias("start"), F.lit(9).alias("end")))
    rows = t.part.select("p_partkey", ranges.alias("ranges"), F.when(F.col("p_size") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("name"))
    rows = rows.withColumn("name", F.translate("name", " ", "_"))
    return numbered(rows, U.index_order("ranges", "name", "p_partkey", "UTF8_LCASE"), "place").select("p_partkey", "place")


@query("""WITH n AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN (['刘', '王', '张'])[p_size % 3 + 1] ELSE CASE WHEN p_size % 2 = 0 THEN 'a_b' ELSE 'A1' END END AS name FROM part)
SELECT p_partkey, name, row_number() OVER (PARTITION BY p_partkey % 2 ORDER BY CASE name WHEN '刘' THEN 1 WHEN '王' THEN 2 WHEN '张' THEN 3 WHEN 'a_b' THEN 1 ELSE 2 END, p_partkey) AS place FROM n""")
def q_collated_order(t: Tables) -> DataFrame:
    """Chinese names by pinyin; Latin ones in the order of an English dictionary, where signs come before digits and case matters last."""
    from quillon.operators.saved import numbered

    name = F.when(F.col("p_partkey") % 2 == 0, F.element_at(F.array(*map(F.lit, ("刘", "王", "张"))), (F.col("p_size") % 3 + 1).cast("int"))).otherwise(F.when(F.col("p_size") % 2 == 0, "a_b").otherwise("A1"))
    rows = t.part.select("p_partkey", name.alias("name"))
    parts = [numbered(rows.where(F.col("p_partkey") % 2 == k), [*U.index_order_by_name("name", language), F.col("p_partkey")], "place") for k, language in ((0, "zh"), (1, "en"))]
    return parts[0].unionByName(parts[1])


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'weakened' WHEN o_orderstatus = 'O' AND o_orderkey % 2 = 0 THEN 'supported' ELSE 'unresolved' END AS impact FROM orders")
def q_impact(t: Tables) -> DataFrame:
    kind = F.when(F.col("o_orderstatus") == "F", "existing").when(F.col("o_orderstatus") == "O", "missing")
    base = F.when(F.col("o_orderkey") % 2 == 0, "DA_X").otherwise("DA_X_Upgrade")
    return t.orders.select("o_orderkey", A.impact(kind, base).alias("impact"))


@query("SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN 'snapshot_' || lpad((p_partkey % 1000)::VARCHAR, 3, '0') || '_' || replace(p_name, ' ', '_') ELSE 'da_' || replace(p_name, ' ', '_') END AS id, CASE WHEN p_type <> 'PROMO' THEN 'EN ' || p_name ELSE p_name END AS name_en, CASE WHEN p_type = 'SMALL' THEN 'gold_xp' ELSE lower(p_type) END AS category, CASE WHEN p_type <> 'PROMO' AND p_size % 2 = 0 THEN 'up ' || p_name END AS second, '2-' || (1 + p_size % 7) || ' to 3-1' AS windows, ['level ' || p_size] AS requirements, CASE WHEN p_type <> 'PROMO' THEN 'client' ELSE 'catalogue' END AS id_source FROM part")
def q_normalised_record(t: Tables) -> DataFrame:
    """A source row joined to the client's rows of its name (a base one first) and their other language, as one normalised record."""
    part = t.part
    rows = part.select("p_partkey", F.col("p_name").alias("name"), (F.col("p_partkey") % 1000).alias("position"), F.when(F.col("p_type") == "SMALL", "goldxp").otherwise(F.lower("p_type")).alias("category"), F.array(F.format_string("windows: 2-%d ~ 3-1", 1 + F.col("p_size") % 7), F.format_string("level %d", "p_size")).alias("labels"), F.concat(F.lit("<b>up</b> "), "p_name").alias("upgrade"), F.col("p_type"), F.col("p_size"), F.concat("p_name", F.lit("#"), F.col("p_partkey").cast("string")).alias("join_name"))
    api = F.concat(F.lit("DA "), "p_name")
    own = part.where("p_type <> 'PROMO'").select(F.concat("p_name", F.lit("#"), F.col("p_partkey").cast("string")).alias("join_name"), api.alias("api_name"), F.lit("does x").alias("text"))
    upgrades = part.where("p_type <> 'PROMO'").select(F.concat("p_name", F.lit("#"), F.col("p_partkey").cast("string")).alias("join_name"), F.concat(api, F.lit("_Upgrade")).alias("api_name"), F.when(F.col("p_size") % 2 == 0, "does <i>y</i>").otherwise("does <i>x</i>").alias("text"))
    english = own.select("api_name", F.concat(F.lit("EN "), F.substring("api_name", 4, 99)).alias("name_en")).distinct()
    out = U.normalised(rows, own.union(upgrades), english, key="p_partkey", join="join_name", windows="windows:", remap={"goldxp": "gold_xp"})
    return out.select("p_partkey", "id", "name_en", "category", F.col("second"), I.stage_text(F.col("ranges")).alias("windows"), F.col("requirements"), F.col("sources")["id"].alias("id_source"))


@query("SELECT doc_id, source || ':' || lang AS field FROM documents")
def q_read_by_path(t: Tables) -> DataFrame:
    """Fields read by a path that each row names."""
    from quillon.operators import search as S

    surfaces = S.Surfaces(("lang",), synonyms="names")
    rows = t.documents.select("doc_id", "lang", F.array(F.lit("x"), F.col("source")).alias("names"))
    return rows.select("doc_id", F.concat_ws(":", S.read_field(surfaces, F.lit("names.1")), S.read_field(surfaces, F.lit("lang")), S.read_field(surfaces, F.lit("names.9")), S.read_field(surfaces, F.lit("nowhere"))).alias("field"))
