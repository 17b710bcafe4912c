"""Searches over documents (whole texts) and parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators import search as S
from quillon.operators import search_index as X
from quillon.operators.saved import scratch, spread
from quillon.plans.registry import Tables, norm, query

LEXICON = S.Lexicon((S.Group("licence", ("licensed", "all rights reserved", "released under"), ("legal",)), S.Group("metal", ("bolt", "small ring", "ring"), ("metalwork",))), (("legal", "Legal notice"), ("red_goods", "red")))
DOCS = S.Surfaces(names=("title",), effects=("text",), synonyms="synonyms", concepts="concepts")
PARTS = S.Surfaces(names=("p_name", "p_brand"), effects=("p_type",), requirements="requirements", concepts="concepts")


def documents(t: Tables) -> DataFrame:
    """A document's first line is its name; its source is a synonym; labels give concepts."""
    docs = t.documents.withColumn("title", F.substring_index("text", "\n", 1)).withColumn("synonyms", F.array("source"))
    return docs.withColumn("concepts", F.when(F.col("lang") == "de", F.array(F.lit("legal"))).otherwise(F.array().cast("array<string>")))


def parts(t: Tables) -> DataFrame:
    return t.part.withColumn("requirements", F.array(F.concat(F.lit("size "), F.col("p_size").cast("string")))).withColumn("concepts", F.when(F.col("p_size") > 40, F.array(F.lit("metalwork"))).otherwise(F.array().cast("array<string>")))


def found(hits: DataFrame, key: str) -> DataFrame:
    return hits.select(key, F.col("total").alias("total"), F.round("score", 4).alias("score"), F.array_join("matched_fields", ",").alias("fields"))


def ladder(term: str, names: list[str], effects: list[str], lists: list[tuple[str, str]], expansions: tuple[str, ...] = (), concept: str | None = None) -> tuple[str, str]:
    """The ladder of one clause in SQL: score and field."""
    has = lambda x, w: f"contains({x}, '{w}')"
    steps = [(f"{n} = '{term}'", 1000, "nameExact") for n in names] + [(f"starts_with({n}, '{term}')", 700, "namePrefix") for n in names] + [(has(n, term), 500, "name") for n in names] + [(has(e, term), 300, "effect") for e in effects] + [(has(x, term), {"requirement": 220, "synonym": 140}[f], f) for x, f in lists]
    for e in expansions:
        if e != term:
            steps += [(has(x, e), 140, "synonym") for x in [*names, *effects, *[x for x, _ in lists]]]
    if concept:
        steps.append((concept, 100, "concept"))
    case = lambda i: "CASE " + " ".join(f"WHEN {s[0]} THEN {s[i] if i == 1 else repr(s[i])}" for s in steps) + " END"
    return case(1), case(2)


def sql(base: str, key: str, terms: list[tuple[str, str]], pick: str = "") -> str:
    scores = [f"({s}) AS s{i}, ({f}) AS f{i}" for i, (s, f) in enumerate(terms)]
    n = range(len(terms))
    total, fields = " + ".join(f"s{i}" for i in n), ", ".join(f"f{i}" for i in n)
    joined = "f0" if len(terms) == 1 else f"CASE WHEN f0 = f1 THEN f0 ELSE f0 || ',' || f1 END" if len(terms) == 2 else f"array_to_string(list_distinct([{fields}]), ',')"
    return f"WITH b AS ({base}), m AS (SELECT {key}, {', '.join(scores)} FROM b) SELECT {key}, ({total})::INT AS total, round(({total}) - {key} / 10000, 4) AS score, {joined} AS fields FROM m WHERE {' AND '.join(f's{i} IS NOT NULL' for i in n)} {pick}"


DOC_BASE = f"SELECT doc_id, {norm('split_part(text, chr(10), 1)')} AS n, {norm('text')} AS e, {norm('source')} AS s, lang = 'de' AS legal FROM documents"
PART_BASE = f"SELECT p_partkey, {norm('p_name')} AS n, {norm('p_brand')} AS b, {norm('p_type')} AS e, 'size ' || p_size AS r, p_size > 40 AS metal FROM part"


def d(term, expansions=(), concept=None):
    return ladder(term, ["n"], ["e"], [("s", "synonym")], expansions, concept)


def p(term, expansions=(), concept=None):
    return ladder(term, ["n", "b"], ["e"], [("r", "requirement")], expansions, concept)


LICENCE = ("all rights reserved", "licensed", "released under")
METAL = ("bolt", "ring", "small ring")


@query(sql(DOC_BASE, "doc_id", [d("que")]))
def q_search_single(t: Tables) -> DataFrame:
    return found(S.search(documents(t), "QUE", DOCS, order="doc_id"), "doc_id")


@query(sql(DOC_BASE, "doc_id", [d("the"), d("src3")]))
def q_search_and(t: Tables) -> DataFrame:
    return found(S.search(documents(t), "the, src3", DOCS, order="doc_id"), "doc_id")


@query(sql(DOC_BASE, "doc_id", [d("licensed", LICENCE, "legal")]))
def q_search_expansion(t: Tables) -> DataFrame:
    return found(S.search(documents(t), "Licensed", DOCS, LEXICON, "doc_id"), "doc_id")


@query(sql(PART_BASE, "p_partkey", [p("ring", METAL, "metal"), p("4")]))
def q_search_ladder(t: Tables) -> DataFrame:
    return found(S.search(parts(t), "ring 4", PARTS, LEXICON, "p_partkey"), "p_partkey")


@query(sql(PART_BASE, "p_partkey", [p("small ring", METAL, "metal"), p("small")]))
def q_search_clauses_longest(t: Tables) -> DataFrame:
    return found(S.search(parts(t), "Small-ring small", PARTS, LEXICON, "p_partkey"), "p_partkey")


@query("SELECT p_partkey, 0::INT AS total, 0::DOUBLE AS score, '' AS fields FROM part")
def q_search_empty(t: Tables) -> DataFrame:
    return found(S.search(parts(t), " !! ", PARTS, LEXICON, "p_partkey"), "p_partkey")


@query(sql(PART_BASE, "p_partkey", [p("small")], "ORDER BY total DESC, p_partkey LIMIT 20"))
def q_search_topk(t: Tables) -> DataFrame:
    return found(S.ranked(S.search(parts(t), "small", PARTS, order="p_partkey"), "p_partkey", 20), "p_partkey")


@query(f"WITH b AS ({PART_BASE}) SELECT p_partkey, CASE WHEN contains(n, 'ring') THEN 'name: RING' WHEN contains(b, 'ring') THEN 'p_brand: ring' WHEN contains(e, 'ring') THEN 'kind: ring' WHEN contains(r, 'ring') THEN 'requirements: ring' WHEN contains(n, 'bolt') THEN 'related name: BOLT' ELSE 'concept: metalwork' END AS reason FROM b WHERE contains(n, 'ring') OR contains(n, 'bolt') OR metal")
def q_search_reason(t: Tables) -> DataFrame:
    """The hit is shown as the record writes it, behind the label of its field."""
    rows = spread(parts(t)).withColumn("p_name", F.upper("p_name"))
    hits = S.search(rows, "ring", PARTS, LEXICON, "p_partkey")
    return hits.select("p_partkey", S.reason(F.element_at("matches", 1), PARTS, dict(LEXICON.concepts), {"p_name": "name", "p_type": "kind", "p_brand": "p_brand", "requirements": "requirements"}).alias("reason"))


@query("SELECT p_partkey, 'requirements.1' AS path, 'Size ' || p_size || '!' AS field FROM part")
def q_search_paths(t: Tables) -> DataFrame:
    """The path of an element of a list ends in its number, and is read back from the record."""
    rows = t.part.withColumn("requirements", F.array(F.lit("none"), F.concat(F.lit("Size "), F.col("p_size").cast("string"), F.lit("!"))))
    hits = S.search(rows, "size", S.Surfaces(("p_name",), requirements="requirements"), order="p_partkey").withColumn("path", F.get("matches", 0)["path"])
    return hits.select("p_partkey", "path", S.read_field(S.Surfaces(("p_name",), requirements="requirements"), F.col("path")).alias("field"))


WIDTH = ("abcdefghijklmnopqrstuvwxyz", "ａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ")


def wide_parts(t: Tables) -> DataFrame:
    """Parts with names in full width, and in two ways to write an accent: as one character, or as a letter and a mark."""
    accent = F.when(F.col("p_partkey") % 2 == 0, "\u00ed").otherwise("i\u0301")
    return t.part.withColumn("wide", F.translate("p_name", *WIDTH)).withColumn("marked", F.replace(F.upper("p_name"), F.lit("I"), F.upper(accent)))


@query(sql("SELECT p_partkey, p_name AS n FROM part", "p_partkey", [ladder("ring", ["n"], [], [])]))
def q_search_compatible(t: Tables) -> DataFrame:
    """Records in full width match a plain query, and the other way round: both searches give the same."""
    plain = S.search(wide_parts(t), "Ring", S.Surfaces(("wide",)), order="p_partkey")
    asked = S.search(wide_parts(t), "ｒｉｎｇ", S.Surfaces(("p_name",)), order="p_partkey")
    return found(plain, "p_partkey").intersect(found(asked, "p_partkey"))


@query("SELECT p_partkey, replace(p_name, 'i', 'í') AS form FROM part WHERE contains(p_name, 'ring') OR contains(p_name, 'widget')")
def q_search_accents(t: Tables) -> DataFrame:
    """Composed and decomposed accents, small and capital: the form, of what either of two searches finds."""
    from quillon.functions.text import normalize

    rows = wide_parts(t).withColumn("synonyms", F.array("marked"))
    s = S.Surfaces((), ("marked",), synonyms="synonyms")
    hits = [S.search(rows, q, s, order="p_partkey").select("p_partkey", "marked") for q in ("RI\u0301NG", "w\u00eddget")]
    return hits[0].union(hits[1]).select("p_partkey", normalize(F.col("marked")).alias("form"))


@query("SELECT p_partkey, strpos(p_name, 'ring') - 1 AS start_at, strpos(p_name, 'ring') + 3 AS end_at FROM part WHERE contains(p_name, 'ring')")
def q_match_ranges(t: Tables) -> DataFrame:
    hits = parts(t).where(F.lower("p_name").contains("ring"))
    ranges = S.valid_ranges(F.col("p_name"), S.match_ranges("p_name", F.lit("ring")))
    return hits.select("p_partkey", F.inline(ranges).alias("start_at", "end_at")).select("p_partkey", F.col("start_at").cast("long"), F.col("end_at").cast("long"))


@query("SELECT p_partkey, (strpos(p_name, 'ring') - 1)::INT AS start_at, (strpos(p_name, 'ring') + 3)::INT AS end_at FROM part WHERE contains(p_name, 'ring')")
def q_match_ranges_wide(t: Tables) -> DataFrame:
    """Where a plain term stands in texts of full width, in UTF-16 units of the raw text."""
    return wide_parts(t).select("p_partkey", F.inline(S.match_ranges("wide", F.lit("ring"))).alias("start_at", "end_at"))


def ladder_sql(term: str, steps: list[tuple[str, int, str]], i: int) -> str:
    return "CASE " + " ".join(f"WHEN {test.format(t=term)} THEN {s if i == 0 else repr(f)}" for test, s, f in steps) + " END"


#: Steps of the ladder over a part's surfaces, for a term that is a column.
PART_STEPS = [(f"{n} = {{t}}", 1000, "nameExact") for n in "nb"] + [(f"starts_with({n}, {{t}})", 700, "namePrefix") for n in "nb"] + [(f"contains({n}, {{t}})", 500, "name") for n in "nb"] + [("contains(e, {t})", 300, "effect"), ("contains(r, {t})", 220, "requirement")]


@query(f"""WITH b AS ({PART_BASE}), q AS (SELECT DISTINCT p_type || ' ' || split_part(p_name, ' ', 1) || ' ' || (p_size % 4) AS q FROM part),
w AS (SELECT q, unnest(string_split(lower(q), ' ')) AS w, generate_subscripts(string_split(q, ' '), 1) AS i FROM q), m AS (SELECT q, i, p_partkey, {ladder_sql("w", PART_STEPS, 0)} AS s, {ladder_sql("w", PART_STEPS, 1)} AS f FROM w, b),
h AS (SELECT q, p_partkey, sum(s) AS total, max(f) FILTER (i = 1) AS f1, max(f) FILTER (i = 2) AS f2, max(f) FILTER (i = 3) AS f3 FROM m WHERE s IS NOT NULL GROUP BY q, p_partkey HAVING count(*) = 3)
SELECT q AS query, p_partkey, total::INT AS total, round(total - p_partkey / 10000, 4) AS score, f1 || CASE WHEN f2 <> f1 THEN ',' || f2 ELSE '' END || CASE WHEN f3 NOT IN (f1, f2) THEN ',' || f3 ELSE '' END AS fields FROM h""")
def q_search_batch(t: Tables) -> DataFrame:
    """A table of queries of three words, answered from one stored index of all parts."""
    index = X.build(parts(t), "p_partkey", PARTS, scratch(t._spark, "index"), "p_partkey")
    queries = t.part.select(F.concat_ws(" ", "p_type", F.substring_index("p_name", " ", 1), (F.col("p_size") % 4).cast("string")).alias("query")).distinct()
    hits = X.search_batch(index, queries.withColumn("text", F.col("query")), "query", "text")
    return hits.select("query", F.col("key").alias("p_partkey"), "total", F.round("score", 4).alias("score"), F.array_join("matched_fields", ",").alias("fields"))


@query(sql(DOC_BASE, "doc_id", [d("licensed", LICENCE, "legal"), d("src3")]))
def q_search_index_one(t: Tables) -> DataFrame:
    """One query over a stored index of whole documents: an expansion, a concept, and a source."""
    index = X.build(documents(t), "doc_id", DOCS, scratch(t._spark, "index"), "doc_id")
    return found(X.search_one(index, "Licensed src3", LEXICON).withColumnRenamed("key", "doc_id"), "doc_id")
