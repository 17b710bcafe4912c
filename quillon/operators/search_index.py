"""A stored index of search forms, and searches of one query or a table of queries over it.

Records' surfaces are brought into search form once and written, with postings of their grams: every run of one, two and
three characters, so that what contains a term is found for terms of any length. Postings are lists, one for each gram of a few million characters
of surfaces; they lie in folders by a hash of the gram and are sorted by it. A term looks up its rarest grams, and what has all of them is checked
by the term itself. Queries that share a clause share its hits, and a query only meets records that its rarest clause hits. The result is that of
search.search(), query by query.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from quillon.operators.pool import normalize_query
from quillon.operators.saved import saved, spread
from quillon.operators.search import LADDER, Lexicon, Surfaces, _indexed, clauses

#: Folders that postings are dealt to, characters of the longest gram, and grams that a term looks up.
FOLDERS, LONGEST, LOOKED_UP = 16, 3, 3
#: Characters of the surfaces that one list of postings covers.
LISTED = 4_000_000

_CLAUSES = "array<struct<source:string,expansions:array<string>,concepts:array<struct<name:string,form:string>>>>"


@dataclass(frozen=True)
class Index:
    """A written index: its folder, and the session that reads it."""

    spark: SparkSession
    path: str

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    @property
    def records(self) -> DataFrame:
        """(key, position)"""
        return self._table("records")

    @property
    def surfaces(self) -> DataFrame:
        """(surface, key, place, kind, path, form)"""
        return self._table("surfaces")

    @property
    def concepts(self) -> DataFrame:
        """(key, path, form)"""
        return self._table("concepts")

    @property
    def lists(self) -> DataFrame:
        """(folder, gram, n, base, offsets): n surfaces that have a gram, base plus each offset; a gram has several lists."""
        return self.spark.read.schema("gram string, n long, base long, offsets array<int>, folder int").parquet(f"{self.path}/postings")

    @property
    def postings(self) -> DataFrame:
        """(folder, gram, surface)"""
        return self.lists.select("folder", "gram", _listed())

    @property
    def grams(self) -> DataFrame:
        """(gram, surfaces)"""
        return self._table("grams")


def _listed() -> Column:
    """The surfaces of a list, one a row."""
    return F.explode(F.transform("offsets", lambda x: F.col("base") + x)).alias("surface")


def _folder(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(FOLDERS)).cast("int")


def _grams(form: Column, size: int) -> Column:
    return F.regexp_extract_all(form, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1))


def _surface(kind: str, path: Column, form: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), path.alias("path"), form.alias("form"))


def _elements(column: str, name: str, kind: str) -> Column:
    """The surfaces of a list; a concept's path is the list, any other's ends in its number."""
    return F.transform(F.col(column), lambda x, i: _surface(kind, F.lit(name) if kind == "concept" else F.concat(F.lit(f"{name}."), i.cast("string")), x))


def _runs(ids: np.ndarray, alphabet: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
    """For each length of grams: the grams of forms, where the list of each begins, and the lists one after the other, of places in forms.

    ids: the forms' characters, one form after the other, as numbers in the alphabet, in which 0 is what is beyond a form's end.
    """
    many, rows = len(alphabet), len(lengths)
    row, run = np.repeat(np.arange(rows, dtype=np.int64), lengths), np.zeros(len(ids), np.int64)
    for ahead in range(LONGEST):  # each character with those that follow it in its form
        run *= many
        run[: len(run) - ahead] += np.where(row[ahead:] == row[: len(row) - ahead], ids[ahead:], 0)
    pairs = run * rows + row  # by gram, then by form
    for n in range(LONGEST, 0, -1):
        pairs.sort()
        pairs = pairs[np.concatenate([[True], pairs[1:] != pairs[:-1]])]
        gram = pairs // rows
        whole = gram % many != 0
        shown, place = gram[whole], (pairs - gram * rows)[whole]
        starts = np.flatnonzero(np.concatenate([[True], shown[1:] != shown[:-1]])) if len(shown) else np.zeros(0, np.int64)
        text = alphabet[np.stack([shown[starts] // many**i % many for i in range(n - 1, -1, -1)], 1)].tobytes().decode("utf-32-le")
        yield [text[i : i + n] for i in range(0, len(text), n)], starts, place
        pairs = gram // many * rows + (pairs - gram * rows)


def _lists(surfaces: np.ndarray, forms: list[str]) -> Iterator[pa.RecordBatch]:
    """Lists of postings of forms that aren't empty. Forms that have too many characters for numbers of 64 bits, or ids too far apart, are halved."""
    lengths, codes = np.array([len(f) for f in forms], np.int64), np.frombuffer("".join(forms).encode("utf-32-le"), "<u4")
    number = np.zeros(0x110000, np.int64)
    number[codes] = 1
    alphabet = np.concatenate([[0], np.flatnonzero(number)]).astype("<u4")
    wide = len(alphabet) ** LONGEST * len(forms) >= 1 << 63
    if len(forms) > 1 and (wide or int(surfaces.max()) - int(surfaces.min()) >= 1 << 31):
        half = len(forms) // 2
        yield from _lists(surfaces[:half], forms[:half])
        yield from _lists(surfaces[half:], forms[half:])
        return
    base = int(surfaces.min())
    number[alphabet[1:]] = np.arange(1, len(alphabet))
    for grams, starts, place in _runs(number[codes], alphabet, lengths):
        offsets = pa.ListArray.from_arrays(pa.array(np.append(starts, len(place)), pa.int32()), pa.array(surfaces[place] - base, pa.int32()))
        n = np.diff(np.append(starts, len(place)))
        yield pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), pa.array(n, pa.int64()), pa.array(np.full(len(grams), base), pa.int64()), offsets], ["gram", "n", "base", "offsets"])


def _posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists of postings of (surface, form), each of LISTED characters of forms."""
    surfaces, forms, size = [], [], 0
    for batch in batches:
        lengths = pc.utf8_length(batch.column("form")).to_numpy(zero_copy_only=False)
        ends, start = size + np.cumsum(lengths, dtype=np.int64), 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, LISTED, "right")))
            part = batch.slice(start, stop - start)
            surfaces.append(part.column("surface").to_numpy())
            forms += part.column("form").to_pylist()
            size, start = int(ends[stop - 1]), stop
            if stop < batch.num_rows or size >= LISTED:
                yield from _lists(np.concatenate(surfaces), forms)
                surfaces, forms, ends, size = [], [], ends - size, 0
    if forms:
        yield from _lists(np.concatenate(surfaces), forms)


def build(records: DataFrame, key: str, surfaces: Surfaces, path: str, order: str | None = None) -> Index:
    """Write the index of records to a new folder. key tells records apart; order, a number, is taken off scores as search() does.

    Null and empty surfaces have no grams and are never hit, as in search(). An empty table makes an empty index.
    """
    spark, s = records.sparkSession, surfaces
    parts = [F.array(*[_surface("name", F.lit(c), F.col(f"_n{i}")) for i, c in enumerate(s.names)], *[_surface("effect", F.lit(c), F.col(f"_e{i}")) for i, c in enumerate(s.effects)])]
    for column, name, kind in (("_r", s.requirements, "requirement"), ("_s", s.synonyms, "synonym")):
        if name:
            parts.append(_elements(column, name, kind))
    position = F.col(order) if order else F.lit(0)
    lists = [c for c in (s.requirements, s.synonyms) if c]
    texts = spread(records.select(*dict.fromkeys([key, *s.names, *s.effects, *lists])))
    indexed = _indexed(texts, replace(s, concepts=None)).select(F.col(key).alias("key"), F.posexplode(F.concat(*parts)).alias("place", "_p")).select(F.monotonically_increasing_id().alias("surface"), "key", "place", "_p.*")
    indexed.where("form <> ''").write.parquet(f"{path}/surfaces")
    named = replace(s, names=(), effects=(), requirements=None, synonyms=None)
    concepts = _indexed(spread(records.select(*dict.fromkeys([key, *([s.concepts] if s.concepts else [])]))), named).select(F.col(key).alias("key"), F.explode(F.array_distinct("_c")).alias("form"))
    concepts.select("key", F.lit(s.concepts).cast("string").alias("path"), "form").write.parquet(f"{path}/concepts")
    records.select(F.col(key).alias("key"), position.cast("double").alias("position")).write.parquet(f"{path}/records")
    index = Index(spark, path)
    lists = index.surfaces.select("surface", "form").mapInArrow(_posted, "gram string, n long, base long, offsets array<int>").withColumn("folder", _folder(F.col("gram")))
    # a folder is one task's, or several tasks' if it is large: the rebalancing hint splits it
    lists.hint("rebalance", "folder").sortWithinPartitions("folder", "gram", "base").write.partitionBy("folder").parquet(f"{path}/postings")
    index.lists.groupBy("gram").agg(F.sum("n").alias("surfaces")).write.parquet(f"{path}/grams")
    return index


def containing(index: Index, terms: DataFrame, literal: list[str] | None = None) -> DataFrame:
    """(term, surface, key, place, kind, path, form): surfaces that contain each term of (term), an empty one in none.

    literal: the terms, where the driver knows them; then only their folders are read.
    """
    size = F.least(F.lit(LONGEST), F.char_length("term"))
    wanted = terms.where("term <> ''").distinct().withColumn("size", size)
    sized = reduce(lambda a, n: a.when(F.col("size") == n, F.array_distinct(_grams(F.col("term"), n))), range(2, LONGEST + 1), F.when(F.col("size") == 1, F.array("term")))
    each = wanted.select("term", F.explode(sized).alias("gram")).join(index.grams, "gram", "left").withColumn("surfaces", F.coalesce("surfaces", F.lit(0)))
    rarest = each.withColumn("_n", F.row_number().over(Window.partitionBy("term").orderBy("surfaces", "gram"))).where(F.col("_n") <= LOOKED_UP)
    asked = rarest.groupBy("term").agg(F.collect_list("gram").alias("grams")).select("term", F.size("grams").alias("n"), F.explode("grams").alias("gram")).withColumn("folder", _folder(F.col("gram")))
    postings, surfaces = index.lists, index.surfaces
    if literal is None:
        asked = saved(asked, "asked")  # so that the planner knows how few rows meet the lists
    else:
        known = sorted({t[i : i + min(LONGEST, len(t))] for t in literal if t for i in range(len(t) - min(LONGEST, len(t)) + 1)})
        postings = postings.where(F.col("gram").isin(known) & F.col("folder").isin([r[0] for r in index.spark.createDataFrame([(g,) for g in known], "gram string").select(_folder(F.col("gram"))).distinct().collect()] if known else []))
        # what has none of the terms needn't travel to the check
        surfaces = surfaces.where(reduce(lambda a, t: a | F.col("form").contains(t), (t for t in literal if t), F.lit(False)))
    found = asked.withColumnRenamed("n", "_of").join(postings, ["folder", "gram"]).select("term", "_of", _listed()).groupBy("term", "_of", "surface").agg(F.count("*").alias("_k")).where("_k = _of").select("term", "surface")
    return found.join(surfaces, "surface").where(F.col("form").contains(F.col("term")))


def _parsed(queries: DataFrame, text: str, lexicon: Lexicon) -> DataFrame:
    @pandas_udf(_CLAUSES)
    def of(x: pd.Series) -> pd.Series:
        return x.map(lambda q: [{"source": c.source, "expansions": list(c.expansions), "concepts": [{"name": k, "form": normalize_query(k)} for k in c.concepts]} for c in clauses(q or "", lexicon)])

    return queries.withColumn("_clauses", of(F.col(text)))


def search_batch(index: Index, queries: DataFrame, query_id: str, text: str, lexicon: Lexicon = Lexicon(), literal: list[str] | None = None) -> DataFrame:
    """(query_id, key, matches, matched_fields, total, score): the hits of each query, each as search() gives them.

    A record is a hit if every clause hits it; of a clause's hits in a record the first by the ladder counts. Null and empty queries have all
    records, with score 0. Queries of one query_id must be one row. The lexicon is small; it goes to the tasks with the code.
    """
    parsed = _parsed(queries.select(F.col(query_id).alias("query"), F.col(text).alias("_text")), "_text", lexicon).select("query", "_clauses")
    parsed = saved(parsed, "parsed")  # else what is asked of the clauses is asked before the queries are made distinct, of every row
    each = parsed.select("query", F.posexplode("_clauses").alias("clause", "c")).select("query", "clause", "c.*")
    # a clause is known by its source, as all are of one lexicon; its ways are the source and then the expansions
    terms = F.concat(F.array("source"), F.filter("expansions", lambda t: t != F.col("source")))
    each = each.select("query", F.struct("clause", "source", terms.alias("terms"), "concepts").alias("c"))
    kinds = each.select("c.*").dropDuplicates(["source"])
    ways = kinds.select("source", F.posexplode("terms").alias("way", "term"))
    hits = ways.join(containing(index, ways.select("term"), literal), "term")
    of = lambda kind: F.col("kind") == kind
    field = F.when(F.col("way") > 0, "expansion").when(of("name") & (F.col("form") == F.col("term")), "nameExact").when(of("name") & F.col("form").startswith(F.col("term")), "namePrefix").otherwise(F.col("kind"))
    fields = list(LADDER)
    step = reduce(lambda a, f: a.when(field == f, fields.index(f)), fields[1:], F.when(field == fields[0], 0))
    direct = hits.select("key", "source", F.struct(step.alias("step"), "way", "place", "path").alias("m"))
    stated = kinds.select("source", F.posexplode("concepts").alias("way", "_c")).select("source", "way", F.col("_c.form").alias("form"))
    concept = stated.join(index.concepts, "form").select("key", "source", F.struct(F.lit(fields.index("concept")).alias("step"), "way", F.lit(0).alias("place"), "path").alias("m"))
    # each record with the clauses that hit it, whichever queries they are of
    best = direct.unionByName(concept).repartition("key").groupBy("key", "source").agg(F.min("m").alias("m"))
    held = best.groupBy("key").agg(F.collect_list(F.struct("source", "m")).alias("_h")).join(index.records, "key")
    held = saved(held.select("key", "position", F.col("_h.source").alias("sources"), F.col("_h.m").alias("ms")), "held")
    counts = held.select(F.explode("sources").alias("source")).groupBy("source").agg(F.count("*").alias("records"))
    # a query with its clauses and the rarest of them, unless one hits nothing
    counted = each.join(counts, F.col("c.source") == F.col("source"), "left")
    asked = counted.groupBy("query").agg(F.min(F.struct("records", "source")).alias("_l"), F.array_sort(F.collect_list("c")).alias("_q"), F.count("records").alias("_k")).where(F.size("_q") == F.col("_k"))
    asked = saved(asked.select("query", F.col("_l.source").alias("lead"), "_q"), "asked")
    met = held.select("*", F.explode("sources").alias("lead")).join(asked, "lead").where(F.size(F.array_except("_q.source", "sources")) == 0)
    score = lambda m: reduce(lambda a, i: a.when(m["step"] == i, LADDER[fields[i]]), range(1, len(fields)), F.when(m["step"] == 0, LADDER[fields[0]]))
    other = lambda m, kind: m["step"] == fields.index(kind)

    def shown(q: Column, m: Column) -> Column:
        field = reduce(lambda a, i: a.when(m["step"] == i, fields[i]), range(1, len(fields)), F.when(m["step"] == 0, fields[0]))
        term = F.when(other(m, "concept"), F.get(q["concepts"], m["way"])["name"]).otherwise(F.get(q["terms"], m["way"]))
        kind = F.when(other(m, "concept"), "concept").when(other(m, "expansion"), "queryExpansion").otherwise("direct")
        return F.struct(score(m).alias("score"), F.when(other(m, "expansion"), "synonym").otherwise(field).alias("field"), m["path"].alias("path"), term.alias("term"), kind.alias("kind"))

    hit = lambda q: F.element_at("ms", F.array_position("sources", q["source"]).cast("int"))
    pairs = F.transform("_q", lambda q: F.struct(q.alias("q"), hit(q).alias("m")))
    found = met.select("query", "key", "position", F.transform(pairs, lambda p: shown(p["q"], p["m"])).alias("matches"))
    total = F.aggregate("matches", F.lit(0), lambda a, m: a + m["score"])
    found = found.select("query", "key", "matches", F.array_distinct(F.transform("matches", lambda m: m["field"])).alias("matched_fields"), total.alias("total"), (total - F.col("position") / 10000).alias("score"))
    # a query without words is answered by every record: that many rows are its result
    empty = parsed.where(F.size("_clauses") == 0).select("query").crossJoin(index.records.select("key"))
    empty = empty.select("query", "key", F.array().cast(found.schema["matches"].dataType).alias("matches"), F.array().cast("array<string>").alias("matched_fields"), F.lit(0).alias("total"), F.lit(0.0).alias("score"))
    return found.unionByName(empty).withColumnRenamed("query", query_id)


def search_one(index: Index, query: str, lexicon: Lexicon = Lexicon()) -> DataFrame:
    """(key, matches, matched_fields, total, score) of one query: reads the folders of its grams only."""
    terms = [t for c in clauses(query, lexicon) for t in (c.source, *c.expansions)]
    return search_batch(index, index.spark.createDataFrame([(0, query)], "query int, text string"), "query", "text", lexicon, terms).drop("query")
