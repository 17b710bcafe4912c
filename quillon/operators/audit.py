"""Counts and histograms over a catalogue: zeros kept, states told apart, verdicts from criteria."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.conditions import BUCKETS
from quillon.functions.text import normalize
from quillon.operators.concepts import FEW
from quillon.operators.pool import normalize_query
from quillon.operators.terms import hits


def counts_with_zeros(rows: DataFrame, value: Column, allowed: Sequence, name: str = "value") -> DataFrame:
    """(name, n, position) for each allowed value in its order, also those that no row has."""
    listed = rows.sparkSession.createDataFrame([(v, i) for i, v in enumerate(allowed)], [name, "position"])
    counted = rows.select(value.alias(name)).groupBy(name).agg(F.count("*").alias("n"))
    return listed.join(counted, name, "left").select(name, F.coalesce("n", F.lit(0)).alias("n"), "position")


def coverage(rows: DataFrame, **present: Column) -> DataFrame:
    """One row: all rows, and for each name how many meet its condition."""
    return rows.agg(F.count("*").alias("rows"), *[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in present.items()])


def non_empty(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit("")) != ""


def lower_bound(known: Column, unmatched: Column, incomplete: Column) -> Column:
    """Least size of a corpus: what is known, and what others have beyond the unmatched."""
    return known + F.greatest(F.lit(0), incomplete - unmatched)


def knowledge_histogram(rows: DataFrame, fields: dict[str, Column], flags: Sequence[str] = ()) -> DataFrame:
    """(field, state, n) of knowledge_state() columns, unpivoted in one pass; all five buckets of a field, also those without rows."""
    cells = F.array(*[F.struct(F.lit(n).alias("field"), state.alias("state")) for n, state in fields.items()])
    counted = rows.select(F.inline(cells)).groupBy("field", "state").agg(F.count("*").alias("n"))
    listed = rows.sparkSession.createDataFrame([(f, b) for f in fields for b in BUCKETS["flag" if f in flags else "value"]], "field string, state string")
    return listed.join(counted, ["field", "state"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def map_histogram(rows: DataFrame, provenance: Column, part: str) -> DataFrame:
    """(field, part, n) over the entries of a provenance map."""
    return rows.select(F.explode(provenance).alias("field", "source")).groupBy("field", F.col(f"source.{part}").alias(part)).agg(F.count("*").alias("n"))


def verdict(sums: DataFrame, criteria: dict[str, Column]) -> DataFrame:
    """(criterion, met) rows of one row of sums, with the verdict over all of them."""
    cells = F.array(*[F.struct(F.lit(n).alias("criterion"), F.coalesce(c, F.lit(False)).alias("met")) for n, c in criteria.items()])
    good = F.forall("cells", lambda x: x["met"])
    return sums.select(cells.alias("cells")).select(F.explode("cells").alias("c"), F.when(good, "ready").otherwise("blocked").alias("verdict")).select("c.criterion", "c.met", "verdict")


def occurrences(rows: DataFrame, text: Column, terms: Sequence[str]) -> DataFrame:
    """(term, n): rows whose search form holds the term; zeros kept. One pass over the rows; of more than FEW terms by an automaton."""
    form = normalize(text)
    if len(terms) > FEW:
        found = hits(rows.select(form.alias("_t")), F.col("_t"), [normalize_query(t) for t in terms]).groupBy("term").agg(F.count("*").alias("n")).withColumnRenamed("term", "_i")
        names = rows.sparkSession.createDataFrame(list(enumerate(terms)), "_i int, term string")
        return names.join(found, "_i", "left").select("term", F.coalesce("n", F.lit(0)).alias("n"))
    sums = rows.select(form.alias("_t")).agg(*[F.count_if(F.col("_t").contains(normalize_query(t))).alias(f"t{i}") for i, t in enumerate(terms)])
    return sums.select(F.inline(F.array(*[F.struct(F.lit(t).alias("term"), F.col(f"t{i}").alias("n")) for i, t in enumerate(terms)])))


def occurrence_list(rows: DataFrame, key: str, fields: dict[str, Column], terms: Sequence[str]) -> DataFrame:
    """(term, key, field) of each field whose search form holds a term: what occurrences() counts. Hits are exploded, not fields times terms."""
    forms = rows.select(key, *[normalize(c).alias(f"_f{i}") for i, c in enumerate(fields.values())])
    if len(terms) > FEW:
        each = forms.select(key, F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"_f{i}").alias("_t")) for i, f in enumerate(fields)])))
        names = rows.sparkSession.createDataFrame(list(enumerate(terms)), "term int, _name string")
        return hits(each, F.col("_t"), [normalize_query(t) for t in terms]).join(F.broadcast(names), "term").select(F.col("_name").alias("term"), key, "field")
    found = [F.when(F.col(f"_f{i}").contains(normalize_query(t)), F.struct(F.lit(t).alias("term"), F.lit(f).alias("field"))) for i, f in enumerate(fields) for t in terms]
    return forms.select(key, F.inline(F.array_compact(F.array(*found)))).select("term", key, "field")


def rules_summary(rows: DataFrame, special: str, category: str) -> DataFrame:
    """One row: records, those with special rules, and categories of these."""
    return rows.agg(F.count("*").alias("records"), F.count_if(F.coalesce(F.col(special), F.lit(False))).alias("special"), F.count_distinct(F.when(F.col(special), F.col(category))).alias("special_categories"))


def decision_summary(generated: DataFrame, decided: DataFrame, keys: list[str], action: str = "action") -> DataFrame:
    """One row: generated, decided, approved, rejected, modified, unreviewed and stale (decided but no longer generated)."""
    both = generated.select(*keys).distinct().withColumn("_g", F.lit(True)).join(decided.select(*keys, action).withColumn("_d", F.lit(True)), keys, "full_outer")
    g, d = F.col("_g").isNotNull(), F.col("_d").isNotNull()
    return both.agg(F.count_if(g).alias("generated"), F.count_if(d).alias("decided"), *[F.count_if(g & d & (F.col(action) == a)).alias(a) for a in ("approved", "rejected", "modified")], F.count_if(g & ~d).alias("unreviewed"), F.count_if(d & ~g).alias("stale"))


def latest(rows: DataFrame, stamp: Column) -> DataFrame:
    return rows.agg(F.max(F.try_to_timestamp(stamp)).alias("latest"))


def ledger(sums: DataFrame, entries: Sequence[tuple[str, str, bool, Column]]) -> DataFrame:
    """(kind, severity, blocks, n, resolution) rows from one row of sums; what has no rows is resolved."""
    cells = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(s).alias("severity"), F.lit(b).alias("blocks"), n.cast("long").alias("n")) for k, s, b, n in entries])
    return sums.select(F.inline(cells)).withColumn("resolution", F.when(F.col("n") > 0, "needs_review").otherwise("resolved"))
