"""Mixing sources to target weights by Sainte-Laguë apportionment; DataFrame functions only.

The words of all documents are the budget. Sources get targets by weight, none above MOST_REPEATS times its
own size. Targets are counted in blocks of BLOCK words: the blocks of the budget go to sources by the
highest quotients target / (2 k + 1), those of a source to its shards by the quotients of their sizes.
A shard is a part of one source, by a digest of doc_id; their number follows the source's own rows, so a small source
is one shard and no source of any size is in one task. Within a shard, documents stand in a seeded order and
form a ring of words, which is taken block by block from its start until the shard's quota is used up: all of it so many
times, then the first words once more. Blocks are real words all through: none is cut short at the ring's end.

What whole blocks leave of a source's target, half a block per source and shard at most, is added to or taken from the
quota of its largest shard in words, so that a source of any size gets its target to the word.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm.common import needs, table, written

BLOCK = 32
MOST_REPEATS = 3
#: Documents that a shard has at most, about, until a source has 16 ** MOST_DIGITS shards; from there on shards grow.
SHARD_DOCS = 4096
MOST_DIGITS = 4
#: Parts that each source's rows are dealt to when they learn the number of its shards.
PARTS = 256
WEIGHTS = (1, 2, 3)
SEED = "mix-1"

WORD = r"[^\x20\x09-\x0D]+"


def sainte_lague(parties: DataFrame, group: list[str], votes: str, seats: str, order: list[str]) -> DataFrame:
    """Adds `quota`: the seats (a whole number per group) shared by the highest quotients votes / (2 k + 1).

    Equal quotients go by `order`, which must tell parties apart. Instead of listing all seats, each party
    first gets its rounded share; that is off by half a seat a party at most, and the few quotients next to
    it decide on the rest: their number is in proportion to the number of parties.
    """
    w = Window.partitionBy(*group)
    p = parties.withColumn("_all", F.sum(votes).over(w)).withColumn("_n", F.count("*").over(w))
    p = p.withColumn("_x", F.when(F.col("_all") > 0, F.col(votes).cast("double") * F.col(seats) / F.col("_all")).otherwise(0.0)).withColumn("_r", F.floor(F.col("_x") + 0.5))
    p = p.withColumn("_k", F.col(seats) - F.sum("_r").over(w))
    reach = F.when((F.col("_k") == 0) | (F.col(votes) <= 0), 0).otherwise(F.ceil(F.col("_x") * (F.abs("_k") + F.col("_n")) / F.greatest(F.col(seats), F.lit(1))) + 1).cast("int")
    steps = F.when(reach > 0, F.sequence(F.lit(1), reach)).otherwise(F.array().cast("array<int>"))
    near = p.select(*group, *order, votes, "_r", "_k", F.explode(steps).alias("_j"))
    seat = F.when(F.col("_k") > 0, F.col("_r") + F.col("_j") - 1).otherwise(F.col("_r") - F.col("_j"))
    near = near.withColumn("_seat", seat).where("_seat >= 0").withColumn("_q", F.col(votes) / (2 * F.col("_seat") + 1))
    first = [F.when(F.col("_k") > 0, -F.col("_q")).otherwise(F.col("_q")), *order, "_j"]
    moved = near.withColumn("_rank", F.row_number().over(Window.partitionBy(*group).orderBy(*first))).where("_rank <= abs(_k)").groupBy(*group, *order).agg(F.sum(F.signum("_k")).cast("long").alias("_moved"))
    return p.join(moved, [*group, *order], "left").withColumn("quota", (F.col("_r") + F.coalesce("_moved", F.lit(0))).cast("long")).drop("_all", "_n", "_x", "_r", "_k", "_moved")


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """(no_source, source, source_size) of each source, with weight and target.

    Targets share all words by weight; what lies above most times a source's size is reshared by weight
    until none is above. That ends where target = min(most * size, level * weight) for the one level that
    uses up the budget; sources sorted by size / weight give it. One row per source goes through the window.
    """
    ranked = sources.withColumn("_i", F.row_number().over(Window.orderBy("no_source", "source")) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.pmod("_i", F.lit(len(weights))).cast("int") + 1))
    w = Window.orderBy(F.col("source_size") / F.col("weight"), "_i")
    before, after, whole = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(0, Window.unboundedFollowing), w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    full = F.coalesce(F.sum(most * F.col("source_size")).over(before), F.lit(0))
    level = (F.sum("source_size").over(whole) - full) / F.sum("weight").over(after)
    ranked = ranked.withColumn("_level", level).withColumn("_total", F.sum("source_size").over(whole))
    holds = F.when(most * F.col("source_size") >= F.col("_level") * F.col("weight"), F.col("_level"))
    ranked = ranked.withColumn("_level", F.first(holds, ignorenulls=True).over(whole))
    return ranked.withColumn("target", F.least((most * F.col("source_size")).cast("double"), F.coalesce(F.col("_level") * F.col("weight"), F.lit(0.0)))).drop("_level")


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, block: int = BLOCK, most: int = MOST_REPEATS, shard_docs: int = SHARD_DOCS, seed: str = SEED, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) of each row.

    Null, empty and blank texts have size 0 and are taken 0 times; a null source is a source of its own,
    the last; repeated rows are separate documents; very long texts are counted whole. taken is at most most * size. A source's
    taken words differ from its target by less than a word; only if its quotas reach most times a shard, they may fall short by
    half a block for each of its other shards. An empty table gives an empty table.
    """
    size = F.regexp_count(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")), F.lit(WORD)).cast("long")
    label = F.col(f"`{source}`").cast("string")
    sized = needs(docs, key, text, source).select(F.col(f"`{key}`").alias("doc_id"), label.isNull().alias("no_source"), F.coalesce(label, F.lit("")).alias("source"), size.alias("size"), F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")))).alias("mark"))
    sized = written(sized, "sized").withColumn("part", F.pmod(F.xxhash64("mark"), F.lit(PARTS)).cast("int"))
    digits = F.least(F.lit(MOST_DIGITS), F.greatest(F.lit(0), F.ceil(F.round(F.log(F.count("*") / shard_docs) / math.log(16), 9)))).cast("int")
    sources = sized.groupBy("no_source", "source").agg(F.sum("size").alias("source_size"), digits.alias("_digits"))
    # joined by source and part, so that no source's rows are joined in one task
    parts = sources.select("no_source", "source", "_digits", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"))
    dealt = sized.join(parts, ["no_source", "source", "part"]).withColumn("shard", F.expr("substring(mark, 1, _digits)")).drop("part", "_digits")
    by_shard = written(dealt.groupBy("no_source", "source", "shard").agg(F.sum("size").alias("shard_size")), "shards")
    targets = source_targets(sources.drop("_digits"), weights, most)
    targets = sainte_lague(targets.withColumn("_seats", F.floor(F.col("_total") / block + 0.5)).withColumn("_one", F.lit(0)), ["_one"], "target", "_seats", ["_i"])
    targets = targets.select("no_source", "source", "source_size", "target", F.col("quota").alias("_seats"))
    shards = sainte_lague(by_shard.join(targets, ["no_source", "source"]), ["no_source", "source"], "shard_size", "_seats", ["shard"])
    of = Window.partitionBy("no_source", "source")
    whole = F.least(F.col("quota") * block, most * F.col("shard_size"))
    largest = F.row_number().over(of.orderBy(F.desc("shard_size"), "shard")) == 1
    shards = shards.withColumn("_words", whole).withColumn("_rest", F.floor(F.col("target") + 0.5) - F.sum("_words").over(of))
    shards = shards.withColumn("_words", F.when(largest, F.greatest(F.lit(0), F.least(F.col("_words") + F.col("_rest"), most * F.col("shard_size")))).otherwise(F.col("_words")))
    shards = shards.withColumn("_times", F.when(F.col("shard_size") > 0, F.expr("_words div shard_size")).otherwise(0)).withColumn("_more", F.col("_words") - F.col("_times") * F.col("shard_size"))
    w = Window.partitionBy("no_source", "source", "shard").orderBy("mark", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = dealt.join(shards.select("no_source", "source", "shard", "source_size", "target", "_times", "_more"), ["no_source", "source", "shard"]).withColumn("_end", F.sum("size").over(w))
    once_more = F.greatest(F.lit(0), F.least(F.col("_end"), F.col("_more")) - (F.col("_end") - F.col("size")))
    return placed.select("doc_id", F.when(~F.col("no_source"), F.col("source")).alias("source"), "size", "source_size", "target", (F.col("_times") * F.col("size") + once_more).cast("long").alias("taken"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).drop("source")


QUERIES = {"op2_mix_sources": op2_mix_sources}


def _quotas(name: str, parties: str, group: str, votes: str, seats: str, order: str) -> str:
    """The same apportionment in SQL."""
    return f"""
{name}_x AS (SELECT *, CASE WHEN sum({votes}) OVER g > 0 THEN {votes}::DOUBLE * {seats} / sum({votes}) OVER g ELSE 0 END AS x, count(*) OVER g AS parties FROM {parties} WINDOW g AS (PARTITION BY {group})),
{name}_r AS (SELECT *, floor(x + 0.5)::BIGINT AS r, {seats} - sum(floor(x + 0.5)::BIGINT) OVER (PARTITION BY {group}) AS k FROM {name}_x),
{name}_q AS (SELECT *, unnest(range(1, CASE WHEN k = 0 OR {votes} <= 0 THEN 1 ELSE (ceil(x * (abs(k) + parties) / greatest({seats}, 1)) + 2)::BIGINT END)) AS j FROM {name}_r),
{name}_s AS (SELECT *, CASE WHEN k > 0 THEN r + j - 1 ELSE r - j END AS seat FROM {name}_q),
{name}_o AS (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY CASE WHEN k > 0 THEN -1 ELSE 1 END * ({votes} / (2 * seat + 1)), {order}, j) AS place FROM {name}_s WHERE seat >= 0),
{name}_m AS (SELECT {group}, {order}, sum(sign(k)) AS moved FROM {name}_o WHERE place <= abs(k) GROUP BY {group}, {order}),
{name} AS (SELECT a.*, (a.r + coalesce(m.moved, 0))::BIGINT AS quota FROM {name}_r a LEFT JOIN {name}_m m ON {' AND '.join(f'a.{c} = m.{c}' for c in f'{group}, {order}'.split(', '))})"""


ORACLE = {
    "op2_mix_sources": f"""
WITH sized AS (SELECT doc_id, source IS NULL AS no_source, coalesce(source, '') AS source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size, md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS mark FROM documents),
s00 AS (SELECT no_source, source, sum(size)::BIGINT AS source_size, least({MOST_DIGITS}, greatest(0, ceil(round(ln(count(*) / {SHARD_DOCS}) / ln(16), 9))))::BIGINT AS digits FROM sized GROUP BY no_source, source),
cut AS (SELECT z.*, substr(z.mark, 1, s.digits) AS shard FROM sized z JOIN s00 s ON s.no_source = z.no_source AND s.source = z.source),
by_shard AS (SELECT no_source, source, shard, sum(size)::BIGINT AS shard_size FROM cut GROUP BY ALL),
s0 AS (SELECT no_source, source, source_size, row_number() OVER (ORDER BY no_source, source) - 1 AS i FROM s00),
s1 AS (SELECT *, [{', '.join(map(str, WEIGHTS))}][(i % {len(WEIGHTS)}) + 1] AS weight FROM s0),
s2 AS (SELECT *, (sum(source_size) OVER () - coalesce(sum({MOST_REPEATS} * source_size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level, source_size / weight AS ratio FROM s1 WINDOW w AS (ORDER BY source_size / weight, i)),
s3 AS (SELECT *, (SELECT arg_min(level, (ratio, i)) FROM s2 WHERE {MOST_REPEATS} * source_size >= level * weight) AS chosen FROM s2),
s4 AS (SELECT no_source, source, source_size, i, 0 AS one, least({MOST_REPEATS} * source_size::DOUBLE, coalesce(chosen * weight, 0)) AS target, floor(sum(source_size) OVER () / {BLOCK} + 0.5)::BIGINT AS seats FROM s3),
{_quotas('sq', 's4', 'one', 'target', 'seats', 'i')},
p AS (SELECT b.*, q.source_size, q.target, q.quota AS seats FROM by_shard b JOIN (SELECT no_source, source, source_size, target, quota FROM sq) q ON q.no_source = b.no_source AND q.source = b.source),
{_quotas('pq', 'p', 'no_source, source', 'shard_size', 'seats', 'shard')},
b1 AS (SELECT no_source, source, shard, shard_size, source_size, target, least(quota * {BLOCK}, {MOST_REPEATS} * shard_size) AS words FROM pq),
b2 AS (SELECT *, floor(target + 0.5)::BIGINT - sum(words) OVER (PARTITION BY no_source, source) AS rest, row_number() OVER (PARTITION BY no_source, source ORDER BY shard_size DESC, shard) AS place FROM b1),
b3 AS (SELECT * REPLACE (CASE WHEN place = 1 THEN greatest(0, least(words + rest, {MOST_REPEATS} * shard_size)) ELSE words END::BIGINT AS words) FROM b2),
f AS (SELECT *, CASE WHEN shard_size > 0 THEN words // shard_size ELSE 0 END AS times, CASE WHEN shard_size > 0 THEN words % shard_size ELSE 0 END AS more FROM b3),
e AS (SELECT c.*, f.source_size, f.target, f.times, f.more, sum(c.size) OVER (PARTITION BY c.no_source, c.source, c.shard ORDER BY c.mark, c.doc_id, c.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS stop FROM cut c JOIN f ON f.no_source = c.no_source AND f.source = c.source AND f.shard = c.shard)
SELECT doc_id, size, source_size, target, (times * size + greatest(0, least(stop, more) - (stop - size)))::BIGINT AS taken FROM e
"""
}
