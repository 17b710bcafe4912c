"""Joins of tables by overlapping intervals.

Every interval has a level, the power of two that its length fits into, and lies in two bins of that width at most. It is entered in
these, and asks the bins of all larger levels that the other side has. So each pair meets where the longer of the two is entered, in two by two
bins at most, and is kept in the first of them; neither a width nor the longest interval need be known. Levels below one at which no bin has more
than a few rows of the smaller side are raised to it, so rows are entered fewer times, and meet that many too many at most. Bins with very many rows
of one side are salted: those rows are dealt to several tasks, and the other side's are repeated in each.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators.saved import saved

#: Rows of one side in a bin from which they are dealt to several tasks.
HOT = 20_000
#: Rows of the smaller side that a bin may have at a level to which others are raised, and how many of the highest levels are tried.
FEW, TRIED = 32, 3


def point_number(p: Column) -> Column:
    """A point of (stage, round) as a number in the same order."""
    return p["stage"].cast("long") * (1 << 20) + p["round"].cast("long")


def _number(c: Column, kind: str) -> Column:
    """Numbers and times as whole numbers in the same order."""
    if kind.startswith("timestamp"):
        return F.unix_micros(c.cast("timestamp"))
    if kind == "date":
        return F.unix_date(c).cast("long")
    if kind.startswith("struct"):
        return point_number(c)
    return F.floor(c).cast("long")


def _sided(rows: DataFrame, start: str, end: str, side: str) -> DataFrame:
    """rows with their bounds as numbers, lower one first, and the level."""
    kind = rows.schema[start].dataType.simpleString()
    a, b = _number(F.col(start), kind), _number(F.col(end), kind)
    out = rows.where(F.col(start).isNotNull() & F.col(end).isNotNull()).withColumns({f"_{side}a": F.least(a, b), f"_{side}b": F.greatest(a, b)})
    length = (F.col(f"_{side}b") - F.col(f"_{side}a")).cast("double")
    return out.withColumn(f"_{side}level", F.ceil(F.log2(length + 1)).cast("int"))


def _entries(rows: DataFrame, side: str, levels: Sequence[int], own: bool) -> DataFrame:
    """rows once for each bin: at their own level, or at each of the other side's levels above it."""
    level = F.array(F.col(f"_{side}level")) if own else F.filter(F.array(*[F.lit(x) for x in levels]).cast("array<int>"), lambda x: x > F.col(f"_{side}level"))
    each = rows.withColumn("_level", F.explode(level))
    first, last = F.expr(f"shiftright(_{side}a, _level)"), F.expr(f"shiftright(_{side}b, _level)")
    return each.withColumn(f"_{side}first", first).withColumn("_bin", F.explode(F.sequence(first, last)))


def _base(rows: DataFrame, side: str, keys: Sequence[str], levels: Sequence[int]) -> int:
    """The highest level, of the first few, at which no bin has more than a few rows; the lowest one if there is none."""
    for level in sorted(levels, reverse=True)[:TRIED]:
        cells = rows.groupBy(*keys, F.shiftright(f"_{side}a", level).alias("_bin")).agg(F.count("*").alias("_n"))
        if (cells.agg(F.max("_n")).first()[0] or 0) <= FEW:
            return level
    return min(levels, default=0)


def _salted(left: DataFrame, right: DataFrame, cell: list[str], hot: int, crowds: DataFrame | None) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides' entries and the columns to join them by: of bins with many left rows also a salt: one of several for left rows, and all of these for right ones.

    crowds: the keys that have enough left rows for a bin of them to be crowded; without keys, null.
    """
    if crowds is not None and crowds.isEmpty():
        return left, right, cell
    counted = left if crowds is None else left.join(crowds, crowds.columns, "left_semi")
    crowded = counted.groupBy(*cell).agg(F.count("*").alias("_n")).where(F.col("_n") > hot).select(*cell, F.ceil(F.col("_n") / hot).cast("int").alias("_salts"))
    crowded = saved(crowded, "crowded")
    if crowded.isEmpty():
        return left, right, cell
    one = F.coalesce("_salts", F.lit(1))
    dealt = left.join(crowded, cell, "left").withColumn("_salt", F.pmod(F.col("_lid"), one).cast("int")).drop("_salts")
    repeated = right.join(crowded, cell, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), one - 1))).drop("_salts")
    return dealt, repeated, [*cell, "_salt"]


def overlapping(left: DataFrame, right: DataFrame, left_range: tuple[str, str], right_range: tuple[str, str], keys: Sequence[tuple[str, str]] = (), hot: int = HOT) -> DataFrame:
    """All pairs of rows whose closed intervals overlap and whose keys are equal, each once.

    left and right have no column in common; bounds are numbers, dates, times, or points of (stage, round), alike on both sides. Rows with a null
    bound or key meet nothing; an interval that ends before it starts meets what both of its bounds lie in. Repeated rows repeat.
    """
    a, b = left_range
    c, d = right_range
    known = lambda rows, side: reduce(lambda x, k: x.where(F.col(k[side]).isNotNull()), keys, rows)
    lefts = saved(_sided(known(left, 0), a, b, "l").withColumn("_lid", F.monotonically_increasing_id()), "left")
    rights = saved(_sided(known(right, 1), c, d, "r"), "right")
    # powers of two: a few dozen at most
    l_levels, r_levels = ([r[0] for r in rows.select(f"_{s}level").distinct().collect()] for rows, s in ((lefts, "l"), (rights, "r")))
    smaller = (lefts, "l", [k[0] for k in keys]) if lefts.count() < rights.count() else (rights, "r", [k[1] for k in keys])
    base = _base(*smaller, {*l_levels, *r_levels})
    lefts, rights = (rows.withColumn(f"_{s}level", F.greatest(f"_{s}level", F.lit(base))) for rows, s in ((lefts, "l"), (rights, "r")))
    l_levels, r_levels = (sorted({max(x, base) for x in levels}) for levels in (l_levels, r_levels))
    overlap = (F.col(a) <= F.col(d)) & (F.col(c) <= F.col(b)) & (F.col("_bin") == F.greatest("_lfirst", "_rfirst"))
    cell = ["_level", "_bin", *[f"_k{i}" for i in range(len(keys))]]
    named = lambda rows, side: rows.withColumns({f"_k{i}": F.col(k[side]) for i, k in enumerate(keys)}) if keys else rows
    crowds = saved(named(lefts, 0).groupBy(*cell[2:]).agg(F.count("*").alias("_n")).where(F.col("_n") > hot).select(*cell[2:]), "crowds") if keys else None
    out = None
    for l_own in (True, False):  # left rows of any level among right ones that are no longer, then the others
        if not l_own and max(r_levels, default=0) <= min(l_levels, default=0):
            continue  # no right row is longer than a left one
        l_entries = named(_entries(lefts, "l", r_levels, l_own), 0)
        r_entries = named(_entries(rights, "r", l_levels, True), 1)  # those of one level meet at first, once
        if l_own and max(l_levels, default=0) > min(r_levels, default=0):
            r_entries = r_entries.unionByName(named(_entries(rights, "r", l_levels, False), 1))
        dealt, repeated, by = _salted(l_entries, r_entries, cell, hot, crowds)
        met = dealt.join(repeated, by).where(overlap).select(*left.columns, *right.columns)
        out = met if out is None else out.unionByName(met)
    return out


def reference_pool(records: DataFrame, references: DataFrame, record: str, reference: str, ranges: str, windows: str, since: str | None = None) -> DataFrame:
    """(record, reference): records any of whose ranges overlaps any window of a reference, each pair once.

    ranges and windows are lists of (start, end); of windows only what remains from `since` on counts, if that column is given.
    A reference without windows, or none that remain, has no records.
    """
    each = records.select(record, F.inline(ranges).alias("_rs", "_re"))
    asked = references.select(reference, F.inline(windows).alias("_ws", "_we"), *([F.col(since).alias("_since")] if since else []))
    if since:
        asked = asked.where(F.col("_since").isNull() | (F.col("_we") >= F.col("_since"))).withColumn("_ws", F.greatest("_ws", "_since")).drop("_since")
    return overlapping(each, asked, ("_rs", "_re"), ("_ws", "_we")).select(record, reference).distinct()
