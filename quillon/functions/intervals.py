"""Closed intervals over ordered points (numbers, times, or structs, which compare field by field)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def contains_any(ranges: Column, point: Column) -> Column:
    return F.exists(ranges, lambda r: (r["start"] <= point) & (point <= r["end"]))


def overlaps(a: Column, start: Column, end: Column) -> Column:
    return (a["start"] <= end) & (start <= a["end"])


def overlaps_any(ranges: Column, start: Column, end: Column) -> Column:
    return F.exists(ranges, lambda r: overlaps(r, start, end))


def ranges_meet(a: Column, b: Column) -> Column:
    """Whether any interval of one list overlaps any of the other."""
    return F.exists(a, lambda x: F.exists(b, lambda y: overlaps(x, y["start"], y["end"])))


def remaining(ranges: Column, point: Column) -> Column:
    """What of the intervals lies at or after a point: ended ones go, running ones start there."""
    return F.transform(F.filter(ranges, lambda r: r["end"] >= point), lambda r: F.struct(F.greatest(r["start"], point).alias("start"), r["end"].alias("end")))


def stage_ranges(text: Column, prefix: str = "", separator: str = "~") -> Column:
    """All `a-b ~ c-d` behind a label, as intervals of (stage, round); separator is a pattern for what stands between two points."""
    part = F.regexp_extract(text, f"{prefix}(.*)", 1) if prefix else text
    pattern = rf"(?i)(\d+)-(\d+)\s*{separator}\s*(\d+)-(\d+)"
    a, b, c, d = (F.transform(F.regexp_extract_all(part, F.lit(pattern), F.lit(i)), lambda v: v.try_cast("int")) for i in range(1, 5))
    point = lambda s, r: F.struct(s.alias("stage"), r.alias("round"))
    return F.transform(F.arrays_zip(a.alias("a"), b.alias("b"), c.alias("c"), d.alias("d")), lambda z: F.struct(point(z["a"], z["b"]).alias("start"), point(z["c"], z["d"]).alias("end")))


def stage_text(ranges: Column) -> Column:
    return F.array_join(F.transform(ranges, lambda r: F.format_string("%d-%d to %d-%d", r["start"]["stage"], r["start"]["round"], r["end"]["stage"], r["end"]["round"])), ", ")


def playable_round(text: Column, least_stage: int = 2, most_round: int = 7) -> Column:
    """`stage-round` as a point, or null if it isn't one that can be played."""
    stage = F.regexp_extract(text, r"^\s*(\d+)-(\d+)\s*$", 1).try_cast("int")
    round_ = F.regexp_extract(text, r"^\s*(\d+)-(\d+)\s*$", 2).try_cast("int")
    return F.when((stage >= least_stage) & round_.between(1, most_round), F.struct(stage.alias("stage"), round_.alias("round")))


def optional_number(text: Column) -> Column:
    """A finite number from 0 on in decimal digits, or null for anything else that a form may hold."""
    said = F.trim(text)
    v = F.when(said.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), said.try_cast("double"))
    return F.when((v >= 0) & (v < float("inf")) & ~F.isnan(v), v)
