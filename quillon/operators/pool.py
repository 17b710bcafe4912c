"""The candidate pool: one Catalyst predicate from a bag of optional criteria."""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.conditions import State, none_fails
from quillon.functions.intervals import contains_any, overlaps_any, ranges_meet, remaining
from quillon.functions.text import normalize

#: Beyond so many ids an exclusion is a join.
LITERALS = 1000


@dataclass(frozen=True)
class Criteria:
    """What is None isn't asked. points: numbers, strings or (stage, round); ranges: pairs of points."""

    point: Any = None
    range: tuple[Any, Any] | None = None
    gold: float | None = None
    affordable_only: bool = True
    categories: Sequence[str] = ()
    variant_only: bool = False
    state: State | None = None
    reference_ranges: Sequence[tuple[Any, Any]] | None = None
    reference_from: Any = None
    excluded: Sequence[Any] = ()
    min_cost: float | None = None
    max_cost: float | None = None


@dataclass(frozen=True)
class Columns:
    """Where the pool finds its fields."""

    id: str = "id"
    category: str = "category"
    cost: str = "cost"
    least_gold: str | None = None
    ranges: str | None = None
    variant: str | None = None
    conditions: str | None = None
    extra: dict = field(default_factory=dict)


def point_of(p: Any) -> Column:
    if isinstance(p, Column):
        return p
    if isinstance(p, tuple):
        return F.struct(F.lit(p[0]).alias("stage"), F.lit(p[1]).alias("round"))
    return F.lit(p)


def affordable(gold: float, c: Columns) -> Column:
    """Enough gold for the stated minimum, else for the cost."""
    cost = F.col(c.cost)
    return F.lit(gold) >= (F.coalesce(F.col(c.least_gold), cost) if c.least_gold else cost)


def state_of(criteria: Criteria) -> dict | None:
    """A state exists if one is given or gold is; gold in the given one goes before."""
    if criteria.state is None and criteria.gold is None:
        return None
    return ({} if criteria.gold is None else {"gold": criteria.gold}) | dict(criteria.state or {})


def predicate(criteria: Criteria, c: Columns) -> Column | None:
    """All asked conditions together; null rows fail as SQL has it. Scalar parts reach the scan."""
    parts: list[Column] = []
    if criteria.excluded and len(criteria.excluded) <= LITERALS:
        parts.append(F.coalesce(~F.col(c.id).isin(*criteria.excluded), F.lit(True)))  # as the join has it: no id isn't an excluded one
    if criteria.categories:
        parts.append(F.col(c.category).isin(*criteria.categories))
    if criteria.min_cost is not None:
        parts.append(F.col(c.cost) >= criteria.min_cost)
    if criteria.max_cost is not None:
        parts.append(F.col(c.cost) <= criteria.max_cost)
    if criteria.gold is not None and criteria.affordable_only:
        parts.append(affordable(criteria.gold, c))
    if criteria.variant_only:
        parts.append(F.coalesce(F.col(c.variant), F.lit("")) != "")
    if criteria.point is not None:
        parts.append(contains_any(F.col(c.ranges), point_of(criteria.point)))
    if criteria.range is not None:
        parts.append(overlaps_any(F.col(c.ranges), *map(point_of, criteria.range)))
    if (state := state_of(criteria)) and c.conditions:
        parts.append(none_fails(F.col(c.conditions), state))
    if criteria.reference_ranges is not None:
        if not criteria.reference_ranges:
            parts.append(F.lit(False))
        else:
            windows = F.array(*[F.struct(point_of(a).alias("start"), point_of(b).alias("end")) for a, b in criteria.reference_ranges])
            if criteria.reference_from is not None:
                windows = remaining(windows, point_of(criteria.reference_from))
            parts.append(ranges_meet(F.col(c.ranges), windows))
    out = None
    for p in parts:
        out = p if out is None else out & p
    return out


def candidate_pool(records: DataFrame, criteria: Criteria, c: Columns = Columns()) -> DataFrame:
    """The records that meet all criteria. Works on streams too, as long as no id list needs a join."""
    if len(criteria.excluded) > LITERALS:
        ids = records.sparkSession.createDataFrame([(x,) for x in criteria.excluded], [c.id])
        records = exclude(records, ids, c.id)
        criteria = replace(criteria, excluded=())
    p = predicate(criteria, c)
    return records if p is None else records.where(p)


def exclude(records: DataFrame, ids: DataFrame, on: str | list[str]) -> DataFrame:
    return records.join(ids, on, "left_anti")


def named_like(name: str | Sequence[str], query: str, category: str | None = None, special_only: bool = False, c: Columns = Columns(), special: str = "has_special_rules") -> Column:
    """Index filter: the query's search form within any of the names, and category, and special rules only."""
    q = normalize_query(query)
    out = F.lit(True)
    if q:
        hits = [normalize(F.col(n)).contains(q) for n in ([name] if isinstance(name, str) else name)]
        any_hit = hits[0]
        for h in hits[1:]:
            any_hit = any_hit | h
        out = any_hit
    if category:
        out = out & (F.col(c.category) == category)
    return out & F.col(special) if special_only else out


def suggestions(records: DataFrame, name: str, query: str, order: str, n: int = 6) -> DataFrame:
    """The first n records by order whose name holds the query: an autocomplete."""
    return records.where(normalize(F.col(name)).contains(normalize_query(query))).orderBy(order).limit(n)


#: White space as in quillon.functions.text.WHITE.
WHITE_SPACE = re.compile("[\t\n\x0b\f\r \xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]+")


def normalize_query(text: str) -> str:
    """The search form of a query string, on the driver."""
    t = unicodedata.normalize("NFKC", text).lower()
    t = "".join(" " if unicodedata.category(ch)[0] in "PS" else ch for ch in t)
    return WHITE_SPACE.sub(" ", t).strip(" ")


# ---------------------------------------------------------------- forms to criteria


#: How a form may write a number: decimal digits with a fraction and an exponent, or whole ones in hexadecimal, octal or binary.
NUMBER = re.compile(r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|0[xX][0-9a-fA-F]+|0[oO][0-7]+|0[bB][01]+")


def form_number(text: str | None) -> float | None:
    """A finite number from 0 on; anything else is as if not asked. Digits are those of ASCII."""
    said = (text or "").strip()
    if not NUMBER.fullmatch(said):
        return None
    v = float(int(said, 0)) if said[:2].lower() in ("0x", "0o", "0b") else float(said)
    return v if math.isfinite(v) and v >= 0 else None


def form_point(text: str | None, playable: bool = True) -> tuple[int, int] | None:
    """`stage-round` in digits of ASCII, both from 1 on; a playable one is of stage 2 on, and of one of seven rounds."""
    m = re.fullmatch(r"([0-9]+)-([0-9]+)", (text or "").strip())
    if not m:
        return None
    stage, turn = int(m[1]), int(m[2])
    return (stage, turn) if stage >= 1 and turn >= 1 and (not playable or (stage >= 2 and turn <= 7)) else None


def form_range(start: str | None, end: str | None) -> tuple | None:
    a, b = form_point(start), form_point(end)
    return (a, b) if a and b and a <= b else None


def criteria_from_form(form: dict, reference: Sequence[tuple] | None = None) -> Criteria:
    """Criteria of a form's strings. An exact point suppresses the range; the reference's start is that point."""
    point = form_point(form.get("stage"))
    return Criteria(point=point, range=None if point else form_range(form.get("from"), form.get("to")), gold=form_number(form.get("gold")), affordable_only=form.get("affordable_only", True), categories=tuple(form.get("categories", ())), variant_only=form.get("variant_only", False), reference_ranges=reference, reference_from=point, excluded=tuple(form.get("excluded", ())), min_cost=form_number(form.get("min_cost")), max_cost=form_number(form.get("max_cost")))


def form_message(form: dict) -> str | None:
    """Advice only: a query still runs, without the fields that don't hold."""
    if form.get("stage") and not form_point(form["stage"]):
        return "the point can't be read"
    if (form.get("from") or form.get("to")) and not form_range(form.get("from"), form.get("to")):
        return "the range can't be read"
    bad = [k for k in ("gold", "min_cost", "max_cost") if form.get(k) and form_number(form[k]) is None]
    return f"not a number: {', '.join(bad)}" if bad else None


def form_rows(forms: DataFrame, key: str) -> DataFrame:
    """(key, point, span, gold, min_cost, max_cost, message): what each row of form strings comes to, read as criteria_from_form() does.

    forms: key and the form's strings by name; those that are not there, and nulls, are as if not asked. Points are shown as stage-round.
    """
    fields = [c for c in forms.columns if c != key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shown = lambda p: None if p is None else f"{p[0]}-{p[1]}"
        for b in batches:
            out = []
            for row in b.to_dict("records"):
                form = {f: row[f] for f in fields if isinstance(row[f], str)}
                c = criteria_from_form(form)
                out.append((row[key], shown(c.point), " to ".join(map(shown, c.range)) if c.range else None, c.gold, c.min_cost, c.max_cost, form_message(form)))
            yield pd.DataFrame(out, columns=[key, "point", "span", "gold", "min_cost", "max_cost", "message"])

    kind = forms.schema[key].dataType.simpleString()
    return forms.mapInPandas(run, f"{key} {kind}, point string, span string, gold double, min_cost double, max_cost double, message string")
