"""Conditions that are true, false or unknown; unknown is null. Also values that are known, unknown or confirmed.

A condition is a struct (type, operator, v_num, v_str, v_bool, v_arr, evaluable): its value lies in the one
column of its type. A state maps types to numbers, strings, booleans or lists of strings.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

State = Mapping[str, "int | float | str | bool | list[str]"]


def _compare(op: Column, a: Column, b: Column) -> Column:
    return F.when(op == "=", a == b).when(op == "!=", a != b)


def evaluate(r: Column, state: State) -> Column:
    """True, false or null (unknown): not for machines, no operator, nothing known of its type, or types that don't fit."""
    out = None
    for kind, actual in state.items():
        op = r["operator"]
        if isinstance(actual, bool):
            known = F.when(r["v_bool"].isNotNull(), _compare(op, F.lit(actual), r["v_bool"]))
        elif isinstance(actual, (int, float)):
            a, v = F.lit(float(actual)), r["v_num"]
            known = F.when(op == ">", a > v).when(op == ">=", a >= v).when(op == "<", a < v).when(op == "<=", a <= v).otherwise(_compare(op, a, v))
        elif isinstance(actual, str):
            known = F.when(op == "in", F.array_contains(r["v_arr"], actual)).otherwise(_compare(op, F.lit(actual), r["v_str"]))
        else:
            has = F.array_contains(F.array(*map(F.lit, actual)).cast("array<string>"), r["v_str"])
            known = F.when(op == "active", has).when(op == "inactive", ~has)
        hit = r["evaluable"] & (r["type"] == kind)
        out = F.when(hit, known) if out is None else out.when(hit, known)
    return F.lit(None).cast("boolean") if out is None else out


def none_fails(conditions: Column, state: State) -> Column:
    """Whether no condition is surely false; unknown ones don't reject, nor does a missing list."""
    return F.coalesce(~F.exists(conditions, lambda r: F.coalesce(~evaluate(r, state), F.lit(False))), F.lit(True))


def known_value(status: Column, value: Column, plain: Column | None = None) -> Column:
    """The value if confirmed, a plain one as it is; null if unknown. Keep status to tell these apart."""
    inner = F.when(status == "confirmed", value)
    return inner if plain is None else F.when(status.isNull(), plain).otherwise(inner)


#: The five buckets that a field's knowledge falls in.
BUCKETS = {"value": ("confirmed_value", "confirmed_null", "unknown", "legacy_value", "legacy_null"), "flag": ("confirmed_true", "confirmed_false", "unknown", "legacy_true", "legacy_false")}


def knowledge_state(status: Column, value: Column, plain: Column | None = None, present: Column | None = None, flag: bool = False) -> Column:
    """One of BUCKETS: confirmed by status; unknown by status, or because the field isn't there; else a plain (legacy) value or null.

    value: what a confirmed one says; plain: a bare value; present: whether a bare field is there at all, by default if it isn't null.
    flag: the value is a truth value, and null counts as false.
    """
    plain = F.lit(None) if plain is None else plain
    there = plain.isNotNull() if present is None else present
    names = BUCKETS["flag" if flag else "value"]
    holds = (lambda v: F.coalesce(v.cast("boolean"), F.lit(False))) if flag else (lambda v: v.isNotNull())
    return F.when(status == "confirmed", F.when(holds(value), names[0]).otherwise(names[1])).when((status == "unknown") | ~F.coalesce(there, F.lit(False)), names[2]).when(holds(plain), names[3]).otherwise(names[4])
