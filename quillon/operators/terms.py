"""Many terms and many patterns in one pass over a text.

Terms go into an Aho-Corasick automaton, so a text is read once however many there are. Of a pattern the automaton holds a literal
that every match has; the pattern itself is only tried where that literal occurs. The automaton is built in each worker from terms
that come with the task; their size is checked, and more than fit are dealt to several passes.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Sequence
from functools import reduce

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

#: Characters of all terms of one automaton, which takes some fifty times as many bytes in each worker.
MOST = 2_000_000

_BUILT: dict[tuple, tuple[ahocorasick.Automaton, list[int]]] = {}


def _automaton(terms: tuple[str, ...]) -> tuple[ahocorasick.Automaton, list[int]]:
    """The automaton of terms, kept in this worker, whose words have the numbers of the terms that are alike; and the numbers of empty terms."""
    if terms not in _BUILT:
        _BUILT.clear()
        alike: dict[str, list[int]] = defaultdict(list)
        for i, t in enumerate(terms):
            alike[t].append(i)
        empty = alike.pop("", [])
        automaton = ahocorasick.Automaton()
        for t, numbers in alike.items():
            automaton.add_word(t, tuple(numbers))
        automaton.make_automaton()
        _BUILT[terms] = automaton, empty
    return _BUILT[terms]


def _found(terms: tuple[str, ...], text: str | None) -> list[int]:
    automaton, empty = _automaton(terms)
    if text is None:
        return []
    return sorted({n for _, numbers in automaton.iter(text) for n in numbers}.union(empty) if len(automaton) else empty)


def contained(terms: Sequence[str]):
    """A column function: the numbers of the terms that a text contains, in order; an empty term is in every text, a null text has none."""
    fixed = tuple(terms)

    @pandas_udf("array<int>")
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: _found(fixed, t))

    return of


def parts(terms: Sequence[str], most: int = MOST) -> list[range]:
    """Runs of terms that fit one automaton."""
    out, start, size = [], 0, 0
    for i, t in enumerate(terms):
        if size + len(t) > most and i > start:
            out.append(range(start, i))
            start, size = i, 0
        size += len(t)
    return [*out, range(start, len(terms))] if terms else []


def hits(rows: DataFrame, text: Column, terms: Sequence[str], most: int = MOST) -> DataFrame:
    """rows once for each term that text contains, with its number as `term`. One pass, or one for each part of terms that are too many for one automaton."""
    out = [rows.withColumn("term", F.explode(contained([terms[i] for i in part])(text))).withColumn("term", F.col("term") + part.start) for part in parts(terms, most)]
    return reduce(DataFrame.unionByName, out) if out else rows.withColumn("term", F.lit(0)).where("false")


def listed(terms: DataFrame, most: int = 20 * MOST) -> list[str]:
    """The distinct terms of (term), in order; their size is asked for before they are collected."""
    distinct = terms.select("term").where("term <> ''").distinct()
    size = distinct.agg(F.sum(F.char_length("term"))).first()[0] or 0
    if size > most:
        raise ValueError(f"{size} characters of terms; {most} may be brought to the driver. Join a stored search index with them instead.")
    return sorted(r["term"] for r in distinct.collect())


# ---------------------------------------------------------------- literals of patterns


def _literals(pattern) -> list[str] | None:
    """Literals of which every match of a parsed pattern holds one; null if there is no such list."""
    from re import _constants as C

    best: list[str] | None = None

    def better(a: list[str] | None, b: list[str] | None) -> list[str] | None:
        worth = lambda x: min(map(len, x)) if x else 0
        return a if worth(a) >= worth(b) else b

    run = ""
    for op, value in [*pattern, (None, None)]:
        if op is C.LITERAL:
            run += chr(value)
            continue
        best, run = better(best, [run] if run else None), ""
        if op is C.SUBPATTERN:
            best = better(best, _literals(value[3]))
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and value[0] > 0:
            best = better(best, _literals(value[2]))
        elif op is C.BRANCH:
            each = [_literals(b) for b in value[1]]
            best = better(best, [x for e in each for x in e] if all(each) else None)
    return best


def heads(pattern: str) -> list[str] | None:
    """Literals, folded, of which every text that matches holds one when folded; null if the pattern has none, or isn't understood."""
    from re import _parser

    try:
        found = _literals(_parser.parse(pattern))
    except (re.error, OverflowError, RecursionError):
        return None
    return None if found is None else sorted({x.casefold() for x in found})


def tried(patterns: Sequence[str]):
    """A column function: the numbers of patterns that may match a text, in order: those of which a literal occurs, and those without one."""
    known = [heads(p) for p in patterns]
    always = [i for i, h in enumerate(known) if not h]
    literals = [(x, i) for i, h in enumerate(known) for x in h or ()]
    terms, owners = tuple(x for x, _ in literals), [i for _, i in literals]

    @pandas_udf("array<int>")
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [] if t is None else sorted({owners[n] for n in _found(terms, t.casefold())}.union(always)))

    return of
