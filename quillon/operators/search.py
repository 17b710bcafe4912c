"""Phrase-aware AND search with synonym expansion, a ladder of field scores, and evidence.

The lexicon and the query are small: clauses are built on the driver and compiled into column expressions,
so a search is one projection and one filter over the records, without a join.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from quillon.functions.text import STABLE, let, nfkc, nfkc_each, normalize, unlike
from quillon.operators.pool import WHITE_SPACE, normalize_query

#: What the search form makes a blank of: signs, and white space as it knows it, in runs.
SIGNS = r"[\p{P}\p{S}]"
BLANKS = r"(?:[\p{P}\p{S}]|(?U:[\s\uFEFF&&[^\u0085]]))+"
#: Scores of the steps of the ladder, the first that holds counts.
LADDER = {"nameExact": 1000, "namePrefix": 700, "name": 500, "effect": 300, "requirement": 220, "synonym": 140, "expansion": 140, "concept": 100}


@dataclass(frozen=True)
class Group:
    """Aliases that mean the same, with the concepts they stand for."""

    key: str
    aliases: tuple[str, ...]
    concepts: tuple[str, ...] = ()


@dataclass(frozen=True)
class Lexicon:
    groups: tuple[Group, ...] = ()
    concepts: tuple[tuple[str, str], ...] = ()  # key, label


@dataclass(frozen=True)
class Clause:
    source: str
    expansions: tuple[str, ...]
    concepts: tuple[str, ...] = ()


@dataclass(frozen=True)
class Surfaces:
    """Columns to search, in the order in which they win. names, effects: strings; the others: arrays of strings."""

    names: tuple[str, ...]
    effects: tuple[str, ...] = ()
    requirements: str | None = None
    synonyms: str | None = None
    concepts: str | None = None


def clauses(query: str, lexicon: Lexicon = Lexicon()) -> list[Clause]:
    """Words of the query; the longest phrase that the lexicon knows is one clause. Repeated words repeat."""
    meaning: dict[str, tuple[set[str], set[str]]] = {}
    entries = [(a, g.aliases, g.concepts) for g in lexicon.groups for a in g.aliases] + [(label, (label,), (key,)) for key, label in lexicon.concepts]
    for phrase, others, keys in entries:
        if form := normalize_query(phrase):
            terms, concepts = meaning.setdefault(form, (set(), set()))
            terms.update(t for o in others if (t := normalize_query(o)))
            concepts.update(k.strip() for k in keys if k.strip())
    by_first: dict[str, list[list[str]]] = {}
    for phrase in sorted(meaning, key=lambda p: (-len(p.split()), p)):
        by_first.setdefault(phrase.split()[0], []).append(phrase.split())
    words, out, at = normalize_query(query).split(), [], 0
    while at < len(words):
        found = next((p for p in by_first.get(words[at], ()) if words[at : at + len(p)] == p), None)
        if found:
            phrase = " ".join(found)
            terms, concepts = meaning[phrase]
            out.append(Clause(phrase, tuple(sorted(terms)), tuple(sorted(concepts))))
            at += len(found)
        else:
            out.append(Clause(words[at], (words[at],)))
            at += 1
    return out


def _indexed(records: DataFrame, s: Surfaces) -> DataFrame:
    """Search forms of all surfaces, each made once: as columns of a generator, which the optimizer doesn't inline into every test."""
    none = F.array().cast("array<string>")
    lists = {"_r": s.requirements, "_s": s.synonyms, "_c": s.concepts}
    plain = [nfkc(F.col(c)).alias(f"_x{i}") for i, c in enumerate((*s.names, *s.effects))]
    plain += [nfkc_each(F.coalesce(F.col(c), none)).alias(f"_x{n}") for n, c in lists.items() if c]
    composed = records.select("*", *plain)
    forms = [F.coalesce(normalize(F.col(f"_x{i}"), True), F.lit("")).alias(f"_n{i}" if i < len(s.names) else f"_e{i - len(s.names)}") for i in range(len(s.names) + len(s.effects))]
    forms += [(F.transform(F.col(f"_x{n}"), lambda x: normalize(x, True)) if c else none).alias(n) for n, c in lists.items()]
    return composed.select(*records.columns, F.inline(F.array(F.struct(*forms))))


def _first(tests: list[tuple[Column, Column]], score: int, field: str, term: str, kind: str) -> list[tuple[Column, Column]]:
    return [(test, F.struct(F.lit(score).alias("score"), F.lit(field).alias("field"), path.alias("path"), F.lit(term).alias("term"), F.lit(kind).alias("kind"))) for test, path in tests]


def match(clause: Clause, s: Surfaces) -> Column:
    """What the clause hits in a record of _indexed(): a struct, or null. The path of an element of a list ends in its number."""
    names = [(F.col(f"_n{i}"), F.lit(c)) for i, c in enumerate(s.names)]
    effects = [(F.col(f"_e{i}"), F.lit(c)) for i, c in enumerate(s.effects)]
    lists = [(F.col(c), p, f) for c, p, f in (("_r", s.requirements, "requirement"), ("_s", s.synonyms, "synonym")) if p]
    within = lambda column, t: F.exists(column, lambda x: x.contains(t))
    place = lambda column, path, t: F.concat(F.lit(f"{path}."), (F.array_position(F.transform(column, lambda x: x.contains(t)), True) - 1).cast("string"))
    t, steps = clause.source, []
    for field, test in (("nameExact", lambda x: x == t), ("namePrefix", lambda x: x.startswith(t)), ("name", lambda x: x.contains(t))):
        steps += _first([(test(x), p) for x, p in names], LADDER[field], field, t, "direct")
    steps += _first([(x.contains(t), p) for x, p in effects], LADDER["effect"], "effect", t, "direct")
    for column, path, field in lists:
        steps += _first([(within(column, t), place(column, path, t))], LADDER[field], field, t, "direct")
    for term in clause.expansions:
        if term != t:
            tests = [(x.contains(term), p) for x, p in [*names, *effects]] + [(within(c, term), place(c, p, term)) for c, p, _ in lists]
            steps += _first(tests, LADDER["expansion"], "synonym", term, "queryExpansion")
    if s.concepts:
        for key in clause.concepts:
            steps += _first([(F.array_contains("_c", normalize_query(key)), F.lit(s.concepts))], LADDER["concept"], "concept", key, "concept")
    out = F.when(*steps[0])
    for test, value in steps[1:]:
        out = out.when(test, value)
    return out


def search(pool: DataFrame, query: str, surfaces: Surfaces, lexicon: Lexicon = Lexicon(), order: str | None = None) -> DataFrame:
    """Records that every clause hits, with matches, matched_fields, total and score.

    total is the sum of the clauses' scores; score takes off order / 10000, as hits are reported. Rank by
    (total, order), which is the same order as long as positions differ by less than 200000. An empty
    query returns the pool with score 0.
    """
    built = clauses(query, lexicon)
    none = "array<struct<score:int,field:string,path:string,term:string,kind:string>>"
    if not built:
        return pool.withColumns({"matches": F.array().cast(none), "matched_fields": F.array().cast("array<string>"), "total": F.lit(0), "score": F.lit(0.0)})
    indexed = _indexed(pool, surfaces)
    hits = indexed.select("*", F.inline(F.array(F.struct(*[match(c, surfaces).alias(f"_m{i}") for i, c in enumerate(built)]))))
    all_hit = F.col("_m0").isNotNull()
    for i in range(1, len(built)):
        all_hit = all_hit & F.col(f"_m{i}").isNotNull()
    matches = F.array(*[F.col(f"_m{i}") for i in range(len(built))])
    total = F.aggregate("matches", F.lit(0), lambda a, m: a + m["score"])
    found = hits.where(all_hit).withColumn("matches", matches).withColumn("matched_fields", F.array_distinct(F.transform("matches", lambda m: m["field"]))).withColumn("total", total)
    found = found.withColumn("score", F.col("total") - (F.col(order) / 10000 if order else F.lit(0.0)))
    return found.select(*pool.columns, "matches", "matched_fields", "total", "score")


def ranked(hits: DataFrame, order: str, n: int | None = None) -> DataFrame:
    out = hits.orderBy(F.desc("total"), F.asc_nulls_last(order))
    return out if n is None else out.limit(n)


# ---------------------------------------------------------------- evidence


def normalized_with_map(raw: str) -> tuple[str, list[tuple[int, int]]]:
    """The search form, and for each of its characters the span of raw that it came from, in UTF-16 units.

    Marks go with their letter. If letter by letter gives another form than the whole text does, there are no spans.
    """
    import unicodedata

    units: list[tuple[str, int, int]] = []
    at = 0
    for ch in raw:
        n = 2 if ord(ch) > 0xFFFF else 1
        if units and unicodedata.category(ch)[0] == "M":
            units[-1] = (units[-1][0] + ch, units[-1][1], at + n)
        else:
            units.append((ch, at, at + n))
        at += n
    text, spans = [], []
    for unit, a, b in units:
        for ch in unicodedata.normalize("NFKC", unit).lower():
            blank = bool(WHITE_SPACE.match(ch)) or unicodedata.category(ch)[0] in "PS"
            if blank and text and text[-1] == " ":
                spans[-1] = (spans[-1][0], b)
            else:
                text.append(" " if blank else ch)
                spans.append((a, b))
    while text and text[0] == " ":
        text.pop(0), spans.pop(0)
    while text and text[-1] == " ":
        text.pop(), spans.pop()
    form = "".join(text)
    return (form, spans) if form == normalize_query(raw) else (normalize_query(raw), [])


def occurrences(raw: str, term: str) -> list[tuple[int, int]]:
    """Spans of raw, in UTF-16 units, whose search form is the term; they don't overlap."""
    form, spans = normalized_with_map(raw)
    if not term or not spans:
        return []
    units, out, at = raw.encode("utf-16-le"), [], form.find(term)
    while at >= 0:
        a, b = spans[at][0], spans[at + len(term) - 1][1]
        if normalize_query(units[2 * a : 2 * b].decode("utf-16-le", "replace")) == term:
            out.append((a, b))
        at = form.find(term, at + len(term))
    return out


@pandas_udf(ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType())])))
def _mapped_ranges(raw: pd.Series, term: pd.Series) -> pd.Series:
    """occurrences() for columns."""
    return pd.Series([[{"start": a, "end": b} for a, b in occurrences(r or "", t or "")] for r, t in zip(raw, term, strict=True)])


def _one_to_one(raw: Column) -> Column:
    """Whether each character of a text has one of the search form, before blanks are folded: NFKC leaves it, and its small letter is one character."""
    return ~raw.rlike(unlike(STABLE)) & (F.char_length(F.lower(raw)) == F.char_length(raw))


def _spelled(term: Column) -> Column:
    """The pattern of a term: its blanks are runs of blanks and signs."""
    return F.concat(F.lit(r"\Q"), F.replace(term, F.lit(" "), F.lit(rf"\E{BLANKS}\Q")), F.lit(r"\E"))


def _formed(term: Column) -> Column:
    """The term if it is in search form, else an empty one."""
    return F.when(term.rlike(rf"^ | $|  |{SIGNS}"), F.lit("")).otherwise(term)


def _plain_ranges(raw: Column, term: Column) -> Column:
    """The same for such a text, whose places are those of its small letters: a blank of the term is a run of blanks and signs there."""
    low, pattern = F.lower(raw), _spelled(term)
    hits = F.transform(F.regexp_extract_all(low, pattern, F.lit(0)), lambda h: F.char_length(h))
    between = F.transform(F.split(low, pattern, -1), lambda p: F.char_length(p))
    none = F.array().cast("array<struct<start:int,end:int>>")
    step = lambda a, z: F.struct((a["at"] + z["gap"] + z["hit"]).alias("at"), F.concat(a["out"], F.array(F.struct((a["at"] + z["gap"]).alias("start"), (a["at"] + z["gap"] + z["hit"]).alias("end")))).alias("out"))
    found = F.aggregate(F.arrays_zip(F.slice(between, 1, F.size(hits)).alias("gap"), hits.alias("hit")), F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda a: a["out"])
    return F.when((term != "") & (F.size(hits) > 0), found).otherwise(none)


def match_ranges(raw: Column | str, term: Column | str) -> Column:
    """Where a text's search form is the term, as (start, end) in UTF-16 units of the text; nulls have none. Only texts that aren't mapped one to one leave the JVM.

    The term is in search form; one that isn't is found nowhere.
    """
    raw, term = (F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in (raw, term))
    plain = _one_to_one(raw)
    return F.when(plain, _plain_ranges(raw, _formed(term))).otherwise(_mapped_ranges(F.when(~plain, raw), term))


def valid_ranges(text: Column, ranges: Column) -> Column:
    """The ranges that lie within the text and aren't empty."""
    n = F.length(F.encode(text, "UTF-16BE")) / 2
    return F.filter(ranges, lambda r: (r["start"] >= 0) & (r["start"] < r["end"]) & (r["end"] <= n))


def read_field(s: Surfaces, path: Column) -> Column:
    """The raw text that a match's path names; null for paths of concepts and unknown ones."""
    out = F.lit(None).cast("string")
    for c in (*s.names, *s.effects):
        out = F.when(path == c, F.col(c)).otherwise(out)
    for c in (s.requirements, s.synonyms):
        if c:
            place = F.regexp_extract(path, rf"^{c}\.(\d+)$", 1).try_cast("int")
            out = F.when(place.isNotNull(), F.get(F.col(c), place)).otherwise(out)
    return out


@pandas_udf(StringType())
def _mapped_surface(raw: pd.Series, term: pd.Series) -> pd.Series:
    def of(r: str | None, t: str | None) -> str | None:
        spans = occurrences(r, t or "") if r else None
        return r.encode("utf-16-le")[2 * spans[0][0] : 2 * spans[0][1]].decode("utf-16-le", "replace") if spans else None

    return pd.Series([of(r, t) for r, t in zip(raw, term, strict=True)], dtype=object)


def _plain_surface(raw: Column, term: Column) -> Column:
    """What the first of _plain_ranges() covers."""
    low, pattern = F.lower(raw), _spelled(term)
    hit = F.regexp_substr(low, pattern)
    return F.when((_formed(term) != "") & hit.isNotNull(), F.substring(raw, F.regexp_instr(low, pattern), F.char_length(hit)))


def first_surface(raw: Column, term: Column) -> Column:
    """The part of a raw text that the first of match_ranges() of the term covers, as it is written there; null without one."""
    # both arguments are made once, whatever they are made of
    plain = let(F.struct(raw.alias("raw"), term.alias("term")), lambda x: F.when(_one_to_one(x["raw"]), _plain_surface(x["raw"], x["term"])))
    return F.coalesce(plain, _mapped_surface(let(raw, lambda x: F.when(~_one_to_one(x), x)), term))


def reason(m: Column, s: Surfaces, labels: dict[str, str], fields: dict[str, str] | None = None) -> Column:
    """A match in words: the concept's label, or the text that was hit as it is written, after the label of its field."""
    names, shows = (F.create_map(*[F.lit(x) for kv in d.items() for x in kv]) if d else None for d in (labels, fields))

    def of(m: Column, surface: Column) -> Column:
        label = names[m["term"]] if labels else F.lit(None).cast("string")
        stem = F.regexp_replace(m["path"], r"\.\d+$", "")
        field = F.coalesce(shows[stem], F.lit("match")) if fields else stem
        shown = F.concat(F.when(m["kind"] == "queryExpansion", "related ").otherwise(""), field, F.lit(": "), F.coalesce(surface, m["term"]))
        return F.when(m["kind"] == "concept", F.concat(F.lit("concept: "), F.coalesce(label, m["term"]))).otherwise(shown)

    return let(F.struct(m.alias("m"), first_surface(read_field(s, m["path"]), m["term"]).alias("surface")), lambda x: of(x["m"], x["surface"]))
