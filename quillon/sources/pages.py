"""Extraction from saved pages: embedded JSON, nested elements, rendered cards, keyed de-duplication."""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from quillon.functions import intervals as I
from quillon.functions import text as T
from quillon.sources import elements as E

_PAYLOAD = re.compile(r"""<script\b[^>]*?(?:type=["']application/(?:ld\+)?json["']|id=["']__NEXT_DATA__["'])[^>]*>(.*?)</script>""", re.DOTALL | re.IGNORECASE)
_ATTRIBUTE = re.compile(r"""data-record=(?:"([^"]*)"|'([^']*)')""")


def balanced(text: str, at: int) -> str | None:
    """The JSON value that starts with a bracket at `at`, up to the bracket that closes it; strings are skipped."""
    depth, quoted, i = 0, False, at
    while i < len(text):
        ch = text[i]
        if quoted:
            i += ch == "\\"
            quoted = ch != '"'
        elif ch == '"':
            quoted = True
        elif ch in "{[":
            depth += 1
        elif ch in "}]":
            depth -= 1
            if not depth:
                return text[at : i + 1]
        i += 1
    return None


def payloads(page: str) -> list[str]:
    """JSON texts within a page: typed scripts, record attributes, and pieces pushed by scripts as escaped strings."""
    out = [m[1].strip() for m in _PAYLOAD.finditer(page)] + [html.unescape(m[1] or m[2] or "") for m in _ATTRIBUTE.finditer(page)]
    for m in re.finditer(r'\.push\(\[\d+,("(?:[^"\\]|\\.)*")\]\)', page):
        try:
            piece = json.loads(m[1])
        except ValueError:
            continue
        at = min((i for i in (piece.find("{"), piece.find("[")) if i >= 0), default=-1)
        if at >= 0 and (found := balanced(piece, at)):
            out.append(found)
    return out


def walk(value: object) -> Iterator[dict]:
    """Every object within a JSON value, outer ones first."""
    if isinstance(value, dict):
        yield value
        value = list(value.values())
    if isinstance(value, list):
        for v in value:
            yield from walk(v)


@pandas_udf(ArrayType(StringType()))
def embedded_objects(pages: pd.Series) -> pd.Series:
    """Every object of every JSON text in a page, each as JSON with sorted keys; what can't be parsed is left out."""

    def of(page: str | None) -> list[str]:
        out = []
        for text in payloads(page or ""):
            try:
                out += [json.dumps(o, sort_keys=True, ensure_ascii=False) for o in walk(json.loads(text))]
            except (ValueError, RecursionError):
                continue
        return out

    return pages.map(of)


_RECORD = StructType([StructField(n, StringType()) for n in ("source_key", "name", "effect", "category", "cost")])


def _said(obj: dict, keys: Sequence[str]) -> str | None:
    """The first of the keys that an object has with a value that isn't null or empty, as text."""
    for k in keys:
        v = obj.get(k)
        if v is not None and v != "":
            return v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)
    return None


@pandas_udf(StructType([StructField("objects", LongType()), StructField("records", ArrayType(_RECORD))]))
def _embedded(pages: pd.Series) -> pd.DataFrame:
    n, found = [], []
    for page in pages:
        objects, records = 0, []
        for text in payloads(page or ""):
            try:
                every = list(walk(json.loads(text)))
            except (ValueError, RecursionError):
                continue
            objects += len(every)
            records += [r for o in every if (r := {f: _said(o, KEYS[f]) for f in _RECORD.names})["name"] is not None]
        n.append(objects)
        found.append(records)
    return pd.DataFrame({"objects": n, "records": found})


def embedded_records(page: Column) -> Column:
    """(objects, records) of a page: how many objects its JSON texts hold, and which of these are records, as record_of() has it. Parsed once."""
    both = _embedded(page)
    cost = F.transform(both["records"], lambda r: r.withField("cost", r["cost"].try_cast("double")))
    kept = F.filter(cost, lambda r: r["effect"].isNotNull() | r["category"].isNotNull() | r["cost"].isNotNull())
    return F.struct(both["objects"].alias("objects"), kept.alias("records"))


def elements(page: str, name: str) -> list[str]:
    """Inner HTML of each element that has the class; what lies within a match is no match of its own."""
    return [page[n[4] : n[5]] for n in E.outermost([n for n in E.tree(page) if name in n[1]])]


def class_elements(name: str):
    """A column function: the inner HTML of elements of one class."""

    @pandas_udf(ArrayType(StringType()))
    def of(pages: pd.Series) -> pd.Series:
        return pages.map(lambda p: elements(p or "", name))

    return of


#: How a card writes its category, after how many shops it comes again, that it comes once, what stands within a window, what it asks for, and its two upgrades.
CATEGORY = (r"""(?i)\bdata-category=["']([^"']+)["']""", r"""(?i)\b(?:alt|title)=["'](Champion|Combat|Misc|Shop|Gold/?XP|Risky|Item)\s+[A-Za-z]+["']""")
COOLDOWN = r"(?i)(?:re-?offer(?:ed)?|offered again)[^\d]{0,40}(\d+)\s*shops?"
ONCE = r"(?i)\bonce per game\b"
BETWEEN = "(?:to|~|–|—)"
REQUIREMENTS = r"(?i)^Requirements\s*:\s*"
UPGRADES = {"blossom": ("upgrade-label", r"(?i)^Blossom Upgrade\s*:\s*"), "prismatic": ("prismatic-label", r"(?i)^Prismatic Blossom\s*:\s*")}


def _or_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def _strong(html: Column, nodes: Column, cell: Column) -> Column:
    """What a cell shows in bold, else all it shows."""
    bold = E.first(E.of_tag(E.within(nodes, cell), "strong"))
    return E.shown(html, F.coalesce(bold, cell))


def _unless_none(nodes: Column, others: Column) -> Column:
    """The nodes, or the others where there are none."""
    return T.let(nodes, lambda n: F.when(F.size(n) > 0, n).otherwise(others))


def _made(rows: DataFrame, **columns: Column) -> DataFrame:
    """rows with columns that are made once: by a generator, which the optimizer doesn't inline into each of their uses."""
    return rows.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def _upgrade(name: str, label: str, pattern: str) -> Column:
    """The upgrade line with the label, without it; where there is none, the paragraph behind the label."""
    html, inside, mark = F.col("html"), F.col("_inside"), F.col(f"_mark_{name}")
    labelled = lambda n: F.exists(inside, lambda x: F.array_contains(x["classes"], label) & (x["open"] >= n["open"]) & (x["close"] <= n["close"]))
    line = E.first(F.filter("_lines", lambda n: n["text"].rlike(pattern) | labelled(n)))["text"]
    behind = E.first(F.filter(inside, lambda n: (n["tag"] == "p") & (n["open"] >= mark["close"])))
    return T.let(line, lambda x: F.when(x.isNotNull(), _or_null(F.regexp_replace(x, pattern, ""))).otherwise(_or_null(E.shown(html, behind))))


def card_rows(pages: DataFrame, key: str, page: str, tag: str | None = "li", card: str | None = None, name: str = "name-cell", cost: str = "cost-cell", description: str = "description-cell", effect: str = "description", line: str = "upgrade-line", hint: str = "hint", windows: Sequence[str] = ("stage-info", "stage-cell")) -> DataFrame:
    """(key, position, name, cost, effect, blossom, prismatic, requirements, hints, windows, category, cooldown, once, ranges): rendered records of each page.

    A card is an outermost element of a tag, a class, or both that has a cell for the name and one for the description; it is a record
    if it shows a name and an effect. Name and cost are what their cells show in bold, or all of it; a cost of other than digits is null. The effect
    is one part of the description; upgrades and requirements stand in it behind their labels. Windows are read from the first of their classes that
    is there. A page is parsed once; null pages have no cards.
    """
    html, nodes, inside = F.col("html"), F.col("nodes"), F.col("_inside")
    c = pages.select(key, F.posexplode(E.subtrees(tag, card)(F.col(page))).alias("position", "_card")).select(key, "position", "_card.*")
    c = _made(c, **{n: E.first(E.of_class(nodes, k)) for n, k in (("_named", name), ("_cost", cost), ("_described", description))}).where("_named is not null and _described is not null")
    c = _made(c, _inside=E.within(nodes, F.col("_described")))
    times = E.of_class(nodes, windows[-1])
    for k in reversed(windows[:-1]):
        times = _unless_none(E.of_class(nodes, k), times)
    texts = lambda of: F.filter(F.transform(of, lambda n: E.shown(html, n)), lambda t: t != "")
    lines = F.transform(E.of_class(inside, line), lambda n: F.struct(n["open"].alias("open"), n["close"].alias("close"), E.shown(html, n).alias("text")))
    marks = {f"_mark_{u}": E.first(E.of_class(inside, label)) for u, (label, _) in UPGRADES.items()}
    effects = F.coalesce(E.shown(html, E.first(E.of_class(inside, effect))), F.lit(""))
    c = _made(c, _whole=T.visible_text(html), _price=_strong(html, nodes, F.col("_cost")), _lines=lines, hints=texts(E.of_class(inside, hint)), windows=texts(times), name=_strong(html, nodes, F.col("_named")), effect=effects, **marks).where("name <> '' and effect <> ''")
    asked = F.transform(F.filter("hints", lambda h: h.rlike(REQUIREMENTS)), lambda h: F.trim(F.regexp_replace(h, REQUIREMENTS, "")))
    category = F.coalesce(*[F.nullif(F.regexp_extract(html, p, 1), F.lit("")) for p in CATEGORY])
    return c.select(
        key, "position", "name", F.when(F.col("_price").rlike(r"^\d+$"), F.col("_price").try_cast("double")).alias("cost"), "effect", *[_upgrade(u, *UPGRADES[u]).alias(u) for u in UPGRADES],
        F.filter(asked, lambda h: h != "").alias("requirements"), "hints", "windows", category.alias("category"), F.regexp_extract("_whole", COOLDOWN, 1).try_cast("int").alias("cooldown"),
        F.when(F.col("_whole").rlike(ONCE), True).alias("once"), I.stage_ranges(F.array_join("windows", " "), separator=BETWEEN).alias("ranges"))


def titles(page: Column, name: str) -> Column:
    """Texts of elements of a class that hold no other element."""
    return F.regexp_extract_all(page, F.lit(rf"""class=["']{name}["'][^>]*>([^<]*)<"""), F.lit(1))


def marked_object(page: Column, marker: str) -> Column:
    """The innermost object around a key marker in escaped JSON, if the marker is there exactly once."""
    found = F.regexp_extract_all(page, F.lit(r"(\{[^{}]*" + marker + r"[^{}]*\})"), F.lit(1))
    return F.when(F.size(found) == 1, F.replace(F.element_at(found, 1), F.lit('\\"'), F.lit('"')))


#: Keys under which a record's parts may stand, the first that is there counts.
KEYS = {"name": ("name", "title", "displayName"), "effect": ("effect", "description", "desc"), "category": ("category", "type"), "cost": ("cost", "price"), "source_key": ("key", "id")}


def record_of(obj: Column) -> Column:
    """A JSON object, parsed once, as a record, or null: it needs a name, and an effect, a category or a cost."""
    parsed = F.from_json(obj, ", ".join(f"`{k}` string" for keys in KEYS.values() for k in keys))
    first = {n: F.coalesce(*[F.nullif(parsed[k], F.lit("")) for k in keys]) for n, keys in KEYS.items()}
    cost = first["cost"].try_cast("double")
    ok = first["name"].isNotNull() & (first["effect"].isNotNull() | first["category"].isNotNull() | cost.isNotNull())
    return F.when(ok, F.struct(first["source_key"].alias("source_key"), first["name"].alias("name"), first["effect"].alias("effect"), first["category"].alias("category"), cost.alias("cost")))


#: Where a page states its own address, by preference.
ADDRESSES = (r"""<link\b[^>]*rel=["']canonical["'][^>]*href=["']([^"']+)""", r"""<meta\b[^>]*property=["']og:url["'][^>]*content=["']([^"']+)""")


def canonical_url(page: Column) -> Column:
    return F.coalesce(*[F.nullif(F.regexp_extract(page, p, 1), F.lit("")) for p in ADDRESSES])


#: How a page says when it was updated.
UPDATED = r"(?i)(?:Updated|更新(?:日期|時間?)?)[：:\s]*([A-Za-z]+\s+\d{1,2},\s+\d{4}|\d{4}[-/.]\d{1,2}[-/.]\d{1,2})"


def page_facts(pages: DataFrame, key: str, page: str, declared: str | None = None) -> DataFrame:
    """(key, url, updated, declared, sha256): what a saved page says of itself, and the digest of all of it; null where it says nothing.

    declared is the pattern of the number of records, in its group. A null page has no digest.
    """
    p = F.col(page)
    said = F.regexp_extract(p, declared, 1).try_cast("long") if declared else F.lit(None).cast("long")
    return pages.select(key, canonical_url(p).alias("url"), F.nullif(F.regexp_extract(p, UPDATED, 1), F.lit("")).alias("updated"), said.alias("declared"), F.sha2(p, 256).alias("sha256"))


def import_problems(pages: DataFrame, records: DataFrame, key: str, page: str, identity: str, declared: str | None = None, name: str | None = None) -> DataFrame:
    """(key, problem) of saved pages that must not be imported: fail closed on any row.

    records: (key, ...), what was read from each page. wrong_identity: neither its canonical address nor its og:url matches the pattern;
    no_records: nothing was read; undeclared and count_mismatch: it doesn't state how many there are (the pattern's group), or another number;
    repeated_name: two of its records have one name, in any case (only with name, their column).
    """
    said = page_facts(pages, key, page, declared).select(key, F.col("url").alias("_url"), F.col("declared").alias("_said"))
    sums = [F.count("*").alias("_n"), *([F.count_distinct(F.lower(name)).alias("_names"), F.count(name).alias("_named")] if name else [])]
    both = said.join(records.groupBy(key).agg(*sums), key, "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    checks = [(~F.coalesce(F.col("_url").rlike(identity), F.lit(False)), "wrong_identity"), (F.col("_n") == 0, "no_records")]
    if declared:
        checks += [(F.col("_said").isNull(), "undeclared"), (F.col("_said") != F.col("_n"), "count_mismatch")]
    if name:
        checks.append((F.col("_names") != F.col("_named"), "repeated_name"))
    return both.select(key, F.explode(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(x)) for c, x in checks]))).alias("problem"))


def dedupe(rows: DataFrame, key: Column, prefer: Column, order: str) -> DataFrame:
    """One row per key: a preferred one, else the first by order. A minimum, combined before the shuffle."""
    keyed = rows.withColumn("_key", key)
    out = keyed.groupBy("_key").agg(F.min_by(F.struct(*rows.columns), F.struct((~F.coalesce(prefer, F.lit(False))).alias("later"), F.col(order).alias("order"))).alias("_row"))
    return out.select("_row.*")
