"""Text functions: normal forms, keys, similarity, fingerprints, formatting. All but the Unicode normal forms are built-in expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x), where x is made once, however often f uses it. f has no Python functions."""
    return F.get(F.transform(F.array(x), f), 0)


#: Characters that NFKC leaves as they are, whatever stands beside them; a text of only these doesn't leave the JVM for it.
STABLE = r"\x00-\x7F\u00A1-\u00A7\u00A9\u00AB-\u00AE\u00B0\u00B1\u00B6\u00B7\u00BB\u00BF-\u0131\u0134-\u013E\u0141-\u0148\u014A-\u017E\u0400-\u0482\u048A-\u04FF\u2013\u2014\u2018\u2019\u201C\u201D\u20AC\u3041-\u3096\u30A1-\u30FA\u4E00-\u9FFF\uAC00-\uD7A3"


def unlike(stable: str) -> str:
    """A pattern for other characters; most are of ASCII, which it looks at first."""
    return rf"[[^\x00-\x7F]&&[^{stable}]]"


def _form(kind: str, stable: str):
    """A column function for a Unicode normal form; Spark has no expression for it. Texts of stable characters only don't leave the JVM."""

    def of(s: str | None) -> str | None:
        return None if s is None else unicodedata.normalize(kind, s)

    @pandas_udf(StringType())
    def one(x: pd.Series) -> pd.Series:
        return x.map(of)

    def column(x: Column) -> Column:
        return F.coalesce(one(F.when(x.rlike(unlike(stable)), x)), x)

    return column


nfkc, nfkd = _form("NFKC", STABLE), _form("NFKD", r"\x00-\x7F")


@pandas_udf(ArrayType(StringType()))
def _nfkc_each(x: pd.Series) -> pd.Series:
    return x.map(lambda v: None if v is None else [None if s is None else unicodedata.normalize("NFKC", s) for s in v])


def nfkc_each(x: Column) -> Column:
    """NFKC of each element of an array of strings."""
    return F.coalesce(_nfkc_each(F.when(F.exists(x, lambda s: s.rlike(unlike(STABLE))), x)), x)


#: White space as the search form knows it; a next-line mark is none.
WHITE = r"(?U)[\s\uFEFF&&[^\u0085]]+"


def normalize(x: Column, compatible: bool = False) -> Column:
    """Search form: NFKC, small letters, runs of punctuation and symbols as one space, white space folded and trimmed.

    compatible says that x is in NFKC already, as it must be within a lambda, where no Python runs. Null stays null.
    """
    x = x if compatible else nfkc(x)
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(x), r"[\p{P}\p{S}]+", " "), WHITE, " "))


def tokens(x: Column, distinct: bool = True) -> Column:
    """Words of the search form in order, by default each once; none for empty text."""
    words = F.filter(F.split(normalize(x), " "), lambda t: t != "")
    return F.array_distinct(words) if distinct else words


def name_key(x: Column, compatible: bool = False) -> Column:
    """Identity form of a name: small ASCII letters, digits and CJK ideographs only."""
    return F.regexp_replace(F.lower(x if compatible else nfkc(x)), r"[^a-z0-9㐀-鿿]", "")


def catalogue_key(x: Column, compatible: bool = False) -> Column:
    """Alignment form of a name: decomposed, so without accents, and without apostrophes; letters and digits of any script stay."""
    return F.regexp_replace(F.regexp_replace(F.lower(x if compatible else nfkd(x)), "[’']", ""), r"[^\p{L}\p{N}]", "")


def review_key(x: Column) -> Column:
    """Form of a review item's keys: composed, so accents stay; letters and digits of any script."""
    return F.regexp_replace(F.lower(nfkc(x)), r"[^\p{L}\p{N}]", "")


def canonical_text(x: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(nfkc(x))), r"[\p{P}\p{S}\s]+", "")


def stable_key(x: Column) -> Column:
    """First 16 digits of the SHA-256 of the text in NFKC with white space folded, in small letters."""
    return F.substring(F.sha2(F.lower(F.regexp_replace(F.trim(nfkc(x)), r"\s+", " ")), 256), 1, 16)


def slug(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(x), r"[^a-z0-9]+", "_"), "^_+|_+$", "")


def derived_id(own: Column, position: Column, name: Column) -> Column:
    """An id from a client id; else from the position and the name's slug, or its digest if that is empty."""
    fallback = F.concat(F.lit("snapshot_"), F.lpad(position.cast("string"), 3, "0"), F.lit("_"), F.coalesce(F.nullif(slug(name), F.lit("")), F.substring(F.sha2(name, 256), 1, 12)))
    return F.coalesce(F.nullif(slug(own), F.lit("")), fallback)


def variant_kind(x: Column) -> Column:
    low = F.lower(x)
    return F.when(low.contains("prismatic"), "prismatic").when(low.contains("upgrade"), "upgrade").otherwise("base")


def client_key(x: Column, prefixes: tuple[str, ...] = ("da_", "18_"), suffix: str = "18") -> Column:
    """Key of a base record's client id without namespace parts; null for variants and for nothing left."""
    key = F.lower(x)
    for p in prefixes:
        key = F.regexp_replace(key, f"^{p}", "")
    key = F.regexp_replace(F.regexp_replace(key, f"{suffix}$", ""), "[^a-z0-9]", "")
    return F.when(variant_kind(x) == "base", F.nullif(key, F.lit("")))


def client_family(x: Column) -> Column:
    return F.regexp_replace(x, "(?i)_(upgrade|prismatic)$", "")


def is_variant(x: Column) -> Column:
    return x.rlike("(?i)_(upgrade|prismatic)$")


def strip_tags(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, "<[^>]*>", ""))


def distinct_second(first: Column, second: Column) -> Column:
    """The second text without tags, if it says something else than the first; else null."""
    return F.when(strip_tags(second) != strip_tags(first), F.nullif(strip_tags(second), F.lit("")))


#: Named references in the order of their replacement; what an ampersand gives may begin another.
REFERENCES = (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"))


def _numbered(x: Column, mark: str, shown: str, digits: str, base: int) -> Column:
    """x with its numbered references decoded; numbers that no character has stay as they are."""
    parts = F.split(x, mark)
    number = lambda p: F.conv(F.regexp_extract(p, f"^0*({digits}{{1,8}});", 1), base, 10).try_cast("long")
    char = lambda p: F.decode(F.unhex(F.lpad(F.hex(number(p)), 8, "0")), "UTF-32")
    known = lambda p: p.rlike(f"^0*{digits}{{1,8}};") & (number(p) <= 0x10FFFF) & ~number(p).between(0xD800, 0xDFFF)
    rest = F.transform(F.slice(parts, 2, F.greatest(F.lit(0), F.size(parts) - 1)), lambda p: F.when(known(p), F.concat(char(p), F.regexp_replace(p, f"^{digits}+;", ""))).otherwise(F.concat(F.lit(shown), p)))
    return F.concat(F.get(parts, 0), F.array_join(rest, ""))


def decode_references(x: Column) -> Column:
    """Character references: decimal and hexadecimal numbers, then the named ones in order."""
    numbered = lambda x: let(_numbered(x, "&#(?![xX])", "&#", "[0-9]", 10), lambda y: _numbered(y, "(?i)&#x", "&#x", "[0-9a-fA-F]", 16))
    out = let(x, lambda x: F.when(x.contains("&#"), numbered(x)).otherwise(x))
    for a, b in REFERENCES:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def visible_text(x: Column) -> Column:
    """Text of a page: scripts and styles dropped, tags as spaces, references decoded, white space folded, none before punctuation."""
    out = F.regexp_replace(x, r"(?is)<(?:script|style)\b.*?</(?:script|style)>", "")
    out = decode_references(F.regexp_replace(out, r"(?s)<[^>]+>", " "))
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"(?U)\s+", " "), r" ([.,;:!?])", "$1"))


def bigrams(key: Column) -> Column:
    """The set of pairs of neighbouring characters; none for shorter texts, where a sequence would count down."""
    pairs = F.transform(F.sequence(F.lit(1), F.length(key) - 1), lambda i: F.substr(key, i, F.lit(2)))
    return F.when(F.length(key) >= 2, F.array_distinct(pairs)).otherwise(F.array().cast("array<string>"))


def dice(a: Column, b: Column) -> Column:
    """Dice similarity of two sets of bigrams; 0 when both are empty."""
    n = F.size(a) + F.size(b)
    return F.when(n > 0, 2.0 * F.size(F.array_intersect(a, b)) / n).otherwise(0.0)


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length; two empty texts are equal."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longer)


def fnv1a(x: Column) -> Column:
    """FNV-1a of 32 bits over code points, as eight hexadecimal digits."""
    code = F.aggregate(F.filter(F.split(x, ""), lambda c: c != ""), F.lit(2166136261).cast("long"), lambda h, c: F.pmod(F.pmod(h.bitwiseXOR(F.ascii(c).cast("long")), F.lit(1 << 32)) * F.lit(16777619).cast("long"), F.lit(1 << 32)))
    return F.lower(F.lpad(F.hex(code), 8, "0"))


def canonical_json(x: Column) -> Column:
    """A JSON text with the keys of its objects sorted at every depth; null if it isn't JSON."""
    return F.to_json(F.try_parse_json(x))


def canonical_map_json(x: Column) -> Column:
    """A map, whatever its values, as JSON with all keys sorted."""
    return canonical_json(F.to_json(x))


def utf16_length(x: Column) -> Column:
    return F.length(F.encode(x, "UTF-16BE")) / 2


def percent(p: Column) -> Column:
    """Two places below one per cent, else one; the rounding is half up on the printed value."""
    return F.concat(F.when((p > 0) & (p < 0.01), F.format_number(p * 100, 2)).otherwise(F.format_number(p * 100, 1)), F.lit("%"))


def percentages(x: Column) -> Column:
    """The numbers before per-cent signs."""
    return F.transform(F.regexp_extract_all(x, F.lit(r"(-?\d+(?:\.\d+)?)\s*%"), F.lit(1)), lambda v: v.cast("double"))


def placeholders(x: Column, values: Column) -> Column:
    """What `@Name@` and `@Name*100@` stand for: (name, display) by the map values; near-whole numbers are rounded."""
    names = F.regexp_extract_all(x, F.lit(r"@([A-Za-z][A-Za-z0-9_]*)\s*(?:\*\s*100)?@"), F.lit(1))
    times = F.regexp_extract_all(x, F.lit(r"@[A-Za-z][A-Za-z0-9_]*\s*(\*\s*100)?@"), F.lit(1))
    found = F.zip_with(names, times, lambda n, t: F.struct(n.alias("name"), F.element_at(values, n).alias("raw"), (t != "").alias("percent")))
    shown = lambda v: F.when(F.abs(v - F.round(v)) < 0.0001, F.round(v)).otherwise(F.round(v, 6))
    return F.transform(F.filter(found, lambda f: f["raw"].isNotNull()), lambda f: F.struct(f["name"].alias("name"), shown(f["raw"] * F.when(f["percent"], 100).otherwise(1)).alias("display"), F.when(f["percent"], "percent").otherwise("number").alias("unit")))


def proposition_key(kind: Column, operator: Column, value: Column, text: Column) -> Column:
    """A condition's key: from its structure where it has any, else from its text."""
    parts = F.concat_ws("|", F.concat(F.lit("type="), kind), F.concat(F.lit("operator="), operator), F.concat(F.lit("value="), value))
    return F.when(parts != "", F.concat(F.lit("structured-"), stable_key(parts))).otherwise(F.concat(F.lit("text-"), stable_key(text)))


def escape_html(x: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x
