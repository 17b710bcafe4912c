"""Main text of web pages, by differencing with the page of the nearest URL.

The pages of a host are ordered by their URL's path and query; each is paired with the page before or after it, whichever
has more leading segments (then characters) of the URL in common. Both pages' text lines (one per block
element) are aligned by a longest common subsequence; shared lines are what the site's template gave, and are
deleted. Exact copies on one host are one page.

A neighbour that shares nearly all of a page's undecided text may be another view of the same story (for print, with a
tracking parameter). It can't tell template from story; then only lines go that differing pages of the host have shown to be template,
where they stand in such a pair.

Every page goes through that; where it alone can't give the right text, markup corrects it. A line that no
other page has is still no text if it stands in an element whose name, role, class or id says menu, header,
footer, sidebar, notice, advert, form, script or comment; and a line that two articles share is text if it stands
inside <article> or <main>. All other lines are text if, and only if, differencing leaves them.
"""

from __future__ import annotations

import html as entities
import os.path
import re
from collections.abc import Collection, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import bounded_batches, needs, table, written

#: Share of a page's undecided characters from which a neighbour that has them too is taken for a view of the same story.
NEAR = 0.9
#: Cells of an alignment beyond which it is cut in halves of the first page.
CELLS = 200_000_000

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>|<[!?][^>]*>|<[!?/a-zA-Z][^>]*\Z""", re.DOTALL)
_ATTR = re.compile(r"""([a-zA-Z_:][-a-zA-Z0-9_:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_PART = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+")

RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("nav footer aside script style noscript template iframe svg canvas object button select textarea label legend output progress meter dialog menu head title audio video map datalist applet annotation annotation-xml".split())
BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
#: What an element's name may say; a name counts if all its parts are of these kinds or tell the place of a part.
NAMES = frozenset("nav navbar navigation menu submenu breadcrumb breadcrumbs masthead topbar footer bottombar sidebar rail widget widgets ad ads adv advert adverts advertisement advertising adslot adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations pagination pager disqus discussion reply replies respond toolbar copyright skip cta warning warnings taboola outbrain".split())
COMMENTS = frozenset("comment comments commentlist commenter commenters usercomments responses".split())
PLACES = frozenset("site page post entry article story content main body global primary secondary top bottom left right inner outer upper lower mobile desktop sticky fixed box block bar list item items link links area section container wrapper wrap row col unit slot text title heading panel module thread form count meta author user reader icon icons buttons group holder region zone posts articles stories".split())
#: Kinds that name an element as the last of its name's parts, whatever stands before: what is a vendor's ad is an ad.
THINGS = COMMENTS | frozenset("ad ads adv advert adverts advertisement advertising adslot sponsor sponsored promo promotion notice notices alert popup cookie cookies consent newsletter cta paywall".split())
#: Parts that tell that an element holds the content, whatever its other names say.
HOLDS = frozenset("content main article body post entry story page wrapper container layout".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An open element of the first kind ends where one of the second begins.
ENDS = {"li": {"li"}, "p": BLOCKS - {"br"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}

CONTENT, PLAIN, GONE = 2, 1, 0

Line = tuple[str, int]


def _says(name: str, kinds: frozenset) -> bool:
    """Whether a class or id is one of these kinds: as a whole, with nothing else in it but places, numbers and letters, or by the last thing it names."""
    parts = [p.lower() for p in _PART.findall(name)]
    here = [p in kinds for p in parts]
    rest = [not k and p not in PLACES and len(p) > 1 and not p.isdigit() for p, k in zip(parts, here, strict=True)]
    if not any(rest):
        return any(here)
    last = next((p for p in reversed(parts) if p in kinds or p not in PLACES and len(p) > 1 and not p.isdigit()), "")
    return last in kinds and last in THINGS


def _state(tag: str, attrs: str, above: int) -> int:
    """What the text of an element is: of the article, undecided, or dropped."""
    if above == GONE or tag in DROPPED:
        return GONE
    own = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(attrs)} if attrs.strip() else {}
    role = own.get("role", "").lower()
    if role in ROLES or "hidden" in own or own.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", own.get("style", "")):
        return GONE
    classes = own.get("class", "").split()
    ids = [] if tag in HEADINGS else own.get("id", "").split()
    if any(_says(n, COMMENTS) for n in classes + ids):
        return GONE
    if tag in ("article", "main") or role in ("main", "article"):
        return CONTENT
    if tag == "header" and above != CONTENT:
        return GONE
    if tag in ("html", "body"):
        return above
    if above != CONTENT:  # in an article a part's id is a name of its subject, as of a section "discussion"
        classes += ids
    gone = [n for n in classes if _says(n, NAMES) or above != CONTENT and _says(n, _HEADER)]
    return GONE if gone and not any(n not in gone and {p.lower() for p in _PART.findall(n)} & HOLDS for n in classes) else above


_HEADER = frozenset(["header"])
_FORM_END = re.compile(r"</?form\b", re.IGNORECASE)
_STORY = re.compile(r"<(?:article|main|h1)\b|role=[\"']?main\b", re.IGNORECASE)
_PARAGRAPH = re.compile(r"<p\b", re.IGNORECASE)
_FIELD = re.compile(r"""<(?:textarea|select)\b|<input\b(?![^>]*\btype\s*=\s*["']?(?:hidden|submit|button|image|reset)\b)""", re.IGNORECASE)


def _wraps(page: str, at: int) -> bool:
    """Whether a form that begins at a place is the frame of a story and not a thing to fill in: it has an article, a title, or three paragraphs and over two for each field."""
    end = _FORM_END.search(page, at)
    stop = end.start() if end else len(page)
    if _STORY.search(page, at, stop):
        return True
    paragraphs, fields = (sum(1 for _ in x.finditer(page, at, stop)) for x in (_PARAGRAPH, _FIELD))
    return paragraphs > 2 and paragraphs > 2 * fields


def lines(page: str) -> list[Line]:
    """A page's blocks of text in order, with what markup says of each; references decoded, white space folded."""
    out: list[Line] = []
    held: list[str] = []
    stack: list[tuple[str, int]] = []
    state, at, lower = PLAIN, 0, None

    def flush() -> None:
        if held:
            if text := " ".join("".join(held).split()):
                out.append((text, state))
            held.clear()

    def close(depth: int) -> None:
        nonlocal state
        flush()
        del stack[depth:]
        state = stack[-1][1] if stack else PLAIN

    while m := _TAG.search(page, at):
        if m.start() > at:
            held.append(entities.unescape(page[at : m.start()]))
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), -1)
            if depth >= 0 and (stack[depth][1] != state or tag in BLOCKS):
                close(depth)
            elif depth >= 0:
                del stack[depth:]
            elif tag in BLOCKS:
                flush()
            continue
        while stack and tag in ENDS.get(stack[-1][0], ()):
            close(len(stack) - 1)
        if tag in BLOCKS:
            flush()
        if tag in VOID:
            continue
        attrs = m[3] if m[2] else m[6]
        new = _state(tag, attrs or "", state)
        if tag == "form" and not _wraps(page, at):
            new = GONE
        if tag in RAW:
            lower = page.lower() if lower is None else lower
            end = lower.find(f"</{tag}", at) if len(lower) == len(page) else -1
            if end < 0:
                n = re.compile(f"</{tag}", re.IGNORECASE).search(page, at)
                end = n.start() if n else len(page)
            at = end
            if new == GONE:
                flush() if state != GONE else None
                continue  # its end tag finds no open element
        if (attrs or "").endswith("/") and tag not in BLOCKS:
            continue
        if new != state:
            flush()
        stack.append((tag, new))
        state = new
    if at < len(page):
        held.append(entities.unescape(page[at:]))
    flush()
    return out


def shared(a: Sequence, b: Sequence) -> set[int]:
    """Places in a of a longest common subsequence of a and b, by bit vectors over b."""
    start, end = 0, 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    while end < min(len(a), len(b)) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    out = {*range(start), *range(len(a) - end, len(a))}
    both = set(a[start : len(a) - end]) & set(b[start : len(b) - end])
    x = [i for i in range(start, len(a) - end) if a[i] in both]
    y = [j for j in range(start, len(b) - end) if b[j] in both]
    if not x or not y:
        return out
    if len(x) * len(y) > CELLS and len(x) > 1:
        return out | _halved([a[i] for i in x], [b[j] for j in y], x)
    places: dict = {}
    for k, j in enumerate(y):
        places[b[j]] = places.get(b[j], 0) | 1 << k
    full = (1 << len(y)) - 1
    v, rows = full, []
    for i in x:
        u = v & places[a[i]]
        v = ((v + u) | (v - u)) & full
        rows.append(v)
    i, j = len(x), len(y)
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
        else:
            i -= 1
            if not i or rows[i - 1] >> (j - 1) & 1:
                j -= 1
                out.add(x[i])
    return out


def _lengths(a: Sequence, b: Sequence) -> list[int]:
    """Length of the longest common subsequence of a and each prefix of b."""
    places: dict = {}
    for k, t in enumerate(b):
        places[t] = places.get(t, 0) | 1 << k
    full = (1 << len(b)) - 1
    v = full
    for t in a:
        u = v & places.get(t, 0)
        v = ((v + u) | (v - u)) & full
    out = [0]
    for k in range(len(b)):
        out.append(out[-1] + (not v >> k & 1))
    return out


def _halved(a: Sequence, b: Sequence, at: list[int]) -> set[int]:
    """The same for very long pages, by Hirschberg's halving: a in two parts, b cut where their lengths add up best."""
    half = len(a) // 2
    first, second = _lengths(a[:half], b), _lengths(a[half:][::-1], b[::-1])
    cut = max(range(len(b) + 1), key=lambda k: first[k] + second[len(b) - k])
    return {at[i] for i in shared(a[:half], b[:cut])} | {at[half + i] for i in shared(a[half:], b[cut:])}


def alike(sizes: Sequence[int], common: set[int]) -> bool:
    """Whether a neighbour with the lines at the places in common has nearly all undecided characters; sizes has none for other lines."""
    whole = sum(sizes)
    return whole > 0 and sum(sizes[i] for i in common) >= NEAR * whole


def main_text(page: list[Line], deleted: Collection[int]) -> str:
    """The lines that stay: lines of an article in any case, undecided ones if they aren't deleted; beside an article only if they are the longer part."""
    content = [i for i, (_, s) in enumerate(page) if s == CONTENT]
    kept = [i for i, (_, s) in enumerate(page) if s == PLAIN and i not in deleted]
    if content:
        length = lambda at: sum(len(page[i][0]) for i in at)
        kept = sorted(content + kept) if length(kept) > length(content) else content
    return " ".join(page[i][0] for i in kept)


#: A URL that begins with its host.
BARE = r"^(?:[a-zA-Z0-9-]+\.)+[a-zA-Z]{2,}(?::[0-9]+)?/|^www\.[^/?#]+"
_SEPARATORS = "\x01\x02\x03"


def nearness(a: str, b: str) -> tuple[int, int]:
    """How near two URLs of a host are: leading segments, then characters, in common."""
    same = os.path.commonprefix([a, b])
    return sum(map(same.count, _SEPARATORS)) + (a == b), len(same)


def neighbours(pages: DataFrame) -> DataFrame:
    """(host, mark, near, other): marks of the pages before and after each page in the order of host, url, mark; the nearer first.

    pages: (host, url, mark), distinct; urls have their separators replaced by _SEPARATORS, so that pages with leading
    segments in common are next to each other. All pages are sorted over all tasks, so no host is in one. A task
    knows the neighbours of its pages but for those of the first and the last; these, two a task, go through the driver.
    """
    columns = ["host", "url", "mark"]
    empty = {c: None for c in columns}

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, before, row = TaskContext.get().partitionId(), empty, None
        schema = pa.schema([("task", pa.int32()), ("first", pa.bool_()), ("last", pa.bool_()), *[(f"{side}{c}", pa.string()) for side in ("", "b_", "a_") for c in columns]])

        def linked(before: dict, row: dict, after: dict) -> dict:
            ends = {"task": task, "first": before["host"] is None, "last": after["host"] is None}
            return ends | {f"{side}{c}": r[c] for side, r in (("", row), ("b_", before), ("a_", after)) for c in columns}

        for batch in batches:
            out = []
            for after in batch.to_pylist():
                if row:
                    out.append(linked(before, row, after))
                    before = row
                row = after
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
        if row:
            yield pa.RecordBatch.from_pylist([linked(before, row, empty)], schema=schema)

    kinds = ", ".join(f"{side}{c} string" for side in ("", "b_", "a_") for c in columns)
    ordered = pages.select(*columns).repartitionByRange(*columns).sortWithinPartitions(*columns)
    linked = written(ordered.mapInArrow(link, f"task int, first boolean, last boolean, {kinds}"), "order")
    ends = linked.where("first or last").select("task", "first", "last", *columns).collect()  # two rows a task
    tasks = sorted({r["task"] for r in ends})
    firsts = {r["task"]: r.asDict() for r in ends if r["first"]}
    lasts = {r["task"]: r.asDict() for r in ends if r["last"]}
    before_task, after_task = dict(zip(tasks[1:], tasks, strict=False)), dict(zip(tasks, tasks[1:], strict=False))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                before = lasts.get(before_task.get(r["task"]), empty) if r["first"] else {c: r[f"b_{c}"] for c in columns}
                after = firsts.get(after_task.get(r["task"]), empty) if r["last"] else {c: r[f"a_{c}"] for c in columns}
                near = [x for x in (before, after) if x["host"] == r["host"]]
                if len(near) == 2 and nearness(r["url"], after["url"]) > nearness(r["url"], before["url"]):
                    near.reverse()
                marks = [x["mark"] for x in near] + [None, None]
                out.append({"host": r["host"], "mark": r["mark"], "near": marks[0], "other": marks[1]})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([(c, pa.string()) for c in ("host", "mark", "near", "other")]))

    return linked.mapInArrow(choose, "host string, mark string, near string, other string")


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, url, text, n_chars) of each row.

    Null, empty and blank pages, and pages without main text, have an empty text. Pages without a URL or with a relative one, and those alone on
    their host, have no neighbour: all their undecided lines stay. So do those of pages whose nearest is a view of the same story, but for
    lines that other pages of the host show to be template. A host is what stands behind `//`, or before the first slash of a URL without either if it ends like a domain. Repeated rows are each extracted; exact copies on a host have one
    text. Ties in nearness go to the page before. The text doesn't depend on how pages are dealt out. What is
    sorted and compared are 64-bit hashes of lines; what may be text of a page moves once, compressed, to meet what is to be
    deleted from it; of very many copies of one page Spark splits the join. Joins are by merging at every size. An empty table
    gives an empty table.
    """
    spark = pages.sparkSession
    bounded_batches(spark)
    u = F.coalesce(F.col(f"`{url}`").cast("string"), F.lit(""))
    full = F.when(u.rlike(BARE), F.concat(F.lit("//"), u)).otherwise(u)
    host = F.lower(F.regexp_extract(full, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", 1))
    path = F.translate(F.regexp_extract(full, r"^(?:[^:/?#]*:)?//[^/?#]*([^#]*)", 1), "/?&", _SEPARATORS)
    page = F.coalesce(F.col(f"`{html}`").cast("string"), F.lit(""))
    narrow = needs(pages, key, url, html).select(host.alias("host"), path.alias("path"), F.md5(page).alias("mark"), F.col(f"`{key}`").alias("key"), F.col(f"`{url}`").alias("url"), page.alias("html"))
    kinds = {f.name: f.dataType.simpleString() for f in narrow.schema}

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [lines(p.as_py()) for p in batch.column(3)]
            marks = [np.array([xxhash.xxh3_64_intdigest(t) for t, _ in x], dtype="<u8").tobytes() for x in own]
            sizes = [np.array([len(t) if state == PLAIN else 0 for t, state in x], dtype="<i4").tobytes() for x in own]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(marks, pa.binary()), pa.array(sizes, pa.binary())], names=["host", "url", "mark", "lines", "sizes"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for own, sizes, near in zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True):
                marks, sizes = np.frombuffer(own, dtype="<u8"), np.frombuffer(sizes, dtype="<i4").tolist()
                common = sorted(i for i in shared(marks.tolist(), np.frombuffer(near, dtype="<u8").tolist()) if sizes[i]) if near is not None else []
                out.append((common, marks.view(np.int64)[common].tolist(), alike(sizes, common)))
            columns = [pa.array([x[k] for x in out], t) for k, t in enumerate((pa.list_(pa.int32()), pa.list_(pa.int64()), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], names=["host", "mark", "places", "marks", "alike"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(3).compress
        for batch in batches:
            own = [lines(p.as_py()) for p in batch.column(4)]
            states = pa.array([bytes(state for _, state in x) for x in own], pa.binary())
            texts = pa.array([pack("\n".join(t if state else "" for t, state in x).encode()) for x in own], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], states, texts], names=["host", "mark", "key", "url", "states", "texts"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            texts = []
            for states, text, deleted in zip(*batch.columns[2:], strict=True):
                own = list(zip(unpack(text.as_py()).decode().split("\n"), states.as_py(), strict=False))
                texts.append(main_text(own, set(deleted.as_py() or ())))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string())], names=["key", "url", "text"])

    seen = narrow.where("host != ''").select("host", "path", "mark", "html").mapInArrow(hashed, "host string, url string, mark string, lines binary, sizes binary")
    seen = written(seen.groupBy("host", "mark").agg(F.min("url").alias("url"), F.min("lines").alias("lines"), F.min("sizes").alias("sizes")), "lines")
    own = seen.select("host", "mark", "lines", "sizes")
    found = neighbours(seen).select("host", "mark", "near").join(own.hint("merge"), ["host", "mark"])
    found = found.join(own.select("host", F.col("mark").alias("near"), F.col("lines").alias("near_lines")).hint("merge"), ["host", "near"], "left")
    found = written(found.select("host", "mark", "lines", "sizes", "near_lines").mapInArrow(compare, "host string, mark string, places array<int>, marks array<long>, alike boolean"), "shared")
    # lines that differing pages share; of pages that nearly are their neighbour's copy only these go
    template = found.where("not alike").select("host", F.explode("marks").alias("line")).distinct()
    asked = found.where("alike").select("host", "mark", F.inline(F.arrays_zip(F.col("places").alias("place"), F.col("marks").alias("line"))))
    shown = asked.join(template.hint("merge"), ["host", "line"]).groupBy("host", "mark").agg(F.collect_list("place").alias("places"))
    deleted = found.where("not alike and size(places) > 0").select("host", "mark", "places").unionByName(shown)
    kinds = f"key {kinds['key']}, url {kinds['url']}"
    moved = narrow.select("host", "mark", "key", "url", "html").mapInArrow(packed, f"host string, mark string, {kinds}, states binary, texts binary")
    done = moved.join(deleted.hint("merge"), ["host", "mark"], "left").select("key", "url", "states", "texts", "places").mapInArrow(finish, f"{kinds}, text string")
    return done.select(F.col("key").alias(key), "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


QUERIES = {"op1_html_extraction": op1_html_extraction}
ORACLE: dict[str, str] = {}
