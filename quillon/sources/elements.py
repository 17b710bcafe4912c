"""A page as its elements: one pass gives each element's place, and questions about classes and parts are filters over the list."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from quillon.functions import text as T

#: open and close bound the element with its tags, start and end what is in it; depth counts the elements around it.
NODE = "tag string, classes array<string>, depth int, open int, start int, end int, close int"
SUBTREES = f"array<struct<html string, nodes array<struct<{NODE}>>>>"

_TAG = re.compile(r"<(/?)([a-zA-Z][\w:-]*)\b([^>]*)>")
_CLASS = re.compile(r"""\bclass=["']([^"']*)["']""", re.IGNORECASE)


def tree(page: str) -> list[tuple]:
    """Every element of a page that is closed, in the order of their opening tags: fields as in NODE.

    An element ends where as many of its own tag are closed as were opened since; others within may be left open. The
    page is read once, whatever its nesting.
    """
    found: list[list] = []
    opened: dict[str, list[int]] = defaultdict(list)
    for m in _TAG.finditer(page):
        tag = m[2].lower()
        if m[1]:
            if opened[tag]:
                node = found[opened[tag].pop()]
                node[5], node[6] = m.start(), m.end()
        elif not m[3].endswith("/"):
            classes = _CLASS.search(m[3])
            opened[tag].append(len(found))
            found.append([tag, classes[1].split() if classes else [], 0, m.start(), m.end(), -1, -1])
    around: list[int] = []
    out = []
    for node in found:
        if node[6] < 0:
            continue
        while around and around[-1] <= node[3]:
            around.pop()
        node[2] = len(around)
        # elements that overlap without one being in the other only count as around what they hold whole
        if not around or node[6] <= around[-1]:
            around.append(node[6])
        out.append(tuple(node))
    return out


def outermost(nodes: list[tuple]) -> list[tuple]:
    """Nodes that don't begin within an earlier one."""
    out, end = [], 0
    for n in nodes:
        if n[3] >= end:
            out.append(n)
            end = n[6]
    return out


def subtrees(tag: str | None = None, name: str | None = None) -> Callable[[Column], Column]:
    """A column function: the outermost elements of a tag, of a class, or both, each with its HTML and the elements in it, placed within that HTML."""

    @arrow_udf(SUBTREES)
    def all_of(pages: pa.Array) -> pa.Array:
        # flat columns with offsets: no object is made for a node
        roots, inner, named = [0], [0], [0]
        html: list[str] = []
        tags: list[str] = []
        classes: list[str] = []
        numbers: list[int] = []
        for page in pages:
            text = page.as_py() or ""
            nodes, at = tree(text), 0
            for root in outermost([n for n in nodes if (tag is None or n[0] == tag) and (name is None or name in n[1])]):
                begin, end = root[3], root[6]
                while nodes[at][3] < begin:
                    at += 1
                while at < len(nodes) and nodes[at][3] < end:
                    n = nodes[at]
                    if n[6] <= end:
                        tags.append(n[0])
                        classes += n[1]
                        named.append(len(classes))
                        numbers += (n[2] - root[2], n[3] - begin, n[4] - begin, n[5] - begin, n[6] - begin)
                    at += 1
                html.append(text[begin:end])
                inner.append(len(tags))
            roots.append(len(html))
        whole = np.array(numbers, dtype=np.int32).reshape(-1, 5)
        listed = lambda offsets, values: pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
        each = pa.StructArray.from_arrays([pa.array(tags, pa.string()), listed(named, pa.array(classes, pa.string())), *[pa.array(whole[:, i]) for i in range(5)]], ["tag", "classes", "depth", "open", "start", "end", "close"])
        return listed(roots, pa.StructArray.from_arrays([pa.array(html, pa.string()), listed(inner, each)], ["html", "nodes"]))

    return lambda page: all_of(page)


def within(nodes: Column, of: Column) -> Column:
    """The nodes in an element, itself included; none if it is null."""
    return T.let(of, lambda e: F.filter(nodes, lambda n: F.coalesce((n["open"] >= e["open"]) & (n["close"] <= e["close"]), F.lit(False))))


def of_class(nodes: Column, name: str) -> Column:
    """The outermost nodes of a class."""
    named = F.filter(nodes, lambda n: F.array_contains(n["classes"], name))
    return T.let(named, lambda every: F.filter(every, lambda n: ~F.exists(every, lambda o: (o["open"] < n["open"]) & (o["close"] > n["open"]))))


def of_tag(nodes: Column, tag: str) -> Column:
    return F.filter(nodes, lambda n: n["tag"] == tag)


def source(html: Column, node: Column) -> Column:
    """An element with its tags."""
    return T.let(node, lambda n: F.substring(html, n["open"] + 1, n["close"] - n["open"]))


def shown(html: Column, node: Column) -> Column:
    """The visible text of an element; null if there is none."""
    return T.visible_text(source(html, node))


def first(nodes: Column) -> Column:
    return F.get(nodes, 0)
