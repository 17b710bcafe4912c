"""Exact duplicates: Patricia tries own the texts, their terminal nodes the smallest identifiers.

1. Each task puts its texts, byte string by byte string, into a trie of its own. Copies meet there: a terminal counts them and
   keeps the smallest id. A document goes on as (id, number of its terminal), a text once per task, however many
   copies there are. When the trie holds more than HELD bytes, its largest subtree is written out and dropped; a
   text that comes again later just gets another terminal.
2. Terminals are dealt by length and content hash, so equal texts of all tasks meet, and arrive sorted by both. A trie over
   the full byte strings tells which are equal; each of its terminals owns those of the first step. It is bounded alike:
   past HELD bytes, subtrees go once the next hash begins, as no equal text can come any more.
3. Documents find their owner by the number of their terminal. That number is one task's, so a group with a third of
   all rows is spread over all tasks that read it, and needs no salt.

Texts are shuffled once per task that has them; ids and numbers are all else that moves.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import ARROW_BATCH_BYTES, bounded_batches, needs, table, written

#: Bytes of texts that a trie holds before it gives subtrees away.
HELD = 48 << 20
#: Bytes that a node takes besides its text, roughly.
NODE = 400

_BLANKS = bytes.maketrans(b"\x09\x0a\x0b\x0c\x0d", b"     ")
_SEVERAL = re.compile(b"  +")


def normalised(data: bytes | None) -> bytes:
    """UTF-8 with each run of `[\\x20\\x09-\\x0D]` as one space; null as an empty text."""
    data = (data or b"").translate(_BLANKS)
    return _SEVERAL.sub(b" ", data) if b"  " in data else data


class Node:
    """What leads here from the parent (label), the children by their first byte, and what ends here."""

    __slots__ = ("label", "children", "end")

    def __init__(self, label: bytes, end=None) -> None:
        self.label, self.children, self.end = label, {}, end


def _common(text: bytes, at: int, label: bytes) -> int:
    """How many bytes of label stand in text from at on."""
    if text.startswith(label, at):
        return len(label)
    low, high = 0, min(len(label), len(text) - at)  # low are common, high + 1 are not
    while low < high:
        middle = (low + high + 1) // 2
        if text[at + low : at + middle] == label[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


class Trie:
    """A radix trie of byte strings; every path without a branch is one label."""

    def __init__(self) -> None:
        self.root, self.held = Node(b""), NODE

    def terminal(self, text: bytes) -> Node:
        """The node where text ends, made if there is none; `end` is None until the caller sets it."""
        node, at = self.root, 0
        while at < len(text):
            child = node.children.get(text[at])
            if child is None:
                child = node.children[text[at]] = Node(text[at:])
                self.held += NODE + len(text) - at
                return child
            n = _common(text, at, child.label)
            if n < len(child.label):  # the label is cut where text leaves it
                fork = Node(child.label[:n])
                fork.children[child.label[n]] = child
                node.children[text[at]] = fork
                child.label = child.label[n:]
                child = fork
                self.held += NODE
            node, at = child, at + n
        return node

    @staticmethod
    def ends(node: Node, before: bytes = b"") -> Iterator[tuple[bytes, object]]:
        """(text, end) of all that ends at or below a node."""
        todo = [(node, before)]
        while todo:
            node, before = todo.pop()
            before += node.label
            if node.end is not None:
                yield before, node.end
            todo += [(c, before) for c in node.children.values()]

    @staticmethod
    def size(node: Node) -> int:
        todo, n = [node], 0
        while todo:
            node = todo.pop()
            n += NODE + len(node.label)
            todo += node.children.values()
        return n

    def spilled(self, most: int) -> Iterator[tuple[bytes, object]]:
        """What ends in the largest subtrees below the first branch, dropped one by one until at most `most` bytes are held."""
        top, before = self.root, b""
        while top.end is None and len(top.children) == 1:
            (top,) = top.children.values()
            before += top.label
        sizes = {first: self.size(c) for first, c in top.children.items()}
        for first in sorted(sizes, key=sizes.__getitem__, reverse=True):
            if self.held <= most:
                return
            self.held -= sizes[first]
            yield from self.ends(top.children.pop(first), before)
        if self.held > most:  # only the way to the branch is left
            if top.end is not None:
                yield before, top.end
            self.root, self.held = Node(b""), NODE


class _Rows:
    """Arrow batches of about a megabyte from single rows."""

    def __init__(self, schema: pa.Schema) -> None:
        self.schema, self.rows, self.bytes = schema, [], 0

    def add(self, row: tuple, size: int = 64) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.bytes += size
        if self.bytes > ARROW_BATCH_BYTES:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            columns = zip(*self.rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, self.schema.types, strict=True)], schema=self.schema)
        self.rows, self.bytes = [], 0


def _rank(key, at: int) -> tuple:
    """The order of rows in a group: by id, those without one last, then by place."""
    return (key is None, key, at)


def terminals(docs: DataFrame, held: int = HELD) -> DataFrame:
    """The first step over (key, text): rows of documents (key, at, number) and of terminals (also length, hash, digest, text, n).

    A terminal's key and at are those of its least document. `at` numbers rows, `number` terminals, over all tasks.
    """
    bounded_batches(docs.sparkSession)
    kind = docs.schema["key"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, at, schema = Trie(), TaskContext.get().partitionId() << 33, None

        def row(text: bytes, end: list) -> tuple:
            digest = hashlib.sha256(text)
            (_, key, place), number, n = end
            return key, place, number, len(text), int.from_bytes(digest.digest()[:8], "little", signed=True), digest.hexdigest(), text, n

        for batch in batches:
            if schema is None:
                schema = pa.schema([("key", batch.schema.field("key").type), ("at", pa.int64()), ("number", pa.int64()), ("length", pa.int64()), ("hash", pa.int64()), ("digest", pa.string()), ("text", pa.binary()), ("n", pa.int64())])
                out = _Rows(schema)
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                node = trie.terminal(normalised(text))
                if node.end is None:
                    node.end = [_rank(key, at), at, 1]
                else:
                    node.end[0] = min(node.end[0], _rank(key, at))
                    node.end[2] += 1
                yield from out.add((key, at, node.end[1], None, None, None, None, None))
                at += 1
                if trie.held > held:
                    for text, end in trie.spilled(held // 2):
                        yield from out.add(row(text, end), len(text))
        if schema is not None:
            for text, end in trie.ends(trie.root):
                yield from out.add(row(text, end), len(text))
            yield from out.rest()

    return docs.select("key", F.col("text").cast("binary").alias("text")).mapInArrow(run, f"key {kind.simpleString()}, at long, number long, length long, hash long, digest string, text binary, n long")


def owners(found: DataFrame, held: int = HELD) -> DataFrame:
    """The second step over rows of terminals: (number, keep_key, keep_at, group_size, digest) of each of them."""
    kind = found.schema["key"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, last, out = Trie(), None, None

        def rows(end: list) -> Iterator[tuple]:
            (_, key, place), size, digest, numbers = end
            return ((number, key, place, size, digest) for number in numbers)

        for batch in batches:
            if out is None:
                out = _Rows(pa.schema([("number", pa.int64()), ("keep_key", batch.schema.field("key").type), ("keep_at", pa.int64()), ("group_size", pa.int64()), ("digest", pa.string())]))
            for key, at, number, length, content, digest, text, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (length, content) != last and trie.held > held:
                    for _, end in trie.spilled(held // 2):
                        for row in rows(end):
                            yield from out.add(row)
                last = (length, content)
                node = trie.terminal(text)
                if node.end is None:
                    node.end = [_rank(key, at), n, digest, [number]]
                else:
                    node.end[0] = min(node.end[0], _rank(key, at))
                    node.end[1] += n
                    node.end[3].append(number)
        if out is not None:
            for _, end in trie.ends(trie.root):
                for row in rows(end):
                    yield from out.add(row)
            yield from out.rest()

    dealt = found.select("key", "at", "number", "length", "hash", "digest", "text", "n").repartition("length", "hash").sortWithinPartitions("length", "hash")
    return dealt.mapInArrow(run, f"number long, keep_key {kind.simpleString()}, keep_at long, group_size long, digest string")


def exact_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", held: int = HELD) -> DataFrame:
    """One row per row of docs: the key, keep_id (of the row that stays), group_size (long), kept (boolean), text_sha256 (of the normalised text).

    Texts are equal if they are once each run of `[\\x20\\x09-\\x0D]` is one space; null counts as empty. The row of the smallest
    key stays. Rows without key stay only if all of their group have none; of several rows of one key, or without
    key, one stays. So each group has one row that is kept. An empty table gives an empty table; other columns don't matter.
    """
    docs = needs(docs, key, text).select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    found = written(terminals(docs, held), "terminals")
    owned = owners(found.where("n is not null"), held)
    out = found.where("n is null").select("key", "at", "number").join(owned, "number")
    return out.select(F.col("key").alias(key), F.col("keep_key").alias("keep_id"), "group_size", (F.col("at") == F.col("keep_at")).alias("kept"), F.col("digest").alias("text_sha256"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op12_exact_dedup": op12_exact_dedup}

ORACLE = {
    "op12_exact_dedup": r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM t
"""
}
