"""Phrases that stand together more often than their parts would: counted by suffix automata, scored at their weakest cut.

1. Texts become blocks, each of one language and of bounded size: the different words with their counts, and the
   texts as numbers of words, zero between pieces. Pieces never meet, so a long text may fill several blocks.
2. Words are summed over all blocks, and those that come often enough are handed back to each block that has them. Then
   pairs of neighbouring frequent words are summed and handed back alike. A phrase is no more frequent than its words and
   pairs, so nothing that can become a candidate is lost. A block gets what it has itself: no list of all words or pairs exists
   anywhere. Words and pairs travel as hashes of 48 bits; two that collide only let a rare one pass, as phrases are counted exactly.
3. What is left of a block are runs of words of which each neighbouring pair is frequent. The different runs, weighed by how often they come,
   go into a generalised suffix automaton; its states get their endpos counts along suffix links, and its paths of up
   to five words are the block's phrases. Counts of a phrase are summed over all blocks.
4. A phrase is subsumed if a longer one that holds it is as frequent. It is enough to look one word further: to the phrases whose
   suffix link leads to it when they lose their first word, and to those it leads to by one transition.

What is summed travels packed: a block sends one row to each part of the hash range in which it has something. There are CHUNKS parts or as many
as the number of words asks for, so that a part's rows fit one task; a hot word is one entry a block.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm.common import bounded_batches, mix, needs, table, written

LONGEST, AT_LEAST, SUBSUMES, TOP = 5, 100, 100, 2000
#: Bytes of text of a block, and of all blocks that a task keeps open.
BLOCK, OPEN = 8 << 20, 32 << 20
#: Words in one automaton; a block with more in its runs gets several, a longer run is cut.
STATES = 150_000
#: Bytes of a text that are split into words at once, cut between pieces.
SLICE = 1 << 20
#: Bits of the hashes that are dropped where words and pairs travel; more that collide only let more rare ones pass.
DROPPED = 16
#: Parts of the hash range at least, and words of all texts for each part.
CHUNKS, CHUNK_WORDS = 32, 2_000_000

_TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\x0a\x0b\x0c\x0d", b"abcdefghijklmnopqrstuvwxyz ..........")
_U = np.uint64


class _Block:
    """Numbers of words as they come; 0 stands between pieces."""

    def __init__(self) -> None:
        numbers = count()
        self.words: dict[bytes, int] = defaultdict(lambda: next(numbers))
        self.words[b"."]
        self.parts: list[np.ndarray] = []
        self.bytes = 0

    def add(self, data: bytes) -> None:
        tokens = data.replace(b".", b" . ").split()
        tokens.append(b".")
        self.parts.append(np.fromiter(map(self.words.__getitem__, tokens), np.int32, len(tokens)))
        self.bytes += len(data)


def _slices(data: bytes) -> Iterator[bytes]:
    """data in parts of about SLICE bytes, cut where a piece ends."""
    at = 0
    while len(data) - at > SLICE:
        cut = data.rfind(b".", at, at + SLICE)
        cut = data.find(b".", at + SLICE) if cut < 0 else cut
        if cut < 0:
            break
        yield data[at:cut]
        at = cut + 1
    yield data[at:]


def _zstd(data: bytes) -> bytes:
    return pa.compress(data, codec="zstd", asbytes=True)


def _planes(a: np.ndarray) -> bytes:
    """Numbers as their lowest bytes, then their next ones, and so on, compressed: small numbers take little."""
    return _zstd(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes())


def _unplaned(data: bytes, size: int, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data, decompressed_size=size * width, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, size).T).view(kind).ravel()


def blocks(texts: DataFrame) -> DataFrame:
    """(block, lang, n, words, words_size, counts, size, sequence) of (lang, text): words and sequence are compressed, with their bytes before; word 0 is the border of pieces."""
    bounded_batches(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = count(TaskContext.get().partitionId() << 33)
        opened: dict[str, _Block] = {}

        def closed(lang: str) -> pa.RecordBatch:
            block = opened.pop(lang)
            seq = np.concatenate(block.parts)
            counts = np.bincount(seq, minlength=len(block.words))
            counts[0] = 0
            names = b" ".join(block.words)
            columns = [[next(number)], [lang], [int(counts.sum())], [_zstd(names)], [len(names)], [counts], [len(seq)], [_planes(seq)]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["block", "lang", "n", "words", "words_size", "counts", "size", "sequence"])

        kinds = [pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.binary()]
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for part in _slices((text or b"").translate(_TABLE)):
                    opened.setdefault(lang, _Block()).add(part)
                    if opened[lang].bytes > BLOCK:
                        yield closed(lang)
                if sum(b.bytes for b in opened.values()) > OPEN:
                    yield closed(max(opened, key=lambda k: opened[k].bytes))
        for lang in list(opened):
            yield closed(lang)

    return texts.mapInArrow(run, "block long, lang string, n long, words binary, words_size long, counts array<long>, size long, sequence binary")


def _words(row: dict) -> list[bytes]:
    return pa.decompress(row["words"], decompressed_size=row["words_size"], codec="zstd", asbytes=True).split(b" ")


def _word_keys(words: list[bytes], lang: str) -> np.ndarray:
    seed = xxhash.xxh3_64_intdigest(lang.encode())
    return np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in words), np.uint64, len(words))


def _pair_keys(seq: np.ndarray, keys: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where, hash) of the neighbouring words that are both known."""
    at = np.flatnonzero(known[seq[:-1]] & known[seq[1:]])
    return at, mix(keys[seq[at]] * _U(0x9FB21C651E98DF25) + keys[seq[at + 1]]) >> _U(DROPPED)


_PACKED_DDL = "chunk int, block long, size long, keys binary, counts binary"
_PACKED = pa.schema([("chunk", pa.int32()), ("block", pa.int64()), ("size", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])


def _packed(block: int, keys: np.ndarray, counts: np.ndarray, chunks: int) -> pa.RecordBatch:
    """Rows of one block: its keys in order, in parts by their leading bits, with how often each comes."""
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order].astype(np.uint32)
    part = (keys >> _U(64 - DROPPED - chunks.bit_length() + 1)).astype(np.int64)
    edges = np.flatnonzero(np.diff(part)) + 1  # parts that the block has nothing in get no row
    rows = [(c, block, len(k), _planes(np.diff(k, prepend=_U(0))), _planes(n)) for c, k, n in zip(part[np.concatenate([[0], edges])].tolist(), np.split(keys, edges), np.split(counts, edges), strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), _PACKED.types, strict=True)], schema=_PACKED)


def frequent(packed: DataFrame, at_least: int) -> DataFrame:
    """(block, known): of packed rows, the keys of each block that come at_least times over all blocks, as bytes."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.to_pylist()
        keys = [np.cumsum(_unplaned(r["keys"], r["size"], np.uint64)) for r in rows]
        _, which = np.unique(np.concatenate(keys), return_inverse=True)
        sums = np.bincount(which, weights=np.concatenate([_unplaned(r["counts"], r["size"], np.uint32) for r in rows]))
        often = np.split((sums >= at_least)[which], np.cumsum([r["size"] for r in rows])[:-1])
        found = [(r["block"], k[o].tobytes()) for r, k, o in zip(rows, keys, often, strict=True) if o.any()]
        return pa.table({"block": pa.array([f[0] for f in found], pa.int64()), "known": pa.array([f[1] for f in found], pa.binary())})

    found = packed.groupBy("chunk").applyInArrow(run, "block long, known binary")
    # a block gets back no more than it sent
    return found.groupBy("block").agg(F.collect_list("known").alias("known"))


def _known(parts: list[bytes] | None) -> np.ndarray:
    return np.frombuffer(b"".join(parts or []), np.uint64)


def words(stored: DataFrame, chunks: int) -> DataFrame:
    """Packed rows of the words of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys = _word_keys(_words(row)[1:], row["lang"]) >> _U(DROPPED)
                if len(keys):
                    yield _packed(row["block"], keys, np.array(row["counts"][1:]), chunks)

    return stored.select("block", "lang", "words", "words_size", "counts").mapInArrow(run, _PACKED_DDL)


def pairs(stored: DataFrame, chunks: int) -> DataFrame:
    """Packed rows of the pairs of neighbouring known words of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys = _word_keys(_words(row), row["lang"])
                known = np.isin(keys >> _U(DROPPED), _known(row["known"]))
                known[0] = False
                found, n = np.unique(_pair_keys(_unplaned(row["sequence"], row["size"], np.int32), keys, known)[1], return_counts=True)
                if len(found):
                    yield _packed(row["block"], found, n, chunks)

    return stored.select("block", "lang", "words", "words_size", "size", "sequence", "known").mapInArrow(run, _PACKED_DDL)


class Automaton:
    """A generalised suffix automaton of sequences: states are classes of subsequences that end at the same places."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]

    def _state(self, length: int, moves: dict[int, int], link: int) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.count.append(0)
        return len(self.length) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        """The state of what q holds up to one more than p's length, taken out of q."""
        new = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = new
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def _extended(self, p: int, c: int) -> int:
        q = self.next[p].get(c)
        if q is not None:
            return q if self.length[q] == self.length[p] + 1 else self._split(p, q, c)
        new = self._state(self.length[p] + 1, {}, 0)
        while p != -1 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p != -1:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, c)
        return new

    def add(self, sequence: list[int], weight: int = 1) -> None:
        last = 0
        for c in sequence:
            last = self._extended(last, c)
            self.count[last] += weight

    def phrases(self, longest: int) -> Iterator[tuple[tuple[int, ...], int]]:
        """(subsequence of 2 to `longest` members, how often it comes), each once."""
        ends = list(self.count)
        for s in sorted(range(1, len(ends)), key=self.length.__getitem__, reverse=True):
            ends[self.link[s]] += ends[s]
        todo = [((c,), s) for c, s in self.next[0].items()]
        while todo:
            path, s = todo.pop()
            if len(path) > 1:
                yield path, ends[s]
            if len(path) < longest:
                todo += [((*path, c), t) for c, t in self.next[s].items()]


def _runs(seq: np.ndarray, at: np.ndarray) -> Counter:
    """The maximal runs in which every neighbouring pair is at a place of `at`, as bytes, with how often they come."""
    if not len(at):
        return Counter()
    border = np.flatnonzero(np.diff(at) != 1)
    starts, ends = at[np.concatenate([[0], border + 1])], at[np.concatenate([border, [len(at) - 1]])] + 2
    data = seq.tobytes()
    return Counter(data[4 * s : 4 * e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True))


def _pieces(run: list[int], n: int, longest: int) -> Iterator[tuple[list[int], int]]:
    """A run in parts of STATES words at most, with weights: parts overlap by one word less than a phrase may have, and what both hold is taken off once."""
    at = 0
    while len(run) - at > STATES:
        yield run[at : at + STATES], n
        at += STATES - longest + 1
        yield run[at : at + longest - 1], -n
    yield run[at:], n


def phrase_counts(stored: DataFrame, longest: int, at_least: int, chunks: int) -> DataFrame:
    """(lang, phrase, f) of stored blocks with known words and pairs: words and phrases that come at_least times over all blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words, seq = _words(row), _unplaned(row["sequence"], row["size"], np.int32)
                keys = _word_keys(words, row["lang"])
                known = np.isin(keys >> _U(DROPPED), _known(row["known"]))
                known[0] = False
                parts: dict[int, tuple[list, list]] = {}

                def add(phrase: bytes, n: int, parts=parts) -> None:
                    found, c = parts.setdefault(xxhash.xxh3_64_intdigest(phrase) % chunks, ([], []))
                    found.append(phrase)
                    c.append(n)

                for i in np.flatnonzero(known).tolist():
                    add(words[i], row["counts"][i])
                at, hashes = _pair_keys(seq, keys, known)
                at = at[np.isin(hashes, _known(row["pairs"]))]
                automaton, held = Automaton(), 0
                for run_, times in [*_runs(seq, at).items(), (b"", 0)]:
                    for piece, n in _pieces(np.frombuffer(run_, np.int32).tolist(), times, longest):
                        if held > STATES or not times:
                            for path, ends in automaton.phrases(longest):
                                add(b" ".join([words[i] for i in path]), ends)
                            automaton, held = Automaton(), 0
                        automaton.add(piece, n)
                        held += len(piece)
                rows = []
                for c, (found, n) in parts.items():
                    # in order, neighbours have their first words in common
                    order = sorted(range(len(found)), key=found.__getitem__)
                    listed = b"\n".join([found[i] for i in order])
                    rows.append((row["lang"], c, len(order), len(listed), _zstd(listed), _planes(np.array(n, dtype=np.int64)[order])))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["lang", "chunk", "n", "size", "phrases", "counts"])

    kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]

    def summed(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.to_pylist()
        listed = [pa.decompress(r["phrases"], decompressed_size=r["size"], codec="zstd", asbytes=True).split(b"\n") for r in rows]
        flat = pa.table({"phrase": pa.chunked_array([pa.array(x, pa.binary()) for x in listed]), "c": pa.chunked_array([pa.array(_unplaned(r["counts"], r["n"], np.int64)) for r in rows])})
        sums = flat.group_by("phrase").aggregate([("c", "sum")])
        sums = sums.filter(pc.greater_equal(sums["c_sum"], at_least))
        return pa.table({"lang": pa.array([key[0].as_py()] * len(sums), pa.string()), "phrase": sums["phrase"], "f": sums["c_sum"]})

    packed = stored.select("block", "lang", "words", "words_size", "counts", "size", "sequence", "known", "pairs").mapInArrow(run, "lang string, chunk int, n long, size long, phrases binary, counts binary")
    return packed.groupBy("lang", "chunk").applyInArrow(summed, "lang string, phrase binary, f long").select("lang", F.col("phrase").cast("string").alias("phrase"), "f")


def _joined(words: Column) -> Column:
    return F.array_join(words, " ")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, at_least: int = AT_LEAST, subsumes: int = SUBSUMES) -> DataFrame:
    """(lang, phrase, a, l, r, n, score): per language the phrases of 2 to `longest` words that come at least `at_least` times.

    Texts are lower-cased (A-Z), split at `[.,;:!?\\x0A-\\x0D]` into pieces and those into words `[^\\x20\\x09]+`. n is the number of
    words, a of the phrase, l and r of the parts of the cut with the lowest score floor(1000 a n / (l r)), ties to the shortest first part; occurrences within pieces,
    overlaps included. A phrase goes if a longer one that holds it comes at least `subsumes` hundredths as often. Arithmetic is in
    decimals of 38 digits. Texts that are null or empty have no words; a null language is `und`; repeated rows count each. A piece is held whole
    by one task. An empty table gives an empty table; other columns don't matter.
    """
    texts = needs(docs, lang, text).select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text}`").cast("string").cast("binary").alias("text"))
    stored = written(blocks(texts), "blocks")
    totals = stored.groupBy("lang").agg(F.sum("n").alias("n"))

    all_words = totals.agg(F.sum("n")).first()[0] or 0
    chunks = max(CHUNKS, 1 << (all_words // CHUNK_WORDS).bit_length())

    # blocks are moved to their lists by a merge at every size
    known = written(frequent(words(stored, chunks), at_least), "known")
    paired = frequent(pairs(stored.hint("merge").join(known, "block"), chunks), at_least).withColumnRenamed("known", "pairs")
    both = stored.hint("merge").join(known.join(paired, "block", "left"), "block")
    of = written(phrase_counts(both, longest, at_least, chunks), "phrases")
    found = of.withColumn("k", F.size(F.split("phrase", " "))).where("k > 1").withColumnRenamed("f", "a")
    word = F.split("phrase", " ")
    cuts = found.withColumn("w", word).select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", _joined(F.slice("w", 1, F.col("cut"))).alias("first"), _joined(F.slice("w", F.col("cut") + 1, longest)).alias("rest"))
    cuts = cuts.join(of.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"]).join(of.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"]).join(totals, "lang")
    score = F.expr("1000 * cast(a as decimal(38,0)) * n div (cast(l as decimal(38,0)) * r)")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "l", "r", "a", "n")).alias("m"))

    longer = found.where("k > 2").withColumn("w", word).select("lang", "a", F.explode(F.array(_joined(F.slice("w", F.lit(1), F.col("k") - 1)), _joined(F.slice("w", F.lit(2), F.col("k") - 1)))).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    left = best.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < subsumes * F.col("m.a")))
    return left.select("lang", "phrase", "m.a", "m.l", "m.r", "m.n", "m.score")


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.desc("score"), F.desc("a"), "phrase"]
    part = F.pmod(F.xxhash64("phrase"), F.lit(64))
    # the first of each part first, so that a language's last sort is of 64 times as many rows at most
    some = collocations(table(spark, sf_dir, "documents")).withColumn("rank", F.row_number().over(Window.partitionBy("lang", part).orderBy(*order))).where(F.col("rank") <= TOP)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= TOP)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


QUERIES = {"op13_phrase_collocations": op13_phrase_collocations}

#: All phrases of all pieces, with 128-bit arithmetic.
ORACLE = {
    "op13_phrase_collocations": r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents WHERE text IS NOT NULL),
words AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM words GROUP BY lang),
grams AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, range(1, 6) t(k))),
f AS (SELECT lang, k, phrase, count(*)::HUGEINT AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
cuts AS (SELECT c.lang, c.phrase, c.k, c.a, l.f AS l, r.f AS r, n, cut, (1000 * a * n) // (l.f * r.f) AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM c) c JOIN totals ON totals.lang = c.lang
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(w[1:cut], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(w[cut + 1:], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inside AS (SELECT DISTINCT lang, array_to_string(w[s:e], ' ') AS phrase, a FROM (SELECT lang, w, k, a, s, unnest(range(s + 1, k + 1)) AS e FROM (SELECT lang, w, k, a, unnest(range(1, k)) AS s FROM c)) WHERE e - s + 1 < k),
kept AS (SELECT * FROM best b WHERE NOT EXISTS (SELECT 1 FROM inside i WHERE i.lang = b.lang AND i.phrase = b.phrase AND 100 * i.a >= 100 * b.a))
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) WHERE rank <= 2000
"""
}
