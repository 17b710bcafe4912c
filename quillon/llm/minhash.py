"""Near-duplicate documents by one-permutation hashing.

1. Every text becomes its set of word shingles, hashed to 64 bits, and from it `SEEDS` one-permutation
   sketches: the hash range is cut into BINS bins, each keeps its least hash, and an empty bin takes the
   value of a donor that a hash sequence of its own picks (optimal densification). Groups of ROWS
   neighbouring bins make buckets.
2. Documents with equal sets are one class; only one of them goes on.
3. In each bucket all classes point at its smallest member: a star, so that a bucket of n gives n - 1
   candidate edges. Edges are confirmed on the full sets. First each class tries its smallest centre;
   edges between classes that are then connected already needn't be tried.
4. A star misses links between two members that don't resemble its centre. So buckets whose members still
   lie in several components are looked at again: members outside a bucket's main component meet all others
   of their buckets, in blocks of bounded size; a task counts common shingles by an inverted index and
   returns the links it finds, never the pairs it tried.

Two sets of similarity 0.8 share no bucket with probability (1 - 0.8^8)^56 < 4e-5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import bounded_batches, mix, needs, table, word_hashes, written
from quillon.llm.components import components

SEEDS, BINS, ROWS = 4, 112, 8
#: Documents of the two sides that meet in one task when mixed buckets are looked at again.
BLOCK, CHUNK = 768, 512

_U = np.uint64
_FULL = _U(0xFFFFFFFFFFFFFFFF)


def _seed(i: int) -> np.uint64:
    return mix(np.array([i + 1], dtype=np.uint64))[0]


def _donors(rounds: int = 4096) -> np.ndarray:
    """donors[t, i]: the bin that empty bin i asks at its t-th try; at last all others in turn."""
    t, i = np.meshgrid(np.arange(rounds, dtype=np.uint64), np.arange(BINS, dtype=np.uint64), indexing="ij")
    picked = (mix(t * _U(BINS) + i + _U(0x51ED27)) >> _U(33)) % _U(BINS)
    turn = (np.arange(BINS)[:, None] + np.arange(BINS)[None, :]) % BINS
    return np.concatenate([picked.astype(np.int64), turn])


_DONORS = _donors()


def shingles(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles of a column of texts, sorted by row and hash.

    Words are `[^\\x20\\x09-\\x0D]+` with A-Z in lower case. A text of fewer words than a shingle has its
    whole sequence as its only one; null, empty and blank texts have none.
    """
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    # a blank after each text keeps words of neighbours apart
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    data = np.frombuffer(b" ".join([*texts.to_pylist(), b""]), dtype=np.uint8)
    begins = np.concatenate([[0], np.cumsum(sizes + 1)])
    h, starts, _ = word_hashes(data)
    if not len(h):
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
    row = np.searchsorted(begins, starts, side="right") - 1
    out = np.full(len(h), _U(words), dtype=np.uint64)
    full = np.zeros(len(h), dtype=bool)
    if len(h) >= words:
        n = len(h) - words + 1
        for k in range(words):
            out[:n] = mix(out[:n] * _U(0x9FB21C651E98DF25) + h[k : k + n])
        full[:n] = row[:n] == row[words - 1 :]
    first = np.concatenate([[True], row[1:] != row[:-1]])
    counts = np.diff(np.concatenate([np.flatnonzero(first), [len(h)]]))
    for at, n in zip(np.flatnonzero(first)[counts < words].tolist(), counts[counts < words].tolist(), strict=True):
        v = np.array([n], dtype=np.uint64)
        for k in range(n):
            v = mix(v * _U(0x9FB21C651E98DF25) + h[at + k])
        out[at], full[at] = v[0], True
    row, out = row[full], out[full]
    order = np.lexsort((out, row))
    row, out = row[order], out[order]
    keep = np.concatenate([[True], (row[1:] != row[:-1]) | (out[1:] != out[:-1])])
    return row[keep], out[keep]


def sketches(row: np.ndarray, h: np.ndarray, n_rows: int) -> np.ndarray:
    """The buckets of each row: n_rows by SEEDS * BINS / ROWS hashes. Rows without shingles get what nobody should use."""
    out = []
    for s in range(SEEDS):
        v = mix(h ^ _seed(s))
        bins = ((v >> _U(32)) * _U(BINS)) >> _U(32)
        least = np.full(n_rows * BINS, _FULL, dtype=np.uint64)
        np.minimum.at(least, row * BINS + bins.astype(np.int64), v)
        least = least.reshape(n_rows, BINS)
        filled = least != _FULL
        r, c = np.nonzero(~filled & filled.any(axis=1)[:, None])
        for ask in _DONORS:
            if not len(r):
                break
            d = ask[c]
            found = filled[r, d]
            least[r[found], c[found]] = least[r[found], d[found]]
            r, c = r[~found], c[~found]
        bands = least.reshape(n_rows, BINS // ROWS, ROWS)
        key = np.broadcast_to(mix(np.arange(BINS // ROWS, dtype=np.uint64) + _U(1000 * (s + 1))), bands.shape[:2]).copy()
        for k in range(ROWS):
            key = mix(key * _U(0x9FB21C651E98DF25) + bands[:, :, k])
        out.append(key)
    return np.concatenate(out, axis=1)


def signatures(docs: DataFrame, words: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n, lo, hi, buckets) of each row: size and 128-bit digest of its set, and its buckets (null without shingles)."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, h = shingles(batch.column(1), words)
            n = np.bincount(row, minlength=len(batch)).astype(np.int64)
            some = np.flatnonzero(n)
            at = np.concatenate([[0], np.cumsum(n[some])])[:-1]
            digest = np.zeros((2, len(batch)), dtype=np.uint64)
            if len(some):
                for k in range(2):
                    digest[k, some] = np.add.reduceat(mix(h ^ _seed(100 + k)), at)
            buckets = sketches(row, h, len(batch)).view(np.int64)
            width = buckets.shape[1]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1, dtype=np.int32) * width), pa.array(buckets.ravel()), mask=pa.array(n == 0))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), *(pa.array(d.view(np.int64)) for d in digest), lists], names=["doc_id", "n", "lo", "hi", "buckets"])

    narrow = needs(docs, key, text).select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, n long, lo long, hi long, buckets array<long>")


def confirmed(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union of their full sets. texts: (id, text)."""
    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("y")), "b").select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (r, g), (s, h) = shingles(batch.column(2), words), shingles(batch.column(3), words)
            size = lambda r: np.bincount(r, minlength=len(batch))
            row, v = np.concatenate([r, s]), np.concatenate([g, h])
            order = np.lexsort((v, row))
            row, v = row[order], v[order]
            twice = np.flatnonzero((row[1:] == row[:-1]) & (v[1:] == v[:-1])) if len(v) else []
            common = size(row[twice])
            union = size(r) + size(s) - common
            good = pa.array((union > 0) & (100 * common >= percent * union))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(good), batch.column(1).filter(good)], names=["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def hashed_sets(texts: DataFrame, words: int) -> DataFrame:
    """(id, set) of each row of (id, text): its distinct shingles as sorted 64-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, h = shingles(batch.column(1), words)
            at = np.searchsorted(row, np.arange(len(batch) + 1)).tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([h[i:j].tobytes() for i, j in zip(at, at[1:], strict=False)], pa.binary())], names=["id", "set"])

    return texts.select("id", "text").mapInArrow(run, "id long, set binary")


def _sets(column: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and hash of all elements, and the size of each row's set."""
    sizes = column.map(len).to_numpy(dtype=np.int64) // 8
    return np.repeat(np.arange(len(sizes)), sizes), np.frombuffer(b"".join(column), dtype=np.uint64), sizes


def _links_of_block(percent: int):
    """For a block of documents (role 0) and a chunk of others (role 1): one link to each component that a document links with."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        mine, others = rows[rows["role"] == 0], rows[rows["role"] == 1]
        row, h, sizes = _sets(mine["set"])
        order = np.argsort(h, kind="stable")
        row, h = row[order], h[order]
        vocabulary, first, n = np.unique(h, return_index=True, return_counts=True)
        other_row, other_h, other_sizes = _sets(others["set"])
        at = np.minimum(np.searchsorted(vocabulary, other_h), max(0, len(vocabulary) - 1))
        known = vocabulary[at] == other_h if len(vocabulary) else np.zeros(len(other_h), dtype=bool)
        other_row, at = other_row[known], at[known]
        ids, component = mine["id"].to_numpy(), mine["component"].to_numpy()
        seen, out = set(), []
        bounds = np.searchsorted(other_row, np.arange(len(others) + 1))
        for j, (b, c) in enumerate(zip(others["id"].tolist(), others["component"].tolist(), strict=True)):
            k = at[bounds[j] : bounds[j + 1]]
            # without so many common shingles no set of any size is similar enough
            if 100 * len(k) < percent * other_sizes[j]:
                continue
            lengths = n[k]
            # the documents of all postings of this one's shingles, end to end
            place = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(first[k], lengths)
            common = np.bincount(row[place], minlength=len(mine))
            good = (100 * common >= percent * (sizes + other_sizes[j] - common)) & (component != c) & (common > 0)
            for i in np.flatnonzero(good).tolist():
                if (i, c) not in seen:
                    seen.add((i, c))
                    out.append((ids[i], b))
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return run


def _missed_links(members: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Links between different components of a bucket. members: (bucket, id, component) of buckets with several.

    Every such link has an end outside the bucket's main component. These documents are dealt out to
    blocks of BLOCK, those of one main component together; a block meets all members of its documents'
    buckets, in chunks of CHUNK. Shingles are made once; their hashes travel, not texts.
    """
    main = members.groupBy("bucket", "component").agg(F.count("*").alias("n")).groupBy("bucket").agg(F.max(F.struct("n", "component"))["component"].alias("main"))
    outside = members.join(main, "bucket").where("component != main")
    home = outside.groupBy("id").agg(F.min("main").alias("home"))
    homes = home.groupBy("home").agg(F.count("*").alias("n"))
    blocks = written(home.join(homes, "home").select("id", "home", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / BLOCK)).alias("part")), "blocks")
    met = outside.select("id", "bucket").join(blocks, "id").select("home", "part", "bucket").distinct().join(members, "bucket").select("home", "part", "id", "component").distinct()
    met = written(met, "met")
    chunks = met.groupBy("home", "part").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
    others = met.join(chunks, ["home", "part"]).select("home", "part", F.pmod(F.xxhash64("id", F.lit(1)), "chunks").alias("chunk"), F.lit(1).alias("role"), "id", "component")
    of = members.select("id", "component").distinct()
    mine = blocks.join(chunks, ["home", "part"]).join(of, "id").select("home", "part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), F.lit(0).alias("role"), "id", "component")
    sets = written(hashed_sets(texts.join(of.select("id").distinct(), "id", "left_semi"), words), "sets")
    full = mine.unionByName(others).join(sets, "id").select("home", "part", "chunk", "role", "id", "component", "set")
    return full.groupBy("home", "part", "chunk").applyInPandas(_links_of_block(percent), "a long, b long")


def _labelled(pairs: DataFrame, labels: DataFrame, *ends: str) -> DataFrame:
    """With the component of each end; what has no link yet is its own."""
    for end in ends:
        pairs = pairs.join(labels.select(F.col("id").alias(end), F.col("component").alias(f"{end}_component")), end, "left").withColumn(f"{end}_component", F.coalesce(f"{end}_component", end))
    return pairs


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row.

    Null, empty and blank texts have no shingles and link with nothing. Rows of one doc_id are one
    document with several texts: any of their links counts. A row without doc_id links with nothing and
    is kept, its component_id is null. An empty table gives an empty table; other columns don't matter.
    """
    docs = needs(docs, key, text).select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    signed = written(signatures(docs, words), "signatures")
    classes = signed.where("n > 0 and doc_id is not null").groupBy("lo", "hi").agg(F.min("doc_id").alias("id"), F.any_value("buckets").alias("buckets"))
    classes = written(classes, "classes")
    spread = classes.select("id", F.explode("buckets").alias("bucket"))
    centres = spread.groupBy("bucket").agg(F.min("id").alias("centre"), F.count("*").alias("n")).where("n > 1").drop("n")
    members = written(spread.join(centres, "bucket"), "members")
    texts = written(docs.join(members.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi").select(F.col("doc_id").alias("id"), "text"), "texts")
    stars = members.where("id != centre").select(F.col("id").alias("a"), F.col("centre").alias("b"))

    links = written(confirmed(stars.groupBy("a").agg(F.min("b").alias("b")), texts, words, percent), "links")
    labels = written(components(links), "labels")
    rest = _labelled(stars.distinct(), labels, "a", "b").where("a_component != b_component").select("a", "b")
    links = links.union(written(confirmed(rest, texts, words, percent), "links"))
    labels = written(components(links), "labels")

    open_members = _labelled(members.select("bucket", "id"), labels, "id").withColumnRenamed("id_component", "component")
    mixed = open_members.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low != high").select("bucket")
    open_members = written(open_members.join(mixed, "bucket"), "open")
    found = written(_missed_links(open_members, texts, words, percent), "links")
    if not found.isEmpty():
        labels = written(components(links.union(found)), "labels")

    linked = classes.select("lo", "hi", "id").join(labels, "id", "left").select("lo", "hi", F.coalesce("component", "id").alias("component"))
    out = signed.where("n > 0 and doc_id is not null").join(linked, ["lo", "hi"]).select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
    out = out.unionByName(signed.where("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80)


QUERIES = {"op5_minhash_near_dedup": op5_minhash_near_dedup}

#: Exact: all pairs of documents that share a shingle, then the transitive closure of the links.
ORACLE = {
    "op5_minhash_near_dedup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS t FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(t) = 0 THEN []::VARCHAR[] WHEN len(t) = 1 THEN [t[1]] ELSE list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
sym AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT DISTINCT a AS id, a AS r FROM sym UNION SELECT reach.id, sym.b FROM reach JOIN sym ON sym.a = reach.r),
least AS (SELECT id, min(r) AS r FROM reach GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(l.r, d.doc_id) AS component_id, d.doc_id = coalesce(l.r, d.doc_id) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN least l ON l.id = d.doc_id
"""
}
