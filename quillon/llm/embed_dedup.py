"""Near-duplicate embeddings by iterative quantisation.

Rotations are learned on a bounded sample of each vector length: each starts from the sample's principal axes and a random
rotation and alternates between binary codes and the rotation that brings vectors nearest to them. The
codes are cut into substrings, each with a hash table of its own (multi-index hashing: two codes that differ in fewer bits
than there are tables share a substring). Vectors of one length and label that share a substring are compared by the Hamming distance
of their whole codes; those with a partner within FAR of the bits are reranked by cosine on the original vectors. A pair is counted in the first table that both share, so no pairs need be kept to
count them once.

Substrings are as long as log2 of the vectors of a length, so a bucket holds about one vector of balanced codes however
many there are; the number of tables follows their length: two vectors of cosine 0.98 differ in a bit with probability
about 0.064, so they share none of t tables of b bits with probability about (1 - 0.936^b)^t, and t is the least that keeps this
below MISSED. That is 24 tables of 16 bits for 65536 vectors and 58 of 28 bits for 268 million.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import table, written
from quillon.llm.components import components
from quillon.llm.vectors import matrix, read

#: Vectors of each length that rotations are learned on, in expectation.
SAMPLE = 4096
MISSED = 4.9e-5
#: Bits of a substring.
LEAST_BITS, MOST_BITS = 16, 40
#: Share of differing bits beyond which a pair isn't reranked. Cosine 0.98 gives 0.064, vectors that have nothing in common 0.5.
FAR = 0.4
#: Where the number of the table stands in a code.
TABLE_AT = 44
#: Principal axes that a rotation turns, at most.
AXES = 1024
#: Vectors of a bucket that meet in one task are two blocks of about this size at most.
BLOCK = 2048


def plan(n: int, cosine: float = 0.98) -> tuple[int, int]:
    """(tables, bits of a substring) for n vectors of one length."""
    bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(2, n)))))
    alike = 1 - math.acos(min(1.0, max(-1.0, cosine))) / math.pi
    return max(1, math.ceil(math.log(MISSED) / math.log1p(-(alike**bits) if alike < 1 else -0.999999))), bits


def learn_rotations(x: np.ndarray, tables: int, sub_bits: int, steps: int = 25, seed: int = 5) -> np.ndarray:
    """Projections (dim, bits) to codes whose columns are cut into `tables` substrings, from a sample of vectors."""
    dim = x.shape[1]
    bits = min(dim, AXES)
    sub = min(sub_bits, bits)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    _, axes = np.linalg.eigh(x.T @ x)
    axes = axes[:, ::-1][:, :bits]
    v, rng, out = x @ axes, np.random.default_rng(seed), []
    while sum(p.shape[1] for p in out) < tables * sub:
        r, _ = np.linalg.qr(rng.standard_normal((bits, bits)))
        for _ in range(steps):
            u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
            r = (u @ w).T
        p = axes @ r
        out.append(p[:, : bits // sub * sub])
    return np.concatenate(out, axis=1)[:, : tables * sub]


def codes(x: np.ndarray, projection: np.ndarray, tables: int) -> np.ndarray:
    """(rows, tables) substrings of the codes."""
    ones = (x @ projection >= 0).reshape(len(x), tables, -1).astype(np.int64)
    return (ones << np.arange(ones.shape[2], dtype=np.int64)).sum(axis=2, dtype=np.int64)


def packed(c: np.ndarray, bits: int) -> np.ndarray:
    """(rows, words) whole codes as 64-bit words: as many substrings of so many bits in each as there is room for."""
    per_word = 64 // bits
    c = (c & ((1 << bits) - 1)).astype(np.uint64)
    c = np.concatenate([c, np.zeros((len(c), -c.shape[1] % per_word), dtype=np.uint64)], axis=1).reshape(len(c), -1, per_word)
    return np.bitwise_or.reduce(c << (np.arange(per_word, dtype=np.uint64) * np.uint64(bits)), axis=2)


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(rows of a, rows of b) distances of packed codes."""
    if len(a) * len(b) < 4096:
        return np.bitwise_count(a[:, None] ^ b[None]).sum(axis=2, dtype=np.uint16)
    out = np.zeros((len(a), len(b)), dtype=np.uint16)
    for w in range(a.shape[1]):
        out += np.bitwise_count(a[:, w, None] ^ b[None, :, w])
    return out


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> list[int]:
    """Which of the edges (a, b) among n nodes join two trees."""
    root, out = list(range(n)), []
    for e, (i, j) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        while root[j] != j:
            root[j] = root[root[j]]
            j = root[j]
        if i != j:
            root[max(i, j)] = min(i, j)
            out.append(e)
    return out


def near_duplicates(vectors: DataFrame, cosine: float = 0.98, key: str = "vec_id", vector: str = "embedding", label: str = "label", sample: int = SAMPLE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row.

    Rows of equal vectors and labels are one class, of which one member goes through the tables. Vectors of different lengths
    have no cosine and never link; each length has rotations of its own. Rows
    whose label is null, or whose vector is null, empty, zero or holds
    null or non-finite components, link with nothing. Vectors are scaled by powers of two first, so squares neither vanish nor overflow. Repeated rows are vectors of their own; rows of one
    vec_id are one node of components. A row without vec_id is counted but is kept alone: its component_id is null.
    An empty table gives an empty table.
    """
    spark = vectors.sparkSession
    rows = written(read(vectors, key, vector, label).withColumnRenamed(label, "label"), "vectors")
    good = F.col("vec").isNotNull() & F.col("label").isNotNull()
    classes = rows.where(good).groupBy("label", "same").agg(F.min("id").alias("id"), F.count("*").alias("size"), F.any_value("vec").alias("vec"), F.any_value("dim").alias("dim"))
    classes = written(classes, "classes").where("id is not null")
    sizes = {r["dim"]: r["n"] for r in classes.groupBy("dim").agg(F.count("*").alias("n")).collect()}  # one row for each length of vectors
    if not sizes:
        return rows.select(F.col("id").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    share = F.create_map(*[F.lit(v) for d, n in sizes.items() for v in (d, max(1.0, min(1.0, sample / n) * 1_000_000))])[F.col("dim")]
    part = F.pmod(F.xxhash64("id"), F.lit(1_000_000))
    chosen: dict[int, list[bytes]] = {}
    for r in classes.where(part < share).select("dim", "id", "same", "vec").orderBy("id", "same").collect():
        chosen.setdefault(r["dim"], []).append(bytes(r["vec"]))
    plans, projections = {}, {}
    for d, n in sizes.items():
        plans[d] = plan(n, cosine)
        projections[d] = learn_rotations(matrix(chosen[d]) if d in chosen else np.ones((1, d)), *plans[d])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, raw = batch.column(4).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
            out, whole = [None] * len(batch), [None] * len(batch)
            for d in np.unique(dims).tolist():
                at, (tables, bits) = np.flatnonzero(dims == d), plans[d]
                c = codes(matrix([raw[i] for i in at]), projections[d], tables)
                words = packed(c, min(bits, d))
                c += np.arange(tables, dtype=np.int64) << TABLE_AT
                for k, i in enumerate(at.tolist()):
                    out[i], whole[i] = c[k], words[k].tobytes()
            if len(batch):
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int64())), *(batch.column(i) for i in (2, 1, 3, 4)), pa.array(whole, pa.binary())], names=["id", "codes", "label", "vec", "size", "dim", "whole"])

    kind = classes.schema["label"].dataType.simpleString()
    coded = classes.select("id", "vec", "label", "size", "dim").mapInArrow(encode, f"id long, codes array<long>, label {kind}, vec binary, size long, dim int, whole binary")
    # rows of one id may have several vectors or labels: each class is told by a digest too
    coded = written(coded.withColumn("uid", F.xxhash64("vec", "label")), "codes")
    keys = coded.select("id", "uid", "dim", "label", F.explode("codes").alias("code"))
    large = keys.groupBy("dim", "label", "code").agg(F.count("*").alias("n")).where("n > 1").select("dim", "label", "code", F.ceil(F.col("n") / BLOCK).alias("blocks"))
    placed = keys.join(large, ["dim", "label", "code"]).withColumn("own", F.pmod(F.xxhash64("id"), "blocks"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    placed = placed.select("id", "uid", "dim", "label", "code", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    met = placed.join(coded.select("id", "uid", "dim", "label", "codes", "whole", "vec", "size"), ["id", "uid", "dim", "label"]).select("dim", "label", "code", "i", "j", "own", "id", "uid", "size", "codes", "whole", "vec")
    met = met.repartition("dim", "label", "code", "i", "j").sortWithinPartitions("dim", "label", "code", "i", "j", "own", "id")

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def rerank(rows: pa.Table) -> pa.RecordBatch:
            code, i, j = rows["code"][0].as_py(), rows["i"][0].as_py(), rows["j"][0].as_py()
            own, ids, uid, size = (rows[n].to_numpy() for n in ("own", "id", "uid", "size"))
            c = np.array(rows["codes"].to_pylist(), dtype=np.int64)
            x = matrix(rows["vec"].to_pylist())
            norm = np.sqrt((x * x).sum(axis=1))
            left, right = (np.flatnonzero(own == i), np.flatnonzero(own == j))
            tables, bits = plans[rows["dim"][0].as_py()]
            bits = min(bits, x.shape[1])
            if bits >= LEAST_BITS:  # shorter vectors have too few bits that differ independently
                words = np.frombuffer(b"".join(rows["whole"].to_pylist()), dtype=np.uint64).reshape(len(ids), -1)
                near = hamming(words[left], words[right]) <= FAR * tables * bits
                if i == j:
                    near[np.arange(len(left)), np.arange(len(left))] = False
                left, right = left[near.any(axis=1)], right[near.any(axis=0)]
            a, b = np.nonzero((x[left] @ x[right].T) / (norm[left][:, None] * norm[right][None, :]) >= cosine)
            a, b = left[a], right[b]
            once = a < b if i == j else np.ones(len(a), dtype=bool)
            t = code >> TABLE_AT
            once &= ~(c[a][:, :t] == c[b][:, :t]).any(axis=1)
            a, b = a[once], b[once]
            n_links = np.bincount(a, weights=size[b], minlength=len(ids)) + np.bincount(b, weights=size[a], minlength=len(ids))
            some = np.flatnonzero(n_links)
            trees = _forest(len(ids), a, b)
            first, which = (pa.array(np.concatenate([v[some], v[a[trees]]]), pa.int64()) for v in (ids, uid))
            second = pa.array([*[None] * len(some), *ids[b[trees]].tolist()], pa.int64())
            return pa.RecordBatch.from_arrays([first, which, second, pa.array(np.concatenate([n_links[some], np.zeros(len(trees))]).astype(np.int64))], names=["a", "uid", "b", "n"])

        for batch in batches:
            if not len(batch):
                continue
            keys = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(5)]
            cuts = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
            for at, to in zip([0, *cuts.tolist()], [*cuts.tolist(), len(batch)], strict=True):
                piece = batch.slice(at, to - at)
                if held and any(held[0].column(k)[0] != piece.column(k)[0] for k in range(5)):
                    yield rerank(pa.Table.from_batches(held))
                    held = []
                held.append(piece)
        if held:
            yield rerank(pa.Table.from_batches(held))

    found = written(met.mapInArrow(links, "a long, uid long, b long, n long"), "links")
    counts = found.where("b is null").groupBy(F.col("a").alias("id"), "uid").agg(F.sum("n").alias("n"))
    labels = written(components(found.where("b is not null").select("a", "b")), "labels")
    by_class = classes.select("label", "same", "id", "size", F.xxhash64("vec", "label").alias("uid")).join(counts, ["id", "uid"], "left").join(labels, "id", "left")
    by_class = by_class.select("label", "same", (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    linked = rows.where(good).select("id", "label", "same").join(by_class, ["label", "same"], "left").select("id", "n_links", "component_id")
    alone = rows.where(~F.coalesce(good, F.lit(False))).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.unionByName(alone).withColumn("component_id", F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")))
    return out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES = {"op9_embedding_near_dedup": op9_embedding_near_dedup}

ORACLE = {
    "op9_embedding_near_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT DISTINCT a AS id, a AS r FROM links UNION SELECT reach.id, links.b FROM reach JOIN links ON links.a = reach.r),
least AS (SELECT id, min(r) AS r FROM reach GROUP BY id),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT d.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, coalesce(l.r, d.vec_id) AS component_id, d.vec_id = coalesce(l.r, d.vec_id) AS kept
FROM embeddings d LEFT JOIN n ON n.a = d.vec_id LEFT JOIN least l ON l.id = d.vec_id
"""
}
