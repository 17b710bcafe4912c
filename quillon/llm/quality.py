"""Document quality by Bradley-Terry pairwise ranking.

A document's strength is a linear function of features of its text: counts that tell its make, and the shares of its words and
pairs of neighbouring words that fall in each of HASHED buckets, which tell what it says. The model says that a good document
beats a bad one with probability logistic(strength difference); it is fitted by logistic loss on the
feature differences of preference pairs, drawn from labelled rows. The cut between good and bad is a
quantile of the strengths of the labelled rows: the share of bad ones among them. Scores are a logistic
function of the strength that is THRESHOLD at the cut.

The labelled rows used are a bounded sample: ROWS_PER_CLASS of each class in expectation, by a hash of the key.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import bounded_batches, mix, needs, table, word_hashes

THRESHOLD = 0.7
ROWS_PER_CLASS = 4000
PAIRS = 40_000
#: Buckets of words, and as many of pairs of words.
HASHED = 512
#: Quadratic penalty of the weights of counts, and of those of buckets.
PENALTY, HASHED_PENALTY = 1e-3, 1e-2

#: Classes of bytes: space, newline, lower, upper, digit, sentence marks, other ASCII signs, beyond ASCII.
_CLASS = np.full(256, 7, dtype=np.uint8)
_CLASS[:128] = 6
_CLASS[[0x20, 0x09, 0x0B, 0x0C, 0x0D]] = 0
_CLASS[0x0A] = 1
_CLASS[97:123] = 2
_CLASS[65:91] = 3
_CLASS[48:58] = 4
_CLASS[[ord(c) for c in ".,;:?'\"-()"]] = 5
_KINDS = 8

FEATURES = ("words", "word_length", "spaces", "lines", "lower", "upper", "digits", "marks", "signs", "beyond", "distinct", "repeats", "distinct_pairs", "long_words", "short_words")


@dataclass
class Features:
    """Of n texts: counts (n, names in FEATURES), and for every word and pair its text, bucket and share in the text's words."""

    counts: np.ndarray
    row: np.ndarray
    bucket: np.ndarray
    share: np.ndarray

    def buckets(self) -> np.ndarray:
        """(n, 2 * HASHED): the sum of shares in each bucket."""
        n = len(self.counts)
        return np.bincount(self.row * 2 * HASHED + self.bucket, weights=self.share, minlength=n * 2 * HASHED).reshape(n, 2 * HASHED)


def features(texts: pa.Array) -> Features:
    """One row per text; null, empty and blank texts are all 0. Words are told apart by case."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    n = len(sizes)
    data = np.frombuffer(b" ".join([*texts.to_pylist(), b""]), dtype=np.uint8)
    begins = np.cumsum(sizes + 1) - sizes - 1
    out = np.zeros((n, len(FEATURES)))
    none = np.empty(0, dtype=np.int64)
    if not len(data):
        return Features(out, none, none, none.astype(np.float64))
    kinds = _CLASS[data]
    counts = np.stack([np.add.reduceat((kinds == k).astype(np.int64), begins) for k in range(_KINDS)], axis=1)
    counts[:, 0] -= 1  # the blank behind each text
    h, starts, ends = word_hashes(data, lower=False)
    row = np.searchsorted(begins, starts, side="right") - 1
    per = lambda x=None, at=row: np.bincount(at, weights=x, minlength=n)
    words = per()
    some = np.maximum(words, 1)
    length = ends - starts
    same = row[1:] == row[:-1]
    order = np.lexsort((h, row))
    r, v = row[order], h[order]
    fresh = np.concatenate([[True], (r[1:] != r[:-1]) | (v[1:] != v[:-1])]) if len(h) else np.empty(0, dtype=bool)
    pair = (h[:-1] * np.uint64(0x9FB21C651E98DF25) + h[1:])[same]
    pair_row = row[1:][same]
    order = np.lexsort((pair, pair_row))
    pr, pv = pair_row[order], pair[order]
    fresh_pairs = np.concatenate([[True], (pr[1:] != pr[:-1]) | (pv[1:] != pv[:-1])]) if len(pv) else np.empty(0, dtype=bool)
    pairs = np.maximum(per(at=pair_row), 1)
    total = np.maximum(sizes, 1)
    out[:, 0] = np.log1p(words)
    out[:, 1] = np.log1p(per(length) / some)
    out[:, 2:10] = np.sqrt(np.maximum(counts[:, [0, 1, 2, 3, 4, 5, 6, 7]], 0) / total[:, None])
    out[:, 10] = np.log1p(per(at=r[fresh])) / np.maximum(np.log1p(words), 1)
    out[:, 11] = np.sqrt(per(at=row[1:][same & (h[1:] == h[:-1])]) / some)
    out[:, 12] = per(at=pr[fresh_pairs]) / pairs
    out[:, 13] = np.sqrt(per(length > 14) / some)
    out[:, 14] = np.sqrt(per(length < 3) / some)
    out[words == 0] = 0
    rows = np.concatenate([row, pair_row])
    bucket = np.concatenate([(h >> np.uint64(40)) % np.uint64(HASHED), (mix(pair) >> np.uint64(40)) % np.uint64(HASHED) + np.uint64(HASHED)]).astype(np.int64)
    return Features(out, rows, bucket, 1 / some[rows])


@dataclass
class BradleyTerry:
    """Strength = weights . z + hashed . shares, with z the standardised counts and their squares."""

    middle: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    hashed: np.ndarray
    cut: float = 0.0
    slope: float = 1.0

    def expand(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.middle) / self.scale, -6, 6)
        return np.concatenate([z, z * z / 6], axis=1)

    def score(self, x: Features) -> np.ndarray:
        told = np.bincount(x.row, weights=self.hashed[x.bucket] * x.share, minlength=len(x.counts))
        strength = self.expand(x.counts) @ self.weights + told
        return 1 / (1 + np.exp(-np.clip(self.slope * (strength - self.cut) + np.log(THRESHOLD / (1 - THRESHOLD)), -30, 30)))


def ranked_weights(z: np.ndarray, better: np.ndarray, worse: np.ndarray, penalty: np.ndarray) -> np.ndarray:
    """The weights of least mean logistic loss on z[better] - z[worse], with a quadratic penalty, by Newton steps.

    Each step is solved by conjugate gradients; neither the differences nor the matrix of second derivatives are ever formed.
    """
    n, weights = len(better), np.zeros(z.shape[1])

    def spread(x: np.ndarray) -> np.ndarray:
        return z.T @ (np.bincount(better, weights=x, minlength=len(z)) - np.bincount(worse, weights=x, minlength=len(z))) / n

    for _ in range(30):
        strength = z @ weights
        p = 1 / (1 + np.exp(np.clip(strength[better] - strength[worse], -30, 30)))
        gradient = spread(p) - penalty * weights
        step, rest = np.zeros_like(weights), gradient.copy()
        way, size = rest.copy(), rest @ rest
        end = max(1e-24, 1e-6 * size)
        for _ in range(100):
            if size <= end:
                break
            u = z @ way
            bent = spread(p * (1 - p) * (u[better] - u[worse])) + penalty * way
            a = size / (way @ bent)
            step += a * way
            rest -= a * bent
            size, before = rest @ rest, size
            way = rest + size / before * way
        weights = weights + step
        if np.abs(step).max() < 1e-6:
            break
    return weights


def fit(x: np.ndarray, shares: np.ndarray, y: np.ndarray, n_pairs: int = PAIRS, seed: int = 7) -> BradleyTerry:
    """From counts, shares of buckets, and labels 0 or 1. With one class only, every score says that class."""
    middle = np.median(x, axis=0) if len(x) else np.zeros(len(FEATURES))
    scale = np.maximum(np.std(x, axis=0), 1e-2) if len(x) else np.ones(len(FEATURES))
    model = BradleyTerry(middle, scale, np.zeros(2 * len(FEATURES)), np.zeros(2 * HASHED))
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        model.cut = -20.0 if len(good) else 20.0
        return model
    rng = np.random.default_rng(seed)
    # shares are small: ten times as large, a bucket's weight is of the size of the others
    z = np.concatenate([model.expand(x), 10 * shares], axis=1)
    k = 2 * len(FEATURES)
    weights = ranked_weights(z, rng.choice(good, n_pairs), rng.choice(bad, n_pairs), np.where(np.arange(z.shape[1]) < k, PENALTY, HASHED_PENALTY))
    model.weights, model.hashed = weights[:k], 10 * weights[k:]
    # each class weighs as the sample has it; the cut is the quantile that leaves the bad share below it
    strength = z @ weights
    ranked = np.sort(strength)
    model.cut = float((ranked[len(bad) - 1] + ranked[min(len(bad), len(ranked) - 1)]) / 2)
    centred, grid = strength - model.cut, 2.0 ** np.arange(-4, 5)
    loss = [np.mean(np.logaddexp(0, np.where(y == 1, -1, 1) * a * centred)) for a in grid]
    model.slope = float(grid[int(np.argmin(loss))])
    return model


def learn(docs: DataFrame, labels: DataFrame, learnable: Column, key: str = "doc_id", text: str = "text", label: str = "quality", per_class: int = ROWS_PER_CLASS) -> BradleyTerry:
    """A model from the rows of labels where learnable (a condition on the key) holds.

    The sample's keys are broadcast (2 * per_class rows in expectation); its features reach the driver, about 4 KB a row whatever the
    length of its text. Labels other than 0 and 1, null keys and labels without a document don't count; repeated rows count each. Each
    class is thinned alike, so that their shares stay as they are. Empty tables give a model that knows nothing.
    """
    bounded_batches(docs.sparkSession)
    known = needs(labels, key, label).where(learnable & F.col(f"`{key}`").isNotNull() & F.col(f"`{label}`").isin(0, 1)).select(F.col(f"`{key}`").alias("key"), F.col(f"`{label}`").cast("int").alias("label"))
    n = known.count()
    share = min(1.0, 2 * per_class / max(1, n))
    sample = known.where(F.pmod(F.xxhash64("key"), F.lit(1_000_000)) < share * 1_000_000)
    chosen = needs(docs, key, text).select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text")).join(F.broadcast(sample), "key").select("label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                x = features(batch.column(1).slice(at, 256))
                raw = [[r.tobytes() for r in part] for part in (x.counts, x.buckets().astype(np.float32))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 256), *(pa.array(r, pa.binary()) for r in raw)], names=["label", "x", "shares"])

    got = chosen.mapInArrow(run, "label int, x binary, shares binary").toArrow()
    x = np.frombuffer(b"".join(got["x"].to_pylist()), dtype=np.float64).reshape(-1, len(FEATURES))
    shares = np.frombuffer(b"".join(got["shares"].to_pylist()), dtype=np.float32).reshape(-1, 2 * HASHED)
    y = got["label"].to_numpy()
    order = np.lexsort((shares.max(axis=1), *x.T, y)) if len(y) else np.empty(0, dtype=np.int64)  # the same model whatever the order of rows
    return fit(x[order], shares[order].astype(np.float64), y[order])


def score(docs: DataFrame, model: BradleyTerry, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score, predicted) of each row. No shuffle.

    Null and empty texts are scored as texts without words, very long ones whole, repeated rows each; an empty table gives an empty table.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.score(features(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], names=["key", "score", "predicted"])

    narrow = needs(docs, key, text).select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    return narrow.mapInArrow(run, f"key {narrow.schema['key'].dataType.simpleString()}, score double, predicted int").withColumnRenamed("key", key)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    docs = table(spark, sf_dir, "documents")
    model = learn(docs, table(spark, sf_dir, "labels"), ~held)
    return score(docs, model).withColumn("held_out", F.coalesce(held, F.lit(False)))


QUERIES = {"op4_quality": op4_quality}
ORACLE: dict[str, str] = {}
