"""Language identification by interpolated Kneser-Ney character models.

Each language has a character model of order ORDER over words (runs of letters, lower-cased, with marks
for start and end). N-grams are kept in hash arrays sorted for binary search, shared by all languages: per n-gram the
discounted probability in those languages that have it, per context the weight of the shorter context; what a
language doesn't have takes no room. Below the models of single characters lies a uniform one over GROUND times as many
characters as all samples have, so that characters never seen have a probability too, the same in every language. A
text's language is the one with the lowest cross-entropy per character. A text is rejected if even that
entropy is far above what texts of that language have, or if the calibrated probability is low.

Every language among the labels is learned. Models are fitted on a sample of labelled rows, chosen by a hash
of the key (DOCS_PER_LANGUAGE rows a language in expectation, fewer where there are many languages); seven
eighths of it count n-grams, the others calibrate.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import bounded_batches, mix, needs, table

ORDER = 5
#: Labelled rows of each language that models are fitted on, in expectation.
DOCS_PER_LANGUAGE = 1600
#: Labelled rows of all languages that reach the driver, in expectation: with more than 64 languages each gets fewer.
DOCS = 64 * DOCS_PER_LANGUAGE
#: Of a language at least so many, whatever DOCS says, or all that it has.
LEAST_DOCS = 64
#: Of a language with fewer rows none is kept for calibration.
FEW = 16
#: Longer runs of letters, marks and digits are counted in pieces of so many characters, which overlap by ORDER - 1.
PIECE = 100
#: A text is rejected if its entropy is above its language's by so many standard errors and by such a share.
FAR_OUT, FAR_SHARE = 8.0, 1.0
#: ... or with a lower calibrated probability.
LEAST_SCORE = 0.5
#: The uniform lowest order has this many times the seen characters.
GROUND = 10
#: Words a worker remembers, with one language; with more, as many fewer, but LEAST_CACHE.
CACHE, LEAST_CACHE = 1_200_000, 20_000
#: Cells of the table of positions and languages that are computed at once.
CELLS = 250_000

_U = np.uint64
_STEP = _U(0x9FB21C651E98DF25)
_WORDS = re.compile(r"[^\W\d_]+")
_START, _END = 2, 3


def words_of(text: str) -> list[str]:
    return _WORDS.findall(text.lower())


def has_letter(text: str, words: list[str]) -> bool:
    return any(map(str.isalpha, words)) or any(map(str.isalpha, text))


def _positions(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Characters of all words with their marks, their place in the word, and each word's length with the end mark."""
    text = "".join(f"\x02{w}\x03" for w in words)
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 2
    begins = np.cumsum(lengths) - lengths
    return chars, np.arange(len(chars)) - np.repeat(begins, lengths), lengths - 1


def _grams(chars: np.ndarray) -> list[np.ndarray]:
    """grams[k][i]: hash of the k characters that end at i; only meaningful within a word."""
    out = [np.zeros(len(chars), dtype=np.uint64)]
    c = mix(chars.astype(np.uint64) + _U(1))
    for _ in range(ORDER):
        before = np.concatenate([[_U(0)], out[-1][:-1]])
        out.append(mix(before * _STEP + c))
    return out


@dataclass
class Sparse:
    """Values by sorted hash and language: those of keys[i] are at start[i]..start[i + 1] of languages and values."""

    keys: np.ndarray
    start: np.ndarray
    languages: np.ndarray
    values: np.ndarray

    @staticmethod
    def of(parts: list[tuple[np.ndarray, np.ndarray]]) -> Sparse:
        """From each language's hashes and values."""
        h = np.concatenate([k for k, _ in parts]) if parts else np.empty(0, dtype=np.uint64)
        lang = np.repeat(np.arange(len(parts), dtype=np.int32), [len(k) for k, _ in parts])
        order = np.lexsort((lang, h))
        h = h[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.empty(0, dtype=np.int64)
        values = np.concatenate([v for _, v in parts]).astype(np.float32) if parts else np.empty(0, dtype=np.float32)
        return Sparse(h[first], np.append(first, len(h)), lang[order], values[order])

    def look(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in h, language, value) of all that is known of the hashes h; a place and a language come once."""
        if not len(self.keys):
            return np.empty(0, dtype=np.int64), self.languages, self.values
        at = np.searchsorted(self.keys, h)
        at[at == len(self.keys)] = 0
        place = np.flatnonzero(self.keys[at] == h)
        begin = self.start[at[place]]
        n = self.start[at[place] + 1] - begin
        entry = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.repeat(place, n), self.languages[entry], self.values[entry]


@dataclass
class KneserNey:
    """All languages' models: for each length k, discounted probabilities of n-grams and weights of contexts."""

    languages: list[str]
    found: list[Sparse]
    weights: list[Sparse]
    ground: float
    sharpness: float = 1.0
    mean: np.ndarray | None = None
    spread: np.ndarray | None = None

    def score(self, words: list[str]) -> np.ndarray:
        """Row per word: its length with the end mark, then minus its log-probability in each language."""
        n = len(self.languages)
        out = np.zeros((len(words), 1 + n))
        for a, b in self._pieces(words):
            chars, place, lengths = _positions(words[a:b])
            grams = _grams(chars)
            own = np.flatnonzero(place > 0)
            p = np.full((len(own), n), self.ground, dtype=np.float32)
            flat = p.ravel()
            for k in range(1, ORDER + 1):
                rows = np.flatnonzero(place[own] >= k - 1)
                at = own[rows]
                if k == 1:
                    p *= self.weights[1].values  # the empty context, which every language has
                else:
                    r, lang, value = self.weights[k].look(grams[k - 1][at - 1])
                    flat[rows[r] * n + lang] *= value
                r, lang, value = self.found[k].look(grams[k][at])
                flat[rows[r] * n + lang] += value
            begins = np.cumsum(lengths) - lengths
            out[a:b, 0] = lengths
            out[a:b, 1:] = np.add.reduceat(-np.log(p, dtype=np.float64), begins, axis=0)
        return out

    def _pieces(self, words: list[str]) -> Iterator[tuple[int, int]]:
        """Runs of words that have about CELLS positions and languages together."""
        a, cells = 0, 0
        for i, w in enumerate(words):
            cells += (len(w) + 1) * len(self.languages)
            if cells >= CELLS:
                yield a, i + 1
                a, cells = i + 1, 0
        if a < len(words):
            yield a, len(words)

    def decide(self, n_chars: float, n_words: int, sums: np.ndarray) -> tuple[int, float, bool]:
        """Language, calibrated probability, rejected."""
        entropy = sums / n_chars
        best = int(np.argmin(entropy))
        score = float(1 / np.exp(-(entropy - entropy[best]) * self.sharpness * np.sqrt(n_words)).sum())
        usual = np.inf if self.mean is None else self.mean[best] + max(FAR_OUT * self.spread[best] / np.sqrt(n_words), FAR_SHARE * self.mean[best])
        return best, score, bool(entropy[best] > usual or score < LEAST_SCORE)


def _one_language(words: list[str], counts: np.ndarray) -> tuple[list, float]:
    """For k = 1..ORDER: n-gram hashes, discounted probabilities, context hashes, weights; the share left to unseen characters."""
    chars, place, lengths = _positions(words)
    grams = _grams(chars)
    times = np.repeat(counts, lengths + 1).astype(np.float64)
    out = []
    for k in range(1, ORDER + 1):
        at = np.flatnonzero(place >= max(1, k - 1))
        raw = at if k == ORDER else at[place[at] == k - 1]
        h, c, x = [], [], []
        if len(raw):  # the highest order, and what starts a word: how often it is there
            key, first, back = np.unique(grams[k][raw], return_index=True, return_inverse=True)
            h.append(key)
            c.append(np.bincount(back, weights=times[raw]))
            x.append(grams[k - 1][raw[first] - 1] if k > 1 else np.zeros(len(key), dtype=np.uint64))
        if k < ORDER:  # else how many different characters stand before it
            longer = np.flatnonzero(place >= max(1, k))
            _, first = np.unique(grams[k + 1][longer], return_index=True)
            longer = longer[first]
            key, first, n = np.unique(grams[k][longer], return_index=True, return_counts=True)
            h.append(key)
            c.append(n.astype(np.float64))
            x.append(grams[k - 1][longer[first] - 1] if k > 1 else np.zeros(len(key), dtype=np.uint64))
        h, c, x = (np.concatenate(p) if p else np.empty(0, dtype=kind) for p, kind in ((h, np.uint64), (c, np.float64), (x, np.uint64)))
        once, twice = (c == 1).sum(), (c == 2).sum()
        discount = min(0.95, max(0.1, once / max(1, once + 2 * twice)))
        context, back, kinds = np.unique(x, return_inverse=True, return_counts=True)
        total = np.bincount(back, weights=c)
        out.append((h, np.maximum(c - discount, 0) / total[back], context, discount * kinds / total))
    return out


def fit(samples: dict[str, tuple[list[str], np.ndarray]]) -> KneserNey:
    """Models from each language's words and their counts."""
    languages = sorted(samples)
    parts = [_one_language(*samples[x]) for x in languages]
    none = Sparse.of([])
    found = [none, *(Sparse.of([p[k][:2] for p in parts]) for k in range(ORDER))]
    weights = [none, *(Sparse.of([p[k][2:] for p in parts]) for k in range(ORDER))]
    kinds = max(2, len({c for x in languages for w in samples[x][0] for c in w}) + 1)
    return KneserNey(languages, found, weights, 1 / (GROUND * kinds))


def calibrate(model: KneserNey, texts: list[tuple[str, str]]) -> None:
    """Sets the sharpness of scores, and each language's usual entropy, by labelled texts not used in fit()."""
    rows = []
    for lang, text in texts:
        words = words_of(text)
        if words and lang in model.languages:
            s = model.score(words)
            rows.append((model.languages.index(lang), s[:, 0].sum(), len(words), s[:, 1:].sum(axis=0)))
    n = len(model.languages)
    model.mean, model.spread = np.full(n, 3.0), np.full(n, 3.0)
    if not rows:
        return
    lang, chars, words, sums = (np.array(x) for x in zip(*rows, strict=True))
    entropy = sums / chars[:, None]
    for j in range(n):
        if (lang == j).sum() >= 5:
            own, w = entropy[lang == j, j], words[lang == j]
            model.mean[j] = np.average(own, weights=w)
            model.spread[j] = max(0.05, np.sqrt(np.mean((own - model.mean[j]) ** 2 * w)))
    gaps = (entropy - entropy.min(axis=1, keepdims=True)) * np.sqrt(words)[:, None]
    right = np.arange(len(lang))

    def loss(t: float) -> float:
        z = -gaps * t
        return float(np.mean(np.log(np.exp(z).sum(axis=1)) - z[right, lang]))

    model.sharpness = min((2.0**i for i in range(-4, 7)), key=loss)


def learn(docs: DataFrame, learnable: Column, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = DOCS_PER_LANGUAGE) -> KneserNey | None:
    """Models from rows of docs where learnable holds; None if there are no labelled texts.

    Every language is learned. Only counts of languages, then the sample (at most DOCS rows in expectation, or
    LEAST_DOCS a language if that is more) reach the driver, as words with their counts and as an eighth of that many texts.
    """
    labelled = needs(docs, key, text, lang).where(learnable & F.col(f"`{lang}`").isNotNull() & F.col(f"`{text}`").isNotNull()).select(F.col(f"`{key}`").cast("string").alias("key"), F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").cast("string").alias("lang"))
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    per_language = min(per_language, max(LEAST_DOCS, DOCS // len(sizes)))
    part = F.pmod(F.xxhash64("key"), F.lit(1_000_000))
    shares = labelled.sparkSession.createDataFrame([(k, min(1.0, per_language / n), n < FEW) for k, n in sizes.items()], "lang string, share double, few boolean")
    sample = labelled.join(F.broadcast(shares), "lang").where(part < F.col("share") * 1_000_000)
    half = F.when(F.col("few"), 1).otherwise(F.pmod(F.xxhash64("key", F.lit("half")), F.lit(8)))
    # strings of letters as Spark sees them; what Python calls a word is cut from them here
    runs = sample.where(half != 0).select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{M}\p{N}]+)"), F.lit(1))).alias("run"))
    begins = F.sequence(F.lit(1), F.greatest(F.lit(1), F.char_length("run") - (ORDER - 1)), F.lit(PIECE - ORDER + 1))
    pieces = F.when(F.char_length("run") > PIECE, F.transform(begins, lambda i: F.substring("run", i, F.lit(PIECE)))).otherwise(F.array("run"))
    counted = runs.select("lang", F.explode(pieces).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    got: dict[str, dict[str, int]] = {}
    rows = counted.toArrow()
    for x, word, n in zip(rows["lang"].to_pylist(), rows["word"].to_pylist(), rows["n"].to_pylist(), strict=True):
        own = got.setdefault(x, {})
        for w in words_of(word):
            own[w] = own.get(w, 0) + n
    samples = {x: (sorted(c), np.array([c[w] for w in sorted(c)])) for x, c in got.items() if c}
    if not samples:
        return None
    model = fit(samples)
    calibrate(model, [(r["lang"], r["text"]) for r in sample.where(half == 0).select("lang", "text").collect()])
    return model


class _Numbers(dict):
    """Words to row numbers, in the order in which they are first asked for."""

    def __missing__(self, word: str) -> int:
        i = self[word] = len(self)
        return i


class Scorer:
    """Sums of scores of texts' words; remembers a bounded number of words.

    Words are scored when many new ones have come together, not text by text.
    """

    def __init__(self, model: KneserNey):
        self.model = model
        self.remembered = max(LEAST_CACHE, CACHE // len(model.languages))
        self._forget()

    def _forget(self) -> None:
        self.known, self.scored, self.chars = _Numbers(), 0, 0
        self.table = np.zeros((0, 1 + len(self.model.languages)))

    def sums(self, texts: list[list[str]]) -> np.ndarray:
        """Row per text: characters with end marks, then minus the log-probability in each language, of all its words."""
        out, waiting = np.zeros((len(texts), 1 + len(self.model.languages))), []
        for i, words in enumerate(texts):
            for a in range(0, len(words), LEAST_CACHE):
                part = words[a : a + LEAST_CACHE]
                waiting.append((i, np.fromiter(map(self.known.__getitem__, part), dtype=np.int64, count=len(part))))
                if len(self.known) > self.remembered:
                    self._add(out, waiting)
        self._add(out, waiting)
        return out

    def _add(self, out: np.ndarray, waiting: list[tuple[int, np.ndarray]]) -> None:
        if len(self.known) > self.scored:
            new = list(islice(reversed(self.known), len(self.known) - self.scored))[::-1]
            self.chars += sum(map(len, new))
            if len(self.table) < len(self.known):
                self.table = np.concatenate([self.table[: self.scored], np.zeros((len(new) + len(self.known) // 2, self.table.shape[1]))])
            self.table[self.scored : len(self.known)] = self.model.score(new)
            self.scored = len(self.known)
        step = max(1, CELLS // self.table.shape[1])
        for i, rows in waiting:
            for a in range(0, len(rows), step):
                out[i] += self.table[rows[a : a + step]].sum(axis=0)
        waiting.clear()
        if len(self.known) > self.remembered or self.chars > 32 * self.remembered:  # strings of letters without end aren't remembered either
            self._forget()


def identify(docs: DataFrame, model: KneserNey | None, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, lang_pred, score, rejected) of each row, with the columns in keep.

    Texts that are null or have no letter, and all texts if there is no model, are `und` with score 0 and
    rejected. Repeated rows are each judged, very long texts whole; equal entropies go to the first language by name; an empty
    table gives an empty table. No shuffle; a worker holds one Arrow batch, the models and a bounded number of words.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        scorer = Scorer(model) if model else None
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
            words = [words_of(t) for t in texts]
            known = [model is not None and bool(w) and has_letter(t, w) for t, w in zip(texts, words, strict=True)]
            got = iter(scorer.sums([w for w, k in zip(words, known, strict=True) if k])) if scorer else None
            rows = [("und", 0.0, True)] * len(texts)
            for i, w in enumerate(words):
                if known[i]:
                    total = next(got)
                    best, score, out = model.decide(total[0], len(w), total[1:])
                    rows[i] = (model.languages[best], score, out)
            langs, scores, rejected = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], names=[*names, "lang_pred", "score", "rejected"])

    kept = needs(docs, key, *keep)
    names = [f"c{i}" for i in range(len(kept.columns))]
    schema = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, kept.schema, strict=True))
    narrow = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip([key, *keep], names, strict=True)], F.col(f"`{text}`").cast("string").alias("text"))
    out = narrow.mapInArrow(run, f"{schema}, lang_pred string, score double, rejected boolean")
    return out.select(*[F.col(n).alias(c) for c, n in zip([key, *keep], names, strict=True)], "lang_pred", "score", "rejected")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    remainder = F.crc32(F.col("doc_id").cast("string")) % 3
    model = learn(docs, remainder != 1)
    return identify(docs, model).withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False)))


QUERIES = {"op6_language_id": op6_language_id}
ORACLE: dict[str, str] = {}
