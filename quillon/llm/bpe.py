"""BPE encoding and decoding by forced-boundary splitting.

A pair of bytes that occurs inside no token of the vocabulary can never be bridged by a merge: between
such two bytes every encoding has a cut. Texts are cut at these certain places, the fragments are
encoded independently (and so can be cached by content), and the ids are concatenated.

Two kinds of cuts are used:

* Before the first white space after other text. Every vocabulary is checked for it: no token may hold a
  byte other than white space followed by a space. The pre-tokeniser also always cuts there, and what
  stands before such a place has no influence on what follows.
* Inside what the pre-tokeniser keeps together, at each byte pair that no token holds.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, compress
from operator import not_

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession

from quillon.llm.common import bounded_batches, needs, table

#: Entries of each of the three caches of a Python worker; a full cache is emptied.
CACHE = 500_000
#: Longer fragments aren't cached.
CACHED_CHARS = 40

#: The byte-level vocabulary's way to cut text before the merges, and its white space as a class.
PRETOKENS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _kinds() -> np.ndarray:
    """The kind of each code point below 65536, between which the pre-tokeniser cuts: 1 letter, 2 number, 3 white space, else 0."""
    out = np.zeros(1 << 16, dtype=np.int8)
    every = "".join(chr(c) for c in range(1 << 16) if not 0xD800 <= c < 0xE000)
    for kind, pattern in enumerate((r"\p{L}", r"\p{N}", r"\s"), 1):
        out[[ord(c) for c in regex.findall(pattern, every)]] = kind
    return out


class _Cache(dict):
    """Pieces (texts or bytes) to the bytes of their ids."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, piece: str | bytes) -> bytes:
        ids = self.make(piece)
        if len(piece) <= CACHED_CHARS:
            if len(self) >= CACHE:
                self.clear()
            self[piece] = ids
        return ids


class ForcedBoundaryBPE:
    """Encoder and decoder for a byte-level BPE vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec["normalizer"] or spec["post_processor"] or model.get("ignore_merges") or model.get("dropout") or model.get("byte_fallback"):
            raise ValueError("only plain byte-level BPE vocabularies are known")
        alphabet = byte_alphabet()
        raw = {t: bytes(map(alphabet.__getitem__, t)) for t in model["vocab"]}
        self.bytes_of: dict[int, bytes] = {i: raw[t] for t, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError("only plain added tokens are known")
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.size = max(self.bytes_of) + 1
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.tokens = [self.bytes_of.get(i, b"") for i in range(self.size)]
        self.decimals = [str(i) for i in range(self.size)]
        vocab, merges = model["vocab"], []
        for pair in model["merges"]:
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            merges.append(vocab[a + b])
        inside = np.zeros((256, 256), dtype=bool)
        for b in raw.values():
            for x, y in zip(b, b[1:], strict=False):
                inside[x, y] = True
        #: forced[256 * a + b]: between bytes a and b there is a cut in every encoding.
        self.forced = bytes((~inside).ravel().tobytes())
        self._forced = np.frombuffer(self.forced, dtype=bool)
        self.forced_pairs = frozenset(zip(*(x.tolist() for x in np.nonzero(~inside)), strict=True))
        blank = {0x20, *range(0x09, 0x0E)}
        if any(inside[b, 0x20] for b in range(256) if b not in blank and b not in (0x85, 0xA0) and not 0x80 <= b <= 0xBF):
            raise ValueError("this vocabulary has tokens that bridge words")
        if merges != sorted(merges):
            raise ValueError("ids must follow the order of the merges")
        self._code = "H" if self.dtype.itemsize == 2 else "I"
        # a merge loop over ranks in native code; with ids in the order of the merges, it makes the same choices
        self._merge = tiktoken.Encoding("fragments", pat_str=PRETOKENS, mergeable_ranks={b: i for i, b in self.bytes_of.items() if i not in self.special.values()}, special_tokens={})._core_bpe.encode_single_piece
        self._simple = re.compile(r"( ?)([^\W\d_]+)([,.;:!?]*)")
        self._pretokens = regex.compile(PRETOKENS)
        self._kinds, self._wide = _kinds(), re.compile(f"[{WHITE}]{{2}}")
        self._units = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
        self._specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._white = frozenset(re.findall(f"[{WHITE}]", "".join(map(chr, range(0x3001)))))
        self._fragments, self._units_seen = _Cache(self._merged), _Cache(self._unit)
        self._after_space: dict[str, bytes] = {}

    # -- encoding

    def _merged(self, fragment: bytes) -> bytes:
        """Merges of one fragment: always the pair of the lowest rank, of equal ones the leftmost."""
        return array(self._code, self._merge(fragment)).tobytes()

    def _word(self, word: str) -> bytes:
        """One pre-token, cut at the byte pairs that no token holds."""
        b = word.encode()
        if self.forced_pairs.isdisjoint(zip(b, b[1:], strict=False)):
            return self._fragments[b]
        v = np.frombuffer(b, dtype=np.uint8)
        cuts = (np.flatnonzero(self._forced[v[:-1].astype(np.int64) << 8 | v[1:]]) + 1).tolist()
        return b"".join(self._fragments[b[i:j]] for i, j in zip([0, *cuts], [*cuts, len(b)], strict=True))

    def _unit(self, unit: str) -> bytes:
        """A text whose surroundings don't matter: pre-tokens, forced cuts, merges."""
        m = self._simple.fullmatch(unit)
        if m and m[2].isalpha():
            return self._word(m[1] + m[2]) + self._word(m[3]) if m[3] else self._word(unit)
        return b"".join(map(self._word, self._pretokens.findall(unit)))

    def _cut(self, units: list[str]) -> dict[str, bytes] | None:
        """The ids of units behind a space, cut all at once: between kinds of characters, and at forced pairs.

        Null if one of them is of a kind whose cuts aren't these: with an apostrophe, with white space at an end or side by
        side, or beyond the basic plane.
        """
        text = " ".join(["", *units])
        c = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
        if "'" in text or c.max() > 0xFFFF:
            return None
        kind, space = self._kinds[c], c == 0x20
        white = kind == 3
        if white[-1] or (white[1:] & white[:-1]).any():
            return None
        cut = space.copy()
        cut[1:] |= (kind[1:] != kind[:-1]) & ~space[:-1]
        data = text.encode()
        v = np.frombuffer(data, dtype=np.uint8)
        cuts = np.zeros(len(v), dtype=bool)
        cuts[1:] = self._forced[v[:-1].astype(np.int64) << 8 | v[1:]]
        if len(v) > len(c):
            size = 1 + (c >= 0x80) + (c >= 0x800)
            at = np.cumsum(size) - size
            cuts[at[cut]] = True
            begins = at[space]
        else:
            cuts |= cut
            begins = np.flatnonzero(space)
        begin = np.flatnonzero(cuts)
        known = self._fragments
        pieces = [data[i:j] for i, j in zip(begin.tolist(), [*begin[1:].tolist(), len(data)], strict=True)]
        ids = list(map(known.get, pieces))
        if None in ids:
            new = list(set(compress(pieces, map(not_, ids))))
            if len(known) + len(new) > CACHE:
                known.clear()
                new = list(set(pieces))
            merged = list(map(self._merge, new))
            ends = np.cumsum(np.fromiter(map(len, merged), dtype=np.int64, count=len(merged))) * self.dtype.itemsize
            raw = np.fromiter(chain.from_iterable(merged), dtype=self.dtype).tobytes()
            known.update(zip(new, [raw[i:j] for i, j in zip([0, *ends.tolist()], ends.tolist(), strict=False)], strict=True))
            ids = list(map(known.get, pieces))
            if max(map(len, new)) > CACHED_CHARS:
                for piece in new:
                    if len(piece) > CACHED_CHARS:
                        del known[piece]
        first = [*np.searchsorted(begin, begins).tolist(), len(ids)]
        return {u: ids[i] if j - i == 1 else b"".join(ids[i:j]) for u, i, j in zip(units, first, first[1:], strict=False)}

    def _learn(self, units: list[str]) -> dict[str, bytes] | None:
        """The ids of units behind a space; null if one of them is empty or has white space at an end, and so isn't independent of its neighbours."""
        out = self._cut(units)
        if out is None:
            if any(not u or u[0] in self._white or u[-1] in self._white for u in units):
                return None
            odd = {u for u in units if "'" in u or max(u) > "\uffff" or self._wide.search(u)}
            even = [u for u in units if u not in odd]
            out = (self._cut(even) if even else None) or {u: self._unit(f" {u}") for u in even}
            out |= {u: self._unit(f" {u}") for u in odd}
        return out

    def _plain(self, text: str) -> bytes:
        first, *rest = text.split(" ")
        if first and first[-1] in self._white:
            return self._uneven(text)
        known = self._after_space
        ids = list(map(known.get, rest))
        if None in ids:
            new = list(set(compress(rest, map(not_, ids))))
            if len(known) + len(new) > CACHE:
                known.clear()
                new = list(set(rest))
            made = self._learn(new)
            if made is None:
                return self._uneven(text)
            if max(map(len, new)) <= CACHED_CHARS:
                known.update(made)
                ids = list(map(known.get, rest))
            else:  # longer ones aren't remembered
                known.update({u: i for u, i in made.items() if len(u) <= CACHED_CHARS})
                ids = [known.get(u) or made[u] for u in rest]
        return b"".join([self._units_seen[first], *ids]) if first else b"".join(ids)

    def _uneven(self, text: str) -> bytes:
        """A text with more white space than single spaces between its words."""
        return b"".join(map(self._units_seen.__getitem__, self._units.findall(text)))

    def encode_bytes(self, text: str | None) -> bytes:
        """The ids as little-endian integers of self.dtype."""
        if not text:
            return b""
        if self._specials and any(s in text for s in self.special):
            parts = self._specials.split(text)
            return b"".join(np.array([self.special[p]], dtype=self.dtype).tobytes() if i % 2 else self._plain(p) if p else b"" for i, p in enumerate(parts))
        return self._plain(text)

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), dtype=self.dtype).tolist()

    # -- decoding

    def decode(self, ids: list[int]) -> str:
        """Bytes of all ids, read as UTF-8; what isn't UTF-8 becomes U+FFFD, unknown ids nothing."""
        tokens, n = self.tokens, self.size
        try:
            return b"".join(map(tokens.__getitem__, ids)).decode("utf-8", "replace")
        except IndexError:
            return b"".join(tokens[i] for i in ids if 0 <= i < n).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def tokenizer(path: str) -> ForcedBoundaryBPE:
    """One per Python worker and vocabulary."""
    return ForcedBoundaryBPE(path)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>) for each row; null and empty texts give an empty array; repeated rows stay."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in batches:
            ids = [bpe.encode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["key", "ids"])

    narrow = needs(docs, key, text)
    kind = narrow.schema[key].dataType.simpleString()
    return narrow.mapInArrow(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def decode(encoded: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, text) for each row of ids; null ids give an empty text, null elements and unknown ids nothing."""
    bounded_batches(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in batches:
            texts = [bpe.decode([i for i in x or [] if i is not None]) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["key", "text"])

    narrow = needs(encoded, key, ids)
    kind = narrow.schema[key].dataType.simpleString()
    return narrow.mapInArrow(run, f"key {kind}, text string").withColumnRenamed("key", key)


def round_trip(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and decode every text in one pass: (key, n_tokens, ids_sha256, decoded_sha256).

    No shuffle; a worker holds one Arrow batch and two caches of bounded size. Null and empty texts have
    0 tokens and the digests of the empty string; repeated rows are each encoded.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        decimals, sha = bpe.decimals, hashlib.sha256
        for batch in batches:
            n, first, second = [], [], []
            for x in batch.column(1):
                ids = bpe.encode(x.as_py())
                n.append(len(ids))
                first.append(sha(",".join(map(decimals.__getitem__, ids)).encode()).hexdigest())
                second.append(sha(bpe.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())], names=["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    narrow = needs(docs, key, text)
    kind = narrow.schema[key].dataType.simpleString()
    return narrow.mapInArrow(run, f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("key", key)


def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), default_vocabulary())


QUERIES = {"op3_bpe_round_trip": op3_bpe_round_trip}
ORACLE: dict[str, str] = {}
