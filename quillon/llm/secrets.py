"""Secret scans: fixed patterns, and a linear-chain conditional random field that adds to them.

The field tags the words of a text as secret begin, inside or outside. A word's features are its shape
(length, shares of digits and capitals, whether it is all hexadecimal), what it is made like (an address, a path, a
number, a name in parts), how often it changes between kinds of characters, how its vowels and consonants are spread,
the shapes of its neighbours, which of the three words before it name a secret or lead to a value, and how much
the whole file looks like code or configuration. Weights are fitted by quasi-Newton steps on the likelihood; texts are
decoded by Viterbi over all their words. A text in which no word can gain by any tag but outside, even
with the best transitions on both sides, is all outside; the others are decoded step by step.

Training sequences are windows of a bounded sample of documents (SAMPLE_DOCS in expectation), labelled by
the fixed patterns, and windows of copies of them into which made-up secrets, or made-up things that look like secrets and are
none, have been put at any place. Features are those of the whole text.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import bounded_batches, needs, table

SAMPLE_DOCS = 1200
WINDOW = 24
#: Quasi-Newton steps at most, and the penalty on squared weights.
STEPS, PENALTY = 60, 4e-5

#: The patterns of the base spans, in the order in which kinds are listed, and least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "field")
_LEAST = {"assign": 6, "access": 20, "hex": 24}

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """Leftmost matches that don't overlap, per kind; what is too short is dropped. Sorted by start, then kind as listed."""
    out: list[Span] = []
    low = text.lower()
    if any(w in low for w in ("passw", "secret", "token", "api")):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= _LEAST["assign"]]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= _LEAST["access"]]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def written_spans(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


# ---------------------------------------------------------------- features

_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.zeros(256, dtype=np.int32)
_LOWER[97:123] = 1
_NOT_HEX = np.ones(256, dtype=np.int32)
_NOT_HEX[[*range(48, 58), *range(97, 103)]] = 0
_VOWEL = np.zeros(256, dtype=np.int32)
_VOWEL[[ord(c) for c in "aeiouyAEIOUY"]] = 1
_CONSONANT = np.zeros(256, dtype=bool)
_CONSONANT[[c for c in range(128) if chr(c).isalpha() and not _VOWEL[c]]] = True
_SIGN = np.zeros(256, dtype=bool)
_SIGN[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
#: Kinds between which a random string changes often: digit, capital, small letter, sign; beyond ASCII.
_CHANGE = np.full(256, 4, dtype=np.int8)
_CHANGE[48:58] = 0
_CHANGE[65:91] = 1
_CHANGE[97:123] = 2
_CHANGE[_SIGN] = 3
_KEYWORD = re.compile(rb"passw|passphrase|passcode|secret|token|api[_-]?key|access[_-]?key|credential|auth|private|\bpin\b|\bpwd\b", re.IGNORECASE)
#: Where data or a digest of a file is written out in a page, and no secret.
_DATA = re.compile(rb"(?<![^\x20\x09-\x0D\"'(=])(?:url\([\"']?)?(?:data:[a-z]+/|sha(?:1|224|256|384|512)[-:])")
#: A password within an address.
_LOGIN = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*://[^/\x20\x09-\x0D:@]*:([^@/\x20\x09-\x0D]+)@")
_LINKS = frozenset([b"is", b"was", b"are", b"to", b"as", b"=", b":", b":=", b"=>", b"->", b"=="])

_LENGTHS = np.array([4, 8, 12, 16, 20, 32, 48])
_SIZES = np.array([8, 12, 24])
N_SHAPES, N_COARSE, N_CONTEXT, N_FILES, N_MAKES, N_CHANGES, N_SOUNDS = 8 * 4 * 3 * 2, 16, 2 * 27, 4, 15 * 4, 7 * 4, 6 * 2 * 4
#: Where each kind of feature starts among all weights.
_AT = np.cumsum([0, N_SHAPES, N_COARSE, N_COARSE, N_CONTEXT, N_FILES, N_MAKES, N_CHANGES, N_SOUNDS])
N_FEATURES = int(_AT[-1])


@dataclass
class Words:
    """The words of a batch of texts: text, begin and end in bytes, ids of the features of each."""

    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    ids: np.ndarray


def words_of(texts: list[bytes]) -> Words:
    data = np.frombuffer(b" ".join([*texts, b""]), dtype=np.uint8)
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    begins = np.cumsum(sizes + 1) - sizes - 1
    blank = _BLANK[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]]).view(np.int8))) if len(data) else np.empty(0, dtype=np.int64)
    start, end = edge[0::2], edge[1::2]
    n = len(start)
    if not n:
        return Words(start, start, start, np.zeros((0, len(_AT) - 1), dtype=np.int64))
    row = np.searchsorted(begins, start, side="right") - 1
    length = end - start
    # small letters and what isn't hexadecimal are most bytes; digits, capitals and signs are few
    lower = np.add.reduceat(_LOWER[data], start)
    vowels = np.add.reduceat(_VOWEL[data], start)
    others = np.add.reduceat(_NOT_HEX[data], start) - (np.concatenate([start[1:], [len(data)]]) - end)  # less the blanks behind each word
    kind = _CHANGE[data]

    def count(mask: np.ndarray) -> np.ndarray:
        return np.bincount(np.searchsorted(start, np.flatnonzero(mask), side="right") - 1, minlength=n)

    digits, upper = count(kind == 0), count(kind == 1)
    at = np.flatnonzero(_SIGN[data])
    owner, char = np.searchsorted(start, at, side="right") - 1, data[at]
    sign = lambda c: np.bincount(owner[char == ord(c)], minlength=n)
    signs = np.bincount(owner, minlength=n)
    slash, dot, dash, under, mail, colon = (sign(c) for c in "/.-_@:")
    assign = colon + sign("=")
    scheme = np.zeros(n, dtype=bool)
    scheme[owner[:-1][(char[:-1] == ord(":")) & (char[1:] == ord("/")) & (at[1:] == at[:-1] + 1)]] = True
    changes = count(np.concatenate([[False], (kind[1:] != kind[:-1]) & ~blank[1:] & ~blank[:-1]]))
    c = _CONSONANT[data]
    runs = np.zeros(n, dtype=bool)
    runs[np.searchsorted(start, np.flatnonzero(c[:-3] & c[1:-2] & c[2:-1] & c[3:]), side="right") - 1] = True

    letters = np.maximum(length - signs, 1)
    share = np.searchsorted([1, 15, 60], 100 * digits // letters, side="right")
    case = np.where((upper > 1) & (lower > 1), 2, np.where(upper > 1, 1, 0))
    shape = ((np.searchsorted(_LENGTHS, length, side="right") * 4 + share) * 3 + case) * 2 + (others <= signs)
    coarse = np.minimum(length // 8, 3) * 4 + (digits > 0) * 2 + (assign > 0)
    size = np.searchsorted(_SIZES, length, side="right")
    uuid = (dash == 4) & (others <= signs) & (letters > 27) & (letters < 37)
    data_word = np.zeros(n, dtype=bool)
    data_word[np.searchsorted(start, np.array([m.start() for m in _DATA.finditer(data.tobytes())], dtype=np.int64), side="right") - 1] = True
    groups = (colon + dash > 4) & (others <= signs)
    numbered = (digits > 0) & (digits < 3) & (signs == 0) & (kind[end - 1] == 0)
    make = np.select([data_word, scheme & (mail == 1) & (colon > 1), groups, scheme | (slash > 0) & (dot > 0), (mail == 1) & (dot > 0), uuid, digits + signs == length, slash > 0, under > 0, dash > 0, (digits == 0) & (signs == 0), (digits == 0) & (upper <= 1), numbered, (digits > 0) & (signs == 0)], [11, 12, 13, *range(1, 10), 14, 10], 0)
    change = np.searchsorted([1, 8, 16, 28, 40, 55], 100 * changes // np.maximum(length, 1), side="right")
    alphas = lower + upper
    sound = np.where(alphas < 4, 5, np.searchsorted([14, 24, 33, 52], 100 * vowels // np.maximum(alphas, 1), side="right"))

    role = np.zeros(n, dtype=np.int64)
    short = np.flatnonzero((length <= 3) & (lower + signs == length))
    whole = data.tobytes()
    role[[i for i, a, b in zip(short.tolist(), start[short].tolist(), end[short].tolist(), strict=True) if whole[a:b] in _LINKS]] = 2
    found = np.array([m.start() for m in _KEYWORD.finditer(whole)], dtype=np.int64)
    role[np.searchsorted(start, found, side="right") - 1] = 1
    same = row[1:] == row[:-1]
    back = lambda x, fill: np.concatenate([[fill], np.where(same, x[:-1], fill)])
    r1 = back(role, 0)
    r2 = back(r1, 0)
    context = (assign > 0) * 27 + r1 * 9 + r2 * 3 + back(r2, 0)
    # how much a file looks like code: signs and assignments among its words
    per = np.bincount(row, minlength=len(texts))
    signed = np.bincount(row, weights=(assign > 0) | (signs > 2), minlength=len(texts)) / np.maximum(per, 1)
    file = np.searchsorted([0.005, 0.05, 0.3], signed, side="right")[row]
    nxt = np.concatenate([np.where(same, coarse[1:], 0), [0]])
    kinds = [shape, back(coarse, 0), nxt, context, file, make * 4 + size, change * 4 + size, (sound * 2 + runs) * 4 + size]
    return Words(row, start - begins[row], end - begins[row], np.stack([k + a for k, a in zip(kinds, _AT[:-1], strict=True)], axis=1))


# ---------------------------------------------------------------- the field

OUT, BEGIN, IN = 0, 1, 2
_NEVER = -1e4


@dataclass
class Field:
    """weights[feature, tag] and moves[tag before, tag]; inside can't follow outside or start a text."""

    weights: np.ndarray
    moves: np.ndarray

    def emissions(self, ids: np.ndarray) -> np.ndarray:
        out = np.zeros((len(ids), 3))
        for k in range(ids.shape[1]):
            out += self.weights[ids[:, k]]
        return out

    def hopeful(self, e: np.ndarray) -> np.ndarray:
        """Words that may gain by a tag other than outside, with the best moves to and from it."""
        bonus = 2 * (self.moves[self.moves > _NEVER / 2].max() - min(self.moves[OUT, OUT], self.moves.max())) if len(e) else 0.0
        return np.maximum(e[:, BEGIN], e[:, IN]) - e[:, OUT] + max(0.0, bonus) > 0

    def viterbi(self, e: np.ndarray) -> list[int]:
        """The best tags of one text."""
        m = self.moves.tolist()
        score, back = [e[0, 0], e[0, 1], _NEVER], []
        for row in e[1:].tolist():
            step, new = [], []
            for t in range(3):
                a, b, c = score[0] + m[0][t], score[1] + m[1][t], score[2] + m[2][t]
                p = 0 if a >= b and a >= c else 1 if b >= c else 2
                step.append(p)
                new.append((a, b, c)[p] + row[t])
            back.append(step)
            score = new
        tag = max(range(3), key=score.__getitem__)
        out = [tag]
        for step in reversed(back):
            tag = step[tag]
            out.append(tag)
        return out[::-1]


def marginals(e: np.ndarray, moves: np.ndarray, used: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Probabilities of tags (sequences, words, 3) and of pairs of neighbours (sequences, words - 1, 3, 3), and the sum of log partition functions, by scaled forward and backward passes."""
    n, length = used.shape
    top = e.max(axis=2, keepdims=True)
    own, move = np.exp(e - top), np.exp(moves)
    forward, backward = np.empty((n, length, 3)), np.ones((n, length, 3))
    scale = np.ones((n, length))
    first = own[:, 0] * np.array([1.0, 1.0, 0.0])
    scale[:, 0] = first.sum(axis=1)
    forward[:, 0] = first / scale[:, 0, None]
    for i in range(1, length):
        new = forward[:, i - 1] @ move * own[:, i]
        scale[:, i] = np.where(used[:, i], new.sum(axis=1), 1.0)
        forward[:, i] = np.where(used[:, i, None], new / scale[:, i, None], forward[:, i - 1])
    for i in range(length - 2, -1, -1):
        new = (own[:, i + 1] * backward[:, i + 1]) @ move.T / scale[:, i + 1, None]
        backward[:, i] = np.where(used[:, i + 1, None], new, 1.0)
    pairs = forward[:, :-1, :, None] * move * (own * backward)[:, 1:, None, :] / scale[:, 1:, None, None]
    return forward * backward, pairs, float((np.log(scale) + top[:, :, 0])[used].sum())


def minimised(f, x: np.ndarray, steps: int, kept: int = 8, enough: float = 2e-4) -> np.ndarray:
    """x near the minimum of a convex function that gives (value, gradient), by limited-memory quasi-Newton steps with halving; ends when a step gains less than `enough` of the value."""
    value, g = f(x)
    s_list, y_list = [], []
    for _ in range(steps):
        q, coefficients = g.copy(), []
        for s, y in zip(reversed(s_list), reversed(y_list), strict=True):
            a = (s @ q) / (y @ s)
            coefficients.append(a)
            q -= a * y
        q *= (s_list[-1] @ y_list[-1]) / (y_list[-1] @ y_list[-1]) if s_list else 1.0 / max(1e-12, np.abs(g).max())
        for s, y, a in zip(s_list, y_list, reversed(coefficients), strict=True):
            q += (a - (y @ q) / (y @ s)) * s
        step = 1.0
        while True:
            new_value, new_g = f(x - step * q)
            if new_value <= value - 1e-4 * step * (g @ q) or step < 1e-6:
                break
            step /= 2
        s, y = -step * q, new_g - g
        gained, x, value, g = value - new_value, x + s, new_value, new_g
        if y @ s > 1e-12:
            s_list, y_list = [*s_list[-kept + 1 :], s], [*y_list[-kept + 1 :], y]
        if gained < enough * max(abs(value), 1e-12):
            break
    return x


def fit(ids: np.ndarray, tags: np.ndarray, used: np.ndarray, steps: int = STEPS, penalty: float = PENALTY) -> Field:
    """Maximum likelihood with a penalty on squared weights. ids: (sequences, words, features); tags, used: (sequences, words).

    Words with the same features are scored once, and their expected tags summed before they are dealt to features.
    """
    n, length = tags.shape
    barred = np.zeros((3, 3))
    barred[OUT, IN] = _NEVER
    if not n:
        return Field(np.zeros((N_FEATURES, 3)), barred)
    at = np.flatnonzero(used.ravel())
    own = ids.reshape(n * length, -1)[at]
    code = np.zeros(len(at), dtype=np.int64)
    for k, (a, b) in enumerate(zip(_AT[:-1], _AT[1:], strict=True)):
        code = code * (b - a) + own[:, k] - a
    _, first, which = np.unique(code, return_index=True, return_inverse=True)
    kinds = own[first]
    pair_used = used[:, 1:] & used[:, :-1]
    total = max(1, len(at))

    def counts(of: np.ndarray) -> np.ndarray:
        """Sums of (word, tag) over features."""
        each = np.stack([np.bincount(which, weights=of[:, t], minlength=len(kinds)) for t in range(3)], axis=1)
        return np.stack([sum(np.bincount(kinds[:, k], weights=each[:, t], minlength=N_FEATURES) for k in range(kinds.shape[1])) for t in range(3)], axis=1)

    gold = np.zeros((n, length, 3))
    np.put_along_axis(gold, tags[:, :, None], 1.0, axis=2)
    gold_moves = np.einsum("nla,nlb->ab", gold[:, :-1] * pair_used[:, :, None], gold[:, 1:])
    gold_counts = counts(gold.reshape(-1, 3)[at])
    split = N_FEATURES * 3

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        weights, moves = x[:split].reshape(-1, 3), x[split:].reshape(3, 3)
        e = np.zeros((n * length, 3))
        e[at] = weights[kinds].sum(axis=1)[which]
        expected, pairs, partition = marginals(e.reshape(n, length, 3), moves + barred, used)
        value = (partition - (gold_counts * weights).sum() - (gold_moves * moves).sum()) / total + penalty / 2 * float(x @ x)
        gradient = np.concatenate([(counts(expected.reshape(-1, 3)[at]) - gold_counts).ravel(), ((pairs * pair_used[:, :, None, None]).sum(axis=(0, 1)) - gold_moves).ravel()]) / total + penalty * x
        return value, gradient

    x = minimised(loss, np.zeros(split + 9), steps)
    return Field(x[:split].reshape(-1, 3), x[split:].reshape(3, 3) + barred)


_SMALL, _CAPITAL, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
_LETTERS = {"hex": _DIGITS + "abcdef", "upper": _CAPITAL + _DIGITS, "mixed": _SMALL + _CAPITAL + _DIGITS, "base64": _SMALL + _CAPITAL + _DIGITS + "+/", "small": _SMALL, "letters": _SMALL + _CAPITAL, "signs": _SMALL + _CAPITAL + _DIGITS + "!#$%&*+-?@^_~"}
_NAMES = ("token", "secret", "password", "passphrase", "passwd", "pwd", "pin", "api_key", "apikey", "access_key", "auth", "credential", "credentials", "private_key")
_PREFIXES = ("sk-", "key-", "tok_", "pat_", "live_")
#: Words that names in programs are made of.
_CODE = "get set is has find load save make read write user name list item items value values count index by id type from with key map data file path page order account session request response event handler service manager factory config option default current next configuration description notification repository subscription transaction permission attribute collection application".split()
#: Words that follow a secret's name and are none.
_AFTER = "required incorrect expired protected missing invalid wrong empty optional case-sensitive forgotten stored encrypted hashed changed reset below above here needed valid unknown long short strong weak shared given sent".split()


def _random(rng: np.random.Generator, letters: str, least: int, most: int) -> str:
    return "".join(rng.choice(list(letters), int(rng.integers(least, most))))


Tagged = list[tuple[str, int]]


def _made_up(rng: np.random.Generator) -> Tagged:
    """Words of a made-up secret with its surroundings, and the tag of each."""
    kind = str(rng.choice(list(_LETTERS)))
    form = int(rng.integers(0, 9))
    if form == 8:  # a password within an address
        login = _random(rng, _LETTERS[str(rng.choice(["small", "mixed"]))], 2, 12)
        host = ".".join(_random(rng, _SMALL + _DIGITS, 2, 10) for _ in range(int(rng.integers(1, 4))))
        return [(f"{rng.choice(['https', 'http', 'ftp', 'postgres', 'mysql', 'redis', 'amqp', 'mongodb+srv'])}://{login}:{_random(rng, _LETTERS[kind], 4, 24).replace('@', '')}x@{host}{rng.choice(['', ':5432', ':80'])}{rng.choice(['', '/', '/db', '/a/b?c=d'])}", BEGIN)]
    if form > 5 and rng.random() < 0.3:
        kind = "small"  # what people choose
    # without a name beside it only a long string of many kinds is a secret
    value = _random(rng, _LETTERS[kind if form else str(rng.choice(["mixed", "base64", "upper"]))], 8 if form else 28, 44 if form else 64)
    if form == 0 and rng.random() < 0.3:
        value = str(rng.choice(_PREFIXES)) + value
    quote = str(rng.choice(["", "", '"', "'"]))
    word, name = (f"{quote}{value}{quote}", BEGIN), str(rng.choice(_NAMES))
    name = name.upper() if rng.random() < 0.2 else name
    if form == 0:
        return [word]
    if form == 1:
        return [(name, OUT), (str(rng.choice(["=", ":", ":=", "->"])), OUT), word]
    if form == 2:
        return [(f"{name}:", OUT), word]
    if form == 3:
        return [(f"{name}={quote}{value}{quote}", BEGIN)]
    if form == 4:
        half = max(4, len(value) // 2)
        return [(name, OUT), ("=", OUT), (f"{quote}{value[:half]}", BEGIN), (f"{value[half:]}{quote}", IN)]
    if form == 5:
        return [(name, OUT), word]
    return [(str(rng.choice(["the", "my", "your", "our", "new"])), OUT), (name.replace("_", " ").split()[0] if form == 6 else name, OUT), (str(rng.choice(["is", "is", "was", "to"])), OUT), word]


def _harmless(rng: np.random.Generator, words: list[str]) -> Tagged:
    """Words that look like a secret, or stand where one might, and are none. words: those of the text, for names made of them."""
    plain = [w for w in words if w.isascii() and w.isalpha()][:400] or ["user", "value", "name", "list"]
    some = [str(w).lower() for w in rng.choice(plain, 6)]
    form = int(rng.integers(0, 20))
    if form == 18:
        out = ":".join(_random(rng, _LETTERS["hex"], 1, 5) for _ in range(8)) if rng.random() < 0.5 else str(rng.choice([":", "-"])).join(_random(rng, _LETTERS["hex"], 2, 3) for _ in range(6))
        out = out.upper() if rng.random() < 0.3 else out
    elif form == 16:
        out = f"data:{rng.choice(['image/png', 'image/jpeg', 'font/woff2', 'text/css', 'application/json'])};base64,{_random(rng, _LETTERS['base64'], 20, 120)}{rng.choice(['', '=', '=='])}"
        out = str(rng.choice(["{}", "url({})", 'src="{}"', '"{}"'])).format(out)
    elif form == 17:
        out = f"{rng.choice(['sha256', 'sha384', 'sha512', 'sha1'])}{rng.choice(['-', ':'])}{_random(rng, _LETTERS['base64'], 27, 88)}{rng.choice(['', '=', '=='])}"
        out = str(rng.choice(["{}", 'integrity="{}"', '"{}"', "{},"])).format(out)
    elif form <= 2:
        path = "/".join(_random(rng, _LETTERS[str(rng.choice(["hex", "mixed", "small"]))], 3, 40) if rng.random() < 0.6 else str(rng.choice(some)) for _ in range(int(rng.integers(1, 6))))
        out = f"{rng.choice(['https', 'http'])}://{rng.choice(['cdn', 'www', 'static', 'img', some[0]])}.{some[1]}.{rng.choice(['com', 'org', 'net', 'io'])}/{path}{rng.choice(['', '.js', '.png', '.html', '?v=' + _random(rng, _DIGITS, 1, 12), '?id=' + _random(rng, _LETTERS['mixed'], 4, 20)])}"
    elif form <= 4:
        h = _random(rng, _LETTERS["hex"], 32, 33)
        out = "-".join((h[:8], h[8:12], h[12:16], h[16:20], h[20:]))
        out = out.upper() if rng.random() < 0.3 else out
    elif form <= 6 or form > 18:
        some = [str(w) for w in rng.choice(_CODE, 8)] if rng.random() < 0.5 else some
        out = some[0] + "".join(w.capitalize() for w in some[1 : int(rng.integers(2, 9))]) + str(rng.choice(["", "", "V2", "2", "Id", "URL", "64"]))
    elif form == 7:
        out = str(rng.choice(["_", "-", "."])).join(some[: int(rng.integers(2, 6))]) + str(rng.choice(["", "()", "_2", ".py", ".txt"]))
        out = out.upper() if rng.random() < 0.3 else out
    elif form == 8:
        out = "/" + "/".join(some[: int(rng.integers(2, 6))]) + str(rng.choice(["", ".conf", ".tar.gz", "/1.2.3"]))
    elif form == 9:
        out = f"{some[0]}.{some[1]}{rng.integers(0, 99)}@{some[2]}.com"
    elif form == 10:
        out = str(rng.choice([f"20{rng.integers(10, 40)}-{rng.integers(10, 13)}-{rng.integers(10, 29)}T{rng.integers(10, 24)}:{rng.integers(10, 60)}:00Z", _random(rng, _DIGITS, 5, 20), f"+{rng.integers(10, 99)}-{_random(rng, _DIGITS, 3, 4)}-{_random(rng, _DIGITS, 6, 8)}", f"v{rng.integers(0, 20)}.{rng.integers(0, 20)}.{rng.integers(0, 200)}"]))
    elif form == 11:
        out = "-".join((_random(rng, _CAPITAL, 2, 4), _random(rng, _DIGITS, 3, 6), _random(rng, _CAPITAL + _DIGITS, 1, 4)))
    elif form == 12:
        out = "".join(some[: int(rng.integers(2, 5))])  # a long word
    else:
        name = str(rng.choice(_NAMES)).split("_")[0]
        after = str(rng.choice(_AFTER)) if rng.random() < 0.6 else some[0]
        return [(str(w), OUT) for w in (("the", name, "is", after), (f"{name}:", after), (name, after), ("your", name, "to", some[1]))[form % 4 if form < 15 else int(rng.integers(0, 4))]]
    before = [(str(rng.choice(["see", "id", "the", "from", "at", "file", "call"])), OUT)] if rng.random() < 0.5 else []
    return [*before, (out, OUT)]


def training(texts: list[str], seed: int = 11) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of texts, and of copies with made-up things in them; tags from the fixed patterns and the making."""
    rng, ids, tags, used = np.random.default_rng(seed), [], [], []

    def add(found: np.ndarray, own: list[int], at: int) -> None:
        at = max(0, min(at, len(own) - WINDOW))
        cut = own[at : at + WINDOW]
        if cut and cut[0] == IN:
            cut = [BEGIN, *cut[1:]]
        ids.append(np.zeros((WINDOW, found.shape[1]), dtype=np.int64))
        ids[-1][: len(cut)] = found[at : at + WINDOW]
        tags.append(cut + [OUT] * (WINDOW - len(cut)))
        used.append([True] * len(cut) + [False] * (WINDOW - len(cut)))

    for text in texts:
        words = [(m[0], m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
        if not words:
            continue
        own, starts = [OUT] * len(words), [w[1] for w in words]
        for kind, a, b in base_spans(text):
            m = ASSIGN.match(text, a) if kind == "assign" else None
            a, b = m.span(2) if m else (a, b)
            first = True
            for i in range(max(0, bisect_right(starts, a) - 1), bisect_left(starts, b)):
                if words[i][2] > a and own[i] == OUT:
                    own[i], first = BEGIN if first else IN, False
        plain = [w[0] for w in words]
        copies: list[tuple[list[str], list[int], list[int]]] = [(plain, own, [int(rng.integers(0, len(plain))), *[i - int(rng.integers(2, WINDOW - 4)) for i, t in enumerate(own) if t == BEGIN][:8]])]
        for make in (_made_up, _made_up, _made_up, _harmless, _harmless, _harmless, _harmless):
            new, at = _harmless(rng, plain) if make is _harmless else _made_up(rng), int(rng.integers(0, len(plain) + 1))
            if at < len(own) and own[at] == IN:
                continue  # not into the middle of a secret
            copies.append((plain[:at] + [w for w, _ in new] + plain[at:], own[:at] + [t for _, t in new] + own[at:], [at - int(rng.integers(0, WINDOW - 4))]))
        for w, t, places in copies:
            found = words_of([" ".join(w).encode("utf-8", "replace")]).ids
            for at in sorted(set(places)):
                add(found, t, at)
    if not ids:
        return np.zeros((0, WINDOW, len(_AT) - 1), dtype=np.int64), np.zeros((0, WINDOW), dtype=np.int64), np.zeros((0, WINDOW), dtype=bool)
    return np.stack(ids), np.array(tags), np.array(used)


_TRIM = re.compile(r"""^["'`(\[{<]*(.*?)["'`)\]}>.,;:]*$""", re.DOTALL)
#: A key and its sign stay outside the span, as in name=value.
_KEY = re.compile(r"""^[A-Za-z_.-]{1,40}["']?[:=]["']?(?=.)""")


def field_spans(texts: list[str], field: Field) -> list[list[Span]]:
    """Spans that the field finds in each text, in code points, without quotes and signs around them."""
    raw = [t.encode("utf-8", "replace") for t in texts]
    words = words_of(raw)
    out: list[list[Span]] = [[] for _ in texts]
    e = field.emissions(words.ids)
    for r in np.unique(words.row[field.hopeful(e)]).tolist():
        lo, hi = np.searchsorted(words.row, r), np.searchsorted(words.row, r + 1)
        tags = field.viterbi(e[lo:hi])
        i = 0
        while i < len(tags):
            if tags[i] == OUT:
                i += 1
                continue
            j = i + 1
            while j < len(tags) and tags[j] == IN:
                j += 1
            a, b = int(words.start[lo + i]), int(words.end[lo + j - 1])
            start = len(raw[r][:a].decode())
            piece = raw[r][a:b].decode()
            if k := _LOGIN.search(piece):
                out[r].append(("field", start + k.start(1), start + k.end(1)))
                i = j
                continue
            if k := _KEY.match(piece):
                start, piece = start + k.end(), piece[k.end() :]
            m = _TRIM.match(piece)
            if m and m[1]:
                out[r].append(("field", start + m.start(1), start + m.end(1)))
            i = j
    return out


def spans_of(texts: list[str], field: Field) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, all spans) of each text; what the field adds doesn't overlap a base span."""
    out = []
    for text, more in zip(texts, field_spans(texts, field), strict=True):
        base = base_spans(text)
        added = [s for s in more if not any(s[1] < b[2] and b[1] < s[2] for b in base)]
        out.append((base, sorted(base + added, key=lambda s: (s[1], KINDS.index(s[0])))))
    return out


def learn(docs: DataFrame, key: str = "doc_id", text: str = "text", sample_docs: int = SAMPLE_DOCS) -> Field:
    """The field, from a sample of sample_docs rows in expectation by a hash of the key.

    Windows are cut and their features made where the texts are; of a text the driver gets at most a dozen windows of two bytes a
    feature, whatever its length. Each text's made-up things follow from the text, so they don't depend on how rows are dealt out.
    """
    bounded_batches(docs.sparkSession)
    narrow = needs(docs, key, text).select(F.col(f"`{key}`").cast("string").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    n = narrow.select("key").count()
    part = F.pmod(F.xxhash64("key"), F.lit(1_000_000))
    chosen = narrow.where((part < min(1.0, sample_docs / max(1, n)) * 1_000_000) & F.col("text").isNotNull())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column(0).to_pylist():
                ids, tags, used = training([t], zlib.crc32(t.encode("utf-8", "replace")))
                if len(ids):
                    columns = [a.astype(kind).reshape(len(a), -1) for a, kind in ((ids, "<u2"), (tags, "u1"), (used, "u1"))]
                    yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in c], pa.binary()) for c in columns], names=["ids", "tags", "used"])

    rows = sorted((bytes(r["ids"]), bytes(r["tags"]), bytes(r["used"])) for r in chosen.select("text").mapInArrow(cut, "ids binary, tags binary, used binary").collect())
    if not rows:
        return fit(*training(["this is a plain line of text"] * 50))
    ids, tags, used = (np.frombuffer(b"".join(r[k] for r in rows), dtype=kind).reshape(len(rows), WINDOW, -1) for k, kind in enumerate(("<u2", "u1", "u1")))
    return fit(ids.astype(np.int64), tags[:, :, 0].astype(np.int64), used[:, :, 0].astype(bool))


def scan(docs: DataFrame, field: Field, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, base, spans) of each row: arrays of (kind, start, end) in code points.

    Null and empty texts have none; repeated rows are each scanned; very long texts are scanned whole; an empty table gives an
    empty table. No shuffle; a worker holds one Arrow batch.
    """
    bounded_batches(docs.sparkSession)
    spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    as_rows = lambda s: [dict(zip(("kind", "start", "end"), x, strict=True)) for x in s]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = spans_of(pc.fill_null(batch.column(1), "").to_pylist(), field)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([as_rows(b) for b, _ in got], spans), pa.array([as_rows(s) for _, s in got], spans)], names=["key", "base", "spans"])

    narrow = needs(docs, key, text).select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    kind = "array<struct<kind string, start long, end long>>"
    return narrow.mapInArrow(run, f"key {narrow.schema['key'].dataType.simpleString()}, base {kind}, spans {kind}").withColumnRenamed("key", key)


def values_of(text: str, spans: list[Span]) -> list[tuple[int, int]]:
    """What of each span is the secret itself, by place: of an assignment its value, without key, sign and quote."""
    return sorted(ASSIGN.match(text, a).span(2) if kind == "assign" else (a, b) for kind, a, b in spans)


def redact(docs: DataFrame, field: Field, text: str = "text", mask: str = "[secret]") -> DataFrame:
    """docs with every found secret in text replaced by mask (all columns stay); those that overlap, by one mask.

    Of an assignment only the value goes. Null texts stay null, empty ones empty; repeated rows are each treated; an empty table stays empty.
    """
    bounded_batches(docs.sparkSession)
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = docs.columns.index(text)

    def masked(t: str, spans: list[Span]) -> str:
        out, end = [], 0
        for a, b in values_of(t, spans):
            if a >= end:
                out += [t[end:a], mask]
            end = max(end, b)
        return "".join([*out, t[end:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            got = spans_of([t or "" for t in texts], field)
            new = [masked(t, spans) if spans else t for t, (_, spans) in zip(texts, got, strict=True)]
            columns = [pa.array(new, pa.string()) if i == at else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, docs.schema, strict=True))
    return docs.toDF(*names).mapInArrow(run, schema).toDF(*docs.columns)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = scan(docs, learn(docs))
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(text("base"), 256).alias("base_sha256"), text("spans").alias("spans"))


QUERIES = {"op7_secret_scan": op7_secret_scan}
ORACLE: dict[str, str] = {}
