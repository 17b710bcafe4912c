"""Spelling variants, exact duplicates and phrases: against brute force and SQL."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quillon.llm import exact_dedup, phrases, spelling
from tests.util import oracle, rows


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((i for i, (p, q) in enumerate(zip(a, b, strict=False)) if p != q), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def listed_variants(counts, ratio=2):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    out = {}
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] is not None else None)
    return out


@pytest.mark.parametrize("pairs", [3, 2048])
def test_variants_by_listing(spark, pairs):
    rng = random.Random(pairs)
    words = {"".join(rng.choice("abé") for _ in range(rng.randrange(1, 8))) for _ in range(500)} | {"aaaaaaaa", "aaaaaaa", "a" * 300, "a" * 301, "a" * 150 + "b" + "a" * 150, "ÿ", "b", ""}
    counts = {w: rng.choice([1, 2, 4, 9, 50, 400]) for w in words}
    df = spark.createDataFrame([(w, n, 0) for w, n in counts.items()], "word string, n long, size int").withColumn("head", F.lit("clash")).repartition(5)
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.variants(df, pairs=pairs).collect()}
    assert got == listed_variants(counts)


def test_variants_edges(spark):
    df = spark.createDataFrame([("house", 3), ("house", 3), ("housse", 2), (None, 7), ("mouse", None)], "word string, n long")
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.variants(df).collect()}
    assert got == {"house": (None, "house", 6, 1, None), "housse": ("house", "house", 2, 1, 6)}
    assert spelling.variants(df.where("false")).count() == 0


def test_typed_words(spark):
    texts = [(i, "Über den ÄPFELN word2vec hélas " * 40 + "x" * 5000) for i in range(60)] + [(None, "alone"), (7, None), (8, ""), (9, "123 ..."), (9, "twice"), (9, "twice")]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("word", F.lit("clash"))
    want = Counter()
    for i, t in texts:
        for w in spelling_runs(t or ""):
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            want[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 97 == 0 else w] += 1
    got = Counter({r["word"]: r["count"] for r in spelling.typed_words(df).groupBy("word").count().collect()})
    assert got == want
    assert spelling.typed_words(df.where("false")).count() == 0


def spelling_runs(text):
    return re.findall("[a-zÀ-ÿ]+", "".join(c.lower() if c.isascii() else c for c in text))


def test_spelling_query(spark, data):
    names, want = oracle(spelling.ORACLE["op11_spelling_variants"], data)
    got = spelling.op11_spelling_variants(spark, data)
    assert sorted(got.columns) == names and rows(got) == want


def test_trie_by_dict():
    rng, trie, want, spilled = random.Random(4), exact_dedup.Trie(), Counter(), Counter()
    for i in range(4000):
        text = b"<html>" * rng.randrange(2) + bytes(rng.choice(b"abc") for _ in range(rng.randrange(0, 7)))
        node = trie.terminal(text)
        node.end = (node.end or 0) + 1
        want[text] += 1
        if i % 900 == 899:
            before = trie.held
            for t, n in trie.spilled(before // 2):
                spilled[t] += n
            assert trie.held <= before // 2
    assert trie.held == trie.size(trie.root)
    for t, n in trie.ends(trie.root):
        spilled[t] += n
    assert spilled == want


@pytest.mark.parametrize("held", [1 << 10, 48 << 20])
def test_exact_duplicates_by_listing(spark, held):
    rng = random.Random(5)
    base = ["".join(rng.choice("ab \n\té") for _ in range(rng.randrange(12))) for _ in range(120)] + ["x" * 30000, "x" * 30000 + "y", None, "", " ", " ", "  a"]
    texts = [(i, rng.choice(base)) for i in range(1500)] + [(i, "hot") for i in range(1500, 2500)]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumns({"key": F.lit("clash"), "at": F.lit(1), "n": F.lit(2)}).repartition(7)
    forms = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for i, t in texts}
    groups = {}
    for i, t in forms.items():
        groups.setdefault(t, []).append(i)
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in exact_dedup.exact_duplicates(df, held=held).collect()}
    assert got == {i: (min(groups[t]), len(groups[t]), i == min(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in forms.items()}


def test_exact_duplicates_edges(spark):
    df = spark.createDataFrame([(None, "a"), (None, "a"), (1, "b"), (1, "b"), (None, "b"), (2, "c"), (1, "c ")], "doc_id long, text string").repartition(3)
    got = Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_duplicates(df).collect())
    assert got == Counter({(None, None, 2, True): 1, (None, None, 2, False): 1, (1, 1, 3, True): 1, (1, 1, 3, False): 1, (None, 1, 3, False): 1, (2, 2, 1, True): 1, (1, 1, 1, True): 1})
    named = spark.createDataFrame([("b", "x"), ("a", "x"), (None, "x")], "name string, body string")
    assert {r["name"]: (r["keep_id"], r["kept"]) for r in exact_dedup.exact_duplicates(named, "name", "body").collect()} == {"a": ("a", True), "b": ("a", False), None: ("a", False)}
    assert exact_dedup.exact_duplicates(df.where("false")).count() == 0


def test_exact_query(spark, data):
    names, want = oracle(exact_dedup.ORACLE["op12_exact_dedup"], data)
    got = exact_dedup.op12_exact_dedup(spark, data)
    assert sorted(got.columns) == names and rows(got) == want


def listed_phrases(texts, at_least, longest):
    """Plain counts of all phrases: the contract word by word."""
    f, n = defaultdict(Counter), Counter()
    for lang, text in texts:
        lang = "und" if lang is None else lang
        lower = "".join(c.lower() if c.isascii() else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = {}
    for lang, counts in f.items():
        kept = {p: a for p, a in counts.items() if len(p) > 1 and a >= at_least}
        for p, a in kept.items():
            if any(len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in kept.items()):
                continue
            score, cut = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            out[lang, " ".join(p)] = (a, counts[p[:cut]], counts[p[cut:]], n[lang], score)
    return out


def phrase_texts(rng):
    vocabulary = [f"w{i}" for i in range(12)] + ["É", "né", "X-1", " q"]
    passage = " ".join(rng.choice(vocabulary) for _ in range(30))
    texts = [(rng.choice(["en", "fr", None]), "".join(rng.choice(vocabulary) + rng.choice([" ", " ", "\t", "  ", ". ", "\n", "!,"]) for _ in range(rng.randrange(60)))) for _ in range(150)]
    texts += [("en", passage.upper())] * 40 + [("fr", "a a a a a a, a a a")] * 12 + [("en", None), (None, ""), ("de", " \t"), ("de", ". . .")]
    return texts + [("en", (passage + "; ") * 700)]


@pytest.mark.parametrize("parts", [1, 6])
def test_phrases_by_listing(spark, parts):
    rng = random.Random(8)
    texts = phrase_texts(rng)
    df = spark.createDataFrame(texts, "lang string, text string").withColumns({"block": F.lit("clash"), "n": F.lit(1), "word": F.lit("x")}).repartition(parts)
    got = {(r["lang"], r["phrase"]): (r["a"], r["l"], r["r"], r["n"], r["score"]) for r in phrases.collocations(df, at_least=9).collect()}
    assert got == listed_phrases(texts, 9, 5)
    assert phrases.collocations(df.where("false")).count() == 0


def test_blocks_and_automata_of_any_size(monkeypatch):
    """What bounds memory changes nothing: slices of a text, and several automata for one block."""
    rng = random.Random(9)
    text = "".join(rng.choice("ab \t.,") for _ in range(5000)).encode().translate(phrases._TABLE)
    monkeypatch.setattr(phrases, "SLICE", 50)
    parts = list(phrases._slices(text))
    assert b".".join(parts) == text and max(map(len, parts)) <= 60
    sequences = [[rng.randrange(4) for _ in range(rng.randrange(1, 15))] for _ in range(300)]
    want, got = Counter(), Counter()
    for s in sequences:
        want.update(tuple(s[i : i + k]) for k in range(2, 6) for i in range(len(s) - k + 1))
    for some in (sequences[:100], sequences[100:]):
        automaton = phrases.Automaton()
        for s, n in Counter(map(tuple, some)).items():
            automaton.add(list(s), n)
        found = list(automaton.phrases(5))
        assert len({p for p, _ in found}) == len(found)
        got.update(dict(found))
    assert got == want


def test_long_runs_are_cut(monkeypatch):
    rng = random.Random(10)
    monkeypatch.setattr(phrases, "STATES", 12)
    for longest in (2, 3, 5):
        run = [rng.randrange(3) for _ in range(rng.randrange(200))]
        got = Counter()
        for piece, n in phrases._pieces(run, 7, longest):
            assert len(piece) <= 12
            automaton = phrases.Automaton()
            automaton.add(piece, n)
            for p, c in automaton.phrases(longest):
                got[p] += c
        want = Counter(tuple(run[i : i + k]) for k in range(2, longest + 1) for i in range(len(run) - k + 1))
        assert {p: c for p, c in got.items() if c} == {p: 7 * c for p, c in want.items()}


def test_phrase_query(spark, data):
    names, want = oracle(phrases.ORACLE["op13_phrase_collocations"], data)
    got = phrases.op13_phrase_collocations(spark, data)
    assert sorted(got.columns) == names and rows(got) == want
