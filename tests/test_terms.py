"""Many terms and patterns in one pass, against one after the other."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from quillon.operators import audit as A
from quillon.operators import concepts as C
from quillon.operators import terms as M


def test_contained_by_listing(spark):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abcß ") for _ in range(rng.randrange(n)))
    terms, texts = [word(5) for _ in range(200)] + ["ab", "ab"], [word(40) for _ in range(60)] + ["", None]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    want = {(k, i) for k, x in enumerate(texts) if x is not None for i, t in enumerate(terms) if t in x}
    for most in (M.MOST, 40):
        assert {(r["k"], r["term"]) for r in M.hits(df, F.col("text"), terms, most).collect()} == want
    assert [i for p in M.parts(terms, 40) for i in p] == list(range(len(terms))) and len(M.parts(terms, 40)) > 5
    assert M.hits(df, F.col("text"), []).count() == 0


PATTERNS = ["(?i)licen[sc]e", "ab+c", "x|yz", "(?:foo|bar)baz", "^start", "end$", r"\d{3}", "(a|b)c?", "[A-Z]{2}", "(?i)STRASSE", "q(?=u)", r"\p{Lu}x", "a{0,2}b", "(?:)", "((no)+|yes)!"]


def test_heads_are_in_every_match():
    rng = random.Random(4)
    for p in PATTERNS:
        known = M.heads(p)
        if known is None:
            continue
        for _ in range(3000):
            text = "".join(rng.choice(["a", "b", "c", "x", "yz", "foo", "bar", "baz", "start", "end", "1", "22", "AB", "qu", "no", "yes", "!", "Licence", "license", "Strasse", " "]) for _ in range(6))
            if re.search(p, text):
                assert any(h in text.casefold() for h in known), (p, text)


def test_many_rules_as_each_alone(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice(["a", "bb", "c", "x", "yz", "foo", "barbaz", "start", "end", "123", "AB", "qu", "nono!", "yes!", "Licence", "strasse", "Äx", " "]) for _ in range(8)) for _ in range(80)] + ["", None]
    fields = spark.createDataFrame([(i, "f" if i % 2 else "g", t) for i, t in enumerate(texts)], "k int, field string, text string").where("text is not null")
    rules = [C.Rule(f"c{i % 4}", p, "low" if i % 3 else "high", "flag" if i % 5 == 0 else None, F.col("field") == "f" if i % 4 == 0 else None, F.col("k") > 10 if i % 6 == 0 else None) for i, p in enumerate(PATTERNS * 2)]
    assert len(rules) > C.FEW
    want = set()
    for i, r in enumerate(rules):
        want |= {(x["k"], x["field"], i, *x[3:]) for x in C.tag(fields, "k", [r]).collect()}
    got = {tuple(x) for x in C.tag(fields, "k", rules).collect()}
    assert got == want
    groups = {f"g{i}": p for i, p in enumerate(PATTERNS * 2)}
    assert {tuple(x) for x in C.guards(fields, "k", groups).collect()} == {(k, f, f"g{i}") for k, f, i, *_ in want | {(x["k"], x["field"], i) for i, p in enumerate(PATTERNS * 2) for x in C.tag(fields, "k", [C.Rule("c", p)]).collect()}}


def test_audit_of_many_terms(spark):
    df = spark.createDataFrame([(1, "One, two three"), (2, "TWO"), (3, None)], "k int, text string")
    terms = ["one", "two", "Two three", "never", *[f"w{i}" for i in range(C.FEW)]]
    assert {r["term"]: r["n"] for r in A.occurrences(df, F.col("text"), terms).collect()} == {t: {"one": 1, "two": 2, "Two three": 1}.get(t, 0) for t in terms}
    assert {tuple(r) for r in A.occurrence_list(df, "k", {"text": F.col("text")}, terms).collect()} == {("one", 1, "text"), ("two", 1, "text"), ("two", 2, "text"), ("Two three", 1, "text")}
    with pytest.raises(ValueError):
        M.listed(spark.createDataFrame([("abc",)], "term string"), 2)


def test_time_does_not_follow_the_number_of_terms():
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(9))
    text = " ".join(word() for _ in range(20000))

    def took(n):
        terms = tuple(word() for _ in range(n))
        M._found(terms, "warm")
        began = time.perf_counter()
        M._found(terms, text)
        return time.perf_counter() - began

    assert took(20000) < 30 * took(200)
