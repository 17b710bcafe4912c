"""The stored index against single searches."""

import random

import numpy as np
from pyspark.sql import functions as F

from quillon.operators import search as S
from quillon.operators import search_index as X

LEXICON = S.Lexicon((S.Group("g", ("abc", "d e", "zz"), ("Kind",)), S.Group("h", ("法强", "q"), ())), (("Kind", "kind label"), ("other", "e")))
SURFACES = S.Surfaces(names=("name", "other"), effects=("effect",), requirements="needs", synonyms="also", concepts="kinds")


def records(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randrange(1, 5)))
    text = lambda n: " ".join(word() for _ in range(rng.randrange(n)))
    rows = [(i, text(3), text(2) or None, text(12), [text(4), None, text(2)], [word()] if i % 3 else None, ["kind"] if i % 5 == 0 else []) for i in range(80)]
    rows += [(90, "ＡＢＣ 法强", None, None, None, None, None), (91, "", "", "x" * 5000 + " end", [], [], ["KIND", "other"])]
    return spark.createDataFrame(rows, "k int, name string, other string, effect string, needs array<string>, also array<string>, kinds array<string>").withColumns({"surface": F.lit("clash"), "key": F.lit("clash")})


QUERIES = ["a", "ab", "abc", "ABC kind label", "d e", "法强", "e a b", "zz", "q", "end x", "xxxx", "kind label", "", None, " !! ", "nowhere abc", "cd cd"]


def rows_of(df, key):
    return sorted((r[key], r["total"], round(r["score"], 6), tuple(r["matched_fields"]), tuple((m["score"], m["field"], m["path"], m["term"], m["kind"]) for m in r["matches"])) for r in df.collect())


def test_batch_is_each_alone(spark, tmp_path):
    df = records(spark)
    index = X.build(df, "k", SURFACES, str(tmp_path / "index"), "k")
    queries = spark.createDataFrame(list(enumerate(QUERIES)), "n int, q string")
    batch = X.search_batch(index, queries, "n", "q", LEXICON).cache()
    for i, q in enumerate(QUERIES):
        assert rows_of(batch.where(F.col("n") == i), "key") == rows_of(S.search(df, q or "", SURFACES, LEXICON, "k"), "k"), q
    batch.unpersist()
    for q in ("ab", "ABC kind label", "", "nowhere"):
        assert rows_of(X.search_one(index, q, LEXICON), "key") == rows_of(S.search(df, q, SURFACES, LEXICON, "k"), "k"), q


def test_empty_index(spark, tmp_path):
    index = X.build(records(spark).where("false"), "k", SURFACES, str(tmp_path / "none"))
    assert X.search_one(index, "abc", LEXICON).count() == 0
    assert X.search_batch(index, spark.createDataFrame([(1, "a")], "n int, q string").where("false"), "n", "q").count() == 0


def test_one_query_reads_its_folders(spark, tmp_path):
    index = X.build(records(spark), "k", SURFACES, str(tmp_path / "index"), "k")
    plan = X.containing(index, spark.createDataFrame([("abc",)], "term string"), ["abc"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(folder" in plan or "PartitionFilters: [folder" in plan


def test_batch_holds_records_not_pairs(spark, tmp_path, monkeypatch):
    """What is kept on the way grows with the records, not with queries times records: a clause that many queries share is hit once."""
    kept = []
    monkeypatch.setattr(X, "saved", lambda df, name: kept.append((name, df.cache().count())) or df)
    df = spark.range(60).selectExpr("id as k", "concat('common w', id % 6) as name")
    index = X.build(df, "k", S.Surfaces(names=("name",)), str(tmp_path / "index"))
    queries = spark.range(300).selectExpr("id as n", "concat('common w', id % 6, if(id % 2 = 0, ' co', '')) as q")
    got = X.search_batch(index, queries, "n", "q")
    assert got.count() == 3000
    assert dict(kept)["held"] == 60
    assert {r["total"] for r in got.collect()} == {700 + 500, 700 + 500 + 700}


def test_postings_are_lists(spark, tmp_path):
    """Every gram of every surface, in lists, not a row each."""
    df = spark.range(2000).selectExpr("id as k", "concat('same name ', id % 3) as name")
    index = X.build(df, "k", S.Surfaces(names=("name",)), str(tmp_path / "index"))
    want = {(f[i : i + n], f) for f in (f"same name {j}" for j in range(3)) for n in (1, 2, 3) for i in range(len(f) - n + 1)}
    got = index.postings.join(index.surfaces, "surface").groupBy("gram", "form").agg(F.count("*").alias("n"), F.countDistinct("surface").alias("d")).collect()
    assert {(r["gram"], r["form"]) for r in got} == want and all(r["n"] == r["d"] == len(range(int(r["form"][-1]), 2000, 3)) for r in got)
    assert index.lists.count() * 20 < index.postings.count()
    assert {r["gram"]: r["surfaces"] for r in index.grams.collect()}["sam"] == 2000


def test_lists_of_odd_forms():
    """Forms of one and two characters, of a zero character, beyond the basic plane, with very many characters, and ids too far apart for one list."""
    rng = random.Random(3)
    forms = ["a", "ab", "\0", "\0\0a\0", "𝒳y𝒳y", "aaaa", "a\U0010ffff"] + ["".join(rng.choice("abc𝒳法") for _ in range(rng.randrange(1, 30))) for _ in range(40)] + ["".join(map(chr, range(0x4E00 + 700 * i, 0x4E00 + 700 * i + 20000))) for i in range(3)] * 2
    ids = np.array([i if i % 2 else i + (1 << 33) for i in range(len(forms))])
    short = len(forms) - 6
    read = lambda batches: sorted((r["gram"], r["base"] + o) for b in batches for r in b.to_pylist() for o in r["offsets"])
    runs = lambda f: {f[i : i + n] for n in (1, 2, 3) for i in range(len(f) - n + 1)}
    assert read(X._lists(ids[:short], forms[:short])) == sorted((g, i) for i, f in zip(ids[:short].tolist(), forms[:short], strict=True) for g in runs(f))
    n = [0] * len(forms)
    for b in X._lists(np.arange(len(forms)), forms):
        for o, base in zip(b.column("offsets").to_pylist(), b.column("base").to_pylist(), strict=True):
            for x in o:
                n[base + x] += 1
    few = [len(runs(f)) for f in forms[: short + 3]]
    assert n == few[:short] + few[short:] * 2


def test_postings_over_batches(monkeypatch):
    """Surfaces are put together over batches, and a batch is cut, at the number of characters."""
    import pyarrow as pa

    monkeypatch.setattr(X, "LISTED", 10)
    forms = ["abc", "d", "efghijklmnopqrst", "u", "vw", "x", "abc", "abcabc", "yz"]
    batches = [pa.RecordBatch.from_arrays([pa.array(range(a, b), pa.int64()), pa.array(forms[a:b], pa.string())], ["surface", "form"]) for a, b in ((0, 2), (2, 2), (2, 7), (7, 9))]
    got = sorted((r["gram"], r["base"] + o) for b in X._posted(iter(batches)) for r in b.to_pylist() for o in r["offsets"])
    assert got == sorted({(f[i : i + n], j) for j, f in enumerate(forms) for n in (1, 2, 3) for i in range(len(f) - n + 1)})


def test_one_query_joins_what_holds_its_terms(spark, tmp_path):
    """Forms that hold none of one query's terms are dropped where they are read, before the join."""
    index = X.build(records(spark), "k", SURFACES, str(tmp_path / "index"), "k")
    plan = X.containing(index, spark.createDataFrame([("abc",)], "term string"), ["abc"])._jdf.queryExecution().executedPlan().toString()
    assert "Contains(form, abc)" in plan or "StringContains(form,abc)" in plan
