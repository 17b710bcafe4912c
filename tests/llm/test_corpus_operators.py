"""Near duplicates, mixing, embeddings and the pipeline: against brute force and SQL."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import ann, embed_dedup, minhash, mixing
from quillon.llm.components import components
from quillon.llm.vectors import matrix
from tests.util import oracle, rows


def shingle_sets(texts, words):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
        out.append({tuple(w)} if 0 < len(w) < words else {tuple(w[i : i + words]) for i in range(len(w) - words + 1)})
    return out


def union_find(ids, links):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 140)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    df = spark.createDataFrame(edges + [(None, 3), (5, None), (7, 7)] + edges[:5], "a long, b long")
    want = union_find({x for e in edges for x in e}, edges)
    got = dict(components(df).collect())
    assert got == {k: v for k, v in want.items() if any(k in e and e[0] != e[1] for e in edges)}
    assert components(df.where("false")).count() == 0


def near_copies(rng, n, length, edits):
    vocabulary = [f"w{i}" for i in range(3000)]
    base = [rng.choice(vocabulary) for _ in range(length)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits)):
            w[rng.randrange(length)] = rng.choice(vocabulary)
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates_by_brute_force(spark, words):
    rng = random.Random(words)
    texts = near_copies(rng, 120, 90, 14) + near_copies(rng, 40, 12, 3) + near_copies(rng, 30, 300, 60) + ["", None, " \n", "One", "one", "one two", "ONE two", "É one two three four", "é one two three four"]
    texts += texts[:7]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n", F.lit("clash")).withColumn("bucket", F.lit(1)).repartition(5)
    sets = shingle_sets(texts, words)
    links = [(a, b) for b in range(len(texts)) for a in range(b) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = union_find(range(len(texts)), links)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(df, words=words).collect()}
    assert got == {i: (len(s), want[i], want[i] == i) for i, s in enumerate(sets)}


def test_near_duplicates_edges(spark):
    df = spark.createDataFrame([(None, "a b c"), (1, "a b c"), (1, "a b c"), (2, "a b c"), (3, None)], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["component_id"], r["kept"]) for r in minhash.near_duplicates(df, words=2).collect() if r["doc_id"])
    assert got == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 3, True)]
    assert minhash.near_duplicates(df.where("false"), words=2).count() == 0


def test_near_duplicates_query(spark, data):
    names, want = oracle(minhash.ORACLE["op5_minhash_near_dedup"], data)
    got = minhash.op5_minhash_near_dedup(spark, data)
    assert sorted(got.columns) == names and rows(got) == want


def sainte_lague(votes, seats):
    got = {k: 0 for k in votes}
    for _ in range(seats):
        k = min(votes, key=lambda k: (-votes[k] / (2 * got[k] + 1), k))
        got[k] += 1
    return got


def test_sainte_lague_by_listing(spark):
    rng, cases = random.Random(2), []
    for g in range(25):
        votes = {f"p{i}": rng.choice([0, 1, 7, rng.randrange(1, 5000)]) for i in range(rng.randrange(1, 9))}
        cases.append((g, votes, rng.randrange(0, 60) if any(votes.values()) else 0))
    df = spark.createDataFrame([(g, k, v, n) for g, votes, n in cases for k, v in votes.items()], "g int, p string, votes long, seats long")
    got = defaultdict(dict)
    for r in mixing.sainte_lague(df, ["g"], "votes", "seats", ["p"]).collect():
        got[r["g"]][r["p"]] = r["quota"]
    for g, votes, n in cases:
        assert got[g] == sainte_lague(votes, n), (g, votes, n)


def test_targets_by_resharing(spark):
    sizes = {"a": 10, "b": 1000, "c": 5, "d": 700, "e": 0, "f": 30}
    df = spark.createDataFrame([(False, k, v) for k, v in sizes.items()], "no_source boolean, source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
    weight = {k: (1, 2, 3)[i % 3] for i, k in enumerate(sorted(sizes))}
    target, free, left = {}, set(sizes), float(sum(sizes.values()))
    while free:
        share = {k: left * weight[k] / sum(weight[x] for x in free) for k in free}
        over = {k for k in free if share[k] > 3 * sizes[k]}
        if not over:
            target |= share
            break
        for k in over:
            target[k] = 3.0 * sizes[k]
        left, free = left - sum(target[k] for k in over), free - over
    assert got == pytest.approx(target)


@pytest.mark.parametrize("shard_docs", [4096, 20])
def test_mix(spark, data, shard_docs):
    docs = spark.read.parquet(f"{data}/documents.parquet").withColumn("size", F.lit("clash")).withColumn("shard", F.lit("clash"))
    got = mixing.mix_sources(docs, shard_docs=shard_docs)
    assert rows(got) == rows(mixing.mix_sources(docs.repartition(7), shard_docs=shard_docs))
    by = defaultdict(lambda: [0, 0, 0])
    for r in got.collect():
        assert 0 <= r["taken"] <= 3 * r["size"]
        by[r["source"]][0] += r["taken"]
        by[r["source"]][1] = r["target"]
        by[r["source"]][2] = r["source_size"]
    for taken, target, size in by.values():
        assert abs(taken - target) <= 1 if target < 2.9 * size else 0.99 * target <= taken <= target + 1, (taken, target, size)


@pytest.mark.parametrize("own_words", [10, 40])
def test_mix_hits_targets_of_small_sources(spark, own_words):
    """Sources of 1, 3 and 300 short documents beside 300,000: each within a word of its target, by the contract's own rules."""
    few = [(f"s{n}", n * 1_000_000 + i, own_words) for n in (1, 3, 300) for i in range(n)]
    small = spark.createDataFrame(few, "source string, doc_id long, words int").select("doc_id", "source", F.repeat(F.lit("w "), F.col("words")).alias("text"))
    large = spark.range(300_000).select("id", F.lit("t").alias("source"), F.lit("a b c").alias("text"))
    got = mixing.mix_sources(small.union(large)).groupBy("source").agg(F.sum("size"), F.first("target"), F.sum("taken"), F.max(F.col("taken") / F.col("size"))).collect()
    sizes = {f"s{n}": n * own_words for n in (1, 3, 300)} | {"t": 900_000}
    # the three small sources come first and are filled up; the large one gets the rest
    targets = {k: 3 * v for k, v in sizes.items() if k != "t"}
    targets["t"] = sum(sizes.values()) - sum(targets.values())
    for source, size, target, taken, most in got:
        assert size == sizes[source] and target == pytest.approx(targets[source])
        assert abs(taken - target) <= 1 and most <= 3, (source, taken, target)


def test_mix_query(spark, data):
    names, want = oracle(mixing.ORACLE["op2_mix_sources"], data)
    got = mixing.op2_mix_sources(spark, data)
    assert sorted(got.columns) == names and rows(got) == want


def test_mix_edges(spark):
    df = spark.createDataFrame([(1, "a b", None), (2, None, "s"), (3, "", "s"), (None, "x y z", "t"), (None, "x y z", "t"), (4, "v " * 300_000, "u")], "doc_id long, text string, source string").withColumn("part", F.lit("clash"))
    got = mixing.mix_sources(df).collect()
    assert len(got) == 6 and sum(r["size"] for r in got) == 300_008 and all(r["taken"] <= 3 * r["size"] for r in got)
    assert mixing.mix_sources(df.where("false")).count() == 0


def clusters(rng, n, dim=32):
    centres = rng.normal(size=(n // 10, dim))
    x = centres[rng.integers(0, len(centres), n)] + rng.normal(size=(n, dim)) * rng.choice([0.02, 0.12, 0.8], size=(n, 1))
    x[5] = x[6]
    x[7] = x[6] * 2
    return x


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(4)
    x = clusters(rng, 700)
    out = [(i, v.tolist(), int(rng.integers(0, 3))) for i, v in enumerate(x)]
    out += [(900, None, 1), (901, [0.0] * 32, 1), (902, [float("nan")] + [1.0] * 31, 1), (903, [None] + [1.0] * 31, 1), (904, [1.0, 2.0], 1), (907, [2.0, 4.0], 1), (908, [1.0, 2.01], 1), (909, [-2.0, 1.0], 1), (910, [1.0, 2.0], 2), (850, [1.0, 2.2], 1), (905, x[6].tolist(), None), (906, [], 1), (950, x[6].tolist(), 0), (950, x[6].tolist(), 0), (951, (x[6] * 1.5).tolist(), 0), (951, x[8].tolist(), 0), (951, x[8].tolist(), 1)]
    return spark.createDataFrame(out, "vec_id long, embedding array<double>, label int").withColumn("id", F.lit("clash")).withColumn("vec", F.lit("clash"))


def usable(v):
    return v is not None and len(v) > 0 and None not in v and np.isfinite(v).all() and np.any(v)


def cosines(data):
    """Of all vectors with all; -2 between different lengths."""
    out = np.full((len(data), len(data)), -2.0)
    lengths = np.array(list(map(len, data)))
    for n in set(lengths.tolist()):
        at = np.flatnonzero(lengths == n)
        x = np.array([data[i] for i in at], dtype=float)
        norm = np.linalg.norm(x, axis=1)
        out[np.ix_(at, at)] = x @ x.T / norm[:, None] / norm[None]
    return out


def test_embedding_duplicates_by_brute_force(vectors):
    got = [(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embed_dedup.near_duplicates(vectors).collect()]
    data = [(r["vec_id"], r["embedding"], r["label"]) for r in vectors.collect()]
    good = [(i, np.array(v), lab) for i, v, lab in data if usable(v) and lab is not None]
    cos = cosines([v for _, v, _ in good])
    label = np.array([lab for _, _, lab in good])
    linked = (cos >= 0.98) & (label[:, None] == label[None])
    np.fill_diagonal(linked, False)
    ids = [i for i, _, _ in good]
    want = union_find({i for i, _, _ in data}, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(linked), strict=True)])
    expected = sorted([(i, int(n), want[i], want[i] == i) for i, n in zip(ids, linked.sum(axis=1), strict=True)] + [(i, 0, i, True) for i, v, lab in data if not (usable(v) and lab is not None)])
    same = np.mean([a == b for a, b in zip(sorted(got), expected, strict=True)])
    assert len(got) == len(data) and same >= 0.995
    by_id = dict((g[0], g[1]) for g in got)
    assert (by_id[904], by_id[908], by_id[909], by_id[910]) == (3, 3, 0, 0)
    assert embed_dedup.near_duplicates(vectors.where("false")).count() == 0
    assert sum(by_id[i] for i, *_ in expected) >= 0.99 * sum(n for _, n, *_ in expected)


def test_embedding_query(spark, data):
    names, want = oracle(embed_dedup.ORACLE["op9_embedding_near_dedup"], data)
    got = embed_dedup.op9_embedding_near_dedup(spark, data)
    assert sorted(got.columns) == names and rows(got) == want


def test_codes_are_balanced():
    x = clusters(np.random.default_rng(1), 2000, 64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    p = embed_dedup.learn_rotations(x, 24, 16)
    c = embed_dedup.codes(x, p, 24)
    assert c.shape == (2000, 24) and c.max() < 1 << 16
    assert 0.1 < ((x @ p) >= 0).mean() < 0.9
    bits = ((c[:, :, None] >> np.arange(16)) & 1).reshape(2000, -1)
    words = embed_dedup.packed(c, 16)
    assert words.shape == (2000, 6)
    for n in (20, 400):
        assert (embed_dedup.hamming(words[:n], words[500:580]) == (bits[:n, None] != bits[None, 500:580]).sum(axis=2)).all()
    odd = embed_dedup.packed(c[:5, :7] & 0x1FFF, 13)
    assert odd.shape == (5, 2) and (embed_dedup.hamming(odd, odd) == (bits.reshape(2000, 24, 16)[:5, None, :7, :13] != bits.reshape(2000, 24, 16)[None, :5, :7, :13]).sum(axis=(2, 3))).all()
    cos, far = x[:400] @ x[:400].T, embed_dedup.hamming(words[:400], words[:400]) / 384
    assert far[cos >= 0.98].max() < embed_dedup.FAR < far[np.abs(cos) < 0.1].mean()


def test_nearest_by_brute_force(vectors):
    data = [(r["vec_id"], r["embedding"]) for r in vectors.collect() if usable(r["embedding"])]
    ids, cos = np.array([i for i, _ in data]), cosines([v for _, v in data])
    got = defaultdict(list)
    for r in ann.search(vectors, F.col("vec_id") % 50 == 0, shard=200).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert set(got) == {i for i in ids.tolist() if i % 50 == 0}
    hits = total = 0
    for q in got:
        best = {}
        for i, v in zip(ids.tolist(), cos[np.flatnonzero(ids == q)[0]].tolist(), strict=True):
            if i != q and v > -2:
                best[i] = max(v, best.get(i, -2))
        want = sorted(best.items(), key=lambda t: (-round(t[1], 12), t[0]))[:5]
        assert all(abs(best[i] - v) < 1e-9 for i, v in got[q]) and [v for _, v in got[q]] == sorted((v for _, v in got[q]), reverse=True)
        assert len(got[q]) == len(want)
        hits += len({i for i, _ in want} & {i for i, _ in got[q]})
        total += len(want)
    assert hits / total >= 0.95
    assert {i for i, _ in got[850]} == {904, 907, 908, 909, 910}


def test_nearest_recall_on_the_tables(spark):
    """All queries of a whole table against brute force."""
    folder = "/root/testdata/sf0.1"
    rows_ = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").collect() if usable(r["embedding"])]
    ids, x = np.array([i for i, _ in rows_]), np.array([v for _, v in rows_], dtype=float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = defaultdict(dict)
    for r in ann.op10_nearest_neighbours(spark, folder).collect():
        got[r["query_id"]][r["vec_id"]] = r["score"]
    asked = np.flatnonzero(ids % 50 == 0)
    assert set(got) == set(ids[asked].tolist())
    hits = 0
    for q, s in zip(asked.tolist(), x[asked] @ x.T, strict=True):
        s[q] = -2
        fifth = np.sort(s)[-5]
        hits += sum(v >= fifth - 1e-9 for v in got[int(ids[q])].values())
    assert hits >= 0.9 * 5 * len(asked), hits / len(asked) / 5


def test_nearest_edges(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (50, None)], "vec_id long, embedding array<double>")
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in ann.search(df, F.col("vec_id") % 50 == 0).collect()]
    assert sorted(got) == [(0, 1, 1), (0, 2, 2)]
    assert ann.search(df.where("false"), F.col("vec_id") % 50 == 0).count() == 0


def test_robust_prune_keeps_nearest():
    x = clusters(np.random.default_rng(2), 300)
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    kept = ann.robust_prune(x, np.arange(20), np.broadcast_to(np.arange(300), (20, 300)).copy(), 8, 1.2)
    for i in range(20):
        far = 2 - 2 * x @ x[i]
        far[i] = np.inf
        assert kept[i, 0] >= 0 and abs(far[kept[i, 0]] - far.min()) < 1e-5 and i not in kept[i]
    assert matrix([]).shape == (0, 0)


def test_pipeline_stages(spark, data):
    """Each stage against a plainer way on its own input."""
    import corpus_pipeline as p
    from quillon.llm.common import table, written

    assert [n for n, _ in p.STAGES] == ["language_id", "near_duplicates", "secret_scan", "mix_sources", "bpe"]
    docs, seen = table(spark, data, "documents"), {}
    for name, stage in p.STAGES:
        before, docs = docs, written(stage(spark, docs, data), name)
        seen[name] = (before, docs)
        if name != "bpe":
            assert sorted(docs.columns) == sorted(p.COLUMNS)
    before, after = seen["language_id"]
    assert after.count() >= 0.98 * before.count()
    before, after = seen["near_duplicates"]
    known = before.select("doc_id", "text").collect()
    sets = shingle_sets([r["text"] for r in known], 5)
    links = [(known[a]["doc_id"], known[b]["doc_id"]) for b in range(len(known)) for a in range(b) if sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    want = union_find([r["doc_id"] for r in known], links)
    assert sorted(r["doc_id"] for r in after.select("doc_id").collect()) == sorted(i for i, c in want.items() if i == c)
    before, after = seen["secret_scan"]
    assert after.count() == before.count() and after.where("text rlike '[0-9a-f]{24,}'").count() == 0
    assert after.where("n_chars != char_length(text)").count() == 0
    before, after = seen["mix_sources"]
    copies = {r["doc_id"]: r["count"] for r in after.groupBy("doc_id").count().collect()}
    taken = {r["doc_id"]: int(r["taken"] / r["size"] + 0.5) for r in mixing.mix_sources(before).where("size > 0").collect()}
    assert copies == {k: v for k, v in taken.items() if v}
    before, after = seen["bpe"]
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    import hashlib

    assert after.count() == before.count()
    assert all(r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest() and r["n_tokens"] == len(r["ids"]) for r in after.collect())


def test_pipeline_edges(spark, data):
    import corpus_pipeline as p
    from quillon.llm.common import written

    odd = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (3, "hello there friend of mine", "en", "s", 26), (3, "hello there friend of mine", "en", "s", 26), (None, "hello there again my friend", None, None, 3)], "doc_id long, text string, lang string, source string, n_chars long")
    for docs in (odd, odd.where("false")):
        for name, stage in p.STAGES:
            docs = written(stage(spark, docs, data), name)
    assert docs.count() == 0


def test_pipeline_stages_with_clashing_columns_and_long_texts(spark, data):
    """Each stage on a table with columns of the names that operators use inside, and a text of a million characters."""
    import corpus_pipeline as p
    from quillon.llm.common import table, written

    docs = table(spark, data, "documents").limit(60)
    long = docs.limit(1).withColumns({"doc_id": F.lit(10_000_000).cast("long"), "text": F.concat(F.lit("password = hunter22x "), F.repeat(F.lit("the words of one very long text and its secret "), F.lit(20_000)))})
    docs = written(docs.unionByName(long), "odd")
    for name, stage in p.STAGES:
        odd = docs
        for c in ("key", "size", "taken", "copies", "turn", "copy", "lang_pred", "rejected", "component_id", "kept", "part", "ids", "mark", "shard", "n"):
            odd = odd.withColumn(c, F.lit("clash"))
        docs = written(stage(spark, odd, data), name)
        if name != "bpe":
            assert docs.columns == p.COLUMNS, name
            if name == "secret_scan":
                assert docs.where("doc_id = 10000000").select(F.left("text", F.lit(30))).first()[0] == "password = [secret] the words "
    assert docs.where("doc_id = 10000000").select("n_tokens").distinct().count() == 1


def test_mix_stage_with_repeated_rows(spark, data):
    import corpus_pipeline as p

    rows_in = [(i // 2, f"w{i // 4} " * (5 + i // 4), "en", f"s{i % 2}", 1) for i in range(40)] * 2
    docs = spark.createDataFrame(rows_in, "doc_id long, text string, lang string, source string, n_chars long")
    want = sum(int(r["taken"] / r["size"] + 0.5) for r in mixing.mix_sources(docs).collect())
    out = p.mix_sources(spark, docs, data)
    assert out.count() == want and out.columns == p.COLUMNS


@pytest.mark.parametrize(("small", "other"), [("a", 10_500), ("b", 30_800)])
def test_mix_stage_keeps_a_small_source_near_its_target(spark, data, small, other):
    """70 documents in a table of so many rows that each would be a shard of its own; targets of 0.45 and 1.4 times their words."""
    import corpus_pipeline

    rng = random.Random(7)
    sizes = [rng.randrange(100, 700) for _ in range(70)]
    few = spark.createDataFrame([(100_000 + i, "w " * n, "l", small, 0) for i, n in enumerate(sizes)], "doc_id long, text string, lang string, source string, n_chars long")
    many = spark.range(66_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < other, "v").alias("text"), F.lit("l").alias("lang"), F.lit("b" if small == "a" else "a").alias("source"), F.lit(0).cast("long").alias("n_chars"))
    got = corpus_pipeline.mix_sources(spark, few.unionByName(many), data).where(F.col("source") == small)
    words = got.select(F.sum(F.regexp_count("text", F.lit(mixing.WORD)))).collect()[0][0]
    target = (sum(sizes) + other) * (1 if small == "a" else 2) / 3
    assert abs(words - target) <= 400, (words, target)  # half a document and a block
    assert got.select("doc_id").distinct().count() >= (20 if small == "a" else 70)


def test_components_of_any_size(spark):
    """Vectors whose squares vanish or overflow link and are found as their scaled ones would be."""
    rng = np.random.default_rng(3)
    base = rng.standard_normal((6, 8))
    data = [(10 * k + j, (base[k] * f).tolist(), 1) for k in range(6) for j, f in enumerate((1.0, 1e-200, 1e200, -1e-300))] + [(100, [1e-200, 1e-200] + [0.0] * 6, 1), (101, [5e-324, 5e-324] + [0.0] * 6, 1), (102, [1e308, 1e308] + [0.0] * 6, 1)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embed_dedup.near_duplicates(df).collect()}
    unit = np.array([np.array(v) / np.abs(v).max() for _, v, _ in data])
    linked = cosines(unit.tolist()) >= 0.98
    np.fill_diagonal(linked, False)
    ids = [i for i, _, _ in data]
    want = union_find(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(linked), strict=True)])
    assert got == {i: (int(n), want[i]) for i, n in zip(ids, linked.sum(axis=1), strict=True)}
    near = {}
    for r in ann.search(df, F.col("vec_id") % 50 == 0).collect():
        near.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert {near[100][1][0], near[100][2][0]} == {101, 102} and all(abs(near[100][k][1] - 1) < 1e-12 for k in (1, 2))
