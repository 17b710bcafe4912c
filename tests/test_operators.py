"""Semantics of single operators on small fixtures."""

import json
import time

import pytest
from pyspark.sql import functions as F

from quillon.functions import conditions as C
from quillon.functions import intervals as I
from quillon.functions import text as T
from quillon.operators import align as A
from quillon.operators import components as K
from quillon.operators import pool as P
from quillon.operators import probability as Pr
from quillon.operators import resolve as R
from quillon.operators import rules as U
from quillon.operators import search as S
from quillon.operators import validate as W
from quillon.sources import catalogue, elements, pages, sinks
from quillon.streaming.pool import stream_pool

RANGES = "array<struct<start:struct<stage:int,round:int>,end:struct<stage:int,round:int>>>"


@pytest.fixture(scope="module")
def records(spark):
    two = [((4, 2), (4, 7)), ((6, 1), (10, 1))]
    rows = [("a", "combat", 0.0, None, [((2, 1), (3, 5))], None), ("b", "shop", 10.0, 12.0, two, "shiny"), ("c", "combat", 35.0, None, two, ""), ("d", "shop", 5.0, None, [], None)]
    return spark.createDataFrame(rows, f"id string, category string, cost double, least double, ranges {RANGES}, variant string")


COLUMNS = P.Columns(least_gold="least", ranges="ranges", variant="variant")


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_intervals(records):
    keep = lambda **k: ids(P.candidate_pool(records, P.Criteria(**k), COLUMNS))
    assert keep(point=(4, 2)) == ["b", "c"] and keep(point=(4, 7)) == ["b", "c"] and keep(point=(5, 1)) == []
    assert keep(range=((3, 5), (4, 1))) == ["a"] and keep(range=((1, 1), (20, 1))) == ["a", "b", "c"]
    assert keep(reference_ranges=[((2, 1), (4, 3))]) == ["a", "b", "c"]
    assert keep(reference_ranges=[((2, 1), (4, 3))], reference_from=(4, 1)) == ["b", "c"]
    assert keep(reference_ranges=[]) == []


def test_affordability_and_scalars(records):
    keep = lambda **k: ids(P.candidate_pool(records, P.Criteria(**k), COLUMNS))
    assert keep(gold=11) == ["a", "d"] and keep(gold=12) == ["a", "b", "d"] and keep(gold=0, affordable_only=False) == ["a", "b", "c", "d"]
    assert keep(variant_only=True) == ["b"] and keep(min_cost=5, max_cost=10) == ["b", "d"]
    assert keep(categories=("combat",), excluded=("a",)) == ["c"]
    assert keep(excluded=tuple("abxyz") + tuple(map(str, range(2000)))) == ["c", "d"]


def test_remaining(spark):
    df = spark.sql("select array(struct(1 as start, 3 as end), struct(5 as start, 9 as end)) as r")
    out = df.select(I.remaining(F.col("r"), F.lit(6)).alias("r")).first()["r"]
    assert [(x["start"], x["end"]) for x in out] == [(6, 9)]


def test_conditions_are_three_valued(spark):
    schema = "type string, operator string, v_num double, v_str string, v_bool boolean, v_arr array<string>, evaluable boolean"
    cases = [
        (("gold", ">=", 35.0, None, None, None, True), {"gold": 35}, True), (("gold", "<", 10.0, None, None, None, True), {"gold": 10}, False),
        (("gold", ">=", 35.0, None, None, None, False), {"gold": 50}, None), (("gold", ">=", 35.0, None, None, None, True), {}, None), (("gold", None, 35.0, None, None, None, True), {"gold": 35}, None),
        (("gold", "=", None, "35", None, None, True), {"gold": 35}, None), (("once", "!=", None, None, True, None, True), {"once": False}, True),
        (("mode", "in", None, None, None, ["x", "y"], True), {"mode": "y"}, True), (("trait", "active", None, "t", None, None, True), {"trait": ["t"]}, True), (("trait", "inactive", None, "t", None, None, True), {"trait": ["t"]}, False), (("trait", "active", None, "t", None, None, True), {"trait": "t"}, None),
    ]
    for row, state, expected in cases:
        df = spark.createDataFrame([(row,)], f"r struct<{','.join(c.strip().replace(' ', ':', 1) for c in schema.split(','))}>")
        assert df.select(C.evaluate(F.col("r"), state)).first()[0] is expected, (row, state)


def test_knowledge_has_five_buckets(spark):
    df = spark.createDataFrame([("unknown", None, None, False), (None, None, None, False), ("confirmed", None, None, False), ("confirmed", 3, None, False), (None, None, 0, True), (None, None, None, True)], "s string, v int, p int, there boolean")
    state = lambda flag: [r[0] for r in df.select(C.knowledge_state(F.col("s"), F.col("v"), F.col("p"), F.col("there"), flag)).collect()]
    assert state(False) == ["unknown", "unknown", "confirmed_null", "confirmed_value", "legacy_value", "legacy_null"]
    assert state(True) == ["unknown", "unknown", "confirmed_false", "confirmed_true", "legacy_false", "legacy_false"]


def test_probabilities(spark):
    pool = spark.range(40).withColumn("forced", F.col("id") < 10)
    r = Pr.equal_weight(pool, F.col("id") < 4).first()
    assert (r["pool_size"], r["target_count"], r["target_probability"], r["per_record_probability"]) == (40, 4, 0.10, 0.025)
    assert Pr.equal_weight(pool.where("id <> 39"), F.col("id") < 4).first()["target_probability"] == 4 / 39
    assert Pr.equal_weight(pool.where("id <> 0"), F.col("id") < 4).first()["target_probability"] == 3 / 39
    assert [r["mode"] for r in Pr.by_slot(pool, F.col("id") < 4, F.col("forced")).collect()] == ["ordinary", "forced"]
    assert Pr.equal_weight(pool.where("false"), F.lit(True)).first()["target_probability"] == 0


def test_text_forms(spark):
    df = spark.createDataFrame([("  Ｆｕｌｌ-Width, Test!! ",), ("a",), ("",), ("😀a",)], "x string")
    got = [tuple(r) for r in df.select(T.normalize(F.col("x"), compatible=False), F.size(T.bigrams(F.col("x"))), T.utf16_length(F.col("x"))).collect()]
    assert spark.sql("select 'a\u0085b\u3000c\u00a0' as x").select(T.normalize(F.col("x"))).first()[0] == P.normalize_query("a\u0085b\u3000c\u00a0") == "a\u0085b c"
    assert got[0][0] == "full width test" and got[1][1:] == (0, 1) and got[2][1:] == (0, 0) and got[3][2] == 3
    assert spark.sql("select 'ab' as x").select(T.fnv1a(F.col("x"))).first()[0] == "4d2505ca"
    assert spark.sql("select '' as a, '' as b").select(T.edit_similarity(F.col("a"), F.col("b")), T.dice(T.bigrams(F.col("a")), T.bigrams(F.col("b")))).first()[:] == (1.0, 0.0)


def test_stable_characters_are_stable():
    import re
    import unicodedata

    every = [chr(c) for c in range(1 << 16) if not 0xD800 <= c < 0xE000]
    stable = re.findall(f"[{T.STABLE}]", "".join(every))
    assert len(stable) > 30_000
    starters = [c for c in every if unicodedata.normalize("NFKC", c) == c and not unicodedata.combining(c)]
    assert set(stable) <= set(starters)
    # none composes with a character before it
    assert all(unicodedata.normalize("NFKC", a + b) == a + b for a in ("a", "e", "\uac00", "\u3046", "\u0415", "\u1100") for b in stable)


def test_clauses_take_the_longest_phrase():
    lexicon = S.Lexicon((S.Group("g", ("attack", "attack speed"), ("k2", "k1")),), (("c", "Speed"),))
    assert S.clauses("Attack-speed speed x x", lexicon) == [S.Clause("attack speed", ("attack", "attack speed"), ("k1", "k2")), S.Clause("speed", ("speed",), ("c",)), S.Clause("x", ("x",)), S.Clause("x", ("x",))]
    assert S.clauses(" !! ", lexicon) == []


def test_search_ladder(spark):
    df = spark.createDataFrame([(0, "gold", "x", ["c1"]), (1, "golden", "x", []), (2, "old gold", "x", []), (3, "y", "has gold", []), (4, "y", "coin", []), (5, "y", "z", ["C-1"]), (6, "y", "z", [])], "ord int, name string, effect string, concepts array<string>")
    lexicon = S.Lexicon((S.Group("g", ("gold", "coin"), ("c 1",)),))
    hits = S.search(df, "GOLD", S.Surfaces(("name",), ("effect",), concepts="concepts"), lexicon, "ord")
    indexed = {r["ord"]: r["total"] for r in hits.collect()}
    assert indexed == {0: 1000, 1: 700, 2: 500, 3: 300, 4: 140, 5: 100}
    none = S.search(df, "", S.Surfaces(("name",)), lexicon, "ord")
    assert none.count() == 7 and none.first()["total"] == 0


def test_evidence_ranges():
    assert S.occurrences("Ｇold-GOLD", "gold") == [(0, 4), (5, 9)]
    assert S.occurrences("😀 café x", "café") == [(3, 8)]
    assert S.occurrences("a  -  b", "a b") == [(0, 7)]
    assert S.occurrences("", "a") == [] and S.occurrences("aaa", "aa") == [(0, 2)]


def test_cascade_uses_rows_once(spark):
    left = spark.createDataFrame([(1, "x", "n1"), (2, "x2", "n1"), (3, "q", "n2")], "l int, lk string, ln string")
    right = spark.createDataFrame([(10, "x", "n9"), (11, "z", "n1"), (12, "z", "n2"), (13, "w", "n2")], "r int, rk string, rn string")
    got = R.cascade(left, right, [("key", F.col("lk"), F.col("rk"), True), ("name", F.col("ln"), F.col("rn"), False)], "l", "r")
    assert sorted(map(tuple, got.collect())) == [(1, 10, "key"), (2, 11, "name")]


def test_margins(spark):
    c = spark.createDataFrame([(1, 0.9, 1), (1, 0.85, 2), (2, 0.4, 1), (3, 0.9, 1), (3, 0.5, 2)], "l int, score double, rank int")
    got = {r["l"]: (r["status"], r["unresolved"]) for r in R.margins(c, "l").collect()}
    assert got == {1: ("ambiguous", False), 2: ("candidate", True), 3: ("candidate", False)}


def test_duplicates_and_collisions(spark):
    df = spark.createDataFrame([("a", '{"x":1,"y":2}', "1"), ("a", '{"y":2,"x":1}', "1"), ("b", "p", "p"), ("b", "q", "q"), ("c", "r", "r"), ("d", "s", "s"), ("d", "s", "s")], "k string, raw string, canon string")
    got = {r["k"]: (r["status"], r["blocked"]) for r in R.duplicate_audit(df, "k", F.col("raw"), F.col("canon")).collect()}
    assert got == {"a": ("equivalent_duplicate", False), "b": ("conflicting_duplicate", True), "d": ("exact_duplicate", False)}
    left = spark.createDataFrame([(1,), (2,)], "l int")
    none = R.margins(spark.createDataFrame([(1, 0.9, 1)], "l int, score double, rank int"), "l", left=left).orderBy("l").collect()
    assert [(r["best"], r["unresolved"]) for r in none] == [(0.9, False), (None, True)]


def test_snapshot_diff(spark):
    a, b = spark.createDataFrame([("x", 1), ("y", 2), ("n", None)], "id string, cost int"), spark.createDataFrame([("y", 3), ("z", 4), ("n", None)], "id string, cost int")
    assert dict(A.snapshot_diff(a, b, "id", ["cost"]).collect()) == {"x": "removed", "y": "changed", "z": "added"}
    assert A.same_set(a, a, "id").first()["equal"] and not A.same_set(a, a.union(a), "id").first()["equal"]


def test_align(spark):
    old = spark.createDataFrame([(0, None, "A"), (1, "s1", "B"), (2, None, "Dup"), (3, None, "gone"), (4, None, "E")], "p int, s string, n string")
    new = spark.createDataFrame([(0, None, "a"), (5, "s1", "Bee"), (6, None, "Dup"), (7, None, "Dup"), (8, None, "e"), (9, None, "new")], "p int, s string, n string")
    got = {(r["old_position"], r["fresh_position"]): r["status"] for r in A.align(old, new, "p", "s", "n").collect()}
    assert got == {(0, 0): "unchanged", (1, 5): "renamed", (2, None): "ambiguous", (3, None): "old_only", (4, 8): "shifted", (None, 6): "ambiguous_fresh", (None, 7): "ambiguous_fresh", (None, 9): "fresh_only"}


def test_rows_are_numbered_in_order(spark):
    from quillon.operators.saved import numbered

    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("v")).repartition(9)
    got = numbered(df, [F.desc("v")]).orderBy("position").collect()
    assert [(r["position"], r["v"]) for r in got] == [(i + 1, 999 - i) for i in range(1000)]
    assert numbered(df.where("false"), [F.col("v")]).count() == 0


def test_nested_changes(spark):
    old, new = {"a": 1, "b": [1, {"c": None}], "d": True, "g": 1.0}, {"a": 1, "b": [1, {"c": "null"}, 2], "d": 1, "e": [], "g": 1}
    df = spark.createDataFrame([(1, json.dumps(old), json.dumps(new))], "k int, old string, new string")
    assert sorted(tuple(r)[1:] for r in A.json_diff(df, "k", "old", "new").collect()) == [("b[1].c", "null", '"null"'), ("b[2]", None, "2"), ("d", "true", "1"), ("e", None, "[]")]


def test_clusters(spark):
    chain = spark.createDataFrame([(i, [f"k{i}", f"k{i + 1}"]) for i in range(30)] + [(99, ["z", ""]), (100, [])], "i int, keys array<string>")
    got = dict(K.shared_key_clusters(chain, "i", F.col("keys")).collect())
    assert {got[i] for i in range(30)} == {0} and got[99] == 99 and got[100] == 100


def test_forms():
    assert P.form_point("2-7") == (2, 7) and P.form_point("1-3") is None and P.form_point("3-8") is None
    assert P.form_range("4-2", "3-1") is None and P.form_number("-1") is None and P.form_number(" 3.5 ") == 3.5 and P.form_number("inf") is None
    c = P.criteria_from_form({"stage": "3-2", "from": "2-1", "to": "4-1", "gold": "x"})
    assert c.point == (3, 2) and c.range is None and c.gold is None
    assert "gold" in P.form_message({"gold": "x"}) and P.form_message({}) is None
    assert P.state_of(P.Criteria(gold=3, state={"gold": 9})) == {"gold": 9} and P.state_of(P.Criteria()) is None


def test_dataset_round_trip(spark, tmp_path):
    record = {"id": "a", "name": "n", "cost": 3, "ranges": [{"start": {"stage": 2, "round": 1}, "end": {"stage": 3, "round": 1}}], "conditions": [{"type": "gold", "operator": ">=", "value": 5, "evaluable": True}, {"type": "mode", "operator": "in", "value": ["x"], "evaluable": True}], "once": {"status": "unknown"}, "cooldown": None, "sources": {"cost": {"sourceId": "s", "confidence": "official"}}}
    path = tmp_path / "d.json"
    path.write_text(json.dumps({"patch": "1", "records": [record, record | {"id": "b", "once": True}]}))
    records, envelope = catalogue.read_dataset(spark, str(path))
    assert envelope.first()["n"] == 2 and catalogue.by_id(records, "b").count() == 1
    got = records.select(F.transform("conditions", catalogue.typed_condition).alias("c"), catalogue.knowledge(F.col("once"), "boolean").alias("o")).orderBy("o.status").collect()
    assert got[0]["c"][0]["v_num"] == 5.0 and got[0]["c"][1]["v_arr"] == ["x"]
    assert [(r["o"]["status"], r["o"]["value"]) for r in got] == [("confirmed", True), ("unknown", None)]
    sinks.write_json(envelope, str(tmp_path / "out"), ["patch"])
    assert json.loads(spark.read.text(str(tmp_path / "out")).first()[0])["n"] == 2
    sinks.publish(envelope, str(tmp_path / "pub"))
    sinks.write_once(envelope, str(tmp_path / "once"))
    with pytest.raises(Exception, match="already exists"):
        sinks.write_once(envelope, str(tmp_path / "once"))
    assert catalogue.expect_count(records, 2).count() == 2
    with pytest.raises(Exception, match="expected 3"):
        catalogue.expect_count(records, 3).collect()


def test_saved_pages(spark):
    card = '<li><div class="name-cell"><strong>A &amp; B</strong> new</div><div class="cost-cell"><strong>3</strong></div><div class="description-cell"><p class="description">x<span>deep</span></p><p class="hint">Requirements : h1</p><p class="hint">h2</p></div></li>'
    page = '<link rel="canonical" href="u"><ul>' + card + '<li class="card"><b class="name-cell"></b></li><li><b class="name-cell">C</b><b class="description-cell">no effect</b></li></ul><script>self.__f.push([1,"5:{\\"name\\":\\"N\\",\\"cost\\":4,\\"in\\":{\\"title\\":\\"T\\",\\"desc\\":\\"d\\"}} tail"])</script>'
    df = spark.createDataFrame([(1, page), (2, None)], "k long, html string")
    cards = pages.card_rows(df, "k", "html").collect()
    assert [(r["name"], r["cost"], r["effect"], r["requirements"], r["hints"], r["blossom"]) for r in cards] == [("A & B", 3.0, "x deep", ["h1"], ["Requirements: h1", "h2"], None)]
    assert pages.elements('<div class="a b">1<div class="a">2</div></div><div class="ab">3</div><p class="a">4', "a") == ['1<div class="a">2</div>']
    found = df.where("k = 1").select(F.array_compact(F.transform(pages.embedded_objects("html"), pages.record_of)).alias("r")).first()["r"]
    assert [(r["name"], r["effect"], r["cost"]) for r in found] == [("N", None, 4.0), ("T", "d", None)]
    one = df.where("k = 1").select(pages.embedded_records(F.col("html")).alias("r")).first()["r"]
    assert one["objects"] == 2 and [(r["name"], r["effect"], r["cost"]) for r in one["records"]] == [("N", None, 4.0), ("T", "d", None)]
    odd = df.select(pages.embedded_records(F.lit('<script type="application/json">[{"name": "", "title": 5, "price": "x"}, {"name": "a", "cost": "1.5"}, {"desc": "d"}, 3]</script><script type="application/json">{bad</script>')).alias("r")).first()["r"]
    assert odd["objects"] == 3 and [(r["name"], r["cost"]) for r in odd["records"]] == [("a", 1.5)]
    assert df.where("k = 2").select(pages.embedded_records(F.col("html")).alias("r")).first()["r"]["records"] == []
    assert df.select(pages.canonical_url(F.col("html"))).first()[0] == "u"


def test_validation(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, None)], "id int, kind string")
    got = sorted(map(tuple, W.all_of(W.errors(df, "id", [W.required("kind"), W.allowed("kind", ("a",))]), W.repeated(df, "id")).collect()))
    assert got == [(1, "id", "repeated"), (1, "kind", "not an allowed value"), (2, "kind", "missing"), (2, "kind", "not an allowed value")]


def test_rules_and_order(spark, records):
    assert U.rules_for(spark.createDataFrame([("1",), ("2",)], "patch string"), "2").count() == 1
    assert [r["id"] for r in records.orderBy(*U.index_order("ranges", "category", "id")).collect()] == ["a", "c", "b", "d"]


def test_stream_pool(spark, tmp_path, records):
    path = str(tmp_path / "in")
    records.write.parquet(path)
    stream = spark.readStream.schema(records.schema).parquet(path)
    q = stream_pool(stream, P.Criteria(categories=("combat",), point=(4, 2)), COLUMNS).writeStream.format("memory").queryName("kept").start()
    q.processAllAvailable()
    q.stop()
    assert ids(spark.table("kept")) == ["c"]
    with pytest.raises(ValueError, match="stream"):
        stream_pool(records, P.Criteria())


def test_element_tree():
    page = '<div class="a b">x<br><div class="a">y</div><p>open<img/></div><p class="c">z</P><i>'
    nodes = [(n[0], n[1], n[2], page[n[3] : n[6]]) for n in elements.tree(page)]
    assert nodes == [("div", ["a", "b"], 0, page[: page.index("<p class")]), ("div", ["a"], 1, '<div class="a">y</div>'), ("p", ["c"], 0, '<p class="c">z</P>')]
    assert elements.tree("") == [] and elements.tree("<<p></q>") == []


def test_cards_take_linear_time():
    def took(n):
        page = "<ul>" + '<li><div class="name-cell"><b>n</b></div></li>' * n + "<p>" * n + "</ul>"
        began = time.perf_counter()
        assert len(elements.outermost([x for x in elements.tree(page) if x[0] == "li"])) == n
        return time.perf_counter() - began

    took(500)
    assert took(16000) < 16 * max(took(4000), 0.01)


def test_requirement_paths(spark):
    text = '[{"type": "a", "textZh": "b", "machineEvaluable": true, "operator": "<", "value": 1e400}, {"type": "a", "textZh": "b", "machineEvaluable": false, "operator": "in", "value": 3}, [], {}]'
    df = spark.createDataFrame([(text,), ("[]",), (None,), ("not json",), ('"x"',)], "v string").select("v", W.requirement_problems(F.col("v"), "r").alias("p"))
    got = {r["v"]: [tuple(x) for x in r["p"]] for r in df.collect()}
    alone = [("r", "must be a list")]
    assert got["[]"] == [] and got[None] == alone and got["not json"] == alone and got['"x"'] == alone
    found = got[text]
    assert found == alone or [p for p in found if p[0].startswith("r[2") or p[0].startswith("r[3")] == [("r[2]", "must be an object"), ("r[3].type", "must be a text"), ("r[3].textZh", "must be a text"), ("r[3].machineEvaluable", "must be true or false")]


def test_forms_take_plain_digits():
    numbers = {"1_0": None, "１２": None, "0x1F": 31.0, "1e2": 100.0, ".5": 0.5, "5.": 5.0, "+3": 3.0, "1d": None, "": None, None: None, "Infinity": None, "nan": None}
    assert {k: P.form_number(k) for k in numbers} == numbers
    assert P.form_point("２-１") is None and P.form_point(" 2-1 ") == (2, 1) and P.form_point("1-0", playable=False) is None and P.form_point("1-1", playable=False) == (1, 1) and P.form_point("2-8") is None


def test_ranges_of_plain_texts_are_those_of_mapped_ones(spark):
    """What the JVM finds by pattern is what the offset map finds, whatever signs, cases and scripts are about."""
    import random

    rng = random.Random(12)
    texts = ["".join(rng.choice(["a", "B", "ab", " ", "  ", "-", "!?", "é", "İ", "ß", "法强", "ﬁ", "ｈ", "\t", "1", "🎉", "﻿", "_", "я"]) for _ in range(rng.randrange(14))) for _ in range(400)] + [None, ""]
    terms = ["a", "ab", "a b", "b", "é", "法", "1 a", "ss", "ß", "fi", "h", "A", "a-b", " a", "", None, "i", "я", "b 法强"]
    df = spark.createDataFrame([(x, t) for x in texts for t in terms], "x string, t string").select("x", "t", S.match_ranges("x", "t").alias("r"), S.first_surface(F.col("x"), F.col("t")).alias("s"))
    for r in df.collect():
        want = S.occurrences(r["x"] or "", r["t"] or "")
        assert [tuple(p) for p in r["r"]] == want, (r["x"], r["t"])
        assert r["s"] == (r["x"].encode("utf-16-le")[2 * want[0][0] : 2 * want[0][1]].decode("utf-16-le") if want else None)


def test_small_files_are_spread(spark, data, tmp_path):
    """What is much work a row isn't left to the one task that scans a small file; no expression repeats its arguments."""
    from quillon.plans import QUERIES

    tasks = spark.sparkContext.defaultParallelism
    for name in ("q_search_reason", "q_rendered_cards", "q_requirement_problems"):
        assert QUERIES[name](spark, data).rdd.getNumPartitions() >= tasks
    for c in (S.first_surface(F.concat("x", "x"), F.col("x")), W.requirement_problems(F.concat("x", "x"), "r"), T.decode_references(F.concat("x", "x"))):
        assert str(c).count("concat(x, x)") <= 2


def test_first_surface_and_nested_classes(spark):
    got = spark.createDataFrame([("a Big--Ring ring", "big ring"), ("x", ""), (None, "x"), ("ＲＩＮＧ", "ring"), ("x", None)], "x string, t string").select(S.first_surface(F.col("x"), F.col("t")).alias("s")).collect()
    assert [r["s"] for r in got] == ["Big--Ring", None, None, "ＲＩＮＧ", None]
    page = '<li class="a b">x<p>é</p></li><li/><li></li>'
    got = spark.createDataFrame([(page,), (None,), ("",)], "p string").select(elements.subtrees("li")(F.col("p")).alias("s")).collect()
    assert [[(c["html"], [(n["tag"], n["classes"], n["depth"], n["open"], n["close"]) for n in c["nodes"]]) for c in r["s"]] for r in got] == [[('<li class="a b">x<p>é</p></li>', [("li", ["a", "b"], 0, 0, 30), ("p", [], 1, 17, 25)]), ("<li></li>", [("li", [], 0, 0, 9)])], [], []]
