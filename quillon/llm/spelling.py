"""Spelling variants of a vocabulary, found in a forward and a reversed sorted dictionary.

Words are near if one inserted, deleted or replaced code point makes one of the other. One edit leaves a half
of a word intact:

1. A pair belongs to the length of its shorter word. Of that length each word is entered twice: in the forward
   dictionary under its first half, in the reversed one under its last half read backwards. Words that share an
   entry are a block. An edit behind the first half shows in the forward dictionary, one within it in the other.
2. Blocks that would take more than PAIRS comparisons are divided: what lies between the shared front and the
   shared end holds the edit, so one of its halves is intact in turn. That goes on, block by block, until
   blocks are small or one code point is left between, where the alphabet bounds them. Nothing is left out.
3. Each dictionary is dealt by block and sorted; runs of one block are scanned, and what lies between front and
   end is compared. Both dictionaries may show a pair if a code point is repeated where the edit is;
   the reversed one then leaves it to the forward one.

No task holds more than a small block, no row a list of words; words of all pairs are never written, only near ones.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import needs, table, written

#: Comparisons in a block from which it is divided.
PAIRS = 2048
RUNS = "[A-Za-zÀ-ÿ]+"
BLOCK = ["cls", "a", "b", "head", "tail"]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def runs(docs: DataFrame, key: str = "doc_id", text: str = "text", pattern: str = RUNS) -> DataFrame:
    """(key, word): each occurrence of a run of letters, with only A-Z in lower case. Null and empty texts have none."""
    found = docs.select(F.col(f"`{key}`").alias("key"), F.explode(F.regexp_extract_all(F.col(f"`{text}`").cast("string"), F.lit(pattern), F.lit(0))).alias("word"))
    ascii_only = F.char_length("word") == F.octet_length("word")
    return found.withColumn("word", F.when(ascii_only, F.lower("word")).otherwise(F.translate("word", _UPPER, _LOWER)))


def _divided(entries: DataFrame) -> DataFrame:
    """Each entry under the first half and under the last half of what lies between its front and its end."""
    between = F.col("cls") - F.col("a") - F.col("b")
    half = F.floor(between / 2).cast("int")
    front = F.struct((F.col("a") + half).alias("a"), F.col("b").alias("b"), F.col("reach").alias("reach"))
    back = F.struct(F.col("a").alias("a"), (F.col("b") + between - half).alias("b"), (F.col("a") + half).alias("reach"))
    out = entries.withColumn("_e", F.explode(F.when(half > 0, F.array(front, back)).otherwise(F.array(F.struct("a", "b", "reach")))))
    out = out.select("word", "n", "size", "cls", "_e.*")
    return out.withColumn("head", F.expr("left(word, a)")).withColumn("tail", F.expr("reverse(right(word, b))"))


def blocks(words: DataFrame, pairs: int = PAIRS) -> DataFrame:
    """The dictionary entries of (word, n): (cls, a, b, head, tail) name the block, reach bounds what the front of a pair may share."""
    sized = words.withColumn("size", F.char_length("word"))
    todo = sized.withColumn("cls", F.explode(F.array("size", F.col("size") - 1))).where("cls >= 0").withColumns({"a": F.lit(0), "b": F.lit(0), "reach": F.lit(0)})
    todo, done = _divided(todo), []
    while True:
        # a block needs a word of its own length; longer ones only meet those
        counts = todo.groupBy(*BLOCK).agg(F.count_if(F.col("size") == F.col("cls")).alias("own"), F.count("*").alias("all")).where("own > 0 and all > 1")
        cost = F.col("own") * (2 * F.col("all") - F.col("own") - 1) / 2
        counted = counts.withColumn("large", (cost > pairs) & (F.col("cls") - F.col("a") - F.col("b") > 1)).drop("own", "all")
        entered = written(todo.join(counted, BLOCK), "entries")
        done.append(entered.where("not large").drop("large"))
        large = entered.where("large")
        if large.isEmpty():
            return reduce(DataFrame.unionByName, done)
        todo = _divided(large)


def near_words(words: DataFrame, pairs: int = PAIRS) -> DataFrame:
    """(x, nx, y, ny): each pair of near words of (word, n) once, the shorter or smaller one as x."""
    entries = blocks(words, pairs).withColumn("mid", F.expr("substring(word, a + 1, size - a - b)"))
    x = entries.where("size = cls").select(*BLOCK, F.col("word").alias("x"), F.col("n").alias("nx"), F.col("mid").alias("mx"), "reach")
    y = entries.select(*BLOCK, F.col("word").alias("y"), F.col("n").alias("ny"), F.col("mid").alias("my"), (F.col("size") > F.col("cls")).alias("longer"))
    same = reduce(lambda p, q: p & q, [x[c] == y[c] for c in BLOCK])
    on = same & (F.col("longer") | (F.col("x") < F.col("y"))) & (F.levenshtein("mx", "my", 1) == 1)
    on = on & ((F.col("reach") == 0) | F.expr("left(x, reach) <> left(y, reach)"))
    return x.hint("merge").join(y, on).select("x", "nx", "y", "ny")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): where following forms ends. A word has one form, and forms make no ring; the way halves in each round."""
    up = written(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        higher = up.select(F.col("word").alias("root"), F.col("root").alias("top"))
        up = written(up.join(higher, "root", "left").select("word", F.coalesce("top", "root").alias("root"), F.col("top").isNotNull().alias("moved")), "forms")
        if up.where("moved").isEmpty():
            return up.select("word", "root")
        up = up.drop("moved")


def variants(words: DataFrame, word: str = "word", n: str = "n", ratio: int = 2, pairs: int = PAIRS) -> DataFrame:
    """One row per word: word, form, root (strings), n, n_near, form_n (longs).

    A word's form is its near word of largest n (ties: smallest in code-point order) if that n is at least ratio
    (over 1) times its own, else null; its root is where following forms ends, itself without a form.
    Words that are null, and counts that are null, are left out; the empty word is near
    to those of one code point; counts of a word that comes several times are added. An empty table gives an empty table; other columns don't matter.
    """
    words = needs(words, word, n).select(F.col(f"`{word}`").cast("string").alias("word"), F.col(f"`{n}`").cast("long").alias("n"))
    words = written(words.where("word is not null and n is not null").groupBy("word").agg(F.sum("n").alias("n")), "words")
    both = near_words(words, pairs).select(F.explode(F.array(F.struct(F.col("x").alias("word"), F.col("y").alias("other"), F.col("ny").alias("m")), F.struct(F.col("y").alias("word"), F.col("x").alias("other"), F.col("nx").alias("m")))).alias("p")).select("p.*")
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best"))
    taken = -F.col("best.m") >= ratio * F.col("n")
    found = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(taken, F.col("best.other")).alias("form"), F.when(taken, -F.col("best.m")).alias("form_n"))
    found = written(found, "near")
    top = roots(found.where("form is not null").select("word", "form"))
    out = found.join(top, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def typed_words(docs: DataFrame, key: str = "doc_id", text: str = "text", every: int = 97) -> DataFrame:
    """(word): the runs of docs, one in about `every` of which has lost a code point, as a checksum of its document's id and itself says.

    A row without id counts as one whose id is the empty text; rows of one id lose alike.
    """
    word = runs(needs(docs, key, text), key, text).withColumn("h", F.crc32(F.concat(F.coalesce(F.col("key").cast("string"), F.lit("")), F.lit(":"), F.col("word")).cast("binary")))
    word = word.withColumn("at", (F.col("h") % F.char_length("word")).cast("int"))
    return word.select(F.when(F.col("h") % every == 0, F.expr("concat(left(word, at), substring(word, at + 2))")).otherwise(F.col("word")).alias("word"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = typed_words(table(spark, sf_dir, "documents")).groupBy("word").agg(F.count("*").alias("n"))
    return variants(counts.where("char_length(word) >= 5 and n >= 3"))


QUERIES = {"op11_spelling_variants": op11_spelling_variants}

#: All words with one place masked, or one code point deleted; the checksum by its polynomial, as SQL has none.
ORACLE = {
    "op11_spelling_variants": r"""
WITH RECURSIVE bits AS (SELECT range AS b, range AS v, 0 AS k FROM range(256) UNION ALL SELECT b, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(v ORDER BY b) AS t FROM bits WHERE k = 8),
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS w FROM documents),
grouped AS (SELECT doc_id, w, count(*) AS c FROM runs GROUP BY ALL),
bytes AS (SELECT doc_id, w, c, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || w, ''), lambda s: CASE WHEN unicode(s) < 128 THEN [unicode(s)::BIGINT] ELSE [(192 + unicode(s) // 64)::BIGINT, (128 + unicode(s) % 64)::BIGINT] END)) AS bs FROM grouped),
hashed AS (SELECT w, c, xor(list_reduce(list_prepend(4294967295::BIGINT, bs), lambda h, x: xor(t[xor(h, x) % 256 + 1], h // 256)), 4294967295) AS h FROM bytes, crc),
words AS (SELECT w, sum(c)::BIGINT AS n FROM (SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS w, c FROM hashed) GROUP BY w HAVING length(w) >= 5 AND sum(c) >= 3),
places AS (SELECT w, n, unnest(range(1, length(w) + 1)) AS i FROM words),
masked AS (SELECT w, n, i, substr(w, 1, i - 1) || '*' || substr(w, i + 1) AS m FROM places),
less AS (SELECT DISTINCT w, n, substr(w, 1, i - 1) || substr(w, i + 1) AS d FROM places),
shorter AS (SELECT less.w AS long, less.n AS long_n, words.w AS short, words.n AS short_n FROM less JOIN words ON words.w = less.d),
near AS (
  SELECT x.w, x.n, y.w AS o, y.n AS m FROM masked x JOIN masked y ON x.m = y.m AND x.w <> y.w
  UNION ALL SELECT long, long_n, short, short_n FROM shorter UNION ALL SELECT short, short_n, long, long_n FROM shorter),
best AS (SELECT w, n, count(*) AS n_near, max(m) AS m FROM near GROUP BY w, n),
form AS (SELECT b.w, b.n_near, CASE WHEN b.m >= 2 * b.n THEN (SELECT min(o) FROM near WHERE near.w = b.w AND near.m = b.m) END AS form, CASE WHEN b.m >= 2 * b.n THEN b.m END AS form_n FROM best b),
up AS (SELECT w, form AS root FROM form WHERE form IS NOT NULL UNION ALL SELECT up.w, form.form FROM up JOIN form ON form.w = up.root WHERE form.form IS NOT NULL),
top AS (SELECT w, root FROM up WHERE NOT EXISTS (SELECT 1 FROM form WHERE form.w = up.root AND form.form IS NOT NULL))
SELECT words.w AS word, form.form, coalesce(top.root, words.w) AS root, words.n, coalesce(n_near, 0) AS n_near, form_n
FROM words LEFT JOIN form ON form.w = words.w LEFT JOIN top ON top.w = words.w
"""
}
