"""The most similar pairs of two tables, without comparing all of them.

A score is a weighted sum of similarities (Dice of sets, or edit similarity of texts; of alternatives the best) and of
bonuses for equal values. To reach a score, one of the similarities must reach a bound, so the two sides have a certain
number of grams in common, so one of them is among the rarest of the left side: only those are looked up in the
postings of the right side. The bound follows from the n-th best score that a left row is known to have: first from
rows that share its values, then from those that share a rare gram. Pairs without any common gram score by their bonuses alone;
the first n of each class of equal values are enough of them.

Every join is on equal keys: a gram, and the values that a bonus asks for. Postings of common grams are touched only for rows
that have no good partner. What is found is exact; pairs are scored once, from whole rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.text import dice, edit_similarity
from quillon.operators.saved import saved

#: Grams of a row that are looked up to find a first bound, if so many right rows have them at most. Neither changes a result.
SEEDS, SEED_ROWS = 3, 64
#: Scores are ranked in so many decimals; bounds give way by as much.
DIGITS, SLACK = 12, 1e-9


@dataclass(frozen=True)
class Dice:
    """Dice similarity of two columns of sets (arrays without repeats); two empty sets and nulls are not similar."""

    left: str
    right: str

    def value(self) -> Column:
        return F.coalesce(dice(F.col(self.left), F.col(self.right)), F.lit(0.0))

    def grams(self, rows: DataFrame, key: str, column: str) -> Iterator[tuple[str, DataFrame]]:
        yield "set", rows.select(F.col(key).alias("id"), F.size(column).alias("size"), F.explode(F.transform(column, lambda g: g.cast("string"))).alias("gram"))


@dataclass(frozen=True)
class Edit:
    """1 - edit distance / longer length of two columns of texts; two empty texts are equal, nulls are not similar."""

    left: str
    right: str

    def value(self) -> Column:
        return F.coalesce(edit_similarity(F.col(self.left), F.col(self.right)), F.lit(0.0))

    def grams(self, rows: DataFrame, key: str, column: str) -> Iterator[tuple[str, DataFrame]]:
        """Pairs of neighbours with both ends marked, for bounds over a half; single characters for lower ones. Repeats are numbered."""
        text = F.col(column)
        marked = F.concat(F.lit("\x02"), text, F.lit("\x03"))
        pairs = F.transform(F.sequence(F.lit(1), F.length(text) + 1), lambda i: F.substr(marked, i, F.lit(2)))
        single = F.when(text == "", F.array(F.lit(""))).otherwise(F.filter(F.split(text, ""), lambda c: c != ""))
        for kind, parts in (("pairs", pairs), ("single", single)):
            each = rows.where(text.isNotNull()).select(F.col(key).alias("id"), parts.alias("parts")).select("id", F.size("parts").alias("size"), F.explode("parts").alias("part"))
            nth = F.row_number().over(Window.partitionBy("id", "part").orderBy("size"))
            yield kind, each.select("id", "size", F.concat("part", F.lit("\x01"), nth.cast("string")).alias("gram"))


@dataclass(frozen=True)
class Score:
    """groups: (weight, alternatives of which the best counts); equal: (bonus, left column, right column), nothing for nulls."""

    groups: Sequence[tuple[float, Sequence[Dice | Edit]]]
    equal: Sequence[tuple[float, str, str]] = ()

    def value(self) -> Column:
        terms = []
        for weight, of in self.groups:
            best = F.greatest(*[s.value() for s in of]) if len(of) > 1 else of[0].value()
            terms.append(best if weight == 1 else weight * best)
        terms += [bonus * F.coalesce(F.col(a) == F.col(b), F.lit(False)).cast("double") for bonus, a, b in self.equal]
        return reduce(lambda x, y: x + y, terms)

    def weight(self) -> float:
        return sum(w for w, _ in self.groups)

    def classes(self, side: int) -> Column:
        """(class, bonus, key) for each set of equal values that a row can take part in; side 0 is left, 1 right."""
        out = []
        numbers = range(len(self.equal))
        for n in range(len(self.equal) + 1):
            for some in combinations(numbers, n):
                values = [F.col(self.equal[i][1 + side]).cast("string") for i in some]
                whole = reduce(lambda x, y: x & y, [v.isNotNull() for v in values], F.lit(True))
                key = F.to_json(F.array(*values)) if values else F.lit("")
                out.append(F.when(whole, F.struct(F.lit(",".join(map(str, some))).alias("class"), F.lit(float(sum(self.equal[i][0] for i in some))).alias("bonus"), key.alias("key"))))
        return F.array_compact(F.array(*out))


def _grams(rows: DataFrame, key: str, score: Score, side: int) -> DataFrame:
    """(id, size, gram): the grams of all similarities; a gram's name says of which."""
    parts = []
    for g, (_, of) in enumerate(score.groups):
        for a, s in enumerate(of):
            for kind, df in s.grams(rows, key, s.right if side else s.left):
                parts.append(df.select("id", "size", F.lit(kind).alias("kind"), F.concat(F.lit(f"{g}.{a}.{kind}:"), "gram").alias("gram"), F.lit(f"{g}.{a}.{kind}").alias("of")))
    return reduce(DataFrame.unionByName, parts)


def _needed(bound: Column, size: Column, other: Column | None = None) -> Column:
    """How many grams two rows must have in common at least; without the other's size, whatever it is."""
    low = F.greatest(size, other) if other is not None else size
    both = bound * (size + other) / 2 if other is not None else bound * size / (2 - bound)
    exact = F.when(F.col("kind") == "set", both).when(F.col("kind") == "pairs", (2 * bound - 1) * (low - 1) + 1).otherwise(bound * low)
    return F.greatest(F.lit(1.0), exact - SLACK)


class _Index:
    """Postings of the right side, and the grams of the left side from rare to common."""

    def __init__(self, left: DataFrame, right: DataFrame, left_id: str, right_id: str, score: Score):
        self.score = score
        postings = saved(_grams(right, right_id, score, 1), "postings")
        rows = postings.groupBy("gram").agg(F.count("*").alias("rows"))
        probes = _grams(left, left_id, score, 0).join(rows, "gram", "left").withColumn("rows", F.coalesce("rows", F.lit(0)))
        rarest = Window.partitionBy("id", "of").orderBy("rows", "gram")
        self.probes = saved(probes.withColumn("place", F.row_number().over(rarest)), "probes")
        self.postings = postings.select("gram", F.col("id").alias("r"), F.col("size").alias("r_size"))
        self.left_classes = left.select(F.col(left_id).alias("id"), F.inline(score.classes(0)))
        self.right_classes = right.select(F.col(right_id).alias("r"), F.inline(score.classes(1)))

    def seeds(self) -> DataFrame:
        """(id, r) of rows that share a rare gram."""
        return self.probes.where((F.col("place") <= SEEDS) & (F.col("rows") <= SEED_ROWS)).join(self.postings, "gram").select("id", "r")

    def reaching(self, bounds: DataFrame) -> DataFrame:
        """(id, r) of all pairs with a similarity over nothing that may reach the bound of (id, bound), and perhaps others."""
        asked = self.left_classes.join(bounds, "id").withColumn("bound", (F.col("bound") - F.col("bonus")) / self.score.weight()).where(F.col("bound") <= 1 + SLACK).drop("bonus")
        bound = F.greatest(F.lit(0.0), "bound")
        fits = F.when(F.col("kind") == "pairs", bound > 0.5).when(F.col("kind") == "single", bound <= 0.5).otherwise(True)
        ways = self.probes.where("rows > 0").join(asked, "id").where(fits & (F.col("place") <= F.col("size") - F.ceil(_needed(bound, F.col("size"))) + 1))
        entries = self.postings.join(self.right_classes.drop("bonus"), "r")
        common = F.least(F.col("size") - F.col("place") + 1, "r_size")
        return ways.join(entries, ["gram", "class", "key"]).where(common >= _needed(bound, F.col("size"), F.col("r_size"))).select("id", "r")


def _firsts(left: DataFrame, right: DataFrame, left_id: str, right_id: str, score: Score, n: int) -> DataFrame:
    """(id, r): the first n right rows by id of each class that a left row is in."""
    classes = right.select(F.col(right_id).alias("r"), F.inline(score.classes(1)))
    first = classes.where("class <> ''").withColumn("_n", F.row_number().over(Window.partitionBy("class", "key").orderBy("r"))).where(F.col("_n") <= n).select("class", "key", "r")
    shared = left.select(F.col(left_id).alias("id"), F.inline(score.classes(0))).join(first, ["class", "key"]).select("id", "r")
    some = [r["r"] for r in right.select(F.col(right_id).alias("r")).orderBy("r").limit(n).collect()]  # n values
    kind = right.schema[right_id].dataType
    anyone = left.select(F.col(left_id).alias("id"), F.explode(F.array(*[F.lit(x) for x in some]).cast(f"array<{kind.simpleString()}>")).alias("r"))
    return shared.unionByName(anyone)


def scored(pairs: DataFrame, left: DataFrame, right: DataFrame, left_id: str, right_id: str, score: Score) -> DataFrame:
    """Both rows of each pair (id, r) once, with the score."""
    named = pairs.distinct().select(F.col("id").alias(left_id), F.col("r").alias(right_id))
    return named.join(left, left_id).join(right, right_id).withColumn("score", score.value())


def _ranked(pairs: DataFrame, left_id: str, right_id: str, n: int) -> DataFrame:
    w = Window.partitionBy(left_id).orderBy(F.round("score", DIGITS).desc(), right_id)
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def most_similar(left: DataFrame, right: DataFrame, left_id: str, right_id: str, score: Score, n: int) -> DataFrame:
    """Both rows, score and rank of the n right rows of best score for each left row; ties (to 12 decimals) to the smaller right_id.

    left and right have no column in common, and their ids no repeats; rows without id are left out. If right has fewer than n rows, all of them are
    returned. Empty tables give an empty table.
    """
    left, right = left.where(F.col(left_id).isNotNull()), right.where(F.col(right_id).isNotNull())
    index = _Index(left, right, left_id, right_id, score)
    first = saved(scored(_firsts(left, right, left_id, right_id, score, n).unionByName(index.seeds()), left, right, left_id, right_id, score).select(left_id, right_id, "score"), "first")
    last = _ranked(first, left_id, right_id, n).where(F.col("rank") == n)
    # with fewer than n known, right has no more rows
    bounds = last.select(F.col(left_id).alias("id"), (F.col("score") - SLACK).alias("bound"))
    new = index.reaching(bounds).distinct().join(first.select(F.col(left_id).alias("id"), F.col(right_id).alias("r")), ["id", "r"], "left_anti")
    more = scored(new, left, right, left_id, right_id, score).select(left_id, right_id, "score")
    best = _ranked(first.unionByName(more), left_id, right_id, n)
    return best.join(left, left_id).join(right, right_id).select(*left.columns, *right.columns, "score", "rank")


def at_least(left: DataFrame, right: DataFrame, left_id: str, right_id: str, score: Score, bound: float) -> DataFrame:
    """(left_id, right_id, score) of all pairs that score at least bound and have any similarity; bonuses must not reach it alone."""
    if bound <= sum(b for b, _, _ in score.equal):
        raise ValueError("bonuses alone reach the bound: such pairs have no gram to be found by")
    left, right = left.where(F.col(left_id).isNotNull()), right.where(F.col(right_id).isNotNull())
    bounds = left.select(F.col(left_id).alias("id"), F.lit(bound - SLACK).alias("bound"))
    found = _Index(left, right, left_id, right_id, score).reaching(bounds)
    return scored(found, left, right, left_id, right_id, score).where(F.round("score", DIGITS) >= bound).select(left_id, right_id, "score")
