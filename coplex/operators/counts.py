"""Base rates and pair tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Least count of the first item of a pair lift.
LEAST_PAIR = 100


def base_rates(inc: DataFrame, rating: str = "all", n: Column | None = None) -> DataFrame:
    """(tag, n) over all baskets of the rating, whatever the base population. n: what adds them up, if rows are counts already."""
    rated = {"all": F.lit(True), "gs": F.col("rating").isin("g", "s"), "e": F.col("rating") == "e"}[rating]
    return inc.filter(rated).groupBy("tag").agg((F.count(F.lit(1)) if n is None else n).alias("n"))


def population_size(posts: DataFrame, rating: str = "all") -> DataFrame:
    rated = {"all": F.lit(True), "gs": F.col("rating").isin("g", "s"), "e": F.col("rating") == "e"}[rating]
    return posts.agg(F.count_if(rated).alias("n"))


def within(words: DataFrame, population: DataFrame, pool: list[int]) -> DataFrame:
    """(tid, word, bits) of the pool's items, cut to the population's bitmap (word, bits)."""
    p = population.withColumnRenamed("bits", "p")
    return words.filter(F.col("tid").isin(pool)).join(p, "word").select("tid", "word", F.col("bits").bitwiseAND(F.col("p")).alias("bits")).filter("bits <> 0")


def pair_table(inside: DataFrame) -> DataFrame:
    """(a, b, n_ab) with a < b of a pool's bitmaps: a product of bit matrices, word by word. A word of 64 baskets gives at most pool ** 2 / 2
    rows, where each of its baskets would, and none is counted by itself."""
    a, b = inside.withColumnsRenamed({"tid": "a", "bits": "x"}), inside.withColumnsRenamed({"tid": "b", "bits": "y"})
    both = a.join(b, "word").filter("a < b").select("a", "b", F.bit_count(F.col("x").bitwiseAND(F.col("y"))).alias("n")).filter("n > 0")
    return both.groupBy("a", "b").agg(F.sum("n").alias("n_ab"))


def single_counts(inside: DataFrame) -> DataFrame:
    return inside.groupBy("tid").agg(F.sum(F.bit_count("bits")).cast("long").alias("n"))


def lift(n_ab: Column, n_a: Column, n_b: Column, total: Column) -> Column:
    """(n_ab / n_a) / (n_b / total); null where n_a is small or n_b is nothing; a missing pair counts 0."""
    return F.when((n_a >= LEAST_PAIR) & (n_b > 0), (F.coalesce(n_ab, F.lit(0)) / n_a) / (n_b / total))


def pair_lifts(asked: DataFrame, pairs: DataFrame, singles: DataFrame, total: int) -> DataFrame:
    """asked (x, y) with lift, found by the unordered pair."""
    keyed = asked.withColumns({"a": F.least("x", "y"), "b": F.greatest("x", "y")})
    n_x, n_y = singles.select(F.col("tid").alias("x"), F.col("n").alias("n_x")), singles.select(F.col("tid").alias("y"), F.col("n").alias("n_y"))
    joined = keyed.join(pairs, ["a", "b"], "left").join(n_x, "x", "left").join(n_y, "y", "left")
    return joined.select("x", "y", lift(F.col("n_ab"), F.coalesce("n_x", F.lit(0)), F.coalesce("n_y", F.lit(0)), F.lit(total)).alias("lift"))
