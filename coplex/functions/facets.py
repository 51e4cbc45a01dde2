"""Facets of items. Rules are data: rows (facet, ord, kind, pattern) say which items a facet has.

Kinds: exact (the item), word (a whole word of the item between underscores), last (its last word), suffix, prefix
and regex. Memberships are computed once, into a dimension table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Most rules by pattern, which every item meets.
MOST_RULES = 10_000


def normalise(text: Column) -> Column:
    """Trimmed, lower-cased, spaces as underscores."""
    return F.translate(F.lower(F.trim(text)), " ", "_")


def split_list(text: Column) -> Column:
    """A comma-separated list of normalised names, without empty ones."""
    return F.filter(F.transform(F.split(text, ","), normalise), lambda x: x != "")


def prompt(tags: Column) -> Column:
    """Names for a prompt: underscores as spaces, joined by a comma; names of symbols alone stay as they are."""
    return F.concat_ws(", ", F.transform(tags, lambda t: F.when(t.rlike("[A-Za-z0-9]"), F.translate(t, "_", " ")).otherwise(t)))


def _affixes(names: DataFrame, rules: DataFrame, kind: str) -> DataFrame:
    """Matches of the rules of a kind, prefix or suffix: items meet a rule by the affix of its length, so by equality. There are as
    many lengths as rules have, and none is longer than a name."""
    of = rules.filter(F.col("kind") == kind)
    lengths = [r["n"] for r in of.select(F.length("pattern").alias("n")).distinct().collect()]
    cut = (lambda n: F.left("tag", F.lit(n))) if kind == "prefix" else (lambda n: F.right("tag", F.lit(n)))
    affixes = F.array(*(F.when(F.length("tag") >= n, cut(n)) for n in lengths)) if lengths else F.array().cast("array<string>")
    return names.select("tag", F.explode(affixes).alias("part")).join(of, F.col("part") == F.col("pattern")).select("tag", "facet", "ord")


def memberships(tags: DataFrame, rules: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """(tag, facet, ord): every facet that an item is in; `excluded` has (facet, tag) exceptions.

    All kinds are joins by equality but patterns, a configuration of bounded size, which are matched where the items are."""
    names, p = tags.select("tag"), F.col("pattern")
    of = lambda kind: rules.filter(F.col("kind") == kind)
    words = F.split(F.col("tag"), "_")
    exact = names.join(of("exact"), F.col("tag") == p)
    word = names.select("tag", F.explode(F.array_distinct(words)).alias("part")).join(of("word"), F.col("part") == p)
    last = names.withColumn("part", F.element_at(words, -1)).join(of("last"), F.col("part") == p)
    patterns = of("regex").select("facet", "ord", "pattern").take(MOST_RULES + 1)
    if len(patterns) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules by pattern")
    hits = [F.when(F.col("tag").rlike(r["pattern"]), F.struct(F.lit(r["facet"]).alias("facet"), F.lit(r["ord"]).alias("ord"))) for r in patterns]
    found = names.select("tag", F.explode(F.array_compact(F.array(*hits))).alias("x")).select("tag", "x.facet", "x.ord") if hits else None
    for part in (exact, word, last, _affixes(names, rules, "prefix"), _affixes(names, rules, "suffix")):
        part = part.select("tag", "facet", "ord")
        found = part if found is None else found.union(part)
    found = found.distinct()
    return found.join(excluded, ["facet", "tag"], "left_anti").select("tag", "facet", "ord") if excluded is not None else found


def exclusive(members: DataFrame) -> DataFrame:
    """(tag, facet): the first facet in order of each item."""
    return members.groupBy("tag").agg(F.min_by("facet", "ord").alias("facet"))


def anchors_in(anchors: DataFrame, pools: DataFrame) -> DataFrame:
    """(facet, tag) for anchors (place, tag) and a module's pools (facet, ord, tag): an anchor goes to the first facet whose
    pool has it, and each facet takes one, the first in place."""
    owned = anchors.join(pools, "tag").groupBy("place", "tag").agg(F.min_by("facet", "ord").alias("facet"))
    return owned.groupBy("facet").agg(F.min_by("tag", "place").alias("tag"))


def owned_anywhere(anchors: DataFrame, pools: DataFrame) -> DataFrame:
    """anchors with owned: whether any of the modules' pools (module, facet, tag) has it."""
    return anchors.join(pools.select("tag", F.lit(True).alias("owned")).distinct(), "tag", "left").withColumn("owned", F.coalesce("owned", F.lit(False)))
