"""Quality rules whose cutoffs adapt to each language and source.

One projection over the texts gives a few counts per document, all inside the JVM; they are written once. Mergeable
quantile sketches (Greenwald-Khanna summaries, built per partition and merged) then give quantiles of four ratios per
language and source, per language and over all. A small group's quantiles are drawn towards its parent's, as if it had
PRIOR documents like them, and become fences; a join brings each document its group's fences.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, staged

#: Words of a window that counts as repeated when it is found twice.
WINDOW = 5
#: Accuracy of the sketches: ranks are right to 1 / ACCURACY of a group.
ACCURACY = 10_000
#: Documents of the parent that a group's quantiles count.
PRIOR = 20


@dataclass(frozen=True)
class Rule:
    """A document may have `count` of at most (q + reach * (q - median)) * `per` + spare, where q is the quantile `tail` of
    count / per in its group; two-sided rules have the mirrored lower fence too. spare is about one occurrence, which
    says little about a short text."""

    count: str
    per: str
    tail: float
    reach: float
    spare: float
    two_sided: bool = False


#: About a tenth of a corpus may be junk by symbols and lengths; repetition is common in small amounts.
RULES = {
    "symbol_ratio": Rule("n_symbols", "n_words", 0.9, 3.0, 1.0),
    "dup_line_ratio": Rule("n_dup_lines", "n_lines", 0.98, 1.0, 1.0),
    "repeat_ratio": Rule("n_repeat_words", "n_words", 0.98, 1.5, 5.0),
    "mean_word": Rule("word_chars", "n_words", 0.9, 4.0, 10.0, two_sided=True),
}


def repeated_words(words: Column) -> Column:
    """Number of words inside windows of WINDOW words that occur twice or more in the array, first ones included.

    Windows are compared by 64-bit hash within one text. Only texts with a repeated window pay for the sort of
    (hash, start); starts in order then cover min(WINDOW, distance to the next start) words each."""
    n = F.size(words)
    at = lambda i: F.xxhash64(*(F.get(words, i + F.lit(k)) for k in range(WINDOW)))
    hashes = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), at)).otherwise(F.array().cast("array<bigint>"))

    def covered(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        same = lambda s, i, j: F.coalesce(F.get(s, j)["h"] == F.get(s, i)["h"], F.lit(False))
        # get() gives null beyond either end
        starts = lambda s: F.array_sort(F.transform(F.filter(F.transform(s, lambda x, i: F.when(same(s, i, i - 1) | same(s, i, i + 1), x["i"])), lambda x: x.isNotNull()), lambda x: x))
        width = lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x)
        return let(let(pairs, starts), width)

    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h))).cast("long")


def let(value: Column, body) -> Column:
    """body(value) with value computed once, as the element of a one-element array.

    A plain column would be folded into the lambdas that use it, and computed anew for each of their elements."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def metrics(docs: DataFrame) -> DataFrame:
    """Counts per row of docs, without its text."""
    text = F.coalesce("text", F.lit(""))
    words = F.array_remove(F.split(text, SPACE), "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\f\r")) != "")
    by_word = let(words, lambda w: F.struct(F.size(w).alias("n"), F.length(F.array_join(w, "")).alias("chars"), repeated_words(w).alias("repeated")))
    by_line = let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))
    counted = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce("lang", F.lit("")).alias("lang"),
        F.coalesce("source", F.lit("")).alias("source"),
        (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        by_word.alias("w"),
        by_line.alias("l"),
    )
    return counted.select(
        "doc_id",
        "lang",
        "source",
        F.col("w.n").cast("long").alias("n_words"),
        F.col("w.chars").cast("long").alias("word_chars"),
        "n_symbols",
        F.col("l.n").cast("long").alias("n_lines"),
        F.col("l.dup").cast("long").alias("n_dup_lines"),
        F.col("w.repeated").alias("n_repeat_words"),
    )


def thresholds(measured: DataFrame) -> DataFrame:
    """Fences per (lang, source): <ratio>_max, and <ratio>_min where two-sided."""
    good = ~F.col("base_failed")
    sketches = [F.percentile_approx(F.when(good, F.col(r.count) / F.greatest(r.per, F.lit(1))), [1 - r.tail, 0.5, r.tail], ACCURACY).alias(x) for x, r in RULES.items()]
    levels = measured.rollup("lang", "source").agg(F.grouping_id().alias("level"), F.count_if(good).alias("n"), *sketches)
    levels = staged(levels.withColumn("root", F.lit(0)), "quantiles")  # as many rows as languages and sources have pairs
    all_rows, languages, groups = (levels.filter(F.col("level") == x) for x in (3, 1, 0))

    def drawn(own: DataFrame, parent: DataFrame, keys: list[str]) -> DataFrame:
        p = parent.select(*keys, *(F.col(x).alias(f"parent_{x}") for x in RULES))
        joined = own.join(p, keys)
        towards = lambda x: F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: (F.col("n") * F.coalesce(F.get(x, i), F.lit(0.0)) + PRIOR * F.get(f"parent_{x}", i)) / (F.col("n") + PRIOR))
        return joined.select("lang", "source", "n", *(towards(x).alias(x) for x in RULES))

    found = drawn(groups, drawn(languages, all_rows, ["root"]), ["lang"])
    return found.select(
        "lang",
        "source",
        *((F.col(x)[2] + r.reach * (F.col(x)[2] - F.col(x)[1])).alias(f"{x}_max") for x, r in RULES.items()),
        *((F.col(x)[0] - r.reach * (F.col(x)[1] - F.col(x)[0])).alias(f"{x}_min") for x, r in RULES.items() if r.two_sided),
    )


def quality_rules(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    Needs doc_id, text, lang and source; other columns are not read. A null text has no words and fails the base
    rule; null languages and sources count as ''. Repeated rows are judged each. A group none of whose documents
    passes the base rule has its parent's fences. An empty table gives an empty result."""
    base_failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    measured = staged(metrics(docs).withColumn("base_failed", base_failed), "quality-metrics")
    inside = F.lit(True)
    for x, r in RULES.items():
        per = F.greatest(r.per, F.lit(1))
        inside &= F.col(r.count) <= F.col(f"{x}_max") * per + r.spare
        if r.two_sided:
            inside &= F.col(r.count) >= F.col(f"{x}_min") * per - r.spare
    kept = ~F.col("base_failed") & F.coalesce(inside, F.lit(False))
    # written, so that it is broadcast if its measured size allows, and a hot group's rows can be split if not
    judged = measured.join(staged(thresholds(measured), "fences"), ["lang", "source"], "left")
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"))
