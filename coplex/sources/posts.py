"""From posts (baskets with lists of tags) to the index tables that queries run on."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import ranked

#: Most items of an index: ids are small integers, and the dictionary goes to every task of a join.
MOST_TIDS = 32_767

#: Letters of a rating and their codes.
RATINGS = {"g": 0, "s": 1, "q": 2, "e": 3}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def posts_from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as posts: (id, created_at, rating, entity, segment, region, general_tags, copyright_tags, character_tags).

    Tags come from an order's lines and their parts; an order without lines has none."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag", "l_linestatus", (F.col("l_discount") >= 0.09).alias("hid"))
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_name")

    def tags(line: Column) -> Column:
        words = F.split(line["p_name"], " ")
        return F.array(
            F.concat(F.lit("brand:"), line["p_brand"]),
            F.concat(F.lit("type:"), line["p_type"]),
            F.concat(F.lit("adj:"), F.get(words, F.lit(0))),
            F.concat(F.lit("noun:"), F.get(words, F.lit(1))),
            F.concat(F.lit("flag:"), line["l_returnflag"]),
            F.concat(F.lit("line:"), line["l_linestatus"]),
            F.when(line["l_returnflag"] == "R", F.concat(F.lit("ret:"), line["l_linestatus"])),
            F.when(line["hid"], F.lit("hid:y")),
        )

    # lines are dealt out by order as they are and named there: tags take several times their bytes, and grouping them before the
    # shuffle would order them all without making them fewer
    line = F.struct("p_brand", "p_type", "p_name", "l_returnflag", "l_linestatus", "hid")
    dealt = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", line.alias("line")).repartition("l_orderkey")
    general = dealt.groupBy("l_orderkey").agg(F.collect_set("line").alias("lines"))
    general = general.select("l_orderkey", F.sort_array(F.array_distinct(F.array_compact(F.flatten(F.transform("lines", tags))))).alias("general_tags"))
    place = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    buyers = table(spark, sf_dir, "customer").join(place, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_mktsegment", "r_name")
    urgency = F.substring("o_orderpriority", 1, 1)
    rating = F.when(urgency == "1", "g").when(urgency == "2", "s").when(urgency == "3", "q").otherwise("e")
    bought = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", rating.alias("rating"))
    orders = bought.join(buyers, F.col("o_custkey") == F.col("c_custkey")).join(general, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    entity = F.when(F.col("o_custkey") % 3 == 0, 0).otherwise(F.col("o_custkey") % 50 + 1).cast("int")
    return orders.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderdate").alias("created_at"),
        "rating",
        F.col("c_mktsegment").alias("segment"),
        F.col("r_name").alias("region"),
        F.coalesce("general_tags", F.array().cast("array<string>")).alias("general_tags"),
        F.array("c_mktsegment", "r_name").alias("copyright_tags"),
        F.when(entity == 0, F.array().cast("array<string>")).otherwise(F.array(F.format_string("c%03d", entity))).alias("character_tags"),
    )


def unique(posts: DataFrame) -> bool:
    """Whether no two posts have the same id."""
    return posts.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()


def incidence(posts: DataFrame, unique: bool = False) -> DataFrame:
    """(pid, tag, rating), each once; of posts with unique ids, without a shuffle."""
    tags = F.array_distinct("general_tags") if unique else F.col("general_tags")
    found = posts.select(F.col("id").alias("pid"), "rating", F.explode(tags).alias("tag")).select("pid", "tag", "rating")
    return found if unique else found.distinct()


def id_cut(posts: DataFrame, since: str) -> DataFrame:
    """One row: the smallest id among posts created at or after `since`."""
    return posts.filter(F.col("created_at") >= F.lit(since).cast("timestamp")).agg(F.min("id").alias("id_since"))


def dictionary(inc: DataFrame) -> DataFrame:
    """(tag, tid, n): tid is the rank by frequency, ties by name. Counted tags are ranked by ranges, not in one task."""
    return by_frequency(inc.groupBy("tag").agg(F.count(F.lit(1)).alias("n")))


def by_frequency(counts: DataFrame) -> DataFrame:
    """The dictionary of counts (tag, n)."""
    return ranked(counts, "tid", F.desc("n"), F.col("tag")).select("tag", "tid", "n")


def reduced(inc: DataFrame, tags: DataFrame, first_id: int, base_tag: str, tid_cut: int) -> DataFrame:
    """(pid, tid, rating) of baskets from first_id on that carry base_tag, for tags up to tid_cut."""
    if tid_cut > MOST_TIDS:
        raise ValueError(f"an index has at most {MOST_TIDS} items")
    population = inc.filter((F.col("tag") == base_tag) & (F.col("pid") >= first_id)).select("pid")
    kept = inc.filter(F.col("pid") >= first_id).join(population, "pid", "left_semi")
    # at most tid_cut rows; joined by a shuffle, a tag in nearly every basket would be one hot key
    cut = tags.filter(F.col("tid") <= tid_cut)
    return kept.join(F.broadcast(cut), "tag").select("pid", F.col("tid").cast("smallint").alias("tid"), "rating")


def write_item_major(rows: DataFrame, path: str) -> None:
    """Sorted by (tid, pid), so that a filter on tid skips row groups; the committer makes the write atomic."""
    rows.repartitionByRange("tid", "pid").sortWithinPartitions("tid", "pid").write.mode("overwrite").parquet(path)


def baskets(rows: DataFrame) -> DataFrame:
    """Basket-major layout: (pid, items, n_items, rating code)."""
    made = rows.groupBy("pid").agg(F.sort_array(F.collect_set("tid")).alias("items"), rating_code(F.first("rating")).alias("rating"))
    return made.withColumn("n_items", F.size("items"))


def rating_code(rating: Column) -> Column:
    return F.create_map(*[x for k, v in RATINGS.items() for x in (F.lit(k), F.lit(v))])[rating].cast("tinyint")


def places(names: Sequence[str]) -> Callable[[str], Column]:
    """A function of array columns: the places, from 1, that their names have in a list of MOST_TIDS at most, ascending and each once."""

    @F.arrow_udf("array<smallint>")
    def found(tags: pa.Array) -> pa.Array:
        flat = pc.list_flatten(tags)
        at = pc.index_in(flat, value_set=pa.array(names, flat.type))
        known = pc.is_valid(at).to_numpy(zero_copy_only=False)
        row = pc.list_parent_indices(tags).to_numpy().astype("int64")[known]
        key = np.unique(row << 15 | at.drop_null().to_numpy().astype("int64"))  # by row, then place
        ends = np.cumsum(np.bincount(key >> 15, minlength=len(tags)))
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype("int32")), pa.array(((key & 32767) + 1).astype("int16")))

    return found


def baskets_in_place(posts: DataFrame, names: Sequence[str], first_id: int, base_tag: str) -> DataFrame:
    """Posts with unique ids as baskets: those from first_id on that carry base_tag, with items, the places of their tags among the
    names (sorted, the dictionary up to its cut), and pid, rating code and n_items. What baskets() makes of reduced() rows, without a shuffle."""
    if len(names) > MOST_TIDS:
        raise ValueError(f"an index has at most {MOST_TIDS} items")
    kept = posts.filter((F.col("id") >= first_id) & F.array_contains("general_tags", base_tag))
    made = kept.withColumn("items", places(list(names))("general_tags")).withColumn("n_items", F.size("items")).filter("n_items > 0")
    return made.withColumns({"pid": F.col("id"), "rating": rating_code(F.col("rating"))})


def with_entities(posts: DataFrame) -> DataFrame:
    """posts with entity: dense rank of a post's first character tag, 0 without one. Distinct names are ranked by ranges."""
    named = posts.withColumn("_name", F.try_element_at("character_tags", F.lit(1)))
    ranks = ranked(named.filter("_name IS NOT NULL").select("_name").distinct(), "_entity", F.col("_name"))
    return named.join(ranks, "_name", "left").withColumn("entity", F.coalesce("_entity", F.lit(0))).drop("_name", "_entity")


def entity_ids(posts: DataFrame) -> DataFrame:
    """(pid, entity) of posts."""
    return with_entities(posts.select("id", "character_tags")).select(F.col("id").alias("pid"), "entity")
