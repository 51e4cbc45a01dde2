"""The stored index: everything that queries need from posts, written once and read back.

Item-major rows sorted by (tid, pid) answer posting lists by row-group statistics, and so do bitmaps of the same; basket-major
rows hold a basket's items, rating, entity and bits in one row. Small tables are the dictionary, base rates per rating, single counts, pair
counts and constants. A build goes into a version's folder below one that is named by its inputs' files and sizes and its
settings; the constants are written last, so a build that broke off is no version."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coplex.operators import bitmaps as bm
from coplex.operators import counts as ct
from coplex.operators import predicates as pr
from coplex.operators import samples as sm
from coplex.operators import substrings as ss

from . import posts as ps
from .store import delete, shared_dir, stored

BASKETS = "pid long, items array<smallint>, rating tinyint, n_items int, entity int, costume_bits int, segment_bits int, solo boolean"
SCHEMAS = {
    "tags": "tag string, n long, tid int",
    "rates": "tag string, n long, rating string",
    "grams": "gram string, tid int, tag string, n long, bucket int",
    "rows": "pid long, tid smallint, rating string",
    "words": "tid smallint, word long, bits long",
    "sketches": f"tid smallint, place int, hash string, {BASKETS}",
    "baskets": BASKETS,
    "singles": "tid smallint, n long",
    "pairs": "a smallint, b smallint, n_ab long",
    "consts": "id_since long, n_all long, n_gs long, n_e long, pair_total long",
}


@dataclass(frozen=True)
class Settings:
    """since: date of the id cut. base: item of the base population. solo_with, solo_without: items that the pair table's
    population has all of, and none of. pair_pools: prefixes of the items that pairs are counted for."""

    since: str
    base: str
    tid_cut: int
    segments: tuple[str, ...]
    costumes: tuple[str, ...]
    solo_with: tuple[str, ...]
    solo_without: tuple[str, ...]
    pair_pools: tuple[str, ...]


def fingerprint(spark: SparkSession, paths: Sequence[str], settings: Settings) -> str:
    """Changes with the name, size or time of any input file, and with the settings."""
    files = spark.read.format("binaryFile").load(list(paths)).select(F.xxhash64("path", "length", "modificationTime").alias("h"), "length")
    # two sums of the files' hashes, whose order doesn't matter
    found = files.agg(F.count(F.lit(1)), F.sum("length"), F.bit_xor("h"), F.sum(F.pmod("h", F.lit((1 << 31) - 1)))).first()
    return hashlib.sha256(repr((tuple(found), asdict(settings), SCHEMAS)).encode()).hexdigest()[:24]


#: The version that each application reads, by root.
_pinned: dict[tuple[str, str], str] = {}


@dataclass
class Index:
    spark: SparkSession
    path: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.path}/{name}")

    def views(self, prefix: str = "coplex_") -> None:
        """Every table as a temporary view, for SQL."""
        for name in SCHEMAS:
            self.table(name).createOrReplaceTempView(prefix + name)

    def warm(self) -> DataFrame:
        """Baskets read into the executors' memory; the caller releases them with unpersist()."""
        kept = self.table("baskets").cache()
        kept.count()
        return kept


#: Frees the shuffle files of a step as soon as it has been written.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def packed(df: DataFrame, path: str, *partition_by: str) -> DataFrame:
    """stored() with what takes least disk: differences of neighbouring numbers, zstd."""
    df.write.mode("overwrite").options(**{"compression": "zstd", "parquet.writer.version": "v2"}).partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def build(spark: SparkSession, posts: DataFrame, path: str, settings: Settings) -> Index:
    """Writes the tables of an index. What takes disk besides them: shuffles of one step at a time, posts until baskets are made of
    them, and rated words until the layouts are."""
    before = spark.conf.get(FREED, None)
    spark.conf.set(FREED, "true")
    try:
        return _build(spark, posts, path, settings)
    finally:
        spark.conf.set(FREED, before) if before else spark.conf.unset(FREED)


def _build(spark: SparkSession, posts: DataFrame, path: str, settings: Settings) -> Index:
    index, s = Index(spark, path), settings
    posts = packed(posts, f"{path}/posts")
    unique = ps.unique(posts)
    inc = ps.incidence(posts, unique)
    if not unique:
        inc = packed(inc, f"{path}/incidence")
    counts = stored(inc.groupBy("tag", "rating").agg(F.count(F.lit(1)).alias("n")), f"{path}/counts")
    tags = stored(ps.by_frequency(counts.groupBy("tag").agg(F.sum("n").alias("n"))).select("tag", "n", "tid"), f"{path}/tags")
    stored(ss.grams(tags), f"{path}/grams", "bucket")
    rates = None
    for rating in ("all", "gs", "e"):
        own = ct.base_rates(counts, rating, F.sum("n")).select("tag", "n", F.lit(rating).alias("rating"))
        rates = own if rates is None else rates.unionByName(own)
    stored(rates, f"{path}/rates", "rating")
    consts = posts.agg(F.min(F.when(F.col("created_at") >= F.lit(s.since).cast("timestamp"), F.col("id"))).alias("id_since"), F.count(F.lit(1)).alias("n_all"), F.count_if(F.col("rating").isin("g", "s")).alias("n_gs"), F.count_if(F.col("rating") == "e").alias("n_e"))
    consts = stored(consts, f"{path}/sizes")
    first_id = consts.first()["id_since"] or 0
    tid = {r["tag"]: r["tid"] for r in tags.filter(F.col("tid") <= s.tid_cut).select("tag", "tid").collect()}  # tid_cut rows
    bits = {"costume_bits": pr.packed_bits([F.col("segment") == x for x in s.costumes]), "segment_bits": pr.packed_bits([F.array_contains("copyright_tags", x) for x in s.segments])}
    known = lambda names: [tid[x] for x in names if x in tid]
    solo = pr.has_all(known(s.solo_with)) & ~pr.has_any(known(s.solo_without)) if len(known(s.solo_with)) == len(s.solo_with) else F.lit(False)
    if unique:
        made = ps.baskets_in_place(ps.with_entities(posts), sorted(tid, key=tid.get), first_id, s.base).withColumns(bits)
    else:
        ps.write_item_major(ps.reduced(inc, tags, first_id, s.base, s.tid_cut), f"{path}/rows")
        marked = posts.select(F.col("id").alias("pid"), *(x.alias(k) for k, x in bits.items()))
        made = ps.baskets(index.table("rows")).join(ps.entity_ids(posts), "pid", "left").join(marked, "pid", "left")
    made = made.select("pid", "items", "rating", "n_items", F.coalesce("entity", F.lit(0)).alias("entity"), F.coalesce("costume_bits", F.lit(0)).alias("costume_bits"), F.coalesce("segment_bits", F.lit(0)).alias("segment_bits"), solo.alias("solo"))
    # neighbouring baskets in one task, so that words are whole before they are shuffled
    baskets = packed(made.repartitionByRange("pid").sortWithinPartitions("pid"), f"{path}/baskets")
    for done in (posts, counts, *([] if unique else [inc])):
        delete(done)
    if unique:
        each = baskets.select("pid", F.explode("items").alias("tid"), "rating").unionByName(bm.marks(baskets).withColumn("rating", F.lit(None)))
        rated = packed(bm.rated_words(each, len(ps.RATINGS)).repartitionByRange("tid", "word").sortWithinPartitions("tid", "word"), f"{path}/rated")
        words = packed(rated.select("tid", "word", "bits").sortWithinPartitions("tid", "word"), f"{path}/words")
        packed(bm.item_major(rated.filter("tid > 0").sortWithinPartitions("tid", "word"), list(ps.RATINGS)), f"{path}/rows")
        delete(rated)
    else:
        words = bm.words(index.table("rows").select("pid", "tid").unionByName(bm.marks(baskets)))
        words = packed(words.repartitionByRange("tid", "word").sortWithinPartitions("tid", "word"), f"{path}/words")
    packed(sm.sketches(baskets), f"{path}/sketches")
    pool, population = sorted(v for k, v in tid.items() if k.startswith(s.pair_pools)), baskets.filter("solo")
    inside = packed(ct.within(words, bm.words(population.select("pid", F.lit(0).alias("tid"))).select("word", "bits"), pool), f"{path}/inside")
    stored(ct.single_counts(inside), f"{path}/singles")
    stored(ct.pair_table(inside), f"{path}/pairs")
    delete(inside)
    stored(consts.withColumn("pair_total", F.lit(population.count()).cast("long")), f"{path}/consts")
    return index


def versions(spark: SparkSession, root: str) -> list[str]:
    """Whole versions below a root: those whose constants, which are written last, have been committed."""
    glob = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/*/consts/_SUCCESS")
    found = glob.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(glob) or []
    return sorted(f"{root}/{x.getPath().getParent().getParent().getName()}" for x in found)


def opened(spark: SparkSession, sf_dir: str, posts: Callable[[], DataFrame], tables: Sequence[str], settings: Settings) -> Index:
    """The index over a folder's tables, built if it isn't there.

    Each build has a folder of its own, so builders never meet and a broken build is never read. Of several whole versions
    readers take the first by name; an application stays with the version it has begun with, for as long as that is there."""
    root = f"{shared_dir(spark)}/index-{fingerprint(spark, [f'{sf_dir}/{t}.parquet' for t in tables], settings)}"
    key, there = (spark.sparkContext.applicationId, root), versions(spark, root)
    if not there:
        build(spark, posts(), f"{root}/{uuid.uuid4().hex}", settings)
        there = versions(spark, root)
    if _pinned.get(key) not in there:
        _pinned[key] = there[0]
    return Index(spark, _pinned[key])
