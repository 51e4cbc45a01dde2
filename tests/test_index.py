"""Index tables, facets, samples, draws, manifests and the streaming refresh on small tables."""

import hashlib
import json
from dataclasses import replace

import pytest

from coplex.functions import facets as fx
from coplex.operators import bitmaps as bm
from coplex.operators import counts as ct
from coplex.operators import predicates as pr
from coplex.operators import samples as sm
from coplex.plans import roll as R
from coplex.sources import manifest as mf
from coplex.sources import posts as ps
from coplex.streaming.counts import refresh
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def posts(spark):
    rows = [(i, f"20{10 + i % 12}-01-01", "gsqe"[i % 4], [t for t in ("base" if i % 5 else "other", f"a_{i % 3}", f"b_{i % 7}")], ["x"], [f"c{i % 4}"] if i % 4 else []) for i in range(1, 200)]
    df = spark.createDataFrame(rows, "id long, created_at string, rating string, general_tags array<string>, copyright_tags array<string>, character_tags array<string>")
    return df.withColumn("created_at", F.to_timestamp("created_at"))


def test_index(spark, posts, tmp_path):
    inc = ps.incidence(posts).cache()
    tags = ps.dictionary(inc)
    assert [r.n for r in tags.orderBy("tid").collect()] == sorted((r.n for r in tags.collect()), reverse=True)
    first = ps.id_cut(posts, "2016-01-01").first()["id_since"]
    assert first == 6
    rows = ps.reduced(inc, tags, first, "base", 8)
    assert rows.filter(f"pid < {first} OR tid > 8").isEmpty()
    ps.write_item_major(rows, str(tmp_path / "items"))
    again = spark.read.parquet(str(tmp_path / "items"))
    assert again.exceptAll(rows).isEmpty() and rows.exceptAll(again).isEmpty()
    baskets = ps.baskets(rows)
    assert baskets.filter("n_items <> size(array_distinct(items))").isEmpty()
    entities = {r.pid: r.entity for r in ps.entity_ids(posts).collect()}
    assert entities[4] == 0 and entities[1] == 1 and entities[3] == 3
    assert ps.dictionary(inc.limit(0)).isEmpty()
    assert {r.tag: r.n for r in ct.base_rates(inc, "e").collect()}["a_0"] == sum(1 for i in range(1, 200) if i % 4 == 3 and i % 3 == 0)


def test_samples(spark, posts):
    df = posts.select(F.col("id").alias("pid"), F.size("general_tags").alias("n_items"), F.array(F.lit(1).cast("smallint")).alias("items"), (F.col("id") % 4).cast("int").alias("entity"), (F.col("id") % 4).alias("rating"))
    a, b = sm.take(df, 20, 1), sm.take(df.repartition(7), 20, 1)
    assert sorted(r.pid for r in a.collect()) == sorted(r.pid for r in b.collect()) and a.count() == 20
    capped = sm.cap_entities(df, 5, 1).groupBy("entity").count().collect()
    assert {r.entity: r["count"] for r in capped} == {0: 49, 1: 5, 2: 5, 3: 5}
    assert sm.cap_entities(df, 0, 1).count() == df.count()
    assert sm.sub_sample(df, [1], "gs", entity_cap=0).filter("rating > 1").isEmpty()
    assert sm.sub_sample(df, [2]).isEmpty()


def test_predicates():
    assert pr.mask_of(["b", "all", "zzz", "b"], ["a", "b", "c"]) == 2
    assert pr.mask_of([], ["a"]) == 0


def test_facets(spark):
    tags = spark.createDataFrame([("long_hair",), ("hair_bow",), ("red_eyes",), ("bow",)], "tag string")
    rules = spark.createDataFrame([("hair", 0, "last", "hair"), ("deco", 1, "word", "bow"), ("eyes", 2, "regex", "^[a-z_-]+_eyes$"), ("hairy", 3, "prefix", "hair")], "facet string, ord int, kind string, pattern string")
    members = fx.memberships(tags, rules)
    assert sorted((r.tag, r.facet) for r in members.collect()) == [("bow", "deco"), ("hair_bow", "deco"), ("hair_bow", "hairy"), ("long_hair", "hair"), ("red_eyes", "eyes")]
    assert {r.tag: r.facet for r in fx.exclusive(members).collect()}["hair_bow"] == "deco"
    row = spark.range(1).select(fx.split_list(F.lit(" Long Hair ,, Bow")).alias("x")).select("x", fx.prompt(F.array(F.lit("long_hair"), F.lit("^_^"))).alias("p")).first()
    assert row.x == ["long_hair", "bow"] and row.p == "long hair, ^_^"


def test_draws(spark):
    df = spark.createDataFrame([("f", i, float(i)) for i in range(5)], "facet string, tid int, weight double")
    seen = [R.draw(df, s).first()["tid"] for s in range(12)]
    assert 0 not in seen and len(set(seen)) > 1 and seen[3] == R.draw(df, 3).first()["tid"]
    several = R.draw_several(df, 3, 1).collect()
    assert len({r.tid for r in several}) == 3
    assert R.pick([0.0, 0.0], 0.5) is None and R.pick([1, 1], 0.9) == 1
    u = [R.random_number(1, i) for i in range(4000)]
    assert 0 < min(u) and max(u) < 1 and abs(sum(u) / len(u) - 0.5) < 0.02
    assert spark.range(1).select(sm.uniform(F.lit(1), F.lit(7))).first()[0] == R.random_number(1, 7)
    assert R.weights([0.2, 0.2], 0.5, True, 1) == [0.2, 0.2] and sum(R.weights([0.2, 0.3], 0.5, False, 1)) == pytest.approx(1)


def test_pair_lift(spark):
    rows = spark.createDataFrame([(p, t) for p in range(300) for t in ((1, 2) if p < 150 else (1,) if p < 200 else (3,))], "pid int, tid int")
    inside = ct.within(bm.words(rows), bm.words(rows.select("pid", F.lit(0).alias("tid"))).select("word", "bits"), [1, 2, 3])
    pairs, singles = ct.pair_table(inside), ct.single_counts(inside)
    assert {(r.a, r.b): r.n_ab for r in pairs.collect()} == {(1, 2): 150}
    asked = spark.createDataFrame([(1, 2), (2, 1), (3, 1), (9, 1)], "x int, y int")
    got = {(r.x, r.y): r.lift for r in ct.pair_lifts(asked, pairs, singles, 300).collect()}
    assert got[(1, 2)] == pytest.approx((150 / 200) / (150 / 300)) and got[(2, 1)] == pytest.approx(1.5) and got[(3, 1)] == 0 and got[(9, 1)] is None


def test_manifest(spark, tmp_path):
    (tmp_path / "data").mkdir()
    (tmp_path / "data" / "a.parquet").write_bytes(b"abc")
    found = mf.manifest(spark, str(tmp_path / "data"))
    assert found.first()["sha256"] == hashlib.sha256(b"abc").hexdigest()
    (tmp_path / "m.json").write_text(json.dumps({"files": [{"name": "a.parquet", "size": 3, "sha256": ""}, {"name": "b.parquet", "size": 1, "sha256": ""}]}))
    wanted = mf.read_manifest(spark, str(tmp_path / "m.json"))
    assert [r.name for r in mf.missing(wanted, mf.listing(spark, str(tmp_path / "data"))).collect()] == ["b.parquet"]
    with pytest.raises(FileNotFoundError):
        mf.need(wanted.limit(0), "the dictionary")


def test_checksum_tree(spark, tmp_path):
    """Blocks of a folder by hand, a copy that broke off and one of other bytes; empty files, none at all."""
    data = {"a": bytes(range(256)) * 10, "b": b"", "c": b"x" * 100, "d e": b"y" * 1001}
    (tmp_path / "in").mkdir(), (tmp_path / "copy").mkdir(), (tmp_path / "none").mkdir()
    for name, content in data.items():
        (tmp_path / "in" / name).write_bytes(content)
    del data["b"]  # Spark's readers skip empty files
    hashed = mf.blocks(spark, str(tmp_path / "in"), block=100).cache()
    got = {(r.name, r.block): (r.size, r.start, r.length, r.sha256) for r in hashed.collect()}
    want = {(n, i): (len(x), i * 100, len(x[i * 100 : i * 100 + 100]), hashlib.sha256(x[i * 100 : i * 100 + 100]).hexdigest()) for n, x in data.items() for i in range(max(1, -(-len(x) // 100)))}
    assert got == want
    roots = {r.name: (r.size, r.n_blocks, r.root) for r in mf.tree(hashed).collect()}
    for name, content in data.items():
        own = [v[3] for k, v in sorted(want.items()) if k[0] == name]
        assert roots[name] == (len(content), len(own), hashlib.sha256("".join(own).encode()).hexdigest())
    (tmp_path / "copy" / "a.part").write_bytes(data["a"][:1050])
    (tmp_path / "copy" / "d e").write_bytes(data["d e"][:350] + b"!" + data["d e"][351:720] + b"!" + data["d e"][721:])
    (tmp_path / "copy" / "b").write_bytes(b"longer")
    copied = mf.blocks(spark, str(tmp_path / "copy"), block=100)
    lacking = {(r.name, r.start, r.length) for r in mf.to_fetch(hashed, copied).collect()}
    assert lacking == {("a", 1000, 1560), ("c", 0, 100), ("d e", 300, 100), ("d e", 700, 100)}
    state = {r.name: (r.have, r.state) for r in mf.status(mf.tree(hashed), mf.listing(spark, str(tmp_path / "copy"))).collect()}
    assert state == {"a": (1050, "partial"), "c": (0, "missing"), "d e": (1001, "complete")}
    texts = spark.createDataFrame([(n, x.decode("latin-1")) for n, x in data.items() if n != "a"] + [("null", None), ("wide", "é日" * 90)], "n string, t string")
    found = {(r.name, r.block): r.sha256 for r in mf.text_blocks(texts, F.col("n"), F.col("t"), 100).collect()}
    wide = ("é日" * 90).encode()
    assert found == {k: v[3] for k, v in want.items() if k[0] != "a"} | {("null", 0): hashlib.sha256(b"").hexdigest()} | {("wide", i): hashlib.sha256(wide[i * 100 : i * 100 + 100]).hexdigest() for i in range(5)}
    assert mf.tree(mf.blocks(spark, str(tmp_path / "none"))).collect() == []


def test_streaming_refresh(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, "a"), (2, "b")], "pid long, tag string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("pid long, tag string").parquet(str(tmp_path / "in"))
    refresh(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).groupBy("tag").agg(F.sum("n").alias("n"))
    assert {r.tag: r.n for r in got.collect()} == {"a": 2, "b": 1}


def test_increments(spark, posts, tmp_path):
    from coplex.streaming import increments as inc

    rules = (["base"], ["a_0"], ["a_", "b_"])
    rows = posts.select("id", "rating", "general_tags", F.lit(1).alias("op")).cache()
    gone = rows.filter("id % 3 = 0").withColumn("op", F.lit(-1))
    parts = [rows.filter("id % 2 = 0"), gone, rows.filter("id % 2 = 1"), rows.limit(0)]
    want = {k: sorted(map(tuple, df.collect())) for k, df in inc.deltas(rows.filter("id % 3 <> 0"), *rules).items()}
    for name, order in (("one", [0, 1, 2, 3]), ("two", [1, 3, 2, 0])):  # a retraction may come first
        path = str(tmp_path / name)
        for n, i in enumerate(order):
            parts[i].coalesce(1).write.mode("append").parquet(f"{path}/in")
            stream = spark.readStream.schema("id long, rating string, general_tags array<string>, op int").option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
            inc.refresh(stream, f"{path}/out", f"{path}/state", *rules).awaitTermination()
        assert {k: sorted(map(tuple, inc.current(spark, f"{path}/out", k).collect())) for k in inc.TABLES} == want
        inc.compacted(spark, f"{path}/out", f"{path}/less")
        assert {k: sorted(map(tuple, inc.current(spark, f"{path}/less", k).collect())) for k in inc.TABLES} == want
    assert inc.dictionary(spark, f"{path}/out").orderBy("tid").first().tag == "base"


def test_entry_without_llm():
    """The entry module imports and lists the core queries when the optional parts are gone."""
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    code = "import sys; sys.modules['coplex.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert 'm8_candidates' in q and not any(k.startswith('op') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"
    assert subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True).returncode == 0


def test_entry_when_folders_are_gone(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "coplex", tmp_path / "coplex", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert 'm8_candidates' in e.queries() and not any(k.startswith('op') or k == 'pipeline' for k in e.queries())"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin"}, capture_output=True).returncode == 0


def test_stored_index(spark, posts, tmp_path):
    from coplex.sources import index as ix
    from coplex.sources import store

    settings = ix.Settings("2016-01-01", "base", 8, ("x",), ("one", "two"), ("base",), ("a_0",), ("a_", "b_"))
    rows = posts.withColumns({"segment": F.when(F.col("id") % 2 == 0, "one").otherwise("two")})
    index = ix.build(spark, rows, str(tmp_path / "index"), settings)
    baskets = index.table("baskets")
    assert baskets.count() == index.table("rows").select("pid").distinct().count()
    assert baskets.filter("costume_bits NOT IN (1, 2) OR segment_bits <> 1").isEmpty()
    tid = {r.tag: r.tid for r in index.table("tags").collect()}
    assert {r.pid for r in baskets.filter("solo").collect()} == {r.pid for r in baskets.collect() if tid["base"] in r["items"] and tid["a_0"] not in r["items"]}
    assert "PushedFilters: [IsNotNull(tid), EqualTo(tid,1)]" in index.table("rows").filter("tid = 1")._jdf.queryExecution().toString()
    consts = index.table("consts").first()
    assert consts.id_since == 6 and consts.n_all == 199 and consts.pair_total == baskets.filter("solo").count()
    index.views("test_")
    assert spark.sql("SELECT count(*) FROM test_pairs").first()[0] == index.table("pairs").count() > 0
    assert index.warm().unpersist().count() == baskets.count()
    assert store.exists(spark, f"{index.path}/consts") and not store.exists(spark, f"{index.path}/none")
    empty = ix.build(spark, rows.limit(0), str(tmp_path / "empty"), settings)
    assert empty.table("baskets").isEmpty() and empty.table("consts").first().n_all == 0
    with pytest.raises(KeyError):
        sm.posting(index.table("rows"), None)


def test_stored_index_of_unique_ids(spark, posts, tmp_path, monkeypatch):
    """Posts with unique ids need no shuffle by basket; the index is the same as by the way for repeated ids, and only its tables stay."""
    from coplex.sources import index as ix

    settings = ix.Settings("2016-01-01", "base", 8, ("x",), ("one", "two"), ("base",), ("a_0",), ("a_", "b_"))
    rows = posts.withColumns({"segment": F.when(F.col("id") % 2 == 0, "one").otherwise("two"), "general_tags": F.concat("general_tags", F.array(F.lit("a_1"), F.lit("a_1")))})
    one = ix.build(spark, rows, str(tmp_path / "one"), settings)
    assert {x.name for x in (tmp_path / "one").iterdir()} == {*ix.SCHEMAS, "sizes"}
    assert not ps.unique(rows.unionByName(rows.limit(1))) and ps.unique(rows)
    monkeypatch.setattr(ps, "unique", lambda posts: False)
    two = ix.build(spark, rows, str(tmp_path / "two"), settings)
    for name in ix.SCHEMAS:
        a, b = one.table(name), two.table(name)
        assert a.count() == b.count() > 0 and a.exceptAll(b).isEmpty(), name


def test_ranked(spark):
    from coplex.sources.store import ranked

    df = spark.createDataFrame([(i * 37 % 101, str(i)) for i in range(101)], "n int, name string").repartition(5)
    got = ranked(df, "place", F.desc("n"), F.col("name")).collect()
    assert {r.place for r in got} == set(range(1, 102)) and all(r.place == 101 - r.n for r in got)
    assert ranked(df.limit(0), "place", F.col("n")).isEmpty()


def test_sample_cache(spark):
    cache, made = sm.SampleCache(2), []
    for key in "abca":
        cache.get(key, lambda key=key: made.append(key) or spark.range(3))
    assert made == ["a", "b", "c", "a"] and list(cache.kept) == ["c", "a"]
    assert all(x.storageLevel.useMemory for x in cache.kept.values())
    for x in cache.kept.values():
        x.unpersist()


def test_bitmaps(spark):
    has = {p: {t for t in range(1, 6) if (p * 7 + t * t) % (t + 1) == 0} for p in (*range(0, 300), 64 * 10**9 + 63)}
    rows = spark.createDataFrame([(p, t) for p, ts in has.items() for t in ts] + [(5, 1), (5, 1)], "pid long, tid int")
    has[5].add(1)
    table = bm.words(rows).cache()
    for groups, excluded in (([[1]], ()), ([[1], [2, 3]], [4]), ([[1, 2, 3, 4, 5]], [5]), ([[1], [2], [3]], ()), ([[1], []], ()), ([[9]], [1])):
        found = bm.among(table, groups, excluded)
        want = {p for p, ts in has.items() if all(ts & set(g) for g in groups) and not ts & set(excluded)}
        assert sorted(r.pid for r in bm.pids(found).collect()) == sorted(want) and bm.size(found).first().n == len(want)
    with pytest.raises(ValueError):
        bm.among(table, [])
    baskets = spark.createDataFrame([(1, 2, 5, 0), (2, 0, 0, 2)], "pid long, rating tinyint, segment_bits int, costume_bits int")
    assert {(r.pid, r.tid) for r in bm.marks(baskets).collect()} == {(1, -3), (1, -10), (1, -12), (2, -1), (2, -51)} and bm.bits_of(5, bm.SEGMENT) == [-10, -12]


def test_sketches(spark, posts):
    df = posts.select(F.col("id").alias("pid"), F.array(F.lit(1), (F.col("id") % 3 + 2)).cast("array<smallint>").alias("items"), (F.col("id") % 4).cast("int").alias("entity"), (F.col("id") % 4).alias("rating"))
    for k in (5, 60, 500):
        table = sm.sketches(df, k).cache()
        assert table.groupBy("tid").count().filter(f"count > {k}").isEmpty()
        for cap, entity_cap in ((3, 0), (20, 2), (200, 10)):
            exact = lambda c=cap, e=entity_cap: sm.take(sm.cap_entities(df.filter("array_contains(items, 1) AND rating < 3"), e, 1), c, 1)
            found, kept = sm.from_sketch(table, 1, 199, F.col("rating") < 3, entity_cap, cap, exact, k)
            assert sorted(r.pid for r in found.select("pid").collect()) == sorted(r.pid for r in exact().collect())
            assert kept if k == 500 or cap == 3 and k == 60 else True
    many = spark.range(20_000).select(F.col("id").alias("pid"), F.expr("array(1S, smallint(id % 2 + 2))").alias("items"))
    plan = sm.sketches(many, 10)
    assert plan.count() == 30
    meant = many.select("pid", sm.order_key("pid", 1).alias("hash")).orderBy("hash", "pid").limit(10).collect()
    assert [r.pid for r in plan.filter("tid = 1").orderBy("place").collect()] == [r.pid for r in meant]
    assert "BroadcastHashJoin" in plan._jdf.queryExecution().executedPlan().toString()  # rows are cut before they are ordered
    merged = sm.sketches(df.filter("pid < 90"), 7).unionByName(sm.sketches(df.filter("pid >= 90"), 7))
    place = F.row_number().over(sm.Window.partitionBy("tid").orderBy("hash", "pid"))
    again = merged.withColumn("place", place).filter("place <= 7").select("tid", "place", "pid")
    assert again.exceptAll(sm.sketches(df, 7).select("tid", "place", "pid")).isEmpty() and again.count() == 28


def test_substrings(spark, tmp_path):
    from coplex.operators import substrings as ss

    names = ["abcabc", "bca", "a", "", "xéy日本", "aaaa", "cab", "ab_ab", "bcabca"]
    ss.grams(spark.createDataFrame([(t, i, 9) for i, t in enumerate(names)], "tag string, tid int, n long")).write.partitionBy("bucket").parquet(str(tmp_path / "g"))
    table = spark.read.parquet(str(tmp_path / "g"))
    for needle in ("a", "ab", "abc", "abca", "bcabc", "éy日本", "aaa", "aaaaa", "zz", "_"):
        assert sorted(r.tag for r in ss.containing(table, needle).collect()) == sorted(t for t in names if needle in t)
    plan = ss.containing(table, "abca")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan


def test_versions(spark, posts, tmp_path):
    from coplex.sources import index as ix

    settings = ix.Settings("2016-01-01", "base", 8, ("x",), ("one", "two"), ("base",), ("a_0",), ("a_", "b_"))
    rows, root = posts.withColumn("segment", F.lit("one")), str(tmp_path / "index")
    assert ix.versions(spark, root) == []
    rows.limit(3).write.parquet(f"{root}/0broken/rows")  # a build that broke off before its constants
    for name in ("b", "a"):
        ix.build(spark, rows, f"{root}/{name}", settings)
    assert ix.versions(spark, root) == [f"{root}/a", f"{root}/b"]


def test_anchors(spark):
    pools = spark.createDataFrame([("hair", 0, "bow"), ("deco", 1, "bow"), ("deco", 1, "ribbon")], "facet string, ord int, tag string")
    anchors = spark.createDataFrame([(1, "ribbon"), (2, "bow"), (3, "other")], "place int, tag string")
    assert {(r.facet, r.tag) for r in fx.anchors_in(anchors, pools).collect()} == {("deco", "ribbon"), ("hair", "bow")}
    assert {r.tag: r.owned for r in fx.owned_anywhere(anchors, pools).collect()} == {"ribbon": True, "bow": True, "other": False}
    with pytest.raises(ValueError):
        fx.memberships(pools.select("tag"), spark.range(10_001).select(F.lit("f").alias("facet"), F.lit(0).alias("ord"), F.lit("regex").alias("kind"), F.col("id").cast("string").alias("pattern")))


def test_edge(spark):
    from coplex.functions import edge

    rules = [replace(p, known=("k",)) if p.name == "cos" else p for p in edge.PARAMETERS]
    queries = ["exclude=+Red%20Hair,+,bow&people=7&on=[%22a%22,%22b%22]&must=0&req=x,+y&cos=k,zz&design=a,+b&charcap=0&temp=0", "people=x&on=%7B&must=1&charcap=2.9&temp=1e400&people=2", "", None, "on=3&exclude=%zz&people=&charcap=nan"]
    rows = edge.requests(spark.createDataFrame([(i, q) for i, q in enumerate(queries)], "i int, query string"), "query", rules).orderBy("i").collect()
    assert [list(r)[2:] for r in rows] == [
        [["red_hair", "bow"], 3, ["a", "b"], False, ["x", "y"], ["k"], ["a", "b"], 0, 0.1],
        [[], 1, None, True, [], [], [], 2, float("inf")],
        [[], 1, None, False, [], [], [], 100, 1.0],
        [[], 1, None, False, [], [], [], 100, 1.0],
        [[], 1, None, False, [], [], [], 100, 1.0],
    ]
    shown = edge.shown(spark.createDataFrame([(0.123456, 1.005, 2.6, 0.98765)], "conf double, lift double, k double, none_p double")).first()
    assert (shown.conf, shown.k, shown.none_p) == (0.1235, 3, 0.988)
    roll = edge.as_json(spark.createDataFrame([(1, "b"), (0, "a")], "ord int, tag string")).first().roll
    assert json.loads(roll) == [{"ord": 0, "tag": "a"}, {"ord": 1, "tag": "b"}]
