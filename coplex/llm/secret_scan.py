"""Secrets in texts: strong patterns alone, weak candidates only where complementary parts of a credential meet.

Patterns are matched inside the JVM; split() and regexp_extract_all() give the pieces around and inside the matches, whose
running lengths are their places. Strong matches are reported as they are. Weak ones (identifiers, keys without a name,
endpoints) say nothing alone: they are linked by interval joins. A scope is what stands between two blank lines; parts of
one scope that lie within REACH characters of each other are joined by (row, scope, bin), where a bin is REACH characters
wide, so a key holds REACH / 4 parts at most, however long the text or its scopes are. First identifiers and keys look for
each other, then endpoints look for what is strong or was found so. Semi joins answer this without a row per pair.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

#: Most characters between two parts of one credential.
REACH = 200
#: Elements that a running sum adds one by one before it starts another block.
BLOCK = 256
BREAK = r"\n[\x20\x09\x0D]*\n"


@dataclass(frozen=True)
class Kind:
    """What a match of pattern is. Its group of that number has `least` characters or more, and matches every one of has.
    Every match has one of the strings `signs` in it, which are quicker to look for. Company kinds mean something only beside
    others, and are looked for in texts that have any."""

    name: str
    role: str
    pattern: str
    strong: bool = False
    group: int = 0
    least: int = 1
    has: tuple[str, ...] = ()
    signs: tuple[str, ...] = ()
    company: bool = False


NAMED = r"""["']?\x20*[:=]\x20*["']?"""
KINDS: Sequence[Kind] = (
    Kind("assign", "secret", rf"(?i:(password|passwd|secret|token|api_?key)){NAMED}([A-Za-z0-9+/_.=-]+)", True, 2, 6, signs=(":", "=")),
    Kind("access", "identifier", r"AKIA[A-Z0-9]{16,}", True, signs=("AKIA",)),
    Kind("hex", "secret", r"[0-9a-f]{24,}", True),
    Kind("key", "secret", r"[A-Za-z0-9+/_-]{32,}={0,2}", has=("[0-9]", "[A-Z]", "[a-z]")),
    Kind("ident", "identifier", rf"(?i:(client_?id|user_?name|user_?id|user|login|account_?id|account|access_?key_?id)){NAMED}([A-Za-z0-9+/_.@-]+)|[A-Za-z0-9_.+-]{1,64}@[A-Za-z0-9-]+\.[A-Za-z0-9.-]*[A-Za-z0-9]", least=4, signs=("=", ":", "@"), company=True),
    Kind("endpoint", "endpoint", r"""(?i:https?|s3|ftp|sftp|jdbc|postgres|postgresql|mysql|mongodb|redis|amqp)://[^\x20\x09-\x0D"'<>]+|[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(:[0-9]{1,5})?""", signs=("://", "."), company=True),
)
PLACES = "array<struct<start: int, ord: int, end: int>>"
SPANS = "array<struct<start: int, ord: int, end: int, scope: int>>"


def running(x: Column) -> Column:
    """Running sums of an array of integers, block by block, as aggregate() copies what it has at every element."""

    def within(block: Column) -> Column:
        grown = F.aggregate(block, F.array().cast("array<bigint>"), lambda acc, v: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0).cast("bigint")) + v)))
        return F.when(F.size(block) > 0, grown).otherwise(F.array().cast("array<bigint>"))

    def joined(blocks: Column) -> Column:
        ends = within(F.transform(blocks, lambda b: F.coalesce(F.try_element_at(b, F.lit(-1)), F.lit(0).cast("bigint"))))
        return let(ends, lambda e: F.flatten(F.transform(blocks, lambda b, i: F.transform(b, lambda v: v + F.when(i > 0, F.get(e, i - 1)).otherwise(F.lit(0))))))

    places = F.sequence(F.lit(0), F.floor((F.size(x) - 1) / BLOCK).cast("int"))
    return F.when(F.size(x) > 0, let(F.transform(places, lambda i: within(F.slice(x, i * BLOCK + 1, BLOCK))), joined)).otherwise(F.array().cast("array<bigint>"))


def let(value: Column, body) -> Column:
    """body(value) with value computed once, as the element of a one-element array."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _spans(text: Column, kind: Kind, number: int) -> Column:
    """array<struct<start, ord, end>> of a kind's matches, leftmost and without overlaps; those that fail a condition go
    afterwards, so what they cover is not matched again."""
    pattern, none = F.lit(kind.pattern), F.array().cast(PLACES)
    found, judged = F.regexp_extract_all(text, pattern, F.lit(0)), F.regexp_extract_all(text, pattern, F.lit(kind.group))
    sizes = F.zip_with(F.split(text, kind.pattern, -1), found, lambda gap, m: F.struct(F.when(m.isNotNull(), F.length(gap) + F.length(m)).alias("step"), F.length(m).alias("n")))

    def placed(s: Column) -> Column:
        ends = running(F.transform(F.filter(s, lambda x: x["n"].isNotNull()), lambda x: x["step"].cast("bigint")))
        return F.zip_with(ends, F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0))), lambda e, x: F.struct((e - x["n"]).cast("int").alias("start"), F.lit(number).alias("ord"), e.cast("int").alias("end")))

    def passes(x: Column, m: Column) -> Column:
        ok = F.length(m) >= kind.least
        for p in kind.has:
            ok &= m.rlike(p)
        return F.when(ok, x)

    every = F.zip_with(let(sizes, placed), judged, passes)
    likely = text.rlike(kind.pattern)
    if kind.signs:
        some = F.lit(False)
        for sign in kind.signs:
            some |= F.contains(text, F.lit(sign))
        likely = some & likely
    return F.when(likely, F.filter(every, lambda x: x.isNotNull())).otherwise(none)


def _scoped(spans: Column, breaks: Column) -> Column:
    """Spans in order of place, each with the number of blank lines before it."""
    of = lambda x, scope: F.struct(x["start"].alias("start"), x["ord"].alias("ord"), x["end"].alias("end"), scope.cast("int").alias("scope"))

    def counted(events: Column) -> Column:
        before = running(F.transform(events, lambda x: (x["ord"] < 0).cast("bigint")))
        return let(before, lambda n: F.filter(F.transform(events, lambda x, i: of(x, F.get(n, i))), lambda x: x["ord"] >= 0))

    alone = F.transform(F.array_sort(spans), lambda x: of(x, F.lit(0)))
    return let(breaks, lambda b: F.when(F.size(b) > 0, let(F.array_sort(F.concat(spans, b)), counted)).otherwise(alone))


def matches(docs: DataFrame, kinds: Sequence[Kind] = KINDS, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(row, doc_id, spans) of every row; spans has each kind's matches by place, with ord, the kind's number, and scope."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    of = lambda company: F.concat(F.array().cast(PLACES), *(_spans(text, k, i) for i, k in enumerate(kinds) if k.company == company))
    blank = _spans(text, Kind("", "", BREAK, signs=("\n",)), -1)
    spans = let(of(False), lambda own: F.when(F.size(own) > 0, let(F.concat(own, of(True)), lambda found: _scoped(found, blank))).otherwise(F.array().cast(SPANS)))
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("doc_id"), spans.alias("spans"))


def _linked(weak: DataFrame, parts: DataFrame, reach: int) -> DataFrame:
    """The weak parts that have a part of another role, as given in their column needs, within reach in their scope.

    A bin of one row has a bounded number of parts, so no key of this join is hot, and a semi join gives no pairs."""
    bins = lambda a, b: F.sequence(F.floor(a / reach), F.floor(b / reach))
    asks = weak.withColumn("bin", F.explode(bins(F.greatest(F.col("start") - reach, F.lit(0)), F.col("end") - 1 + reach)))
    gives = parts.select(F.col("row").alias("r"), F.col("scope").alias("s"), F.col("start").alias("a"), F.col("end").alias("z"), F.col("role").alias("has"), F.explode(bins(F.col("start"), F.col("end") - 1)).alias("b"))
    near = (F.col("a") <= F.col("end") + reach) & (F.col("start") <= F.col("z") + reach) & ((F.col("a") >= F.col("end")) | (F.col("start") >= F.col("z")))
    same = (F.col("row") == F.col("r")) & (F.col("scope") == F.col("s")) & (F.col("bin") == F.col("b"))
    found = asks.join(gives, same & near & F.array_contains("needs", F.col("has")), "left_semi")
    return found.drop("bin", "needs").distinct()


def scan_secrets(docs: DataFrame, kinds: Sequence[Kind] = KINDS, text_col: str = "text", id_col: str = "doc_id", reach: int = REACH) -> DataFrame:
    """Per row of docs: its id, and spans array<struct<start, ord, end, linked>> in order of place and kind; start and end are
    code points, end exclusive, ord is the kind's number, linked marks weak parts, which are reported for their company.

    Whole texts are scanned. A null or empty text has no spans; repeated rows are scanned each, as rows are told apart by
    their place and not by their id, which may be null; other columns are not read. An empty table gives an empty result."""
    rows = staged(matches(docs, kinds, text_col, id_col), "secret-parts")  # without texts
    role = F.element_at(F.array(*(F.lit(k.role) for k in kinds)), F.col("x.ord") + 1)
    several = F.size(F.array_distinct(F.transform("spans", lambda x: x["ord"]))) > 1
    some_weak = F.exists("spans", lambda x: x["ord"].isin([i for i, k in enumerate(kinds) if not k.strong]))
    parts = rows.filter(several & some_weak).select("row", F.explode("spans").alias("x")).select("row", "x.*", role.alias("role"))
    parts = parts.withColumn("strong", F.col("ord").isin([i for i, k in enumerate(kinds) if k.strong]))
    needs = lambda *roles: F.array(*map(F.lit, roles))
    pairs = F.when(F.col("role") == "identifier", needs("secret")).otherwise(needs("identifier"))
    one = staged(_linked(parts.filter("NOT strong AND role <> 'endpoint'").withColumn("needs", pairs), parts, reach), "secret-links")
    sure = parts.filter("strong").unionByName(one)
    two = _linked(parts.filter("role = 'endpoint'").withColumn("needs", needs("identifier", "secret")), sure, reach)
    more = one.unionByName(two).groupBy("row").agg(F.collect_list(F.struct("start", "ord", "end", F.lit(True).alias("linked"))).alias("more"))
    strong = F.transform(F.filter("spans", lambda x: x["ord"].isin([i for i, k in enumerate(kinds) if k.strong])), lambda x: F.struct(x["start"].alias("start"), x["ord"].alias("ord"), x["end"].alias("end"), F.lit(False).alias("linked")))
    joined = rows.join(more, "row", "left")
    return joined.select(F.col("doc_id").alias(id_col), F.when(F.col("more").isNull(), strong).otherwise(F.array_sort(F.concat(strong, "more"))).alias("spans"))


def secret_digests(scanned: DataFrame, kinds: Sequence[Kind] = KINDS) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked of what scan_secrets() gives."""
    names = F.array(*(F.lit(k.name) for k in kinds))
    said = lambda x: F.concat_ws(":", F.element_at(names, x["ord"] + 1), x["start"].cast("string"), x["end"].cast("string"))
    base = F.filter("spans", lambda x: ~x["linked"])
    count = lambda i: F.size(F.filter("spans", lambda x: x["ord"] == i)).cast("long")
    strong = [count(i).alias(f"n_{k.name}") for i, k in enumerate(kinds) if k.strong]
    return scanned.select(
        "doc_id", *strong, F.sha2(F.array_join(F.transform(base, said), ","), 256).alias("base_sha256"), F.array_join(F.transform("spans", said), ",").alias("spans"), F.size(F.filter("spans", lambda x: x["linked"])).cast("long").alias("n_linked"),
    )
