"""Oracle SQL of the registered queries, for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

POST = """
post AS (
    SELECT o_orderkey AS id, o_orderdate AS created_at, c_mktsegment AS segment, r_name AS region,
           CASE left(o_orderpriority, 1) WHEN '1' THEN 'g' WHEN '2' THEN 's' WHEN '3' THEN 'q' ELSE 'e' END AS rating,
           CASE WHEN o_custkey % 3 = 0 THEN 0 ELSE o_custkey % 50 + 1 END AS grp
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
line AS (
    SELECT l_orderkey AS pid, unnest(['brand:' || p_brand, 'type:' || p_type, 'adj:' || split_part(p_name, ' ', 1), 'noun:' || split_part(p_name, ' ', 2),
           'flag:' || l_returnflag, 'line:' || l_linestatus, CASE WHEN l_returnflag = 'R' THEN 'ret:' || l_linestatus END, CASE WHEN l_discount >= 0.09 THEN 'hid:y' END]) AS tag
    FROM lineitem JOIN part ON l_partkey = p_partkey),
inc AS (SELECT DISTINCT pid, tag, rating FROM line JOIN post ON pid = id WHERE tag IS NOT NULL)"""

INDEX = POST + """,
dict AS (SELECT tag, row_number() OVER (ORDER BY count(*) DESC, tag) AS tid, count(*) AS n FROM inc GROUP BY tag),
red AS (
    SELECT pid, tag, tid, rating FROM inc JOIN dict USING (tag)
    WHERE tid <= 110 AND pid >= (SELECT min(id) FROM post WHERE created_at >= TIMESTAMP '1996-01-01') AND pid IN (SELECT pid FROM inc WHERE tag = 'line:O')),
ent AS (SELECT id AS pid, CASE WHEN grp = 0 THEN 0 ELSE dense_rank() OVER (PARTITION BY grp = 0 ORDER BY grp) END AS entity FROM post),
bask AS (
    SELECT red.pid, list(tag) AS tags, string_agg(tid::VARCHAR, ',' ORDER BY tid) AS items, count(*) AS n_items,
           CASE any_value(red.rating) WHEN 'g' THEN 0 WHEN 's' THEN 1 WHEN 'q' THEN 2 ELSE 3 END AS rating, any_value(entity) AS entity,
           any_value(CASE region WHEN 'AFRICA' THEN 1 WHEN 'AMERICA' THEN 2 WHEN 'ASIA' THEN 4 WHEN 'EUROPE' THEN 8 ELSE 16 END) AS segment_bits,
           any_value(CASE segment WHEN 'AUTOMOBILE' THEN 1 WHEN 'BUILDING' THEN 2 WHEN 'FURNITURE' THEN 4 WHEN 'HOUSEHOLD' THEN 8 ELSE 16 END) AS costume_bits
    FROM red JOIN ent USING (pid) JOIN post ON id = red.pid GROUP BY red.pid)"""

#: Baskets of the wide sample: without one brand, 100 per entity, 50,000 in all.
WIDE = INDEX + """,
capped AS (
    SELECT *, row_number() OVER (PARTITION BY entity ORDER BY md5(pid::VARCHAR || '#1'), pid) AS rn
    FROM bask WHERE NOT list_contains(tags, 'brand:Brand#11')),
wide AS (SELECT * EXCLUDE rn FROM capped WHERE entity = 0 OR rn <= 100 ORDER BY md5(pid::VARCHAR || '#1'), pid LIMIT 50000)"""


def ladder_sql(name: str, sample: str, hits: list[str]) -> str:
    """Scores, levels, weights and coefficients of a query over a sample (a common table of baskets)."""
    masks = ", ".join(f"({h})::INT AS h{i}" for i, h in enumerate(hits))
    idf = ", ".join(f"CAST(round(1000 * ln(count(*) / greatest(sum(h{i}), 0.5))) AS INT) AS i{i}" for i in range(len(hits)))
    score = " + ".join(f"h{i} * greatest(i{i}, 0)" for i in range(len(hits)))
    return f""",
{name}_hit AS (SELECT *, {masks} FROM {sample}),
{name}_idf AS (SELECT {idf} FROM {name}_hit),
{name}_score AS (SELECT h.*, {score} AS score FROM {name}_hit h, {name}_idf),
{name}_tier AS (SELECT score, count(*) AS n, CAST(sum(count(*)) OVER (ORDER BY score DESC) AS BIGINT) AS size FROM {name}_score GROUP BY score),
{name}_size AS (
    SELECT DISTINCT coalesce(min(CASE WHEN size >= least_size THEN size END), max(size)) AS size
    FROM {name}_tier, (VALUES (1), (30), (100), (300), (900), (3000)) v(least_size) GROUP BY least_size),
{name}_level AS (SELECT row_number() OVER (ORDER BY size) - 1 AS level, score AS cut, size FROM {name}_size JOIN {name}_tier USING (size)),
{name}_exp AS (SELECT s.*, level, size, count(*) OVER (PARTITION BY level, entity) AS c FROM {name}_score s JOIN {name}_level ON score >= cut),
{name}_w AS (SELECT *, CASE WHEN entity = 0 THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, greatest(6.0::DOUBLE, 0.02::DOUBLE * size) / c) END AS w FROM {name}_exp),
{name}_n AS (SELECT level, any_value(size) AS size, sum(w) AS n FROM {name}_w GROUP BY level),
{name}_kept AS (SELECT * FROM (SELECT *, coalesce(max(n) OVER (ORDER BY level ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM {name}_n) WHERE before < 3000),
{name}_c AS (
    SELECT level, n, exp(coalesce(sum(ln(300 / (n + 300))) OVER (ORDER BY level ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS passed, level = max(level) OVER () AS last
    FROM {name}_kept)"""


ITEMS = ["list_contains(tags, 'type:ECONOMY')", "list_contains(tags, 'flag:R')", "NOT list_has_any(tags, ['ret:O', 'ret:F', 'hid:y'])"]
FLAGSHIP = WIDE + ladder_sql("q", "wide", ITEMS)
BRANDS = "(SELECT tag, tid, n FROM dict WHERE starts_with(tag, 'brand:') AND tid <= 110)"
LADDER = FLAGSHIP + f""",
lad AS (
    SELECT tag, sum(CASE WHEN level = 0 THEN w ELSE 0 END) AS k_top, sum(w * passed / CASE WHEN last THEN n ELSE n + 300 END) AS p
    FROM (SELECT level, w, unnest(tags) AS tag FROM q_w) JOIN q_c USING (level) WHERE tag IN (SELECT tag FROM {BRANDS}) GROUP BY tag)"""


def any_sql(name: str, hit: str, counted: str, query: str = "q") -> str:
    """One row p: the any-of ladder of a predicate, on its own counts."""
    return f""",
{name}_n AS (SELECT level, sum(CASE WHEN ({hit}) AND ({counted}) THEN w ELSE 0 END) AS a, sum(CASE WHEN {counted} THEN w ELSE 0 END) AS n FROM {query}_w GROUP BY level),
{name}_k AS (SELECT * FROM (SELECT *, coalesce(max(n) OVER (ORDER BY level ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM {name}_n) WHERE before < 3000),
{name} AS (
    SELECT sum(a * passed / CASE WHEN last THEN n ELSE n + 300 END) AS p FROM (
        SELECT level, a, n, exp(coalesce(sum(ln(300 / (n + 300))) OVER (ORDER BY level ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS passed, level = max(level) OVER () AS last
        FROM {name}_k))"""


def _blocks(text: str, where: str) -> str:
    """Blocks of 512 bytes of documents' texts with their digests."""
    return f"""SELECT name, octet_length(data) AS size, block, block * 512 AS start, least(512, octet_length(data) - block * 512) AS length, sha256(array_slice(data, block * 512 + 1, block * 512 + 512)) AS sha256
            FROM (SELECT name, data, unnest(range(greatest(1, (octet_length(data) + 511) // 512))) AS block FROM (SELECT doc_id::VARCHAR AS name, encode(coalesce({text}, '')) AS data FROM documents {where}))"""


_FACETS = {"brand:Brand#1": "b", "hid:": "h", "adj:r": "r"}
_ANY = "".join(
    any_sql(f"{v}_well", f"len(list_filter(tags, lambda x: starts_with(x, '{k}'))) > 0", "n_items >= 12")
    + any_sql(f"{v}_abs", f"len(list_filter(tags, lambda x: starts_with(x, '{k}'))) > 0", f"len(list_filter(tags, lambda x: starts_with(x, '{k}') OR x = 'flag:A')) > 0")
    for k, v in _FACETS.items()
)

SOLO = INDEX + """,
solo AS (SELECT pid FROM red WHERE tag = 'line:O' EXCEPT SELECT pid FROM red WHERE tag = 'brand:Brand#11'),
inside AS (SELECT pid, tag FROM red WHERE (starts_with(tag, 'brand:') OR starts_with(tag, 'type:')) AND pid IN (SELECT pid FROM solo)),
single AS (SELECT tag, count(*) AS n FROM inside GROUP BY tag),
pair AS (SELECT a.tag AS tag_a, b.tag AS tag_b, count(*) AS n_ab FROM inside a JOIN inside b ON a.pid = b.pid AND a.tag < b.tag GROUP BY ALL)"""

LIFT = """,
small AS (SELECT * FROM wide WHERE list_contains(tags, 'hid:y')),
rate AS (SELECT tag, n / (SELECT count(*) FROM post) AS pb FROM {brands}),
lift AS (
    SELECT rate.tag, least(4.0, greatest(0.25, ((coalesce(c, 0) + 300 * pb) / ((SELECT count(*) FROM {sample}) + 300)) / pb)) AS lift
    FROM rate LEFT JOIN (SELECT tag, count(*) AS c FROM (SELECT unnest(tags) AS tag FROM {sample}) GROUP BY tag) USING (tag))"""

RULES = "('brand', 0, '^brand:'), ('type', 1, '^type:'), ('adj', 2, '^adj:'), ('noun', 3, '^noun:'), ('flag', 4, '^flag:[A-Z]$'), ('ret', 5, '^ret:[OF]$'), ('hid', 6, 'id:y$'), ('line', 7, '^line:'), ('letter', 8, '^(flag|line|ret):[A-Z]$'), ('hidden', 9, '(^|_)hid:y(_|$)'), ('returned', 10, '(^|_)flag:R$')"

UNIFORM = "((('0x' || substr(md5({0}), 1, 12))::BIGINT + 0.5) / 281474976710656.0)"

#: What rolls ask: the sample of an anchor, and pair lifts over brands, types and adjectives.
ROLL = WIDE + """,
anchored AS (
    SELECT *, row_number() OVER (PARTITION BY entity ORDER BY md5(pid::VARCHAR || '#1'), pid) AS rn FROM bask WHERE list_contains(tags, 'type:ECONOMY')),
econ AS (SELECT * EXCLUDE rn FROM anchored WHERE entity = 0 OR rn <= 100 ORDER BY md5(pid::VARCHAR || '#1'), pid LIMIT 50000),
solo AS (SELECT pid FROM red WHERE tag = 'line:O' EXCEPT SELECT pid FROM red WHERE tag = 'brand:Brand#11'),
inside AS (SELECT pid, tag FROM red WHERE split_part(tag, ':', 1) IN ('brand', 'type', 'adj') AND pid IN (SELECT pid FROM solo)),
single AS (SELECT tag, count(*) AS n FROM inside GROUP BY tag),
pair AS (SELECT a.tag AS a, b.tag AS b, count(*) AS n FROM inside a JOIN inside b ON a.pid = b.pid AND a.tag <> b.tag GROUP BY ALL)"""


class RollSql:
    """The SQL of a roll: one block of common tables per question, one row per draw. prior: table of baskets to smooth with,
    which the SQL of a roll always does or never. rates: table of base rates (tag, n)."""

    def __init__(self, seed: int, prior: str = "", rates: str = "dict", total: str = "(SELECT count(*) FROM post)", temperature: float = 1.0, lift: str = ""):
        self.lift = lift
        self.seed, self.prior, self.rates, self.total, self.temperature = seed, prior, rates, total, temperature
        self.parts, self.rows = [], []

    def row(self, place: int, facet: str, status: str, tag: str = "NULL") -> None:
        self.rows.append(f"SELECT {place} AS ord, '{facet}' AS facet, 0 AS draw, '{status}' AS status, {tag} AS tag, NULL::DOUBLE AS conf, NULL::DOUBLE AS lift, NULL::INT AS k, NULL::INT AS n, NULL::DOUBLE AS none_p, NULL::INT AS n_tiers")

    def ask(self, name: str, hits: list[str], pool: str, gone: list[str], picked: list[str], top: int | None = 12, whole: bool = False, absent: str = "", adjust: bool = True, required: bool = False, sample: str = "econ", removed: str = "") -> None:
        """pool, removed: conditions on tag. gone: items as literals. picked: tables with a tag, or literals."""
        out = [f"(SELECT tag FROM {x})" if x.endswith("_pick") else x for x in picked]
        outside = "".join(f" AND tag IS DISTINCT FROM {x}" for x in [*gone, *out]) + (f" AND NOT ({removed})" if removed else "")
        known = f"list_has_any(tags, (SELECT list(tag) FROM {name}_pool))"
        counted = f"({known} OR list_has_any(tags, {absent}))" if absent else "n_items >= 12"
        last = "n" if not self.prior else "n + 300"
        own = f"""
    SELECT tag, sum(CASE WHEN level = 0 THEN w ELSE 0 END) AS k_top, sum(w * passed / CASE WHEN last THEN {last} ELSE n + 300 END) AS p
    FROM (SELECT level, w, unnest(tags) AS tag FROM {name}_w) JOIN {name}_c USING (level) GROUP BY tag"""
        base = rest = ""
        if self.prior:
            base = ladder_sql(f"{name}z", self.prior, hits or ["false"]) + f""",
{name}z_lad AS (
    SELECT tag, sum(w * passed / CASE WHEN last THEN n ELSE n + 300 END) AS p
    FROM (SELECT level, w, unnest(tags) AS tag FROM {name}z_w) JOIN {name}z_c USING (level) GROUP BY tag)"""
            rest = f"(SELECT min(passed * 300 / (n + 300)) FROM {name}_c)"
            wide, lifts = ("least(1.0, coalesce(z.p, 0) * coalesce(lift, 1))", f" LEFT JOIN {self.lift} USING (tag)") if self.lift else ("coalesce(z.p, 0)", "")
            own = f"SELECT tag, coalesce(k_top, 0) AS k_top, coalesce(o.p, 0) + {wide} * {rest} AS p FROM ({own}) o FULL JOIN {name}z_lad z USING (tag){lifts}"
        smoothed = (any_sql(f"{name}z_any", known, counted, f"{name}z") if self.prior else "") + any_sql(f"{name}_any", known, counted, name)
        chance = "coalesce(p, 0)"
        if self.prior:
            smoothed += f""",
{name}_own AS (SELECT sum(a * passed / (n + 300)) AS a, min(passed * 300 / (n + 300)) AS rest FROM (
    SELECT level, a, n, exp(coalesce(sum(ln(300 / (n + 300))) OVER (ORDER BY level ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS passed FROM {name}_any_k))"""
            chance = f"(SELECT o.a + o.rest * coalesce(z.p, 0) FROM {name}_own o, {name}z_any z)"
        self.parts.append(ladder_sql(name, sample, hits or ["false"]) + base + f""",
{name}_lad AS ({own}),
{name}_raw AS (
    SELECT tag, tid, p AS conf, p / ({self.rates}.n / {self.total}) AS lift, k_top, row_number() OVER (ORDER BY round(p, 12) DESC, tid) AS rk
    FROM {name}_lad JOIN {"dict" if self.rates == "dict" else f"dict USING (tag) JOIN {self.rates}"} USING (tag) WHERE ({pool}) AND tid <= 110 AND p > 0{outside} {f"QUALIFY rk <= {top}" if top else ""}),
{name}_pool AS (SELECT tag FROM {f"dict WHERE ({pool}) AND tid <= 110" if whole else f"{name}_raw"})""" + smoothed + f""",
{name}_none AS (SELECT CASE WHEN (SELECT count(*) FROM {name}_pool) = 0 THEN 1.0 ELSE greatest(0.05, 1 - {chance}) END AS p FROM {name}_any)""")
        factor = "1.0"
        if adjust and picked:
            lifts = [f"coalesce((SELECT CASE WHEN x.n >= 100 THEN (coalesce((SELECT n FROM pair WHERE a = {x} AND b = r.tag), 0) / x.n) / (y.n / (SELECT count(*) FROM solo)) END FROM single x, single y WHERE x.tag = {x} AND y.tag = r.tag), 1)" for x in out]
            factor = f"least(20.0, greatest(0.02, {' * '.join(lifts)}))"
        none_p = "n.p" if required or not (adjust and picked) else "least(0.995, 1 - (1 - n.p) * least(1.0, s.after / s.before))"
        self.parts.append(f""",
{name}_cand AS (SELECT r.*, r.conf * {factor} AS adjusted FROM {name}_raw r),
{name}_p AS (SELECT CASE WHEN s.before IS NULL THEN n.p ELSE {none_p} END AS none_p, s.after FROM {name}_none n, (SELECT sum(conf) AS before, sum(adjusted) AS after FROM {name}_cand) s),
{name}_wt AS (
    SELECT tag, rk, pow({"adjusted" if required else "adjusted * (1 - none_p) / greatest(after, 1e-9)"}, {1 / self.temperature}::DOUBLE) AS wt FROM {name}_cand, {name}_p
    {"" if required else f"UNION ALL SELECT NULL, 1000000, pow(none_p, {1 / self.temperature}::DOUBLE) FROM {name}_p"})""")

    def draw(self, place: int, facet: str, name: str, number: int = 0, required: bool = False, status: str = "drawn", shown: str = "", none_p: str = "", only: str = "true") -> str:
        """A draw of the question, without what earlier draws of it took; gives its table. shown: question whose figures the
        row has."""
        before = "".join(f" AND tag IS DISTINCT FROM (SELECT tag FROM {name}{i}_pick)" if i >= 0 else "" for i in range(number)) if number else ""
        u = UNIFORM.format(f"'{self.seed}#{facet}#{number}'")
        self.parts.append(f""",
{name}{number}_pick AS (
    SELECT tag FROM (SELECT tag, rk, wt, sum(wt) OVER (ORDER BY rk) AS run, sum(wt) OVER () AS total FROM {name}_wt WHERE (tag IS NULL OR true{before}) AND {only})
    WHERE run >= {u} * total AND wt > 0 ORDER BY rk LIMIT 1)""")
        self.show(place, facet, f"{name}{number}_pick", shown or name, number, status, none_p or ("NULL::DOUBLE" if required else f"(SELECT none_p FROM {shown or name}_p)"))
        return f"{name}{number}_pick"

    def show(self, place: int, facet: str, pick: str, name: str, number: int, status: str, none_p: str) -> None:
        some = f" WHERE (SELECT tag FROM {pick}) IS NOT NULL" if number else ""
        self.rows.append(f"""SELECT {place}, '{facet}', {number}, '{status}', t.tag, round(c.adjusted, 4), round(c.lift, 2), round(c.k_top)::INT, (SELECT round(n)::INT FROM {name}_n WHERE level = 0), round({none_p}, 3), (SELECT count(*)::INT FROM {name}_tier)
            FROM (SELECT (SELECT tag FROM {pick}) AS tag) t LEFT JOIN {name}_cand c ON c.tag = t.tag{some}""")

    def sql(self) -> str:
        columns = "ord, facet, draw, status, tag, conf, lift, k, n, none_p, n_tiers"
        return "WITH " + ROLL + "".join(self.parts) + f" SELECT * FROM ({' UNION ALL '.join(self.rows)}) AS rolled({columns})"


def _carries(pick: str) -> str:
    return f"coalesce(list_contains(tags, (SELECT tag FROM {pick})), false)"


def _pose(seed: int = 11, act: bool = False) -> str:
    r, base, anchor = RollSql(seed, **(_given_act() if act else {})), ["list_contains(tags, 'flag:R')"], ["'type:ECONOMY'"]
    r.parts += [ACTED] * act
    sample = "acted" if act else "econ"
    r.ask("pb", base, "starts_with(tag, 'brand:')", anchor, [], sample=sample)
    brand = r.draw(0, "brand", "pb")
    r.ask("pa", [*base, _carries(brand)], "starts_with(tag, 'adj:')", anchor, [brand], required=True, sample=sample)
    adj = r.draw(1, "adj", "pa", required=True)
    r.ask("ph", [*base, _carries(brand), _carries(adj)], "starts_with(tag, 'hid:')", anchor, [brand, adj], sample=sample)
    r.draw(2, "hid", "ph")
    r.row(3, "type", "anchor", "'type:ECONOMY'")
    return r.sql()


def _expression(seed: int = 11, act: bool = False) -> str:
    r, base, anchor = RollSql(seed, **(_given_act() if act else {})), ["list_contains(tags, 'flag:R')"], ["'type:ECONOMY'"]
    r.parts += [ACTED] * act
    sample = "acted" if act else "econ"
    r.ask("xa", base, "starts_with(tag, 'adj:')", anchor, [], top=None, sample=sample)
    adj = [r.draw(0, "adj", "xa")]
    adj.append(r.draw(0, "adj", "xa", 1, only=f"(SELECT tag FROM {adj[0]}) IS NOT NULL"))
    r.ask("xb", [*base, *map(_carries, adj)], "starts_with(tag, 'brand:')", anchor, adj, top=None, sample=sample)
    brand = [r.draw(1, "brand", "xb")]
    brand.append(r.draw(1, "brand", "xb", 1, only=f"(SELECT tag FROM {brand[0]}) IS NOT NULL"))
    r.ask("xh", [*base, *map(_carries, adj + brand)], "starts_with(tag, 'hid:')", anchor, adj + brand, top=None, sample=sample)
    r.draw(2, "hid", "xh")
    return r.sql()


def _design(seed: int = 11, segment: bool = False) -> str:
    r, bare, anchors = RollSql(seed, "aswide" if segment else "", lift="alift" if segment else ""), "list_contains(tags, 'hid:y')", ["'type:ECONOMY'", "'line:O'"]
    whole = {"whole": True, "adjust": False, "sample": "asecon" if segment else "econ"}
    r.parts += [SEGMENTED] * segment
    r.row(-1, "anchor_extra", "anchor", "'line:O'")
    r.ask("db", [bare], "starts_with(tag, 'brand:')", [*anchors, "'adj:red'"], [], required=True, **whole)
    brand = r.draw(0, "brand", "db", required=True)
    r.row(1, "type", "anchor", "'type:ECONOMY'")
    r.ask("dh", [bare, _carries(brand)], "starts_with(tag, 'hid:')", anchors, [brand], **whole)
    hid = r.draw(2, "hid", "dh")
    r.row(3, "flag", "off")
    r.row(4, "ret", "off")
    hits = [bare, _carries(brand), _carries(hid), f"(SELECT tag FROM {hid}) IS NULL AND NOT list_contains(tags, 'hid:y')"]
    r.ask("da", hits, "starts_with(tag, 'adj:')", [*anchors, "'adj:red'"], [brand, hid], absent="(SELECT list(tag) FROM dict WHERE starts_with(tag, 'flag:A'))", **whole)
    adj = r.draw(5, "adj", "da")
    r.ask("dn", [*hits, _carries(adj)], "starts_with(tag, 'noun:')", anchors, [brand, hid, adj], **whole)
    r.parts.append(", dn9_pick AS (SELECT NULL::VARCHAR AS tag)")
    r.show(6, "noun", "dn9_pick", "dn", 0, "fixed", "(SELECT none_p FROM dn_p)")
    return r.sql()


def _scene() -> str:
    r, base, anchor = RollSql(11), ["list_contains(tags, 'flag:R')"], ["'type:ECONOMY'"]
    r.ask("sf", [], "starts_with(tag, 'noun:')", [], [], whole=True, adjust=False, sample="wide")
    frame = r.draw(0, "noun", "sf")
    adj, least = "starts_with(tag, 'adj:')", "tag = (SELECT min_by(tag, tid) FROM dict WHERE starts_with(tag, 'adj:'))"
    r.ask("s1", [*base, _carries(frame)], adj, anchor, [frame], whole=True, adjust=False, removed=least)
    one = r.draw(1, "adj", "s1")
    r.ask("s2", [*base, _carries(frame), _carries(one)], adj, anchor, [frame, one], whole=True, adjust=False, removed=least)
    r.parts.append(f""",
s2_rest AS (SELECT list(tag) AS t FROM dict WHERE starts_with(tag, 'adj:') AND tid <= 110 AND tag IS DISTINCT FROM (SELECT tag FROM {one})),
s3_p AS (
    SELECT CASE WHEN (SELECT count(*) FROM s2_cand) = 0 THEN 1.0 ELSE greatest(0.05, 1 - coalesce(avg(list_has_any(tags, (SELECT t FROM s2_rest))::INT), 0)) END AS none_p, (SELECT sum(adjusted) FROM s2_cand) AS after
    FROM econ WHERE n_items >= 12 AND list_contains(tags, (SELECT tag FROM {one}))),
s3_wt AS (SELECT tag, rk, adjusted * (1 - none_p) / greatest(after, 1e-9) AS wt FROM s2_cand, s3_p UNION ALL SELECT NULL, 1000000, none_p FROM s3_p),
s30_pick AS (SELECT NULL::VARCHAR AS tag)""")
    two = r.draw(1, "adj", "s3", 1, shown="s1", only=f"(SELECT tag FROM {one}) IS NOT NULL")
    r.parts.append(f""",
solid AS (SELECT tag FROM (SELECT tag, row_number() OVER (ORDER BY tid) AS i FROM dict WHERE starts_with(tag, 'adj:') AND tid <= 110) WHERE i % 2 = 1),
s9_pick AS (SELECT CASE WHEN (SELECT tag FROM {one}) IN (SELECT tag FROM solid) OR (SELECT tag FROM {two}) IN (SELECT tag FROM solid) THEN 'hid:y' END AS tag)""")
    r.row(1, "adj_umbrella", "added", "'hid:y'")
    r.rows[-1] += " WHERE (SELECT tag FROM s9_pick) IS NOT NULL"
    picked = [frame, "s9_pick", one, two]
    r.ask("sp", [*base, *map(_carries, picked)], "starts_with(tag, 'flag:')", [], picked)
    place = r.draw(2, "ret", "sp")
    picked.append(place)
    r.ask("sb", [*base, *map(_carries, picked)], "starts_with(tag, 'brand:')", anchor, picked)
    r.draw(3, "brand", "sb")
    return r.sql()


def _adult(seed: int = 11) -> str:
    """The sample of an act is small on small tables, so every question has a prior."""
    r = RollSql(seed, "every", "rate_e", "(SELECT count(*) FROM post WHERE rating = 'e')", 0.8)
    r.parts.append(f""",
rate_e AS (SELECT tag, count(*) AS n FROM inc WHERE rating = 'e' GROUP BY tag),
acts AS (SELECT tag, n, row_number() OVER (ORDER BY n DESC, tag) AS rk FROM rate_e WHERE starts_with(tag, 'type:')),
act_pick AS (
    SELECT tag FROM (SELECT tag, rk, sum(pow(n::DOUBLE, 1.25::DOUBLE)) OVER (ORDER BY rk) AS run, sum(pow(n::DOUBLE, 1.25::DOUBLE)) OVER () AS total FROM acts)
    WHERE run >= {UNIFORM.format(f"'{seed}#act#0'")} * total ORDER BY rk LIMIT 1),
every AS (SELECT * FROM bask WHERE rating = 3 ORDER BY md5(pid::VARCHAR || '#1'), pid LIMIT 50000),
acted AS (SELECT * FROM bask WHERE rating = 3 AND list_contains(tags, (SELECT tag FROM act_pick)) ORDER BY md5(pid::VARCHAR || '#1'), pid LIMIT 50000),
hat AS (SELECT min_by(tag, tid) AS tag FROM dict WHERE starts_with(tag, 'adj:')),
shoe AS (SELECT min_by(tag, tid) AS tag FROM dict WHERE starts_with(tag, 'noun:'))""")
    r.row(0, "act", "drawn", "(SELECT tag FROM act_pick)")
    base, gone = [_carries("hat"), _carries("shoe")], ["(SELECT tag FROM act_pick)"]
    r.ask("ab", base, "starts_with(tag, 'brand:')", gone, [], adjust=False, sample="acted")
    one = r.draw(1, "brand", "ab")
    two = r.draw(1, "brand", "ab", 1, only=f"tag IS NOT NULL AND (SELECT tag FROM {one}) IS NOT NULL")
    r.ask("ah", [*base, _carries(one), _carries(two)], "starts_with(tag, 'hid:')", gone, [one, two], adjust=False, sample="acted")
    hid = r.draw(2, "hid", "ah")
    r.ask("af", [*base, _carries(one), _carries(two), _carries(hid)], "starts_with(tag, 'flag:')", gone, [one, two, hid], adjust=False, sample="acted")
    r.draw(3, "flag", "af")
    r.row(4, "adj", "kept", "(SELECT tag FROM hat)")
    r.rows.append(f"SELECT 4, 'noun', 0, CASE WHEN (SELECT tag FROM {one}) IS NULL THEN 'kept' ELSE 'stripped' END, (SELECT tag FROM shoe), NULL::DOUBLE, NULL::DOUBLE, NULL::INT, NULL::INT, NULL::DOUBLE, NULL::INT")
    return r.sql()


def _chain() -> str:
    r, anchor, whole = RollSql(11), ["'type:ECONOMY'"], {"whole": True, "adjust": False}
    r.row(-1, "anchor_extra", "anchor", "'type:ECONOMY'")
    r.ask("cb", [], "starts_with(tag, 'brand:')", anchor, [], **whole)
    brand = r.draw(0, "brand", "cb")
    r.ask("ca", [_carries(brand)], "starts_with(tag, 'adj:')", anchor, [brand], **whole)
    design = [brand, r.draw(1, "adj", "ca")]
    r.ask("cn", [*map(_carries, design)], "starts_with(tag, 'noun:')", anchor, [])
    noun = r.draw(100, "noun", "cn")
    r.ask("ch", [*map(_carries, [*design, noun])], "starts_with(tag, 'hid:')", anchor, [noun])
    pose = [noun, r.draw(101, "hid", "ch")]
    r.ask("cf", [*map(_carries, design + pose)], "starts_with(tag, 'flag:')", anchor, [], top=None)
    flag = r.draw(200, "flag", "cf")
    r.draw(200, "flag", "cf", 1, only=f"(SELECT tag FROM {flag}) IS NOT NULL")
    return f"SELECT ord // 100 AS number, CASE ord // 100 WHEN 0 THEN 'design' WHEN 1 THEN 'pose' ELSE 'expression' END AS module, * REPLACE (ord % 100 AS ord) FROM ({r.sql()})"


ACTED = """,
rate_e AS (SELECT tag, count(*) AS n FROM inc WHERE rating = 'e' GROUP BY tag),
every AS (SELECT * FROM bask WHERE rating = 3 ORDER BY md5(pid::VARCHAR || '#1'), pid LIMIT 50000),
acted AS (SELECT * FROM bask WHERE rating = 3 AND list_contains(tags, 'type:ECONOMY') ORDER BY md5(pid::VARCHAR || '#1'), pid LIMIT 50000)"""


#: The same samples within one region, and the lifts of the anchor's sample.
SEGMENTED = """,
ascap AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY md5(pid::VARCHAR || '#1'), pid) AS rn FROM bask WHERE segment_bits & 4 <> 0 AND NOT list_contains(tags, 'brand:Brand#11')),
aswide AS (SELECT * EXCLUDE rn FROM ascap WHERE entity = 0 OR rn <= 100 ORDER BY md5(pid::VARCHAR || '#1'), pid LIMIT 50000),
aecap AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY md5(pid::VARCHAR || '#1'), pid) AS rn FROM bask WHERE segment_bits & 4 <> 0 AND list_contains(tags, 'type:ECONOMY')),
asecon AS (SELECT * EXCLUDE rn FROM aecap WHERE entity = 0 OR rn <= 100 ORDER BY md5(pid::VARCHAR || '#1'), pid LIMIT 50000),
alift AS (
    SELECT tag, least(4.0, greatest(0.25, ((coalesce(c, 0) + 300 * pb) / ((SELECT count(*) FROM econ) + 300)) / pb)) AS lift
    FROM (SELECT tag, n / (SELECT count(*) FROM post) AS pb FROM dict) LEFT JOIN (SELECT tag, count(*) AS c FROM (SELECT unnest(tags) AS tag FROM econ) GROUP BY tag) USING (tag))"""


def _given_act() -> dict:
    return {"prior": "every", "rates": "rate_e", "total": "(SELECT count(*) FROM post WHERE rating = 'e')"}


def _seeds(roll: Callable[[int], str]) -> str:
    return " UNION ALL ".join(f"SELECT {s}::BIGINT AS seed, * FROM ({roll(s)})" for s in (11, 12, 13))


#: The ladder of every type over the wide sample: what ladder_sql() makes, by type.
BATCH = WIDE + """,
given AS (SELECT tag AS g FROM dict WHERE starts_with(tag, 'type:') AND tid <= 110),
hit AS (
    SELECT g, wide.*, list_contains(tags, g)::INT AS h0, list_contains(tags, 'flag:R')::INT AS h1, (NOT list_has_any(tags, ['ret:O', 'ret:F', 'hid:y']))::INT AS h2 FROM wide, given),
idf AS (SELECT g, """ + ", ".join(f"greatest(0, CAST(round(1000 * ln(count(*) / greatest(sum(h{i}), 0.5))) AS INT)) AS i{i}" for i in range(3)) + """ FROM hit GROUP BY g),
scored AS (SELECT hit.*, h0 * i0 + h1 * i1 + h2 * i2 AS score FROM hit JOIN idf USING (g)),
tier AS (SELECT g, score, CAST(sum(count(*)) OVER (PARTITION BY g ORDER BY score DESC) AS BIGINT) AS size FROM scored GROUP BY g, score),
sz AS (
    SELECT DISTINCT g, coalesce(min(CASE WHEN size >= least_size THEN size END), max(size)) AS size
    FROM tier, (VALUES (1), (30), (100), (300), (900), (3000)) v(least_size) GROUP BY g, least_size),
lev AS (SELECT g, row_number() OVER (PARTITION BY g ORDER BY size) - 1 AS level, score AS cut, size FROM sz JOIN tier USING (g, size)),
ex AS (SELECT s.*, level, size, count(*) OVER (PARTITION BY s.g, level, entity) AS c FROM scored s JOIN lev ON s.g = lev.g AND score >= cut),
w AS (SELECT *, CASE WHEN entity = 0 THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, greatest(6.0::DOUBLE, 0.02::DOUBLE * size) / c) END AS w FROM ex),
sums AS (
    SELECT g, level, 'n' AS what, sum(w) AS a, sum(w) AS n FROM w GROUP BY g, level
    UNION ALL SELECT g, level, 'adj', sum(CASE WHEN n_items >= 12 AND len(list_filter(tags, lambda x: starts_with(x, 'adj:r'))) > 0 THEN w ELSE 0 END), sum(CASE WHEN n_items >= 12 THEN w ELSE 0 END) FROM w GROUP BY g, level
    UNION ALL SELECT g, level, 'noun', sum(CASE WHEN len(list_filter(tags, lambda x: starts_with(x, 'noun:'))) > 0 THEN w ELSE 0 END), sum(CASE WHEN len(list_filter(tags, lambda x: starts_with(x, 'noun:') OR x = 'flag:A')) > 0 THEN w ELSE 0 END) FROM w GROUP BY g, level),
kept AS (SELECT * FROM (SELECT *, coalesce(max(n) OVER (PARTITION BY g, what ORDER BY level ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM sums) WHERE before < 3000),
co AS (
    SELECT g, what, level, a, n, exp(coalesce(sum(ln(300 / (n + 300))) OVER (PARTITION BY g, what ORDER BY level ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS passed, level = max(level) OVER (PARTITION BY g, what) AS last FROM kept),
share AS (SELECT g, what, sum(a * passed / CASE WHEN last THEN n ELSE n + 300 END) AS p FROM co GROUP BY g, what),
lad AS (
    SELECT g, tag, sum(CASE WHEN level = 0 THEN w ELSE 0 END) AS k, sum(w * passed / CASE WHEN last THEN n ELSE n + 300 END) AS p
    FROM (SELECT g, level, w, unnest(tags) AS tag FROM w) JOIN (SELECT g, level, n, passed, last FROM co WHERE what = 'n') USING (g, level) WHERE starts_with(tag, 'brand:') GROUP BY g, tag),
best AS (
    SELECT g, tag, k, p, p / (n / (SELECT count(*) FROM post)) AS lift FROM lad JOIN dict USING (tag) WHERE p > 0 AND tid <= 110
    QUALIFY row_number() OVER (PARTITION BY g ORDER BY p * pow(p / (n / (SELECT count(*) FROM post)), 0.8) DESC, tid) <= 12)"""

ORACLE_SQL: dict[str, str] = {
    "m8_batch": f"""WITH {BATCH}
        SELECT b.g AS given, b.tag, t.n_tiers::INT AS n_tiers, round(x.p, 6) AS p_adj, round(y.p, 6) AS p_noun, round(b.p, 6) AS conf, round(lift, 6) AS lift, round(k, 6) AS k
        FROM best b JOIN (SELECT g, count(*) AS n_tiers FROM tier GROUP BY g) t USING (g) JOIN share x ON x.g = b.g AND x.what = 'adj' JOIN share y ON y.g = b.g AND y.what = 'noun'""",
    "a14_exact_counts": f"""WITH {WIDE}{ladder_sql("q", "wide", ITEMS[:2])},
        b AS (SELECT tag, w FROM (SELECT level, w, unnest(tags) AS tag FROM q_w) WHERE level = 0 AND starts_with(tag, 'brand:')),
        a AS (SELECT unnest(tags) AS tag FROM wide)
        SELECT 'both' AS condition, tag, (SELECT round(n) FROM q_n WHERE level = 0) AS n, round(sum(w), 6) AS c FROM b GROUP BY tag
        UNION ALL SELECT 'all', tag, (SELECT count(*)::DOUBLE FROM wide), count(*)::DOUBLE FROM a WHERE starts_with(tag, 'brand:') GROUP BY tag""",
    "r_design_segment": _design(segment=True),
    "r_chain": _chain(),
    "r_pose_act": _pose(act=True),
    "r_expression_act": _expression(act=True),
    "r_design_seeds": _seeds(_design),
    "r_adult_seeds": _seeds(_adult),
    "r_pose_seeds": _seeds(_pose),
    "r_expression_seeds": _seeds(_expression),
    "p10_segment_bits": f"""WITH {POST},
        tags AS (SELECT pid, list(tag) AS t FROM inc GROUP BY pid)
        SELECT id, (CASE WHEN list_contains(t, 'flag:R') THEN 1 ELSE 0 END + CASE WHEN region IN ('ASIA', 'EUROPE') THEN 2 ELSE 0 END
            + CASE WHEN (list_contains(t, 'hid:y') AND list_contains(t, 'line:O') AND NOT list_contains(t, 'flag:A') AND NOT list_contains(t, 'flag:N')) OR segment = 'BUILDING' THEN 4 ELSE 0 END
            + CASE WHEN grp > 0 THEN 8 ELSE 0 END + CASE WHEN segment = 'MACHINERY' THEN 16 ELSE 0 END)::INT AS bits,
            coalesce(len(t), 0)::INT AS n_tags, CASE WHEN grp > 0 THEN printf('c%03d', grp) END AS entity_name
        FROM post LEFT JOIN tags ON pid = id""",
    "a2_id_cut": f"""WITH {POST}
        SELECT min(id) FILTER (created_at >= TIMESTAMP '1996-01-01') AS id_since, count(*) AS n_all, count(*) FILTER (rating IN ('g', 's')) AS n_gs, count(*) FILTER (rating = 'e') AS n_e FROM post""",
    "w1_entity_ids": f"""WITH {POST}
        SELECT id AS pid, (CASE WHEN grp = 0 THEN 0 ELSE dense_rank() OVER (PARTITION BY grp = 0 ORDER BY grp) END)::INT AS entity FROM post""",
    "f7_normalise": """
        WITH l AS (SELECT p_partkey, list_filter(list_transform(string_split(' ' || upper(p_name) || ' , ' || p_brand || ',,' || p_type, ','), lambda x: replace(lower(trim(x)), ' ', '_')), lambda x: x <> '') AS t FROM part)
        SELECT p_partkey, array_to_string(t, '|') AS listed, array_to_string(list_transform(t, lambda x: CASE WHEN regexp_matches(x, '[A-Za-z0-9]') THEN replace(x, '_', ' ') ELSE x END), ', ') AS prompt FROM l""",
    "f14_requests": """
        WITH q AS (
            SELECT *, 'exclude=+' || upper(replace(p_name, ' ', '+')) || ',+,' || replace(p_brand, '#', '_') || '&people=' || CASE WHEN p_partkey % 5 = 0 THEN 'x' ELSE (p_partkey % 9 - 2)::VARCHAR END
                   || CASE p_partkey % 3 WHEN 0 THEN '&on=%5B%22' || split_part(p_name, ' ', 1) || '%22,%22z%22%5D' WHEN 1 THEN '&on=%7Bno' ELSE '' END || '&must=' || p_partkey % 2
                   || '&req=,' || replace(p_type, ' ', '+') || '&cos=' || split_part(p_name, ' ', 1) || ',red&charcap=' || (p_partkey % 300 - 20) || '.7&temp=0.' || p_partkey % 40 AS query
            FROM part)
        SELECT p_partkey, query, replace(lower(p_name), ' ', '_') || '|' || replace(lower(p_brand), '#', '_') AS excluded, CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE least(3, greatest(1, p_partkey % 9 - 2)) END::INT AS people,
               CASE WHEN p_partkey % 3 = 0 THEN split_part(p_name, ' ', 1) || '|z' END AS switched_on, p_partkey % 2 = 1 AS must_all, p_type AS must,
               array_to_string(list_filter([split_part(p_name, ' ', 1), 'red'], lambda x: x IN ('red', 'hot', 'blue')), '|') AS costumes, '' AS design,
               floor(greatest(0, regexp_extract(query, 'charcap=([-0-9.]+)', 1)::DOUBLE))::INT AS entity_cap, greatest(0.1, ('0.' || p_partkey % 40)::DOUBLE) AS temperature
        FROM q""",
    "x_increments": f"""WITH {INDEX},
        pool AS (
            SELECT pid, tag FROM inc WHERE (starts_with(tag, 'brand:') OR starts_with(tag, 'type:')) AND pid IN (SELECT pid FROM inc WHERE tag = 'line:O') AND pid NOT IN (SELECT pid FROM inc WHERE tag = 'brand:Brand#11'))
        SELECT 'rate' AS kind, rating AS a, tag AS b, count(*) AS n FROM inc GROUP BY rating, tag
        UNION ALL SELECT 'pair', a.tag, b.tag, count(*) FROM pool a JOIN pool b ON a.pid = b.pid AND a.tag < b.tag GROUP BY a.tag, b.tag
        UNION ALL SELECT 'rank', '', tag, tid FROM dict""",
    "s15_tree": f"""
        SELECT name, size, count(*) AS n_blocks, sha256(string_agg(sha256, '' ORDER BY block, sha256)) AS root FROM ({_blocks("text", "")}) GROUP BY name, size""",
    "s16_status": """
        WITH d AS (SELECT doc_id::VARCHAR AS name, octet_length(encode(coalesce(text, ''))) AS size, doc_id % 5 AS k FROM documents)
        SELECT name, size, CASE WHEN k IN (1, 2) THEN size WHEN k = 3 THEN size // 3 ELSE 0 END AS have, CASE WHEN k IN (1, 2) THEN 'complete' WHEN k = 3 THEN 'partial' ELSE 'missing' END AS state FROM d""",
    "s14_ranges": f"""
        WITH w AS ({_blocks("text", "")}),
        g AS (
            {_blocks("left(coalesce(text, ''), floor(length(coalesce(text, '')) * 2 / 3)::INT)", "WHERE doc_id % 4 = 1")}
            UNION ALL {_blocks("replace(coalesce(text, ''), 'qu', 'uq')", "WHERE doc_id % 4 = 2")}
            UNION ALL {_blocks("text", "WHERE doc_id % 4 = 3")}),
        l AS (SELECT *, block - row_number() OVER (PARTITION BY name ORDER BY block) AS run FROM w ANTI JOIN g USING (name, block, length, sha256))
        SELECT name, min(start) AS start, sum(length)::BIGINT AS length FROM l GROUP BY name, run""",
    "a8_document_tokens": """
        SELECT rating, entity, tag, count(*) AS n FROM (
            SELECT lang AS rating, source AS entity, unnest(list_distinct(list_filter(string_split_regex(coalesce(text, ''), '[ \\n]+'), lambda x: x <> ''))) AS tag FROM documents)
        GROUP BY rating, entity, tag""",
    "s9_stored_rates": f"""WITH {INDEX}
        SELECT 'all' AS rating, tag, count(*) AS n FROM inc GROUP BY tag UNION ALL SELECT 'gs', tag, count(*) FROM inc WHERE rating IN ('g', 's') GROUP BY tag
        UNION ALL SELECT 'e', tag, count(*) FROM inc WHERE rating = 'e' GROUP BY tag""",
    "s10_stored_layouts": f"""WITH {INDEX},
        pool AS (SELECT pid, tid FROM red WHERE (starts_with(tag, 'brand:') OR starts_with(tag, 'type:') OR starts_with(tag, 'adj:')) AND pid NOT IN (SELECT pid FROM red WHERE tag = 'brand:Brand#11')),
        pr AS (SELECT a.tid AS a, b.tid AS b, count(*) AS n FROM pool a JOIN pool b ON a.pid = b.pid AND a.tid < b.tid GROUP BY ALL)
        SELECT 'rows' AS layout, count(*) AS n, sum(pid)::BIGINT AS s, sum(tid)::BIGINT AS t FROM red
        UNION ALL SELECT 'baskets', count(*), sum(pid)::BIGINT, sum(n_items)::BIGINT FROM bask
        UNION ALL SELECT 'pairs', count(*), sum(a + b)::BIGINT, sum(n)::BIGINT FROM pr""",
    "p17_facet_present": f"""WITH {INDEX},
        rule(facet, ord, p) AS (VALUES {RULES}),
        own AS (SELECT tag, min_by(facet, ord) AS facet FROM dict JOIN rule ON regexp_matches(tag, p) WHERE NOT (facet = 'noun' AND tag = 'noun:ring') GROUP BY tag)
        SELECT facet, count(DISTINCT pid) AS n FROM red JOIN own USING (tag) GROUP BY facet""",
    "p22_removal": f"WITH {INDEX} SELECT tag, n FROM dict WHERE starts_with(tag, 'adj:') AND NOT starts_with(tag, 'adj:b') AND NOT contains(tag, 'ee')",
    "u4_differences": f"""WITH {INDEX}
        SELECT pid, array_to_string(list_sort(list_filter(list_distinct(list_transform(tags, lambda x: split_part(x, ':', 1))), lambda x: x NOT IN ('ret', 'flag', 'line'))), ',') AS facets,
               len(list_filter(tags, lambda x: x NOT IN ('line:O', 'type:ECONOMY')))::INT AS n_left FROM bask""",
    "t9_small_samples": f"WITH {INDEX} SELECT tag, count(*) AS n, count(*) < 3000 AS small FROM red WHERE starts_with(tag, 'type:') GROUP BY tag",
    "f5_anchors": f"""WITH {INDEX},
        rule(facet, ord, p) AS (VALUES {RULES}),
        m AS (SELECT tag, tid, facet, ord FROM dict JOIN rule ON regexp_matches(tag, p) WHERE tid % 9 = 0 AND NOT (facet = 'noun' AND tag = 'noun:ring')),
        o AS (SELECT tag, tid, min_by(facet, ord) AS facet FROM m GROUP BY tag, tid),
        t AS (SELECT facet, min_by(tag, tid) AS tag FROM o GROUP BY facet)
        SELECT dict.tag, dict.tag IN (SELECT tag FROM m) AS owned, t.facet FROM dict LEFT JOIN t USING (tag) WHERE dict.tid % 9 = 0""",
    "f13_json": f"""WITH {POST}, tags AS (SELECT pid, count(*) AS n FROM inc GROUP BY pid)
        SELECT id, '{{"rating":"' || rating || '","n":' || coalesce(n, 0) || '}}' AS written FROM post LEFT JOIN tags ON pid = id""",
    "r_act_frequencies": f"WITH {INDEX} SELECT tag, count(*) AS n FROM inc WHERE rating = 'e' AND starts_with(tag, 'type:') GROUP BY tag",
    "r6_catalogue": f"""WITH {INDEX},
        rule(facet, ord, p) AS (VALUES {RULES})
        SELECT facet, ord, count(*) AS n_items, min_by(tag, tid) AS example FROM dict JOIN rule ON regexp_matches(tag, p) WHERE NOT (facet = 'noun' AND tag = 'noun:ring') GROUP BY facet, ord""",
    "a3_base_rates": f"""WITH {INDEX}
        SELECT tag, tid, dict.n AS n_all, nullif(count(*) FILTER (rating IN ('g', 's')), 0) AS n_gs, nullif(count(*) FILTER (rating = 'e'), 0) AS n_e FROM dict JOIN inc USING (tag) GROUP BY ALL""",
    "a7_baskets": f"WITH {INDEX} SELECT pid, n_items::INT AS n_items, items, rating::INT AS rating, entity::INT AS entity, segment_bits::INT AS segment_bits, costume_bits::INT AS costume_bits FROM bask",
    "p11_mask_filter": f"WITH {INDEX} SELECT segment_bits::INT AS segment_bits, count(*) AS n, min(pid) AS least, max(pid) AS most FROM bask WHERE segment_bits & 12 <> 0 AND rating <= 1 GROUP BY segment_bits",
    "p15_matches": f"""WITH {INDEX},
        f AS (SELECT list_contains(tags, 'type:ECONOMY') AND list_contains(tags, 'flag:R') AS e, len(list_filter(tags, lambda x: starts_with(x, 'brand:Brand#1'))) > 0 AS a,
                     NOT list_has_any(tags, ['ret:O', 'ret:F']) AS o, n_items >= 12 AS w, list_contains(tags, 'hid:y') AS h FROM bask)
        SELECT count(*) FILTER (e) AS n_exact, count(*) FILTER (e AND a) AS n_any, count(*) FILTER (e AND o) AS n_none, count(*) FILTER (e AND w) AS n_well, count(*) FILTER (h) AS n_item FROM f""",
    "j4_intersection": f"WITH {INDEX} SELECT pid FROM red WHERE tag IN ('type:ECONOMY', 'flag:R', 'hid:y') GROUP BY pid HAVING count(*) = 3",
    "j5_exclusion": f"WITH {INDEX} SELECT pid FROM red WHERE tag = 'flag:A' AND pid NOT IN (SELECT pid FROM red WHERE tag IN ('ret:O', 'hid:y'))",
    "u_set_operations": f"""WITH {INDEX}, a AS (SELECT pid FROM red WHERE tag = 'flag:R'), b AS (SELECT pid FROM red WHERE tag = 'hid:y')
        SELECT 'except' AS op, count(*) AS n, coalesce(sum(pid), 0)::BIGINT AS s FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
        UNION ALL SELECT 'intersect', count(*), coalesce(sum(pid), 0)::BIGINT FROM (SELECT * FROM a INTERSECT SELECT * FROM b)
        UNION ALL SELECT 'union', count(*), coalesce(sum(pid), 0)::BIGINT FROM (SELECT * FROM a UNION SELECT * FROM b)""",
    "t4_posting_sample": f"WITH {INDEX} SELECT pid FROM red WHERE tag = 'type:ECONOMY' ORDER BY md5(pid::VARCHAR || '#1'), pid LIMIT 500",
    "w2_entity_cap": f"""WITH {INDEX}
        SELECT pid, entity::INT AS entity FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY md5(pid::VARCHAR || '#1'), pid) AS rn FROM bask) WHERE entity = 0 OR rn <= 20""",
    "b2_design_sample": f"""WITH {INDEX},
        k AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY md5(pid::VARCHAR || '#1'), pid) AS rn FROM bask
              WHERE list_contains(tags, 'type:ECONOMY') AND list_contains(tags, 'line:O') AND NOT list_has_any(tags, ['brand:Brand#11', 'brand:Brand#12']) AND rating <= 1 AND segment_bits & 12 <> 0)
        SELECT pid FROM k WHERE entity = 0 OR rn <= 20 ORDER BY md5(pid::VARCHAR || '#1'), pid LIMIT 400""",
    "b2_sketch_sample": f"""WITH {INDEX},
        k AS (
            SELECT dict.tag, pid, entity, row_number() OVER (PARTITION BY dict.tag, entity ORDER BY md5(pid::VARCHAR || '#1'), pid) AS rn
            FROM bask JOIN dict ON list_contains(tags, dict.tag) WHERE starts_with(dict.tag, 'brand:Brand#1') AND rating <= 1 AND segment_bits & 12 <> 0)
        SELECT tag, pid FROM k WHERE entity = 0 OR rn <= 20 QUALIFY row_number() OVER (PARTITION BY tag ORDER BY md5(pid::VARCHAR || '#1'), pid) <= 60""",
    "b2_basket_sample": f"""WITH {INDEX},
        k AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY md5(pid::VARCHAR || '#1'), pid) AS rn FROM bask
              WHERE list_contains(tags, 'flag:R') AND list_contains(tags, 'line:O') AND NOT list_has_any(tags, ['brand:Brand#11', 'hid:y']) AND rating <= 1 AND segment_bits & 1 <> 0 AND costume_bits & 1 <> 0)
        SELECT pid FROM k WHERE entity = 0 OR rn <= 5 ORDER BY md5(pid::VARCHAR || '#1'), pid LIMIT 300""",
    "j4_rows": f"""WITH {INDEX}
        SELECT 'all' AS kind, pid FROM red WHERE tag IN ('type:ECONOMY', 'flag:R', 'hid:y') GROUP BY pid HAVING count(*) = 3
        UNION ALL SELECT 'none', pid FROM red WHERE tag = 'flag:A' AND pid NOT IN (SELECT pid FROM red WHERE tag IN ('ret:O', 'hid:y'))""",
    "b4_code_sample": f"WITH {INDEX} SELECT pid, rating::INT AS rating FROM bask WHERE list_contains(tags, 'flag:R') AND rating = 3 ORDER BY md5(pid::VARCHAR || '#1'), pid LIMIT 300",
    "f1_facets": f"""WITH {INDEX},
        rule(facet, ord, p) AS (VALUES {RULES})
        SELECT tag, facet, ord FROM dict JOIN rule ON regexp_matches(tag, p) WHERE NOT (facet = 'noun' AND tag = 'noun:ring')""",
    "f3_exclusive": f"""WITH {INDEX},
        rule(facet, ord, p) AS (VALUES {RULES})
        SELECT tag, min_by(facet, ord) AS facet FROM dict JOIN rule ON regexp_matches(tag, p) WHERE NOT (facet = 'noun' AND tag = 'noun:ring') GROUP BY tag""",
    "t6_autocomplete": f"""WITH {INDEX},
        needle AS (SELECT unnest(['r', 'ed', 'Brand#2', 'd:B', 'nowhere']) AS needle),
        h AS (SELECT needle, dict.* FROM dict JOIN needle ON contains(tag, needle) QUALIFY row_number() OVER (PARTITION BY needle ORDER BY n DESC, tid) <= 30)
        SELECT needle, row_number() OVER (PARTITION BY needle ORDER BY NOT starts_with(tag, needle), length(tag), n DESC, tid)::INT AS place, tag, n FROM h""",
    "m1_tiers": f"WITH {FLAGSHIP} SELECT score::INT AS score, n, size FROM q_tier",
    "m2_levels": f"WITH {FLAGSHIP} SELECT level::INT AS level, cut::INT AS cut, l.size, round(n, 6) AS n FROM q_n JOIN q_level l USING (level)",
    "m3_ladder": f"WITH {LADDER} SELECT tag, round(coalesce(k_top, 0), 6) AS k_top, round(coalesce(p, 0), 6) AS p FROM {BRANDS} LEFT JOIN lad USING (tag)",
    "m8_candidates": f"""WITH {LADDER}, r AS (SELECT tag, tid, p, p / (n / (SELECT count(*) FROM post)) AS lift, k_top FROM lad JOIN dict USING (tag) WHERE p > 0)
        SELECT tag, round(p, 6) AS conf, round(lift, 6) AS lift, round(k_top, 6) AS k FROM r ORDER BY p * pow(lift, 0.8) DESC, tid LIMIT 12""",
    "f12_rounding": f"""WITH {LADDER}, r AS (SELECT tag, tid, p, p / (n / (SELECT count(*) FROM post)) AS lift, k_top FROM lad JOIN dict USING (tag) WHERE p > 0)
        SELECT tag, round(p, 4) AS conf, round(lift, 2) AS lift, round(k_top)::INT AS k FROM r ORDER BY p * pow(lift, 0.8) DESC, tid LIMIT 12""",
    "m5_none": f"WITH {FLAGSHIP}{_ANY} " + " UNION ALL ".join(f"SELECT '{k}' AS facet, round({v}_well.p, 6) AS p_any, round(greatest(0.05, 1 - {v}_well.p), 6) AS p_none, round({v}_abs.p, 6) AS p_any_absent FROM {v}_well, {v}_abs" for k, v in _FACETS.items()),
    "m6_anchor_lift": f"WITH {WIDE}{LIFT.format(brands=BRANDS, sample='small')} SELECT tag, round(lift, 6) AS lift FROM lift",
    "m7_prior": f"""WITH {WIDE}{LIFT.format(brands=BRANDS, sample="(SELECT * FROM wide WHERE list_contains(tags, 'hid:y') AND rating = 0)")}
        {ladder_sql("v", "wide", ITEMS[:1])}{ladder_sql("s", "(SELECT * FROM small WHERE rating = 0)", ITEMS[:1])},
        base AS (
            SELECT tag, least(1.0, coalesce(p, 0) * lift) AS base FROM lift LEFT JOIN (
                SELECT tag, sum(w * passed / CASE WHEN last THEN n ELSE n + 300 END) AS p FROM (SELECT level, w, unnest(tags) AS tag FROM v_w) JOIN v_c USING (level) GROUP BY tag) USING (tag)),
        own AS (SELECT tag, sum(w * passed / (n + 300)) AS p FROM (SELECT level, w, unnest(tags) AS tag FROM s_w) JOIN s_c USING (level) GROUP BY tag)
        SELECT tag, round(coalesce(p, 0) + base * (SELECT min(passed * 300 / (n + 300)) FROM s_c), 6) AS p FROM base LEFT JOIN own USING (tag)""",
    "m9_pair_share": f"""WITH {INDEX},
        f AS (SELECT rating = 0 AS g, (len(list_filter(tags, lambda x: starts_with(x, 'brand:Brand#2'))) > 0)::INT AS a FROM bask WHERE n_items >= 12 AND list_contains(tags, 'hid:y')),
        c AS (SELECT sum(a) AS k1, count(*) AS n1, sum(a) FILTER (g) AS k, count(*) FILTER (g) AS n FROM f)
        SELECT 'with prior' AS kind, round((k + 300 * (k1 / n1)) / (n + 300), 6) AS p FROM c UNION ALL SELECT 'alone', round(k / n, 6) FROM c""",
    "a5_pairs": f"WITH {SOLO} SELECT tag_a, tag_b, n_ab FROM pair",
    "m10_pair_lift": f"""WITH {SOLO},
        x AS (
            SELECT t.tag, CASE WHEN t.n >= 100 AND b.n > 0 THEN (coalesce(n_ab, 0) / t.n) / (b.n / (SELECT count(*) FROM solo)) END AS lift
            FROM (SELECT dict.tag, coalesce(single.n, 0) AS n FROM dict LEFT JOIN single USING (tag) WHERE starts_with(dict.tag, 'type:') AND tid <= 110) t
            CROSS JOIN (SELECT dict.tag, coalesce(single.n, 0) AS n FROM dict LEFT JOIN single USING (tag) WHERE starts_with(dict.tag, 'brand:') AND tid <= 110) b
            LEFT JOIN pair ON tag_a = b.tag AND tag_b = t.tag)
        SELECT tag, count(lift) AS n, round(least(20.0, greatest(0.02, product(lift))), 6) AS product FROM x GROUP BY tag""",
    "g1_draw": f"""WITH {INDEX},
        d AS (SELECT tag, tid, split_part(tag, ':', 1) AS facet, sqrt(n) AS weight FROM dict),
        r AS (SELECT *, sum(weight) OVER (PARTITION BY facet ORDER BY tid) AS run, {UNIFORM.format("'7#' || facet")} * sum(weight) OVER (PARTITION BY facet) AS goal FROM d)
        SELECT facet, tag FROM (SELECT *, row_number() OVER (PARTITION BY facet ORDER BY run, tid) AS k FROM r WHERE run >= goal) WHERE k = 1""",
    "g2_draw_several": f"""WITH {INDEX},
        d AS (SELECT tag, tid, split_part(tag, ':', 1) AS facet, pow(n::DOUBLE, 1 / 0.7::DOUBLE) AS weight FROM dict),
        r AS (SELECT *, row_number() OVER (PARTITION BY facet ORDER BY -ln({UNIFORM.format("'7#' || facet || '#' || tid::VARCHAR")}) / weight, tid) AS place FROM d)
        SELECT facet, tag, place::INT AS place FROM r WHERE place <= 3""",
    "b6_random_anchor": f"""WITH {INDEX},
        d AS (SELECT tag, tid, n, sqrt(n) AS weight FROM dict WHERE starts_with(tag, 'adj:') AND n >= 3000 AND tid <= 110),
        r AS (SELECT *, sum(weight) OVER (ORDER BY tid) AS run, sum(weight) OVER () AS total FROM d),
        t AS (SELECT t AS try, {UNIFORM.format("'3#anchor#' || t")} AS u FROM range(12) AS s(t)),
        x AS (SELECT try, min_by(tag, run) AS tag, min_by(n, run) AS n FROM t JOIN r ON run >= u * total GROUP BY try),
        m AS (SELECT tag, count(*) AS m FROM (SELECT unnest(tags) AS tag FROM bask WHERE segment_bits & 4 <> 0 AND NOT list_contains(tags, 'brand:Brand#11')) GROUP BY tag),
        j AS (SELECT *, ends_with(tag, 'n') OR starts_with(tag, 'adj:b') OR coalesce(m, 0) < 300 AS bad FROM x LEFT JOIN m USING (tag))
        SELECT tag, n, try FROM j ORDER BY bad, CASE WHEN bad THEN -try ELSE try END LIMIT 1""",
    "r_pose": _pose(),
    "r_expression": _expression(),
    "r_design": _design(),
    "r_scene": _scene(),
    "r_adult": _adult(),
}
