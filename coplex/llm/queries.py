"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_bpe import encode_digests
from .common import table
from .exact_dedup import exact_dedup
from .hard_negatives import hard_negatives
from .html_text import extract_text
from .line_dedup import drop_boilerplate_lines
from .lm_scoring import lm_scores
from .ngram_join import ngram_classes
from .packing import pack
from .periodic_runs import run_digests
from .quality_mil import fit_quality, quality_scores
from .quality_rules import quality_rules
from .secret_scan import BREAK, KINDS, REACH, scan_secrets, secret_digests
from .suffix_dedup import suffix_dedup


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_scores(docs, fit_quality(docs, table(spark, sf_dir, "labels")))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return drop_boilerplate_lines(docs, host_col="source")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_classes(table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digests(scan_secrets(table(spark, sf_dir, "documents")))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, label=shifted)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_quality_mil": op2_quality_mil,
    "op3_html_text": op3_html_text,
    "op4_packing": op4_packing,
    "op5_quality_rules": op5_quality_rules,
    "op6_line_dedup": op6_line_dedup,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_ngram_join": op9_ngram_join,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_secret_scan": op11_secret_scan,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_periodic_runs": op13_periodic_runs,
}



def _secret_sql() -> str:
    """Matches with places from running lengths, blank lines before each, and weak parts by EXISTS."""
    literal = lambda x: "'" + x.replace("'", "''") + "'"
    every = [(i, k.pattern, k.group, k.least, k.has) for i, k in enumerate(KINDS)] + [(-1, BREAK, 0, 1, ())]
    lists = ", ".join(f"regexp_extract_all(t, {literal(p)}) AS f{i + 1}, regexp_extract_all(t, {literal(p)}, {g}) AS j{i + 1}, string_split_regex(t, {literal(p)}) AS x{i + 1}" for i, p, g, _, _ in every)
    rows = " UNION ALL ".join(
        f"SELECT rid, {i} AS ord, unnest(range(len(f{i + 1}))) AS i, unnest(f{i + 1}) AS m, unnest(list_transform(j{i + 1}, lambda v: {' AND '.join([f'length(v) >= {least}', *(f'regexp_matches(v, {literal(h)})' for h in has)])})) AS ok, unnest(x{i + 1}[1:len(f{i + 1})]) AS gap FROM l"
        for i, _, _, least, has in every
    )
    name = " ".join(f"WHEN {i} THEN '{k.name}'" for i, k in enumerate(KINDS))
    role = " ".join(f"WHEN {i} THEN '{k.role}'" for i, k in enumerate(KINDS))
    strong = ", ".join(str(i) for i, k in enumerate(KINDS) if k.strong)
    near = f"q.rid = p.rid AND q.scope = p.scope AND q.a <= p.z + {REACH} AND p.a <= q.z + {REACH} AND (q.a >= p.z OR p.a >= q.z)"
    counts = ", ".join(f"coalesce(count(*) FILTER (ord = {i}), 0) AS n_{k.name}" for i, k in enumerate(KINDS) if k.strong)
    return f"""
        WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
        l AS (SELECT rid, {lists} FROM d),
        e AS (SELECT rid, ord, ok, length(m) AS n, sum(length(gap) + length(m)) OVER (PARTITION BY rid, ord ORDER BY i) AS z FROM ({rows})),
        s AS (SELECT *, z - n AS a, sum((ord < 0)::INT) OVER (PARTITION BY rid ORDER BY z - n, ord) AS scope FROM e WHERE ok),
        c AS (SELECT rid, ord, a, z, scope, CASE ord {name} END AS name, CASE ord {role} END AS role, ord IN ({strong}) AS strong FROM s WHERE ord >= 0),
        o AS (
            SELECT * FROM c p WHERE strong OR role <> 'endpoint' AND EXISTS (
                SELECT 1 FROM c q WHERE q.role = CASE p.role WHEN 'identifier' THEN 'secret' ELSE 'identifier' END AND {near})),
        k AS (SELECT * FROM o UNION ALL SELECT * FROM c p WHERE role = 'endpoint' AND EXISTS (SELECT 1 FROM o q WHERE {near})),
        g AS (
            SELECT rid, {counts}, string_agg(name || ':' || a || ':' || z, ',' ORDER BY a, ord) FILTER (strong) AS base,
                   string_agg(name || ':' || a || ':' || z, ',' ORDER BY a, ord) AS spans, count(*) FILTER (NOT strong) AS n_linked
            FROM k GROUP BY rid)
        SELECT doc_id, {", ".join(f"coalesce(n_{k.name}, 0) AS n_{k.name}" for k in KINDS if k.strong)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_linked, 0) AS n_linked
        FROM d LEFT JOIN g USING (rid)"""


ORACLE_SQL: dict[str, str] = {
    "op11_secret_scan": _secret_sql(),
    "op13_periodic_runs": r"""
        WITH d AS (
            SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
                   xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
                       lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) AS h
            FROM documents),
        g AS (SELECT *, len(w) AS n, h // 10 AS g FROM d),
        a AS (SELECT *, CASE WHEN n > 0 THEN g % n ELSE 0 END AS a FROM g),
        m AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
        t AS (SELECT rid, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1]) ELSE w END AS w FROM m),
        e AS (SELECT rid, n, unnest(w) AS word, unnest(range(n)) AS i FROM t),
        q AS (SELECT x.rid, y.i - x.i AS p, x.i FROM e x JOIN e y ON x.rid = y.rid AND x.word = y.word AND y.i > x.i AND 2 * (y.i - x.i) <= x.n),
        k AS (SELECT *, i - row_number() OVER (PARTITION BY rid, p ORDER BY i) AS k FROM q),
        f AS (SELECT rid, p, min(i) AS s, count(*) + p AS n FROM k GROUP BY rid, p, k HAVING count(*) + p >= greatest(12, 2 * p)),
        r AS (SELECT rid, s, n, min(p) AS p FROM f GROUP BY rid, s, n),
        o AS (SELECT rid, string_agg(word, ' ' ORDER BY i) AS kept FROM e WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.rid = e.rid AND e.i >= s + p AND e.i < s + r.n) GROUP BY rid),
        z AS (
            SELECT rid, count(*) AS n_runs, string_agg(s || ',' || n || ',' || p || chr(10), '' ORDER BY s, p) AS said, first(s ORDER BY n DESC, s, p) AS s, first(n ORDER BY n DESC, s, p) AS n, first(p ORDER BY n DESC, s, p) AS p
            FROM r GROUP BY rid)
        SELECT doc_id, coalesce(n_runs, 0) AS n_runs, z.s AS start, z.n AS length, z.p AS period, 1000 * z.n // z.p AS exponent_milli, sha256(coalesce(said, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
        FROM d LEFT JOIN z USING (rid) LEFT JOIN o USING (rid)""",
    "op12_hard_negatives": """
        WITH e AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
            FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS s
            FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
        p AS (SELECT a, b, s FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5),
        n AS (
            SELECT p.a, p.b, p.s, s.b AS nb, s.s AS ns, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.s DESC, s.b) AS rank
            FROM p JOIN s ON p.a = s.a AND NOT same AND 50 * p.s <= 100 * s.s AND 100 * s.s <= 95 * p.s)
        SELECT a AS anchor_id, b AS positive_id, rank::INT AS rank, nb AS negative_id, s AS positive_score, ns AS negative_score FROM n WHERE rank <= 3""",
    "op10_exact_dedup": """
        WITH d AS (
            SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
            FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, text_sha256
        FROM d WINDOW w AS (PARTITION BY text_sha256)""",
    "op5_quality_rules": r"""
        WITH t AS (
            SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text
            FROM documents),
        s AS (
            SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
                   list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
            FROM t),
        g AS (SELECT rid, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM s)),
        r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM g) WHERE c > 1),
        c AS (SELECT rid, count(DISTINCT i + o) AS n_repeat_words FROM r, range(5) AS k(o) GROUP BY rid),
        m AS (
            SELECT s.rid, doc_id, lang, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
                   length(text) - length(regexp_replace(text, '[#*$%&|<>]+', '', 'g')) AS n_symbols,
                   len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
            FROM s LEFT JOIN c USING (rid)),
        b AS (
            SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
                   n_symbols / greatest(n_words, 1) AS a1, n_dup_lines / greatest(n_lines, 1) AS a2,
                   n_repeat_words / greatest(n_words, 1) AS a3, word_chars / greatest(n_words, 1) AS a4
            FROM m),
        q AS (
            SELECT lang, source, grouping(lang, source) AS level, count(*) FILTER (NOT base_failed) AS n,
                   quantile_disc(a1, [0.1, 0.5, 0.9]) FILTER (NOT base_failed) AS q1, quantile_disc(a2, [0.02, 0.5, 0.98]) FILTER (NOT base_failed) AS q2,
                   quantile_disc(a3, [0.02, 0.5, 0.98]) FILTER (NOT base_failed) AS q3, quantile_disc(a4, [0.1, 0.5, 0.9]) FILTER (NOT base_failed) AS q4
            FROM b GROUP BY ROLLUP (lang, source)),
        v AS (
            SELECT lang, source, level, n, k, i, CASE k WHEN 1 THEN q1[i] WHEN 2 THEN q2[i] WHEN 3 THEN q3[i] ELSE q4[i] END AS x
            FROM q, range(1, 5) AS r(k), range(1, 4) AS s(i)),
        y AS (
            SELECT l.lang, l.k, l.i, (l.n * coalesce(l.x, 0) + 20 * a.x) / (l.n + 20) AS x
            FROM v l JOIN v a ON a.level = 3 AND l.level = 1 AND a.k = l.k AND a.i = l.i),
        z AS (
            SELECT g.lang, g.source, g.k, list((g.n * coalesce(g.x, 0) + 20 * y.x) / (g.n + 20) ORDER BY g.i) AS x
            FROM v g JOIN y ON g.level = 0 AND y.lang = g.lang AND y.k = g.k AND y.i = g.i GROUP BY g.lang, g.source, g.k),
        f AS (
            SELECT lang, source, max(x[3] + 3.0 * (x[3] - x[2])) FILTER (k = 1) AS f1, max(x[3] + 1.0 * (x[3] - x[2])) FILTER (k = 2) AS f2,
                   max(x[3] + 1.5 * (x[3] - x[2])) FILTER (k = 3) AS f3, max(x[3] + 4.0 * (x[3] - x[2])) FILTER (k = 4) AS f4,
                   max(x[1] - 4.0 * (x[2] - x[1])) FILTER (k = 4) AS f5
            FROM z GROUP BY lang, source)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               NOT base_failed AND coalesce(
                   n_symbols <= f1 * greatest(n_words, 1) + 1 AND n_dup_lines <= f2 * greatest(n_lines, 1) + 1 AND n_repeat_words <= f3 * greatest(n_words, 1) + 5
                   AND word_chars <= f4 * greatest(n_words, 1) + 10 AND word_chars >= f5 * greatest(n_words, 1) - 10, false) AS kept
        FROM b LEFT JOIN f USING (lang, source)""",
    "op8_suffix_dedup": """
        WITH d AS (SELECT row_number() OVER () AS rid, doc_id, encode(coalesce(text, '')) AS b FROM documents),
        n AS (SELECT *, octet_length(b) AS n FROM d),
        s AS (SELECT rid, i, md5(b[i:i + 199]) AS h FROM (SELECT rid, b, unnest(range(1, n - 198)) AS i FROM n WHERE n >= 200)),
        r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY h) AS c FROM s) WHERE c > 1),
        g AS (SELECT rid, i, CASE WHEN i - lag(i) OVER (PARTITION BY rid ORDER BY i) <= 200 THEN 0 ELSE 1 END AS fresh FROM r),
        p AS (SELECT rid, run, min(i) AS a, max(i) + 200 AS z FROM (SELECT rid, i, sum(fresh) OVER (PARTITION BY rid ORDER BY i) AS run FROM g) GROUP BY rid, run),
        q AS (SELECT *, coalesce(lag(z) OVER (PARTITION BY rid ORDER BY run), 1) AS k FROM p),
        t AS (
            SELECT rid, sum(z - a) AS removed, count(*) AS spans, max(z) AS last, string_agg(CASE WHEN a > k THEN hex(b[k:a - 1]) ELSE '' END, '' ORDER BY run) AS kept
            FROM q JOIN n USING (rid) GROUP BY rid)
        SELECT doc_id, n AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0) AS n_spans,
               sha256(CASE WHEN removed IS NULL THEN b ELSE unhex(kept || CASE WHEN last <= n THEN hex(b[last:n]) ELSE '' END) END) AS kept_sha256
        FROM n LEFT JOIN t USING (rid)""",
    "op9_ngram_join": r"""
        WITH RECURSIVE d AS (
            SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
            FROM documents),
        g AS (
            SELECT rid, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)
            UNION ALL SELECT rid, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 4),
        k AS (SELECT rid, md5(string_agg(g, chr(10) ORDER BY g)) AS s FROM (SELECT DISTINCT rid, g FROM g) GROUP BY rid),
        t AS (SELECT s, min(doc_id) AS least, count(*) AS n_docs, min(rid) AS rid FROM k JOIN d USING (rid) GROUP BY s),
        x AS (SELECT DISTINCT s, g FROM t JOIN g USING (rid)),
        z AS (SELECT s, count(*) AS n FROM x GROUP BY s),
        e AS (
            SELECT p.a, p.b FROM (SELECT l.s AS a, r.s AS b, count(*) AS inter FROM x l JOIN x r ON l.g = r.g AND l.s <> r.s GROUP BY ALL) p
            JOIN z u ON u.s = p.a JOIN z v ON v.s = p.b WHERE inter / (u.n + v.n - inter) >= 0.8),
        c AS (SELECT s AS a, s AS b FROM t UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a),
        m AS (SELECT c.a AS s, min(least) AS class_id FROM c JOIN t ON t.s = c.b GROUP BY c.a),
        l AS (SELECT e.a AS s, count(*) AS n_texts, sum(n_docs) AS n FROM e JOIN t ON t.s = e.b GROUP BY e.a)
        SELECT d.doc_id, CASE WHEN k.s IS NULL THEN d.doc_id ELSE class_id END AS class_id,
               coalesce(n_docs - 1 + coalesce(l.n, 0), 0)::BIGINT AS n_links, coalesce(n_texts, 0)::BIGINT AS n_text_links
        FROM d LEFT JOIN k USING (rid) LEFT JOIN t ON t.s = k.s LEFT JOIN m ON m.s = k.s LEFT JOIN l ON l.s = k.s""",
    "op6_line_dedup": r"""
        WITH d AS (
            SELECT row_number() OVER () AS rid, doc_id, source, coalesce(source, '') AS host, string_split(coalesce(text, ''), chr(10)) AS lines
            FROM documents),
        e AS (SELECT rid, host, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM d),
        k AS (SELECT rid, host, i, line, trim(line, chr(32) || chr(9) || chr(11) || chr(12) || chr(13)) AS key FROM e),
        p AS (SELECT host, key, count(DISTINCT rid) AS n FROM k WHERE key <> '' GROUP BY host, key),
        h AS (SELECT host, count(*) AS pages FROM d GROUP BY host),
        f AS (SELECT host, key FROM p JOIN h USING (host) WHERE n >= 2 AND n > 0.05 * pages),
        x AS (
            SELECT rid, string_agg(line, chr(10) ORDER BY i) AS text, count(*) AS n
            FROM k ANTI JOIN f USING (host, key) GROUP BY rid)
        SELECT doc_id, source, coalesce(x.text, '') AS text, len(lines) AS n_lines, len(lines) - coalesce(x.n, 0) AS n_dropped
        FROM d LEFT JOIN x USING (rid)""",
}
