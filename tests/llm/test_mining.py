"""Secret scan, hard negatives and periodic runs, against brute force."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from coplex.llm import hard_negatives as hn
from coplex.llm.periodic_runs import collapse_runs, find_runs, run_digests
from coplex.llm.queries import ORACLE_SQL
from coplex.llm.recompression import Grammar
from coplex.llm.secret_scan import KINDS, REACH, running, scan_secrets, secret_digests
from pyspark.sql import functions as F


def secrets_of(text):
    """(start, ord, end, linked) by Python's re."""
    found = [(m.start(), i, m.end()) for i, k in enumerate(KINDS) for m in re.finditer(k.pattern, text) if len(m.group(k.group)) >= k.least and all(re.search(h, m.group(k.group)) for h in k.has)]
    blank = [m.start() for m in re.finditer(r"\n[\x20\t\r]*\n", text)]
    role, scope = (lambda x: KINDS[x[1]].role), lambda x: sum(b < x[0] for b in blank)
    near = lambda x, y: scope(x) == scope(y) and y[0] <= x[2] + REACH and x[0] <= y[2] + REACH and (y[0] >= x[2] or x[0] >= y[2])
    needs = {"identifier": "secret", "secret": "identifier"}
    sure = [x for x in found if KINDS[x[1]].strong or role(x) != "endpoint" and any(role(y) == needs[role(x)] and near(x, y) for y in found)]
    sure += [x for x in found if role(x) == "endpoint" and any(near(x, y) for y in sure)]
    return [(*x, not KINDS[x[1]].strong) for x in sorted(sure)]


KEY = "aB3" + "xY9z" * 9
SECRETS = [
    f"AKIA{'Q' * 16} {KEY} https://api.example.com/x",
    f"{KEY} and https://api.example.com alone say nothing",
    f"user: someone\n \n{KEY}",
    f"user: someone\n{KEY} 10.0.0.1:80",
    "user=someone " + "x " * 150 + KEY,
    'Password = "abcdefg" passwd:short token=token=abcdefgh secret: token: abcdefgh API_KEY:\'zz/zz==\'',
    "deadbeef" * 3 + " " + "deadbeef" * 2 + "g" + "0" * 24 + "AKIAAKIA" + "Z9" * 8,
    "É " * 300 + "me@example.com pässword token : abcdef1 " + "日本 " * 100 + "http://日本.example",
    "\n\n".join(f"login: user{i} secret: {'s' * (5 + i % 3)} {KEY}{i} host http://h{i}" for i in range(700)),
    "f" * 5000 + "@" + "f" * 3000,
]


def test_secret_scan(spark, clashing, edge_rows):
    rows = edge_rows + [(100 + i, t) for i, t in enumerate(SECRETS)] + [(100, SECRETS[0])]
    docs = clashing(rows).repartition(3)
    got = sorted(((r.doc_id or 0, [tuple(x) for x in r.spans]) for r in scan_secrets(docs).collect()), key=repr)
    assert got == sorted(((i or 0, secrets_of(t or "")) for i, t in rows), key=repr)
    by_id = {i: [KINDS[x[1]].name for x in s] for i, s in got}
    assert by_id[100] == ["access", "key", "endpoint"] and by_id[101] == [] and by_id[102] == [] and by_id[103] == ["ident", "key", "endpoint"] and by_id[104] == []
    shown = {r.doc_id: r for r in secret_digests(scan_secrets(docs)).collect()}
    assert shown[105].n_assign == 3 and shown[105].base_sha256 == hashlib.sha256(shown[105].spans.encode()).hexdigest()
    assert shown[3].spans == "" and shown[3].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert scan_secrets(docs.limit(0)).isEmpty()


def test_secret_sql(spark, clashing, edge_rows):
    rows = edge_rows + [(100 + i, t) for i, t in enumerate(SECRETS)]
    docs = clashing(rows)
    ours = docs.sparkSession.createDataFrame(secret_digests(scan_secrets(docs)).toPandas()).toPandas()
    documents = docs.select("doc_id", "text").toPandas()  # noqa: F841  read by the SQL
    theirs = duckdb.sql(ORACLE_SQL["op11_secret_scan"]).df()
    key = lambda df: sorted(map(tuple, df[sorted(df.columns)].fillna(-1).astype(str).values.tolist()))
    assert key(ours.astype({"doc_id": "float"})) == key(theirs.astype({"doc_id": "float"}))


def test_running_sums(spark):
    for n in (0, 1, 255, 256, 257, 1000):
        got = spark.range(1).select(running(F.expr(f"transform(sequence(1, {max(n, 1)}), x -> bigint(x))") if n else F.array().cast("array<bigint>"))).first()[0]
        assert got == [i * (i + 1) // 2 for i in range(1, n + 1)]


def mined(rows):
    """The contract by brute force: rows of (id, label, vector)."""
    rows = sorted({i: (i, la, v) for i, la, v in sorted((r for r in rows if None not in r and all(x is not None and np.isfinite(x) for x in r[2])), key=repr, reverse=True)}.values())
    ints = {i: [int(np.floor(256 * float(x))) for x in v] for i, _, v in rows}
    score = lambda a, b: sum(x * y for x, y in zip(ints[a], ints[b], strict=False))
    out = set()
    for a, label, _ in (r for r in rows if r[0] % 50 == 0):
        best = sorted((-score(a, i), i) for i, la, _ in rows if la == label and i != a)[:5]
        for s, p in best:
            inside = sorted((-score(a, i), i) for i, la, _ in rows if la != label and 50 * -s <= 100 * score(a, i) <= 95 * -s)[:3]
            out |= {(a, p, k + 1, i, -s, -t) for k, (t, i) in enumerate(inside)}
    return out


def test_hard_negatives(spark):
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(6, 12))
    rows = [(i, int(rng.integers(0, 4)), [float(x) for x in centers[i % 6] + rng.normal(size=12) * (0.3 if i % 3 else 0.0)]) for i in range(600)]
    rows += [(1000, None, [1.0] * 12), (1050, 1, None), (1100, 1, [None] * 12), (1150, 1, [float("nan")] * 12), (1200, 2, [float("inf")] + [0.0] * 11), (None, 1, [1.0] * 12), (1250, 9, [1.0] * 12), (1300, 1, [2.0]), (1350, 2, []), rows[50], rows[3]]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumns({x: F.lit("x") for x in ("id", "v", "block", "group", "place", "rank")}).repartition(5)
    ask = lambda d: [tuple(r) for r in hn.hard_negatives(d, F.col("id") % 50 == 0).collect()]
    got = ask(df)
    assert set(got) == mined(rows) and len(got) == len(set(got)) > 50
    many = df.withColumn("vec_id", F.col("vec_id") * 50)
    assert set(ask(many)) == mined([(i if i is None else i * 50, la, v) for i, la, v in rows])
    assert ask(df.limit(0)) == []


def test_hard_negatives_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(hn, "MOST", 40)
    monkeypatch.setattr(hn, "TILE", (7, 11))
    rng = np.random.default_rng(6)
    rows = [(i, i % 3, [float(x) for x in rng.normal(size=20) + (3 if i % 4 else 0)]) for i in range(300)]
    df = spark.createDataFrame([(i * 10, la, v) for i, la, v in rows], "vec_id long, label int, embedding array<float>")
    want = mined([(r.vec_id, r.label, list(r.embedding)) for r in df.collect()])
    assert {tuple(r) for r in hn.hard_negatives(df, F.col("id") % 50 == 0).collect()} == want


def test_threshold_join():
    rng = np.random.default_rng(1)
    for _ in range(60):
        d, a, m = int(rng.choice([0, 1, 8, 17, 64])), int(rng.integers(1, 20)), int(rng.integers(0, 60))
        q, x = rng.integers(-50, 50, (a, d)).astype(float), rng.integers(-50, 50, (m, d)).astype(float)
        least = np.floor(rng.normal(0, 1, a) * 800 * d**0.5)
        got = list(zip(*(z.tolist() for z in hn.tiles(q, x, least)), strict=True))
        assert sorted(got) == [(i, j, float(s)) for i in range(a) for j in range(m) if (s := (q[i] * x[j]).sum()) >= least[i]]


def runs_of(w, least=12):
    """(start, period, length) of every run by comparing each place with the one a period later."""
    n, out = len(w), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            if j + p - i >= max(least, 2 * p):
                out.setdefault((i, j + p - i), p)
            i = max(j, i + 1)
    return sorted((s, p, n) for (s, n), p in out.items())


def test_periodic_runs_and_extensions():
    rng = random.Random(1)
    for _ in range(150):
        texts = []
        for _ in range(rng.randint(1, 6)):
            n, k = rng.choice([0, 1, 5, 13, 40, 200]), rng.choice([1, 2, 3, 10])
            w = [rng.randrange(k) for _ in range(n)]
            if n > 20 and rng.random() < 0.5:
                a = rng.randrange(n)
                p = 1 + (n - a) // (3 + rng.randrange(8))
                w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
            texts.append(w)
        sizes, words = np.array([len(x) for x in texts]), np.array([x for t in texts for x in t], dtype=np.int64)
        of, start, length, period = find_runs(words, sizes)
        for t, w in enumerate(texts):
            assert list(zip(start[of == t].tolist(), period[of == t].tolist(), length[of == t].tolist(), strict=True)) == runs_of(w)
        if len(words) < 3:
            continue
        owners = np.repeat(np.arange(len(sizes)), sizes)
        symbols = np.unique(owners * 100 + words, return_inverse=True)[1]
        a = np.array([rng.randrange(len(words) - 1) for _ in range(30)])
        b = np.array([rng.randrange(x + 1, len(words)) for x in a])
        grammar = Grammar(symbols, owners)
        for step in (1, -1):
            for x, y, got in zip(a.tolist(), b.tolist(), grammar.extensions(a, b, step).tolist(), strict=True):
                n = 0
                while 0 <= x + step * n and y + step * n < len(words) and symbols[x + step * n] == symbols[y + step * n]:
                    n += 1
                assert n == got


def test_run_digests(spark, clashing, edge_rows):
    rows = edge_rows[:5] + edge_rows[8:] + [(i, " ".join(f"w{j * j % 7}" for j in range(i * 11))) for i in range(20, 60)] + [(70, "a " * 300), (71, "a\tb\n" * 40 + "É x É x É x É x É x É x É")]
    docs = clashing(rows)
    got = sorted((tuple(r) for r in run_digests(docs).collect()), key=repr)
    want = []
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h, n = zlib.crc32(str(i).encode()) if i is not None else 1, len(w)
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            w = [w[j] if j < a else w[a + (j - a) % p] for j in range(n)]
        runs = runs_of(w)
        gone = {j for s, p, n in runs for j in range(s + p, s + n)}
        best = min(((-n, s, p) for s, p, n in runs), default=None)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        shown = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
        want.append((i, len(runs), *shown, sha("".join(f"{s},{n},{p}\n" for s, p, n in runs)), sha(" ".join(x for j, x in enumerate(w) if j not in gone))))
    assert got == sorted(want, key=repr)
    kept = collapse_runs(docs)
    assert set(docs.columns) < set(kept.columns) and kept.columns[-2:] == ["runs", "text"]
    assert collapse_runs(docs.limit(0)).isEmpty()
    long = spark.createDataFrame([(1, " ".join(str(i * i % 1009) for i in range(6000)))], "doc_id long, text string")
    assert pytest.approx(1009, abs=0) == collapse_runs(long).first()["runs"][0]["period"]
