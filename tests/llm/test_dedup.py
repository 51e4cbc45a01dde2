import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from coplex.llm import exact_dedup as ed
from coplex.llm import suffix_dedup as sd
from coplex.llm.components import components
from coplex.llm.exact_dedup import exact_dedup, keep_one
from coplex.llm.gsaca import repeated_starts, suffix_array
from coplex.llm.line_dedup import drop_boilerplate_lines
from coplex.llm import ngram_join as nj
from coplex.llm.ngram_join import keep_one_of_class, ngram_classes, paths, recall, shingles


def test_exact_dedup(make, edge_rows):
    got = exact_dedup(make(edge_rows), keep="largest").collect()
    assert len(got) == len(edge_rows)
    groups = defaultdict(list)
    for i, t in edge_rows:
        groups[hashlib.sha256((t or "").encode().lower()).hexdigest()].append(i)
    for r in got:
        own = groups[r.text_sha256]
        assert r.group_size == len(own)
        assert r.keep_id == max((i for i in own if i is not None), default=None)
    assert sum(r.kept for r in got) == len(groups)
    assert exact_dedup(make([])).collect() == []
    first = exact_dedup(make([(1, "a"), (2, "A")])).collect()
    assert {(r.doc_id, r.keep_id, r.kept) for r in first} == {(1, 1, True), (2, 1, False)}


def test_merge_of_runs(monkeypatch, make):
    monkeypatch.setattr(ed, "CHUNK", 3)
    rng = np.random.default_rng(3)
    runs = [sorted((hashlib.sha256(bytes([x])).digest(), 1, int(rng.integers(-5, 5)), int(rng.integers(99)), 1) for x in rng.integers(0, 40, n)) for n in (0, 1, 7, 50, 200)]
    chunks = sorted((x[0][0], np.array(x, ed.ENTRY).tobytes()) for run in runs for x in (run[i : i + 3] for i in range(0, len(run), 3)))
    assert list(ed._merge(chunks)) == sorted(x for run in runs for x in run)
    for largest in (False, True):
        groups = defaultdict(list)
        for e in (e for run in runs for e in run):
            groups[e[0]].append(e)
        want = [(d, 1, *min(((e[2], e[3]) for e in own), key=lambda x: (-x[0] if largest else x[0], x[1])), len(own)) for d, own in sorted(groups.items())]
        assert list(ed._fold(ed._merge(chunks), largest)) == want
    # many runs, one text with most rows: every row is told, whatever the partitions
    rows = [(i, "hot" if i % 3 else f"text {i % 60}") for i in range(900)]
    for n in (1, 40):
        got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup(make(rows).repartition(n), keep="largest").collect()}
        last, size = {t: i for i, t in rows}, Counter(t for _, t in rows)
        assert got == {(i, last[t], size[t], i == last[t]) for i, t in rows}


def test_keep_one(make, edge_rows):
    docs = make(edge_rows)
    got = keep_one(docs, keep="largest")
    assert got.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in got.collect()) == sorted((i or 0, t or "") for i, t in {(hashlib.sha256((t or "").encode().lower()).hexdigest()): (i, t) for i, t in edge_rows}.values())


def test_components(spark):
    edges = [(i + 1, i) for i in range(40)] + [(100, 101), (101, 102), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def brute(rows):
    def runs(text):
        words = (text or "").encode().lower().split()
        return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()

    sets = [runs(t) for _, t in rows]
    links, part = [0] * len(rows), list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            if i != j and a and b and len(a & b) / len(a | b) >= 0.8:
                links[i] += 1
                if part[i] != part[j]:
                    old, new = max(part[i], part[j]), min(part[i], part[j])
                    part = [new if x == old else x for x in part]
    return links, part


def test_ngram_join(make, edge_rows):
    base = [f"w{i * 7 % 101}x{i}" for i in range(200)]
    near = [" ".join(base[:k] + ["changed"] + base[k + 1 :]) for k in range(0, 200, 20)]
    rows = edge_rows + [(100 + i, t) for i, t in enumerate(near)] + [(200, near[0]), (300, " ".join(base[:100])), (301, "a b c"), (302, "A b  c")]
    got = ngram_classes(make(rows)).collect()
    links, part = brute(rows)
    assert Counter((r.doc_id, r.n_links) for r in got) == Counter((i, n) for (i, _), n in zip(rows, links))
    least = defaultdict(list)
    for (i, _), p in zip(rows, part):
        least[p].append(i)
    want = Counter((i, min((x for x in least[p] if x is not None), default=None)) for (i, _), p in zip(rows, part))
    assert Counter((r.doc_id, r.class_id) for r in got) == want
    assert ngram_classes(make([])).collect() == []
    kept = keep_one_of_class(make(rows))
    assert kept.columns == make([]).columns
    assert {r.doc_id for r in kept.collect()} >= {100, 300, 301, None, 3, 4} and not {r.doc_id for r in kept.collect()} & {101, 200, 302}


def test_keep_one_of_class_goes_by_row(spark):
    w = " ".join(f"w{i}" for i in range(50))
    rows = [(1, w, "a"), (2, w, "b"), (2, "another text of more than five words", "c"), (1, w, "d"), (None, w, "e"), (None, None, "f"), (None, "", "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `row` string").withColumnRenamed("row", "a.row").withColumns({"row": F.lit(1), "class": F.lit("x"), "node": F.lit(None).cast("string")})
    got = keep_one_of_class(docs)
    assert got.columns == docs.columns
    kept = sorted(r["a.row"] for r in got.collect())
    assert kept in (["a", "c", "f", "g"], ["c", "d", "f", "g"])
    assert keep_one_of_class(docs.limit(0)).collect() == []


def test_ngram_blocks_and_levels(make, monkeypatch):
    # many small blocks, size classes and levels give what brute force does
    monkeypatch.setattr(nj, "BLOCK", (3, 5))
    monkeypatch.setattr(nj, "STRIP", 2)
    monkeypatch.setattr(nj, "COLUMNS", 16)
    words = [f"w{i}" for i in range(160)]
    rows = [(i, " ".join(words[i % 40 :])) for i in range(60)] + [(100 + i, " ".join(words[: 60 + 2 * i])) for i in range(50)] + [(200 + i, " ".join([*words[:80], f"x{i}", *words[81:]])) for i in range(20)]
    got = ngram_classes(make(rows)).collect()
    links, part = brute(rows)
    assert {r.doc_id: r.n_links for r in got} == {i: n for (i, _), n in zip(rows, links)}
    assert {r.doc_id: r.class_id for r in got} == {i: rows[p][0] for (i, _), p in zip(rows, part)}


def test_recall_at_the_threshold():
    rng, found = np.random.default_rng(5), []
    for size in (300, 2000):
        for shared in (0.8, 0.82, 0.85):
            for _ in range(60):
                both, total = round(shared * size), size
                x = rng.integers(0, 2**63, total, dtype=np.uint64)
                own = (total - both) // 2
                a, b = np.unique(x[: both + own]), np.unique(np.concatenate([x[:both], x[both + own :]]))
                p, q = (np.frombuffer(y, ">u2").reshape(nj.TREES, nj.DEPTH) for y in paths([a, b]))
                found.append((p[:, :7] == q[:, :7]).all(1).any())
    assert sum(found) >= len(found) - 1
    assert recall(0.8, 7) >= nj.TARGET_RECALL > recall(0.8, 8)


def test_suffix_array():
    for text in ([], [0], [1, 1, 1, 1], [2, 1, 2, 1, 2], list(b"mississippi"), list(b"abcab" * 9)):
        assert suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])
    assert repeated_starts([b"xabcdx", b"yabcdy", b"zzzzz"], 4) == [[1], [1], [0, 1]]


def removal(rows, length=200):
    data = [(t or "").encode() for _, t in rows]
    count = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((len(b), sum(gone), sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.fixture(scope="module")
def passages():
    word = lambda i: hashlib.md5(str(i).encode()).hexdigest()[: 3 + i % 6]
    run = lambda a, b: " ".join(map(word, range(a, b)))
    shared = run(1000, 1060)
    rows = [(i, run(i * 100, i * 100 + 60) + " " + shared[i : 300 + 3 * i] + " " + run(i * 100 + 60, i * 100 + 90)) for i in range(1, 9)]
    return rows + [(20, "ab" * 300), (21, "z" * 199), (22, run(5000, 5050) + "é" + run(5000, 5050)), (23, run(5000, 5040) + "è"), (24, "same " * 60), (25, "same " * 60)]


@pytest.mark.parametrize(("most", "symbols"), [(50_000, 500_000), (50_000, 400), (3, 400), (0, 0)])
def test_suffix_dedup(make, edge_rows, passages, most, symbols, monkeypatch):
    monkeypatch.setattr(sd, "SYMBOLS", symbols)
    monkeypatch.setattr(sd, "MOST_CONTEXTS", most)  # few split every group as hot ones, 0 down to whole strings
    rows = edge_rows + passages
    got = sd.suffix_dedup(make(rows)).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == Counter((i, *x) for (i, _), x in zip(rows, removal(rows)))


def test_drop_repeats(make, passages):
    got = sd.drop_repeats(make(passages))
    assert got.columns == make([]).columns and got.count() == len(passages)
    want = {i: x for (i, _), x in zip(passages, removal(passages))}
    assert all(r.doc_id in (22, 23) or hashlib.sha256(r.text.encode()).hexdigest() == want[r.doc_id][3] for r in got.collect())
    assert sd.drop_repeats(make([])).collect() == []
    assert sd.suffix_dedup(make([])).collect() == []


def test_line_dedup(make, edge_rows):
    rows = [(i, f"  Menu \nbody {i}\n\nMenu") for i in range(1, 30, 3)] + edge_rows
    got = {(r.doc_id, r.text): (r.n_lines, r.n_dropped) for r in drop_boilerplate_lines(make(rows), "source").collect()}
    assert len(got) <= len(rows) and got[(1, "body 1\n")] == (4, 2)
    assert (3, "") in got and got[(3, "")] == (1, 0)
    assert drop_boilerplate_lines(make([]), "source").collect() == []


def by_hand(rows, ratio, least):
    host = lambda i: "s1" if (i or 0) % 3 else ""
    split = [(host(i), i, (t or "").split("\n")) for i, t in rows]
    pages = Counter(h for h, _, _ in split)
    counts = Counter((h, x) for h, _, lines in split for x in {y.strip(" \t\v\f\r") for y in lines} if x)
    gone = {k for k, n in counts.items() if n >= least and n > ratio * pages[k[0]]}
    out = []
    for h, i, lines in split:
        kept = [x for x in lines if (h, x.strip(" \t\v\f\r")) not in gone]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def test_line_dedup_by_hand(make, edge_rows):
    rows = edge_rows + [(i, "\n".join(f" line {i * j % 23}\t" if j % 4 else "" for j in range(12))) for i in range(10, 50)] + [(1, "a\na\n b"), (4, "a\nb\nc")]
    for rows, ratio, least in ((rows, 0.05, 2), (rows, 0.2, 2), (rows, 0.05, 5), ([(1, "x\ny"), (2, "x\nz")], 0.05, 2), ([(1, "x\ny")], 0.05, 2)):
        got = drop_boilerplate_lines(make(rows), "source", ratio=ratio, least_pages=least)
        assert Counter((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got.collect()) == Counter(by_hand(rows, ratio, least))
