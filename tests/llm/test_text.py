import math
import zlib
from collections import Counter, defaultdict

import public_tokenizers as tokenizers
import numpy as np
import pytest

from coplex.llm import byte_bpe, lm_scoring, packing, quality_mil, quality_rules
from coplex.llm.html_text import Page, extract_text

RANKS, WORDS = tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.path("word_bpe_49k.json")


def test_byte_bpe(make, edge_rows):
    import tiktoken

    tokens = byte_bpe.read_ranks(RANKS)
    library = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks={x: i for i, x in enumerate(tokens)}, special_tokens={})
    want = Counter((i, tuple(library.encode_ordinary(t or ""))) for i, t in edge_rows)
    encoded = byte_bpe.encode(make(edge_rows), RANKS, tokenizers.PATTERN)
    assert Counter((r.doc_id, tuple(r.ids)) for r in encoded.collect()) == want
    back = byte_bpe.decode(encoded, RANKS, tokenizers.PATTERN)
    assert Counter((r.doc_id, bytes(r["data"])) for r in back.collect()) == Counter((i, (t or "").encode()) for i, t in edge_rows)
    digests = byte_bpe.encode_digests(make(edge_rows), RANKS, tokenizers.PATTERN).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in digests) == Counter((i, len(ids)) for (i, ids), n in want.items() for _ in range(n))
    assert byte_bpe.encode_digests(make([]), RANKS, tokenizers.PATTERN).collect() == []


def test_perfect_hash():
    keys = [f"k{i}".encode() for i in range(2000)]
    table = byte_bpe.PerfectHash(keys)
    assert [table.find(k) for k in keys] == list(range(2000)) and table.find(b"other") == -1
    assert sorted(table.keys) == sorted(keys)


def test_packing(make, edge_rows):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(WORDS)
    odd = ["Hello, World! it's. x.'s <|endoftext|> foo<|endoftext|>bar, <|ENDOFTEXT|>! <|StartOfText|>.", "a\x0bb\x0cc\rd\te\nf  ", "\x1c a\x1db\x85c\u3000d\xa0e", "e\u0301, E\u0301. \u0301 a \u0301b ...!? 12.5, 3.", "\u0130! \u0130X, \u017f. \u212a, \u01c5."]
    rows = edge_rows + [(100 + i, "alpha beta " * i) for i in range(60)] + [(200 + i, x) for i, x in enumerate(odd)]
    got = packing.pack(make(rows), WORDS).collect()
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append(r)
    padding = total = 0
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert 0 < at <= 4096
        total += at
        padding += 0 if at & (at - 1) == 0 else 4096 - at
    assert padding <= 0.05 * total
    want = Counter()
    for i, t in rows:
        ids = [*model.encode(t or "", add_special_tokens=False).ids, 2]
        want[(i, len(ids))] += len(ids)
    have = Counter()
    for r in got:
        have[(r.doc_id, r.doc_tokens)] += r.length
    assert have == want
    whole = {i: [*model.encode(t or "", add_special_tokens=False).ids, 2] for i, t in rows if i and i > 99}
    for r in got:
        if r.doc_id in whole:
            assert r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in whole[r.doc_id][r.start : r.start + r.length]))
    assert packing.pack(make([]), WORDS).collect() == []


def test_cuts():
    for n in (*range(1, 300), 2047, 2048, 2049, 4095, 4096, 4097, 100_000):
        at = 0
        for start, length, k in packing.cuts(n):
            assert start == at and k * length <= 4096
            at += length
        assert at == n


def test_lm_scores(make, edge_rows):
    rows = edge_rows + [(1000 + i, f"the cat {i % 7} sat on the mat and the dog ran") for i in range(60)]
    got = lm_scoring.lm_scores(make(rows), RANKS, tokenizers.PATTERN, block_bytes=2000).collect()
    assert len(got) == len(rows)
    words = [[*(x.decode() for x in (t or "").encode().lower().split()), "\0"] for _, t in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    count = Counter(x for own, h in zip(words, held) if not h for x in own)
    n, v = sum(count.values()), len(count)
    want = Counter((i, h, len(own), sum(x in count for x in own), n, round(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in own), 4)) for (i, _), h, own in zip(rows, held, words))
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    assert all(r.score < 0 for r in got)
    out = [r for r in got if r.held_out and r.doc_id > 999]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
    assert lm_scoring.lm_scores(make([]), RANKS, tokenizers.PATTERN).collect() == []


def test_lm_counts_do_not_depend_on_splits(spark, make):
    # as a block read in several splits gives: runs of one block in more than one task
    rows = [(1000 + i, f"the cat {i % 7} sat on mat {i * i} and the dog ran {'x' * (i % 50)}{i}") for i in range(3000)]
    want = {tuple(r)[:6] for r in lm_scoring.lm_scores(make(rows), RANKS, tokenizers.PATTERN).collect()}
    small = {"spark.sql.files.maxPartitionBytes": "8192", "spark.sql.files.openCostInBytes": "1", "parquet.block.size": "4096", "parquet.page.size": "1024", "spark.sql.files.minPartitionNum": "64"}
    before = {k: spark.conf.get(k, None) for k in small}
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
            hadoop.set(k, v)
        got = {tuple(r)[:6] for r in lm_scoring.lm_scores(make(rows).coalesce(1), RANKS, tokenizers.PATTERN).collect()}
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
            hadoop.unset(k)
    short = lambda found: {(*r[:5], round(r[5], 6)) for r in found}
    assert short(got) == short(want)


def test_lm_learns_from_every_document(spark, make):
    # the same words in another order, but for the 400 documents of least hash: counts of words and ids stay
    from pyspark.sql import functions as F

    held = [i for i in range(1000) if zlib.crc32(str(i).encode()) % 7 == 2]
    first = {r.id for r in spark.range(1000).filter(~F.col("id").isin(held)).orderBy(F.xxhash64("id", F.lit(1))).limit(400).collect()}
    line = "one red fox jumps over two lazy dogs near some old river bank".split()
    asked = held[0]
    text = lambda i, turned: " ".join((line[::-1] if i == asked or turned and i not in first else line) * 3)
    scores = []
    for turned in (False, True):
        got = lm_scoring.lm_scores(make([(i, text(i, turned)) for i in range(1000)]), RANKS, tokenizers.PATTERN).collect()
        scores.append(next(r for r in got if r.doc_id == asked))
    assert scores[0].base_score == pytest.approx(scores[1].base_score)
    assert scores[1].score > scores[0].score + 1


def test_lm_learns_from_whole_texts(make, monkeypatch):
    # every id of every training text, of long ones and those beside them too, is among what vectors and classes are made of
    long = " ".join(f"word{i % 977} item{i * i % 7919}" for i in range(20_000))
    rows = [(i, long[i:] if i % 9 == 0 else f"{i} " * (i % 40) + "Zebra crossings near old river banks " * (i % 30)) for i in range(60)] + [(None, None), (60, "")]
    found, new_model = [], lm_scoring.new_model
    monkeypatch.setattr(lm_scoring, "new_model", lambda total, count, subwords: (found.append((total, count, subwords)), new_model(total, count, subwords))[1])
    lm_scoring.lm_scores(make(rows), RANKS, tokenizers.PATTERN).collect()
    (total, count, subwords), want = found[0], Counter()
    for i, t in rows:
        if i is None or zlib.crc32(str(i).encode()) % 7 != 2:
            ids = subwords.model.encode_ordinary("".join(f" {x}" for x in (t or "").lower().split()))
            assert t is not long or len(ids) > lm_scoring.NEAR_IDS
            want += Counter([subwords.end, *ids, subwords.end])
    assert {i: n for i, n in enumerate(count.tolist()) if n} == want
    assert set(np.flatnonzero(total.any(1)).tolist()) == set(want)


def test_neighbours_against_brute_force():
    rng = np.random.default_rng(4)
    code = rng.normal(size=(12, lm_scoring.CODE)).astype(np.float32)
    sequences = [np.array([10, *rng.integers(0, 9, n), 10]) for n in (0, 1, 70, 3, 200)]
    total, count, want = np.zeros((3 * lm_scoring.CODE, 12)), np.zeros(12, np.int64), np.zeros((3, 12, lm_scoring.CODE))
    lm_scoring._add_neighbours(sequences, code, total, count)
    for s in sequences:
        for i, x in enumerate(s):
            around = s[max(0, i - 20) : i + 21]
            want[0, x] += 3 * code[around].sum(0) / len(around)
            want[1, x] += code[s[i - 1] if i else 10]
            want[2, x] += code[s[i + 1] if i + 1 < len(s) else 10]
    assert total == pytest.approx(np.concatenate([x.T for x in want]), abs=1e-3)
    assert count.tolist() == np.bincount(np.concatenate(sequences), minlength=12).tolist()


def test_own_words_of_each_text():
    texts = [[4, 4, 1], [], [1], [4, 1, 1, 1, 2]]
    got = lm_scoring._repeats(np.array(sum(texts, [])), np.array([len(x) for x in texts]))
    assert got.tolist() == [x.count(i) for x in texts for i in x]


def test_windows_score_each_id_once():
    import numpy as np

    inputs, targets, scored = lm_scoring.windows([np.arange(1, 40), np.arange(50, 53)], 99)
    seen = [t for row, s in zip(targets, scored) if s for t in row if t != 99]
    assert seen == [*range(2, 40), 51, 52] and inputs.shape == targets.shape


def test_quality_mil(spark):
    rows, labels = [], []
    for i in range(400):
        bad = i % 3 == 0
        rows.append((i, ("*** &&& %%% " if bad else "a quiet sentence of plain words. ") * (1 + i % 40)))
        labels.append((i, 0 if bad else 1))
    rows += [(1000, None), (1001, ""), (None, "text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([*labels, (5, None), (None, 1), (7, 9)], "doc_id long, quality int")
    got = quality_mil.quality_scores(docs, quality_mil.fit_quality(docs, marks)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    known = dict(labels)
    out = [r for r in got if r.held_out and r.doc_id in known]
    assert out and sum(r.predicted == known[r.doc_id] for r in out) >= 0.95 * len(out)
    empty = quality_mil.fit_quality(docs.limit(0), marks)
    assert quality_mil.quality_scores(docs.limit(0), empty).collect() == []
    assert len(quality_mil.with_quality(docs.withColumnRenamed("doc_id", "score"), empty, "score").columns) == 2


def test_quality_rules(make, edge_rows):
    good = [(100 + i, f"This is document number {i} with quite some ordinary words in a row for once.") for i in range(40)]
    bad = [(200, "* # % & * # % & * # % & * # % & words"), (201, "echo " * 50), (202, "few words")]
    rows = edge_rows + good + bad
    got = quality_rules.quality_rules(make(rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        text = next(t or "" for i, t in rows if i == r.doc_id and len((t or "").split()) >= 0)
        if [i for i, _ in rows].count(r.doc_id) == 1:
            words = [x.decode() for x in text.encode().split()]
            grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
            hit = {i + k for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for k in range(5)}
            assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(words), sum(map(len, words)), len(hit))
            assert r.base_failed == (len(words) < 10 or 100 * len(hit) > 20 * len(words))
    kept = {r.doc_id: r.kept for r in got}
    assert all(kept[i] for i, _ in good) and not any(kept[i] for i in (200, 201, 202, 3, 4))
    assert quality_rules.quality_rules(make([])).collect() == []


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("", ""),
        ("<p>a &lt;b&gt;&nbsp; c<p>d", "a <b> c\n\nd"),
        ("<nav><a href=x>m</a></nav><article><h1>T</h1><p>x<br>y</p><div class='ad'>z</div><form>f</form></article><footer>g</footer>", "T\n\nx y"),
        ("<div class='cookie-notice'>n</div><p>one</p><!-- c --><script>var a='</p>'</script><ul><li>i<li>j</ul><div id=comments><p>no</p></div>", "one\n\ni\n\nj"),
        ("<body><header>H</header><main><header><h1>Title</h1></header><p>t</p></main><aside>s</aside>", "Title\n\nt"),
    ],
)
def test_page(html, text):
    assert Page(html).text(set()) == text


def test_templates(spark):
    pages = [(i, "http://h.org/" + str(i), f"<body><div><p>Same on all pages of this host.</p></div><p>Own words of page {i}.</p></body>") for i in range(30)]
    pages += [(100, None, None), (101, "http://other.org/", "<div><p>Same on all pages of this host.</p></div>")]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, templates string")
    got = {r.page_id: r for r in extract_text(df).collect()}
    assert got[3].text == "Own words of page 3." and got[100].text == "" and got[101].text == "Same on all pages of this host."
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert extract_text(df.limit(0)).collect() == []


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<div class='layout has-sidebar'><article><p>a b</p></article></div>", "a b"),
        ("<div class='sidebar'><article><p>a b c d</p></article></div><p>x</p>", "a b c d"),
        ("<article><p class=notice>n</p><section id=related-work><p>r</p></section><div class=share-text>s</div><p class=share>t</p></article>", "n\n\nr\n\ns\n\nt"),
        ("<article><p>long text of it</p></article><div class=related><article><p>teaser</p></article></div>", "long text of it"),
        ("<div class=widget><p>nearly the whole text of a page</p></div><p>x</p>", "nearly the whole text of a page\n\nx"),
        ("<p>See <a href=x>the many things that are listed here</a></p><p>y</p>", "See the many things that are listed here\n\ny"),
        ("<div class='site-footer'>f</div><p>one two</p><div class='ad-left'>a</div>", "one two"),
    ],
)
def test_names_do_not_drop_the_article(html, text):
    assert Page(html).text(set()) == text


def test_templates_of_small_hosts_and_layouts(spark):
    # 9 pages with a sidebar on all; 90 pages with three layouts; 12 copies of one page among 30
    side = "<div><p>Same on pages of this host, number {}.</p></div>"
    page = lambda i, k: (i, f"http://h{k}.org/{i}", f"<body>{side.format(i % 3 if k == 2 else 0)}<p>Own words of page {i}.</p></body>")
    pages = [page(i, 1) for i in range(9)] + [page(100 + i, 2) for i in range(90)]
    pages += [(300 + i, f"http://h3.org/{i}", f"<body><p>A text that has {'copies' if i < 12 else i}.</p></body>") for i in range(30)]
    got = {r.page_id: r.text for r in extract_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Own words of page {i}." for i in [*range(9), *range(100, 190)])
    assert got[300] == "A text that has copies." and got[320] == "A text that has 20."


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<a " * 300_000, None),
        ('<a"' * 300_000, None),
        ("<i><h2>x" * 100_000, "\n\n".join(["x"] * 100_000)),
        ("<i>" * 200_000 + "x", "x"),
        ("<b><div>" + "<i>" * 100_000 + "</b>" * 100_000, ""),
        ("<a " + "a" * 1_000_000 + " b=c>x", "x"),
        ("&#" + "9" * 10_000 + ";", "�"),
        ("&#" + "0" * 10_000 + "65;&#x" + "0" * 9_000 + "42;", "AB"),
    ],
)
def test_parsing_takes_linear_time(html, text):
    import time

    began = time.thread_time()
    got = Page(html).text(set())
    assert time.thread_time() - began < 10
    assert got == (" ".join(html.split()) if text is None else text)


def test_inline_elements_are_no_templates(spark):
    page = lambda i: (i, "http://i.org/x", f"<article><p>First line {i}<br>second line {i}</p><p>Price: <b>free</b> for <span class=x>plan</span> {i}.</p></article><div>On <em>every</em> page</div>")
    got = {r.page_id: r.text for r in extract_text(spark.createDataFrame([page(i) for i in range(30)], "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"First line {i} second line {i}\n\nPrice: free for plan {i}." for i in range(30))


def test_templates_against_brute_force(spark):
    from coplex.llm import html_text as H

    rng, pages = np.random.default_rng(3), []
    for i in range(120):
        host = f"h{i % 4}.org"
        parts = [f"<div><p>part {k} of {host}</p></div>" for k in rng.choice(8, 3, replace=False)]
        pages.append((i, f"http://{host}/{i}", f"<body>{''.join(parts)}<p>own {i}</p></body>"))
    got = H.templates(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    counts, sizes = defaultdict(Counter), Counter()
    for _, url, source in pages:
        host = url.split("/")[2]
        sizes[host] += 1
        counts[host].update(Page(source).subtrees())
    for r in got:
        often = {h for h, n in counts[r.host].items() if n >= H.LEAST_PAGES and n > H.OUTER_RATIO * sizes[r.host]}
        strict = {h for h in often if counts[r.host][h] > H.RATIO * sizes[r.host]}
        assert set(r.templates) == strict and set(r.common) == often - strict
    assert {r.host for r in got} == set(sizes)


def test_gated_attention_against_brute_force():
    rng = np.random.default_rng(1)
    texts = [bytes(rng.integers(32, 127, n, dtype=np.uint8)) for n in (0, 1, 479, 480, 481, 3000)]
    x, counts = quality_mil.encode_passages(texts)
    model = quality_mil.fit(np.concatenate([x, x]), np.concatenate([counts, counts]), np.array([0, 1] * len(texts), np.float32))
    got, w, at = model.score(texts), model.weights, 0
    for score, n in zip(got, counts):
        rows = np.clip((x[at : at + n] - model.mean) / model.scale, -6, 6)
        h = [np.tanh(r @ w["W"] + w["b"]) for r in rows]
        logit = [float((np.tanh(v @ w["V"]) / (1 + np.exp(-(v @ w["U"])))) @ w["g"]) for v in h]
        share = np.exp(np.array(logit) - max(logit))
        z = sum(a * v for a, v in zip(share / share.sum(), h))
        assert score == pytest.approx(1 / (1 + np.exp(-(z @ w["o"] + w["c"]))), abs=1e-4)
        at += n


def test_model_scores_against_brute_force():
    # every position attends to what stands before it in its window, one at a time
    rng = np.random.default_rng(2)

    class Few:
        size, end, pad = 42, 40, 41
        start = np.ones(42, bool)

    model = lm_scoring.new_model(rng.normal(size=(42, 3 * lm_scoring.CODE)).astype(np.float32), np.ones(42), Few)
    model.share = lm_scoring.shares(rng.integers(0, 9, 42).astype(float), model.class_of, Few.end)
    model.weights["bias"] = rng.normal(size=2 * lm_scoring.HALF).astype(np.float32)
    sequences = [np.array([40, *rng.integers(0, 40, n), 40]) for n in (0, 1, 7, 8, 9, 30)]
    got, want, d, half = model.log_probabilities(sequences, model.inner()), [], lm_scoring.DIM, lm_scoring.HALF
    for s in sequences:
        for i in range(len(s) - 1):
            low = max(0, (i // half - 1) * half)
            made = model.vectors[s[low : i + 1]] @ model.weights["W"]
            q, k, v, r = made[-1, :d], made[:, d : 2 * d], made[:, 2 * d : 3 * d], made[-1, 3 * d :]
            a = np.exp(np.minimum(k @ q + model.weights["bias"][np.arange(len(made))[::-1]], 60))
            logits = np.tanh(np.concatenate([(a @ v) / a.sum(), r])) @ model.weights["O"] + model.weights["c"]
            goal = s[i + 1]
            want.append(logits[model.class_of[goal]] - np.log(np.exp(logits).sum()) + model.share[goal])
    assert got == pytest.approx(np.array(want), abs=1e-3)


def few_model(rng):
    class Few:
        size, end, pad = 42, 40, 41
        start = np.ones(42, bool)

    model = lm_scoring.new_model(rng.normal(size=(42, 3 * lm_scoring.CODE)).astype(np.float32), np.ones(42), Few)
    model.weights["bias"] = rng.normal(size=2 * lm_scoring.HALF).astype(np.float32)
    model.weights["c"] = rng.normal(size=lm_scoring.CLASSES).astype(np.float32)
    return model


def test_step_follows_the_slope():
    # one step's slope against differences of the mean loss, by scores of the same sequences
    rng = np.random.default_rng(5)
    model = few_model(rng)
    sequences = [np.array([40, *rng.integers(0, 40, n), 40]) for n in (0, 9, 70, 3)]
    trainer = lm_scoring.Trainer(model, 0.0)
    trainer.learn(sequences, rng)
    assert trainer.steps == 1
    slope, flat = trainer.mean / np.float32(0.1), trainer.flat.astype(np.float64)

    def loss(x):
        model.weights = lm_scoring.shaped(x, model.weights)
        return -model.log_probabilities(sequences, model.inner()).mean()

    for _ in range(40):
        way = rng.normal(size=len(flat)) * (rng.random(len(flat)) < 0.1)
        want = (loss(flat + 1e-4 * way) - loss(flat - 1e-4 * way)) / 2e-4
        assert float(slope @ way) == pytest.approx(want, rel=2e-2, abs=2e-3)


def test_blocks_words_travel_by_bucket(monkeypatch):
    # a block's words take a row for each bucket, and totals tell the others' counts
    import types

    import pyarrow as pa

    monkeypatch.setattr(lm_scoring, "TaskContext", types.SimpleNamespace(get=lambda: types.SimpleNamespace(partitionId=lambda: 0)))
    rows = [("w" + " ".join(f"W{i * j}" for i in range(3000)), j % 3 > 0) for j in range(1, 5)] + [(" \t", True), ("", True), ("é   É É", True)]
    table = pa.table({"doc_id": range(len(rows)), "text": [x for x, _ in rows], "train": [x for _, x in rows], "first": [True] * len(rows)})
    made = pa.Table.from_batches(lm_scoring._code(types.SimpleNamespace(value=byte_bpe.read_ranks(RANKS)), tokenizers.PATTERN, 20_000)(iter(table.to_batches(max_chunksize=1)))).to_pylist()
    blocks = {r["block"] for r in made if r["lengths"]}
    assert len(blocks) > 2
    found = [r for r in made if r["id"] is None and r["lengths"] is None and r["sequence"] is None and r["train"] is None]
    assert len(found) <= len(blocks) * 1024
    assert len({(r["block"], r["bucket"]) for r in found}) == len(found)
    counts, held = Counter(), Counter()
    by_bucket = defaultdict(list)
    for r in found:
        by_bucket[r["bucket"]].append(r)
        for x, n in zip(r["words"].split(" "), np.frombuffer(r["counts"], np.int64).tolist(), strict=True):
            counts[x] += n
            held[r["block"], np.frombuffer(r["numbers"], np.int32)[r["words"].split(" ").index(x)]] = (x, n)
    assert {x: n for x, n in counts.items() if n} == Counter(w.decode() for x, train in rows if train for w in x.encode().lower().split())
    n = v = 0
    told = {}
    for some in by_bucket.values():
        out = lm_scoring._totals(pa.Table.from_pylist(some)).to_pylist()
        n, v = n + out[-1]["n"], v + out[-1]["v"]
        for r in out[:-1]:
            told |= {(r["home"], i): c for i, c in zip(np.frombuffer(r["numbers"], np.int32).tolist(), np.frombuffer(r["counts"], np.int64).tolist(), strict=True)}
    assert n == sum(counts.values()) and v == sum(x > 0 for x in counts.values())
    assert told == {k: counts[x] for k, (x, own) in held.items() if counts[x] > own}
