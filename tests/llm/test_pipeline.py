import hashlib
from collections import Counter

import corpus_pipeline
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from coplex.llm.byte_bpe import encode_digests
from coplex.llm.exact_dedup import keep_one
from coplex.llm.line_dedup import drop_boilerplate_lines
from coplex.llm.ngram_join import keep_one_of_class
from coplex.llm.packing import Encoder
from coplex.llm.quality_mil import fit_quality, with_quality
from coplex.llm.suffix_dedup import drop_repeats, suffix_dedup


def words(i, n=120):
    return " ".join(f"w{(i * 7919 + k * k) % 5003}" for k in range(n))


@pytest.fixture
def tables(tmp_path):
    def made(docs, labels):
        docs.write.parquet(str(tmp_path / "documents.parquet"))
        docs.sparkSession.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
        return str(tmp_path)

    return made


def test_pipeline(spark, tables):
    texts = [words(i) for i in range(40)] + [words(0), words(1).upper(), words(2) + " and more", "*** &&& %%% " * 30] + ["### @@@ %%% " * 20 for _ in range(12)]
    shared = " ".join(f"shared{k}" for k in range(60))
    texts += [f"{words(60)} {shared} {words(61)}", f"{words(62)} {shared} {words(63)}"]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    path = tables(docs, [(i, int(i < 43 or i > 55), 0) for i in range(len(texts))])
    got = corpus_pipeline.run(spark, path).collect()
    assert {r.doc_id for r in got} == set(range(3, 40)) | {2, 40, 41, 56, 57}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "n-gram Jaccard join", "suffix-array dedup", "packing"]
    # the pieces are those of the kept texts, without what two of them share
    left = {i: texts[i] for i in {r.doc_id for r in got}}
    data = {i: t.encode() for i, t in left.items()}
    count = Counter(b[i : i + 200] for b in data.values() for i in range(len(b) - 199))
    encode = Encoder(public_tokenizers.path("word_bpe_49k.json"))
    for i, b in data.items():
        gone = bytearray(len(b))
        for at in range(len(b) - 199):
            if count[b[at : at + 200]] > 1:
                gone[at : at + 200] = b"\1" * 200
        kept = bytes(x for x, g in zip(b, gone) if not g).decode()
        assert sum(r.length for r in got if r.doc_id == i) == len(encode(pa.array([kept], pa.large_string()))[0]) + 1
    assert any(count[data[56][i : i + 200]] > 1 for i in range(len(data[56]) - 199))


def test_every_stage_takes_edge_rows(clashing, edge_rows, tables, tmp_path):
    docs = clashing([*edge_rows, *edge_rows[:3]])
    path = tables(docs, [(1, 1, 0), (2, 1, 0), (5, 1, 0), (7, 1, 1), (9, 0, 0), (None, 1, 0)])
    spark = docs.sparkSession
    for rows in (docs, docs.limit(0)):
        now = rows
        for name, stage in corpus_pipeline.STAGES:
            out = str(tmp_path / f"{name}-{rows is docs}")
            stage(spark, now, path).write.parquet(out)
            now = spark.read.parquet(out)
            if name != "packing":
                assert now.columns == docs.columns
        made = now.collect()
        assert bool(made) == (rows is docs)
        assert all(r.length > 0 for r in made)


def test_stages_on_nulls_alone(clashing, tables):
    docs = clashing([(None, None), (None, None), (1, None), (2, "")])
    path = tables(docs, [(1, None, 0)])
    assert len(corpus_pipeline.run(docs.sparkSession, path).collect()) == 1  # all texts are empty, so one row stays


@pytest.mark.parametrize("drop", [keep_one, keep_one_of_class, drop_repeats, lambda d: drop_boilerplate_lines(d, "source").drop("n_lines", "n_dropped"), lambda d: with_quality(d, fit_quality(d, d.select("doc_id", F.lit(1).alias("quality"))), "other").drop("other")])
def test_names_of_columns_do_not_matter(clashing, edge_rows, drop):
    docs = clashing(edge_rows)
    got = drop(docs)
    assert sorted(got.columns) == sorted(docs.columns)
    assert all(r[n] == n for r in got.collect() for n in docs.columns[5:])


def test_ties_of_keep_one(spark):
    rows = [(1, "Text"), (1, "text"), (1, "TEXT"), (0, "text"), (None, "text"), (None, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert {tuple(r) for r in keep_one(docs, keep="largest").collect()} == {(1, "Text"), (None, None)}
    assert keep_one(docs, keep="smallest").count() == 2


def test_digests_of_byte_bpe(make, edge_rows):
    import tiktoken

    from coplex.llm.byte_bpe import read_ranks

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={x: i for i, x in enumerate(read_ranks(path))}, special_tokens={})
    rows = [*edge_rows, (50, "<|endoftext|> it's  x\n\n y"), (51, "a" * 5000)]
    want = Counter()
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        want[(i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())] += 1
    got = encode_digests(make(rows), path, public_tokenizers.PATTERN).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want


def test_repeated_rows_lose_all(clashing):
    docs = clashing([(1, "same " * 60), (1, "same " * 60), (2, None)])
    assert [r.n_removed for r in suffix_dedup(docs).orderBy("doc_id").collect()] == [300, 300, 0]
    assert sorted((r.doc_id, r.text) for r in drop_repeats(docs).collect()) == [(1, ""), (1, ""), (2, None)]
