"""The pipeline against plain versions of its stages, each on its own input."""


import pytest
import samples
import test_decontaminate
import test_quality_rules
import test_simhash
import test_suffix_dedup
import tiktoken
from conftest import SF_DIR, rows

import corpus_pipeline
from pipekit.llm import bpe, quality_rules as qr


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents small enough for plain versions: copies, near copies, passages and test items."""
    out = tmp_path_factory.mktemp("tables")
    item = " ".join(f"item{i}" for i in range(12))
    shared = " ".join(f"passage{i}" for i in range(40))
    text = lambda i, n=70: " ".join(f"d{i}w{j * j}" for j in range(n))
    texts = [text(0), text(0), text(1) + " " + item, text(2) + " " + shared, text(3) + " " + shared, "short", None, ""]
    texts += [text(4), text(4).replace("d4w0 ", "d4x0 ", 1), "line again\n" * 60, text(5, 3000)]
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)] + [(None, text(9), None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(1, item.upper())], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return str(out)


def expected(texts):
    """Text by id after each stage."""
    docs = dict(texts)
    good = lambda t: test_quality_rules.expected(t, qr.MIN_REPEAT, qr.MAX_COVERED, qr.MAX_LONGEST)[-1]
    docs = {i: t for i, t in docs.items() if len(samples.plain_words(t)) > 1000 or good(t)}
    yield docs
    ids = sorted(docs, key=lambda i: (i is None, i))
    roots = test_simhash.grouped([test_simhash.expected(docs[i]) for i in ids])
    docs = {ids[r]: docs[ids[r]] for r in set(roots)}
    yield docs
    cut = test_suffix_dedup.expected(list(docs.values()))
    docs = {i: kept.decode(errors="ignore") for i, (_, _, kept) in zip(docs, cut)}
    yield docs
    items = [(1, " ".join(f"item{i}" for i in range(12)))]
    docs = {i: t for i, t in docs.items() if not test_decontaminate.expected(t, items, 10)[1]}
    yield docs


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    source, columns = [(r.doc_id, r.text) for r in docs.collect()], docs.columns
    wanted = expected(source)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        want = next(wanted)
        assert docs.columns == columns
        assert {r.doc_id: r.text for r in docs.collect()} == want, name
        assert docs.count() == len(want)
        assert all(r.n_chars in (None, len(r.text)) for r in docs.collect())
    assert {0, 3, 4, 11, None} <= set(want) and {1, 2, 5, 10} & set(want) == set()
    last = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    library = tiktoken.Encoding("x", pat_str=corpus_pipeline.public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(corpus_pipeline.public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    assert {r.doc_id: r.ids for r in last.collect()} == {i: library.encode_ordinary(t) for i, t in want.items()}
    assert rows(corpus_pipeline.run(spark, folder), "doc_id", "n_tokens") == rows(last, "doc_id", "n_tokens")
    assert all(r.round_trip for r in last.collect())


def test_empty_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        assert docs.count() == 0, name


def test_whole_table(spark):
    found = corpus_pipeline.run(spark, SF_DIR)
    assert found.count() > 100 and found.where("NOT round_trip").count() == 0
