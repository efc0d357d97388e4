"""Decontamination against a plain version."""

import random

import pytest
import samples
from conftest import rows

from pipekit.llm import decontaminate


def expected(text, items, window):
    words, hit, found = samples.licence_words(text), set(), set()
    for item, of in items:
        own = samples.licence_words(of)
        size = min(window, len(own))
        for i in range(len(own) - size + 1 if own else 0):
            for at in range(len(words) - size + 1):
                if words[at : at + size] == own[i : i + size]:
                    hit.update(range(at, at + size))
                    found.add("" if item is None else str(item))
    return len(words), len(hit), sorted(found), hit


def data():
    r = random.Random(4)
    words = [f"w{i}" for i in range(12)] + ["É", "Ü1"]
    say = lambda n: r.choice([" ", ", ", "-"]).join(r.choice(words) for _ in range(n))
    items = [(i, say(r.randint(0, 14))) for i in range(20)] + [(3, "W1 w2 w3"), (None, "É"), (30, None), (31, "zz w1 w2 w3 w4")]
    texts = [None, "", "zz", "...", *[say(r.randint(1, 200)) for _ in range(30)]]
    texts += [f"{say(9)} {text} {say(9)}" for _, text in items if text] + ["ZZ,w1 W2 w3 w4", "w1 " * 5000]
    return items, texts


@pytest.mark.parametrize("block_bytes", [8 * 1024 * 1024, 300])
def test_words_hit(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block_bytes)
    items, texts = data()
    benchmark = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id int, text string, item string")
    found = decontaminate.contamination(samples.frame(spark, texts), benchmark, window=6).collect()
    assert len(found) == len(texts) + 2
    for row in found:
        n, n_hit, names, hit = expected(texts[-1 if row.doc_id is None else row.doc_id], items, 6)
        assert (row.n_words, row.n_hit, sorted(row["items"])) == (n, n_hit, names)
        spans = [(s.start, s.end) for s in row.spans]
        assert {p for a, b in spans for p in range(a, b)} == hit
        assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))


def test_affected_rows_go(spark):
    items, texts = [(1, "one two three four")], ["x One two, three FOUR y", "one two three", None, ""]
    df = samples.frame(spark, texts)
    benchmark = spark.createDataFrame(items, "item_id int, text string")
    kept = decontaminate.decontaminate(df, benchmark)
    assert kept.schema == df.schema and rows(kept, "doc_id") == [(None,), (1,), (2,), (3,), (3,)]
    assert decontaminate.decontaminate(df, benchmark.limit(0)).count() == df.count()
    assert decontaminate.contamination(df.limit(0), benchmark).count() == 0


def test_blocks_of_repeated_items_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 300)
    items = [("again", "one two three four five")] * 500 + [(str(i), f"w{i} " * (i % 9)) for i in range(90)]
    items += [("long", "word " * 100), (None, None)]
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    blocks, numbers = decontaminate._blocks(benchmark, "item_id", "text")
    found = {n: [(r["item"], r.text) for r in blocks.where(f"block = {n}").collect()] for n in numbers}
    assert sorted((str(r) for own in found.values() for r in own)) == sorted({str((i or "", t)) for i, t in items})
    assert all(len(own) == 1 or sum(len(i) + len(t or "") for i, t in own) <= 300 for own in found.values())
    assert len(found) < 90


@pytest.mark.parametrize("block_bytes", [8 * 1024 * 1024, 300])
def test_longest_matches_stand_in_their_item(spark, monkeypatch, block_bytes):
    """A match goes on as long as text and item agree, and windows of two items are two matches."""
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block_bytes)
    items, texts = data()
    items += [(40, "p0 p1 p2 p3 p4 p5 p6"), (41, "p5 p6 p7 p8 p9 p10")]
    texts.append("q p0 p1 p2 p3 p4 p5 p6 p7 p8 p9 p10 q")
    want = set()
    for i, text in enumerate(texts):
        words = samples.licence_words(text)
        for item, of in items:
            own = samples.licence_words(of)
            for at in range(len(words)):
                for off in range(len(own)):
                    if words[at] == own[off] and not (at and off and words[at - 1] == own[off - 1]):
                        n = 0
                        while at + n < len(words) and off + n < len(own) and words[at + n] == own[off + n]:
                            n += 1
                        if n >= min(6, len(own)):
                            want.add((i, at, "" if item is None else str(item), off, n))
    df = spark.createDataFrame([*enumerate(texts)], "doc_id int, text string")
    found = decontaminate.matches(df, spark.createDataFrame(items, "item_id int, text string"), window=6).collect()
    assert {tuple(r) for r in found} == want and len(found) == len(want) > 50
    assert {tuple(r)[1:] for r in found if r.doc_id == len(texts) - 1} == {(1, "40", 0, 7), (6, "41", 0, 6)}
    assert decontaminate.matches(df, spark.createDataFrame([], "item_id int, text string")).count() == 0
