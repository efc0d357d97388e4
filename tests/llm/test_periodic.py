"""Periodic runs against a plain version that looks at every lag."""

import hashlib
import random
import zlib

import numpy as np
import samples
from conftest import SF_DIR
from pyspark.sql import functions as F

from pipekit.llm import queries
from pipekit.llm.periodic import mark_runs, periodic_runs


def plain_runs(words):
    n, found = len(words), []
    for q in range(1, n):
        i = q
        while i < n:
            if words[i] != words[i - q]:
                i += 1
                continue
            start = i - q
            while i < n and words[i] == words[i - q]:
                i += 1
            own = words[start:i]
            smaller = any(own[d:] == own[: len(own) - d] for d in range(1, q))
            if len(own) >= max(12, 2 * q) and not smaller:
                found.append((start, len(own), q))
    return sorted(found, key=lambda run: (run[0], run[2]))


def plain_kept(words, runs):
    return [w for k, w in enumerate(words) if not any(s + q <= k < s + n for s, n, q in runs)]


def test_every_lag_of_odd_sequences():
    r = random.Random(3)
    for _ in range(250):
        n, letters, kind = r.choice([0, 11, 12, 13, 30, 60, 140]), r.choice([1, 2, 2, 3, 4]), r.randrange(4)
        word = lambda k: [r.randrange(letters) for _ in range(k)]
        if kind == 0:
            words = word(n)
        elif kind == 1:
            words = (word(r.randint(1, 12)) * n)[:n]
            for _ in range(r.randrange(4) if n else 0):
                words[r.randrange(n)] = r.randrange(letters + 1)
        elif kind == 2:
            words = [w for _ in range(6) for w in word(r.randint(1, 20)) * r.randint(1, 4)]
        else:
            words = ((word(r.randint(1, 6)) * r.randint(2, 6) + [9] * r.randint(0, 2)) * 10)[:n]
        assert periodic_runs(np.array(words, np.int64)) == plain_runs(words), words


def test_long_texts_take_time_in_proportion():
    half = 100_000
    assert periodic_runs(np.zeros(half, np.int64)) == [(0, half, 1)]
    two = np.concatenate([np.zeros(half, np.int64), [1], np.zeros(half, np.int64)])
    assert periodic_runs(two) == [(0, half, 1), (half + 1, half, 1)]
    assert periodic_runs(np.tile(np.arange(half // 2), 4)) == [(0, 2 * half, half // 2)]


def test_rows(spark):
    say = "one two three"
    texts = [*samples.documents(n=25), "ab " * 12, "ab " * 11, f"{say} " * 4, f"x {say}\n{say}\t{say} {say} y {say}"]
    texts = [t if t is None or len(t) < 600 else t[:600] for t in texts]
    df = samples.frame(spark, texts)
    found = mark_runs(df).collect()
    want = [*enumerate(texts), (len(texts) - 1, texts[-1]), (None, texts[-1])]
    assert len(found) == len(want)
    for row, (key, text) in zip(sorted(found, key=lambda r: (r[0] is None, r[0])), want):
        words = samples.plain_words(text)
        runs = plain_runs(words)
        assert (row.doc_id, row.n_words, [tuple(x) for x in row.runs]) == (key, len(words), runs)
        assert row.collapsed == " ".join(plain_kept(words, runs))
    assert mark_runs(df.limit(0)).count() == 0
    assert mark_runs(df.withColumnRenamed("text", "runs"), text="runs").count() == len(want)


def contract(doc, text):
    words = samples.plain_words(text)
    n, h = len(words), zlib.crc32(str(doc).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    digest = lambda text: hashlib.sha256(text.encode()).hexdigest()
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2])) if runs else (None, None, None)
    milli = 1000 * best[1] // best[2] if runs else None
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    return (doc, len(runs), *best, milli, digest(lines), digest(" ".join(plain_kept(words, runs))))


def test_query_against_the_plain_version(spark):
    found = {r.doc_id: tuple(r) for r in queries.QUERIES["op12_periodic_runs"](spark, SF_DIR).collect()}
    documents = spark.read.parquet(f"{SF_DIR}/documents.parquet").where(F.length("text") < 2_500).collect()
    assert sum(found[d.doc_id][1] > 0 for d in documents) > 5
    assert [d.doc_id for d in documents if found[d.doc_id] != contract(d.doc_id, d.text)] == []


def test_planted_rows_with_nulls(spark):
    texts = [None, "", " ", "a", "a b c d e f g h"]
    rows = [(i, t) for i in range(60) for t in texts] + [(None, "a b")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = queries.planted(df).collect()
    assert len(found) == len(rows)
    kept = [(r.doc_id, r.text) for r in found if zlib.crc32(str(r.doc_id).encode()) % 10 or r.doc_id is None or not samples.plain_words(r.text)]
    assert set(kept) <= set(rows)
