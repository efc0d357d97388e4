"""Fingerprints, links and components against plain versions."""

import random

import numpy as np
import pyarrow as pa
import pytest
import samples
import xxhash
from conftest import rows

from pipekit.llm import simhash


def expected(text):
    words = samples.plain_words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def grouped(prints):
    """The smallest index of each one's component."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(prints))]


@pytest.mark.parametrize("long", [simhash.LONG, 7])
def test_fingerprints(monkeypatch, long):
    monkeypatch.setattr(simhash, "LONG", long)
    texts = samples.documents()
    found = simhash.fingerprints(pa.array(texts)).view(np.uint64).tolist()
    assert found == [expected(t) for t in texts]


def test_near_duplicates(spark):
    texts = samples.documents()
    prints = [expected(t) for t in texts]
    roots = grouped(prints)
    want = [(i, f"{p:016x}", r) for i, (p, r) in enumerate(zip(prints, roots))]
    want += [want[-1], (None, *want[-1][1:])]
    found = simhash.near_duplicates(samples.frame(spark, texts))
    assert rows(found) == sorted(want, key=lambda r: [(v is not None, str(type(v)), v) for v in r])


@pytest.mark.parametrize("compared", [128, 2])
def test_all_links_within_two_bits(spark, monkeypatch, compared):
    monkeypatch.setattr(simhash, "COMPARED", compared)
    r = random.Random(2)
    prints = {0, 2**64 - 1}
    for _ in range(20):
        p = r.getrandbits(64)
        for _ in range(12):
            prints.add(p)
            for _ in range(r.randint(1, 3)):
                p ^= 1 << r.randrange(64)
    prints |= {1 << i for i in range(64)}
    ordered = sorted(prints)
    want = {(a, b) for a in ordered for b in ordered if a < b and (a ^ b).bit_count() <= 2}
    df = spark.createDataFrame([(np.uint64(p).astype(np.int64).item(),) for p in ordered], "print long")
    found = [tuple(sorted(v % 2**64 for v in row)) for row in simhash.links(df).collect()]
    assert len(found) == len(set(found)) and set(found) == want


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 105), (105, 103), (200, 201)]
    found = simhash.components(spark.createDataFrame(edges, "a long, b long"))
    want = [(i, 0) for i in range(61)] + [(100, 100), (103, 100), (105, 100), (200, 200), (201, 200)]
    assert rows(found) == want


def test_one_row_of_each_group_stays(spark):
    texts = samples.documents()
    roots = grouped([expected(t) for t in texts])
    df = samples.frame(spark, texts)
    kept = simhash.keep_one(df)
    assert kept.schema == df.schema
    assert rows(kept, "doc_id") == [(r,) for r in sorted(set(roots))]
    lone = spark.createDataFrame([(None, "a"), (None, "a"), (None, "q w e r t z")], "doc_id long, text string")
    assert rows(simhash.keep_one(lone), "text") == [("a",), ("q w e r t z",)]
    alike = spark.createDataFrame([(1, "a b", lang, n) for lang, n in [("en", 2), ("de", 3), ("de", 1)] * 40], "doc_id long, text string, lang string, n int")
    assert rows(simhash.keep_one(alike.repartition(5))) == [(1, "a b", "de", 1)]
    assert simhash.keep_one(df.limit(0)).count() == simhash.near_duplicates(df.limit(0)).count() == 0
