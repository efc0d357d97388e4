"""Token shards: the permutation, exact round trips, and reading on from any slot."""

import numpy as np
import pytest
import samples

from pipekit.llm import token_shards as ts
from pipekit.session import fresh_path


# A lambda travels to the executors by value.
by_character = lambda: lambda texts: [[ord(c) % 60_000 for c in t] for t in texts]


@pytest.mark.parametrize("n", [1, 2, 3, 5, 100, 4097])
def test_slots_are_a_permutation(n):
    first, second = ts.slots(np.arange(n), n, 1), ts.slots(np.arange(n), n, 2)
    assert sorted(first.tolist()) == list(range(n)) == sorted(second.tolist())
    assert n < 100 or (first != second).mean() > 0.9
    assert ts.slots(np.arange(n)[::-1], n, 1).tolist() == first[::-1].tolist()


def test_round_trip_and_resume(spark):
    texts = samples.documents()
    df = samples.frame(spark, texts).repartition(5)
    written = ts.write_shards(df, fresh_path(spark, "shards"), by_character, length=16, per_shard=100, seed=3)
    shards = {r.shard: r for r in written.collect()}
    found = sorted(ts.read_shards(written, length=16).collect(), key=lambda r: r.slot)
    assert [r.slot for r in found] == list(range(len(found)))
    assert sorted(shards) == list(range(-(-len(found) // 100)))
    assert all(r.shard == r.slot // 100 and shards[r.shard].first == r.shard * 100 for r in found)
    want = []
    for i, text in [*enumerate(texts), (len(texts) - 1, texts[-1]), (None, texts[-1])]:
        ids = by_character()([text or ""])[0]
        want += [(str(i), part, ids[part * 16 : part * 16 + 16]) for part in range(-(-len(ids) // 16))]
    assert sorted((str(r.key), r.part, r.tokens) for r in found) == sorted(want)
    packed = ts.read_shards(written, length=16, packed=True).collect()
    assert {r.slot: np.frombuffer(r.tokens, "<u2").tolist() for r in packed} == {r.slot: r.tokens for r in found}
    rest = ts.read_shards(written, length=16, start=157).collect()
    assert sorted(rest, key=lambda r: r.slot) == found[157:]


def test_nothing_to_write(spark):
    df = samples.frame(spark, [None, ""])
    written = ts.write_shards(df, fresh_path(spark, "shards"), by_character, length=16)
    assert written.count() == ts.read_shards(written, length=16).count() == 0


def test_wide_ids_are_an_error(spark):
    df = samples.frame(spark, ["a"])
    with pytest.raises(Exception, match="16 bits"):
        ts.write_shards(df, fresh_path(spark, "shards"), lambda: lambda texts: [[70_000] for _ in texts])
