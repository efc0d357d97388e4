"""Quality rules against a plain version."""

import samples
from conftest import rows

from pipekit.llm.quality_rules import keep_quality, quality_rules


def expected(text, min_repeat, max_covered, max_longest):
    words, n = samples.plain_words(text), len(samples.plain_words(text))
    best = [0] * n
    for i in range(n):
        for j in range(i + 1, n):
            k = 0
            while j + k < n and words[i + k] == words[j + k]:
                k += 1
            best[i], best[j] = max(best[i], k), max(best[j], k)
    lines = [line for line in (text or "").split("\n") if samples.plain_words(line)]
    repeated = {p for i in range(n) if best[i] >= 3 for p in range(i, i + 3)}
    covered = {p for i in range(n) if best[i] >= min_repeat for p in range(i, i + best[i])}
    failed = n < 50 or 100 * len(repeated) > 50 * n
    longest = max(best, default=0)
    bad = len(covered) > max_covered * n or longest > max_longest
    symbols = sum((text or "").count(c) for c in "#*$%&|<>")
    counts = (n, sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(repeated), len(covered), longest)
    return (*counts, failed, not (failed or bad))


def test_counts_and_verdict(spark):
    texts = [*samples.documents(n=25), "# a | b <c> $%&\n# a | b <c> $%&\n\n \n", "w " * 30 + "u " * 25]
    texts = [t if t is None or len(t) < 2000 else t[:1200] for t in texts]
    found = quality_rules(samples.frame(spark, texts), min_repeat=5, max_covered=0.2, max_longest=12)
    want = [(i, *expected(t, 5, 0.2, 12)) for i, t in enumerate(texts)]
    want += [want[-1], (None, *want[-1][1:])]
    assert rows(found) == sorted(want, key=lambda r: [(v is not None, str(type(v)), v) for v in r])


def test_rows_kept_unchanged(spark):
    df = samples.frame(spark, ["same " * 80, " ".join(f"w{i}" for i in range(60)), None])
    kept = keep_quality(df)
    assert kept.schema == df.schema
    assert rows(kept, "doc_id", "shard") == [(1, 2)]
    assert keep_quality(df.limit(0)).count() == quality_rules(df.limit(0)).count() == 0
