"""License scan against a plain version of its rules."""

import re

import samples
from hypothesis import find, settings
from hypothesis.strategies import from_regex

from pipekit.llm import licenses

TEXTS = [
    "MIT License",
    "the mit\nlicense. Apache-License, Version 2.0 and GNU General Public License v3 or",
    "SPDX-License-Identifier: Apache-2.0",
    "mit license " * 700,
    "Creative Commons Attribution-ShareAlike 4.0; CC BY-SA 4.0 License",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of",
    "K MİT License ünicode licence gpl",
    "GNU Lesser General Public License version 2.1 or simplified BSD licence",
    "license",
    "mit licenses, apache  license",
    "general public license general public license version 2",
]


def labelled(rule, words):
    if not rule.label.endswith("-*"):
        return rule.label
    major, minor = re.search(r"([0-9])(?: ([0-9]+))?(?: [a-z ]+)?$", words).groups()
    return f"{rule.label[:-2]}-{major}.{minor or 0}" + "-or-later" * bool(re.search(" (later|newer)( |$)", words))


def expected(text):
    tried = [(i, rule, re.compile(f"^(?:{rule.pattern})(?![^ ])")) for i, rule in enumerate(licenses.rules())]
    words, base, met = samples.licence_words(text), [], []
    for i in range(len(words)):
        rest = " ".join(words[i : i + licenses.LONGEST])
        base += [(i, label) for phrase, label in licenses.BASE.items() if (rest + " ").startswith(phrase + " ")]
        own = []
        for order, rule, pattern in tried:
            if found := pattern.match(rest):
                own.append((rule.priority, found[0].count(" ") + 1, -order, labelled(rule, found[0])))
        if own:
            priority, size, _, label = max(own)
            met.append((i, i + size, label, priority))
    held = lambda d, e: e != d and e[0] <= d[0] and e[1] >= d[1] and e[3] >= d[3]
    return len(words), base, [d[:3] for d in met if not any(held(d, e) for e in met)]


def test_detections(spark):
    texts = [*samples.documents(n=10), *TEXTS[:3], "mit license " * 60, *TEXTS[4:]]
    df = samples.frame(spark, texts)
    for row in licenses.license_scan(df).collect():
        found = [(d.start, d.end, d.label) for d in row.found]
        want = expected(texts[-1 if row.doc_id is None else row.doc_id])
        assert (row.n_words, [(b.start, b.label) for b in row.base], found) == want
        assert all(0 < d.weight < 1 for d in row.found)
    assert licenses.license_scan(df.limit(0)).count() == 0


def test_many_places_in_one_text(spark):
    df = spark.createDataFrame([(1, TEXTS[3])], "doc_id long, text string")
    row = licenses.license_scan(df).first()
    assert len(row.base) == len(row.found) == 700


def test_every_rule_is_reached(spark):
    """Words of each pattern pass the gates, fit in a place's words and give what the plain version gives."""
    texts = []
    for rule in licenses.rules():
        words = find(from_regex(f"^(?:{rule.pattern})\\Z"), lambda _: True, settings=settings(database=None))
        assert words.count(" ") < licenses.LONGEST and words.split(" ")[0] in licenses.first_words(rule.pattern), rule
        assert rule.pattern.count(" ") + 6 * rule.pattern.count("{1,6}") < licenses.LONGEST
        texts.append(words)
    df = spark.createDataFrame([(i, t if i % 2 else t.upper()) for i, t in enumerate(texts)], "doc_id long, text string")
    for row in licenses.license_scan(df).collect():
        want = expected(texts[row.doc_id])[2]
        assert [(d.start, d.end, d.label) for d in row.found] == want and want[0][0] == 0, texts[row.doc_id]


OVERLAPS = [
    ("Licensed under the Apache License, Version 2.0 (the License)", [(0, 8, "apache-2.0")]),
    ("the GNU General Public License v3 or later", [(1, 8, "gpl-3.0-or-later")]),
    ("GPLv2 only", [(0, 2, "gpl-2.0")]),
    ("Lesser General Public License 2.1", [(0, 6, "lgpl-2.1")]),
    ("CC BY-NC-SA 4.0 license", [(0, 7, "cc-by-nc-sa-4.0")]),
    ("SPDX-License-Identifier: GPL-2.0-or-later", [(0, 8, "gpl-2.0-or-later")]),
    ("see accompanying license file, open source licence", [(0, 4, "see-file"), (4, 7, "open-source")]),
    ("software license agreement of the bsd license", [(0, 3, "proprietary"), (5, 7, "bsd")]),
]


def test_priority_and_versions(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(OVERLAPS)], "doc_id long, text string")
    for row in licenses.license_scan(df).collect():
        assert [(d.start, d.end, d.label) for d in row.found] == OVERLAPS[row.doc_id][1]


def test_rules_are_told_apart():
    patterns = [r.pattern for r in licenses.rules()]
    assert len(patterns) == len(set(patterns)) > 250


def test_native(spark):
    plan = licenses.license_scan(samples.frame(spark, TEXTS))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|MapInArrow|Exchange", plan)
