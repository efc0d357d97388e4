"""License scan by ordered signature rules, in DataFrame expressions only.

A text's words are runs of digits, letters and characters above 0x7F, with A-Z in lower case. Rules
are written expressions over a bounded number of words, in kinds of falling priority: identifiers,
sentences of license texts, notices, names with a version, names, hints. A text is looked at only if
it contains one of GATES, and a place only if a rule begins with its word; there the rule of highest
priority wins, among equals the longest, then the one listed first. A detection that lies within
another one of the same or a higher priority is suppressed. All of this is done in the row itself,
in time proportional to its words: no shuffle, and no group to outgrow a task.

Base places, where one of BASE stands, are reported apart and never suppressed.

Defined results: a null or empty text has no words, no places and score 0; equal rows are all
returned; an empty table gives an empty table; columns not asked for are ignored.
"""

from __future__ import annotations

import re
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from pipekit.llm.arrays import chosen
from pipekit.llm.license_rules import BODIES, HEADERS, HINTS, NAMES, SPDX, VERSIONED

WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# The contract's phrases.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Every rule's words contain one of these.
GATES = ("licen", "gpl", "commons", "spdx", "bsd", "copyleft", "redistribution", "permission", "wtfpl", "cc0", "domain")
GATES += ("mozilla", "apache", "warranty", "dedication", "gnu", "copyright", "openssl", "neither")
# Further words of sentences without a word of this kind.
GATES += ("advertising", "prominent", "convey", "derivative", "applicable", "constitutes", "verbatim", "eclipse", "ofl", "altered", "package")
GATES += ("anyone", "fuck", "deed", "unencumbered", "retain", "evil", "redistribute", "opensource")

# Words of a detection at most.
LONGEST = 32

# The end of a pattern's words, and the version that they have before their last words.
END = "(?![^ ])"
VERSION = "([0-9])(?: ([0-9]+))?(?: [a-z ]+)?$"


class Rule(NamedTuple):
    priority: int
    label: str
    pattern: str


def rules() -> list[Rule]:
    """All rules, kind by kind."""
    spdx = [(name.lower(), f"spdx licen[cs]e identifier {' '.join(re.findall('[a-z0-9]+', name.lower()))}") for name in SPDX]
    kinds = [spdx, BODIES, HEADERS, VERSIONED, NAMES, HINTS]
    return [Rule(len(kinds) - i, label, pattern) for i, kind in enumerate(kinds) for label, pattern in kind]


def first_words(pattern: str) -> list[str]:
    """The words that a pattern can begin with: an optional group may precede the first one."""
    token, rest = re.match(r"(\(\?:[^()]*\)\??|[^ (]+) ?(.*)", pattern).groups()
    if token.endswith(")?"):
        return [*first_words(token[3:-2].strip()), *first_words(rest)]
    options = token[3:-1].split("|") if token.startswith("(?:") else [token]
    found = []
    for option in options:
        spelled = [""]
        for part in re.findall(r"\[[^]]*\]|[^[]", option.split(" ")[0]):
            many = {"[cs]": "cs", "[0-9]": "0123456789"}.get(part, part)
            spelled = [s[:-1] if many == "?" else s + c for s in spelled for c in many] + (spelled if many == "?" else [])
        found += spelled
    return found


def by_first_word() -> dict[str, list[tuple[int, Rule]]]:
    """The rules that can begin with each word, with their places in the order."""
    out: dict[str, list[tuple[int, Rule]]] = {}
    for order, rule in enumerate(rules()):
        for word in dict.fromkeys(first_words(rule.pattern)):
            out.setdefault(word, []).append((order, rule))
    return out


def _met(order: int, rule: Rule) -> str:
    """SQL: what a rule finds at the place `p`, or null."""
    words = f"regexp_extract(p.context, r'^(?:{rule.pattern}){END}', 0)"
    label = f"'{rule.label}'"
    if rule.label.endswith("-*"):
        part = lambda i: f"regexp_extract({words}, r'{VERSION}', {i})"
        later = f"if({words} RLIKE r' (later|newer)( |$)', '-or-later', '')"
        version = f"concat('-', {part(1)}, '.', coalesce(nullif({part(2)}, ''), '0'), {later})"
        label = f"concat('{rule.label[:-2]}', {version})"
    fields = f"'priority', {rule.priority}, 'words', size(split({words}, ' ')), 'rank', {-order}, 'label', {label}"
    return f"CASE WHEN p.context RLIKE r'^(?:{rule.pattern}){END}' THEN named_struct({fields}) END"


def _detections(of: dict[str, list[tuple[int, Rule]]]) -> str:
    """SQL: the detection at each of `places`; as one text, because thousands of columns cost seconds to build."""
    cases = [f"WHEN '{word}' THEN array_max(array({', '.join(_met(*r) for r in own)}))" for word, own in of.items()]
    best = f"CASE p.word {' '.join(cases)} END"
    return f"filter(transform(places, p -> named_struct('start', p.at, 'best', {best})), d -> d.best IS NOT NULL)"


def _any(conditions: list[Column]) -> Column:
    return reduce(Column.__or__, conditions)


def license_scan(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key`, `n_words`, `base` (places of base phrases, with label) and `found` (detections with
    start and end in words, label, priority and weight) of each row."""
    of = by_first_word()
    starting = [*of, *(phrase.split(" ")[0] for phrase in BASE)]

    def place(i: Column, words: Column) -> Column:
        context = F.array_join(F.slice(words, i + 1, F.lit(LONGEST)), " ")
        return F.struct(i.alias("at"), F.get(words, i).alias("word"), context.alias("context"))

    def base_at(p: Column) -> Column:
        labels = [F.when(p["context"].rlike(f"^{phrase}{END}"), label) for phrase, label in BASE.items()]
        return F.struct(p["at"].alias("start"), F.coalesce(*labels).alias("label"))

    rows = chosen(df, key=key, text=text).withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows.withColumn("lowered", F.lower("text"))
    rows = rows.withColumn("gate", _any([F.col("lowered").contains(g) for g in GATES]))
    none = F.array().cast("array<string>")
    cut = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(WORD), F.lit(0))
    rows = rows.select(
        "key",
        F.size(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).cast("long").alias("n_words"),
        F.when(F.col("gate"), cut).otherwise(none).alias("words"),
    )
    begins = F.transform("words", lambda w, i: F.when(w.isin(*dict.fromkeys(starting)), i))
    rows = rows.withColumn("places", F.filter(begins, lambda i: i.isNotNull()))
    rows = rows.withColumn("places", F.transform("places", lambda i: place(i, F.col("words"))))
    rows = rows.withColumn("base", F.filter(F.transform("places", base_at), lambda b: b["label"].isNotNull()))
    rows = rows.withColumn("found", F.expr(_detections(of)))
    spans = F.transform(
        "found",
        lambda d: F.struct(
            d["start"].cast("long").alias("start"),
            (d["start"] + d["best"]["words"]).cast("long").alias("end"),
            d["best"]["label"].alias("label"),
            d["best"]["priority"].alias("priority"),
            (1 - F.pow(F.lit(2.0), -d["best"]["words"])).alias("weight"),
        ),
    )
    rows = rows.withColumn("found", spans)

    def outside(d: Column, i: Column) -> Column:
        # One detection for each start, so those that can hold this one are the few before it.
        before = F.slice(F.col("found"), F.greatest(i - LONGEST + 2, F.lit(1)), F.least(i, F.lit(LONGEST - 1)))
        return ~F.exists(before, lambda e: (e["end"] >= d["end"]) & (e["priority"] >= d["priority"]))

    return rows.select(F.col("key").alias(key), "n_words", "base", F.filter("found", outside).alias("found"))


__all__ = ["BASE", "GATES", "Rule", "first_words", "license_scan", "rules"]
