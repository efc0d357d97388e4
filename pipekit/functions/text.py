"""Text expressions: strip, emoji removal, title case."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# The code points Python's str.strip removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Emoji blocks, and the marks that only belong to an emoji when they follow one
# (variation selector, joiner, keycap, tag letters). A joiner between letters is kept.
EMOJI = (
    r"\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}\x{231A}\x{231B}\x{23E9}-\x{23FA}"
    r"\x{2B05}-\x{2B07}\x{2B1B}\x{2B1C}\x{2B50}\x{2B55}"
)
EMOJI_MARKS = r"\x{FE0F}\x{200D}\x{20E3}\x{E0020}-\x{E007F}"
# No emoji and no mark comes before this code point; one class is far faster to look for.
EMOJI_RANGE = r"[\x{20E3}-\x{10FFFF}]"
EMOJI_PATTERN = rf"[{EMOJI}][{EMOJI}{EMOJI_MARKS}]*|\x{{FE0F}}?\x{{20E3}}"

# Runs of cased letters and the runs between them.
WORD_PATTERN = r"([\p{Lu}\p{Ll}\p{Lt}]+|[^\p{Lu}\p{Ll}\p{Lt}]+)"


def strip(column: Column) -> Column:
    """Remove leading and trailing whitespace of every kind, not only spaces."""
    return F.btrim(column, F.lit(WHITESPACE))


def remove_emoji(column: Column) -> Column:
    return F.when(column.rlike(EMOJI_RANGE), F.regexp_replace(column, EMOJI_PATTERN, "")).otherwise(column)


def title_case(column: Column) -> Column:
    """Capitalise every run of letters, also after an apostrophe, hyphen or digit."""
    runs = F.regexp_extract_all(F.lower(column), F.lit(WORD_PATTERN), F.lit(1))
    return F.array_join(F.transform(runs, F.initcap), "")


TEXT_OPS: dict[str, Callable[[Column], Column]] = {
    "trim": strip,
    "lower": F.lower,
    "rm_emoji": remove_emoji,
}
