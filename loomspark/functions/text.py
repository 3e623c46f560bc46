"""Tokenizers and text measures as column expressions; all run inside the JVM."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The parts of identifiers (a word with at most one leading capital; capitals before another one
# or before the end of the identifier), and literal query words. Any ASCII letter belongs to an identifier.
WORD_PART = r"[A-Z]?[a-z]+"
CAPITALS_PART = r"[A-Z]+(?=[A-Z]|[^a-zA-Z0-9_]|\z)"
LITERAL_WORD = r"[A-Za-z0-9_]+"
#: A whole identifier without such parts: each of its capitals stands before a digit or an underscore. Digits before it
#: come along, since only there can be told that they don't belong to an earlier part of a longer identifier.
PARTLESS = r"(?<![a-zA-Z0-9_])[0-9]*+(?=[A-Z_])(?:[A-Z](?=[0-9_])|[0-9_])+(?![a-zA-Z0-9_])"

# English words with little meaning for search.
STOP_TOKENS = frozenset(
    """
    the a an is are was were be been being have has had do does did will would could should may might must
    shall can need dare and or not in on at to for of with by from as into through during before after above
    below between under again further then once here there when where why how all each few more most other
    some such no nor only own same so than too very just also
    """.split()
)

#: Fuzzy matching compares tokens whose lengths differ by at most this (fixed value).
LENGTH_WINDOW = 2


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(text: Column | str, min_length: int = 2, stop: Iterable[str] | None = None) -> Column:
    """The search tokens of a text, in order and with repeats, by one pass of one pattern over the text.

    Identifiers are cut at letter-case changes, or at underscores if they have no such part; parts come
    out in lower case if they have `min_length` characters, aren't in `stop` and aren't a number.
    Null gives an empty array.
    """
    found = F.regexp_extract_all(F.coalesce(_col(text), F.lit("")), F.lit(f"{WORD_PART}|{CAPITALS_PART}|{PARTLESS}"), F.lit(0))
    # Only identifiers without parts hold underscores or numbers; joining and splitting once cuts all of them. Digits at
    # the beginning of a find are those before the identifier.
    joined = F.regexp_replace(F.lower(F.array_join(found, " ")), "(?<=^| )[0-9]+|(?<=_)[0-9]+(?=_| |$)", "")
    banned = sorted(stop) if stop else []

    def kept(t: Column) -> Column:
        cond = F.length(t) >= max(1, min_length)
        return cond & ~t.isin(banned) if banned else cond

    return F.filter(F.split(joined, "[ _]"), kept)


def literal_tokens(text: Column | str) -> Column:
    """Runs of letters, digits and underscores in lower case; null gives an empty array."""
    return F.transform(F.regexp_extract_all(F.coalesce(_col(text), F.lit("")), F.lit(LITERAL_WORD), F.lit(0)), F.lower)


def similarity(a: Column | str, b: Column | str) -> Column:
    """1 minus the edit distance over the longer length; 0 if either is empty or null."""
    a, b = _col(a), _col(b)
    longer = F.greatest(F.length(a), F.length(b))
    return F.when((F.length(a) == 0) | (F.length(b) == 0) | a.isNull() | b.isNull(), 0.0).otherwise(1.0 - F.levenshtein(a, b) / longer)


def most_edits(longer: int, threshold: float) -> int:
    """The largest distance below `longer` whose similarity still reaches the threshold, or -1."""
    return next((d for d in range(longer - 1, -1, -1) if 1.0 - d / longer >= threshold), -1)


def qualifying_edits(longer: Column | str, threshold: float) -> Column:
    """most_edits as a column: the largest distance below a length whose similarity reaches the threshold, or -1."""
    longer = _col(longer)
    able = F.filter(F.sequence(F.lit(0), longer - 1), lambda d: 1.0 - d / longer >= threshold)
    return F.when(longer > 0, F.coalesce(F.array_max(able), F.lit(-1))).otherwise(F.lit(-1))


def spaced_camel_case(text: Column | str) -> Column:
    """The text with a space at every letter-case boundary."""
    once = F.regexp_replace(_col(text), "([a-z])([A-Z])", "$1 $2")
    return F.regexp_replace(once, "([A-Z]+)([A-Z][a-z])", "$1 $2")


def expand_camel_case(text: Column | str) -> Column:
    """struct(text, added): the text followed by its words in lower case if it has camel case, and the new words."""
    text = _col(text)
    spaced = spaced_camel_case(text)
    words = lambda c: F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != "")
    own = words(text)
    changed = spaced != text
    return F.struct(
        F.when(changed, F.concat_ws(" ", text, F.lower(spaced))).otherwise(text).alias("text"),
        F.when(changed, F.filter(words(spaced), lambda w: ~F.array_contains(own, w))).otherwise(F.array().cast("array<string>")).alias("added"),
    )


def line_count(text: Column | str) -> Column:
    """Number of lines: line feeds plus one."""
    return F.size(F.split(_col(text), "\n", -1))
