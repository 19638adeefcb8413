"""Column functions on message texts: language gate, normalization, hashes, anchors. All run in the JVM."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanloom.schemas import KEYWORD_MAPPING, SPECIAL_CHAR

#: (rule_type, key, value) in the order in which they apply.
Mappings = Sequence[tuple[str, str, str]]


def bound(value: Column, then) -> Column:
    """then(value), with the value computed once: a higher-order function would compute an expression again for each element."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def non_english(text: Column, limit: float = 0.3) -> Column:
    """Whether over 30 % as many UTF-16 units are outside ASCII as are letters; a text without letters isn't."""
    astral = r"[\x{10000}-\x{10FFFF}]"
    foreign = F.regexp_count(text, F.lit(r"[^\x00-\x7F]")) + F.regexp_count(text, F.lit(astral))
    letters = F.regexp_count(text, F.lit(r"\p{L}")) - F.regexp_count(text, F.lit(rf"[\p{{L}}&&{astral}]"))
    return F.when(letters > 0, foreign / letters > limit).otherwise(F.lit(False))


def strip_non_ascii(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\x00-\x7F]+", " ")


def map_keywords(text: Column, mappings: Mappings) -> Column:
    """Each upper-cased key replaced by its upper-cased value, inside words too."""
    for kind, key, value in mappings:
        if kind == KEYWORD_MAPPING and key:
            text = F.replace(text, F.lit(key.upper()), F.lit(value.upper()))
    return text


def map_between_digits(text: Column, mappings: Mappings) -> Column:
    """Each key between two digits replaced by its value; matches don't overlap, so 1/2/3 becomes 1-2/3."""
    for kind, key, value in mappings:
        if kind == SPECIAL_CHAR:
            text = F.regexp_replace(text, rf"(\d){quote(key)}(\d)", f"$1{value}$2")
    return text


def fold_space(text: Column) -> Column:
    text = F.regexp_replace(F.regexp_replace(text, r"[\t\n\r\f]", " "), " {2,}", " ")
    return F.regexp_replace(text, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def normalize(text: Column, mappings: Mappings = ()) -> Column:
    """Null becomes empty; then ASCII, upper case, keywords, marks between digits, white space."""
    text = F.upper(strip_non_ascii(F.coalesce(text, F.lit(""))))
    return fold_space(map_between_digits(map_keywords(text, mappings), mappings))


def normalize_by(text: Column, keywords: Column, between_digits: Column) -> Column:
    """normalize() with the mappings in two arrays of (key, value), in order, for any number of them."""
    text = F.upper(strip_non_ascii(F.coalesce(text, F.lit(""))))
    text = F.aggregate(keywords, text, lambda acc, r: F.replace(acc, F.upper(r["key"]), F.upper(r["value"])))
    pattern = lambda key: F.concat(F.lit(r"(\d)\Q"), F.replace(key, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E(\d)"))
    text = F.aggregate(between_digits, text, lambda acc, r: F.regexp_replace(acc, pattern(r["key"]), F.concat(F.lit("$1"), r["value"], F.lit("$2"))))
    return fold_space(text)


def quote(token: str) -> str:
    """A literal in a Java pattern."""
    return r"\Q" + token.replace(r"\E", r"\E\\E\Q") + r"\E"


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def static_hash(text: Column, values: Column) -> Column:
    """Of the text without the values (array of strings, in order), wherever they occur, and without blanks."""
    left = F.aggregate(values, text, lambda acc, v: F.replace(acc, v, F.lit("")))
    return sha256(F.replace(left, F.lit(" "), F.lit("")))


def sequence_hash(names: Column) -> Column:
    return sha256(F.array_join(names, ":"))


def template_id(sender: Column, canonical: Column) -> Column:
    return sha256(F.concat(sender, F.lit("::"), F.coalesce(canonical, F.lit("null"))))


def is_entity_ref(anchor: Column) -> Column:
    return F.coalesce(anchor.rlike(r"(?s)^\{.+\}$"), F.lit(False))


def is_start_mark(anchor: Column) -> Column:
    return F.coalesce(F.upper(anchor) == "SOM", F.lit(False))


def is_end_mark(anchor: Column) -> Column:
    return F.coalesce(F.upper(anchor) == "EOM", F.lit(False))


def anchor_pattern(token: str, skip_between_digits: bool = True) -> str:
    """The Java pattern that finds a token as a word (see operators.engine.anchor_regex)."""
    t = token.upper()
    if skip_between_digits and not re.search("[0-9A-Za-z]", t):
        return rf"(?<![0-9]){quote(t)}|{quote(t)}(?![0-9])"
    before = "(?<![0-9A-Za-z])" if t[:1].isalnum() else ""
    after = "(?![A-Za-z])" if t[-1:].isalnum() else ""
    return f"{before}{quote(t)}{after}"


def anchor_at(text: Column, token: str, matching: bool = False) -> Column:
    """First place (from 0) of a token, or -1."""
    return F.regexp_instr(F.upper(text) if matching else text, F.lit(anchor_pattern(token, not matching))) - 1


def first_words(text: Column, words: int) -> Column:
    """The text up to the end of its first so many blank-separated words."""
    return F.regexp_extract(text, rf"^(?: *[^ ]+){{1,{words}}}", 0)


def word_count(text: Column) -> Column:
    return F.size(F.split(text, r"\s+"))
