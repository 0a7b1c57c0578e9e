"""Text normalisation, script tests and boundary-aware splitting as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A sentence ends behind a mark, or at a period behind one of four Korean endings, which goes with the blank.
SENTENCE_END = r"(?<=[다요임함])\.\s|(?<=[.!?])\s"


def strip(c: Column) -> Column:
    """Without blanks at both ends, by Unicode's notion of blanks."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def normalize(c: Column | str) -> Column:
    """Without zero-width marks, blanks before line feeds and runs of empty lines."""
    c = F.col(c) if isinstance(c, str) else c
    c = F.regexp_replace(c, "[​﻿]", "")
    return strip(F.regexp_replace(F.regexp_replace(c, r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n"))


def dedent(c: Column | str) -> Column:
    """Each line without blanks at its ends; several empty lines become one."""
    lines = F.transform(F.split(strip(F.col(c) if isinstance(c, str) else c), "\n"), strip)
    return F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n")


def compact(c: Column | str) -> Column:
    """Lower case without ASCII spaces, as raw search compares."""
    return F.replace(F.lower(c), F.lit(" "), F.lit(""))


def has_latin(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).rlike("[A-Za-z]")


def has_hangul(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).rlike("[가-힣]")


def target_query(brief: Column | str) -> Column:
    """The query that a brief names as failing, or null."""
    found = F.regexp_extract(brief, '실패 질의: "(.+?)"', 1)
    return F.when(found != "", found)


def sentences(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, SENTENCE_END), strip), lambda s: s != "")


def hard_split(c: Column, size: int) -> Column:
    return F.when(F.char_length(c) == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(c), F.lit(1)), F.lit(size)), lambda i: F.substring(c, i, F.lit(size))))


def let(value: Column, use) -> Column:
    """use(value) with the value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


#: All but the wide scripts: Hangul, kana, Han and full-width forms.
NARROW = r"[^\u1100-\u115F\u2E80-\uA4CF\uAC00-\uD7A3\uF900-\uFAFF\uFE30-\uFE6F\uFF00-\uFF60\uFFE0-\uFFE6]"


def padded(text: Column | str, width: int) -> Column:
    """The text with blanks up to a width in terminal cells, where wide scripts take two a character."""
    text = F.col(text) if isinstance(text, str) else text
    cells = F.char_length(text) + F.char_length(F.regexp_replace(text, NARROW, ""))
    return F.concat(text, F.repeat(F.lit(" "), F.greatest(F.lit(width) - cells, F.lit(0))))
