"""Hangul syllables as compatibility jamo, and edit distance on them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Compatibility jamo in the order of Unicode's syllable composition.
INITIALS = "ㄱㄲㄴㄷㄸㄹㅁㅂㅃㅅㅆㅇㅈㅉㅊㅋㅌㅍㅎ"
VOWELS = "ㅏㅐㅑㅒㅓㅔㅕㅖㅗㅘㅙㅚㅛㅜㅝㅞㅟㅠㅡㅢㅣ"
FINALS = "ㄱㄲㄳㄴㄵㄶㄷㄹㄺㄻㄼㄽㄾㄿㅀㅁㅂㅄㅅㅆㅇㅈㅊㅋㅌㅍㅎ"  # index 0 of Unicode's finals is none
FIRST, LAST = 0xAC00, 0xD7A3


def _pick(letters: str, at: Column) -> Column:
    return F.substring(F.lit(letters), at + 1, F.lit(1))


def to_jamo(text: Column | str) -> Column:
    """Each syllable as initial, vowel and final, if it has one; other characters stay. Texts without Hangul skip the work."""
    text = F.col(text) if isinstance(text, str) else text

    def spell(ch: Column) -> Column:
        code = F.ascii(ch) - FIRST
        final = F.pmod(code, F.lit(28))
        parts = F.concat(_pick(INITIALS, (code / 588).cast("int")), _pick(VOWELS, (F.pmod(code, F.lit(588)) / 28).cast("int")), F.when(final == 0, "").otherwise(_pick(FINALS, final - 1)))
        return F.when(F.ascii(ch).between(FIRST, LAST), parts).otherwise(ch)

    return F.when(text.rlike("[가-힣]"), F.array_join(F.transform(F.split(text, ""), spell), "")).otherwise(text)


def jamo_distance(a: Column | str, b: Column | str) -> Column:
    """Levenshtein distance of the jamo spellings, in characters."""
    return F.levenshtein(to_jamo(a), to_jamo(b))


def similarity_of(ja: Column, jb: Column) -> Column:
    """1 - distance / longer length of two spellings; two empty ones are alike."""
    longer = F.greatest(F.char_length(ja), F.char_length(jb))
    return F.when(longer == 0, F.lit(1.0)).otherwise(1.0 - F.levenshtein(ja, jb) / longer)


def jamo_similarity(a: Column | str, b: Column | str) -> Column:
    return similarity_of(to_jamo(a), to_jamo(b))
