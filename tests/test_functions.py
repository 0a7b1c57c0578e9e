import random
import time

import pytest
from pyspark.sql import functions as F

from lexiloom.functions import jamo, relevance, splitting, text, vectors


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(("word", "spelled"), [("한", "ㅎㅏㄴ"), ("케이크", "ㅋㅔㅇㅣㅋㅡ"), ("케잌", "ㅋㅔㅇㅣㅋ"), ("a한1", "aㅎㅏㄴ1"), ("", ""), ("힣", "ㅎㅣㅎ"), ("가", "ㄱㅏ"), ("닭", "ㄷㅏㄺ")])
def test_jamo_spelling(spark, word, spelled):
    assert one(spark, jamo.to_jamo(F.lit(word))) == spelled


@pytest.mark.parametrize(("a", "b", "s"), [("케잌", "케이크", 0.833), ("후라이팬", "프라이팬", 0.778), ("도너츠", "도넛", 0.667), ("핸드폰", "휴대폰", 0.625), ("", "", 1.0), ("블루투스", "bluetooth", 0.0), ("아답터", "어댑터", 0.714)])
def test_jamo_similarity(spark, a, b, s):
    assert one(spark, F.round(jamo.jamo_similarity(F.lit(a), F.lit(b)), 3)) == s


def test_jamo_distance(spark):
    assert one(spark, jamo.jamo_distance(F.lit("가"), F.lit(""))) == 2


def test_cosine(spark):
    def cos(a, b):
        return one(spark, vectors.cosine(F.lit(a).cast("array<double>"), F.lit(b).cast("array<double>")))

    assert cos([1.0, 0.0], [1.0, 0.0]) == 1.0
    assert cos([1.0, 0.0], [0.0, 2.0]) == 0.0
    assert cos([0.0, 0.0], [1.0, 1.0]) == 0.0 == cos([1.0], [1.0, 1.0]) == cos([], [])
    assert cos(None, [1.0]) is None


def test_gain_and_fusion(spark):
    assert one(spark, relevance.gain(F.lit(2), F.lit(1))) == 3.0
    assert one(spark, relevance.rrf(F.lit(1))) == pytest.approx(1 / 61)
    assert one(spark, relevance.rrf(F.lit(None).cast("int"))) == 0.0


def test_sentences(spark):
    assert one(spark, text.sentences(F.lit("가다. 나요! 다음. 끝"))) == ["가다", "나요!", "다음.", "끝"]


def test_normalize(spark):
    assert one(spark, text.normalize(F.lit(" a​ b  \n\n\n\n c﻿ \t"))) == "a b\n\n c"
    assert one(spark, text.dedent(F.lit("  a\n\n\n\n    b \n c"))) == "a\n\nb\nc"


def test_packing_counts_the_joiner():
    pieces = splitting.packed(["aa", "bb", "cc", "ddddd"], 5, " ")
    assert pieces == ["aa bb", "cc", "ddddd"]
    assert splitting.packed([], 5, " ") == []


def test_split_falls_back_step_by_step():
    assert splitting.pieces("short", 10) == ["short"]
    assert splitting.pieces("para one\n\npara two", 10) == ["para one", "para two"]
    assert splitting.pieces("One two. Three four. Five.", 12) == ["One two.", "Three four.", "Five."]
    assert splitting.pieces("x" * 25, 10) == ["x" * 10, "x" * 10, "x" * 5]
    assert splitting.pieces("", 10) == []


def test_overlap_repeats_the_last_sentence():
    assert splitting.overlapped(["One. Two.", "Three."], 6) == ["One. Two.", "Two. Three."]
    assert splitting.overlapped(["a", "b"], 0) == ["a", "b"]


def test_scripts_and_targets(spark):
    assert one(spark, text.has_latin(F.lit("한a"))) and not one(spark, text.has_latin(F.lit("한1")))
    assert one(spark, text.has_hangul(F.lit("a한"))) and not one(spark, text.has_hangul(F.lit("abc")))
    assert one(spark, text.target_query(F.lit('실패 질의: "후라이팬" 등'))) == "후라이팬"
    assert one(spark, text.target_query(F.lit("none"))) is None


def test_padding_counts_terminal_cells(spark):
    rows = spark.createDataFrame([("ab",), ("한글",), ("a漢",), ("longer than that",)], "t string").select(text.padded("t", 6)).collect()
    assert [r[0] for r in rows] == ["ab    ", "한글  ", "a漢   ", "longer than that"]


def test_splitting_agrees_with_the_columns(spark):
    """Sentences, normalised texts and blanks at ends are the same in a task's rows as in column functions."""
    rng = random.Random(6)
    texts = ["".join(rng.choice("ab다. .!?\n\t #\u00a0\u200b\u2003\x85") for _ in range(rng.randint(0, 40))) for _ in range(400)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.sentences(F.col("t")).alias("s"), text.normalize("t").alias("n")).collect()
    assert all(splitting.sentences(r.t) == r.s and splitting.normalized(r.t) == r.n for r in rows)


@pytest.mark.parametrize("long", ["One two. " * 1_100_000, "word " * 2_000_000, "x" * 10_000_000, " " * 10_000_000 + "x", "a\n\n" * 3_000_000, "# h\nbody\n" * 1_000_000])
def test_chunks_of_a_long_text_take_linear_time(long):
    began = time.time()
    assert splitting.chunks(long, 400, 80)
    assert time.time() - began < 40
