"""Very long texts: each operator takes time that grows with a text's length and no faster."""

import re
import time

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lexiloom.llm import bpe, exact_dedup, language, line_dedup, media, near_dedup, packing, pii, quality, queries, substrings, token_counts

RANKS = public_tokenizers.path(queries.RANKS)
LONG = {
    "symbols": "#" * 1_000_000 + "a",
    "marks": "!" * 1_000_000 + "a",
    "one letter": "x" * 1_000_000,
    "lines": "\n".join(f"line {i % 5000}" for i in range(200_000)),
    "digit runs": "12 ab\n" * 500_000,
    "ten megabytes": "the cat sat on the mat, and so on. " * 300_000,
}
#: Some take half of it here; what grows faster than the text takes hours.
SECONDS = 40


def within(work):
    began = time.time()
    out = work()
    assert time.time() - began < SECONDS
    return out


@pytest.mark.parametrize("name", LONG)
def test_quality_features(name):
    within(lambda: quality.features(LONG[name]))


def test_trailed_runs_are_those_of_the_plain_pattern():
    plain = re.compile(rb"[^\s\w.,;:!?'\")|\x80-\xff-]+(?=\s|$)|!!+(?=\s|$)")
    rng = np.random.default_rng(4)
    for _ in range(3000):
        raw = bytes(rng.choice(list(b"#%!!a .\n\xc3@"), rng.integers(0, 30)).astype(np.uint8))
        assert quality._TRAILED.findall(raw) == plain.findall(raw)


@pytest.mark.parametrize("name", LONG)
def test_edits_and_personal_data(name):
    text = LONG[name]
    counter = token_counts.Counter.of(RANKS, public_tokenizers.PATTERN)
    edits = queries.masking_edits(text)
    within(lambda: pii.candidates(text))
    tree = token_counts.TokenTree(counter, text)
    within(lambda: tree.edit_all(edits))
    assert tree.text == re.sub("[0-9]+", "0", text) + "\n"
    assert tree.n_tokens == token_counts.TokenTree(counter, tree.text).n_tokens


def one_row(spark, text, n=1):
    return spark.createDataFrame([(text,)], "text string").select(F.explode(F.sequence(F.lit(1).cast("long"), F.lit(n).cast("long"))).alias("doc_id"), "text").withColumn("source", F.col("doc_id").cast("string"))


def test_two_hundred_thousand_lines_of_boilerplate(spark):
    """Sites with the same lines, all boilerplate but the first occurrence."""
    docs = one_row(spark, "\n".join(f"line {i}" for i in range(200_000)), 3)
    got = within(lambda: line_dedup.dedup_lines(docs, sites=3).select("doc_id", "__lines", "__removed", F.length("text").alias("n")).collect())
    assert sorted((r.doc_id, r["__lines"], r["__removed"]) for r in got) == [(i, 200_000, 200_000 * (i > 1)) for i in range(1, 4)]


EVERY = {
    "substring dedup": lambda d: substrings.remove_repeats(d).select("n_words"),
    "byte pairs": lambda d: bpe.encode_decode(d, RANKS, public_tokenizers.PATTERN).select("n_tokens"),
    "line dedup": lambda d: line_dedup.dedup_lines(d).select("__lines"),
    "media": lambda d: media.media_columns(media.text_images(d), ["doc_id", "n_bytes"]).select("n_bytes"),
    "packing": lambda d: packing.pack(d, queries.encoder()).select("length"),
    "near dedup": lambda d: near_dedup.near_classes(d).select("class_id"),
    "exact dedup": lambda d: exact_dedup.exact_dedup(d).select("group_size"),
    "personal data": lambda d: pii.find(d).select("spans"),
    "languages": lambda d: language.predict(d, language.train(d.withColumn("lang", F.lit("xx")))).select("lang_pred"),
}


@pytest.mark.parametrize("name", EVERY)
def test_ten_megabytes_through_each_operator(spark, name):
    docs = one_row(spark, LONG["ten megabytes"])
    assert within(lambda: EVERY[name](docs).collect())
