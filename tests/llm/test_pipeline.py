"""The pipeline's stages in order, on a table that holds what each stage must act on."""

import collections
import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from lexiloom.llm import line_dedup, near_dedup, pii, quality, queries
from tests.llm.test_operators import family, plain_base, plain_classes, star


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = np.random.default_rng(11)
    path = str(tmp_path_factory.mktemp("sf"))
    rows, labels = [], []
    for i in range(400):
        words = ["".join(rng.choice(list("abcdefgh"), rng.integers(2, 8))) for _ in range(rng.integers(30, 90))]
        good = i % 5 != 0
        text = " ".join(words) + "." if good else " ".join(w.upper() + "!!" for w in words)
        text += "\nall rights reserved by everyone" * (i % 3 == 0)
        text += f"\nwrite to user{i}@example.com now" * (i % 7 == 0)
        rows.append((i, text, "en", f"s{i % 16}", len(text)))
        labels.append((i, int(good), 0))
    for i in range(1, 60, 3):
        if i % 5:
            rows.append((1000 + i, rows[i][1].replace(".", " again."), "en", f"s{i % 16}", 0))
            rows.append((2000 + i, rows[i][1], "en", f"s{(i + 1) % 16}", 0))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_are_the_five_in_order():
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == ["good_quality", "without_boilerplate", "one_of_each", "without_personal_data", "packed_sequences"]


def test_each_stage_acts_on_all_that_its_predecessor_kept(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = corpus_pipeline.good_quality(spark, docs, folder)
    assert kept.schema.names == docs.schema.names
    model = quality.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    accepted = {r.doc_id for r in quality.score(docs, model).where("predicted = 1").collect()}
    assert {r.doc_id for r in kept.collect()} == accepted
    assert {i for i in range(400) if i % 5} <= accepted and not accepted & {i for i in range(400) if i % 5 == 0}

    lines = corpus_pipeline.without_boilerplate(spark, kept, folder)
    assert lines.schema.names == docs.schema.names
    held = collections.Counter("all rights reserved" in r.text for r in lines.collect())
    assert held[True] == 1 and sum(held.values()) == len(accepted)

    one = corpus_pipeline.one_of_each(spark, lines, folder)
    assert one.schema.names == docs.schema.names
    classes = near_dedup.near_classes(lines).collect()
    assert {r.doc_id for r in one.collect()} == {r.class_id for r in classes}
    assert {i for i in range(400) if i % 5} <= {r.doc_id for r in one.collect()}

    clean = corpus_pipeline.without_personal_data(spark, one, folder)
    assert clean.schema.names == docs.schema.names
    rows = clean.collect()
    assert len(rows) == one.count() and not any(pii.base_spans(r.text) for r in rows) and any("[EMAIL]" in r.text for r in rows)
    assert all(r.n_chars == len(r.text) for r in rows)


def test_run_equals_a_plain_version(spark, folder, tmp_path):
    """Each stage's decision made again in Python over the whole table, with repeated rows in it."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    docs = docs.unionByName(docs.where("doc_id % 9 = 1"))
    path = str(tmp_path)
    docs.write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").write.parquet(f"{path}/labels.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{path}/labels.parquet").collect()}
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]

    learnt = sorted({i: t for i, t, _ in rows if i in labels and zlib.crc32(str(i).encode()) % 4 != 2}.items())
    x = np.array([quality.features(t) for _, t in learnt]).astype(np.float16).astype(np.float32)
    model = quality.fit_pairs(x, np.array([labels[i] > 0 for i, _ in learnt]))
    rows = [r for r in rows if model.scores(np.array([quality.features(r[1])]))[0] >= 0.7]

    sites, first = collections.defaultdict(set), {}
    for i, t, source in sorted(rows):
        for at, line in enumerate(t.split("\n")):
            sites[line].add(source)
            first.setdefault(line, (i, at))
    rows = [(i, "\n".join(line for at, line in enumerate(t.split("\n")) if len(sites[line]) < 10 or not line.strip() or first[line] == (i, at)), s) for i, t, s in rows]

    best = {}
    for (i, t, _), c in zip(rows, plain_classes([t for _, t, _ in rows]), strict=True):
        best[c] = min(best.get(c, (i, t)), (i, t), key=lambda r: (r[0], hashlib.md5(r[1].encode()).digest()))
    texts = {i: pii.masked(t, [(k, a, b, True) for k, a, b in plain_base(t)]) for i, t in best.values()}
    assert len(texts) == len(best) < len(rows)

    slow, want = Tokenizer.from_file(public_tokenizers.path(queries.TOKENIZER)), {}
    for i, t in texts.items():
        ids = np.array([*slow.encode(t, add_special_tokens=False).ids, 2], "<u4")
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids), 1024), len(ids)]
        want |= {(i, k): (a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))}
    out = corpus_pipeline.run(spark, path).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in out} == want and len(out) == len(want)
    held = collections.defaultdict(list)
    for r in out:
        held[r.sequence_id].append((r.offset, r.length))
    for spans in held.values():
        spans.sort()
        assert all(a + n == b for (a, n), (b, _) in zip([(0, 0), *spans], spans, strict=False)) and sum(spans[-1]) <= 1024
    assert len(held) <= 1.05 * sum(n for _, n, _ in want.values()) / 1024 + 8


def test_run_equals_the_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, folder)
        if i < 4:
            docs.write.mode("overwrite").parquet(f"{folder}/stage{i}")
            docs = spark.read.parquet(f"{folder}/stage{i}")
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    a, b = docs.select(*cols), corpus_pipeline.run(spark, folder).select(*cols)
    assert a.count() > 300 and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_of_a_star_and_of_each_pair_in_a_family_one_document_stays(spark, folder):
    texts = star(10_000) + family(150)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], spark.read.parquet(f"{folder}/documents.parquet").schema)
    stay = sorted(r.doc_id for r in corpus_pipeline.one_of_each(spark, docs, folder).select("doc_id").collect())
    # star() and family() are compared with brute force in test_operators; a family's pairs are neighbours.
    assert stay == [0, *range(10_001, 10_301, 2)]


def test_thresholds_are_the_production_ones():
    assert (line_dedup.SITES, near_dedup.SIMILARITY, near_dedup.SHINGLE, quality.CUT) == (10, 0.8, 5, 0.7)
