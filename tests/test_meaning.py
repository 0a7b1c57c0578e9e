import pytest
from pyspark.sql import functions as F

from lexiloom.operators import similar, vectors
from lexiloom.operators.chunking import chunk_documents, chunk_knowledge
from lexiloom.operators.index import Index
from lexiloom.operators.retrieval import Retriever, discriminative, fold, fuse, maxsim, placed, ranked, ranks_of, relevant_docs, render_context, retrieval_means, retrieval_metrics, symptom_query


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.8, 0.6]), ("c", [0.0, 1.0]), ("z", [0.0, 0.0])], "token string, vec array<double>")


def test_unknown_pairs_stay_unknown(spark, table):
    got = {(r.a, r.b): r.sim for r in vectors.score_pairs(spark.createDataFrame([("a", "b"), ("a", "q"), ("a", "z")], "a string, b string"), table).collect()}
    assert got == {("a", "b"): pytest.approx(0.8), ("a", "q"): None, ("a", "z"): 0.0}


def test_most_similar_leaves_itself_out(spark, table):
    got = vectors.most_similar(spark.createDataFrame([("a",), ("q",)], "token string"), table, 2).orderBy("rank").collect()
    assert [(r.query, r.other, r.sim) for r in got] == [("a", "b", 0.8), ("a", "c", 0.0)]


def test_hubs_equal_means_of_pairs(table):
    got = {r.token: r.hub for r in vectors.hub_scores(table).collect()}
    assert got == {"a": pytest.approx(0.4), "b": pytest.approx(0.7), "c": pytest.approx(0.3)}


def test_separability(spark):
    scored = spark.createDataFrame([(True, 0.9), (True, 0.7), (False, 0.8), (False, 0.2), (True, None)], "link boolean, sim double")
    r = vectors.separability(scored).first()
    assert (r.link_min, r.link_max, r.other_min, r.other_max, r.overlap, r.best_threshold, r.best_accuracy, r.baseline, r.n) == (0.7, 0.9, 0.2, 0.8, True, 0.9, 0.75, 0.5, 4)
    assert vectors.separability(scored.limit(0)).first().n == 0


def test_rank_of_answer(spark, table):
    got = vectors.rank_of_answer(spark.createDataFrame([("a", "c"), ("a", "nope")], "token string, answer string"), table).orderBy("answer").collect()
    assert [(r.answer, r.rank) for r in got] == [("c", 2), ("nope", None)]


def test_coverage(spark, table):
    assert vectors.coverage(spark.createDataFrame([("a",), ("a",), ("q",)], "token string"), table).first() == (1, 2, 0.5)


def words(spark, *terms):
    return spark.createDataFrame([(t,) for t in terms], "term string")


def test_similar_tokens_unite_both_lists(spark):
    v = spark.createDataFrame([("후라이팬", [1.0, 0.0]), ("스마트폰", [0.9, 0.1]), ("프라이팬", [0.0, 1.0])], "token string, vec array<double>")
    rows = similar.similar_tokens(words(spark, "후라이팬"), words(spark, "후라이팬", "프라이팬", "프라이", "스마트폰", "도넛"), 1, v).orderBy("position").collect()
    assert [(r.token, r.similarity, r.vector_similarity) for r in rows] == [("스마트폰", rows[0].similarity, 0.994), ("프라이팬", 0.778, 0.0)]


def test_rules(spark):
    probes, vocabulary = words(spark, "후라이팬", "폰", "이어폰"), words(spark, "프라이팬", "이어폰케이스", "휴대이어폰", "도넛")
    found = similar.similar_tokens(probes, vocabulary).withColumn("query", F.col("probe"))
    variant = {r.query: r.synonyms for r in similar.rule_variant(found).collect()}
    assert variant["후라이팬"] == ["프라이팬", "후라이팬"]
    compound = {r.query: (r.word, r.parts) for r in similar.rule_compound(found).collect()}
    assert compound["이어폰"] in (("휴대이어폰", ["휴대", "이어폰"]), ("이어폰케이스", ["이어폰", "케이스"])) and "폰" not in compound
    meant = found.withColumn("vector_similarity", F.when(F.col("token") == "도넛", 0.9)).withColumn("similarity", F.lit(0.1))
    assert {r.family for r in similar.rule_semantic(meant).collect()} == {"synonym_gap"}
    latin = meant.withColumn("probe", F.lit("donut"))
    assert {r.family for r in similar.rule_semantic(latin).collect()} == {"cross_script"}


def test_garbage_split_needs_single_characters(spark):
    queries = spark.createDataFrame([("아답터", ["답", "터"]), ("후라이팬", ["후라이팬"])], "query string, tokens array<string>")
    probed = similar.probe_of(queries)
    found = similar.similar_tokens(probed.select(F.col("probe").alias("term")), words(spark, "어댑터", "프라이팬")).join(probed.select("query", "probe"), "probe")
    got = similar.rule_garbage_split(found, queries).collect()
    assert [(r.query, r.user_word, r.synonyms) for r in got] == [("아답터", "아답터", ["어댑터", "아답터"])]


def test_chunks(spark):
    body = "intro text\n## First\n" + "One sentence here. " * 12 + "\n\n## Second\nshort"
    docs = spark.createDataFrame([("K1", body), ("K2", ""), ("K3", "# only heading"), ("K4", None)], "doc_id string, text string")
    rows = chunk_documents(docs, 100, 0).orderBy("doc_id", "n").collect()
    k1 = [r for r in rows if r.doc_id == "K1"]
    assert [r.n for r in k1] == list(range(len(k1))) and k1[0].text == "intro text" and k1[0].heading == "" and k1[-1].heading == "Second" and k1[-1].chunk_id == f"K1#{len(k1) - 1}"
    assert all(len(r.text) <= 100 for r in k1) and {r.heading for r in k1} == {"", "First", "Second"}
    assert [r.text for r in rows if r.doc_id == "K3"] == ["# only heading"] and not [r for r in rows if r.doc_id in ("K2", "K4")]
    over = chunk_documents(docs, 100, 30).where("doc_id = 'K1' and heading = 'First'").orderBy("n").collect()
    assert over[1].text.startswith("One sentence here.") and len(over[1].text) > len(k1[2].text)


def test_knowledge_chunks_fall_back_to_the_title(spark):
    got = chunk_knowledge(spark.createDataFrame([("K1", "Title", "plain body")], "doc_id string, title string, body string")).first()
    assert (got.heading, got.display) == ("Title", "Title\nplain body")


def queries(spark, *rows):
    return spark.createDataFrame(rows, "query string, tokens array<string>")


@pytest.mark.parametrize("limit", [0, 10**6])
def test_maxsim_keeps_repeated_query_tokens(spark, table, limit):
    docs = spark.createDataFrame([("d1", ["a", "x"]), ("d2", ["c"]), ("d3", ["x"])], "doc_id string, tokens array<string>")
    got = {r.doc_id: r.score for r in maxsim(queries(spark, ("q", ["a", "a", "b", "unknown"])), docs, table, limit).collect()}
    assert got == {"d1": pytest.approx((1 + 1 + 0.8) / 3, abs=1e-6), "d2": pytest.approx(0.2, abs=1e-6)}


def test_fusion_and_folding(spark):
    schema = "query string, doc_id string, rank int"
    a, b = spark.createDataFrame([("q", "x", 1), ("q", "y", 2)], schema), spark.createDataFrame([("q", "y", 1), ("q", "z", 2)], schema)
    got = {r.doc_id: (r.rank_bm25, r.rank_dense, round(r.score, 6)) for r in fuse(a, b).collect()}
    assert got == {"x": (1, None, round(1 / 61, 6)), "y": (2, 1, round(1 / 62 + 1 / 61, 6)), "z": (None, 2, round(1 / 62, 6))}
    chunks = spark.createDataFrame([("q", "d#0", 3), ("q", "d#1", 1), ("q", "e#0", 2)], schema)
    owners = spark.createDataFrame([("d#0", "d"), ("d#1", "d"), ("e#0", "e")], "chunk_id string, doc_id string")
    assert {r.doc_id: r.rank for r in fold(chunks, owners).collect()} == {"d": 1, "e": 2}


def test_maxsim_leaves_out_only_what_cannot_be_among_the_best(spark, table):
    docs = spark.createDataFrame([(i, ["a", "c"][: 1 + i % 2] if i % 3 else ["c"]) for i in range(60)], "doc_id long, tokens array<string>").coalesce(2)
    asked = queries(spark, ("q", ["a", "b"]), ("r", ["c"]))
    every, few = maxsim(asked, docs, table), maxsim(asked, docs, table, keep=3)
    assert few.count() < every.count()
    assert sorted(ranked(placed(few), 3).collect()) == sorted(ranked(placed(every), 3).collect())


def test_ranks_of_equal_a_full_ranking(spark):
    rows = spark.range(3000).select((F.col("id") % 3).cast("string").alias("query"), F.col("id").alias("doc_id"), (F.col("id") * 7 % 50 / 10).alias("score"))
    wanted = rows.where("doc_id % 97 = 0").select("query", "doc_id")
    places = placed(rows)
    assert sorted(ranks_of(places, wanted).collect()) == sorted(ranked(places).join(wanted, ["query", "doc_id"]).collect())


def test_hybrid_needs_only_the_first_places(spark, table):
    import random

    rng = random.Random(4)
    docs = spark.createDataFrame([(i, [rng.choice("abcxyz") for _ in range(rng.randint(1, 6))]) for i in range(300)], "doc_id long, tokens array<string>")
    asked = queries(spark, ("q", ["a", "x", "y"]), ("r", ["c", "z"]))
    fused = fuse(ranked(placed(Index.of_tokens(docs).scores(asked))), ranked(placed(maxsim(asked, docs, table))))
    want = {q: [r.doc_id for r in sorted((r for r in fused.collect() if r.query == q), key=lambda r: (-r.score, r.doc_id))][:3] for q in "qr"}
    got = Retriever(docs, "hybrid", table).retrieve(asked).collect()
    assert {q: [r.doc_id for r in sorted((r for r in got if r.query == q), key=lambda r: r.rank)] for q in "qr"} == want


def test_retriever_modes(spark, table):
    docs = spark.createDataFrame([("d1", ["a", "x"]), ("d2", ["c", "x", "x"]), ("d3", ["y"])], "doc_id string, tokens array<string>")
    asked = queries(spark, ("q1", ["x", "a"]), ("q2", ["y"]))
    bm25 = Retriever(docs, "bm25").retrieve(asked).collect()
    assert {r.doc_id for r in bm25 if r.query == "q1"} == {"d1", "d2"} and not any(r.degraded for r in bm25)
    dense = Retriever(docs, "dense", table).retrieve(asked, 2).collect()
    assert [r.rank_bm25 for r in dense if r.query == "q2"] == [1]  # no known token: the other list
    hybrid = Retriever(docs, "hybrid", table).retrieve(asked).collect()
    assert next(r for r in hybrid if r.query == "q1" and r.rank == 1).doc_id == "d1"
    degraded = Retriever(docs, "hybrid").retrieve(asked).collect()
    assert all(r.degraded for r in degraded) and {(r.query, r.doc_id) for r in degraded} == {(r.query, r.doc_id) for r in bm25}
    with pytest.raises(ValueError):
        Retriever(docs, "other")


def test_retrieval_evaluation(spark):
    kb = spark.createDataFrame([("K1", ["f1"]), ("K2", ["f1", "f2"]), ("K3", []), ("K4", ["f2"])], "doc_id string, families array<string>")
    assert {r.doc_id for r in discriminative(kb).collect()} == {"K1", "K4"}
    rel = relevant_docs(spark.createDataFrame([("q", "f1"), ("p", "f2"), ("o", "f9")], "query string, family string"), kb)
    got = spark.createDataFrame([("q", "K3", 1), ("q", "K1", 2), ("p", "K3", 1)], "query string, doc_id string, rank int")
    assert retrieval_means(retrieval_metrics(got, rel)).first() == (0.5, 0.5, 0.25, 0.25, 2)


def test_context_and_symptoms(spark):
    rows = spark.createDataFrame([("q", 2, "T2", "b"), ("q", 1, "T1", "a")], "query string, rank int, title string, text string")
    assert render_context(rows).first().context == "[1] T1\na\n\n[2] T2\nb"
    assert symptom_query("아답터", ["답", "터"], 0, "garbage_split") == "아답터 garbage split no results split into single characters"


def test_bounds_from_lists_leave_the_best_whole(spark, monkeypatch):
    import random

    from lexiloom.operators import late

    monkeypatch.setattr(late, "DOCS", 50)
    rng, scored = random.Random(7), []
    vectors = spark.createDataFrame([(f"t{i}", [rng.gauss(0, 1) for _ in range(12)]) for i in range(400)], "token string, vec array<double>")
    docs = spark.createDataFrame([(i, [f"t{rng.randrange(450)}" for _ in range(rng.randint(0, 30))] if i % 90 else None) for i in range(900)], "doc_id long, tokens array<string>").repartition(3)
    asked = queries(spark, *((f"q{i}", [f"t{rng.randrange(450)}" for _ in range(rng.randint(1, 9))]) for i in range(20)))
    few, every = maxsim(asked, docs, vectors, 0, keep=4), maxsim(asked, docs, vectors, 0)
    assert sorted(ranked(placed(few), 4).collect()) == sorted(ranked(placed(every), 4).collect())
    whole = late.Late.scores
    monkeypatch.setattr(late.Late, "scores", lambda self, doc, *more: scored.append(len(doc)) or whole(self, doc, *more))
    known = vectors.select("token", F.transform("vec", lambda x: x / F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, y: s + y * y))).alias("u"))
    rows = asked.select("query", F.explode("tokens").alias("token")).groupBy("query", "token").agg(F.count(F.lit(1)).alias("times")).join(known.select("token"), "token").collect()
    one = late.Late.of(known, rows)
    best = late.Best(len(one.keys), 4)
    for batch in docs.toArrow().combine_chunks().to_batches():
        for ids, owner, at in one.parts(batch):
            one.among(best, owner, at, len(ids))
    assert sum(scored) < 900 * len(one.keys) / 4  # most documents are never compared with a query


def test_fusion_counts_in_the_tasks(spark, monkeypatch):
    import random

    from lexiloom.operators import late, retrieval

    monkeypatch.setattr(late, "DOCS", 70)
    rng, own = random.Random(3), []
    vectors = spark.createDataFrame([(f"t{i}", [rng.gauss(0, 1) for _ in range(6)]) for i in [*range(60), *range(200, 215)]], "token string, vec array<double>")
    docs = spark.createDataFrame([(i, [f"t{min(119, int(rng.expovariate(0.03)))}" for _ in range(rng.randint(1, 40))]) for i in range(1500)], "doc_id long, tokens array<string>").repartition(3)
    asked = queries(spark, *((f"q{i}", [f"t{200 + i}", f"t{60 + i}"]) for i in range(15)))  # a vector that no document has, a term without one: the lists have little in common
    fused = fuse(ranked(placed(Index.of_tokens(docs).scores(asked))), ranked(placed(maxsim(asked, docs, vectors)))).collect()
    monkeypatch.setattr(retrieval, "maxsim", None)  # which would give a row for each query and document
    monkeypatch.setattr(retrieval, "counts_before", lambda *a: own.extend(a[-1]) or late.counts_before(*a))
    got = Retriever(docs, "hybrid", vectors).retrieve(asked).collect()
    assert own
    for q in {r.query for r in fused}:
        want = sorted((r for r in fused if r.query == q), key=lambda r: (-r.score, r.doc_id))[:3]
        assert [(r.doc_id, r.rank_bm25, r.rank_dense) for r in want] == [(r.doc_id, r.rank_bm25, r.rank_dense) for r in sorted((r for r in got if r.query == q), key=lambda r: r.rank)]
