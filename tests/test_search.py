import math

import pytest
from pyspark.sql import functions as F

from lexiloom.operators import evaluation
from lexiloom.operators.analysis import Analyzer
from lexiloom.operators.config import AnalyzerConfig, CompoundExpansion, Prescription, SynonymGroup, UserWord
from lexiloom.operators.index import Engine, Index, reindexed
from lexiloom.sources import shared
from tests.data import BROAD, GOOD


def index(spark, docs):
    return Index.of_tokens(spark.createDataFrame(docs, "doc_id string, tokens array<string>"))


def ask(spark, *queries):
    return spark.createDataFrame([(" ".join(q), list(q)) for q in queries], "query string, tokens array<string>")


def test_order_by_score_then_id(spark):
    i = index(spark, [("b", ["x", "y"]), ("a", ["x", "y"]), ("c", ["x", "x"]), ("d", ["z", "z"])])
    hits = i.search(ask(spark, ["x"])).orderBy("rank").collect()
    assert [h.doc_id for h in hits] == ["c", "a", "b"] and hits[1].score == hits[2].score
    assert hits[0].matched_terms == ["x"]


def test_scores_equal_the_formula(spark):
    docs = [("a", ["x", "x", "y"]), ("b", ["y"]), ("c", []), ("d", ["x", "z", "z", "z"])]
    hit = {r.doc_id: r.score for r in index(spark, docs).search(ask(spark, ["x", "x", "z"])).collect()}
    n, avg = 4, 8 / 4

    def term(tf, dl, df):
        return math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg))

    assert hit == {"a": pytest.approx(term(2, 3, 2), abs=1e-4), "d": pytest.approx(term(1, 4, 2) + term(3, 4, 1), abs=1e-4)}


def test_empty_cases(spark):
    i = index(spark, [("a", ["x"])])
    assert i.search(ask(spark, ["unknown"])).isEmpty() and i.search(ask(spark, [])).isEmpty()
    none = index(spark, [])
    assert none.stats.first() == (0, 0.0) and none.search(ask(spark, ["x"])).isEmpty()


def test_empty_documents_count(spark):
    assert index(spark, [("a", ["x", "y"]), ("b", [])]).stats.first() == (2, 1.0)


def test_grep_ignores_spaces_and_case(engine):
    assert [r.doc_id for r in engine.grep("라이 팬세").collect()] == ["P2"]
    assert engine.grep("팬", limit=2).count() == 2 and engine.grep(" ").isEmpty()


def test_lookup(engine):
    assert engine.doc_tokens("P2").first().tokens == ["프라이팬", "세트", "주방", "필수"]
    with pytest.raises(LookupError):
        engine.doc_tokens("nope")


def test_metrics(spark):
    queries = spark.createDataFrame([("q",), ("none",), ("norels",)], "query string")
    qrels = spark.createDataFrame([("q", "a", 2), ("q", "b", 1), ("q", "z", 1), ("none", "a", 2)], "query string, doc_id string, grade int")
    hits = spark.createDataFrame([("q", "a", 1), ("q", "x", 2), ("q", "b", 3), ("norels", "x", 1)], "query string, doc_id string, rank int")
    got = {r.query: r for r in evaluation.metrics(queries, hits, qrels).collect()}
    dcg, ideal = 3 + 1 / 2, 3 + 1 / math.log2(3) + 1 / 2
    assert got["q"].ndcg == round(dcg / ideal, 4) and got["q"].recall == 0.6667 and got["q"].precision5 == 0.6667 and got["q"].hits_top == ["a", "x", "b"]
    assert got["none"][1:5] == (0.0, 0.0, 0.0, 0) and got["norels"][1:5] == (0.0, 0.0, 0.0, 1)


def test_means_of_nothing(spark):
    assert evaluation.means(spark.createDataFrame([], "query string, ndcg double, n_results long")).first() == (0.0, 0.0, 0)


def test_gate_accepts_a_minimal_patch_and_leaves_the_engine(engine, evalset):
    before = engine.analyzer.config
    verdict, sandbox = evaluation.run_gate(engine, *evalset, Prescription.from_dict(GOOD))
    assert verdict.accepted and verdict.target_before == 0.0 and verdict.target_after == 1.0 and verdict.regressions == ()
    assert engine.analyzer.config == before and sandbox.analyzer.config.synonym_map["후라이팬"] == "프라이팬"


def test_gate_rejects_a_broad_patch(engine, evalset):
    verdict, _ = evaluation.run_gate(engine, *evalset, Prescription.from_dict(BROAD))
    assert not verdict.accepted and "other queries" in verdict.reason and {r[0] for r in verdict.regressions} & {"프라이팬", "팬 굿즈"}
    assert verdict.feedback().startswith("rejected")


def test_gate_checks_the_target_first_and_the_mean_last(spark):
    def table(*rows):
        return spark.createDataFrame([(q, n, 1.0, 1.0, 3) for q, n in rows], "query string, ndcg double, recall double, precision5 double, n_results int")

    before = table(("t", 0.2), ("a", 0.9), ("b", 0.9))
    cases = [((0.2, 0.1, 0.9), "target not improved"), ((0.5, 0.1, 0.9), "regressions"), ((0.5, 0.88, 0.88), "")]
    for (t, a, b), reason in cases:
        assert evaluation.gate_table(before, table(("t", t), ("a", a), ("b", b)), "t").first().reason == reason
    after = table(("t", 0.3), ("a", 0.5), ("b", 0.5))
    assert evaluation.gate_table(before, after, "t", epsilon=0.5, mean_epsilon=0.02).first().reason == "mean dropped"


def test_gate_refuses_unknown_targets(engine, evalset):
    with pytest.raises(LookupError):
        evaluation.run_gate(engine, *evalset, Prescription.from_dict(GOOD | {"target_query": "nope"}))


def test_baseline_comparison(spark):
    schema = "query string, ndcg double, recall double, precision5 double"
    base = spark.createDataFrame([("same", 0.5, 0.5, 0.5), ("down", 0.9, 0.5, 0.5), ("up", 0.1, 0.5, 0.5), ("gone", 1.0, 1.0, 1.0), ("odd", None, 0.5, 0.5)], schema)
    now = spark.createDataFrame([("same", 0.49, 0.5, 0.5), ("down", 0.8, 0.5, 0.5), ("up", 0.9, 0.5, 0.5), ("new", 1.0, 1.0, 1.0), ("odd", 0.5, 0.5, 0.5)], schema)
    diff = evaluation.compare(base, now)
    status = {(r.query, r.metric): r.status for r in diff.collect()}
    assert status["same", "ndcg"] == "same" and status["down", "ndcg"] == "regression" and status["up", "ndcg"] == "improvement" and status["gone", "recall"] == "missing" and status["new", "recall"] == "added" and status["odd", "ndcg"] == "unknown"
    assert evaluation.baseline_ok(diff).first() == (False, 1, 1, 1, 1)
    assert evaluation.baseline_ok(evaluation.compare(base, base)).first().ok
    assert evaluation.baseline_ok(evaluation.compare(base.where("query != 'gone'"), base)).first().ok


def test_incremental_reindexing_equals_a_full_one(engine):
    old = engine.analyzer
    new = old.with_config(AnalyzerConfig(synonym_groups=(SynonymGroup(("프라이팬", "팬")),)))
    tokens = engine.docs.select("doc_id", old.tokens("text").alias("tokens"))
    got = {r.doc_id: r.tokens for r in reindexed(tokens, engine.docs, old, new).collect()}
    assert got == {r.doc_id: r.tokens for r in engine.docs.select("doc_id", new.tokens("text").alias("tokens")).collect()}
    assert reindexed(tokens, engine.docs, old, old) is tokens


def test_search_pushes_only_asked_terms_into_the_aggregation(engine, spark):
    hits = Index.build(engine.docs, Analyzer()).search(ask(spark, ["프라이팬"]))
    assert hits.count() == 2 and hits.where(F.col("score") <= 0).isEmpty()


@pytest.mark.parametrize("config", [
    AnalyzerConfig(),
    AnalyzerConfig(synonym_groups=(SynonymGroup(("프라이팬", "팬")),)),
    AnalyzerConfig(synonym_groups=(SynonymGroup(("프라이팬", "후라이팬")),), user_words=(UserWord("프라이"),)),
    AnalyzerConfig(compound_expansions=(CompoundExpansion("프라이팬", ("프라이", "팬")),)),
])
def test_a_stored_index_follows_configurations(engine, spark, config):
    name = f"test|{id(config)}"
    stored = engine.stored(lambda part, make: shared.kept(spark, f"{name}|{part}", make))
    for old in (stored, engine.with_config(AnalyzerConfig(synonym_groups=(SynonymGroup(("후라이팬", "팬")),))).stored(lambda part, make: shared.kept(spark, f"{name}|other|{part}", make))):
        now, fresh = old.with_config(config), Engine(engine.docs, engine.analyzer.with_config(config))
        assert sorted((r.doc_id, r.tokens) for r in now.tokens.collect()) == sorted((r.doc_id, r.tokens) for r in fresh.tokens.collect())
        for of in (lambda e: e.index.postings.select("term", "doc_id", "tf", "dl"), lambda e: e.index.doc_freq(), lambda e: e.index.stats, lambda e: e.search(ask(spark, ["프라이팬", "팬 굿즈"])).withColumn("matched_terms", F.array_join("matched_terms", " "))):
            assert sorted(of(now).collect()) == sorted(of(fresh).collect())


def test_passages_are_found_where_texts_hold_them(spark):
    docs = spark.createDataFrame([(1, "One two THREE four, five six"), (2, "two three four"), (3, "xtwo three fourx and more"), (4, None), (5, "five six")], "doc_id long, text string")
    passages = spark.createDataFrame([(1, "two three four"), (2, "three"), (3, "wo three fou"), (4, ", five"), (5, "no such words here"), (6, None), (7, "wo THREE four,")], "item long, text string")
    want = {(p.item, d.doc_id) for p in passages.collect() for d in docs.collect() if p.text and d.text and p.text in d.text}
    assert {tuple(r) for r in Engine(docs).holding(passages, "item").collect()} == want and len(want) > 5


def test_kept_tables_are_built_once_and_again_when_gone(spark):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    for _ in range(2):
        assert shared.kept(spark, "test|once", make).count() == 3
    assert len(made) == 1
    shared.dropped(spark)
    assert shared.kept(spark, "test|once", make).count() == 3 and len(made) == 2


def test_small_files_are_dealt_over_the_cores(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).coalesce(1).write.parquet(path)
    assert shared.spread(spark.read.parquet(path), path, "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
