import json
import threading
import urllib.request
from datetime import date

import pytest
from pyspark.sql import functions as F

from lexiloom.operators import evaluation, mining
from lexiloom.operators.config import AnalyzerConfig, CompoundExpansion, Prescription, SynonymGroup, UserWord
from lexiloom.plans import doctor, reports, scale
from lexiloom.plans.api import ToolProtocol, answer, serve
from lexiloom.plans.service import RepairService, Executor, SessionNotFound
from lexiloom.sources import files, lake, search_server, synthetic
from lexiloom.sources.store import PatchStore
from lexiloom.streaming.mining import start_mining
from tests.data import BROAD, GOOD


def test_lake_round_trip(spark, catalog, tmp_path):
    logs = synthetic.synthesize_query_log(spark, 2000, ["bad"], ["good", "fine"], days=5)
    lake.write_catalog(catalog, str(tmp_path), 1)
    lake.write_query_log(logs, str(tmp_path))
    assert lake.read_catalog(spark, str(tmp_path)).exceptAll(catalog).isEmpty()
    back = lake.read_query_log(spark, str(tmp_path))
    assert back.count() == 2000 and dict(back.dtypes)["ts"] == "date"
    stats = {r.name: r for r in lake.lake_stats(spark, str(tmp_path)).collect()}
    assert stats["logs"].partitions == 5 and stats["logs"].files == 5 and stats["catalog"].files == 1 and stats["logs"].rows == 2000
    pruned = mining.candidates(back, since=date(2026, 8, 11), until=date(2026, 8, 12))
    assert "PartitionFilters: [isnotnull(ts" in pruned._jdf.queryExecution().toString()


def test_synthetic_log_has_the_mix(spark):
    logs = synthetic.synthesize_query_log(spark, 20_000, ["bad1", "bad2"], ["good1", "good2"])
    again = synthetic.synthesize_query_log(spark, 20_000, ["bad1", "bad2"], ["good1", "good2"]).repartition(7)
    assert logs.exceptAll(again).isEmpty()
    r = logs.agg(F.avg(F.col("query").startswith("bad").cast("int")).alias("bad"), F.avg(F.col("query").startswith("good").cast("int")).alias("good"), F.count_if(F.col("clicked") & (F.col("n_results") == 0)).alias("odd")).first()
    assert abs(r.bad - 0.12) < 0.01 and abs(r.good - 0.63) < 0.01 and r.odd == 0
    assert logs.where("query like 'bad%' and n_results > 0").isEmpty()


def test_synthetic_catalog(spark, catalog):
    rows = synthetic.synthesize_catalog(spark, 500, original=catalog)
    assert rows.count() == 508 and rows.select("doc_id").distinct().count() == 508
    assert rows.where("name like '아이돌 팬%'").count() == 10


def test_mining(spark):
    rows = [("a", 0, False)] * 4 + [("b", 0, False)] * 2 + [("c", 5, True)] * 9 + [("d", 0, False)] + [("d", 1, True)] * 3
    logs = spark.createDataFrame([(date(2026, 8, 10), *r) for r in rows], "ts date, query string, n_results int, clicked boolean")
    got = [tuple(r) for r in mining.candidates(logs).collect()]
    assert got == [("a", 4, 4, 0, 1.0, 4), ("d", 4, 1, 3, 0.25, 1)]
    logs.createOrReplaceTempView("logs")
    assert [tuple(r) for r in spark.sql(mining.mining_sql()).collect()] == [g[:4] for g in got]
    with pytest.raises(ValueError):
        mining.mine(logs, "other")
    assert "| a |" in reports.candidates_report(mining.mine(logs))


def test_streaming_counts_equal_batch_ones(spark, tmp_path):
    logs = synthetic.synthesize_query_log(spark, 1000, ["bad"], ["good"], days=3)
    logs.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(logs.schema).parquet(str(tmp_path / "in"))
    start_mining(stream, str(tmp_path / "out"), str(tmp_path / "state"), once=True).awaitTermination(120)
    later = spark.createDataFrame([(date(2027, 1, 1), "end", 1, False)], logs.schema)
    later.write.mode("append").parquet(str(tmp_path / "in"))
    for _ in range(2):
        start_mining(stream, str(tmp_path / "out"), str(tmp_path / "state"), once=True).awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out")).groupBy("query").agg(F.sum("volume").cast("long").alias("volume"))
    assert out.exceptAll(logs.groupBy("query").agg(F.count(F.lit(1)).alias("volume"))).isEmpty() and out.count() > 2


def test_vector_cache(spark, tmp_path):
    v = spark.createDataFrame([("b", [0.123456789, 1.0]), ("a", [1.0, 2.0])], "token string, vec array<double>")
    path = str(tmp_path / "v.json")
    files.save_vectors(v, path, "model")
    assert json.loads(open(path).read()) == {"model": "model", "dim": 2, "vectors": {"a": [1.0, 2.0], "b": [0.12346, 1.0]}}
    assert {r.token: r.vec for r in files.load_vectors(spark, path).collect()} == {"a": [1.0, 2.0], "b": [0.12346, 1.0]}
    with pytest.warns(UserWarning):
        assert files.load_vectors_if_there(spark, str(tmp_path / "none.json")) is None


def test_vectors_are_built_once_a_token(spark):
    tokens = spark.createDataFrame([("ab",), ("ab",), ("c",)], "token string")
    got = files.build_vectors(tokens, lambda: lambda ts: [[len(t), 1] for t in ts])
    assert {r.token: r.vec for r in got.collect()} == {"ab": [2.0, 1.0], "c": [1.0, 1.0]}


def test_baseline_files(spark, engine, evalset, tmp_path):
    measured = evaluation.evaluate(engine, *evalset)
    files.write_baseline(measured, str(tmp_path / "b.json"))
    base, epsilon = files.load_baseline(spark, str(tmp_path / "b.json"))
    diff = evaluation.compare(base, measured, epsilon)
    ok = evaluation.baseline_ok(diff).first()
    assert ok.ok and "ok" in reports.baseline_report(ok, diff)


def test_repair_heals_spelling_variants(spark, engine, evalset):
    run = doctor.run_repair(engine, *evalset)
    got = {c.query: c for c in run.cases}
    assert got["후라이팬"].healed and got["도너츠"].healed and got["후라이팬"].patch.synonym_groups == (SynonymGroup(("프라이팬", "후라이팬")),)
    s = doctor.summary(run)
    assert s["heal_rate"] == s["diagnosis_accuracy"] == s["patch_match_rate"] == 1.0 and s["mean_ndcg_after"] == 1.0
    assert doctor.healthy_regressions(run, evalset[0]).isEmpty()
    entries = files.ledger(spark, run.accepted)
    assert [r.no for r in entries.orderBy("no").collect()] == [1, 2] and json.loads(files.ledger_json(entries))[0]["evidence"]["target_ndcg"] == [0.0, 1.0]
    assert "후라이팬" in files.ledger_markdown(entries) and "healed" in reports.repair_report(run)


def test_ladder_proposes_in_its_order(engine, evalset):
    rows = doctor.candidate_patches(engine, evalset[0].where("family is not null"), rules=doctor.LADDER).collect()
    assert min((r.priority, r.family) for r in rows if r.query == "후라이팬") == (0, "spelling_variant")


def test_sessions_end_on_verdicts(engine, evalset):
    def stubborn(transcript):
        return {"tool": "submit_prescription", "arguments": BROAD}

    out = doctor.session(Executor(engine, *evalset, target="후라이팬"), stubborn, "brief")
    assert out["outcome"] == "rejected" and out["submits"] == 3
    steps = iter([{"tool": "grep_documents", "arguments": {"text": "팬"}}, {"tool": "submit_prescription", "arguments": GOOD}])
    assert doctor.session(Executor(engine, *evalset, target="후라이팬"), lambda t: next(steps), "brief")["outcome"] == "accepted"
    assert doctor.session(Executor(engine, *evalset), lambda t: {}, "brief")["outcome"] == "stopped"


def test_tools_tell_errors(engine, evalset):
    x = Executor(engine, *evalset, target="후라이팬")
    for tool, arguments in [("nope", {}), ("search_products", {}), ("search_products", {"query": "a", "x": 1}), ("search_products", {"query": "a", "k": 1000}), ("inspect_document", {"doc_id": "nope"}), ("submit_prescription", GOOD | {"target_query": "도너츠"}), ("submit_prescription", GOOD | {"reasoning": "short"})]:
        assert x.execute(tool, arguments)["is_error"], (tool, arguments)
    assert [h["doc_id"] for h in x.execute("search_products", {"query": "프라이팬"})["content"]] == ["P1", "P2"]
    assert x.execute("analyze_text", {"text": "물티슈"})["content"]["tokens"] == [{"token": "물티슈", "tag": "NNG", "origin": "kiwi"}]
    assert x.execute("find_similar_tokens", {"term": "후라이팬", "k": 2})["content"]["tokens"][0]["token"] == "프라이팬"
    assert x.execute("inspect_document", {"doc_id": "P1"})["content"]["tokens"][0] == "경량"


@pytest.fixture
def service(spark, engine, evalset, tmp_path):
    return RepairService(engine, *evalset, store=PatchStore(spark, str(tmp_path / "store")))


def test_service_restores_sessions_by_replay(service, spark, engine, evalset):
    key = service.open("후라이팬")
    assert not service.submit(key, BROAD)["content"]["accepted"]
    assert service.submit(key, GOOD)["content"]["accepted"]
    other = service.open("도너츠")
    assert service.describe(other)["config"]["synonym_groups"] == []
    fresh = RepairService(engine, *evalset, store=service.store)
    assert fresh.describe(key) == {"session_id": key, "target_query": "후라이팬", "patches": 1, "config": {"user_words": [], "synonym_groups": [["프라이팬", "후라이팬"]], "compound_expansions": {}}}
    assert {s["session_id"]: s["n_patches"] for s in fresh.list_sessions()} == {key: 1, other: 0}
    fresh.delete(key)
    with pytest.raises(SessionNotFound):
        fresh.describe(key)
    assert "qrels" not in json.dumps(service.evalset(), ensure_ascii=False)


def test_routes(service):
    assert answer(service, "GET", "/health", {})[0] == 200
    status, opened = answer(service, "POST", "/sessions", {"target_query": "후라이팬"})
    key = opened["session_id"]
    assert status == 201 and answer(service, "POST", f"/sessions/{key}/prescriptions", BROAD)[0] == 202
    assert answer(service, "POST", f"/sessions/{key}/prescriptions", GOOD)[0] == 200
    assert "후라이팬 => 프라이팬" in json.dumps(answer(service, "GET", f"/sessions/{key}/elasticsearch", {})[1], ensure_ascii=False)
    assert answer(service, "GET", "/sessions/nope", {})[0] == answer(service, "POST", f"/sessions/{key}/tools", {"tool": "nope"})[0] == answer(service, "GET", "/nope", {})[0] == 404
    assert answer(service, "POST", "/search", {})[0] == answer(service, "POST", f"/sessions/{key}/prescriptions", {})[0] == 400
    assert answer(service, "GET", "/evaluate", {})[1]["healthy"]["mean_ndcg"] == 1.0
    assert answer(service, "GET", f"/evaluate?session_id={key}", {})[1]["all"]["mean_ndcg"] > answer(service, "GET", "/evaluate", {})[1]["all"]["mean_ndcg"]
    assert answer(service, "POST", "/sessions", {})[0] == 201 and answer(service, "GET", "/evaluate?session_id=nope", {})[0] == 404


def test_http(service):
    server = serve(service, port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    with urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}/health", timeout=30) as reply:
        assert json.loads(reply.read())["status"] == "ok"
    server.shutdown()


def test_tool_protocol(service):
    p = ToolProtocol(service)
    names = [t["name"] for t in p.handle({"id": 1, "method": "tools/list"})["result"]["tools"]]
    assert len(names) == 8 and "open_target" in names
    assert p.call("search_products", {"query": "x"})["is_error"]
    assert not p.call("open_target", {"query": "후라이팬"})["is_error"] and p.call("open_target", {"query": "nope"})["is_error"]
    reply = p.handle({"id": 2, "method": "tools/call", "params": {"name": "search_products", "arguments": {"query": "도넛"}}})
    assert json.loads(reply["result"]["content"][0]["text"])[0]["doc_id"] == "P3"
    assert p.handle({"id": 3, "method": "other"})["error"]["code"] == -32601 and p.handle({"method": "initialized"}) is None


def test_rendered_settings():
    cfg = AnalyzerConfig((UserWord("백팩"),), (SynonymGroup(("프라이팬", "후라이팬", "pan")),), (CompoundExpansion("물티슈", ("물", "티슈")),))
    s = search_server.render_settings(cfg)
    assert s["settings"]["analysis"]["tokenizer"]["own_tokenizer"]["user_dictionary_rules"] == ["백팩", "물티슈 물 티슈", "프라이팬", "후라이팬"]
    assert s["settings"]["analysis"]["filter"]["own_synonyms"]["synonyms"] == ["후라이팬, pan => 프라이팬"]
    assert search_server.validate_settings(s) == []
    s["settings"]["analysis"]["tokenizer"]["own_tokenizer"]["user_dictionary_rules"] = []
    assert len(search_server.validate_settings(s)) == 2
    assert search_server.validate_settings(search_server.render_settings(cfg, decompound_mode="none")) == []


def test_two_backends(spark, engine, evalset):
    measured = evaluation.evaluate(engine, *evalset)
    other = measured.withColumn("ndcg", F.when(F.col("query") == "도넛", 0.5).otherwise(F.col("ndcg")))
    diff = search_server.divergence(measured, other)
    assert [(r.query, r.delta) for r in diff.where("diverged").collect()] == [("도넛", -0.5)]
    changed = engine.analyzer.with_config(Prescription.from_dict(GOOD).apply_to(AnalyzerConfig()))
    tokens = search_server.token_difference(evalset[0], engine.analyzer, changed)
    assert [(r.query, r.only_a, r.only_b) for r in tokens.collect()] == [("후라이팬", ["후라이팬"], ["프라이팬"])]
    assert "도넛" in reports.divergence_report(diff, tokens)


def test_search_server_errors():
    s = search_server.SearchServer("http://127.0.0.1:9")
    assert not s.ping()
    with pytest.raises(search_server.ServerError):
        s.search("i", "q")


def test_scale_points(spark, catalog, evalset):
    points = scale.run_scale(spark, catalog, [0, 300], *evalset, Prescription.from_dict(GOOD), Prescription.from_dict(BROAD), "팬")
    assert scale.verdict_holds(points) and [p.n_docs for p in points] == [8, 308] and points[1].probe_df > points[0].probe_df
    assert scale.cost(points) is None and "Scale" in reports.scale_report(points)
    assert scale.cost([scale.ScalePoint(1000, 1, 1, True, False, 0, 1), scale.ScalePoint(10_000, 9, 10, True, False, 0, 1)])["time_ratio"] == 10.0
