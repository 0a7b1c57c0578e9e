import json
from concurrent.futures import ThreadPoolExecutor

import pytest

from lexiloom.operators import evaluation
from lexiloom.operators.analysis import catalog_text
from lexiloom.operators.config import Prescription
from lexiloom.operators.index import Engine
from lexiloom.plans import doctor, treatment
from lexiloom.plans.service import Executor
from lexiloom.sources import samples, search_server
from lexiloom.sources.store import TABLES, PatchStore
from tests.data import GOOD

FIXABLE = {"쥬스": "spelling_variant", "소세지": "spelling_variant", "컴퓨타": "spelling_variant", "물병": "compound_locked", "건조대": "compound_locked"}


@pytest.fixture(scope="module")
def sample(spark):
    queries, qrels = samples.load_evalset(spark)
    return Engine(catalog_text(samples.load_catalog(spark)).select("doc_id", "text", "name")), queries.cache(), qrels.cache()


@pytest.fixture(scope="module")
def patches(sample):
    engine, queries, _ = sample
    return treatment.candidates(engine, samples.failing_queries(queries), rules=doctor.LADDER)


def test_sample_sets_fit_together(spark, sample):
    engine, queries, qrels = sample
    assert qrels.join(engine.docs, "doc_id", "left_anti").isEmpty() and qrels.join(queries, "query", "left_anti").isEmpty()
    measured = {r.query: r for r in evaluation.evaluate(engine, queries, qrels).collect()}
    assert all(measured[r.query].ndcg > 0.95 for r in samples.healthy_queries(queries).collect())
    assert all(measured[r.query].n_results == 0 for r in samples.failing_queries(queries).collect())
    covered = {r.family: r.n_docs for r in samples.families_covered(samples.load_knowledge(spark)).collect()}
    assert covered == {"spelling_variant": 3, "compound_locked": 2, "garbage_split": 2, "cross_script": 3, "synonym_gap": 3}


def test_an_evaluation_set_is_checked(spark, tmp_path):
    row = {"query": "a", "qrels": {"1": 2}}
    for rows, said in (([row, row], "twice"), ([row | {"family": "weather"}], "weather")):
        (tmp_path / "e.json").write_text(json.dumps(rows))
        with pytest.raises(ValueError, match=said):
            samples.load_evalset(spark, tmp_path / "e.json")


def test_rules_find_what_letters_tell(patches):
    assert {q: p[0].diagnosis_family for q, p in patches.items()} == FIXABLE


def test_a_doctor_looks_four_times_then_submits(sample, patches):
    engine, queries, qrels = sample
    ask = treatment.RuleDoctor("쥬스", patches["쥬스"])
    done = treatment.treat(Executor(engine, queries, qrels), ask, "쥬스")
    tools = [t["content"]["tool"] for t in done.transcript if t["role"] == "doctor"]
    assert tools == ["search_products", "analyze_text", "grep_documents", "find_similar_tokens", "submit_prescription"]
    assert (done.healed, done.attempts, done.n_turns, done.diagnosis, done.patch_kinds) == (True, 1, 5, "spelling_variant", ("synonym_group",))
    assert ask.evidence["search_products"] == [] and ask.evidence["find_similar_tokens"]["tokens"][0]["token"] == "주스"


def test_giving_up(sample, patches):
    engine, queries, qrels = sample
    broad = Prescription.from_dict({"target_query": "쥬스", "diagnosis_family": "spelling_variant", "reasoning": "far too many meanings", "synonym_groups": [["컵", "노트북", "쥬스"]]})
    executor = Executor(engine, queries, qrels)
    none = treatment.treat(executor, treatment.RuleDoctor("랩탑", []), "랩탑")
    assert not none.healed and none.attempts == 0 and none.feedback.startswith("No rule applies: 0 results, 0 texts")
    once = treatment.treat(executor, treatment.RuleDoctor("쥬스", [broad, *patches["쥬스"]]), "쥬스")
    assert not once.healed and once.attempts == 1 and "no narrower" in once.feedback
    ladder = treatment.treat(executor, treatment.RuleDoctor("쥬스", [broad, *patches["쥬스"]], ladder=True), "쥬스")
    assert ladder.healed and ladder.attempts == 2 and executor.target == "쥬스"
    with pytest.raises(LookupError):
        treatment.treat(executor, treatment.RuleDoctor("?", []), "?")


def test_knowledge_is_retrieved_by_symptoms_for_all_queries_at_once(spark, sample):
    engine, queries, _ = sample
    rows = {r.query: r for r in treatment.contexts(engine, samples.failing_queries(queries), samples.load_knowledge(spark), k=2).collect()}
    assert set(rows) == {r.query for r in samples.failing_queries(queries).collect()}
    assert all(r.context.startswith("[1] ") and len(r.doc_ids) == 2 for r in rows.values())  # "no results" finds notes of it
    assert "K02" in rows["물병"].doc_ids and "(own notes)" in rows["물병"].context  # texts hold it, the search finds nothing


def test_briefs_and_prompts():
    assert treatment.brief("쥬스", 0) in treatment.brief("쥬스", 0, "[1] a note") and "[1] a note" in treatment.brief("쥬스", 0, "[1] a note")
    assert '"쥬스"' in treatment.brief("쥬스", 0) and "spelling_variant" in treatment.PROMPTS["full"] and "spelling_variant" not in treatment.PROMPTS["minimal"]
    with pytest.raises(ValueError, match="full, minimal"):
        treatment.ChatDoctor(None, "long")


class _Client:
    """Plays back replies and keeps what it was sent."""

    def __init__(self, *replies):
        self.replies, self.sent = list(replies), []

    def create(self, *, system, messages, tools):
        self.sent.append(json.loads(json.dumps(messages)))
        return self.replies.pop(0)


def test_a_chat_gets_its_blocks_back_and_all_results_at_once(sample, patches):
    engine, queries, qrels = sample
    use = lambda i, name, given: {"type": "tool_use", "id": i, "name": name, "input": given}
    first = [{"type": "thinking", "data": "kept"}, use("a", "analyze_text", {"text": "쥬스"}), use("b", "no_such_tool", {})]
    client = _Client({"content": first, "stop_reason": "tool_use"}, {"content": [use("c", "submit_prescription", json.loads(patches["쥬스"][0].to_json()))], "stop_reason": "tool_use"})
    done = treatment.treat(Executor(engine, queries, qrels), treatment.ChatDoctor(client, "minimal"), "쥬스")
    assert done.healed and done.n_turns == 3
    assert client.sent[1][1] == {"role": "assistant", "content": first}
    assert [(r["tool_use_id"], r["is_error"]) for r in client.sent[1][2]["content"]] == [("a", False), ("b", True)]
    refused = treatment.treat(Executor(engine, queries, qrels), treatment.ChatDoctor(_Client({"content": [], "stop_reason": "refusal"})), "쥬스")
    assert refused.outcome == "refused" and not refused.healed


def test_numbers_of_patches_in_a_database(spark, tmp_path):
    store = PatchStore(spark, str(tmp_path), f"jdbc:derby:{tmp_path}/db;create=true")
    assert store.migrate() == list(TABLES) and store.migrate() == []
    store.create_session("s", "후라이팬")
    verdict = evaluation.Verdict(**{f: True if f == "accepted" else None for f in evaluation.Verdict.__dataclass_fields__})
    with ThreadPoolExecutor(4) as pool:
        seqs = list(pool.map(lambda _: store.append_patch("s", Prescription.from_dict(GOOD), verdict, 1), range(4)))
    assert sorted(seqs) == [1, 2, 3, 4]
    assert [p.target_query for p in store.patches("s")] == ["후라이팬"] * 4
    assert store.sessions().first().n_patches == 4
    measured = spark.createDataFrame([("q", 0.5, 1.0, 0.2, 3)], "query string, ndcg double, recall double, precision5 double, n_results int")
    store.save_baseline("b", measured)
    assert store.load_baseline("b").first().ndcg == 0.5


class _Server:
    def search(self, index, query, k):
        return [(f"{query}{i}", 1.0 / i) for i in range(1, 4)][:k]


def test_a_server_is_asked_from_tasks(spark):
    queries = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "query string")
    found = search_server.search_all(queries, _Server(), "x", 2, 3)
    assert sorted((r.query, r.doc_id, r.rank) for r in found.collect()) == [("a", "a1", 1), ("a", "a2", 2), ("b", "b1", 1), ("b", "b2", 2)]
