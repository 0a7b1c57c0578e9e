import json

import pytest

from lexiloom import cli
from tests.data import BROAD, GOOD, QRELS, QUERIES


@pytest.fixture(scope="module")
def paths(catalog, spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("cli")
    catalog.write.parquet(str(d / "docs"))
    rels = {}
    for q, doc, grade in QRELS:
        rels.setdefault(q, {})[doc] = grade
    (d / "eval.json").write_text(json.dumps([{"query": q, "family": f, "expected_patch_kinds": k, "qrels": rels[q]} for q, f, k in QUERIES]))
    (d / "good.json").write_text(json.dumps(GOOD))
    (d / "broad.json").write_text(json.dumps(BROAD))
    (d / "vectors.json").write_text(json.dumps({"model": "m", "dim": 2, "vectors": {"a": [1, 0], "b": [0.9, 0.1], "c": [0, 1]}}))
    (d / "pairs.json").write_text('{"a": "a", "b": "b", "link": true}\n{"a": "a", "b": "c", "link": false}\n')
    kb = [("K1", "spelling", "a word spelled otherwise: 후라이팬", ["spelling_variant"]), ("K2", "other", "nothing", ["synonym_gap"]), ("K3", "all", "후라이팬", ["spelling_variant", "synonym_gap"])]
    spark.createDataFrame(kb, "doc_id string, title string, body string, families array<string>").write.parquet(str(d / "kb"))
    return d


@pytest.mark.parametrize(
    ("command", "said"),
    [
        ("analyze --text 물티슈", "물티슈"), ("search --docs {d}/docs --query 프라이팬", "| P1 |"), ("evaluate --docs {d}/docs --evalset {d}/eval.json", "healthy"), ("diagnose --docs {d}/docs --evalset {d}/eval.json", "synonyms 프라이팬, 후라이팬"),
        ("heal --docs {d}/docs --evalset {d}/eval.json --ledger {d}/ledger.json", "heal rate: 1.0"), ("demo-trap --docs {d}/docs --evalset {d}/eval.json --good {d}/good.json --broad {d}/broad.json", "rejected"),
        ("export-es", "nori_tokenizer"), ("build-lake --root {d}/lake --docs 100 --rows 1000", "logs"), ("mine-logs --root {d}/lake", "후라이팬"), ("vector-probe --vectors {d}/vectors.json --pairs {d}/pairs.json", "100%"),
        ("baseline --docs {d}/docs --evalset {d}/eval.json --file {d}/base.json --action write", "baseline"), ("baseline --docs {d}/docs --evalset {d}/eval.json --file {d}/base.json", "ok"),
        ("treat --docs sample --evalset sample --query 쥬스 --knowledge sample", "outcome: accepted, 1 submitted, 5 turns"),
        ("scale-bench --docs {d}/docs --evalset {d}/eval.json --good {d}/good.json --broad {d}/broad.json --sizes 0,50", "True"), ("rag-eval --docs {d}/docs --evalset {d}/eval.json --knowledge {d}/kb --chunking none,200", "bm25, chunks 200"),
    ],
)
def test_command(command, said, paths, capsys, spark):
    assert cli.main(command.format(d=paths).split()) == 0
    assert said in capsys.readouterr().out


def test_a_query_that_isnt_healed_fails_the_command(capsys, spark):
    assert cli.main("treat --docs sample --evalset sample --query 랩탑".split()) == 1
    assert "No rule applies" in capsys.readouterr().out
