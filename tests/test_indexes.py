"""Indexes against plain versions of what they find: spellings, vectors, blocks of postings, substrings, deltas, many patches."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lexiloom.functions import jamo
from lexiloom.operators import evaluation, lattice, patterns, retrieval, vector_index
from lexiloom.operators import index as index_module
from lexiloom.operators import analysis as analysis_module
from lexiloom.operators.analysis import Analyzer, ModelTokenizer
from lexiloom.operators.config import AnalyzerConfig, Prescription, SynonymGroup, UserWord
from lexiloom.operators.index import Engine, Index
from lexiloom.operators.patterns import SubstringIndex
from lexiloom.operators.spelling import SpellingIndex
from lexiloom.operators.vector_index import VectorIndex
from lexiloom.plans import doctor
from lexiloom.plans.doctor import repair_rates
from lexiloom.sources.shared import written


def keep(name, make):
    return written(make(), name)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_spellings_equal_a_comparison_with_the_whole_vocabulary(spark):
    rng = random.Random(3)
    terms = sorted({"".join(rng.choice("abcdef후라이팬케잌é") for _ in range(rng.randint(1, 9))) for _ in range(500)} | {"zzzz", "a" * 40})
    probes = [*rng.sample(terms, 15), "qqq", "", "후라이팬", "w" * 30, "abcabcabc"]
    spelled = {r.t: r.j for r in spark.createDataFrame([(t,) for t in {*terms, *probes}], "t string").select("t", jamo.to_jamo("t").alias("j")).collect()}
    found = SpellingIndex.of(spark.createDataFrame([(t,) for t in terms], "term string")).most_alike(spark.createDataFrame([(p,) for p in probes], "probe string"), 5).collect()
    got = {p: sorted((-round(r.similarity * 1000), r.token) for r in found if r.probe == p) for p in probes}
    for p in probes:
        a = spelled[p]
        want = sorted((-int((1 - edits(a, spelled[t]) / max(len(a), len(spelled[t]))) * 1000 + 0.5 + 1e-9), t) for t in terms if t != p)[:5]
        assert got[p] == want


def test_no_spelling_is_compared_with_all(spark):
    index = SpellingIndex.of(spark.createDataFrame([(t,) for t in ("abc", "abd", "xyz")], "term string"))
    plan = index.most_alike(spark.createDataFrame([("abe",)], "probe string"), 2)._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan and all("=" in line for line in plan.splitlines() if "Join Inner" in line)


def test_spellings_of_few_letters_meet_no_postings(spark):
    rng = random.Random(8)
    terms = sorted({"".join(rng.choice("가나") for _ in range(rng.randint(3, 12))) for _ in range(400)})
    spelled = {r.t: r.j for r in spark.createDataFrame([(t,) for t in terms], "t string").select("t", jamo.to_jamo("t").alias("j")).collect()}
    found = SpellingIndex.of(spark.createDataFrame([(t,) for t in terms], "term string")).most_alike(spark.createDataFrame([(t,) for t in terms[:4]], "probe string"), 3)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()  # all share all pairs of letters: a join by pairs multiplied the vocabulary
    for p in terms[:4]:
        want = sorted((-int((1 - edits(spelled[p], spelled[t]) / max(len(spelled[p]), len(spelled[t]))) * 1000 + 0.5 + 1e-9), t) for t in terms if t != p)[:3]
        assert sorted((-round(r.similarity * 1000), r.token) for r in found.collect() if r.probe == p) == want


def test_an_index_of_few_or_no_terms(spark):
    probes = spark.createDataFrame([("ab",), ("",)], "probe string")
    assert SpellingIndex.of(spark.createDataFrame([], "term string")).most_alike(probes, 3).count() == 0
    one = SpellingIndex.of(spark.createDataFrame([("ab",), ("zz",)], "term string")).most_alike(probes, 3).collect()
    assert sorted(map(tuple, one)) == [("", "ab", 0.0), ("", "zz", 0.0), ("ab", "zz", 0.0)]


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 1, (6, 12))
    rows = [(f"t{i:03d}", (centres[i % 6] + rng.normal(0, 0.4, 12)).tolist()) for i in range(300)]
    rows += [(f"c{i:03d}", rows[0][1]) for i in range(40)]  # copies
    rows += [("zero", [0.0] * 12), ("null", None), ("short", [1.0, 2.0]), ("short2", [2.0, 1.0])]
    return rows, spark.createDataFrame(rows, "token string, vec array<double>")


def units(rows):
    return {t: np.array(v) / np.linalg.norm(v) for t, v in rows if v and any(v)}


@pytest.mark.parametrize("part", [20_000, 10])
def test_most_similar_equals_all_pairs(spark, vectors, monkeypatch, part):
    monkeypatch.setattr(vector_index, "PART", part)
    monkeypatch.setattr(vector_index, "BLOCK", max(1, part // 10))
    rows, table = vectors
    u = units(rows)
    index = VectorIndex.of(table)
    asked = ["t000", "t001", "c000", "short"]
    got = index.most_similar(index.members.where(F.col("token").isin(asked)).select(F.col("token").alias("query"), "u"), 7).collect()
    for q in asked:
        others = [t for t in u if t != q and len(u[t]) == len(u[q])]
        want = sorted((-round(float(u[q] @ u[t]), 6), t) for t in others)[:7]
        assert sorted((-round(r.sim, 6), r.other) for r in got if r.query == q) == want


def test_places_of_answers_equal_all_pairs(spark, vectors):
    rows, table = vectors
    u = units(rows)
    index = VectorIndex.of(table)
    pairs = [("t000", "c005"), ("t000", "t299"), ("t010", "t016"), ("t010", "t011"), ("c001", "t000"), ("short", "short2")]
    sims = [(q, u[q].tolist(), a, round(float(u[q] @ u[a]), 6)) for q, a in pairs]
    got = {(r.query, r.answer): r.before for r in index.before(spark.createDataFrame(sims, "query string, u array<double>, answer string, sim double")).collect()}
    for q, _, a, sim in sims:
        others = [(round(float(u[q] @ u[t]), 6), t) for t in u if t != q and len(u[t]) == len(u[q])]
        assert got[q, a] == sum(s > sim or (s == sim and t < a) for s, t in others)


def test_cells_that_cannot_hold_a_better_one_are_not_visited(spark, vectors):
    index = VectorIndex.of(vectors[1])
    cells = index.cells
    u = units(vectors[0])["t000"]
    c, low, up, n = cells.bounds(u)
    inside = {r.cell: r for r in index.members.where("size(u) = 12").groupBy("cell").agg(F.collect_list("u").alias("us")).collect()}
    for cell, a, b, k in zip(c, low, up, n, strict=True):
        sims = np.array(inside[cell].us) @ u
        assert len(sims) == k and a - 1e-9 <= sims.min() and sims.max() <= b + 1e-9
    assert (up < 0.9).any()


def texts_of(rng, n):
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 3))) for _ in range(300)]
    weights = [1 / (i + 1) for i in range(len(words))]
    return [" ".join(rng.choices(words, weights, k=rng.randint(1, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(9)
    docs = spark.createDataFrame(list(enumerate(texts_of(rng, 400))), "doc_id long, text string")
    queries = spark.createDataFrame([(t,) for t in texts_of(rng, 15)] + [("absentword",), ("",)], "query string")
    return docs, queries


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_postings_are_counted_and_asked_without_a_shuffle(spark, corpus):
    docs, queries = corpus
    assert exchanges(Index.of_tokens(docs.select("doc_id", F.split("text", " ").alias("tokens"))).postings) == 0
    e = Engine(docs).stored(keep)
    assert exchanges(e.index.scores(e.tokenized(queries))) == 1  # sums by query and document


def test_many_touched_documents_are_counted_again(spark, corpus, monkeypatch):
    docs, _ = corpus
    config = AnalyzerConfig(synonym_groups=(SynonymGroup(("a", "b", "c")),))
    stored, want = Engine(docs).stored(keep).with_config(config), Engine(docs).with_config(config).index
    monkeypatch.setattr(index_module, "SHIPPED", 0)
    got = stored.index
    assert sorted(map(tuple, got.postings.select("term", "doc_id", "tf", "dl").collect())) == sorted(map(tuple, want.postings.select("term", "doc_id", "tf", "dl").collect()))
    assert sorted(map(tuple, got.doc_freq().collect())) == sorted(map(tuple, want.doc_freq().collect()))


@pytest.mark.parametrize("old, new", [
    ((), (("a", "b", "c"),)), ((), (("a", "b"), ("b", "c", "e"))), ((("a", "b"),), (("a", "b", "c"),)), ((("d", "e"),), (("d", "e"), ("f", "b", "none"))), ((), (("none", "a", "b"),)), ((("a", "b"),), (("a", "b"),)),
])
def test_a_change_of_synonyms_moves_postings_and_touches_no_document(spark, corpus, monkeypatch, old, new):
    docs, _ = corpus
    of = [Analyzer(AnalyzerConfig(synonym_groups=tuple(map(SynonymGroup, groups)))) for groups in (old, new)]
    stored, want = Engine(docs, of[0]).stored(keep).with_config(of[1].config), Engine(docs, of[1]).index
    monkeypatch.setattr(Engine, "_touched", property(lambda self: pytest.fail("documents are looked for")))
    got = stored.index
    for table, columns in (("postings", ("term", "doc_id", "tf", "dl")), ("doc_len", ("doc_id", "dl")), ("stats", ("n", "avgdl"))):
        assert sorted(map(tuple, getattr(got, table).select(*columns).collect())) == sorted(map(tuple, getattr(want, table).select(*columns).collect()))
    assert sorted(map(tuple, got.doc_freq().collect())) == sorted(map(tuple, want.doc_freq().collect()))
    assert exchanges(got.postings) == 0


@pytest.mark.parametrize("old, new", [((("a", "b"),), ()), ((("a", "b"),), (("a", "c"), ("d", "a"))), ((("a", "b"),), (("c", "b"),))])
def test_merged_forms_come_apart_by_their_documents(spark, corpus, old, new):
    docs, _ = corpus
    of = [Analyzer(AnalyzerConfig(synonym_groups=tuple(map(SynonymGroup, groups)))) for groups in (old, new)]
    got, want = Engine(docs, of[0]).stored(keep).with_config(of[1].config).index, Engine(docs, of[1]).index
    assert sorted(map(tuple, got.postings.select("term", "doc_id", "tf", "dl").collect())) == sorted(map(tuple, want.postings.select("term", "doc_id", "tf", "dl").collect()))
    assert sorted(map(tuple, got.doc_freq().collect())) == sorted(map(tuple, want.doc_freq().collect()))


@pytest.fixture
def no_guesses(spark):
    """Joins are broadcast where they are asked to be, as over tables whose size Spark doesn't know."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_tombstones_and_passages_go_to_the_postings(spark, corpus, no_guesses):
    docs, _ = corpus
    e = Engine(docs).stored(keep)
    delta = e.with_documents(docs.limit(3), docs.limit(6))
    assert exchanges(delta.index.postings) == exchanges(delta.index.doc_len) == 0
    held = e.holding(docs.select(F.col("doc_id").alias("key"), "text").limit(5), "key")
    assert exchanges(held) == 0 and held.count() >= 5


def test_lists_of_a_few_words_make_no_blocks(spark, corpus):
    docs, queries = corpus
    made = []
    e = Engine(docs).stored(lambda name, make: made.append(name) or keep(name, make))
    asked = e.tokenized(queries)
    got = retrieval.Retriever(e.tokens, "bm25", index=e.index).retrieve(asked, 3)
    seen = retrieval.symptoms(e, queries, patterns.Scan(docs))
    want = retrieval.symptoms(e, queries, SubstringIndex.of(docs))
    assert sorted(map(tuple, got.select("query", "doc_id", "rank").collect())) == sorted(map(tuple, e.index.best(asked, 3, bounds=False).select("query", "doc_id", "rank").collect()))
    assert sorted(map(str, seen.collect())) == sorted(map(str, want.collect())) and "blocks" not in made


@pytest.mark.parametrize("bucket", [4, 64])
def test_the_best_by_bounds_are_the_best_of_all_scores(spark, corpus, monkeypatch, bucket):
    monkeypatch.setattr(index_module, "BUCKET", bucket)
    docs, queries = corpus
    plain, stored = Engine(docs), Engine(docs).stored(keep)
    assert stored.index.blocks is not None
    for k in (1, 10):
        got, want = (sorted(map(tuple, e.search(queries, k).select("query", "doc_id", "rank", "score", F.array_join("matched_terms", " ")).collect())) for e in (stored, plain))
        assert got == want


def test_fusion_by_counting_equals_whole_lists(spark, corpus):
    docs, queries = corpus
    rng = np.random.default_rng(2)
    e = Engine(docs)
    terms = [r.term for r in e.index.vocabulary().orderBy("term").collect()]
    table = spark.createDataFrame([(t, rng.normal(0, 1, 6).tolist()) for t in terms[::2]], "token string, vec array<double>")
    asked = e.tokenized(queries)
    for k in (1, 4):
        got = retrieval.Retriever(e.tokens, "hybrid", table, index=e.index).retrieve(asked, k).collect()
        fused = retrieval.fuse(retrieval.ranked(retrieval.placed(e.index.scores(asked))), retrieval.ranked(retrieval.placed(retrieval.maxsim(asked, e.tokens, table)))).collect()
        for q in {r.query for r in fused}:
            want = sorted(((-r.score, r.doc_id, r.rank_bm25, r.rank_dense) for r in fused if r.query == q), key=lambda r: r[:2])[:k]
            assert [(round(-s, 6), d, b, v) for s, d, b, v in want] == [(r.score, r.doc_id, r.rank_bm25, r.rank_dense) for r in sorted((r for r in got if r.query == q), key=lambda r: r.rank)]


@pytest.mark.parametrize("keep_best", [None, 3])
def test_late_interaction_by_vectors_equals_the_table(spark, corpus, monkeypatch, keep_best):
    monkeypatch.setattr(retrieval, "ASKED", 7)
    monkeypatch.setattr(retrieval, "DOCS", 50)
    docs, queries = corpus
    rng = np.random.default_rng(5)
    e = Engine(docs)
    terms = [r.term for r in e.index.vocabulary().orderBy("term").collect()]
    table = spark.createDataFrame([(t, rng.normal(0, 1, 6).tolist()) for t in terms[::2]], "token string, vec array<double>")
    tokens = e.tokens.unionByName(spark.createDataFrame([(-1, None), (-2, [])], "doc_id long, tokens array<string>"))

    def best(df):
        ranks = df.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "doc_id")))
        return sorted(map(tuple, ranks.where(f"place <= {keep_best or 10**9}").collect()))

    got = retrieval.maxsim(e.tokenized(queries), tokens, table, limit=0, keep=keep_best)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()  # documents' tokens met every asked token in a join
    assert best(got) == best(retrieval.maxsim(e.tokenized(queries), tokens, table, keep=keep_best))


def test_changed_documents_equal_a_full_rebuild(spark, corpus):
    docs, queries = corpus
    changed = spark.createDataFrame([(0, "a b a new"), (5, ""), (7, None), (900, "entirely new words a")], "doc_id long, text string")
    deleted = spark.createDataFrame([(1,), (2,), (5000,)], "doc_id long")
    got = Engine(docs).stored(keep).with_documents(changed, deleted)
    want = Engine(docs.join(deleted.unionByName(changed.select("doc_id")), "doc_id", "left_anti").unionByName(changed))
    for part in ("postings", "doc_len", "stats"):
        a, b = (getattr(e.index, part) for e in (got, want))
        assert sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.select(a.columns).collect()), key=str)
    assert sorted(map(tuple, got.index.doc_freq().collect())) == sorted(map(tuple, want.index.doc_freq().collect()))
    for again in (got, got.stored(keep)):
        assert sorted(map(tuple, again.search(queries, terms=False).collect()), key=str) == sorted(map(tuple, want.search(queries, terms=False).collect()), key=str)
    twice, plain = (e.with_documents(spark.createDataFrame([(900, "again")], "doc_id long, text string")) for e in (got, want))
    assert sorted(map(tuple, twice.index.doc_freq().collect())) == sorted(map(tuple, plain.index.doc_freq().collect()))


def test_needles_of_any_length(spark):
    texts = {1: "The cat, the CAT", 2: "aab", 3: "", 4: None, 5: "x", 6: "ab ab c", 7: "éé漢字 한글"}
    needles = {"a": "cat", "b": "A", "c": "ab", "d": "thecat", "e": " ", "f": "x", "g": "abab", "h": "漢字한", "i": None, "j": "nowhere", "k": "aaab"}
    index = SubstringIndex.of(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    got = index.grep(spark.createDataFrame(list(needles.items()), "key string, needle string")).collect()

    def plain(t):
        return (t or "").lower().replace(" ", "")

    assert sorted(map(tuple, got)) == sorted((k, i) for k, n in needles.items() if plain(n) for i, t in texts.items() if t is not None and plain(n) in plain(t))


@pytest.mark.parametrize("group", [2_000_000, 5])
def test_needles_are_read_past_and_nothing_is_shuffled(spark, monkeypatch, group):
    monkeypatch.setattr(patterns, "GROUP", group)
    texts = {1: "The cat, the CAT", 2: "aab", 3: "", 4: None, 5: "x", 6: "ab ab c", 7: "éé漢字 한글"}
    needles = {"a": "cat", "b": "A", "c": "ab", "d": "thecat", "e": " ", "f": "x", "g": "abab", "h": "漢字한", "i": None, "j": "nowhere", "k": "aaab", "l": "A b", "m": "Ab"}
    found = patterns.Scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).grep(spark.createDataFrame(list(needles.items()), "key string, needle string"))

    def plain(t):
        return (t or "").lower().replace(" ", "")

    assert exchanges(found) == 0
    assert sorted(map(tuple, found.collect())) == sorted((k, i) for k, n in needles.items() if plain(n) for i, t in texts.items() if t is not None and plain(n) in plain(t))


@pytest.mark.parametrize("group", [2_000_000, 5])
def test_many_patterns_at_once(spark, monkeypatch, group):
    monkeypatch.setattr(patterns, "GROUP", group)
    texts = {1: "abcabc", 2: "bc", 3: "", 4: None, 5: "b c"}
    known = [("k1", "abc"), ("k2", "bc"), ("k3", ""), ("k4", None), ("k5", "bc"), ("k6", "c"), ("k7", "b c")]
    got = patterns.holding(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), spark.createDataFrame(known, "key string, pattern string")).collect()
    assert sorted(map(tuple, got)) == sorted((k, i) for k, p in known if p is not None for i, t in texts.items() if t is not None and p in t)


def test_many_patches_are_judged_as_each_by_itself(spark, corpus):
    docs, _ = corpus
    e = Engine(docs).stored(keep)
    words = [r.term for r in e.index.doc_freq().orderBy(F.desc("df"), "term").limit(12).collect()]
    rare = [r.term for r in e.index.doc_freq().orderBy("df", "term").limit(4).collect()]
    queries = spark.createDataFrame([("zz" + rare[0],), ("zz" + rare[1],), *((w,) for w in words[:6]), (f"{words[0]} {rare[2]}",)], "query string")
    qrels = e.search(spark.createDataFrame([(rare[0],), (rare[1],), *((w,) for w in words[:6])], "query string"), 5, terms=False).select(F.when(F.col("query").isin(rare), F.concat(F.lit("zz"), "query")).otherwise(F.col("query")).alias("query"), "doc_id", F.lit(2).alias("grade"))
    before = written(evaluation.evaluate(e, queries, qrels), "before")
    patches = [("p1", "zz" + rare[0], [rare[0], "zz" + rare[0]]), ("p2", "zz" + rare[1], [words[0], "zz" + rare[1], words[1]]), ("p3", "zz" + rare[1], [rare[1], "zz" + rare[1]]), ("p4", words[2], ["absent", "words"])]
    got = {r.patch_id: r for r in evaluation.gate_many(e, queries, qrels, spark.createDataFrame(patches, "patch_id string, target string, synonyms array<string>"), before).collect()}
    assert len(got) == 4
    for name, target, group in patches:
        patch = Prescription(target, "spelling_variant", "judged by itself", synonym_groups=(SynonymGroup(tuple(group)),))
        want = evaluation.gate_table(before, evaluation.evaluate(e.with_config(patch.apply_to(e.analyzer.config)), queries, qrels), target).first()
        assert {c: got[name][c] for c in want.asDict()} == want.asDict()


def test_a_repair_measures_independent_patches_in_one_job(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"alphaword{c} common") for i, c in enumerate("ab")], "doc_id long, text string")
    healthy = [(f"alphaword{c}", None, []) for c in "ab"]
    failing = [(f"qalphaword{c}", "spelling_variant", ["synonym_group"]) for c in "ab"] + [("zalphaworda", "spelling_variant", ["synonym_group"])]
    queries = spark.createDataFrame(healthy + failing, "query string, family string, expected_patch_kinds array<string>")
    qrels = spark.createDataFrame([(q, i, 2) for i, c in enumerate("ab") for q, _, _ in healthy + failing if q.endswith(f"alphaword{c}")], "query string, doc_id long, grade int")
    calls = []
    monkeypatch.setattr(doctor, "run_gate", lambda *a, f=doctor.run_gate, **b: calls.append(a[3].target_query) or f(*a, **b))
    run = doctor.run_repair(Engine(docs).stored(keep), queries, qrels)
    assert [c.healed for c in run.cases[:2]] == [True] * 2 and not {q for q, _, _ in failing[:2]} & set(calls)  # one by one before; the last shares a form with the first
    monkeypatch.setattr(doctor._Batch, "verdict", lambda *a: None)  # each by itself
    plain = doctor.run_repair(Engine(docs).stored(keep), queries, qrels)
    assert [(c.query, c.verdict, c.attempts, c.notes) for c in run.cases] == [(c.query, c.verdict, c.attempts, c.notes) for c in plain.cases]
    assert sorted(map(tuple, run.after.drop("hits_top").collect())) == sorted(map(tuple, plain.after.drop("hits_top").collect()))


def test_repair_rates(spark):
    schema = "family string, diagnosed string, healed boolean, expected_kinds array<string>, kinds array<string>"
    rows = [("a", "a", True, ["x"], ["x", "y"]), ("a", "b", False, ["x", "z"], ["x"]), ("b", None, None, [], ["x"]), ("c", "c", True, ["x"], None)]
    assert tuple(repair_rates(spark.createDataFrame(rows, schema)).first()) == (0.5, 0.5, 0.25)
    assert tuple(repair_rates(spark.createDataFrame([], schema)).first()) == (0.0, 0.0, 0.0)


def test_symptoms_and_contexts(spark):
    e = Engine(spark.createDataFrame([(1, "fry ing pan"), (2, "other")], "doc_id long, text string"))
    raw = SubstringIndex.of(e.docs)
    got = {r.query: r for r in retrieval.symptoms(e, spark.createDataFrame([("frying",), ("other",), ("a b",), ("nothing",)], "query string"), raw).collect()}
    assert (got["frying"].n_results, got["frying"].n_raw) == (0, 1) and got["frying"].symptoms == "frying frying no results though texts hold it"
    assert got["other"].symptoms == "other other" and got["a b"].symptoms == "a b a b no results split into single characters" and got["nothing"].n_raw == 0
    rows = spark.createDataFrame([("q", 1, "T", "body", "file.md"), ("q", 2, "U", "more", None)], "query string, rank int, title string, text string, source string")
    context = {r.query: r.context for r in retrieval.render_context(rows, spark.createDataFrame([("q",), ("none",)], "query string")).collect()}
    assert context == {"q": "[1] T (file.md)\nbody\n\n[2] U\nmore", "none": ""}


def plain_path(text, words, whole):
    """The least cost over all ways to cut a text, by trying them all with memory; a run of unknown characters is one step."""
    costs = {}
    for form, _, cost in words:
        costs[form] = min(cost, costs.get(form, 1e9))
    costs |= dict.fromkeys(whole, lattice.WHOLE)
    least = [(0.0,)] + [None] * len(text)
    for j in range(1, len(text) + 1):
        ways = []
        for i in range(j):
            if text[i:j] in costs:
                ways.append((least[i][0] + costs[text[i:j]],))
            ways.append((least[i][0] + lattice.UNKNOWN + (j - i - 1) * lattice.UNKNOWN_NEXT,))
        least[j] = min(ways)
    return least[-1][0]


def path_cost(cut, words, whole):
    costs = {}
    for form, _, cost in words:
        costs[form] = min(cost, costs.get(form, 1e9))
    costs |= dict.fromkeys(whole, lattice.WHOLE)
    return sum(lattice.UNKNOWN + (len(form) - 1) * lattice.UNKNOWN_NEXT if tag == "UNK" else costs[form] for form, tag in cut)


def test_the_lattice_finds_the_cheapest_path():
    rng = random.Random(11)
    for _ in range(300):
        words = [("".join(rng.choice("abc") for _ in range(rng.randint(1, 4))), rng.choice(["NNG", "VV"]), rng.choice([1.0, 2.5, 7.0])) for _ in range(6)]
        whole = {"abca": "NNP"} if rng.random() < 0.3 else {}
        text = "".join(rng.choice("abcd") for _ in range(rng.randint(0, 14)))
        cut = lattice.lattice(words, whole)(text)
        assert "".join(f for f, _ in cut) == text
        assert path_cost(cut, words, whole) == pytest.approx(plain_path(text, words, whole))


def test_morphemes_leave_python_in_parts(spark, monkeypatch):
    monkeypatch.setattr(analysis_module, "MORPHEMES", 3)  # not a batch's morphemes at once as Python objects
    load = lambda whole: lambda text: [(c, "NNG") for c in text]
    rows = spark.createDataFrame([(0, "abcdefgh"), (1, ""), (2, None), (3, "xy")], "doc_id int, text string").repartition(1)
    got = {r.doc_id: [tuple(m) for m in r.m] for r in rows.select("doc_id", ModelTokenizer(load).morphemes(F.col("text"), {}).alias("m")).collect()}
    assert got == {0: [(c, "NNG") for c in "abcdefgh"], 1: [], 2: [], 3: [("x", "NNG"), ("y", "NNG")]}


def test_lattice_as_a_tokenizer(spark):
    words = (("프라이", "NNG", 3.0), ("팬", "NNG", 3.0), ("프라이팬", "NNG", 9.0), ("을", "JKO", 1.0))
    a = Analyzer(tokenizer=lattice.LatticeTokenizer(words))
    df = spark.createDataFrame([("프라이팬을 Zz",), (None,), ("",)], "text string")
    assert [r.t for r in df.select(a.tokens("text").alias("t")).collect()] == [["프라이", "팬"], [], []]
    kept = a.with_config(AnalyzerConfig(user_words=(UserWord("프라이팬"),)))
    assert df.select(kept.tokens("text").alias("t")).first().t == ["프라이팬"]
    assert lattice.learnt(spark.createDataFrame([("a", "NNG", 3), ("b", "VV", 1)], "form string, tag string, n int")) == [("a", "NNG", 0.287682), ("b", "VV", 1.386294)]
