import pytest

from lexiloom.operators.analysis import Analyzer, ModelTokenizer, RegexTokenizer
from lexiloom.operators.config import AnalyzerConfig, CompoundExpansion, InvalidConfig, Prescription, SynonymGroup, UserWord
from tests.data import GOOD


def forms(spark, analyzer, text):
    return spark.createDataFrame([(text,)], "t string").select(analyzer.tokens("t").alias("v")).first().v


def test_default_analysis(spark):
    assert forms(spark, Analyzer(), "Some WORDS, some 12-34 é한글!") == ["some", "words", "some", "12", "34", "é한글"]
    assert forms(spark, Analyzer(), None) == forms(spark, Analyzer(), "") == []


def test_synonyms_apply_to_parts_of_compounds(spark):
    cfg = AnalyzerConfig(synonym_groups=(SynonymGroup(("휴지", "티슈")),), compound_expansions=(CompoundExpansion("물티슈", ("물", "티슈")),))
    row = spark.createDataFrame([("물티슈 캡",)], "t string").select(Analyzer(cfg).explain("t").alias("v")).first().v
    assert [tuple(t) for t in row] == [("물티슈", "NNP", "kiwi"), ("물", "NNG", "expansion"), ("휴지", "NNG", "synonym:티슈"), ("캡", "NNG", "kiwi")]


def test_later_groups_win_and_chains_stop(spark):
    cfg = AnalyzerConfig(synonym_groups=(SynonymGroup(("a1", "b1")), SynonymGroup(("c1", "a1"))))
    assert forms(spark, Analyzer(cfg), "b1 a1") == ["a1", "c1"]


def test_user_words_stay_whole(spark):
    cfg = AnalyzerConfig(user_words=(UserWord("c++"), UserWord("wi-fi"), UserWord("백팩")))
    assert forms(spark, Analyzer(cfg), "C++ and Wi-Fi6 wi-fi c") == ["c++", "and", "wi", "fi6", "wi-fi", "c"]
    assert forms(spark, Analyzer(cfg), "여행용백팩가방") == ["여행용", "백팩", "가방"]


def test_lexicon_tags_decide_what_is_dropped(spark):
    a = Analyzer(tokenizer=RegexTokenizer({"아답터": [("아", "IC"), ("답", "NNG"), ("터", "NNG")]}))
    assert forms(spark, a, "아답터") == ["답", "터"]
    dropped = spark.createDataFrame([("아답터",)], "t string").select(a.dropped("t").alias("v")).first().v
    assert [tuple(t) for t in dropped] == [("아", "IC")]


def test_model_tokenizer_gets_the_whole_words(spark):
    def load(words):
        return lambda text: [(w, words.get(w, "NNG" if len(w) > 1 else "JX")) for w in text.split()]

    a = Analyzer(AnalyzerConfig(user_words=(UserWord("이름"),)), ModelTokenizer(load))
    assert forms(spark, a, "이름 은 나무") == ["이름", "나무"]


@pytest.mark.parametrize("make", [lambda: UserWord("a"), lambda: UserWord("a b"), lambda: SynonymGroup(("a",)), lambda: SynonymGroup(("a", "a")), lambda: SynonymGroup(("a", "b c")), lambda: CompoundExpansion("abc", ("abc",)), lambda: CompoundExpansion("abc", ("a", "b"))])
def test_rules_of_entries(make):
    with pytest.raises(InvalidConfig):
        make()


def test_configurations_grow_without_overlap():
    cfg = AnalyzerConfig().extended([UserWord("word")], [SynonymGroup(("a1", "b1"))])
    for bad in ({"user_words": [UserWord("Word")]}, {"synonym_groups": [SynonymGroup(("c1", "B1"))]}):
        with pytest.raises(InvalidConfig):
            cfg.extended(**bad)
    assert AnalyzerConfig.from_json(cfg.to_json()) == cfg
    assert cfg.describe()["synonym_groups"] == [["a1", "b1"]]


def test_prescriptions():
    p = Prescription.from_dict(GOOD)
    assert p.patch_kinds == ("synonym_group",) and Prescription.from_json(p.to_json()) == p and "프라이팬" in p.summary()
    for bad in ({"reasoning": "short"}, {"diagnosis_family": "other"}, {"synonym_groups": []}, {"synonym_groups": [["x"]]}, {"target_query": " "}):
        with pytest.raises(InvalidConfig):
            Prescription.from_dict(GOOD | bad)
    with pytest.raises(InvalidConfig):
        Prescription.from_dict({"target_query": "x"})
