"""Text analysis as one column expression: morphemes, part-of-speech filter, lower case, compound expansion, synonyms.

Tokens are array<struct<form, tag, origin>>. The order of steps is fixed, nothing is deduplicated, and synonyms also
apply to the parts of compounds. The same expression serves documents and queries.
"""

from __future__ import annotations

import re
from abc import ABC, abstractmethod
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.operators.config import AnalyzerConfig

# Prefixes of content words' tags.
CONTENT_TAGS = "^(NN|NR|NP|SL|SN|SH|XR|VV|VA)"
SEPARATOR = r"[^\p{L}\p{N}]+"
_RAW = "array<struct<form:string,tag:string>>"
#: Morphemes that a task holds as Python strings, those of a single text aside; the rest of a batch are Arrow columns.
MORPHEMES = 100_000


def _morphemes_of(forms: list[str], tags: list[str]) -> pa.Array:
    return pa.StructArray.from_arrays([pa.array(forms, pa.string()), pa.array(tags, pa.string())], ["form", "tag"])


class Tokenizer(ABC):
    """Splits a text into morphemes, array<struct<form, tag>>; it is told the words that must stay whole."""

    @abstractmethod
    def morphemes(self, text: Column, whole_words: dict[str, str]) -> Column: ...

    def content_forms(self, text: Column, whole_words: dict[str, str]) -> Column | None:
        return None


def default_tag(form: Column) -> Column:
    """Numbers SN, Latin words SL, Han SH, all else NNG."""
    return F.when(form.rlike(r"^\p{N}+$"), "SN").when(form.rlike(r"^\p{IsLatin}+$"), "SL").when(form.rlike(r"^\p{IsHan}+$"), "SH").otherwise("NNG")


@dataclass(frozen=True)
class RegexTokenizer(Tokenizer):
    """Runs of letters and digits. A lexicon may give a surface's morphemes: {surface: [(form, tag), ...]}, all lower case.

    With words to keep whole, or `longest` for a lexicon of a script without blanks, the longest match comes first;
    else the split needs no search. Lexicons are literals in the plan: use ModelTokenizer for large ones.
    """

    lexicon: dict[str, list[tuple[str, str]]] = field(default_factory=dict)
    longest: bool = False

    def _surfaces(self, text: Column, whole_words: dict[str, str]) -> Column:
        text = F.lower(text)
        if whole_words or (self.longest and self.lexicon):
            known = sorted({*whole_words, *(self.lexicon if self.longest else ())}, key=lambda w: (-len(w), w))
            bound = {w: re.match(r"[\w]", w) and not re.search(r"[가-힣぀-ヿ一-鿿]", w) for w in known}
            words = "|".join((rf"(?<![\p{{L}}\p{{N}}])\Q{w}\E(?![\p{{L}}\p{{N}}])" if bound[w] else rf"\Q{w}\E") for w in known)
            return F.regexp_extract_all(text, F.lit(rf"(?:{words})|[\p{{L}}\p{{N}}]+?(?={words})|[\p{{L}}\p{{N}}]+" if not all(bound.values()) else rf"(?:{words})|[\p{{L}}\p{{N}}]+"), F.lit(0))
        return F.filter(F.split(text, SEPARATOR), lambda s: s != "")

    def content_forms(self, text: Column, whole_words: dict[str, str]) -> Column | None:
        """Lower-case content forms without their tags, where every tag is a content word's; else None."""
        if self.lexicon or not all(re.match(CONTENT_TAGS, tag) for tag in whole_words.values()):
            return None
        return self._surfaces(text, whole_words)

    def morphemes(self, text: Column, whole_words: dict[str, str]) -> Column:
        surfaces = self._surfaces(text, whole_words)
        if not self.lexicon and not whole_words:
            return F.transform(surfaces, lambda s: F.struct(s.alias("form"), default_tag(s).alias("tag")))
        entries = {s: m for s, m in self.lexicon.items()} | {w: [(w, tag)] for w, tag in whole_words.items()}
        table = F.create_map(*(x for s, m in entries.items() for x in (F.lit(s), F.array(*(F.struct(F.lit(f).alias("form"), F.lit(t).alias("tag")) for f, t in m)))))
        return F.flatten(F.transform(surfaces, lambda s: F.coalesce(F.try_element_at(table, s), F.array(F.struct(s.alias("form"), default_tag(s).alias("tag"))))))


@dataclass(frozen=True)
class ModelTokenizer(Tokenizer):
    """A morphological analyzer in Arrow batches. `load` takes the words to keep whole and returns text -> [(form, tag)]; a worker loads it once for each set of words."""

    load: object

    def morphemes(self, text: Column, whole_words: dict[str, str]) -> Column:
        load, words = self.load, tuple(sorted(whole_words.items()))
        kept: dict = {}

        @F.arrow_udf(_RAW)
        def run(texts: pa.Array) -> pa.Array:
            if words not in kept:
                kept[words] = load(dict(words))
            parts, sizes = [], []
            forms, tags = [], []
            for x in texts:
                found = kept[words](x.as_py() or "")
                sizes.append(len(found))
                forms += [f for f, _ in found]
                tags += [t for _, t in found]
                if len(forms) >= MORPHEMES:
                    parts.append(_morphemes_of(forms, tags))
                    forms, tags = [], []
            values = pa.concat_arrays([*parts, _morphemes_of(forms, tags)])
            return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), values)

        return run(text)


@dataclass(frozen=True)
class Analyzer:
    config: AnalyzerConfig = AnalyzerConfig()
    tokenizer: Tokenizer = RegexTokenizer()

    def with_config(self, config: AnalyzerConfig) -> Analyzer:
        return Analyzer(config, self.tokenizer)

    def _morphemes(self, text: Column | str) -> Column:
        text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
        return self.tokenizer.morphemes(text, self.config.whole_words)

    def explain(self, text: Column | str) -> Column:
        """Tokens with tag and origin: kiwi for morphemes, expansion for parts of compounds, synonym:<old form> where a synonym changed the form."""
        content = F.filter(self._morphemes(text), lambda t: t["tag"].rlike(CONTENT_TAGS))
        tokens = F.transform(content, lambda t: F.struct(F.lower(t["form"]).alias("form"), t["tag"].alias("tag"), F.lit("kiwi").alias("origin")))
        if expansions := self.config.expansion_map:
            parts = F.create_map(*(x for w, ps in expansions.items() for x in (F.lit(w), F.array(*map(F.lit, ps)))))

            def expand(t: Column) -> Column:
                more = F.transform(F.coalesce(F.try_element_at(parts, t["form"]), F.array().cast("array<string>")), lambda p: F.struct(p.alias("form"), F.lit("NNG").alias("tag"), F.lit("expansion").alias("origin")))
                return F.concat(F.array(t), more)

            tokens = F.flatten(F.transform(tokens, expand))
        if synonyms := self.config.synonym_map:
            canonical = F.create_map(*(F.lit(x) for pair in synonyms.items() for x in pair))

            def normal(t: Column) -> Column:
                to = F.coalesce(F.try_element_at(canonical, t["form"]), t["form"])
                return F.struct(to.alias("form"), t["tag"].alias("tag"), F.when(to != t["form"], F.concat(F.lit("synonym:"), t["form"])).otherwise(t["origin"]).alias("origin"))

            tokens = F.transform(tokens, normal)
        return tokens

    def tokens(self, text: Column | str) -> Column:
        """The forms of explain(); where tags decide nothing, they aren't made."""
        plain = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
        forms = self.tokenizer.content_forms(plain, self.config.whole_words)
        if forms is None:
            return F.transform(self.explain(text), lambda t: t["form"])
        if expansions := self.config.expansion_map:
            parts = F.create_map(*(x for w, ps in expansions.items() for x in (F.lit(w), F.array(*map(F.lit, (w, *ps))))))
            forms = F.flatten(F.transform(forms, lambda f: F.coalesce(F.try_element_at(parts, f), F.array(f))))
        if synonyms := {t: c for t, c in self.config.synonym_map.items() if t != c}:
            canonical = F.create_map(*(F.lit(x) for pair in synonyms.items() for x in pair))
            forms = F.transform(forms, lambda f: F.coalesce(F.try_element_at(canonical, f), f))
        return forms

    def dropped(self, text: Column | str) -> Column:
        """The morphemes that the part-of-speech filter leaves out."""
        return F.filter(self._morphemes(text), lambda t: ~t["tag"].rlike(CONTENT_TAGS))

    def own_tokens(self, text: Column | str) -> Column:
        """Forms that come from the text itself, without expansions and synonyms."""
        return F.transform(F.filter(self.explain(text), lambda t: t["origin"] == "kiwi"), lambda t: t["form"])


def catalog_text(docs: DataFrame) -> DataFrame:
    """Catalog rows as documents: the text is name and description."""
    return docs.withColumn("text", F.concat_ws(" ", "name", "description"))


def kiwi_tokenizer() -> ModelTokenizer:
    """The Kiwi analyzer, where it is installed; user words get a high score so that they win."""

    def load(words: dict[str, str]):
        from kiwipiepy import Kiwi

        kiwi = Kiwi()
        for form, tag in words.items():
            kiwi.add_user_word(form, tag, 12.0)
        return lambda text: [(t.form, t.tag) for t in kiwi.tokenize(text)]

    return ModelTokenizer(load)
