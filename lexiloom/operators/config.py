"""Analyzer configuration and the typed patches that extend it. Both are immutable and small: they live on the driver."""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import asdict, dataclass, field, replace

from lexiloom.schemas import FAMILIES


class InvalidConfig(ValueError):
    """A configuration or patch that breaks a rule."""


@dataclass(frozen=True)
class UserWord:
    """A word that analysis must keep whole."""

    form: str
    tag: str = "NNP"

    def __post_init__(self) -> None:
        if len(self.form.strip()) < 2 or " " in self.form.strip():
            raise InvalidConfig(f"a user word needs two characters at least and no blank: {self.form!r}")
        object.__setattr__(self, "form", self.form.strip())


@dataclass(frozen=True)
class SynonymGroup:
    """Terms that mean the same; the first is canonical."""

    terms: tuple[str, ...]

    def __post_init__(self) -> None:
        terms = tuple(t.strip() for t in self.terms)
        if len(terms) < 2 or not all(terms) or any(" " in t for t in terms) or len({t.lower() for t in terms}) < len(terms):
            raise InvalidConfig(f"a synonym group needs two terms at least, none empty, repeated or with blanks: {self.terms!r}")
        object.__setattr__(self, "terms", terms)

    @property
    def canonical(self) -> str:
        return self.terms[0]


@dataclass(frozen=True)
class CompoundExpansion:
    """A compound that is indexed whole and by its parts."""

    word: str
    parts: tuple[str, ...]

    def __post_init__(self) -> None:
        object.__setattr__(self, "parts", tuple(self.parts))
        if len(self.parts) < 2 or "".join(self.parts) != self.word:
            raise InvalidConfig(f"the parts, two at least, must add up to the word: {self.word!r} {self.parts!r}")


@dataclass(frozen=True)
class AnalyzerConfig:
    user_words: tuple[UserWord, ...] = ()
    synonym_groups: tuple[SynonymGroup, ...] = ()
    compound_expansions: tuple[CompoundExpansion, ...] = ()

    def extended(self, user_words: Iterable[UserWord] = (), synonym_groups: Iterable[SynonymGroup] = (), compound_expansions: Iterable[CompoundExpansion] = ()) -> AnalyzerConfig:
        """A new configuration with the additions; repeated words and overlapping groups are refused, letter case aside."""
        words, groups, parts = tuple(user_words), tuple(synonym_groups), tuple(compound_expansions)
        known = {w.form.lower() for w in self.user_words}
        compounds = {c.word.lower() for c in self.compound_expansions}
        grouped = {t.lower() for g in self.synonym_groups for t in g.terms}
        for w in words:
            if w.form.lower() in known:
                raise InvalidConfig(f"user word is there already: {w.form}")
            known.add(w.form.lower())
        for g in groups:
            if taken := {t.lower() for t in g.terms} & grouped:
                raise InvalidConfig(f"terms are in another synonym group: {sorted(taken)}")
            grouped |= {t.lower() for t in g.terms}
        for c in parts:
            if c.word.lower() in compounds:
                raise InvalidConfig(f"compound is there already: {c.word}")
            compounds.add(c.word.lower())
        return replace(self, user_words=self.user_words + words, synonym_groups=self.synonym_groups + groups, compound_expansions=self.compound_expansions + parts)

    @property
    def synonym_map(self) -> dict[str, str]:
        """Term to canonical form, lower case; later groups win."""
        return {t.lower(): g.canonical.lower() for g in self.synonym_groups for t in g.terms}

    @property
    def expansion_map(self) -> dict[str, tuple[str, ...]]:
        return {c.word.lower(): tuple(p.lower() for p in c.parts) for c in self.compound_expansions}

    @property
    def whole_words(self) -> dict[str, str]:
        """Forms that analysis keeps whole, with their tags: user words, and compounds as proper nouns."""
        return {c.word.lower(): "NNP" for c in self.compound_expansions} | {w.form.lower(): w.tag for w in self.user_words}

    def describe(self) -> dict:
        return {
            "user_words": [w.form for w in self.user_words],
            "synonym_groups": [list(g.terms) for g in self.synonym_groups],
            "compound_expansions": {c.word: list(c.parts) for c in self.compound_expansions},
        }

    def to_json(self) -> str:
        return json.dumps(asdict(self), ensure_ascii=False)

    @classmethod
    def from_json(cls, text: str) -> AnalyzerConfig:
        d = json.loads(text)
        return cls(tuple(UserWord(**w) for w in d["user_words"]), tuple(SynonymGroup(tuple(g["terms"])) for g in d["synonym_groups"]), tuple(CompoundExpansion(c["word"], tuple(c["parts"])) for c in d["compound_expansions"]))


@dataclass(frozen=True)
class Prescription:
    """A patch for one failing query: what is wrong, why, and what to add."""

    target_query: str
    diagnosis_family: str
    reasoning: str
    user_words: tuple[UserWord, ...] = ()
    synonym_groups: tuple[SynonymGroup, ...] = ()
    compound_expansions: tuple[CompoundExpansion, ...] = field(default=())

    def __post_init__(self) -> None:
        if not self.target_query.strip():
            raise InvalidConfig("a patch needs a target query")
        if self.diagnosis_family not in FAMILIES:
            raise InvalidConfig(f"unknown family: {self.diagnosis_family}")
        if len(self.reasoning) < 10:
            raise InvalidConfig("the reasoning needs ten characters at least")
        if not (self.user_words or self.synonym_groups or self.compound_expansions):
            raise InvalidConfig("an empty patch")

    @property
    def patch_kinds(self) -> tuple[str, ...]:
        named = (("user_word", self.user_words), ("synonym_group", self.synonym_groups), ("compound_expansion", self.compound_expansions))
        return tuple(k for k, v in named if v)

    def apply_to(self, config: AnalyzerConfig) -> AnalyzerConfig:
        return config.extended(self.user_words, self.synonym_groups, self.compound_expansions)

    def summary(self) -> str:
        said = [f"user word {w.form}" for w in self.user_words] + [f"synonyms {', '.join(g.terms)}" for g in self.synonym_groups] + [f"{c.word} = {' + '.join(c.parts)}" for c in self.compound_expansions]
        return "; ".join(said)

    def to_json(self) -> str:
        return json.dumps(asdict(self), ensure_ascii=False)

    @classmethod
    def from_dict(cls, d: dict) -> Prescription:
        """From plain values, as JSON and tools give them: groups as lists of terms or as {terms: ...}."""
        try:
            return cls(
                d["target_query"], d["diagnosis_family"], d["reasoning"], tuple(UserWord(**w) if isinstance(w, dict) else UserWord(w) for w in d.get("user_words") or ()),
                tuple(SynonymGroup(tuple(g["terms"] if isinstance(g, dict) else g)) for g in d.get("synonym_groups") or ()), tuple(CompoundExpansion(c["word"], tuple(c["parts"])) for c in d.get("compound_expansions") or ()),
            )
        except (KeyError, TypeError) as e:
            raise InvalidConfig(f"malformed patch: {e}") from e

    @classmethod
    def from_json(cls, text: str) -> Prescription:
        return cls.from_dict(json.loads(text))
