"""Segmentation by a lattice: all dictionary words at all places of a text, and the cheapest way through them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.operators.analysis import ModelTokenizer, Tokenizer

#: What a character outside all words costs, what joins a run of them, and what a word that must stay whole costs.
UNKNOWN, UNKNOWN_NEXT, WHOLE = 10.0, 4.0, 0.0
Word = tuple[str, str, float]


def learnt(words: DataFrame) -> list[Word]:
    """Entries from words(form, tag, n), a dictionary that fits into memory: a word costs the negative logarithm of its share."""
    total = words.agg(F.sum("n").alias("t"))
    rows = words.crossJoin(F.broadcast(total)).select("form", "tag", F.round(-F.log(F.col("n") / F.col("t")), 6).alias("cost"))  # one row
    return sorted((r.form, r.tag, r.cost) for r in rows.collect())


def lattice(dictionary: list[Word], whole: dict[str, str]) -> Callable[[str], list[tuple[str, str]]]:
    """Cuts a text into (form, tag): the path of least cost, of equally cheap ones that with the longer last word; linear in the text for words of bounded length.

    Separators belong to no path. A character that no word covers is unknown; neighbouring unknown ones are one form
    of tag UNK. Words in `whole` win wherever they stand.
    """
    import ahocorasick

    best_of: dict[str, tuple[float, str]] = {}
    for form, tag, cost in dictionary:
        if form and (form not in best_of or (cost, tag) < best_of[form]):
            best_of[form] = cost, tag
    best_of |= {form: (WHOLE, tag) for form, tag in whole.items() if form}
    trie = ahocorasick.Automaton()
    for form, (cost, tag) in best_of.items():
        trie.add_word(form, (len(form), cost, tag))
    if best_of:
        trie.make_automaton()

    def cut(text: str) -> list[tuple[str, str]]:
        n = len(text)
        ends: dict[int, list] = {}
        if best_of:
            for last, word in trie.iter(text):
                ends.setdefault(last + 1, []).append(word)
        # At each place the cheapest way there: cost, length of its last step, tag; unknown characters carry on a run.
        known, unknown = [0.0] + [float("inf")] * n, [float("inf")] * (n + 1)
        step: list[tuple[int, str]] = [(0, "")] * (n + 1)
        run = [0] * (n + 1)
        for j in range(1, n + 1):
            fresh, longer = min(known[j - 1], unknown[j - 1] + UNKNOWN - UNKNOWN_NEXT) + UNKNOWN, unknown[j - 1] + UNKNOWN_NEXT
            unknown[j], run[j] = (longer, run[j - 1] + 1) if longer <= fresh else (fresh, 1)
            for size, cost, tag in ends.get(j, ()):
                total = min(known[j - size], unknown[j - size]) + cost
                if total < known[j] or (total == known[j] and size > step[j][0]):
                    known[j], step[j] = total, (size, tag)
        out, j = [], n
        while j:
            if known[j] <= unknown[j]:
                size, tag = step[j]
            else:
                size, tag = run[j], "UNK"
            out.append((text[j - size : j], tag))
            j -= size
        return out[::-1]

    def segmented(text: str) -> list[tuple[str, str]]:
        return [m for part in _parts(text.lower()) for m in cut(part)]

    return segmented


def _parts(text: str) -> list[str]:
    """Runs of letters and digits."""
    return "".join(c if c.isalnum() else " " for c in text).split()


@dataclass(frozen=True)
class LatticeTokenizer(Tokenizer):
    """Morphemes by the cheapest path over a dictionary, in Arrow batches; words to keep whole cost nothing."""

    dictionary: tuple[Word, ...]

    def morphemes(self, text: Column, whole_words: dict[str, str]) -> Column:
        entries = self.dictionary
        return ModelTokenizer(lambda whole: lattice(list(entries), whole)).morphemes(text, whole_words)
