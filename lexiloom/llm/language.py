"""Language identification by prediction by partial matching (operator 11).

Each language has a tree of byte contexts of up to ORDER bytes with the counts of the bytes that followed. A text's code
length under a language is exact: a byte unseen in a context costs an escape there, and is then looked for in the next
shorter context, without the bytes that the longer one knows. Statistics are frozen after training. The language with
the shortest code wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.llm.common import cleared, column, mapped, slices, stored, whole_text

#: Bytes of the longest context; a text starts behind as many zero bytes.
ORDER = 4
#: Grams of ORDER + 1 bytes that a language's tree keeps: the most frequent ones of all its training texts.
GRAMS = 400_000
#: Distinct grams that a counting task holds before it passes them on.
HELD = 1 << 21
UNKNOWN = "und"
_LETTER = r"\p{L}"


def grams(raw: bytes, order: int = ORDER) -> np.ndarray:
    """For each byte the number made of its context and itself, the byte last."""
    b = np.frombuffer(bytes(order) + raw, np.uint8).astype(np.uint64)
    n, out = len(raw), np.zeros(len(raw), np.uint64)
    for i in range(order + 1):
        out = out << np.uint64(8) | b[i : i + n]
    return out


def gram_counts(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """lang, gram, n over whole texts; each task adds up its own before anything is shuffled."""

    def run(batches):
        held: dict[str, list] = {}
        size = 0

        def merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
            keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            return keys, np.bincount(at, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)

        def out() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                keys, n = merged(parts)
                for a in range(0, len(keys), 1 << 16):
                    k = keys[a : a + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k)), pa.array(k.astype(np.int64)), pa.array(n[a : a + (1 << 16)])], ["lang", "gram", "n"])
            held.clear()

        for batch in batches:
            for part in slices([batch], "text"):
                langs, texts = np.array(column(part, "lang").to_pylist(), object), column(part, "text").to_pylist()
                for lang in sorted(set(langs)):
                    found = np.concatenate([grams(texts[i].encode(), order) for i in np.flatnonzero(langs == lang)])
                    parts = held.setdefault(lang, [])
                    parts.append(np.unique(found, return_counts=True))
                    size += len(parts[-1][0])
                if size > HELD:
                    held = {lang: [merged(parts)] for lang, parts in held.items()}
                    size = sum(len(p[0][0]) for p in held.values())
                    if size > HELD // 2:
                        yield from out()
                        size = 0
        yield from out()

    plain = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where("lang is not null and text is not null")
    return plain.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Tree:
    """One language's contexts, order by order: what each context's bytes cost, and what an escape from it costs.

    symbols[k] are sorted numbers of k context bytes and the byte, counts[k] how often it followed. contexts[k] are the
    sorted contexts with their total, distinct bytes, and the same of their next shorter context without the bytes they
    know themselves: rest_total, rest_distinct.
    """

    order: int
    symbols: list[np.ndarray] = field(default_factory=list)
    counts: list[np.ndarray] = field(default_factory=list)
    contexts: list[np.ndarray] = field(default_factory=list)
    total: list[np.ndarray] = field(default_factory=list)
    distinct: list[np.ndarray] = field(default_factory=list)
    rest_total: list[np.ndarray] = field(default_factory=list)
    rest_distinct: list[np.ndarray] = field(default_factory=list)

    @classmethod
    def of(cls, keys: np.ndarray, n: np.ndarray, order: int = ORDER) -> Tree:
        """From the counts of the longest grams, of which those of shorter ones are sums."""
        tree = cls(order)
        for k in range(order + 1):
            short, at = np.unique(keys & _mask(k + 1), return_inverse=True)
            c = np.bincount(at, n, len(short)).astype(np.int64)
            context, of = np.unique(short >> np.uint64(8), return_inverse=True)
            total, distinct = np.bincount(of, c, len(context)).astype(np.int64), np.bincount(of, minlength=len(context))
            if k:  # what the next shorter context has beside the bytes known here
                above = _at(tree.contexts[k - 1], context & _mask(k - 1))
                known = np.bincount(of, tree.counts[k - 1][_at(tree.symbols[k - 1], short & _mask(k))], len(context)).astype(np.int64)
                tree.rest_total.append(tree.total[k - 1][above] - known)
                tree.rest_distinct.append(tree.distinct[k - 1][above] - distinct)
            else:  # the bytes that the language doesn't have at all are equally likely
                tree.rest_total.append(256 - distinct)
                tree.rest_distinct.append(np.zeros(len(context), np.int64))
            for column_, value in zip((tree.symbols, tree.counts, tree.contexts, tree.total, tree.distinct), (short, c, context, total, distinct), strict=True):
                column_.append(value)
        return tree

    def bits(self, keys: np.ndarray) -> np.ndarray:
        """The code length of each gram's last byte behind the rest of it.

        A context's bytes have their counts as shares and the escape the number of distinct bytes; a context that knows
        all that is left has no escape to code.
        """
        out, open_ = np.zeros(len(keys)), np.ones(len(keys), bool)
        total, distinct = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        entered = np.zeros(len(keys), bool)  # whether a longer context was known, and what it leaves is in total and distinct
        for k in range(self.order, -1, -1):
            here = np.flatnonzero(open_)
            if not len(here):
                break
            at, known = _found(self.contexts[k], (keys[here] >> np.uint64(8)) & _mask(k))
            here, at = here[known], at[known]
            fresh = ~entered[here]
            t, d = np.where(fresh, self.total[k][at], total[here]), np.where(fresh, self.distinct[k][at], distinct[here])
            place, seen = _found(self.symbols[k], keys[here] & _mask(k + 1))
            hit, miss = here[seen], here[~seen]
            out[hit] += np.log2((t + d)[seen]) - np.log2(self.counts[k][place[seen]])
            open_[hit] = False
            escape = d[~seen] > 0  # else the shorter context has the same bytes only
            out[miss[escape]] += np.log2((t + d)[~seen][escape]) - np.log2(d[~seen][escape])
            total[miss], distinct[miss], entered[miss] = self.rest_total[k][at[~seen]], self.rest_distinct[k][at[~seen]], True
        rest = np.flatnonzero(open_)
        out[rest] += np.log2(np.where(entered[rest], np.maximum(total[rest], 1), 256))
        return out


def _mask(n: int) -> np.uint64:
    """The last n bytes."""
    return np.uint64((1 << 8 * n) - 1)


def _at(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    return np.searchsorted(table, keys)


def _found(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the keys are in a sorted table, and whether."""
    at = np.minimum(np.searchsorted(table, keys), max(len(table) - 1, 0))
    return at, table[at] == keys if len(table) else np.zeros(len(keys), bool)


class Lookup:
    """The code lengths of all grams that some language has seen, for all languages, behind a table of hashes."""

    def __init__(self, trees: dict[str, Tree]) -> None:
        self.trees = list(trees.values())
        self.keys = np.unique(np.concatenate([t.symbols[t.order] for t in self.trees]))
        self.cost = np.stack([t.bits(self.keys) for t in self.trees], 1)
        self.shift = np.uint64(64 - max(12, (4 * len(self.keys)).bit_length()))
        self.table = np.zeros(1 << (64 - int(self.shift)), np.int32)
        self.table[self._slot(self.keys)] = np.arange(len(self.keys))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def bits(self, raw: bytes) -> np.ndarray:
        """The code length of the bytes under each language."""
        out = np.zeros(len(self.trees))
        order = self.trees[0].order
        for a in range(0, len(raw), 1 << 18):
            before = raw[max(0, a - order) : a]
            keys = grams(before + raw[a : a + (1 << 18)], order)[len(before) :]
            at = self.table[self._slot(keys)]
            hit = self.keys[at] == keys
            if hit.all():
                out += np.bincount(at, minlength=len(self.keys)) @ self.cost if len(keys) > len(self.keys) else self.cost[at].sum(0)
                continue
            out += self.cost[at[hit]].sum(0)
            rare, n = np.unique(keys[~hit], return_counts=True)
            place, known = _found(self.keys, rare)
            out += n[known] @ self.cost[place[known]]
            out += np.array([n[~known] @ t.bits(rare[~known]) for t in self.trees])
        return out


@dataclass(frozen=True)
class Languages:
    """Frozen statistics: each language's grams and their counts, by name."""

    grams: dict[str, tuple[np.ndarray, np.ndarray]]
    order: int = ORDER

    @cached_property
    def lookup(self) -> Lookup | None:
        trees = {lang: Tree.of(keys, n, self.order) for lang, (keys, n) in sorted(self.grams.items())}
        return Lookup(trees) if trees else None


def train(docs: DataFrame, limit: int = GRAMS, order: int = ORDER) -> Languages:
    """Counts the grams of all of docs(text, lang), whole texts; rows with a null text or lang are left out.

    A language's tree keeps about its `limit` most frequent grams, so the model that reaches the driver and the workers
    is bounded; the counts are of all texts. Which count is the last one comes from the numbers of grams with each
    count, so that no task ranks a language's grams; of the grams with that count a share by their hashes is kept.
    """
    scratch: list[str] = []
    counted = stored(gram_counts(docs, order), "grams", scratch)
    by_count = counted.groupBy("lang", "n").agg(F.count(F.lit(1)).alias("size"))  # a row for each count that occurs
    above = F.sum("size").over(Window.partitionBy("lang").orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1))
    room = by_count.withColumn("room", F.least("size", F.greatest(limit - F.coalesce(above, F.lit(0)), F.lit(0)))).where("room > 0")
    fits = counted.join(room, ["lang", "n"]).where((F.col("room") == F.col("size")) | (F.pmod(F.xxhash64("gram"), "size") < F.col("room")))
    found = fits.select("lang", "gram", "n").toArrow()
    cleared(docs.sparkSession, scratch)
    langs, keys, counts = np.array(found["lang"].to_pylist(), object), found["gram"].to_numpy(), found["n"].to_numpy()
    out = {}
    for lang in sorted(set(langs)):
        here = np.flatnonzero(langs == lang)
        here = here[np.argsort(keys[here])]
        out[lang] = keys[here].astype(np.uint64), counts[here]
    return Languages(out, order)


def predict(docs: DataFrame, model: Languages) -> DataFrame:
    """doc_id, lang_pred, score for each row of docs(doc_id, text), repeated ones too; other columns are ignored.

    The shortest code wins, of equally short ones the least name. score is the winner's share of 2 ** -length among all
    languages: its posterior if all are equally likely. Null texts, texts without a letter, and all texts where no
    language was learnt are UNKNOWN with score 0.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # bounded by its limit for each language

    def make(batch: pa.RecordBatch) -> dict:
        lookup, names = shipped.value.lookup, sorted(shipped.value.grams)  # a worker keeps both
        langs, scores = [], []
        for text, letters in zip(column(batch, "text").to_pylist(), column(batch, "letters").to_pylist(), strict=True):
            if lookup is None or not letters:
                langs.append(UNKNOWN)
                scores.append(0.0)
                continue
            bits = lookup.bits(text.encode())
            best = int(bits.argmin())
            langs.append(names[best])
            scores.append(float(1 / np.exp2(np.clip(bits[best] - bits, -1000, 0)).sum()))
        return {"doc_id": column(batch, "doc_id"), "lang_pred": langs, "score": scores}

    plain = docs.select("doc_id", whole_text().alias("text"), F.coalesce(F.col("text").cast("string").rlike(_LETTER), F.lit(False)).alias("letters"))
    return mapped(plain, make, "doc_id long, lang_pred string, score double")
