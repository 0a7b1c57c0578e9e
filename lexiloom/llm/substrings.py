"""Substring dedup by prefix-partitioned suffix trees (operator 2).

A repeat is a window of WINDOW words that starts at two places at least. To find them all without sorting every suffix:

1. Each window is anchored at the leftmost of its least GRAM-word hashes, so equal windows have equal anchors. Windows
   in a row with one anchor form a run of at most WINDOW - GRAM + 1 windows; only the runs' hashes leave a task.
2. Runs whose anchor's gram occurs once hold no repeat. Equal runs are combined to one variant with a count before
   anything is grouped by gram, so groups of copies cost one row a task.
3. The variants of a gram form a group of suffixes. A small group's subtree is built in memory by refining prefixes
   of 1, 2, 4, ... words; its nodes WINDOW words deep with two suffixes or more are the repeats. A group that is too
   large is split by longer prefixes: its suffixes are keyed by their first WINDOW words and counted by aggregation.
4. The repeats go back to the documents as bit masks over runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.common import cleared, column, mapped, stored, whole_text

WINDOW, GRAM = 35, 8
SPAN = WINDOW - GRAM + 1
#: Variants of a gram that one task holds as a subtree, some 3 MB of hashes; larger groups split by longer prefixes.
GROUP = 8192
#: Words of suffixes that a task refines at once.
CHUNK = 400_000
#: Bytes of text that a worker hashes at once; words and their arrays take some thirty times as much.
SLICE = 1 << 20
_B1, _B2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def words_of(text: str) -> list[bytes]:
    """The words [^\\x20\\x09-\\x0D]+ in UTF-8: bytes split at ASCII blanks."""
    return text.encode().split()


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_HASHES = _Hashes()


def hashed(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _inverse(b: np.uint64) -> np.uint64:
    return np.uint64(pow(int(b), -1, 1 << 64))


class Rolling:
    """Hashes of any stretch of a sequence of hashes, in constant time each."""

    def __init__(self, h: np.ndarray, base: np.uint64) -> None:
        power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(h), base)]))
        self.inverse = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(h), _inverse(base))]))
        self.total = np.concatenate([[np.uint64(0)], np.cumsum(h * power[:-1])])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.total[end] - self.total[start]) * self.inverse[start] + (end - start).astype(np.uint64) * _B2)


def runs(h: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, number of windows, gram hash and content hash of each run in the documents' word hashes, one after another; owner: each word's document."""
    empty = (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2
    if len(h) < WINDOW:
        return empty
    gram = h[: len(h) - GRAM + 1].copy()
    for j in range(1, GRAM):
        gram = gram * _B1 + h[j : len(h) - GRAM + 1 + j]
    gram = _mix(gram)
    least, width = np.arange(len(gram)), 1
    while width < SPAN:  # the leftmost least of ever longer stretches
        step = min(width, SPAN - width)
        left, right = least[:-step], least[step:]
        least, width = np.where(gram[right] < gram[left], right, left), width + step
    starts = np.flatnonzero(owner[: len(h) - WINDOW + 1] == owner[WINDOW - 1 :])
    if not len(starts):
        return empty
    anchor = least[starts]
    first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (np.diff(starts) != 1)]))
    n = np.diff(np.append(first, len(starts)))
    at = starts[first]
    return at, n, gram[anchor[first]], Rolling(h, _B1)(at, at + n + WINDOW - 1)


def window_ranks(words: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Numbers the windows at `starts` so that equal ones, and only those, get one number: prefixes of 1, 2, 4, ... words refined to WINDOW words, as levels of a suffix tree."""
    rank, depth = np.unique(words, return_inverse=True)[1].ravel(), 1
    while depth < WINDOW:
        step = min(depth, WINDOW - depth)
        pair = rank[: len(rank) - step] * (int(rank.max()) + 1) + rank[step:]
        rank, depth = np.unique(pair, return_inverse=True)[1].ravel(), depth + step
    return rank[starts]


def _subtrees(variants: list[tuple[int, int, int, int, bytes]]) -> list[tuple[int, int, int]]:
    """(gram, content, mask) of variants (gram, content, windows, count, words) whose groups are complete; a mask's bit j: window j occurs twice at least."""
    words = np.frombuffer(b"".join(v[4] for v in variants), np.uint64)
    n = np.array([v[2] for v in variants])
    begin = np.concatenate([[0], np.cumsum(n + WINDOW - 1)[:-1]])
    owner, j = np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    node = window_ranks(words, begin[owner] + j)
    often = np.bincount(node, np.array([v[3] for v in variants], float)[owner])[node] >= 2
    mask = np.bincount(owner, np.where(often, 2.0**j, 0), len(n)).astype(np.int64)
    return [(v[0], v[1], int(m)) for v, m in zip(variants, mask, strict=True)]


def _grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Subtrees of the groups in rows sorted by gram."""
    held: list = []
    size = 0

    def out(rows):
        cols = list(zip(*_subtrees(rows), strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["m", "s", "mask"])

    for batch in batches:
        for row in zip(*(column(batch, c).to_pylist() for c in ("m", "s", "n", "c", "words")), strict=True):
            if size >= CHUNK and held[-1][0] != row[0]:
                yield out(held)
                held, size = [], 0
            held.append(row)
            size += len(row[4]) // 8
    if held:
        yield out(held)


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each suffix of a large group's variants, keyed by two hashes of its first WINDOW words."""
    for batch in batches:
        n = np.asarray(column(batch, "n"))
        words = np.frombuffer(b"".join(column(batch, "words").to_pylist()), np.uint64)
        begin = np.concatenate([[0], np.cumsum(n.astype(np.int64) + WINDOW - 1)[:-1]]) if len(n) else np.zeros(0, np.int64)
        owner, j = np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at = begin[owner] + j
        keys = [Rolling(w, b)(at, at + WINDOW).view(np.int64) for w, b in ((words, _B1), (_mix(words), _B2))]
        yield pa.RecordBatch.from_arrays([column(batch, c).take(pa.array(owner)) for c in ("m", "s", "c")] + [pa.array(j.astype(np.int32)), *map(pa.array, keys)], names=["m", "s", "c", "j", "k1", "k2"])


def repeated_runs(docs: DataFrame) -> DataFrame:
    """doc_id, x (hash of the text), start, mask of the runs of docs(doc_id, x, text) that hold repeated windows: bit j stands for the window at word start + j."""

    def cut(batch: pa.RecordBatch) -> dict:
        words = [words_of(t) for t in column(batch, "text").to_pylist()]
        sizes = np.array([len(w) for w in words])
        begin = np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(len(words)), sizes)
        at, n, m, s = runs(np.concatenate([hashed(w) for w in words]), owner)
        of = owner[at] if len(at) else at
        return {"doc_id": column(batch, "doc_id").take(pa.array(of)), "x": column(batch, "x").take(pa.array(of)), "start": (at - begin[of]).astype(np.int32), "n": n.astype(np.int32), "m": m.view(np.int64), "s": s.view(np.int64)}

    scratch: list[str] = []
    every = stored(mapped(docs.select("doc_id", "x", "text"), cut, "doc_id long, x long, start int, n int, m long, s long", limit=SLICE), "runs", scratch)
    # The stored side of the join leaves Spark free to split a frequent gram's rows over tasks.
    twice = stored(every.groupBy("m").agg(F.count(F.lit(1)).alias("total")).where("total > 1").select("m"), "twice", scratch)
    again = stored(every.join(twice, "m"), "again")
    cleared(docs.sparkSession, scratch)
    variants = again.groupBy("m", "s").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("doc_id", "x", "start", "n")).alias("at"))
    groups = variants.groupBy("m").agg(F.count(F.lit(1)).alias("variants"))
    variants = stored(variants.join(groups, "m").select("m", "s", "c", "at.*", "variants"), "variants")

    needed = variants.where("variants > 1").groupBy(F.col("doc_id").alias("d"), F.col("x").alias("h")).agg(F.collect_list(F.struct("start", "n", "m", "s", "c", "variants")).alias("wanted"))
    texts = docs.join(needed, docs.doc_id.eqNullSafe(F.col("d")) & (docs.x == F.col("h")))

    def fetch(batch: pa.RecordBatch) -> dict:
        out: dict = {k: [] for k in ("m", "s", "n", "c", "variants", "words")}
        for text, wanted in zip(column(batch, "text").to_pylist(), column(batch, "wanted").to_pylist(), strict=True):
            h = hashed(words_of(text))
            for w in wanted:
                for k in ("m", "s", "n", "c", "variants"):
                    out[k].append(w[k])
                out["words"].append(h[w["start"] : w["start"] + w["n"] + WINDOW - 1].tobytes())
        return out

    contents = mapped(texts.select("text", "wanted"), fetch, "m long, s long, n int, c long, variants long, words binary", limit=SLICE)
    contents = stored(contents, "contents")
    small = contents.where(F.col("variants") <= GROUP).repartition("m").sortWithinPartitions("m", "s").mapInArrow(_grow, "m long, s long, mask long")
    suffixes = contents.where(F.col("variants") > GROUP).select("m", "s", "n", "c", "words").mapInArrow(_split, "m long, s long, c long, j int, k1 long, k2 long")
    often = suffixes.groupBy("k1", "k2").agg(F.sum("c").alias("total")).where("total > 1").select("k1", "k2")
    large = suffixes.join(often, ["k1", "k2"]).groupBy("m", "s").agg(F.bit_or(F.expr("shiftleft(1L, j)")).alias("mask"))
    alone = variants.where("variants = 1").select("m", "s", F.expr("shiftleft(1L, n) - 1").alias("mask"))
    masks = small.unionByName(large).unionByName(alone).where("mask != 0")
    return again.join(masks, ["m", "s"]).select("doc_id", "x", "start", "mask")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, joined by one space) for each row of docs.

    A word goes if a window of WINDOW words over it also starts anywhere else, in the same document or another; rows
    that repeat are documents of their own, so their windows are repeats. Null texts and texts of blanks have no words.
    Texts of fewer than WINDOW words stay whole. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text")).withColumn("x", F.xxhash64("text"))
    found = repeated_runs(rows).groupBy(F.col("doc_id").alias("d"), F.col("x").alias("h")).agg(F.collect_list(F.struct("start", "mask")).alias("runs"))
    joined = rows.join(found, rows.doc_id.eqNullSafe(F.col("d")) & (rows.x == F.col("h")), "left").select("doc_id", "text", "runs")

    def keep(batch: pa.RecordBatch) -> dict:
        out: dict = {"n_words": [], "n_removed": [], "kept": []}
        for text, found in zip(column(batch, "text").to_pylist(), column(batch, "runs").to_pylist(), strict=True):
            words = words_of(text)
            stay = words
            if found:
                start, mask = (np.array([r[k] for r in found], np.int64) for k in ("start", "mask"))
                run, bit = np.nonzero(mask[:, None] >> np.arange(SPAN) & 1)
                at = np.unique(start[run] + bit)
                covered = np.zeros(len(words) + 1, np.int64)
                np.add.at(covered, at, 1)
                np.add.at(covered, at + WINDOW, -1)
                stay = [w for w, c in zip(words, (np.cumsum(covered)[:-1] > 0).tolist(), strict=True) if not c]
            out["n_words"].append(len(words))
            out["n_removed"].append(len(words) - len(stay))
            out["kept"].append(b" ".join(stay).decode())
        return out | {"doc_id": column(batch, "doc_id")}

    return mapped(joined, keep, "doc_id long, n_words long, n_removed long, kept string", limit=SLICE)
