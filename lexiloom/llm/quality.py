"""Quality classifier by Bradley-Terry pairwise ranking (operator 9).

A document's strength is linear in features of its text: hashed word and character n-grams, and shares that describe
its shape. Pairs of a better and a worse document, of all labelled ones, give a logistic loss on the difference of their features.
The strengths' quantile at the share of bad labels becomes the threshold of the score.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.common import cleared, column, mapped, slices, stored, whole_text

#: Labelled rows that are fitted on the driver, all of them; more are fitted by jobs over groups of GROUP. Ids that are sent to the documents at most.
COLLECTED, GROUP, SHIPPED = 20_000, 512, 500_000
#: Rows of the rarer label that a group has on average at least.
RARER = 32
#: The score at the threshold.
CUT = 0.7
#: Places of hashed word and character n-grams, powers of two.
WORDS, CHARS = 512, 512
#: How far n-grams count beside the shape of a text, of which there are SHAPES features: the penalty on their weights is larger by its inverse square.
GRAM_SCALE, SHAPES = 0.1, 20
_MARKS = [b"!", b"*$%&#", b"|", b".", b",", b"0123456789", bytes(range(65, 91)), b"\n", b"<>{}[]=/\\_~^@"]
_SYMBOL = rb"[^\s\w.,;:!?'\")|\x80-\xff-]"
#: Runs of symbols or exclamation marks before a blank; a run is tried at its start only.
_TRAILED = re.compile(rb"(?<!%b)%b++(?=\s|$)|(?<!!)!!++(?=\s|$)" % (_SYMBOL, _SYMBOL))


def shape(text: str) -> list[float]:
    """Shares of marks, case, repetition and line shape; none depends on a language's words."""
    raw = text.encode()
    n = max(1, len(raw))
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words, lines = raw.split(), raw.split(b"\n")
    w = max(1, len(words))
    distinct = len(set(words)) / w
    again = sum(a == b for a, b in zip(words, words[1:], strict=False)) / w
    trailed = len(_TRAILED.findall(raw)) / w
    upper = sum(map(bytes.isupper, words)) / w
    marks = [float(sum(count[c] for c in m)) / w for m in _MARKS]
    return [*(min(1.0, 3 * x) for x in marks), distinct, again, trailed, upper, min(1.0, n / w / 20), len(set(lines)) / len(lines), min(1.0, np.log1p(w) / 10), min(1.0, 10 * again), min(1.0, 10 * trailed), min(1.0, 5 * marks[2]), 1 - distinct ** 2]


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = h = xxhash.xxh32_intdigest(word)
        return h


_HASHES = _Hashes()


def grams(text: str) -> np.ndarray:
    """Hashed words and pairs of words in WORDS places, hashed runs of three bytes in CHARS: square roots of their shares."""
    raw = text.lower().encode()
    out = np.zeros(WORDS + CHARS)
    one = np.fromiter(map(_HASHES.__getitem__, raw.split()), np.uint32)
    two = one[:-1] * np.uint32(0x9E3779B1) ^ one[1:]
    for h in (one, two):
        out[:WORDS] += np.bincount(h * np.uint32(0x85EBCA6B) >> np.uint32(32 - (WORDS.bit_length() - 1)), minlength=WORDS)
    for i in range(0, len(raw), 1 << 20):
        b = np.frombuffer(raw[i : i + (1 << 20) + 2], np.uint8).astype(np.uint32)
        h = (b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]) * np.uint32(0xC2B2AE35)
        out[WORDS:] += np.bincount(h >> np.uint32(32 - (CHARS.bit_length() - 1)), minlength=CHARS)
    for part in (out[:WORDS], out[WORDS:]):
        part /= max(1.0, part.sum())
    return np.sqrt(out)


def features(text: str) -> np.ndarray:
    return np.concatenate([shape(text), grams(text)]).astype(np.float32)


@dataclass(frozen=True)
class Ranker:
    """Strength = weights @ (features - mean) / spread; score = sigmoid((strength - threshold) / width + logit(CUT))."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    threshold: float
    width: float

    def strength(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.spread) @ self.weights

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((self.strength(x) - self.threshold) / self.width, -30, 30) + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-z))


def fit_pairs(x: np.ndarray, better: np.ndarray, pairs: int = 200_000, penalty: float = 1e-2, seed: int = 7) -> Ranker:
    """Newton's method, its steps by conjugate gradients, on the mean logistic loss of random (better, worse) pairs with an L2 penalty.

    The features' differences are never made: a pair acts through its two rows. Without both labels all texts score CUT.
    """
    k = x.shape[1]
    if not len(x) or better.all() or not better.any():
        return Ranker(np.zeros(k), np.ones(k), np.zeros(k), 0.0, 1.0)
    mean, parts = x.mean(0, dtype=float), [slice(i, i + 1024) for i in range(0, len(x), 1024)]  # no second copy of all rows
    spread = np.sqrt(sum(np.square(x[p] - mean).sum(0) for p in parts) / len(x)) + 1e-3
    spread[SHAPES:] /= GRAM_SCALE
    z, rng = np.empty(x.shape, np.float32), np.random.default_rng(seed)
    for p in parts:
        z[p] = (x[p] - mean) / spread
    good, bad = rng.choice(np.flatnonzero(better), pairs), rng.choice(np.flatnonzero(~better), pairs)

    def spread_out(p: np.ndarray) -> np.ndarray:
        """The rows of z weighted by what their pairs give them."""
        c = np.bincount(good, p, len(z)) - np.bincount(bad, p, len(z))
        return (c.astype(np.float32) @ z).astype(float) / pairs

    def differences(v: np.ndarray) -> np.ndarray:
        s = z @ v.astype(np.float32)
        return (s[good] - s[bad]).astype(float)

    w = np.zeros(k)
    for _ in range(12):
        p = 1 / (1 + np.exp(np.clip(differences(w), -30, 30)))
        g = spread_out(p) - penalty * w  # the way down
        if np.abs(g).max() < 1e-5:
            break
        curve = p * (1 - p)
        step, r = np.zeros(k), g.copy()
        d, rr = r.copy(), r @ r
        for _ in range(15):
            h = spread_out(curve * differences(d)) + penalty * d
            a = rr / (d @ h)
            step, r = step + a * d, r - a * h
            new = r @ r
            if new < 1e-4 * (g @ g):
                break
            d, rr = r + new / rr * d, new
        w = w + step
    s = z @ w
    share = 1 - better.mean()
    low, high = np.quantile(s, [max(0.0, share - 0.004), min(1.0, share + 0.004)])
    return Ranker(mean, spread, w, float((low + high) / 2), float(max(1e-3, s.std() / 4)))


def held_out(id_col: str | Column = "doc_id") -> Column:
    """The rows whose labels are never learnt from."""
    return F.coalesce(F.pmod(F.crc32((F.col(id_col) if isinstance(id_col, str) else id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def _chosen(labels: DataFrame) -> DataFrame:
    """doc_id, quality of the labels that may be learnt from; of several labels of an id the least counts."""
    return labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.min("quality").alias("quality"))


def _with_texts(docs: DataFrame, chosen: DataFrame, few: bool) -> DataFrame:
    """The chosen rows' columns and texts; few ids are sent to the documents."""
    return docs.select("doc_id", whole_text().alias("text")).join(F.broadcast(chosen) if few else chosen, "doc_id")


def train(docs: DataFrame, labels: DataFrame, collected: int = COLLECTED) -> Ranker:
    """Fits on all labelled rows: labels(doc_id, quality) that aren't held out, joined with docs.

    Null labels and labels of absent documents are ignored; of several labels of an id the least counts, and of several
    texts the least. Up to `collected` rows reach the driver as 16-bit features, some 2 kB each; more stay in the tasks
    that read them, see fit_groups().
    """
    chosen = _chosen(labels)
    good, bad = chosen.agg(F.count_if(F.col("quality") > 0), F.count_if(F.col("quality") <= 0)).first()
    if good + bad > collected and good and bad:
        return fit_groups(docs, chosen, good, bad)
    known = _with_texts(docs, chosen, True).groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    rows = mapped(known, lambda b: {"quality": column(b, "quality").cast(pa.int32()), "doc_id": column(b, "doc_id"), "x": [features(t).astype(np.float16).tobytes() for t in column(b, "text").to_pylist()]}, "doc_id long, quality int, x binary").collect()
    rows.sort(key=lambda r: r.doc_id)
    better, x = np.array([r.quality > 0 for r in rows], bool), np.frombuffer(b"".join(r.x for r in rows), np.float16).reshape(len(rows), len(features("")))
    del rows
    return fit_pairs(x, better)


def _groups(known: DataFrame) -> DataFrame:
    """own, better, x: a row for each group of known(part, own, doc_id, quality, text), sorted by part in each task; flags as bytes, features as 16-bit numbers."""

    def run(batches):
        held, part = ([], [], []), None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([b"".join(c)], pa.binary()) for c in held], ["own", "better", "x"])

        for batch in slices(batches, "text"):
            for at, own, quality, text in zip(*(column(batch, c).to_pylist() for c in ("part", "own", "quality", "text")), strict=True):
                if at != part and held[0]:
                    yield row()
                    held = ([], [], [])
                part = at
                for c, v in zip(held, (bytes([own]), bytes([quality > 0]), features(text).astype(np.float16).tobytes()), strict=True):
                    c.append(v)
        if held[0]:
            yield row()

    return known.mapInArrow(run, "own binary, better binary, x binary")


def fit_groups(docs: DataFrame, chosen: DataFrame, good: int, bad: int, penalty: float = 1e-2) -> Ranker:
    """fit_pairs() over all rows of chosen(doc_id, quality), which stay in Spark.

    Rows are dealt by a hash of their id into groups of GROUP; the pairs are all those of a better and a worse row of a
    group. Rows of the rarer label are dealt to several groups where a group would see less than RARER of them. The
    features are stored once; each step of L-BFGS is a job over them that returns a gradient for each task. The
    threshold is the quantile of all rows' strengths, to 2 ** -16 of their range.
    """
    spark, groups, scratch, k = docs.sparkSession, -(-(good + bad) // GROUP), [], len(features(""))
    copies = F.when(F.col("quality") > 0, -(-RARER * groups // good)).otherwise(-(-RARER * groups // bad))
    dealt = chosen.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least(copies, F.lit(groups)))))
    dealt = dealt.select("doc_id", "quality", (F.col("copy") == 1).cast("int").alias("own"), F.pmod(F.xxhash64("doc_id") + F.col("copy") - 1, F.lit(groups)).alias("part"))  # copies of a row go to different groups
    texts = _with_texts(docs, dealt, good + bad <= SHIPPED).repartition("part")
    known = texts.groupBy("part", "doc_id", "own", "quality").agg(F.min("text").alias("text")).sortWithinPartitions("part", "doc_id")
    rows = stored(_groups(known), "quality-groups", scratch)

    def total(use: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        """The sum of use(own, better, x) over all groups; a task sends one vector."""

        def run(batches):
            out = None
            for batch in batches:
                for own, better, x in zip(*(column(batch, c) for c in ("own", "better", "x")), strict=True):
                    x = np.frombuffer(x.as_buffer(), np.float16).reshape(-1, k).astype(np.float32)
                    v = use(np.frombuffer(own.as_buffer(), bool), np.frombuffer(better.as_buffer(), bool), x)
                    out = v if out is None else out + v
            if out is not None:
                yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], ["v"])

        found = [np.frombuffer(r.v, float) for r in rows.mapInArrow(run, "v binary").collect()]
        return np.sum(found, 0) if found else np.zeros(3)

    sums = total(lambda own, better, x: np.concatenate([[own.sum(), better[own].sum(), better.sum() * (~better).sum()], x[own].sum(0, dtype=float), np.square(x[own], dtype=float).sum(0)]))
    if not sums[2]:  # the labels' documents are absent
        cleared(spark, scratch)
        return fit_pairs(np.zeros((0, k)), np.zeros(0, bool))
    n, pairs, mean = sums[0], sums[2], sums[3 : 3 + k] / sums[0]
    spread = np.sqrt(np.maximum(sums[3 + k :] / n - mean**2, 0)) + 1e-3
    spread[SHAPES:] /= GRAM_SCALE

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        v = (w / spread).astype(np.float32)

        def of(own: np.ndarray, better: np.ndarray, x: np.ndarray) -> np.ndarray:
            s = (x @ v).astype(float)
            d = np.clip(s[better][:, None] - s[~better], -30, 30)
            p, c = 1 / (1 + np.exp(d)), np.zeros(len(s))
            c[better], c[~better] = p.sum(1), -p.sum(0)
            return np.concatenate([[-np.log1p(-p).sum()], (c.astype(np.float32) @ x).astype(float)])

        out = total(of) / pairs
        return out[0] + penalty / 2 * w @ w, penalty * w - out[1:] / spread

    w = _least(loss, np.zeros(k))

    def strengths(own: np.ndarray, x: np.ndarray) -> np.ndarray:
        return ((x[own] - mean) / spread) @ w

    moments = total(lambda own, better, x: np.array([strengths(own, x).sum(), np.square(strengths(own, x)).sum()]))
    std = np.sqrt(max(0.0, moments[1] / n - (moments[0] / n) ** 2))
    edges = moments[0] / n + std * np.linspace(-8, 8, (1 << 16) + 1)  # strengths beyond count in the first and the last bin
    places = rows.mapInArrow(_binned(lambda own, x: np.clip(np.searchsorted(edges, strengths(own, x), "right") - 1, 0, len(edges) - 2), k), "bin long").groupBy("bin").count().collect()
    count = np.zeros(len(edges) - 1)
    count[[r.bin for r in places]] = [r["count"] for r in places]
    cleared(spark, scratch)
    share, below = 1 - sums[1] / n, np.cumsum(count)
    low, high = (edges[1:][min(len(count) - 1, np.searchsorted(below, q * (n - 1), "right"))] for q in (max(0.0, share - 0.004), min(1.0, share + 0.004)))
    return Ranker(mean, spread, w, float((low + high) / 2), float(max(1e-3, std / 4)))


def _least(loss: Callable[[np.ndarray], tuple[float, np.ndarray]], w: np.ndarray, least: float = 1e-4, steps: int = 150) -> np.ndarray:
    """Where a smooth convex loss, given with its gradient, is least: L-BFGS with halved steps, until no part of the gradient reaches `least`."""
    (f, g), past = loss(w), []
    for _ in range(steps):
        if np.abs(g).max() < least:
            break
        d, a = g.copy(), []
        for s, y in reversed(past):
            a.append(s @ d / (s @ y))
            d -= a[-1] * y
        if past:
            d *= past[-1][0] @ past[-1][1] / (past[-1][1] @ past[-1][1])
        for (s, y), b in zip(past, reversed(a), strict=True):
            d += s * (b - y @ d / (s @ y))
        step = 1.0
        while (new := loss(w - step * d))[0] > f - 1e-4 * step * (g @ d) and step > 1e-6:
            step /= 2
        past = [*past[-19:], (-step * d, new[1] - g)] if (new[1] - g) @ (-step * d) > 0 else past
        w, (f, g) = w - step * d, new
    return w


def _binned(bins: Callable[[np.ndarray, np.ndarray], np.ndarray], k: int) -> Callable:
    """The bins of each group's own rows."""

    def run(batches):
        for batch in batches:
            for own, x in zip(column(batch, "own"), column(batch, "x"), strict=True):
                found = bins(np.frombuffer(own.as_buffer(), bool), np.frombuffer(x.as_buffer(), np.float16).reshape(-1, k).astype(np.float32))
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], ["bin"])

    return run


def score(docs: DataFrame, model: Ranker) -> DataFrame:
    """doc_id, score, predicted (1 from CUT on) for each row, repeated ones too. Null texts count as empty; other columns are ignored."""

    def make(batch: pa.RecordBatch) -> dict:
        x = np.array([features(t) for t in column(batch, "text").to_pylist()])
        s = model.scores(x)
        return {"doc_id": column(batch, "doc_id"), "score": s, "predicted": (s >= CUT).astype(np.int32)}

    return mapped(docs.select("doc_id", whole_text().alias("text")), make, "doc_id long, score double, predicted int")


def keep(docs: DataFrame, model: Ranker) -> DataFrame:
    """The rows of docs that the model accepts, with all their columns. Null texts are judged as empty ones."""
    kinds = docs.schema

    def run(batches):
        for batch in slices(batches, "text"):
            x = np.array([features(t or "") for t in column(batch, "text").to_pylist()])
            yield batch.filter(pa.array(model.scores(x) >= CUT))

    return docs.mapInArrow(run, kinds)
