"""Vector code compression by the filtering algorithm for Lloyd's rounds (operator 13).

Vectors are cut into equal consecutive parts; each part position has a codebook of integer entries. Blocks of vectors
become kd-trees, one for each position, whose nodes carry bounding box, sum and count. A round sends its entries down
the trees: an entry that no point of a node's box can prefer is dropped there, and where one entry is left the whole
subtree is assigned at once, by its sum and count. The trees are made once and stored; every round reads them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from lexiloom.llm.common import cleared, column, mapped, stored

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Vectors of a tree, and points of a leaf at most.
BLOCK, LEAF = 4096, 32
#: Components of this size and more would take distances out of 64 bits.
LARGEST = 1 << 16
#: Nodes that are looked at together: a bound on memory.
STEP = 1024


@dataclass
class Forest:
    """One kd-tree for each part position over the same vectors; all trees have the same shape.

    Level l halves each segment of level l - 1, so `starts[l]` holds for all positions. `order[p]` lists the vectors as
    tree p has them; low, high and total have the nodes of all levels, one level after the other.
    """

    values: np.ndarray  # positions, vectors, components
    order: np.ndarray
    low: np.ndarray  # positions, nodes, components
    high: np.ndarray
    total: np.ndarray

    @property
    def starts(self) -> list[np.ndarray]:
        return segments(self.order.shape[1])


def segments(n: int) -> list[np.ndarray]:
    """Where the nodes of each level start, and the end; leaves have at most LEAF points."""
    out = [np.array([0, n])]
    while np.diff(out[-1]).max(initial=0) > LEAF:
        s = out[-1]
        halves = np.empty(2 * len(s) - 1, np.int64)
        halves[::2], halves[1::2] = s, (s[:-1] + s[1:]) // 2
        out.append(halves)
    return out


def build(values: np.ndarray) -> Forest:
    """Trees over values(positions, vectors, components): a node is halved at the median of its widest side."""
    parts, n, _ = values.shape
    order = np.tile(np.arange(n), (parts, 1))
    boxes = []
    levels = segments(n)
    for depth, s in enumerate(levels):
        points = np.take_along_axis(values, order[:, :, None], 1)
        low, high = np.minimum.reduceat(points, s[:-1], 1), np.maximum.reduceat(points, s[:-1], 1)
        boxes.append((low, high, np.add.reduceat(points, s[:-1], 1)))
        if depth + 1 < len(levels):
            sizes = np.diff(s)
            side = np.repeat((high - low).argmax(2), sizes, 1)
            base = np.repeat(np.take_along_axis(low, (high - low).argmax(2)[:, :, None], 2)[:, :, 0], sizes, 1)
            key = np.take_along_axis(points, side[:, :, None], 2)[:, :, 0] - base
            width = int(key.max()) + 1
            order = np.take_along_axis(order, np.argsort(key + np.repeat(np.arange(len(sizes)), sizes) * width, 1, "stable"), 1)
    low, high, total = (np.concatenate(x, 1) for x in zip(*boxes, strict=True))
    return Forest(values, order, low, high, total)


def filtered(forest: Forest, books: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """What the entries books(positions, entries, components) get: (position, level, node, entry) of whole subtrees, and (position, vector, entry) of single points of leaves.

    Distances are exact integers and ties go to the lower entry. Of a node's entries the one nearest to the middle of
    its box stays; another goes if it is no nearer even at the corner of the box that lies farthest on its side.
    """
    levels, which = forest.starts, np.arange(books.shape[1])
    offset = 0
    position, node = np.arange(len(books)), np.zeros(len(books), np.int64)
    open_ = np.ones((len(books), books.shape[1]), bool)
    for level, s in enumerate(levels):
        last = level + 1 == len(levels)
        following = []
        for a in range(0, len(position), STEP):
            p, i, mask = position[a : a + STEP], node[a : a + STEP], open_[a : a + STEP]
            low, high, entries = forest.low[p, offset + i][:, None], forest.high[p, offset + i][:, None], books[p]
            near = np.where(mask, np.square(2 * entries - low - high).sum(2), np.iinfo(np.int64).max).argmin(1)
            best = np.take_along_axis(entries, near[:, None, None], 1)
            corner = np.where(entries > best, high, low)
            gap = np.square(corner - entries).sum(2) - np.square(corner - best).sum(2)
            mask = mask & ~((gap > 0) | ((gap == 0) & (which > near[:, None])))
            whole = mask.sum(1) == 1
            yield p[whole], np.full(whole.sum(), level), i[whole], near[whole]
            p, i, mask = p[~whole], i[~whole], mask[~whole]
            if last:
                yield from _points(forest, books, s, p, i, mask)
            else:
                following.append((np.repeat(p, 2), np.repeat(2 * i, 2) + np.tile([0, 1], len(i)), np.repeat(mask, 2, 0)))
        if last or not following:
            return
        position, node, open_ = (np.concatenate(x) for x in zip(*following, strict=True))
        offset += len(s) - 1


def _points(forest: Forest, books: np.ndarray, s: np.ndarray, position: np.ndarray, node: np.ndarray, mask: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """The points of leaves against the entries that are left there."""
    for a in range(0, len(position), STEP // 8):
        p, i = position[a : a + STEP // 8], node[a : a + STEP // 8]
        at = s[i][:, None] + np.arange(LEAF)
        there = at < s[i + 1][:, None]
        vector = forest.order[p[:, None], np.minimum(at, forest.order.shape[1] - 1)]
        points = forest.values[p[:, None], vector]
        far = np.square(points[:, :, None] - books[p][:, None]).sum(3)
        entry = np.where(mask[a : a + STEP // 8][:, None], far, np.iinfo(np.int64).max).argmin(2)
        yield np.broadcast_to(p[:, None], there.shape)[there], vector[there], entry[there]


def sums(forest: Forest, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """counts(positions, entries) and totals(positions, entries, components) of the points that each entry gets."""
    counts, totals = np.zeros(books.shape[:2], np.int64), np.zeros(books.shape, np.int64)
    levels = forest.starts
    offsets = np.cumsum([0, *(len(s) - 1 for s in levels)])
    for found in filtered(forest, books):
        if len(found) == 4:
            p, level, i, entry = found
            if len(p):
                s = levels[level[0]]
                np.add.at(counts, (p, entry), s[i + 1] - s[i])
                np.add.at(totals, (p, entry), forest.total[p, offsets[level[0]] + i])
        else:
            p, vector, entry = found
            np.add.at(counts, (p, entry), 1)
            np.add.at(totals, (p, entry), forest.values[p, vector])
    return counts, totals


def assign(forest: Forest, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """codes(vectors, positions) and each vector's squared distances to its entries, summed."""
    parts, n = forest.order.shape
    codes, levels = np.zeros((parts, n), np.int64), forest.starts
    for found in filtered(forest, books):
        if len(found) == 4:
            p, level, i, entry = found
            if len(p):
                s = levels[level[0]]
                sizes = s[i + 1] - s[i]
                places = np.repeat(s[i] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
                codes[np.repeat(p, sizes), forest.order[np.repeat(p, sizes), places]] = np.repeat(entry, sizes)
        else:
            p, vector, entry = found
            codes[p, vector] = entry
    far = np.square(forest.values - np.take_along_axis(books, codes[:, :, None], 1)).sum((0, 2))
    return codes.T, far


def moved(books: np.ndarray, counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """The entries at the floored means of their points; unused ones stay."""
    return np.where(counts[:, :, None] > 0, totals // np.maximum(counts, 1)[:, :, None], books)


def cut(vectors: np.ndarray, parts: int) -> np.ndarray:
    """Integers floor(SCALE * x) as positions, vectors, components."""
    whole = np.floor(SCALE * vectors.astype(np.float64)).astype(np.int64)
    return np.ascontiguousarray(whole.reshape(len(whole), parts, -1).swapaxes(0, 1))


def usable(vector: Column, parts: int) -> Column:
    """Whether a vector can be coded: a positive multiple of `parts` finite components, each under LARGEST in size."""
    return vector.isNotNull() & (F.size(vector) > 0) & (F.size(vector) % parts == 0) & F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < LARGEST), F.lit(False)))


@dataclass(frozen=True)
class Coded:
    """rows(vec_id, label, code, error) and the codebooks (positions, entries, components) that they refer to."""

    rows: DataFrame
    books: np.ndarray

    @property
    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()


_BLOCK_COLUMNS = ("parts", "order", "low", "high", "total")


def _packed(forest: Forest) -> dict[str, list[bytes]]:
    small = np.int16 if np.abs(forest.values).max(initial=0) < 1 << 15 else np.int32
    kinds = small, np.uint16, small, small, np.int64
    return {c: [np.ascontiguousarray(x.astype(k)).tobytes()] for c, x, k in zip(_BLOCK_COLUMNS, (forest.values, forest.order, forest.low, forest.high, forest.total), kinds, strict=True)}


def _forests(batch: pa.RecordBatch, parts: int, width: int) -> Iterator[tuple[int, Forest]]:
    """Each row's trees, one at a time."""
    for i, n in enumerate(column(batch, "n").to_pylist()):
        raw = [column(batch, c)[i].as_buffer() for c in _BLOCK_COLUMNS]
        kind = np.int16 if raw[0].size == parts * n * width * 2 else np.int32
        values, order, low, high, total = (np.frombuffer(b, k).astype(np.int64) for b, k in zip(raw, (kind, np.uint16, kind, kind, np.int64), strict=True))
        yield i, Forest(values.reshape(parts, n, width), order.reshape(parts, n), low.reshape(parts, -1, width), high.reshape(parts, -1, width), total.reshape(parts, -1, width))


def compress(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Coded:
    """Codes of df's vectors; other columns are ignored.

    Rows aren't coded whose vector is null, holds null or non-finite components or ones of LARGEST or more, or has
    another length than most of the usable vectors (of equally frequent lengths the shorter). Repeated rows and ids are
    coded each. The entries start as the vectors of the `entries` smallest ids, nulls last, then by vector; with fewer
    vectors there are fewer entries, and without any there are no rows and no entries. error is a vector's squared
    distance to its entries.
    """
    spark = df.sparkSession
    kept = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("vector")).where(usable(F.col("vector"), parts))
    common = kept.groupBy(F.size("vector").alias("dims")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dims").first()
    label_type = kept.schema["label"].dataType
    if common is None:
        return Coded(kept.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")).limit(0), np.zeros((parts, 0, 0), np.int64))
    width = common.dims // parts
    kept = kept.where(F.size("vector") == common.dims)
    first = kept.select("vec_id", "vector").orderBy(F.asc_nulls_last("vec_id"), "vector").limit(entries).collect()  # `entries` rows
    books = cut(np.array([r.vector for r in first]), parts)

    fields = [StructField("n", LongType()), StructField("ids", ArrayType(LongType())), StructField("labels", ArrayType(label_type))]
    block_schema = StructType(fields).add("parts", "binary").add("order", "binary").add("low", "binary").add("high", "binary").add("total", "binary")

    def trees(batch: pa.RecordBatch) -> dict:
        out: dict = {f.name: [] for f in block_schema}
        for a in range(0, len(batch), BLOCK):
            part = batch.slice(a, BLOCK)
            flat = column(part, "vector").flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1)
            out["n"].append(len(part))
            out["ids"].append(column(part, "vec_id").to_pylist())
            out["labels"].append(column(part, "label").to_pylist())
            for name, raw in _packed(build(cut(flat, parts))).items():
                out[name] += raw
        return out

    scratch: list[str] = []
    blocks = stored(mapped(kept, trees, block_schema, text=None), "vector-trees", scratch, "zstd")
    for _ in range(rounds):
        books = moved(books, *_gathered(blocks, books))

    schema = StructType([StructField("vec_id", LongType()), StructField("label", label_type)]).add("code", "string").add("error", "long")

    def codes(batch: pa.RecordBatch) -> dict:
        out: dict = {"vec_id": [], "label": [], "code": [], "error": []}
        for i, forest in _forests(batch, parts, width):
            code, far = assign(forest, books)
            out["vec_id"] += column(batch, "ids")[i].as_py()
            out["label"] += column(batch, "labels")[i].as_py()
            out["code"] += [row.tobytes().hex() for row in code.astype(np.uint8)]
            out["error"] += far.tolist()
        return out

    rows = stored(mapped(blocks, codes, schema, text=None), "vector-codes")
    cleared(spark, scratch)
    return Coded(rows, books)


def _gathered(blocks: DataFrame, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts and totals of all blocks: each task adds up its own, at most positions x entries x components reach the driver."""
    parts, entries, width = books.shape

    def run(batches):
        counts, totals = np.zeros(books.shape[:2], np.int64), np.zeros(books.shape, np.int64)
        for batch in batches:
            for _, forest in _forests(batch, parts, width):
                c, t = sums(forest, books)
                counts, totals = counts + c, totals + t
        used = np.flatnonzero(np.repeat(counts.ravel(), width))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(np.repeat(counts.ravel(), width)[used]), pa.array(totals.ravel()[used])], ["slot", "n", "total"])

    found = blocks.select("n", *_BLOCK_COLUMNS).mapInArrow(run, "slot int, n long, total long").groupBy("slot").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()
    counts, totals = np.zeros(books.size, np.int64), np.zeros(books.size, np.int64)
    for slot, n, total in found:
        counts[slot], totals[slot] = n, total
    return counts.reshape(books.shape)[:, :, 0], totals.reshape(books.shape)


def with_label_error(coded: Coded) -> DataFrame:
    """The rows with label_error, the errors of all rows with the same label, null labels together. Sums come first, so a frequent label's rows don't meet in one task."""
    by_label = coded.rows.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "__label")
    return coded.rows.join(by_label, F.col("label").eqNullSafe(F.col("__label")), "left").drop("__label")
