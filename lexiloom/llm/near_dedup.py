"""MinHash near-dedup with ProbMinHash (operator 7).

Each element of a weighted set of word shingles sends a Poisson process of arrivals, at a rate of its weight, to
random registers; a register keeps its first arrival, and a process ends early when its next arrival comes after every
register's. Two texts' registers agree with the probability Jaccard similarity. Bands of registers give buckets.

Equal texts are one node. All members of a bucket are compared with one centre, similarity is computed exactly, and
linked nodes are contracted to components. Crowded buckets of several components get further centres, the nodes nearest
to their modal registers, while these link many. Last, wherever a bucket still holds several components, the registers
of all its pairs of two components are compared, block by block, and every pair that is LIKELY is compared exactly
unless links join it already.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.llm.common import cleared, column, mapped, stored, stored_ids, whole_text

SHINGLE, SIMILARITY = 5, 0.8
#: 1 - (1 - 0.8 ** 5) ** 30: of pairs at the threshold about 7 in a million share no bucket.
BANDS, ROWS = 30, 5
#: Nodes and bytes of text in a block of a bucket; each two blocks are one piece of work.
BLOCK, BLOCK_BYTES = 4096, 16 << 20
#: Equal registers from which on a pair is a candidate: over four standard errors below the threshold.
LIKELY = 0.65
#: Edges between contracted components that one task joins, some 50 MB.
FEW = 200_000
#: Nodes from which on a bucket of several components gets further centres, and rows that tell its modal registers.
CROWD, MODAL = 64, 1024


def shingles(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of runs of five words (all words, of a shorter text), sorted, and their counts."""
    words = text.split()
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    joined = map(" ".join, zip(*(words[i:] for i in range(SHINGLE)), strict=False)) if len(words) > SHINGLE else [" ".join(words)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, joined), np.uint64), return_counts=True)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], k: int = BANDS * ROWS) -> np.ndarray:
    """A row of k registers per set: the element that arrived first. Rows of empty sets are 0."""
    sizes = np.array([len(e) for e, _ in sets], np.int64)
    out = np.zeros((len(sets), k), np.uint64)
    for i in np.flatnonzero(sizes == 1):
        out[i] = sets[i][0][0]
    many = np.flatnonzero(sizes > 1)
    if not len(many):
        return out
    e = np.concatenate([sets[i][0] for i in many])
    rate = np.concatenate([sets[i][1] for i in many]).astype(float)
    of = np.repeat(np.arange(len(many)), sizes[many])
    first, won, time = np.full(len(many) * k, np.inf), np.zeros(len(many) * k, np.uint64), np.zeros(len(e))
    nth = 0
    while len(e):
        nth += 1
        draw = _mix(e + np.uint64(nth * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        time = time - np.log(((draw >> np.uint64(11)).astype(float) + 0.5) / 2.0**53) / rate
        slot = of * k + (_mix(draw) % np.uint64(k)).astype(np.int64)
        np.minimum.at(first, slot, time)
        hit = first[slot] == time
        won[slot[hit]] = e[hit]
        goes_on = time < first.reshape(-1, k).max(1)[of]
        e, rate, of, time = e[goes_on], rate[goes_on], of[goes_on], time[goes_on]
    out[many] = won.reshape(-1, k)
    return out


def bands(sig: np.ndarray) -> np.ndarray:
    """A 64-bit bucket per band, other for each band."""
    part = sig.reshape(len(sig), BANDS, ROWS)
    key = np.tile(np.arange(BANDS, dtype=np.uint64), (len(sig), 1))
    for j in range(ROWS):
        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + part[:, :, j])
    return key.view(np.int64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The larger of the Jaccard similarity of the sets and the probability Jaccard similarity of the weighted sets."""
    common, ia, ib = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    plain = len(common) / (len(a[0]) + len(b[0]) - len(common))
    if plain >= SIMILARITY or a[1].max() == 1 == b[1].max():
        return plain
    x, y = a[1][ia].astype(float), b[1][ib].astype(float)
    order = np.argsort(x / y)
    x, y = x[order], y[order]
    # For element i: the sum over j of max(x_j / x_i, y_j / y_i); x wins for the larger ratios x_j / y_j.
    rest_x, rest_y = a[1].sum() - x.sum(), b[1].sum() - y.sum()
    above = np.concatenate([np.cumsum(x[::-1])[::-1], [0.0]])
    below = np.concatenate([[0.0], np.cumsum(y)])
    i = np.arange(len(x))
    return max(plain, float((1 / ((rest_x + above[i]) / x + (rest_y + below[i]) / y)).sum()))


def _groups(batches, by: int, names: tuple[str, ...]):
    """Lists of rows that agree in the first `by` columns, from rows sorted by them."""

    def rows():
        for batch in batches:
            yield from zip(*(column(batch, c).to_pylist() for c in names), strict=True)

    for _, group in itertools.groupby(rows(), lambda r: r[:by]):
        yield list(group)


class _Block:
    """Nodes of one bucket, of two of its blocks or of one."""

    def __init__(self, key: int, blocks: list[int], labels: list[bytes], sig: list[bytes], keys: list[bytes]) -> None:
        self.own = np.unique(np.array(labels, "V16"), return_inverse=True)[1].ravel()
        self.sig = np.frombuffer(b"".join(sig), np.uint8).reshape(len(sig), 2, -1)
        self.keys = np.frombuffer(b"".join(keys), np.int64).reshape(len(keys), 2, -1)
        self.band = int(np.argwhere(self.keys[0] == key)[0, 1])
        order, side = np.argsort(self.own, kind="stable"), np.array(blocks)
        self.one = bool((side == side[0]).all())
        self.rows = order[side[order] == side[0]]
        self.cols = self.rows if self.one else order[side[order] != side[0]]

    def likely(self):
        """Arrays of rows and columns of LIKELY pairs of two components, best first in each; a pair only in the first band that it shares."""
        of_cols, many = self.own[self.cols], bool((self.sig[:, 0] != self.sig[:, 1]).any())
        for i in range(0, len(self.rows), 64):
            rows = self.rows[i : i + 64]
            if self.one:
                cols = self.cols[np.searchsorted(of_cols, self.own[rows[0]], "right") :]
            else:
                cols = self.cols[of_cols != self.own[rows[0]]] if self.own[rows[0]] == self.own[rows[-1]] else self.cols
            if not len(cols):
                continue
            near = np.zeros((len(rows), len(cols)), np.uint8)
            for kind in range(1 + many):
                found = np.zeros_like(near)
                for x, y in zip(self.sig[rows, kind].T, np.ascontiguousarray(self.sig[cols, kind].T), strict=True):
                    found += (x[:, None] == y[None, :]).view(np.uint8)
                np.maximum(near, found, out=near)
            a, b = self.own[rows, None], self.own[None, cols]
            r, c = np.nonzero((near >= LIKELY * self.sig.shape[2]) & ((a < b) if self.one else (a != b)))
            r, c = (v[np.argsort(-near[r, c].astype(int), kind="stable")] for v in (r, c))
            r, c = rows[r], cols[c]
            before = self.keys[:, :, : self.band]
            again = np.zeros(len(r), bool)
            for x, y in ((0, 0), (0, 1), (1, 0), (1, 1))[: 4 if many else 1]:
                again |= (before[r, x] == before[c, y]).any(1)
            yield r[~again], c[~again]


def _involved(batches):
    """The nodes of LIKELY pairs of two components, from rows sorted by (key, low, high)."""
    for held in _groups(batches, 3, ("key", "low", "high", "block", "node", "label", "sig", "keys")):
        hit = np.zeros(len(held), bool)
        if len(held) > 1:
            for r, c in _Block(held[0][0], *([h[i] for h in held] for i in (3, 5, 6, 7))).likely():
                hit[r] = hit[c] = True
        if hit.any():
            out = [held[i] for i in np.flatnonzero(hit)]
            yield pa.RecordBatch.from_arrays([pa.array([h[i] for h in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["key", "low", "high", "block", "node"])


def _joined(batches):
    """Links a, b between the components of LIKELY pairs, from rows sorted by (key, low, high): every pair is compared exactly unless links join it by then."""
    for held in _groups(batches, 3, ("key", "low", "high", "block", "node", "label", "sig", "keys", "text")):
        block = _Block(held[0][0], *([h[i] for h in held] for i in (3, 5, 6, 7)))
        root, sets, a, b = list(range(len(held))), {}, [], []

        def top(i: int) -> int:
            while root[i] != i:
                root[i] = i = root[root[i]]
            return i

        def of(i: int) -> tuple[np.ndarray, np.ndarray]:
            if i not in sets:
                sets[i] = shingles(held[i][8])
            return sets[i]

        for rows, cols in block.likely():
            for r, c in zip(rows.tolist(), cols.tolist(), strict=True):
                x, y = top(int(block.own[r])), top(int(block.own[c]))
                if x != y and similarity(of(r), of(c)) >= SIMILARITY:
                    root[x] = y
                    a.append(held[r][4])
                    b.append(held[c][4])
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])


def _modes(batches):
    """A bucket's most frequent value of each register, from rows sorted by key."""
    for held in _groups(batches, 1, ("key", "sig")):
        sig = np.frombuffer(b"".join(h[1] for h in held), np.uint8).reshape(len(held), -1)
        mode = np.array([np.bincount(v, minlength=256).argmax() for v in sig.T], np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([held[0][0]]), pa.array([mode.tobytes()])], names=["key", "mode"])


def _nearness(batch: pa.RecordBatch) -> dict:
    sig, mode = (np.frombuffer(b"".join(column(batch, c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("sig", "mode"))
    return {"key": column(batch, "key"), "node": column(batch, "node"), "near": (sig == mode).sum(1).astype(np.int32)}


def _united(batches):
    """node, root (the least node of its component) for all nodes of edges a, b, which are FEW at most."""
    root: dict[bytes, bytes] = {}

    def top(x: bytes) -> bytes:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    for batch in batches:
        for a, b in zip(column(batch, "a").to_pylist(), column(batch, "b").to_pylist(), strict=True):
            a, b = sorted((top(a), top(b)))
            root[b] = a
    yield pa.RecordBatch.from_arrays([pa.array(list(root), pa.binary()), pa.array([top(x) for x in root], pa.binary())], names=["node", "root"])


def components(edges: DataFrame, scratch: list[str]) -> DataFrame:
    """node, label (the least node of its component) for all nodes in edges(a, b).

    Each node hooks to its least neighbour below and edges are contracted, until FEW are left; those go through one task.
    """
    if edges.count() <= FEW:
        return stored(edges.where("a != b").coalesce(1).mapInArrow(_united, "node binary, root binary").withColumnRenamed("root", "label"), "labels", scratch)
    edges = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "edges", scratch)
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().select("node", F.col("node").alias("label"))
    while edges.count() > FEW:
        hook = stored_ids(edges.groupBy("a").agg(F.min("b").alias("up")), "hooks", scratch)
        nodes = nodes.join(hook.withColumnRenamed("a", "label"), "label", "left").select("node", F.coalesce("up", "label").alias("label"))
        moved = edges.join(hook, "a").select(F.col("up").alias("a"), "b")
        moved = moved.join(hook.select(F.col("a").alias("b"), F.col("up").alias("to")), "b", "left").select("a", F.coalesce("to", "b").alias("b"))
        edges = stored(moved.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "edges", scratch)
    rest = edges.coalesce(1).mapInArrow(_united, "node binary, root binary").withColumnRenamed("node", "label")
    return stored(nodes.join(rest, "label", "left").select("node", F.coalesce("root", "label").alias("label")), "labels", scratch)


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs(centre, node) that are similar, as edges(a, b)."""
    with_node = pairs.join(texts, "node").withColumnRenamed("text", "left")
    both = with_node.join(texts.select(F.col("node").alias("centre"), F.col("text").alias("right")), "centre")

    def test(batch: pa.RecordBatch) -> dict:
        a, b, known = [], [], {}
        for centre, node, left, right in zip(*(column(batch, c).to_pylist() for c in ("centre", "node", "left", "right")), strict=True):
            if centre not in known:
                known = {centre: shingles(right)}
            if similarity(shingles(left), known[centre]) >= SIMILARITY:
                a.append(centre)
                b.append(node)
        return {"a": a, "b": b}

    return mapped(both.select("centre", "node", "left", "right"), test, "a binary, b binary", "left")


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id (least doc_id of the class), class_size (its rows) for each row of docs.

    A class is a component of the graph whose links join texts of a similarity of SIMILARITY or more, over shingles of
    five words; equal texts are always together. Texts of fewer words are one shingle; texts without words are only
    like equal texts. Null texts count as empty, null ids never are a class's id unless all its ids are null. Repeated
    rows stay. Ties need no rule: links join both their texts, whichever is compared first.
    """
    rows, of = _classes(docs, id_col, text_col)
    return rows.select("doc_id", "node").join(of, "node").select("doc_id", "class_id", "class_size")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs for each class of near_classes(), with all its columns: a row of the least id, of its texts that
    of the least digest, and of rows that repeat both the first by its other columns."""
    _, of = _classes(docs, id_col, text_col)
    name = F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit("null"))
    stay = of.where("stays").select(F.col("node").alias("__node"), F.coalesce(F.col("class_id").cast("string"), F.lit("null")).alias("__id"))
    rows = docs.select(F.struct(*docs.columns).alias("__row"), F.unhex(F.md5(whole_text(text_col))).alias("__node"), name.alias("__id")).join(stay, ["__node", "__id"], "left_semi")
    others = F.to_json(F.struct(F.lit(0).alias("__none"), *(F.col("__row")[c].alias(c) for c in docs.columns if c not in (id_col, text_col))))
    first = rows.withColumn("__n", F.row_number().over(Window.partitionBy("__node", "__id").orderBy(others, F.col("__row")[text_col])))
    return first.where("__n = 1").select("__row.*")


def _classes(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """docs as doc_id, text, node (the text's digest); and node, class_id, class_size, stays (whether the class keeps a row of this text)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text")).withColumn("node", F.unhex(F.md5("text")))

    def sketch(batch: pa.RecordBatch) -> dict:
        sets = [shingles(t) for t in column(batch, "text").to_pylist()]
        sig = signatures(sets)
        # Registers by counts, then those by distinct shingles, which differ where a shingle repeats.
        both = np.stack([sig, sig], 1)
        repeats = [i for i, (_, n) in enumerate(sets) if len(n) and n.max() > 1]
        both[repeats, 1] = signatures([(sets[i][0], np.ones_like(sets[i][1])) for i in repeats])
        keys = bands(both.reshape(-1, BANDS * ROWS)).reshape(len(sets), -1)
        return {"node": column(batch, "node"), "doc_id": column(batch, "doc_id"), "buckets": [np.unique(k) if len(s[0]) else [] for k, s in zip(keys, sets, strict=True)], "keys": [k.tobytes() for k in keys], "sig": [r.tobytes() for r in (_mix(both) & np.uint64(255)).astype(np.uint8)], "bytes": pc.binary_length(column(batch, "text")).cast(pa.int64())}

    scratch: list[str] = []
    sketches = mapped(rows, sketch, "node binary, doc_id long, buckets array<long>, keys binary, sig binary, bytes long")
    nodes = stored(sketches.groupBy("node").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"), *(F.any_value(c).alias(c) for c in ("buckets", "keys", "sig", "bytes"))), "nodes", scratch)
    members = nodes.select("node", F.explode("buckets").alias("key"))
    # Stored sides of joins leave Spark free to split a large bucket's rows over tasks.
    shared = stored_ids(members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("centre")).where("n > 1").select("key", "centre"), "shared", scratch)
    members = stored_ids(members.join(shared, "key"), "members", scratch)  # of buckets of two nodes or more
    tested = stored_ids(members.where("node != centre").select("centre", "node").distinct(), "tested", scratch)
    texts = rows.groupBy("node").agg(F.any_value("text").alias("text"))
    texts = stored(texts.join(members.select("node").distinct(), "node", "left_semi"), "texts", scratch)
    links = stored(_verified(tested, texts), "links", scratch)
    labels = components(links, scratch)
    members = members.where("node != centre").select("key", "node")  # a first centre has been compared with all of its bucket

    def several(of: DataFrame, least: int, name: str) -> DataFrame:
        """The members of buckets of several components and at least so many nodes, with labels, registers, and the bucket's nodes and bytes."""
        named = of.join(labels, "node", "left").join(nodes.select("node", "sig", "keys", "bytes"), "node").select("key", "node", F.coalesce("label", "node").alias("label"), "sig", "keys", "bytes")
        held = named.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("size")).where((F.col("low") != F.col("high")) & (F.col("n") >= least))
        held = stored_ids(held.select("key", "n", "size"), "several", scratch)
        return stored_ids(named.join(held, "key"), name, scratch)

    rest = members
    while not (crowd := several(rest, CROWD, "crowd")).isEmpty():
        sample = crowd.where(F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / MODAL)) == 0).select("key", F.substring("sig", 1, BANDS * ROWS).alias("sig"))
        modes = stored_ids(sample.repartition("key").sortWithinPartitions("key").mapInArrow(_modes, "key long, mode binary"), "modes", scratch)
        near = mapped(crowd.select("key", "node", F.substring("sig", 1, BANDS * ROWS).alias("sig")).join(modes, "key"), _nearness, "key long, node binary, near int", None)
        centres = stored_ids(near.groupBy("key").agg(F.max(F.struct("near", "node"))["node"].alias("centre")), "centres", scratch)
        met = crowd.join(centres, "key").where("node != centre").select("key", "centre", "node")
        pairs = stored_ids(met.select("centre", "node").distinct().join(tested, ["centre", "node"], "left_anti"), "tested", scratch)
        found = stored(_verified(pairs, texts), "links", scratch)
        tested, links, n = tested.unionByName(pairs), links.unionByName(found), found.count()
        labels = components(links, scratch)
        if n < 0.1 * pairs.count():
            break
        named = met.join(labels, "node", "left").join(labels.select(F.col("node").alias("centre"), F.col("label").alias("its")), "centre", "left")
        rest = stored_ids(named.where("label is null or its is null or label != its").select("key", "node"), "members", scratch)
    left = several(members, 2, "left")
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("size") / BLOCK_BYTES))
    dealt = left.select("key", "node", "label", "sig", "keys", blocks.alias("blocks")).withColumn("block", F.pmod(F.xxhash64("node", F.lit(1)), "blocks"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    piece = ["key", "low", "high"]
    hit = dealt.select(*piece, "block", "node", "label", "sig", "keys").repartition(*piece).sortWithinPartitions(*piece).mapInArrow(_involved, "key long, low long, high long, block long, node binary")
    hit = stored(hit, "likely", scratch).join(left.select("key", "node", "label", "sig", "keys"), ["key", "node"]).join(texts, "node")
    found = stored(hit.select(*piece, "block", "node", "label", "sig", "keys", "text").repartition(*piece).sortWithinPartitions(*piece).mapInArrow(_joined, "a binary, b binary"), "links", scratch)
    labels = components(links.unionByName(found), scratch)
    label = nodes.select("node", "least", "copies").join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"), "least", "copies")
    least = F.min(F.struct(F.col("least").isNull().alias("none"), "least", "node"))
    classes = label.groupBy("label").agg(F.min("least").alias("class_id"), F.sum("copies").alias("class_size"), least["node"].alias("first"))
    of = stored_ids(label.select("node", "label").join(classes, "label").select("node", "class_id", "class_size", (F.col("node") == F.col("first")).alias("stays")), "classes")
    cleared(docs.sparkSession, scratch)
    return rows, of
