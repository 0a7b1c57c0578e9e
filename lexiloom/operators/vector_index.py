"""Exact search over unit vectors in cells around pivots.

The distance of a query to a pivot and the distances between which a cell's members lie around it bound how similar any
member can be. Queries visit their nearest cells first; what these give bounds what is still to be found, and cells that
can't hold any of it are never visited. Query and vectors meet by cell and part, in blocks.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions.vectors import unit
from lexiloom.sources.shared import written

#: Vectors that the pivots are fitted on at most, pivots at most, and rounds of fitting.
SAMPLE, PIVOTS, ROUNDS = 8192, 512, 4
#: Vectors of a cell's part, and queries of a block, at most about: what one task holds of either side.
PART, BLOCK = 20_000, 5_000
#: Similarities are rounded to six decimals; bounds leave room for that.
SLACK = 1e-6
_MEMBERS = "token string, u array<double>, cell int, far double"


@dataclass(frozen=True)
class Cells:
    """The pivots by their vectors' length, and the members' number, least and greatest distance for each cell; at most PIVOTS pivots for each length.

    Vectors of a length without pivots lie in one cell, which has no bounds.
    """

    pivots: dict[int, tuple[int, np.ndarray]]  # length -> number of the first cell, pivots
    size: dict[int, tuple[int, float, float]]

    def nearest(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell and distance for unit vectors of one length."""
        if u.shape[1] not in self.pivots:
            return np.full(len(u), -u.shape[1] - 1), np.zeros(len(u))
        first, p = self.pivots[u.shape[1]]
        far = _distances(u, p)
        at = far.argmin(1)
        return first + at, far[np.arange(len(u)), at]

    def bounds(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Cells that hold vectors of u's length; for one unit vector the least and greatest similarity that a member can have, and the members' numbers."""
        if len(u) not in self.pivots:
            cells = [c for c in (-len(u) - 1,) if c in self.size]
            return np.array(cells, int), np.full(len(cells), -1.0), np.ones(len(cells)), np.array([self.size[c][0] for c in cells], int)
        first, p = self.pivots[len(u)]
        cells = np.array([c for c in range(first, first + len(p)) if c in self.size], int)
        n, low, high = (np.array([self.size[c][i] for c in cells]) for i in range(3))
        d = _distances(u[None], p)[0][cells - first] if len(cells) else np.zeros(0)
        near, far = np.maximum(0, np.maximum(d - high, low - d)), np.minimum(2, d + high)
        return cells, 1 - far**2 / 2, 1 - near**2 / 2, n


def _distances(u: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (u * u).sum(1)[:, None] + (pivots * pivots).sum(1) - 2 * u @ pivots.T))


def _pivots(sample: np.ndarray) -> np.ndarray:
    """Means of a bounded sample by Lloyd's rounds, as many as the root of its size."""
    p = sample[: max(1, min(PIVOTS, int(np.sqrt(len(sample)))))].copy()
    for _ in range(ROUNDS):
        at = _distances(sample, p).argmin(1)
        for c in np.unique(at):
            p[c] = sample[at == c].mean(0)
    return p


@dataclass(frozen=True)
class VectorIndex:
    """members(token, u, cell, far) and their cells; a token has one vector."""

    members: DataFrame
    cells: Cells

    @classmethod
    def of(cls, vectors: DataFrame, keep: Callable[[str, Callable[[], DataFrame]], DataFrame] | None = None) -> VectorIndex:
        """Over vectors(token, vec); null and zero vectors have no direction and are left out. Pivots are fitted on a bounded sample, every vector is indexed."""
        keep = keep or (lambda name, make: written(make(), name))
        units = vectors.select(F.col("token").cast("string").alias("token"), unit("vec").alias("u")).where("u is not null and token is not null")
        sample = keep("vector-pivots", lambda: units.orderBy(F.xxhash64("token"), "token").limit(SAMPLE))
        by_length: dict[int, list] = {}
        for r in sample.collect():  # SAMPLE rows
            by_length.setdefault(len(r.u), []).append(r.u)
        pivots, first = {}, 0
        for length, us in sorted(by_length.items()):
            pivots[length] = first, _pivots(np.array(us))
            first += len(pivots[length][1])
        bare = Cells(pivots, {})

        def run(batches):
            for batch in batches:
                us = batch.column(1)
                sizes = np.diff(us.offsets.to_numpy())
                cell, far = np.zeros(len(batch), np.int32), np.zeros(len(batch))
                for length in np.unique(sizes):
                    rows = np.flatnonzero(sizes == length)
                    cell[rows], far[rows] = bare.nearest(_matrix(us.take(pa.array(rows)), int(length)))
                yield pa.RecordBatch.from_arrays([batch.column(0), us, pa.array(cell), pa.array(far)], ["token", "u", "cell", "far"])

        members = keep("vector-cells", lambda: units.mapInArrow(run, _MEMBERS).repartition("cell", F.pmod(F.xxhash64("token"), F.lit(8))).sortWithinPartitions("cell"))
        found = members.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("far").alias("low"), F.max("far").alias("high")).collect()  # a row a cell
        return cls(members, Cells(pivots, {r.cell: (r.n, r.low, r.high) for r in found}))

    def _parts(self, cell: Column) -> Column:
        """How many parts a cell has: only large cells have several."""
        out = F.lit(1)
        for c, (n, _, _) in self.cells.size.items():
            if n > PART:
                out = F.when(cell == c, -(-n // PART)).otherwise(out)
        return out

    def _visits(self, queries: DataFrame, choose: Callable[[dict, np.ndarray], np.ndarray], more: str = "") -> DataFrame:
        """query, u, `more` columns, cell: a row for each cell that choose(row, u) names."""
        schema = f"query string, u array<double>{', ' + more if more else ''}, cell int"

        def run(batches):
            for batch in batches:
                at, cells = [], []
                for i, row in enumerate(batch.to_pylist()):
                    if row["u"] is not None:
                        chosen = choose(row, np.array(row["u"]))
                        at += [i] * len(chosen)
                        cells += chosen.tolist()
                yield pa.RecordBatch.from_arrays([*batch.take(pa.array(at, pa.int64())).columns, pa.array(cells, pa.int32())], [*batch.schema.names, "cell"])

        return queries.mapInArrow(run, schema)

    def meet(self, visits: DataFrame, score: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
        """score(members, visits) for each cell's part and block of queries."""
        visits = written(visits, "visits")  # read for its blocks, its cells and its rows
        most = visits.groupBy("cell").count().agg(F.coalesce(F.max("count"), F.lit(1))).first()[0]
        blocks = -(-most // BLOCK)
        left = self.members.withColumn("part", F.pmod(F.xxhash64("token"), self._parts(F.col("cell")))).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        right = visits.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), (self._parts(F.col("cell")) - 1).cast("long")))).withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int"))
        keys = ("cell", "part", "block")
        asked = left.join(visits.select("cell").distinct(), "cell", "left_semi")
        return asked.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(score, schema)

    def most_similar(self, queries: DataFrame, k: int, digits: int = 6) -> DataFrame:
        """query, other, sim, rank: the k most similar others of queries(query, u), by falling similarity of so many digits, then token."""
        cells, k, slack = self.cells, max(1, k), 10.0**-digits

        def nearest(u: np.ndarray) -> np.ndarray:
            """The most promising cells, until they hold k others."""
            c, _, up, n = cells.bounds(u)
            order = np.lexsort((c, -up))
            return c[order[: 1 + int(np.searchsorted(np.cumsum(n[order]), k + 1))]]

        def rest(row: dict, u: np.ndarray) -> np.ndarray:
            c, _, up, _ = cells.bounds(u)
            return np.setdiff1d(c[up >= (row["worst"] if row["worst"] is not None else -2) - slack], nearest(u))

        def score(members: pa.Table, visits: pa.Table) -> pa.Table:
            tokens = np.array(members["token"].to_pylist(), object)
            out: list = [[], [], []]
            if len(members) and len(visits):
                u = _matrix(members["u"].combine_chunks())
                names = visits["query"].to_pylist()
                for a in range(0, len(visits), 256):
                    sims = _matrix(visits["u"].slice(a, 256).combine_chunks()) @ u.T
                    for query, row in zip(names[a : a + 256], sims, strict=True):
                        others = tokens != query
                        least = -np.partition(-row[others], k - 1)[k - 1] - slack if others.sum() > k else -2
                        for i in np.flatnonzero(others & (row >= least)):
                            out[0].append(query)
                            out[1].append(tokens[i])
                            out[2].append(float(row[i]))
            return pa.table({"query": pa.array(out[0], pa.string()), "other": pa.array(out[1], pa.string()), "sim": pa.array(out[2], pa.float64())})

        def found(visits: DataFrame) -> DataFrame:
            sims = self.meet(visits, score, "query string, other string, sim double")
            ranked = sims.withColumn("sim", F.round("sim", digits)).withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("sim"), "other")))
            return ranked.where(F.col("rank") <= k)

        asked = queries.select(F.col("query").cast("string").alias("query"), "u")
        first = written(found(self._visits(asked, lambda row, u: nearest(u))), "nearest")  # k rows a query
        worst = first.groupBy("query").agg(F.min(F.when(F.col("rank") == k, F.col("sim"))).alias("worst"))
        second = found(self._visits(asked.join(worst, "query", "left"), rest, "worst double").drop("worst"))
        best = first.unionByName(second).withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("sim"), "other")))
        return best.where(F.col("rank") <= k)

    def all_pairs(self, queries: DataFrame) -> DataFrame:
        """query, other, sim of every member with each of queries(query, u), a stated set; cell by cell, in blocks, itself included."""

        def score(members: pa.Table, visits: pa.Table) -> pa.Table:
            n, q = len(members), len(visits)
            sims = _matrix(visits["u"].combine_chunks()) @ _matrix(members["u"].combine_chunks()).T if n and q else np.zeros((0, 0))
            at = np.indices((q, n)).reshape(2, -1) if n and q else np.zeros((2, 0), int)
            return pa.table({"query": visits["query"].take(pa.array(at[0])), "other": members["token"].take(pa.array(at[1])), "sim": pa.array(sims.ravel())})

        cells, asked = self.cells, queries.select(F.col("query").cast("string").alias("query"), "u")
        return self.meet(self._visits(asked, lambda row, u: cells.bounds(u)[0]), score, "query string, other string, sim double")

    def before(self, questions: DataFrame) -> DataFrame:
        """query, answer, before: how many others of questions(query, u, answer, sim) come before the answer, by falling similarity, then token.

        A cell whose members are all more similar counts by its number, one whose members are all less similar not at
        all; only those between are visited.
        """
        cells = self.cells

        def split(row: dict, u: np.ndarray) -> tuple[np.ndarray, int]:
            c, low, up, n = cells.bounds(u)
            sure = low > row["sim"] + SLACK
            own = cells.nearest(u[None])[0][0]
            return c[(up >= row["sim"] - SLACK) & ~sure], int(n[sure].sum()) - int(own in c[sure])

        def counted(batches):
            for batch in batches:
                sure = [split(row, np.array(row["u"]))[1] for row in batch.to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sure, pa.int64())], ["query", "answer", "before"])

        def score(members: pa.Table, visits: pa.Table) -> pa.Table:
            out = []
            if len(members) and len(visits):
                tokens, u = np.array(members["token"].to_pylist(), object), _matrix(members["u"].combine_chunks())
                rows = visits.select(["query", "answer", "sim"]).to_pylist()
                for a in range(0, len(visits), 256):
                    sims = np.round(_matrix(visits["u"].slice(a, 256).combine_chunks()) @ u.T, 6)
                    for row, here in zip(rows[a : a + 256], sims, strict=True):
                        out.append(int(((tokens != row["query"]) & ((here > row["sim"]) | ((here == row["sim"]) & (tokens < row["answer"])))).sum()))
                return pa.table({"query": visits["query"], "answer": visits["answer"], "before": pa.array(out, pa.int64())})
            return pa.table({"query": pa.array([], pa.string()), "answer": pa.array([], pa.string()), "before": pa.array([], pa.int64())})

        asked = questions.select("query", "u", "answer", "sim")
        schema = "query string, answer string, before long"
        visited = self.meet(self._visits(asked, lambda row, u: split(row, u)[0], "answer string, sim double"), score, schema)
        return asked.mapInArrow(counted, schema).unionByName(visited).groupBy("query", "answer").agg(F.sum("before").alias("before"))


def _matrix(u: pa.ListArray, length: int | None = None) -> np.ndarray:
    """Equally long vectors as rows."""
    flat = u.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(u), length or len(flat) // max(1, len(u)))
