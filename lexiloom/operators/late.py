"""Late interaction in tasks that hold the vectors: bounds from lists of near tokens, exact scores only where they leave a document among the best.

An asked token's list names the known tokens that are more similar to it than a limit. A document's tokens raise the
bounds of the asked tokens whose lists they are in; all others stay at their limits. No score is more than its bound, so a document
whose bound is below a query's k-th score so far is not compared with the query at all. Limits are set by a bounded
number of vectors; they bear on the work only, results are exact with any.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from lexiloom.functions.relevance import QUANTUM, idf

#: Lists that a known token is in, on average about; vectors that limits are set by, at most; documents whose bounds a task holds at once.
NEAR, FITTED, DOCS = 2, 4096, 1000
#: Room for scores of six decimals and for bounds in single precision, for a query of so many tokens.
SLACK, SINGLE = 1e-6, 2.0**-23


def _matrix(u: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Equally long vectors as rows."""
    u = u.combine_chunks() if isinstance(u, pa.ChunkedArray) else u
    return u.flatten().to_numpy(zero_copy_only=False).reshape(len(u), -1) if len(u) else np.zeros((0, 1))


def _of(wanted: set, keys: list, cols: np.ndarray, starts: np.ndarray) -> tuple[list, np.ndarray, np.ndarray]:
    """The keys that are wanted, whether each row is theirs, and where their rows start."""
    sizes, stay = np.diff(starts, append=len(cols)), np.array([k in wanted for k in keys], bool)
    return [k for k in keys if k in wanted], np.repeat(stay, sizes), np.cumsum(sizes[stay]) - sizes[stay]


class Best:
    """The `keep` best scores of each query so far; floor is the least of them, -inf as long as there are fewer."""

    def __init__(self, queries: int, keep: int) -> None:
        self.keep, self.query, self.score, self.floor = keep, np.zeros(0, np.int64), np.zeros(0), np.full(queries, -np.inf)

    def add(self, query: np.ndarray, score: np.ndarray) -> None:
        query, score = np.concatenate([self.query, query]), np.concatenate([self.score, score])
        order = np.lexsort((-score, query))
        query, score = query[order], score[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        self.query, self.score = query[place < self.keep], score[place < self.keep]
        self.floor[query[place == self.keep - 1]] = score[place == self.keep - 1]


@dataclass(frozen=True)
class Late:
    """The known tokens with their unit vectors, and the queries' tokens: rows (query, token, times) ordered by query, which start at `starts`."""

    tokens: pa.Array
    units: np.ndarray
    keys: list
    asked: np.ndarray  # unit vectors of the distinct asked tokens
    cols: np.ndarray
    times: np.ndarray
    starts: np.ndarray
    total: np.ndarray
    limits: np.ndarray
    offsets: np.ndarray  # of a known token's entries in near and sims
    near: np.ndarray  # asked tokens in whose lists it is
    sims: np.ndarray

    @classmethod
    def of(cls, known: DataFrame, asked: list) -> Late:
        """Over known(token, u), all of one length, and rows (query, token, times) of known tokens. Lists are made in tasks."""
        terms, keys = sorted({r.token for r in asked}), sorted({r["query"] for r in asked}, key=str)
        column, row = {t: i for i, t in enumerate(terms)}, {k: i for i, k in enumerate(keys)}
        rows = sorted((row[r["query"]], column[r.token], r.times) for r in asked)
        of, cols, times = (np.array([a[i] for a in rows], np.int64) for i in range(3))
        starts = np.flatnonzero(np.diff(of, prepend=-1)) if len(of) else np.zeros(0, np.int64)
        total = np.add.reduceat(times, starts) if len(of) else np.ones(0)
        spark = known.sparkSession
        named = spark.createDataFrame(pa.table({"token": pa.array(terms, pa.string())})).join(known, "token").toArrow()
        vectors = _matrix(named["u"])[pc.index_in(pa.array(terms, pa.string()), named["token"].combine_chunks()).to_numpy()] if terms else np.zeros((0, 1))
        limits = np.full(len(terms), -2.0)
        if len(terms) > NEAR:
            fitted = _matrix(known.orderBy(F.xxhash64("token"), "token").limit(FITTED).select("u").toArrow()["u"]) @ vectors.T
            k = len(fitted) * NEAR // len(terms) + 1
            limits = -np.partition(-fitted, k - 1, 0)[k - 1] if k <= len(fitted) else limits
        shipped = spark.sparkContext.broadcast((vectors, limits))

        def listed(batches):
            vectors, limits = shipped.value
            for batch in batches:
                counts, near, sims = [np.zeros(1, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
                for a in range(0, len(batch) if len(vectors) else 0, DOCS):
                    here = _matrix(batch.column(1).slice(a, DOCS)) @ vectors.T
                    above = here > limits
                    counts.append(above.sum(1))
                    near.append(np.nonzero(above)[1])
                    sims.append(here[above])
                offsets = np.cumsum(np.concatenate(counts)) if len(vectors) else np.zeros(len(batch) + 1)
                offsets = pa.array(offsets.astype(np.int32))
                of = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x).astype(t))) for x, t in ((near, np.int32), (sims, np.float32))]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *of], ["token", "u", "near", "sims"])

        every = known.select("token", "u").mapInArrow(listed, "token string, u array<double>, near array<int>, sims array<float>").toArrow()
        sizes = pc.list_value_length(every["near"].combine_chunks()).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = (every[c].combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("near", "sims"))
        return cls(every["token"].combine_chunks(), _matrix(every["u"]), keys, vectors, cols, times, starts, total, limits, np.concatenate([[0], np.cumsum(sizes)]), *flat)

    def only(self, wanted: set) -> Late:
        """For these queries alone."""
        keys, rows, starts = _of(wanted, self.keys, self.cols, self.starts)
        used, cols = np.unique(self.cols[rows], return_inverse=True)
        at = np.full(len(self.limits), -1, np.int32)
        at[used] = np.arange(len(used))
        near = at[self.near]
        offsets = np.concatenate([[0], np.cumsum(near >= 0)])[self.offsets]
        total = self.total[[k in wanted for k in self.keys]] if self.keys else self.total
        return replace(self, keys=keys, asked=self.asked[used], cols=cols, times=self.times[rows], starts=starts, total=total, limits=self.limits[used], offsets=offsets, near=near[near >= 0], sims=self.sims[near >= 0])

    def parts(self, batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
        """Of a batch (doc_id, tokens), some documents at a time: ids of those with a known token, and pairs (document, known token) by document."""
        lists = batch.column(1)
        sizes = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
        at = pc.index_in(lists.flatten(), self.tokens).fill_null(-1).to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        for a in range(0, len(batch), DOCS):
            b = min(a + DOCS, len(batch))
            here, owner = at[ends[a] : ends[b]], np.repeat(np.arange(a, b), sizes[a:b])
            pairs = np.sort(owner[here >= 0] * np.int64(len(self.tokens)) + here[here >= 0])
            owner, here = np.divmod(pairs[np.diff(pairs, prepend=-1) > 0], len(self.tokens))
            new = np.diff(owner, prepend=-1) > 0
            if len(owner):
                yield batch.column(0).take(pa.array(owner[new])), np.cumsum(new) - 1, here

    def bounds(self, owner: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        """Queries by documents: no score is more."""
        most = np.repeat(self.limits.astype(np.float32)[None], n, 0)
        sizes = self.offsets[at + 1] - self.offsets[at]
        entries = np.repeat(self.offsets[at] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        np.maximum.at(most.reshape(-1), np.repeat(owner * len(self.limits), sizes) + self.near[entries], self.sims[entries])
        tokens, most = np.diff(self.starts, append=len(self.cols)), np.ascontiguousarray(most.T)
        out = np.add.reduceat(most[self.cols] * self.times.astype(np.float32)[:, None], self.starts, 0) / self.total[:, None]
        return out + (SLACK + SINGLE * (tokens + 4))[:, None]

    def scores(self, doc: np.ndarray, query: np.ndarray, first: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The scores of pairs, ordered by document, whose known tokens are at[first[doc]:first[doc + 1]]."""
        out, ends = np.empty(len(doc)), np.append(self.starts[1:], len(self.cols))
        change = [*np.flatnonzero(np.diff(doc, prepend=-1)), len(doc)]
        for a, b in zip(change, change[1:], strict=False):
            which, u = query[a:b], self.units[at[first[doc[a]] : first[doc[a] + 1]]]
            sizes = ends[which] - self.starts[which]
            begin = np.cumsum(sizes) - sizes
            rows = np.repeat(self.starts[which] - begin, sizes) + np.arange(sizes.sum())
            terms, back = np.unique(self.cols[rows], return_inverse=True)
            best = (u @ self.asked[terms].T).max(0)[back]
            out[a:b] = np.round(np.add.reduceat(np.rint(best * self.times[rows] * 1e9), begin) / 1e9 / self.total[which], 6)
        return out

    def among(self, best: Best, owner: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """query, document, score of those of n documents that may be among the best; those of the greatest bounds are scored first, which raises the floor."""
        bounds, first = self.bounds(owner, at, n), np.searchsorted(owner, np.arange(n + 1))
        rest, found = bounds >= best.floor[:, None], []
        leading = np.zeros_like(rest)
        leaders = np.argpartition(-bounds, best.keep - 1, 1)[:, : best.keep] if n > best.keep else np.broadcast_to(np.arange(n), (len(bounds), n))
        np.put_along_axis(leading, leaders, True, 1)
        for turn in (leading, ~leading):
            doc, query = np.nonzero((rest & turn & (bounds >= best.floor[:, None])).T)
            found.append((query, doc, self.scores(doc, query, first, at)))
            best.add(query, found[-1][2])
        query, doc, score = (np.concatenate(x) for x in zip(*found, strict=True))
        near = score >= best.floor[query]
        return query[near], doc[near], score[near]


def best_by_lists(key: StructField, docs: DataFrame, late: Late, keep: int) -> DataFrame:
    """query, doc_id, score of docs(doc_id, tokens): what each task can't leave out of the `keep` best of a query, equal ones too."""
    shipped = docs.sparkSession.sparkContext.broadcast(late)
    schema = StructType([key, docs.schema["doc_id"], StructField("score", DoubleType())])
    wanted = to_arrow_schema(schema)

    def run(batches):
        late = shipped.value
        if not late.keys:
            return
        best, keys = Best(len(late.keys), keep), pa.array(late.keys, wanted.field(0).type)
        for batch in batches:
            for ids, owner, at in late.parts(batch):
                query, doc, score = late.among(best, owner, at, len(ids))
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(query)), ids.take(pa.array(doc)), pa.array(score)], schema=wanted)

    return docs.select("doc_id", "tokens").mapInArrow(run, schema)


@dataclass(frozen=True)
class Terms:
    """The queries' distinct terms that an index holds, for BM25 in the tasks that hold the documents: rows (query, term) ordered by query, which start at `starts`."""

    terms: pa.Array
    idf: np.ndarray
    keys: list
    cols: np.ndarray
    starts: np.ndarray
    avgdl: float
    k1: float
    b: float

    @classmethod
    def of(cls, index, queries: DataFrame) -> Terms:
        """Of queries(query, tokens) over an Index."""
        asked = queries.select("query", F.explode(F.array_distinct("tokens")).alias("term"))
        df = index.doc_freq_of(asked.select("term").distinct()).crossJoin(F.broadcast(index.stats))  # one row of stats
        rows = asked.join(df.select("term", idf(F.col("n"), F.col("df")).alias("idf"), "avgdl"), "term").collect()  # the queries' terms
        weight, keys = {r.term: r.idf for r in rows}, sorted({r["query"] for r in rows}, key=str)
        column, row = {t: i for i, t in enumerate(sorted(weight))}, {k: i for i, k in enumerate(keys)}
        pairs = np.array(sorted((row[r["query"]], column[r.term]) for r in rows), np.int64).reshape(-1, 2)
        return cls(pa.array(sorted(weight), pa.string()), np.array([weight[t] for t in column]), keys, pairs[:, 1], np.flatnonzero(np.diff(pairs[:, 0], prepend=-1)), rows[0].avgdl if rows else 1.0, index.k1, index.b)

    def only(self, wanted: set) -> Terms:
        """For these queries alone."""
        keys, rows, starts = _of(wanted, self.keys, self.cols, self.starts)
        used, cols = np.unique(self.cols[rows], return_inverse=True)
        return replace(self, terms=self.terms.take(pa.array(used)), idf=self.idf[used], keys=keys, cols=cols, starts=starts)

    def parts(self, batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, np.ndarray]]:
        """Of a batch (doc_id, tokens), some documents at a time: their ids, and queries by documents the units of the scores, as Index.scores() adds them up; 0 without a shared term."""
        lists = batch.column(1)
        sizes = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
        at = pc.index_in(lists.flatten(), self.terms).fill_null(-1).to_numpy(zero_copy_only=False)
        ends, width = np.concatenate([[0], np.cumsum(sizes)]), len(self.terms)
        for a in range(0, len(batch) if self.keys else 0, DOCS):
            b = min(a + DOCS, len(batch))
            here, owner = at[ends[a] : ends[b]], np.repeat(np.arange(b - a), sizes[a:b])
            pairs = np.sort(owner[here >= 0] * np.int64(width) + here[here >= 0])
            new = np.flatnonzero(np.diff(pairs, prepend=-1))
            (owner, term), tf = np.divmod(pairs[new], width), np.diff(new, append=len(pairs))
            part = self.idf[term] * tf * (self.k1 + 1.0) / (tf + self.k1 * (1.0 - self.b + self.b * sizes[a:b][owner] / self.avgdl))
            units = np.zeros((width, b - a))
            units[term, owner] = np.floor(part * QUANTUM + 0.5)  # whole numbers, whose sums are exact
            yield batch.column(0).slice(a, b - a), np.add.reduceat(units[self.cols], self.starts, 0)


def _in_tasks(key: StructField, docs: DataFrame, shared: tuple, columns: list[StructField], run) -> DataFrame:
    """query, doc_id and `columns` that run(shared, batches) gives as (values of query, doc_id, columns) over docs(doc_id, tokens)."""
    shipped, schema = docs.sparkSession.sparkContext.broadcast(shared), StructType([key, docs.schema["doc_id"], *columns])
    types = [f.type for f in to_arrow_schema(schema)]

    def given(batches):
        for values in run(shipped.value, batches):
            yield pa.RecordBatch.from_arrays([v.cast(t) if isinstance(v, pa.Array) else pa.array(v, t) for v, t in zip(values, types, strict=True)], schema.names)

    return docs.select("doc_id", "tokens").mapInArrow(given, schema)


_SCORE, _DENSE, _COUNT = StructField("score", DoubleType()), StructField("dense", BooleanType()), StructField("n", LongType())


def first_lists(key: StructField, docs: DataFrame, late: Late, terms: Terms, depth: int) -> DataFrame:
    """query, doc_id, score, dense: what each task can't leave out of a query's first `depth` places by late interaction (dense) and by BM25."""

    def run(shared, batches):
        late, terms = shared
        near, best = Best(len(late.keys), depth), Best(len(terms.keys), depth)
        for batch in batches:
            for ids, owner, at in late.parts(batch) if late.keys else ():
                query, doc, score = late.among(near, owner, at, len(ids))
                yield [late.keys[q] for q in query], ids.take(pa.array(doc)), score, np.ones(len(doc), bool)
            for ids, units in terms.parts(batch):
                top = -np.partition(-units, depth - 1, 1)[:, depth - 1 :][:, :1] if len(ids) > depth else np.zeros((len(units), 1))
                query, doc = np.nonzero((units >= np.maximum(top, best.floor[:, None])) & (units > 0))
                best.add(query, units[query, doc])
                still = units[query, doc] >= best.floor[query]
                query, doc = query[still], doc[still]
                yield [terms.keys[q] for q in query], ids.take(pa.array(doc)), units[query, doc] / QUANTUM, np.zeros(len(doc), bool)

    return _in_tasks(key, docs, (late, terms), [_SCORE, _DENSE], run)


def scores_of(key: StructField, docs: DataFrame, late: Late, terms: Terms, wanted: list) -> DataFrame:
    """query, doc_id, score, dense of the wanted rows (query, doc_id, dense), which are in the lists."""
    of: dict = {}
    for r in wanted:
        of.setdefault((r.doc_id, r.dense), []).append(r["query"])

    def run(shared, batches):
        late, terms, of = shared
        rows = {True: {k: i for i, k in enumerate(late.keys)}, False: {k: i for i, k in enumerate(terms.keys)}}

        def pairs(ids, dense):
            found = [(d, rows[dense][q]) for d, i in enumerate(ids.to_pylist()) for q in of.get((i, dense), ()) if q in rows[dense]]
            return np.array(found, np.int64).reshape(-1, 2).T

        for batch in batches:
            for ids, owner, at in late.parts(batch) if late.keys else ():
                doc, query = pairs(ids, True)
                yield [late.keys[q] for q in query], ids.take(pa.array(doc)), late.scores(doc, query, np.searchsorted(owner, np.arange(len(ids) + 1)), at), np.ones(len(doc), bool)
            for ids, units in terms.parts(batch):
                doc, query = pairs(ids, False)
                doc, query = doc[units[query, doc] > 0], query[units[query, doc] > 0]
                yield [terms.keys[q] for q in query], ids.take(pa.array(doc)), units[query, doc] / QUANTUM, np.zeros(len(doc), bool)

    return _in_tasks(key, docs, (late, terms, of), [_SCORE, _DENSE], run)


def counts_before(key: StructField, docs: DataFrame, late: Late, terms: Terms, own: list) -> DataFrame:
    """query, doc_id, dense, n: how many documents of each list come before rows (query, doc_id, score, dense), by falling score, then doc_id; a row a task.

    Documents are counted where they are. By late interaction only those are scored whose bounds reach the least of a query's own scores.
    """

    def run(shared, batches):
        late, terms, own = shared
        n = np.zeros(len(own), np.int64)
        of: dict = {}
        for i, r in enumerate(own):
            of.setdefault((r["query"], r.dense), []).append(i)
        least = np.array([min((own[i].score for i in of.get((k, True), ())), default=np.inf) for k in late.keys])
        asked = [(q, of[k, False]) for q, k in enumerate(terms.keys) if (k, False) in of]

        def count(mine, score, ids):
            for i in mine:
                at = round(own[i].score * QUANTUM) if not own[i].dense else own[i].score
                n[i] += (score > at).sum() + (ids[score == at] < own[i].doc_id).sum()

        for batch in batches:
            for ids, owner, at in late.parts(batch) if np.isfinite(least).any() else ():
                doc, query = np.nonzero((late.bounds(owner, at, len(ids)) >= least[:, None]).T)
                score, ids = late.scores(doc, query, np.searchsorted(owner, np.arange(len(ids) + 1)), at), ids.to_numpy(zero_copy_only=False)
                for q in np.unique(query):
                    count(of[late.keys[q], True], score[query == q], ids[doc[query == q]])
            for ids, units in terms.parts(batch) if asked else ():
                ids = ids.to_numpy(zero_copy_only=False)
                for q, mine in asked:
                    count(mine, units[q], ids)
        yield [r["query"] for r in own], [r.doc_id for r in own], [r.dense for r in own], n

    late, terms = late.only({r["query"] for r in own if r.dense}), terms.only({r["query"] for r in own if not r.dense})
    return _in_tasks(key, docs, (late, terms, own), [_DENSE, _COUNT], run)
