"""Retrieval of knowledge: BM25, late interaction over token vectors, and their rank fusion, over documents or chunks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from lexiloom.functions.relevance import RRF_K, rrf
from lexiloom.functions.vectors import unit
from lexiloom.operators.index import Engine, Index, shipped
from lexiloom.operators.late import Late, Terms, best_by_lists, counts_before, first_lists, scores_of
from lexiloom.operators.patterns import Scan, SubstringIndex
from lexiloom.operators.vector_index import VectorIndex
from lexiloom.sources.shared import written

MODES = ("bm25", "dense", "hybrid")


def fold(ranked: DataFrame, owners: DataFrame) -> DataFrame:
    """Ranks of chunks(query, doc_id = chunk, rank) as ranks of their documents; owners(chunk_id, doc_id). A document has its best chunk's place."""
    best = ranked.withColumnRenamed("doc_id", "chunk_id").join(owners.select("chunk_id", "doc_id"), "chunk_id").groupBy("query", "doc_id").agg(F.min("rank").alias("best"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("best", "doc_id"))).drop("best")


def placed(scored: DataFrame) -> DataFrame:
    """query, doc_id, place: places in a query's list, by falling score, then doc_id; the smallest comes first."""
    return scored.select("query", "doc_id", F.struct((-F.col("score")).alias("down"), F.col("doc_id").alias("tie")).alias("place"))


def fold_places(chunks: DataFrame, owners: DataFrame) -> DataFrame:
    """placed() chunks as their documents: a document has its best chunk's place. Nothing is ranked for it."""
    named = chunks.withColumnRenamed("doc_id", "chunk_id").join(owners.select("chunk_id", "doc_id"), "chunk_id")
    return named.groupBy("query", "doc_id").agg(F.min("place").alias("place"))


def ranked(places: DataFrame, depth: int | None = None) -> DataFrame:
    """query, doc_id, rank; the first `depth` of each query, which each task cuts its rows to before they meet."""
    out = places.select("query", "doc_id", F.row_number().over(Window.partitionBy("query").orderBy("place", "doc_id")).alias("rank"))
    return out if depth is None else out.where(F.col("rank") <= depth)


def ranks_of(places: DataFrame, wanted: DataFrame) -> DataFrame:
    """query, doc_id, rank of the wanted (query, doc_id) in placed lists of any length.

    Two levels: rows are dealt by ranges of (query, place), so that a long list lies in several parts, ranked inside
    each part, and moved by the number of rows of the query in the parts before.
    """
    dealt = written(places.repartitionByRange("query", "place", "doc_id").withColumn("part", F.spark_partition_id()), "ranges")
    before = Window.partitionBy("query").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    moved = dealt.groupBy("query", "part").agg(F.count(F.lit(1)).alias("n")).select("query", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("moved"))
    local = dealt.withColumn("local", F.row_number().over(Window.partitionBy("query", "part").orderBy("place", "doc_id"))).join(wanted.select("query", "doc_id"), ["query", "doc_id"], "left_semi")
    return local.join(moved, ["query", "part"]).select("query", "doc_id", (F.col("local") + F.col("moved")).cast("int").alias("rank"))


#: Bytes of the table of similarities, known tokens by asked tokens, and of the vectors it is made of; both are broadcast.
TABLE_BYTES = 64 << 20
#: Bytes of the vectors where only these are broadcast; documents and asked tokens whose similarities a task holds at once.
VECTOR_BYTES, DOCS, ASKED = 384 << 20, 1000, 256


def maxsim(queries: DataFrame, docs: DataFrame, vectors: DataFrame, limit: int = TABLE_BYTES, keep: int | None = None) -> DataFrame:
    """query, doc_id, score: the mean over the query's known tokens, repeats counted, of the greatest cosine to a known token of the document.

    queries(query, tokens), docs(doc_id, tokens). Similarities are made between distinct tokens once. If their table
    and the vectors take at most `limit` bytes, each task looks documents up in it, in Arrow batches and without a
    shuffle. Where only the vectors take at most VECTOR_BYTES, these are broadcast, and a task makes the similarities of
    its documents' tokens, some documents at a time. More vectors meet the documents' tokens by an equality join. With `keep` a task may leave out
    documents that aren't among its `keep` best of a query, by falling score, then doc_id; the best of all stay whole.
    Broadcast vectors then go with lists of near tokens, whose bounds tell which documents are scored at all.
    """
    known, q, size = _known(queries, vectors)
    n_asked, n_pairs = q.agg(F.count_distinct("token"), F.count(F.lit(1))).first()
    if size.n * (size.dims + n_asked) * 8 + n_pairs * 100 <= limit:
        return _maxsim_by_table(queries, docs, known.collect(), q.collect(), keep)
    if size.n * size.dims * 8 <= VECTOR_BYTES and size.dims == size.least:
        if keep is not None:
            return best_by_lists(queries.schema["query"], docs, Late.of(known, q.collect()), keep)
        return _maxsim_by_vectors(queries, docs, known, q.collect())
    asked = q.select("token").distinct().join(known, "token").select(F.col("token").alias("q"), F.col("u").alias("uq"))
    d = docs.select("doc_id", F.explode(F.array_distinct("tokens")).alias("token"))
    present = VectorIndex.of(vectors.join(d.select("token").distinct(), "token", "left_semi"))
    sims = present.all_pairs(asked.select(F.col("q").alias("query"), F.col("uq").alias("u"))).select(F.col("other").alias("token"), F.col("query").alias("q"), "sim")
    best = d.join(sims, "token").groupBy("doc_id", "q").agg(F.max("sim").alias("sim"))
    total = q.groupBy("query").agg(F.sum("times").alias("n"))
    joined = best.join(q.withColumnRenamed("token", "q"), "q").groupBy("query", "doc_id").agg(F.sum(F.round(F.col("sim") * F.col("times") * 1e9).cast("long")).alias("s"))
    return joined.join(total, "query").select("query", "doc_id", F.round(F.col("s") / 1e9 / F.col("n"), 6).alias("score"))


def _known(queries: DataFrame, vectors: DataFrame):
    """(token, u) of the vectors with a direction; the queries' tokens among them, with their times; their number and greatest and least length."""
    known = written(vectors.select("token", unit("vec").alias("u")).where("u is not null"), "units")
    q = queries.select("query", F.explode("tokens").alias("token")).groupBy("query", "token").agg(F.count(F.lit(1)).alias("times")).join(known.select("token"), "token", "left_semi")
    return known, q, known.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("u")), F.lit(0)).alias("dims"), F.coalesce(F.min(F.size("u")), F.lit(0)).alias("least")).first()


def _maxsim_by_vectors(queries: DataFrame, docs: DataFrame, known: DataFrame, asked: list) -> DataFrame:
    """maxsim() of all documents, with the vectors at hand, all of one length, and the queries' tokens: nothing is shuffled."""
    vectors = known.select("token", "u").toArrow()
    tokens = vectors["token"].combine_chunks()
    units = vectors["u"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(tokens), -1)
    terms, keys = sorted({r.token for r in asked}), sorted({r["query"] for r in asked}, key=str)
    column, row = {t: i for i, t in enumerate(terms)}, {k: i for i, k in enumerate(keys)}
    rows = sorted((row[r["query"]], column[r.token], r.times) for r in asked)
    of, cols, times = (np.array([a[i] for a in rows], np.int64) for i in range(3))
    starts = np.flatnonzero(np.diff(of, prepend=-1)) if len(of) else np.zeros(0, np.int64)
    total = np.add.reduceat(times, starts) if len(of) else np.ones(0)
    shipped = docs.sparkSession.sparkContext.broadcast((tokens, units, terms, keys, cols, times, starts, total))
    schema = StructType([queries.schema["query"], docs.schema["doc_id"], StructField("score", DoubleType())])
    wanted = to_arrow_schema(schema)

    def run(batches):
        tokens, units, terms, keys, cols, times, starts, total = shipped.value
        if not keys:
            return
        asked = units[pc.index_in(pa.array(terms, tokens.type), tokens).to_numpy()]
        for batch in batches:
            for a in range(0, len(batch), DOCS):
                part = batch.slice(a, DOCS)
                lists = part.column(1)
                owner = np.repeat(np.arange(len(part)), np.diff(lists.offsets.to_numpy()) if not lists.null_count else [len(x) if x is not None else 0 for x in lists.to_pylist()])
                at = pc.index_in(lists.flatten(), tokens).fill_null(-1).to_numpy()
                pairs = np.unique(owner[at >= 0] * np.int64(len(tokens)) + at[at >= 0])  # a document's distinct tokens
                owner, at = pairs // len(tokens), pairs % len(tokens)
                found, first = np.unique(owner, return_index=True)
                if not len(found):
                    continue
                distinct, place = np.unique(at, return_inverse=True)
                best = np.empty((len(found), len(terms)))
                for c in range(0, len(terms), ASKED):
                    sims = units[distinct] @ asked[c : c + ASKED].T
                    for i, (low, high) in enumerate(zip(first, [*first[1:], len(at)], strict=True)):
                        sims[place[low:high]].max(0, out=best[i, c : c + ASKED])
                table = np.concatenate([np.round(np.add.reduceat(np.rint(best[i : i + 64, cols] * times * 1e9), starts, 1) / 1e9 / total, 6) for i in range(0, len(found), 64)])  # documents by queries
                doc, query = (x.ravel() for x in np.indices(table.shape))
                yield pa.RecordBatch.from_arrays([pa.array(keys, wanted.field(0).type).take(pa.array(query)), part.column(0).take(pa.array(found[doc])), pa.array(table[doc, query])], schema=wanted)

    return docs.select("doc_id", "tokens").mapInArrow(run, schema)


def _maxsim_by_table(queries: DataFrame, docs: DataFrame, known: list, asked: list, keep: int | None) -> DataFrame:
    """maxsim() with the vectors and the queries' tokens at hand."""
    at = {r.token: i for i, r in enumerate(known)}
    terms = sorted({r.token for r in asked})
    keys = sorted({r["query"] for r in asked}, key=str)
    column, row = {t: i for i, t in enumerate(terms)}, {k: i for i, k in enumerate(keys)}
    asked = sorted((row[r["query"]], column[r.token], r.times) for r in asked)
    of, cols, times = (np.array([a[i] for a in asked], np.int64) for i in range(3))
    starts = np.flatnonzero(np.diff(of, prepend=-1)) if len(of) else np.zeros(0, np.int64)
    total = np.add.reduceat(times, starts) if len(of) else np.ones(0)
    unit_vectors = np.array([r.u for r in known]).reshape(len(known), -1)
    sims = unit_vectors @ unit_vectors[[at[t] for t in terms]].T if terms else np.zeros((len(known), 0))
    shipped = docs.sparkSession.sparkContext.broadcast((at, keys, cols, times, starts, total, sims))
    schema = StructType([queries.schema["query"], docs.schema["doc_id"], StructField("score", DoubleType())])
    wanted = to_arrow_schema(schema)

    def run(batches):
        at, keys, cols, times, starts, total, sims = shipped.value
        if not keys:
            return
        for batch in batches:
            ids, found, scores = batch.column(0), [], []
            for i, tokens in enumerate(batch.column(1).to_pylist()):
                rows = [at[t] for t in set(tokens or ()) if t in at]
                if rows:
                    found.append(i)
                    scores.append(np.round(np.add.reduceat(np.rint(sims[rows].max(0)[cols] * times * 1e9), starts) / 1e9 / total, 6))
            if not found:
                continue
            table, ids = np.array(scores), ids.take(pa.array(found))  # documents by queries
            if keep is None or len(found) <= keep:
                doc, query = (x.ravel() for x in np.indices(table.shape))
            else:  # what reaches the query's keep-th best score, equal ones too
                least = -np.partition(-table, keep - 1, axis=0)[keep - 1]
                doc, query = np.nonzero(table >= least)
            yield pa.RecordBatch.from_arrays([pa.array(keys, wanted.field(0).type).take(pa.array(query)), ids.take(pa.array(doc)), pa.array(table[doc, query])], schema=wanted)

    return docs.select("doc_id", "tokens").mapInArrow(run, schema)


def fuse(bm25: DataFrame, dense: DataFrame, k: int = RRF_K) -> DataFrame:
    """query, doc_id, score, rank_bm25, rank_dense (null where a list lacks the document): reciprocal ranks added."""
    both = bm25.select("query", "doc_id", F.col("rank").alias("rank_bm25")).join(dense.select("query", "doc_id", F.col("rank").alias("rank_dense")), ["query", "doc_id"], "full_outer")
    return both.withColumn("score", F.round(rrf(F.col("rank_bm25"), k) + rrf(F.col("rank_dense"), k), 9)).where("score > 0")


@dataclass(frozen=True)
class Retriever:
    """Over docs(doc_id, tokens): documents, or chunks with `owners`(chunk_id, doc_id) to fold them; `index` over them if it is there already.

    Without vectors dense and hybrid fall back to bm25, and `degraded` says so.
    """

    docs: DataFrame
    mode: str = "hybrid"
    vectors: DataFrame | None = None
    owners: DataFrame | None = None
    index: Index | None = None

    def __post_init__(self) -> None:
        if self.mode not in MODES:
            raise ValueError(f"mode must be one of {MODES}: {self.mode!r}")

    @property
    def degraded(self) -> bool:
        return self.mode != "bm25" and self.vectors is None

    def size(self) -> int:
        """How many documents or chunks are searched."""
        return self.docs.count()

    def _places(self, scored: DataFrame) -> DataFrame:
        return fold_places(placed(scored), self.owners) if self.owners is not None else placed(scored)

    @cached_property
    def _index(self) -> Index:
        return self.index or Index.of_tokens(self.docs)

    def _bm25(self, queries: DataFrame, depth: int) -> DataFrame:
        """query, doc_id, rank of the first places, from the scores of all documents that share a term."""
        if self.owners is None:
            return self._index.best(queries, depth, bounds=False).select("query", "doc_id", "rank")
        return ranked(self._places(self._index.scores(queries)), depth)

    def _dense(self, queries: DataFrame, depth: int | None = None) -> DataFrame:
        """Placed documents; with a depth a task may leave out what isn't among its first so many."""
        return self._places(maxsim(queries, self.docs, self.vectors, keep=depth if self.owners is None else None))

    def _fused(self, queries: DataFrame, k: int) -> DataFrame:
        """The fused scores of all documents that can be among the k best, without whole lists.

        Of either list the first RRF_K + 2 k places can matter only: the k best of a list reach 1 / (RRF_K + k), and what
        is to beat them reaches half of that in one list. A document among them that isn't in the other list's first
        places has at most the next place there. If that could bring it among the k best, the better documents of the
        other list are counted for it; nothing is ranked or stored for that. Where documents are searched and the vectors can
        be broadcast, both lists come from one pass over the documents, and both counts from another.
        """
        depth, late, key = RRF_K + 2 * k, None, queries.schema["query"]
        if self.owners is None:
            known, q, size = _known(queries, self.vectors)
            if size.n * size.dims * 8 <= VECTOR_BYTES and size.dims == size.least:
                late, terms = Late.of(known, q.collect()), Terms.of(self._index, queries)
        if late:
            lists = written(first_lists(key, self.docs, late, terms, depth), "lists")
            first = [ranked(placed(lists.where(c)), depth) for c in ("not dense", "dense")]
        else:
            first = [ranked(self._places(self._index.scores(queries)), depth), ranked(self._dense(queries, depth), depth)]
        near = written(fuse(*first), "fused")  # 2 depth rows a query at most
        most = F.col("score") + F.when(F.col("rank_bm25").isNull() | F.col("rank_dense").isNull(), 1.0 / (RRF_K + depth + 1)).otherwise(0.0)
        kth = near.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "doc_id"))).where(F.col("place") == k).select("query", F.col("score").alias("kth"))
        possible = near.join(kth, "query", "left").where(most >= F.coalesce("kth", F.lit(0.0)) - 1e-8)
        open_bm25, open_dense = (written(possible.where(F.col(c).isNull()).select("query", "doc_id"), c) for c in ("rank_bm25", "rank_dense"))
        if late:
            wanted = open_bm25.withColumn("dense", F.lit(False)).unionByName(open_dense.withColumn("dense", F.lit(True)))
            docs = self.docs.join(shipped(wanted.select("doc_id").distinct()), "doc_id", "left_semi")
            own = scores_of(key, docs, late, terms, wanted.collect()).collect()  # 2 depth rows a query at most
            counts = counts_before(key, self.docs if own else docs, late, terms, own)
            before = written(counts.groupBy("query", "doc_id", "dense").agg((F.sum("n") + 1).cast("int").alias("rank")), "before")
            counted, counted_dense = (before.where(c).select("query", "doc_id", F.col("rank").alias(f"more_{name}")) for c, name in (("not dense", "bm25"), ("dense", "dense")))
            return self._known_ranks(possible, counted, counted_dense)
        counted = self._counted(open_bm25, self._open_bm25(queries, open_bm25), lambda asked: self._places(self._index.scores(asked)), queries, "more_bm25")
        counted_dense = self._counted(open_dense, self._open_dense(queries, open_dense), self._dense, queries, "more_dense")
        return self._known_ranks(possible, counted, counted_dense)

    def _known_ranks(self, possible: DataFrame, counted: DataFrame, counted_dense: DataFrame) -> DataFrame:
        """The fused scores of the possible documents with the ranks that were counted for them."""
        known = possible.join(counted, ["query", "doc_id"], "left").join(counted_dense, ["query", "doc_id"], "left")
        bm25, dense = F.coalesce("rank_bm25", "more_bm25"), F.coalesce("rank_dense", "more_dense")
        return known.select("query", "doc_id", F.round(rrf(bm25) + rrf(dense), 9).alias("score"), bm25.alias("rank_bm25"), dense.alias("rank_dense"))

    def _chunks_of(self, wanted: DataFrame) -> DataFrame:
        """The documents' chunks where there are chunks."""
        if self.owners is None:
            return wanted
        return wanted.join(self.owners.select("chunk_id", "doc_id"), "doc_id").select("query", F.col("chunk_id").alias("doc_id"))

    def _open_bm25(self, queries: DataFrame, wanted: DataFrame) -> DataFrame:
        return self._places(self._index.scores_of(self._chunks_of(wanted), queries)).join(wanted, ["query", "doc_id"], "left_semi")

    def _open_dense(self, queries: DataFrame, wanted: DataFrame) -> DataFrame:
        docs = self.docs.join(self._chunks_of(wanted).select("doc_id").distinct(), "doc_id", "left_semi")
        return self._places(maxsim(queries.join(wanted.select("query").distinct(), "query", "left_semi"), docs, self.vectors)).join(wanted, ["query", "doc_id"], "left_semi")

    def _counted(self, wanted: DataFrame, places: DataFrame, every: Callable[[DataFrame], DataFrame], queries: DataFrame, name: str) -> DataFrame:
        """query, doc_id, rank named so: one more than the documents of a list before the wanted one; those without a place aren't in the list."""
        if wanted.isEmpty():
            return wanted.withColumn(name, F.lit(None).cast("int"))
        # At most two lists' first places a query: they go to the whole lists, whose rows are counted where they are.
        own = written(places.select("query", F.col("doc_id").alias("own"), F.col("place").alias("at")), name)
        asked = queries.join(own.select("query").distinct(), "query", "left_semi")
        better = every(asked).join(F.broadcast(own), "query").groupBy("query", "own").agg(F.count(F.when(F.struct("place", "doc_id") < F.struct("at", "own"), 1)).alias("n"))
        return better.select("query", F.col("own").alias("doc_id"), (F.col("n") + 1).cast("int").alias(name))

    def retrieve(self, queries: DataFrame, k: int = 3) -> DataFrame:
        """query, doc_id, rank, score, rank_bm25, rank_dense, degraded for queries(query, tokens); a query without dense hits takes the bm25 list."""
        k, none = max(1, k), F.lit(None).cast("int")
        if self.mode == "bm25" or self.degraded:
            fused = self._bm25(queries, k).select("query", "doc_id", rrf(F.col("rank")).alias("score"), F.col("rank").alias("rank_bm25"), none.alias("rank_dense"))
        elif self.mode == "dense":
            keep = k if self.owners is None else None  # a document's chunks take several places
            dense = ranked(self._places(maxsim(queries, self.docs, self.vectors, keep=keep)), k)
            only = dense.select("query", "doc_id", rrf(F.col("rank")).alias("score"), none.alias("rank_bm25"), F.col("rank").alias("rank_dense"))
            rest = self._bm25(queries.join(dense.select("query").distinct(), "query", "left_anti"), k)
            fused = only.unionByName(rest.select("query", "doc_id", rrf(F.col("rank")).alias("score"), F.col("rank").alias("rank_bm25"), none.alias("rank_dense")))
        else:
            fused = self._fused(queries, k)
        order = Window.partitionBy("query").orderBy(F.desc("score"), "doc_id")
        return fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query", "doc_id", "rank", F.round("score", 6).alias("score"), "rank_bm25", "rank_dense", F.lit(self.degraded).alias("degraded"))


def discriminative(knowledge: DataFrame) -> DataFrame:
    """Knowledge rows with some families, but not all that occur."""
    every = knowledge.select(F.explode("families").alias("f")).agg(F.count_distinct("f").alias("__n"))
    return knowledge.crossJoin(F.broadcast(every)).where((F.size("families") > 0) & (F.size(F.array_distinct("families")) < F.col("__n"))).drop("__n")


def relevant_docs(queries: DataFrame, knowledge: DataFrame) -> DataFrame:
    """query, doc_id: discriminative rows that have the query's family, by an equality join on exploded families."""
    tagged = discriminative(knowledge).select("doc_id", F.explode(F.array_distinct("families")).alias("family"))
    return queries.select("query", "family").join(tagged, "family").select("query", "doc_id")


def retrieval_metrics(retrieved: DataFrame, relevant: DataFrame) -> DataFrame:
    """query, hit, recall, precision, rr for each query that has a relevant document."""
    wanted = relevant.groupBy("query").agg(F.count(F.lit(1)).alias("wanted"))
    hit = retrieved.join(relevant.withColumn("__r", F.lit(1)), ["query", "doc_id"], "left").groupBy("query").agg(F.count("__r").alias("found"), F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("__r") == 1, F.col("rank"))).alias("first"))
    rows = wanted.join(hit, "query", "left")
    zero = F.lit(0.0)
    return rows.select("query", (F.coalesce("found", F.lit(0)) > 0).cast("int").alias("hit"), F.coalesce(F.try_divide("found", "wanted"), zero).alias("recall"), F.coalesce(F.try_divide("found", "n"), zero).alias("precision"), F.coalesce(1.0 / F.col("first"), zero).alias("rr"))


def retrieval_means(scored: DataFrame) -> DataFrame:
    """hit_rate, recall, precision, mrr, n_queries, rounded to 4 decimals."""
    return scored.agg(F.round(F.avg("hit"), 4).alias("hit_rate"), F.round(F.avg("recall"), 4).alias("recall"), F.round(F.avg("precision"), 4).alias("precision"), F.round(F.avg("rr"), 4).alias("mrr"), F.count(F.lit(1)).alias("n_queries"))


def symptom_query(target: str, tokens: list[str], n_results: int, family: str | None = None) -> str:
    """A retrieval query that describes a failing search: its words, whether it found nothing, whether it fell apart into single characters."""
    said = [target, *([family.replace("_", " ")] if family else []), *(["no results"] if n_results == 0 else []), *(["split into single characters"] if len(tokens) >= 2 and all(len(t) == 1 for t in tokens) else [])]
    return " ".join(said)


def symptoms(engine: Engine, queries: DataFrame, raw: Scan | SubstringIndex, k: int = 10) -> DataFrame:
    """What is to be seen of each search of queries(query), in one plan: query, tokens, dropped (forms that analysis leaves out), n_results, n_raw (texts that hold the query as typed), symptoms.

    `symptoms` is the text to retrieve knowledge by. It tells what happened and never what would mend it: the query,
    its tokens and dropped forms, that nothing was found though texts hold the query, that it fell apart into letters.
    """
    asked = queries.select("query").distinct()
    seen = asked.select("query", engine.analyzer.tokens("query").alias("tokens"), F.transform(engine.analyzer.dropped("query"), lambda t: t["form"]).alias("dropped"))
    hits = engine.search(asked, k, terms=False, bounds=False).groupBy("query").agg(F.count(F.lit(1)).alias("n_results"))
    found = raw.grep(asked.select(F.col("query").alias("key"), F.col("query").alias("needle"))).groupBy(F.col("key").alias("query")).agg(F.count(F.lit(1)).alias("n_raw"))
    rows = seen.join(hits, "query", "left").join(found, "query", "left").withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_results", "n_raw")})
    apart = (F.size("tokens") >= 2) & F.forall("tokens", lambda t: F.char_length(t) == 1)
    said = F.concat_ws(
        " ", "query", F.array_join("tokens", " "), F.when(F.size("dropped") > 0, F.concat(F.lit("dropped "), F.array_join("dropped", " "))), F.when(F.col("n_results") == 0, F.lit("no results")),
        F.when((F.col("n_results") == 0) & (F.col("n_raw") > 0), F.lit("though texts hold it")), F.when(apart, F.lit("split into single characters")),
    )
    return rows.select("query", "tokens", "dropped", "n_results", "n_raw", said.alias("symptoms"))


def render_context(rows: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """query, context: retrieved(query, rank, title, text, and source if there is one) as numbered paragraphs, in order; a query has k rows at most.

    With queries(query), those without a hit have an empty context instead of no row. A null source isn't shown.
    """
    title = F.concat(F.col("title"), F.coalesce(F.concat(F.lit(" ("), F.col("source").cast("string"), F.lit(")")), F.lit(""))) if "source" in rows.columns else F.col("title")
    part = F.format_string("[%d] %s\n%s", F.col("rank"), title, F.col("text"))
    out = rows.groupBy("query").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", part.alias("p")))), lambda s: s["p"]), "\n\n").alias("context"))
    return out if queries is None else queries.select("query").distinct().join(out, "query", "left").withColumn("context", F.coalesce("context", F.lit("")))
