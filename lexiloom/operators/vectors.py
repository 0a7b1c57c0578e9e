"""Embedding similarity: pairs, nearest tokens, hubs, separability, rank of the answer. Unknown vectors stay unknown, never 0."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions.vectors import cosine, dot, unit
from lexiloom.operators.vector_index import VectorIndex
from lexiloom.sources.shared import written


def score_pairs(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """pairs(a, b, ...) with sim, null where either token has no vector."""
    left = vectors.select(F.col("token").alias("a"), F.col("vec").alias("__a"))
    right = vectors.select(F.col("token").alias("b"), F.col("vec").alias("__b"))
    return pairs.join(left, "a", "left").join(right, "b", "left").withColumn("sim", cosine("__a", "__b")).drop("__a", "__b")


def _indexed(vectors: DataFrame | VectorIndex) -> VectorIndex:
    return vectors if isinstance(vectors, VectorIndex) else VectorIndex.of(vectors)


def most_similar(queries: DataFrame, vectors: DataFrame | VectorIndex, k: int = 8) -> DataFrame:
    """query token, other, sim, rank of the k nearest others; tokens without a vector have none. A table of vectors is indexed first."""
    index = _indexed(vectors)
    asked = queries.select(F.col("token").cast("string").alias("token")).distinct().join(index.members, "token").select(F.col("token").alias("query"), "u")
    return index.most_similar(asked, k).select("query", "other", "sim", "rank")


def hub_scores(vectors: DataFrame) -> DataFrame:
    """token, hub: its mean similarity to every other token, in closed form from the sum of all unit vectors, so no pairs are made."""
    units = vectors.select("token", unit("vec").alias("__u")).where(F.col("__u").isNotNull())
    total = units.select(F.posexplode("__u").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("__sum"))  # one row, as long as a vector
    n = units.agg(F.count(F.lit(1)).alias("__n"))
    both = units.crossJoin(F.broadcast(total)).crossJoin(F.broadcast(n))
    return both.where("__n > 1").select("token", ((dot("__u", "__sum") - 1.0) / (F.col("__n") - 1)).alias("hub"))


def separability(scored: DataFrame) -> DataFrame:
    """How well one threshold tells links from others: scored(link boolean, sim) to one row.

    link_min, link_max, other_min, other_max, overlap, best_threshold, best_accuracy (ties: the higher threshold), baseline
    (share of the majority), n. Candidates are the values themselves; a value at or above the threshold counts as a
    link. Counts by value come first, so the running sums are over distinct values; pairs without a value are left out.
    """
    known = scored.where(F.col("sim").isNotNull()).withColumn("sim", F.round("sim", 6))
    counts = known.groupBy("sim").agg(F.count(F.when(F.col("link"), 1)).alias("links"), F.count(F.when(~F.col("link"), 1)).alias("others"))
    sums = known.agg(
        F.min(F.when(F.col("link"), F.col("sim"))).alias("link_min"), F.max(F.when(F.col("link"), F.col("sim"))).alias("link_max"), F.min(F.when(~F.col("link"), F.col("sim"))).alias("other_min"), F.max(F.when(~F.col("link"), F.col("sim"))).alias("other_max"),
        F.count(F.when(F.col("link"), 1)).alias("n_links"), F.count(F.lit(1)).alias("n"),
    )
    # Ranges of values in order, summed each; a range starts from the sums of those before it.
    ranges = written(counts.repartitionByRange("sim").withColumn("range", F.spark_partition_id()), "ranges")
    upward, within = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("range").orderBy("sim").rowsBetween(Window.unboundedPreceding, -1)
    carried = ranges.groupBy("range").agg(F.sum("links").alias("l"), F.sum("others").alias("o")).select("range", *(F.coalesce(F.sum(c).over(upward), F.lit(0)).alias(f"carried_{c}") for c in "lo"))  # a row a range
    below = ranges.join(F.broadcast(carried), "range").select("sim", (F.coalesce(F.sum("links").over(within), F.lit(0)) + F.col("carried_l")).alias("links_below"), (F.coalesce(F.sum("others").over(within), F.lit(0)) + F.col("carried_o")).alias("others_below"))
    right = below.crossJoin(F.broadcast(sums)).withColumn("right", F.col("n_links") - F.col("links_below") + F.col("others_below"))
    best = right.agg(F.max(F.struct("right", "sim")).alias("best"))
    return sums.crossJoin(F.broadcast(best)).select(
        "link_min", "link_max", "other_min", "other_max", F.coalesce(F.col("other_max") >= F.col("link_min"), F.lit(False)).alias("overlap"), F.col("best.sim").alias("best_threshold"),
        F.round(F.try_divide("best.right", "n"), 4).alias("best_accuracy"), F.round(F.try_divide(F.greatest(F.col("n_links"), F.col("n") - F.col("n_links")), F.col("n")), 4).alias("baseline"), "n",
    )


def rank_of_answer(questions: DataFrame, vectors: DataFrame | VectorIndex) -> DataFrame:
    """questions(token, answer) with rank (from 1) of the answer among all others by similarity, and sim; null if either is unknown.

    The rank is counted, not sorted: one more than the tokens that come before the answer.
    """
    index = _indexed(vectors)
    known = questions.distinct().join(index.members.select("token", F.col("u").alias("__q")), "token").join(index.members.select(F.col("token").alias("answer"), F.col("u").alias("__a")), "answer").where(F.size("__q") == F.size("__a"))
    asked = known.select(F.col("token").alias("query"), F.col("__q").alias("u"), "answer", F.round(dot("__q", "__a"), 6).alias("sim"))
    ranks = asked.join(index.before(asked), ["query", "answer"]).select(F.col("query").alias("token"), "answer", "sim", (F.col("before") + 1).alias("rank"))
    return questions.join(ranks, ["token", "answer"], "left").select("token", "answer", "sim", "rank")


def coverage(tokens: DataFrame, vectors: DataFrame) -> DataFrame:
    """known, distinct, coverage of tokens(token) by the vectors."""
    distinct = tokens.select("token").distinct().join(vectors.select("token", F.lit(1).alias("__k")), "token", "left")
    return distinct.agg(F.count("__k").alias("known"), F.count(F.lit(1)).alias("distinct_tokens"), F.round(F.coalesce(F.try_divide(F.count("__k"), F.count(F.lit(1))), F.lit(0.0)), 4).alias("coverage"))
