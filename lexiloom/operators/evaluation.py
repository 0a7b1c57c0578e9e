"""Graded evaluation, quality baselines and the regression gate, each as one job over all queries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions.relevance import bm25_term, exact_sum, gain, idf
from lexiloom.operators.config import Prescription
from lexiloom.operators.index import TOP_K, Engine, shipped
from lexiloom.sources.shared import written

METRICS = ("ndcg", "recall", "precision5")
MIN_GAIN, EPSILON = 0.05, 0.02
#: Regressions that a verdict lists; it counts all.
SHOWN = 1000


def metrics(queries: DataFrame, hits: DataFrame, qrels: DataFrame, k: int = TOP_K, by: tuple[str, ...] = ()) -> DataFrame:
    """query, ndcg, recall, precision5, n_results, hits_top: rounded to 4 decimals; a row for each query, without hits too.

    hits(query, doc_id, rank), qrels(query, doc_id, grade). precision5 divides by the hits among the first five. `by`
    names further columns of queries and hits, such as the patch under which a query was asked.
    """
    graded = hits.where(F.col("rank") <= k).join(qrels, ["query", "doc_id"], "left").withColumn("grade", F.coalesce("grade", F.lit(0)))
    relevant = (F.col("grade") > 0).cast("long")
    found = graded.groupBy(*by, "query").agg(
        F.sum(gain(F.col("grade"), F.col("rank"))).alias("dcg"), F.sum(relevant).alias("found"), F.sum(F.when(F.col("rank") <= 5, relevant)).alias("found5"), F.count(F.when(F.col("rank") <= 5, 1)).alias("top5"), F.count(F.lit(1)).alias("n_results"),
        F.transform(F.sort_array(F.collect_list(F.when(F.col("rank") <= 5, F.struct("rank", "doc_id")))), lambda s: s["doc_id"]).alias("hits_top"),
    )
    best = qrels.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("grade"), "doc_id")))
    ideal = best.groupBy("query").agg(F.sum(F.when(F.col("place") <= k, gain(F.col("grade"), F.col("place")))).alias("ideal"), F.count(F.when(F.col("grade") > 0, 1)).alias("wanted"))
    rows = queries.select(*by, "query").distinct().join(found, [*by, "query"], "left").join(ideal, "query", "left")

    def ratio(a: str, b: str, name: str):
        return F.round(F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0)), 4).alias(name)

    return rows.select(*by, "query", ratio("dcg", "ideal", "ndcg"), ratio("found", "wanted", "recall"), ratio("found5", "top5", "precision5"), F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"), F.coalesce("hits_top", F.array().cast(found.schema["hits_top"].dataType)).alias("hits_top"))


def evaluate(engine: Engine, queries: DataFrame, qrels: DataFrame, k: int = TOP_K) -> DataFrame:
    return metrics(queries, engine.search(queries.select("query").distinct(), k, terms=False, bounds=False), qrels, k)  # queries of a few words


def means(measured: DataFrame) -> DataFrame:
    """mean_ndcg, zero_result_rate, n_queries in one row; 0 without queries."""
    return measured.agg(F.round(F.coalesce(F.avg("ndcg"), F.lit(0.0)), 4).alias("mean_ndcg"), F.round(F.coalesce(F.avg((F.col("n_results") == 0).cast("int")), F.lit(0.0)), 4).alias("zero_result_rate"), F.count(F.lit(1)).alias("n_queries"))


def means_by_health(measured: DataFrame, queries: DataFrame) -> DataFrame:
    """segment (all, healthy, failing), mean_ndcg, zero_result_rate, n_queries; a query with a family is failing. One pass by grouping sets."""
    named = measured.join(queries.select("query", F.when(F.col("family").isNull(), "healthy").otherwise("failing").alias("segment")), "query")
    out = named.rollup("segment").agg(F.round(F.avg("ndcg"), 4).alias("mean_ndcg"), F.round(F.avg((F.col("n_results") == 0).cast("int")), 4).alias("zero_result_rate"), F.count(F.lit(1)).alias("n_queries"))
    return out.withColumn("segment", F.coalesce("segment", F.lit("all")))


def long_form(measured: DataFrame, value: str) -> DataFrame:
    """query, metric, value."""
    return measured.unpivot(["query"], list(METRICS), "metric", value)


def compare(before: DataFrame, after: DataFrame, epsilon: float = EPSILON) -> DataFrame:
    """query, metric, before, after, status: regression, improvement, same, missing (no longer measured), added, or unknown for a null value."""
    both = long_form(before, "before").withColumn("was", F.lit(True)).join(long_form(after, "after").withColumn("is", F.lit(True)), ["query", "metric"], "full_outer")
    status = (
        F.when(F.col("is").isNull(), "missing").when(F.col("was").isNull(), "added").when(F.col("before").isNull() | F.col("after").isNull(), "unknown")
        .when(F.col("after") < F.col("before") - epsilon, "regression").when(F.col("after") > F.col("before") + epsilon, "improvement").otherwise("same")
    )
    return both.select("query", "metric", "before", "after", status.alias("status"))


def baseline_ok(compared: DataFrame) -> DataFrame:
    """ok, regressions, improvements, missing, added in one row: only regressions and missing queries fail; queries count once."""
    def queries(status: str, name: str):
        return F.count_distinct(F.when(F.col("status") == status, F.col("query"))).alias(name)

    counts = compared.agg(F.count(F.when(F.col("status") == "regression", 1)).alias("regressions"), F.count(F.when(F.col("status") == "improvement", 1)).alias("improvements"), queries("missing", "missing"), queries("added", "added"))
    return counts.select(((F.col("regressions") == 0) & (F.col("missing") == 0)).alias("ok"), "*")


@dataclass(frozen=True)
class Verdict:
    accepted: bool
    reason: str
    target_before: float
    target_after: float
    results_before: int
    results_after: int
    mean_before: float
    mean_after: float
    regressions: tuple[tuple[str, str, float, float], ...]  # the first SHOWN, to be looked at
    n_regressions: int = 0  # all of them

    def feedback(self) -> str:
        """What a doctor is told: the verdict, and the first five regressions."""
        head = "accepted" if self.accepted else f"rejected: {self.reason}"
        lines = [f"{head} (target nDCG {self.target_before:.4f} to {self.target_after:.4f}, mean {self.mean_before:.4f} to {self.mean_after:.4f})"]
        lines += [f"- {q}: {m} {a:.4f} to {b:.4f}" for q, m, a, b in self.regressions[:5]]
        return "\n".join(lines)


def gate_table(before: DataFrame, after: DataFrame, target: str, min_gain: float = MIN_GAIN, epsilon: float = EPSILON, mean_epsilon: float | None = None) -> DataFrame:
    """The verdict as one row, from both measurements: accepted, reason, target_*, results_*, mean_*, n_regressions, regressed_queries.

    Checks in this order: the target gains enough, no other query's metric drops by more than epsilon, the mean doesn't.
    """
    both = before.alias("b").join(after.alias("a"), "query")
    hit = F.col("query") == target
    drops = sum(((~hit & (F.col(f"a.{m}") < F.col(f"b.{m}") - epsilon)).cast("int") for m in METRICS), F.lit(0))
    row = both.agg(
        F.max(F.when(hit, F.col("b.ndcg"))).alias("target_before"), F.max(F.when(hit, F.col("a.ndcg"))).alias("target_after"), F.max(F.when(hit, F.col("b.n_results"))).alias("results_before"), F.max(F.when(hit, F.col("a.n_results"))).alias("results_after"),
        F.round(F.avg("b.ndcg"), 4).alias("mean_before"), F.round(F.avg("a.ndcg"), 4).alias("mean_after"), F.coalesce(F.sum(drops), F.lit(0)).cast("long").alias("n_regressions"), F.count(F.when(drops > 0, 1)).alias("regressed_queries"),
    )
    reason = _reason(min_gain, epsilon if mean_epsilon is None else mean_epsilon)
    return row.select((reason == "").alias("accepted"), reason.alias("reason"), "*")


def _reason(min_gain: float, mean_epsilon: float) -> Column:
    return (
        F.when(F.col("target_after") < F.col("target_before") + min_gain, "target not improved").when(F.col("n_regressions") > 0, "regressions")
        .when(F.col("mean_after") < F.col("mean_before") - mean_epsilon, "mean dropped").otherwise("")
    )


def gate_many(engine: Engine, queries: DataFrame, qrels: DataFrame, patches: DataFrame, before: DataFrame, min_gain: float = MIN_GAIN, epsilon: float = EPSILON, mean_epsilon: float | None = None) -> DataFrame:
    """The gate's verdict on each of patches(patch_id, target, synonyms), all in one job; synonyms lists a group, its canonical form first.

    Each patch is judged by itself against `before`, the measurement of the engine as it is. A synonym moves postings
    from form to form and changes no document's length, so a patch's index is the stored one and a delta: the merged
    postings of its group, keyed by patch. Only queries that hold one of its forms can change; they alone are asked
    again, each under its patch, and all others keep their measurement. patch_id, accepted, reason and the columns of
    gate_table() come out, a row for each patch whose target is in the evaluation set.
    """
    per = 10_000  # measurements have four decimals: as integers their sums are exact
    groups, after = measured_many(engine, queries, qrels, patches)
    both = written(after.join(before.select("query", *(F.col(m).alias(f"was_{m}") for m in (*METRICS, "n_results"))), "query"), "both")
    targets = groups.select("patch_id", "target").distinct()
    hit = F.col("query") == F.col("target")
    drops = sum(((~hit & (F.col(m) < F.col(f"was_{m}") - epsilon)).cast("int") for m in METRICS), F.lit(0))
    moved = both.join(targets, "patch_id").groupBy("patch_id").agg(
        F.max(F.when(hit, F.col("ndcg"))).alias("now"), F.max(F.when(hit, F.col("n_results"))).alias("found"), F.sum(F.round((F.col("ndcg") - F.col("was_ndcg")) * per).cast("long")).alias("shift"),
        F.sum(drops).cast("long").alias("n_regressions"), F.count(F.when(drops > 0, 1)).alias("regressed_queries"),
    )
    total = before.agg(F.sum(F.round(F.col("ndcg") * per).cast("long")).alias("sum"), F.count(F.lit(1)).alias("n_queries"))
    rows = targets.join(before.select(F.col("query").alias("target"), F.col("ndcg").alias("target_before"), F.col("n_results").alias("results_before")), "target").join(moved, "patch_id", "left").crossJoin(F.broadcast(total))  # one row
    table = rows.select(
        "patch_id", "target_before", F.coalesce("now", "target_before").alias("target_after"), "results_before", F.coalesce("found", "results_before").alias("results_after"),
        F.round(F.col("sum") / per / F.col("n_queries"), 4).alias("mean_before"), F.round((F.col("sum") + F.coalesce("shift", F.lit(0))) / per / F.col("n_queries"), 4).alias("mean_after"),
        F.coalesce("n_regressions", F.lit(0)).alias("n_regressions"), F.coalesce("regressed_queries", F.lit(0)).alias("regressed_queries"),
    )
    reason = _reason(min_gain, epsilon if mean_epsilon is None else mean_epsilon)
    return table.select("patch_id", (reason == "").alias("accepted"), reason.alias("reason"), *table.columns[1:])


def measured_many(engine: Engine, queries: DataFrame, qrels: DataFrame, patches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """groups(patch_id, target, to, term) of the patches' forms, and patch_id with metrics() of the queries that each patch can change, under it."""
    index = engine.index
    groups = written(patches.select("patch_id", "target", F.lower(F.get("synonyms", F.lit(0))).alias("to"), F.explode(F.transform("synonyms", F.lower)).alias("term")).distinct(), "groups")  # the stated patches
    forms = groups.select("patch_id", "term", "to")
    tokens = engine.tokenized(queries.select("query").distinct()).select("query", F.explode("tokens").alias("term")).distinct()
    changed = tokens.join(forms, "term").select("patch_id", "query").distinct()
    asked = written(changed.join(tokens, "query").join(forms, ["patch_id", "term"], "left").select("patch_id", "query", F.coalesce("to", "term").alias("term"), F.col("to").isNotNull().alias("merged")).distinct(), "asked")
    merged = index.postings.join(shipped(forms), "term").groupBy("patch_id", F.col("to").alias("term"), "doc_id").agg(F.sum("tf").alias("tf"), F.first("dl").alias("dl"))
    merged = written(merged, "merged")
    delta = merged.join(merged.groupBy("patch_id", "term").agg(F.count(F.lit(1)).alias("df")), ["patch_id", "term"]).join(asked.where("merged"), ["patch_id", "term"])
    plain = asked.where("not merged")
    base = index.postings.join(shipped(written(plain.join(index.doc_freq_of(plain.select("term").distinct()), "term"), "plain")), "term")
    names = ("patch_id", "query", "doc_id", "tf", "dl", "df")
    parts = base.select(*names).unionByName(delta.select(*names)).crossJoin(F.broadcast(index.stats))  # one row of stats
    part = bm25_term(idf(F.col("n"), F.col("df")), F.col("tf"), F.col("dl"), F.col("avgdl"), index.k1, index.b)
    scored = parts.groupBy("patch_id", "query", "doc_id").agg(exact_sum(part).alias("score"))
    hits = scored.withColumn("rank", F.row_number().over(Window.partitionBy("patch_id", "query").orderBy(F.desc("score"), "doc_id"))).where(F.col("rank") <= TOP_K)
    after = metrics(changed, hits, qrels, by=("patch_id",))
    return groups, after


def regressions(before: DataFrame, after: DataFrame, target: str, epsilon: float = EPSILON) -> DataFrame:
    """query, metric, before, after of each drop by more than epsilon, the target aside."""
    return compare(before, after, epsilon).where((F.col("status") == "regression") & (F.col("query") != target)).drop("status")


def run_gate(engine: Engine, queries: DataFrame, qrels: DataFrame, patch: Prescription, min_gain: float = MIN_GAIN, epsilon: float = EPSILON, mean_epsilon: float | None = None, before: DataFrame | None = None) -> tuple[Verdict, Engine]:
    """The verdict on a patch and the sandbox engine under it; the given engine stays as it is.

    `before` may hold the current measurement, so that a loop of patches measures it once. Both measurements are small
    (a row per query) and are cached while they are compared.
    """
    if queries.where(F.col("query") == patch.target_query).isEmpty():
        raise LookupError(f"not in the evaluation set: {patch.target_query!r}")
    sandbox = engine.with_config(patch.apply_to(engine.analyzer.config))
    now = (before if before is not None else evaluate(engine, queries, qrels)).cache()
    then = evaluate(sandbox, queries, qrels).cache()
    try:
        r = gate_table(now, then, patch.target_query, min_gain, epsilon, mean_epsilon).first()
        lost = [] if r.accepted else regressions(now, then, patch.target_query, epsilon).orderBy("query", "metric").limit(SHOWN).collect()
    finally:
        then.unpersist()
        if before is None:
            now.unpersist()
    reason = {"target not improved": f"target nDCG {r.target_before} to {r.target_after}, {min_gain} more needed", "regressions": f"{r.regressed_queries} other queries get worse", "mean dropped": "the mean drops"}.get(r.reason, "")
    return Verdict(r.accepted, reason, r.target_before, r.target_after, r.results_before, r.results_after, r.mean_before, r.mean_after, tuple(tuple(x) for x in lost), r.n_regressions), sandbox
