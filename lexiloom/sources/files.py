"""Small JSON and Markdown files: vector caches, baselines, ledgers."""

from __future__ import annotations

import json
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom import schemas
from lexiloom.functions.vectors import rounded


def load_vectors(spark: SparkSession, path: str) -> DataFrame:
    """token, vec from a JSON object {model, dim, vectors: {token: [...]}} on any storage that Spark reads."""
    one = spark.read.schema("model string, dim int, vectors map<string,array<double>>").option("multiLine", True).json(path)
    return one.select(F.explode("vectors").alias("token", "vec"))


def load_vectors_if_there(spark: SparkSession, path: str) -> DataFrame | None:
    """The cache, or None with a warning: what needs it then degrades visibly."""
    try:
        return load_vectors(spark, path)
    except Exception as e:  # noqa: BLE001  Spark's own error class for an absent path
        if "PATH_NOT_FOUND" not in str(e):
            raise
        import warnings

        warnings.warn(f"no vectors at {path}: retrieval by meaning is off", stacklevel=2)
        return None


def save_vectors(vectors: DataFrame, path: str, model: str) -> None:
    """The cache as one JSON file on the driver: sorted tokens, five decimals, no blanks. For vocabularies that fit; larger ones belong in Parquet."""
    rows = vectors.select("token", rounded("vec").alias("vec")).orderBy("token").toLocalIterator()
    table = {r.token: r.vec for r in rows}
    Path(path).write_text(json.dumps({"model": model, "dim": len(next(iter(table.values()), [])), "vectors": table}, ensure_ascii=False, separators=(",", ":"), sort_keys=True))


def build_vectors(tokens: DataFrame, embed) -> DataFrame:
    """token, vec of the distinct tokens: embed() gives a model on a worker, which maps lists of tokens to vectors, in Arrow batches."""

    def run(batches):
        model = embed()
        for tokens in batches:
            yield pd.Series([list(map(float, v)) for v in model(tokens.tolist())])

    vec = F.pandas_udf(run, "array<double>", F.PandasUDFType.SCALAR_ITER)
    return tokens.select("token").distinct().select("token", vec("token").alias("vec"))


def write_baseline(measured: DataFrame, path: str, epsilon: float = 0.02) -> None:
    """{epsilon, mean_ndcg, queries: {query: metrics}}: a row for each query of an evaluation set, which a person writes, so it fits the driver."""
    rows = {r.query: {"ndcg": r.ndcg, "recall": r.recall, "precision5": r.precision5, "n_results": r.n_results} for r in measured.orderBy("query").collect()}
    mean = round(sum(r["ndcg"] for r in rows.values()) / len(rows), 4) if rows else 0.0
    Path(path).write_text(json.dumps({"epsilon": epsilon, "mean_ndcg": mean, "queries": rows}, ensure_ascii=False, indent=2))


def load_baseline(spark: SparkSession, path: str) -> tuple[DataFrame, float]:
    """The metrics by query, and epsilon."""
    d = json.loads(Path(path).read_text())
    rows = [(q, m.get("ndcg"), m.get("recall"), m.get("precision5"), m.get("n_results")) for q, m in d["queries"].items()]
    return spark.createDataFrame(rows, schemas.METRICS), d["epsilon"]


def ledger(spark: SparkSession, accepted: list[dict]) -> DataFrame:
    """Numbered entries of accepted patches with their evidence: each has patch (a Prescription), verdict and attempts."""
    rows = [
        (i, a["patch"].target_query, a["patch"].diagnosis_family, a["patch"].summary(), a["patch"].reasoning, ([v.target_before, v.target_after], [v.results_before, v.results_after], [v.mean_before, v.mean_after]), a["attempts"])
        for i, a in enumerate(accepted, 1) for v in [a["verdict"]]
    ]
    return spark.createDataFrame(rows, schemas.LEDGER)


def ledger_json(entries: DataFrame) -> str:
    return json.dumps([json.loads(x) for x in entries.orderBy("no").toJSON().collect()], ensure_ascii=False, indent=2)


def ledger_markdown(entries: DataFrame) -> str:
    lines = ["| # | query | family | patch | nDCG | results | attempts |", "|-|-|-|-|-|-|-|"]
    for r in entries.orderBy("no").collect():
        e = r.evidence
        lines.append(f"| {r.no} | {r.target_query} | {r.diagnosis_family} | {r.patch} | {e.target_ndcg[0]:.4f} to {e.target_ndcg[1]:.4f} | {e.target_results[0]} to {e.target_results[1]} | {r.attempts} |")
    return "\n".join(lines)
