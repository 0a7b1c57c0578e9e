"""Benchmarks of indexing and gating over growing synthetic catalogs."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.operators.analysis import Analyzer, catalog_text
from lexiloom.operators.config import Prescription
from lexiloom.operators.evaluation import run_gate
from lexiloom.operators.index import Engine
from lexiloom.sources.synthetic import synthesize_catalog


@dataclass(frozen=True)
class ScalePoint:
    n_docs: int
    index_seconds: float
    gate_seconds: float
    good_accepted: bool
    broad_accepted: bool
    regressions: int
    probe_df: int


def token_df(engine: Engine, token: str) -> int:
    row = engine.index.doc_freq().where(F.col("term") == token).first()
    return row.df if row else 0


def measure(engine: Engine, queries: DataFrame, qrels: DataFrame, good: Prescription, broad: Prescription, probe: str) -> ScalePoint:
    t = time.perf_counter()
    n = engine.docs.count()
    engine.index.postings.write.format("noop").mode("overwrite").save()
    indexed = time.perf_counter()
    accepted, _ = run_gate(engine, queries, qrels, good)
    gated = time.perf_counter()
    rejected, _ = run_gate(engine, queries, qrels, broad)
    return ScalePoint(n, round(indexed - t, 3), round(gated - indexed, 3), accepted.accepted, rejected.accepted, rejected.n_regressions, token_df(engine, probe))


def run_scale(spark: SparkSession, original: DataFrame, sizes: list[int], queries: DataFrame, qrels: DataFrame, good: Prescription, broad: Prescription, probe: str, analyzer: Analyzer | None = None) -> list[ScalePoint]:
    """A point for each number of synthetic documents added to the original ones."""
    points = []
    for n in sizes:
        docs = synthesize_catalog(spark, n, original=original) if n else original
        points.append(measure(Engine(catalog_text(docs).select("doc_id", "text"), analyzer or Analyzer()), queries, qrels, good, broad, probe))
    return points


def verdict_holds(points: list[ScalePoint]) -> bool:
    return all(p.good_accepted and not p.broad_accepted for p in points)


def cost(points: list[ScalePoint]) -> dict | None:
    """How time grows against documents, and seconds a million documents; None with fewer than two points of 1000 documents or more."""
    large = sorted((p for p in points if p.n_docs >= 1000), key=lambda p: p.n_docs)
    if len(large) < 2:
        return None
    a, b = large[0], large[-1]
    return {"docs_ratio": round(b.n_docs / a.n_docs, 2), "time_ratio": round(b.gate_seconds / max(a.gate_seconds, 1e-3), 2), "seconds_per_million": round(b.gate_seconds / b.n_docs * 1e6, 1)}
