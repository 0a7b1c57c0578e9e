"""A small catalog, evaluation set and knowledge base of our own, and readers for others in the same form."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom import schemas

#: Where the files that come with the library are.
SAMPLES = Path(__file__).resolve().parent.parent / "samples"


def _rows(path: Path | str) -> list[dict]:
    return json.loads(Path(path).read_text(encoding="utf-8"))


def load_catalog(spark: SparkSession, path: Path | str = SAMPLES / "catalog.json") -> DataFrame:
    """doc_id, name, description, category of a JSON list; catalogs of any size belong in Parquet."""
    return spark.createDataFrame([(r["doc_id"], r["name"], r.get("description"), r.get("category")) for r in _rows(path)], schemas.CATALOG)


def load_evalset(spark: SparkSession, path: Path | str = SAMPLES / "evalset.json") -> tuple[DataFrame, DataFrame]:
    """queries(query, family, expected_patch_kinds, note) and qrels(query, doc_id, grade) of a JSON list; a query that stands twice is an error."""
    rows = _rows(path)
    if len({r["query"] for r in rows}) < len(rows):
        raise ValueError(f"a query stands twice in {path}")
    if wrong := sorted({r["family"] for r in rows if r.get("family")} - set(schemas.FAMILIES)):
        raise ValueError(f"unknown families in {path}: {', '.join(wrong)}")
    queries = spark.createDataFrame([(r["query"], r.get("family"), r.get("expected_patch_kinds") or [], r.get("note")) for r in rows], schemas.EVAL_QUERIES)
    return queries, spark.createDataFrame([(r["query"], str(d), int(g)) for r in rows for d, g in r["qrels"].items()], schemas.QRELS)


def healthy_queries(queries: DataFrame) -> DataFrame:
    """Those that the plain configuration answers well; a patch must not harm them."""
    return queries.where("family is null")


def failing_queries(queries: DataFrame) -> DataFrame:
    return queries.where("family is not null")


def load_knowledge(spark: SparkSession, path: Path | str = SAMPLES / "knowledge.json") -> DataFrame:
    """doc_id, title, body, source, families of a JSON list."""
    return spark.createDataFrame([(r["doc_id"], r["title"], r["body"], r.get("source"), r.get("families") or []) for r in _rows(path)], schemas.KNOWLEDGE)


def families_covered(knowledge: DataFrame) -> DataFrame:
    """family, n_docs: the families that some row of a knowledge base is about."""
    return knowledge.select(F.explode(F.array_distinct("families")).alias("family")).groupBy("family").agg(F.count(F.lit(1)).alias("n_docs"))
