"""A training corpus from documents: five stages, each on all that its predecessor kept.

Between stages the documents are written as Parquet and read again. A stage returns the columns of documents; the last
one returns the packed sequences. Stages drop no document without cause: the first drops what the classifier rejects,
the third all rows but one of each group of near copies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm import line_dedup, near_dedup, pii, quality, queries
from lexiloom.llm.common import stored


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from the labels of sf_dir that aren't held out."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep(docs, model)


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of many sources are taken out, but for their first occurrence; n_chars follows the text."""
    return line_dedup.dedup_lines(docs).select(*docs.columns).withColumn("n_chars", F.length("text").cast("long"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies one row stays, of the document with the least id; repeated rows are copies too."""
    return near_dedup.keep_one(docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked by its kind; n_chars follows the text."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their sequences, as op6_best_fit_packing returns them."""
    return queries.packed(docs)


STAGES = [("quality classifier", good_quality), ("line dedup", without_boilerplate), ("near dedup", one_of_each), ("personal data", without_personal_data), ("packing", packed_sequences)]
#: SQL can express neither the classifier nor the sketches, the spans or the packing; tests compare run() with a plain version in Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
