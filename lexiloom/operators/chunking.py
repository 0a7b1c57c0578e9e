"""Boundary-aware chunks of documents: Markdown sections, paragraphs, sentences, fixed cuts, with overlap."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from lexiloom.functions import splitting

SIZE, OVERLAP = 400, 80
#: Characters of chunks in a batch that a task passes on, about.
BATCH = 4 << 20


def chunk_documents(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP, paragraph: str = "\n\n", text_col: str = "text") -> DataFrame:
    """doc_id, chunk_id ({doc}#{n}), n (from 0 over the document), heading, text of each chunk; no shuffle.

    A text that isn't empty gives a chunk at least; null texts give none. Pieces with overlap may be longer than `size`.
    """
    schema = StructType([docs.schema["doc_id"], StructField("n", IntegerType()), StructField("heading", StringType()), StructField("text", StringType())])
    wanted = to_arrow_schema(schema)

    def run(batches):
        at, ns, headings, texts, held = [], [], [], [], 0

        def batch_of(ids: pa.Array) -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int64())), pa.array(ns, pa.int32()), pa.array(headings, pa.string()), pa.array(texts, pa.string())], schema=wanted)
            for column in (at, ns, headings, texts):
                column.clear()
            return out

        for batch in batches:
            for i, text in enumerate(batch.column(1)):
                for n, (heading, piece) in enumerate(splitting.chunks(text.as_py() or "", size, overlap, paragraph)):
                    at.append(i)
                    ns.append(n)
                    headings.append(heading)
                    texts.append(piece)
                    held += len(piece)
                    if held >= BATCH:
                        yield batch_of(batch.column(0))
                        held = 0
            if at:
                yield batch_of(batch.column(0))
                held = 0

    out = docs.select("doc_id", F.col(text_col).alias("text")).mapInArrow(run, schema)
    return out.select("doc_id", F.concat_ws("#", F.col("doc_id").cast("string"), F.col("n").cast("string")).alias("chunk_id"), "n", "heading", "text")


def chunk_knowledge(knowledge: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Chunks of knowledge(doc_id, title, body); the document's title stands in for an empty heading, and display is heading and text."""
    chunks = chunk_documents(knowledge, size, overlap, text_col="body").join(knowledge.select("doc_id", "title"), "doc_id")
    heading = F.coalesce(F.nullif("heading", F.lit("")), F.col("title"))
    return chunks.select("doc_id", "chunk_id", "n", heading.alias("heading"), "text", F.concat_ws("\n", heading, "text").alias("display"))
