"""A search-relevance engine on Spark DataFrames: analysis, BM25, graded evaluation, gated configuration patches, retrieval, log mining."""

__version__ = "0.1.0"
