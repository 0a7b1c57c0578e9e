"""Line dedup by distinct-site spread (operator 4), in DataFrame functions only.

A HyperLogLog sketch of the sites of each line hash is merged by aggregation. A line whose estimate is clearly at or
above the threshold is boilerplate, one clearly below isn't, and lines near the threshold get an exact distinct count.
Of a boilerplate line the first occurrence stays; all others go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.common import stored

#: Sites from which on a line is boilerplate.
SITES = 10
#: log2 of a sketch's registers; its standard error is about 1.04 / 2**(LOG_K / 2), 1.6 % here.
LOG_K = 12
#: Estimates within this share of the threshold (and at least 1) count exactly.
MARGIN = 0.08
BLANK = r"\A[\x20\x09-\x0D]*\z"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def spread_lines(docs: DataFrame, site_col: str = "source", text_col: str = "text", id_col: str = "doc_id", sites: int = SITES) -> tuple[DataFrame, DataFrame]:
    """All non-blank lines (id, x, at, h1, h2) and the boilerplate among them (h1, h2, first: id, x and at of the occurrence that stays).

    Two 64-bit hashes name a line; x is a hash of the row's text. A null site counts as one site of its own.
    """
    # The text's hash is taken below the explosion, which would else take it for each line.
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(site_col).cast("string"), F.lit("\x00")).alias("site"), F.col(text_col).alias("t"), F.xxhash64(text_col).alias("x"))
    lines = rows.select("id", "site", "x", F.posexplode(_lines(F.col("t"))).alias("at", "line")).where(~F.col("line").rlike(BLANK))
    lines = lines.select("id", "site", "x", "at", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("line"), F.col("line")).alias("h2"))
    spread = lines.groupBy("h1", "h2").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LOG_K))).alias("about"), F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "x", "at")).alias("first"))
    margin = max(1.0, MARGIN * sites)
    possible = spread.where((F.col("n") >= sites) & (F.col("about") >= sites - margin))
    possible = stored(possible, "spread")  # lines of many sites only
    sure = possible.where(F.col("about") > sites + margin).select("h1", "h2", "first")
    near = possible.where(F.col("about") <= sites + margin).select("h1", "h2", "first")
    exact = lines.join(near.select("h1", "h2"), ["h1", "h2"]).groupBy("h1", "h2", "site").agg(F.lit(1).alias("one")).groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("exact")).where(F.col("exact") >= sites)
    return lines.select("id", "x", "at", "h1", "h2"), sure.unionByName(near.join(exact.select("h1", "h2"), ["h1", "h2"]))


def dedup_lines(docs: DataFrame, site_col: str = "source", text_col: str = "text", id_col: str = "doc_id", sites: int = SITES) -> DataFrame:
    """docs with boilerplate lines taken out of its text, and __lines (non-blank lines before) and __removed; all rows and other columns stay.

    Lines are what stands between line feeds, compared as they are; blank lines never count as boilerplate. Null texts
    stay null with no lines. Rows that repeat (same id and text) are treated alike: a line stays in all or in none of
    them. Of equal first occurrences by id the one with the least text hash stays. An empty table stays empty.
    """
    lines, boilerplate = spread_lines(docs, site_col, text_col, id_col, sites)
    gone = lines.join(boilerplate, ["h1", "h2"]).where(~F.struct("id", "x", "at").eqNullSafe(F.col("first")))
    gone = gone.groupBy(F.col("id").alias("__id"), F.col("x").alias("__x")).agg(F.collect_set("at").alias("__at"))
    rows = docs.select(F.struct(*docs.columns).alias("__row"), F.col(id_col).alias("__key"), F.xxhash64(F.col(text_col)).alias("__hash"))
    rows = rows.join(gone, F.col("__key").eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__x")), "left")
    parts = _lines(F.col("__row")[text_col])
    # array_except hashes the places, so this is linear in the lines; the lines are bound to a name, to be split once.
    staying = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), "__at")
    joined = F.element_at(F.transform(F.array(parts), lambda lines: F.array_join(F.transform(staying, lambda i: F.get(lines, i)), "\n")), 1)
    kept = F.when(F.col("__at").isNull(), F.col("__row")[text_col]).otherwise(joined)
    return rows.select(
        *((kept if c == text_col else F.col("__row")[c]).alias(c) for c in docs.columns),
        F.coalesce(F.size(F.filter(parts, lambda line: ~line.rlike(BLANK))), F.lit(0)).cast("long").alias("__lines"),
        F.coalesce(F.size("__at"), F.lit(0)).cast("long").alias("__removed"),
    )
