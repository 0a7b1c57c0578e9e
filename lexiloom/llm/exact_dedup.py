"""Exact dedup by skew-safe combining (operator 8).

Rows with equal normalised text form a group. Groups are combined in three steps, each of which groups by the whole
normalised text beside its digest, so that unequal texts with one digest never meet: a local partial aggregation in
the task that reads the rows, a merge of (digest, salt) groups, and a merge of the salts' winners. No step gathers a
group's rows: each keeps a minimum and a count. The last step also counts the contents of each digest. Where it found
one, the digest stands for a content that was compared in full, and rows go back to their group by digest and salt;
where it found several, they go back by their content.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.common import stored, whole_text

#: Parts of a digest's rows; a text that few rows share has no more winners than rows.
SALTS = 32
SPACE = r"[\x20\x09-\x0D]+"


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS, key_bytes: int = 32) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty; empty texts are equal to each other. A null id is larger than any other: it stays only
    if all ids of its group are null. Of repeated rows (same id and text) one is kept. Other columns are ignored. An
    empty table gives no rows. Rows meet by the first `key_bytes` of the digest; fewer than 32 give the same result.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.regexp_replace(whole_text(text_col), SPACE, " ").alias("norm"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("norm", 256))).withColumn("key", F.expr(f"substring(digest, 1, {int(key_bytes)})")).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
    salted = rows.groupBy("key", "salt", "norm").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("size"))
    contents = salted.repartition("key").groupBy("key", "norm").agg(F.min("keep_id").alias("keep_id"), F.sum("size").alias("group_size"), F.collect_set("salt").alias("salts"))
    found = contents.groupBy("key").agg(F.count(F.lit(1)).alias("contents"), *(F.first(c).alias(c) for c in ("keep_id", "group_size", "salts")))  # dealt by key already
    found = stored(found, "winners")
    one = found.where("contents = 1").select("key", F.explode("salts").alias("salt"), "keep_id", "group_size")
    # Repeated rows count once and are told apart again at the end.
    members = rows.groupBy("doc_id", "key", "salt", "digest").agg(F.count(F.lit(1)).alias("times"))
    joined = members.join(one, ["key", "salt"]).drop("key", "salt")
    several = found.where("contents > 1").select("key")
    if not several.isEmpty():
        some = rows.join(several, "key")
        winners = some.groupBy("key", "norm").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        members = some.groupBy("doc_id", "key", "digest", "norm").agg(F.count(F.lit(1)).alias("times"))
        joined = joined.unionByName(members.join(winners, ["key", "norm"]).drop("key", "norm"))
    copies = joined.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    return copies.select("doc_id", "keep_id", "group_size", ((F.col("nth") == 1) & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
