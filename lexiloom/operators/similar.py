"""Similar tokens by spelling and by meaning, and the rules that turn them into patch candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions.jamo import similarity_of, to_jamo
from lexiloom.functions.text import has_latin
from lexiloom.functions.vectors import cosine, unit
from lexiloom.operators.spelling import SpellingIndex
from lexiloom.operators.vector_index import VectorIndex

# Thresholds of the rules.
JAMO_LEAST, VECTOR_LEAST, LENGTH_DIFFERENCE = 0.65, 0.60, 2


def similar_tokens(probes: DataFrame, vocabulary: DataFrame | SpellingIndex, k: int = 8, vectors: DataFrame | None = None, index: VectorIndex | None = None) -> DataFrame:
    """probe, token, similarity (jamo, 3 decimals), vector_similarity (null if unknown), position (from 1).

    The k best by spelling and the k best by meaning, k to 2k rows a probe; ordered by the larger of both, then token.
    The probes are a stated query set; both kinds of neighbours come from indexes, which are built where only the
    vocabulary(term) or the vectors(token, vec) are given. `index` must hold tokens of the vocabulary only.
    """
    p = probes.select(F.col("term").alias("probe")).where("probe is not null").distinct()
    best = (vocabulary if isinstance(vocabulary, SpellingIndex) else SpellingIndex.of(vocabulary)).most_alike(p, k)
    if vectors is None:
        best = best.select("probe", "token", "similarity", F.lit(None).cast("double").alias("vector_similarity"))
    else:
        if index is None:
            tokens = vocabulary.tokens.select("token") if isinstance(vocabulary, SpellingIndex) else vocabulary.select(F.col("term").alias("token"))
            index = VectorIndex.of(vectors.join(tokens, "token", "left_semi"))
        asked = p.join(vectors.select(F.col("token").alias("probe"), unit("vec").alias("u")), "probe").select(F.col("probe").alias("query"), "u")
        vec = vectors.select(F.col("token").alias("probe"), F.col("vec").alias("__pv")), vectors.select("token", F.col("vec").alias("__tv"))
        meaning = F.round(cosine("__pv", "__tv"), 3).alias("vector_similarity")
        meant = index.most_similar(asked, k, 3).select(F.col("query").alias("probe"), F.col("other").alias("token"))
        both = best.select("probe", "token", "similarity").unionByName(meant.withColumn("similarity", F.lit(None).cast("double")))
        pairs = both.groupBy("probe", "token").agg(F.max("similarity").alias("similarity"))
        spelling = F.coalesce("similarity", F.round(similarity_of(to_jamo("probe"), to_jamo("token")), 3)).alias("similarity")
        best = pairs.join(vec[0], "probe", "left").join(vec[1], "token", "left").select("probe", "token", spelling, meaning)
    order = Window.partitionBy("probe").orderBy(F.desc(F.greatest("similarity", F.coalesce("vector_similarity", F.lit(0.0)))), "token")
    return best.withColumn("position", F.row_number().over(order))


def _first(df: DataFrame, *by: str) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy("query").orderBy(*by))).where("__n = 1").drop("__n")


def rule_variant(similar: DataFrame) -> DataFrame:
    """R1: the first token spelled almost like the probe becomes its canonical synonym. similar has query, probe too."""
    close = (F.col("similarity") >= JAMO_LEAST) & (F.abs(F.char_length("token") - F.char_length("probe")) <= LENGTH_DIFFERENCE) & (F.col("token") != F.col("probe"))
    return _first(similar.where(close), "position").select("query", F.lit("spelling_variant").alias("family"), F.array("token", "probe").alias("synonyms"))


def rule_compound(similar: DataFrame) -> DataFrame:
    """R2: the first longer token that ends, or else begins, with the probe is expanded into the probe and the rest."""
    longer = similar.where((F.char_length("probe") >= 2) & (F.char_length("token") > F.char_length("probe")))
    ends, begins = F.endswith("token", F.col("probe")), F.startswith("token", F.col("probe"))
    cut = F.char_length("token") - F.char_length("probe")
    parts = F.when(ends, F.array(F.substring("token", F.lit(1), cut), F.col("probe"))).otherwise(F.array(F.col("probe"), F.substring("token", F.char_length("probe") + 1, cut)))
    return _first(longer.where(ends | begins), "position").select("query", F.lit("compound_locked").alias("family"), F.col("token").alias("word"), parts.alias("parts"))


def rule_semantic(similar: DataFrame) -> DataFrame:
    """R3: the first token near in meaning but not in spelling becomes a synonym; the family is cross_script if just one side has Latin letters."""
    near = (F.col("vector_similarity") >= VECTOR_LEAST) & (F.col("similarity") < JAMO_LEAST)
    family = F.when(has_latin("probe") != has_latin("token"), "cross_script").otherwise("synonym_gap")
    return _first(similar.where(near), "position").select("query", family.alias("family"), F.array("token", "probe").alias("synonyms"))


def rule_garbage_split(similar: DataFrame, queries: DataFrame) -> DataFrame:
    """R4: a query whose tokens, two at least, are single characters becomes a user word and a synonym of the first token spelled like it; queries(query, tokens)."""
    garbage = queries.where((F.size("tokens") >= 2) & F.forall("tokens", lambda t: F.char_length(t) == 1)).select("query")
    found = rule_variant(similar.join(garbage, "query", "left_semi"))
    return found.select("query", F.lit("garbage_split").alias("family"), F.element_at("synonyms", 2).alias("user_word"), "synonyms")


def probe_of(queries: DataFrame) -> DataFrame:
    """queries(query, tokens) with probe: the first token of two characters or more if there are several tokens, else the query in lower case without spaces."""
    long = F.filter("tokens", lambda t: F.char_length(t) >= 2)
    plain = F.replace(F.lower("query"), F.lit(" "), F.lit(""))
    return queries.withColumn("probe", F.when(F.size("tokens") >= 2, F.coalesce(F.try_element_at(long, F.lit(1)), plain)).otherwise(plain))
