"""Many strings looked for at once, in all texts: by an automaton over bounded groups of patterns, or by an index of letter runs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lexiloom.functions.text import compact, let
from lexiloom.sources.shared import written

#: Characters of the patterns that one automaton holds at most, a single longer pattern aside.
GROUP = 2_000_000
#: Letters from which on a pattern is in the automaton.
BRIEF = 3
#: Letters of an indexed run, and how many of a needle's rarest runs are intersected.
RUN, RAREST = 3, 3


def holding(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """key, doc_id of each text that contains a pattern, for texts(doc_id, text) and patterns(key, pattern), a stated set.

    The patterns are dealt into groups of GROUP characters about; the texts pass through one automaton a group, in Arrow
    batches, so the work grows with texts times groups, not with texts times patterns. Null texts and patterns match
    nothing, an empty pattern every text.
    """
    known = written(patterns.where("pattern is not null").select("key", "pattern").distinct(), "patterns")
    size = known.agg(F.coalesce(F.sum(F.char_length("pattern")), F.lit(0))).first()[0]
    groups = int(size // GROUP + 1)
    schema = StructType([known.schema["key"], texts.schema["doc_id"]])
    out = None
    for g in range(groups):
        part = known.where(F.pmod(F.xxhash64("pattern"), F.lit(groups)) == g).toArrow()  # GROUP characters about
        shipped = texts.sparkSession.sparkContext.broadcast((part["key"].combine_chunks(), part["pattern"].to_pylist()))
        found = texts.where("text is not null").select("doc_id", "text").mapInArrow(_scan(shipped, schema), schema)
        out = found if out is None else out.unionByName(found)
    return out


def _scan(shipped, schema: StructType) -> Callable:
    wanted = to_arrow_schema(schema)

    def run(batches):
        import ahocorasick

        keys, patterns = shipped.value
        at: dict[str, list[int]] = {}
        for i, p in enumerate(patterns):
            at.setdefault(p, []).append(i)
        always = at.pop("", [])
        automaton = ahocorasick.Automaton()
        brief = {p: at.pop(p) for p in list(at) if len(p) < BRIEF}  # in most texts at many places: a search ends at the first
        for p, rows in at.items():
            automaton.add_word(p, rows)
        automaton.make_automaton()
        for batch in batches:
            docs, hits = [], []
            for n, text in enumerate(batch.column(1)):
                found, plain = set(always), text.as_py()
                for p, rows in brief.items():
                    if p in plain:
                        found.update(rows)
                if at:
                    for _, rows in automaton.iter(plain):
                        found.update(rows)
                docs += [n] * len(found)
                hits += sorted(found)
            yield pa.RecordBatch.from_arrays([pa.array(keys.take(pa.array(hits, pa.int64())), wanted.field(0).type), batch.column(0).take(pa.array(docs, pa.int64()))], schema=wanted)

    return run


@dataclass(frozen=True)
class Scan:
    """docs(doc_id, text) whose texts are read for each stated set of needles; nothing is built or shuffled."""

    docs: DataFrame

    def grep(self, needles: DataFrame) -> DataFrame:
        """key, doc_id of the texts that hold a needle, spaces and case aside, for needles(key, needle); empty needles are in none."""
        plain = needles.select("key", compact("needle").alias("pattern")).where("pattern <> ''")
        return holding(self.docs.select("doc_id", compact("text").alias("text")), plain)


def runs(plain: Column, n: int) -> Column:
    """The distinct runs of n letters of a text."""
    letters = F.filter(F.split(plain, ""), lambda c: c != "")
    joined = let(letters, lambda every: F.transform(F.slice(every, n, F.greatest(F.size(every) - n + 1, F.lit(0))), lambda c, i: F.concat(*(F.get(every, i + k) for k in range(n - 1)), c)))
    return F.array_distinct(joined)


@dataclass(frozen=True)
class SubstringIndex:
    """postings(run, doc_id) of the runs of up to RUN letters in compacted texts, and frequencies(run, df); docs(doc_id, text), whose doc_id is a key."""

    docs: DataFrame
    postings: DataFrame
    frequencies: DataFrame

    @classmethod
    def of(cls, docs: DataFrame, keep: Callable[[str, Callable[[], DataFrame]], DataFrame] | None = None) -> SubstringIndex:
        keep = keep or (lambda name, make: written(make(), name))

        def made() -> DataFrame:
            plain = docs.select("doc_id", compact("text").alias("plain"))
            return plain.select("doc_id", F.explode(F.concat(*(runs(F.col("plain"), n) for n in range(1, RUN + 1)))).alias("run")).repartition("run", F.pmod(F.xxhash64("doc_id"), F.lit(8))).sortWithinPartitions("run")

        postings = keep("substrings", made)
        return cls(docs, postings, keep("substring-frequencies", lambda: postings.groupBy("run").agg(F.count(F.lit(1)).alias("df"))))

    def grep(self, needles: DataFrame) -> DataFrame:
        """key, doc_id of the texts that hold a needle, spaces and case aside, for needles(key, needle); empty needles are in none.

        A needle's rarest runs are intersected; only the texts that hold all of them are read and compared.
        """
        plain = written(needles.select("key", compact("needle").alias("plain")).where("plain <> ''"), "needles")
        size = F.char_length("plain")
        parts = F.when(size == 1, runs(F.col("plain"), 1)).when(size == 2, runs(F.col("plain"), 2)).otherwise(runs(F.col("plain"), RUN))
        asked = plain.select("key", "plain", F.explode(parts).alias("run")).join(self.frequencies, "run", "left")
        chosen = asked.withColumn("place", F.row_number().over(Window.partitionBy("key", "plain").orderBy(F.coalesce("df", F.lit(0)), "run"))).where(F.col("place") <= RAREST)
        wanted = chosen.groupBy("key", "plain").agg(F.count(F.lit(1)).alias("n"))
        both = self.postings.join(chosen.select("key", "plain", "run"), "run").groupBy("key", "plain", "doc_id").agg(F.count(F.lit(1)).alias("n"))
        near = both.join(wanted, ["key", "plain", "n"])
        texts = self.docs.select("doc_id", compact("text").alias("text"))
        return near.join(texts, "doc_id").where(F.contains("text", F.col("plain"))).select("key", "doc_id")
