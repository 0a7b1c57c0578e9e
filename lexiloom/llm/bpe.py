"""Byte-level BPE in SQL (operator 3).

Python only splits texts by the tokenizer's pattern. The merges run in DuckDB, inside each task: a recursive query
unnests the tokens of every word to positions, joins adjacent pairs with the merge table, contracts each word's
leftmost pair of least rank, and goes on until no pair is in the table. An ordered aggregation over token positions
gives the bytes back, word by word. Long words are encoded in parts that are put together (common.stitched). Words already encoded in a worker are remembered, within a bound, so frequent words cost one lookup.
"""

from __future__ import annotations

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.common import PART, bpe_ranks, column, mapped, stitched, whole_text

#: Words that a worker remembers, with their ids and those ids' bytes, in each of two generations.
REMEMBERED = 400_000

ENCODE = """
with recursive state(w, ids) using key (w) as (
    select w, ids from words
    union
    select w, list_concat(list_append(ids[1:place - 1], rank), ids[place + 2:]) from (
        select p.w, any_value(p.ids) as ids, arg_min(p.i, (m.rank::bigint << 32) + p.i) as place, min(m.rank) as rank
        from (select w, ids, unnest(range(1, len(ids))) as i from state) p
        join merges m on m.pair = (p.ids[p.i]::bigint << 32) + p.ids[p.i + 1]
        group by p.w))
select w, ids from state order by w
"""
DECODE = """
select w, string_agg(v.bytes, '' order by p.i)
from (select w, unnest(ids) as id, generate_subscripts(ids, 1) as i from words) p join vocabulary v on v.id = p.id
group by w order by w
"""


class SqlBpe:
    """Encodes and decodes words by a rank file. Bytes stand in SQL as Latin-1 characters."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.first = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        pairs = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        left, right, rank = (np.array(x, np.int64) for x in zip(*pairs, strict=True)) if pairs else (np.zeros(0, np.int64),) * 3
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})
        self.db.register("given", pa.table({"pair": (left << 32) + right, "rank": rank.astype(np.int32)}))
        self.db.execute("create table merges as from given")
        self.db.register("given", pa.table({"id": pa.array(ranks.values(), pa.int32()), "bytes": [t.decode("latin-1") for t in ranks]}))
        self.db.execute("create table vocabulary as from given")
        self.db.unregister("given")
        self.token = {r: t for t, r in ranks.items()}

    def _ask(self, query: str, ids: pa.Array) -> pa.Table:
        self.db.register("words", pa.table({"w": np.arange(len(ids), dtype=np.int32), "ids": ids}))
        return self.db.sql(query).to_arrow_table()

    def encode(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, as little-endian 32-bit integers. Empty words have none. Long words are put together from parts."""
        out = dict(zip(short := [w for w in words if len(w) <= PART], self._contracted(short), strict=True))
        long = [w for w in words if len(w) > PART]

        def lists(parts: list[bytes]) -> list[list[int]]:
            each = list(dict.fromkeys(parts))
            known = {w: np.frombuffer(x, "<u4").tolist() for w, x in zip(each, self._contracted(each), strict=True)}
            return [known[p] for p in parts]

        if long:
            out |= {w: np.array(ids, "<u4").tobytes() for w, ids in zip(long, stitched(long, lists, self.token), strict=True)}
        return [out[w] for w in words]

    def _contracted(self, words: list[bytes]) -> list[bytes]:
        """The recursive query over the words."""
        ends = np.cumsum([0, *map(len, words)])
        flat = self.first[np.frombuffer(b"".join(words), np.uint8)]
        ids = self._ask(ENCODE, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))).column("ids").combine_chunks()
        ids = pa.concat_arrays(ids.chunks) if isinstance(ids, pa.ChunkedArray) else ids
        raw, at = np.asarray(ids.flatten(), "<u4").tobytes(), (np.asarray(ids.offsets) - ids.offsets[0].as_py()) * 4
        return [raw[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]

    def decode(self, groups: list[bytes]) -> list[bytes]:
        """The bytes of each group of ids."""
        ends = np.cumsum([0, *(len(g) // 4 for g in groups)])
        flat = np.frombuffer(b"".join(groups), "<i4")
        got = self._ask(DECODE, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)))
        out = [b""] * len(groups)
        for w, s in zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True):
            out[w] = s.encode("latin-1")
        return out


class Worker:
    """What one Python worker keeps: the database, and two generations of words with their ids and with the bytes that these stand for."""

    kept: dict = {}

    def __init__(self, path: str, pattern: str) -> None:
        self.sql, self.split = SqlBpe(bpe_ranks(path)), regex.compile(pattern)
        self.young: dict[str, tuple[bytes, bytes]] = {}
        self.old: dict[str, tuple[bytes, bytes]] = {}

    @classmethod
    def of(cls, path: str, pattern: str) -> Worker:
        if (path, pattern) not in cls.kept:
            cls.kept[path, pattern] = cls(path, pattern)
        return cls.kept[path, pattern]

    def known(self, wanted: set[str]) -> dict[str, tuple[bytes, bytes]]:
        """A table that holds the wanted words; those in neither generation are encoded at once, and what comes out is decoded at once."""
        missing = []
        for w in wanted.difference(self.young):
            if w in self.old:
                self.young[w] = self.old[w]
            else:
                missing.append(w)
        long = {}
        if missing:
            ids = self.sql.encode([w.encode() for w in missing])
            new = dict(zip(missing, zip(ids, self.sql.decode(ids), strict=True), strict=True))
            long = {w: new.pop(w) for w in missing if len(w) > PART}  # not remembered: the memory is bounded by words
            self.young.update(new)
        table = self.young
        if len(table) > REMEMBERED:
            self.young, self.old = {}, table
        return {w: long.get(w) or table[w] for w in wanted} if long else table

    def encode_decode(self, texts: list[str]) -> tuple[list[bytes], list[bytes]]:
        words = [self.split.findall(t) for t in texts]
        table = self.known(set().union(*words))
        both = [list(map(table.__getitem__, ws)) for ws in words]
        return [b"".join([p[0] for p in ps]) for ps in both], [b"".join([p[1] for p in ps]) for ps in both]


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers), decoded (the bytes that these ids stand for).

    A row comes out for each row that goes in. Null and empty texts have no ids. Other columns are ignored. Special
    tokens are not recognised. The pattern splits a text in one pass; time grows with a text's length, whatever its words.
    """

    def make(batch: pa.RecordBatch) -> dict:
        ids, decoded = Worker.of(ranks_path, pattern).encode_decode(column(batch, "text").to_pylist())
        return {"doc_id": column(batch, "doc_id"), "n_tokens": [len(x) // 4 for x in ids], "ids": ids, "decoded": decoded}

    return mapped(docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text")), make, "doc_id long, n_tokens long, ids binary, decoded binary")
