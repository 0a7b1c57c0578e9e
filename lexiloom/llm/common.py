"""What the training-data operators share: shared storage, text slices for Arrow, tokenizer files."""

from __future__ import annotations

import base64
import tempfile
import uuid
from collections.abc import Callable, Iterator, Mapping

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Bytes of text that a Python worker handles at once.
SLICE_BYTES = 4 << 20
#: Bytes of a word from which on it is encoded in parts, and of such a part.
PART = 256
#: Files for each core of the cluster that a table of keys and ids is written as, at most.
FILES = 4


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or one of our own where that is unset and all runs on this machine (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="lexiloom-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def stored(df: DataFrame, name: str, scratch: list[str] | None = None, compression: str = "snappy") -> DataFrame:
    """df written as Parquet to the shared folder and read back: it cuts the lineage and survives lost executors.

    The path is noted in `scratch`, for cleared(); else the files stay until the folder's owner removes them, since the
    returned plan reads them.
    """
    path = f"{shared_dir(df.sparkSession)}/lexiloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    if scratch is not None:
        scratch.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_ids(df: DataFrame, name: str, scratch: list[str] | None = None) -> DataFrame:
    """stored() for narrow rows that are cheap to make: a task writes what several partitions give, one after the other.

    Each file costs its task and, in some stores, a child process to set its permissions; rows of a few bytes
    dealt by a key over many partitions would be mostly files.
    """
    return stored(df.coalesce(FILES * df.sparkSession.sparkContext.defaultParallelism), name, scratch)


def cleared(spark: SparkSession, scratch: list[str]) -> None:
    """Removes stored tables that no plan reads any more: what was made of them must be stored itself."""
    for path in scratch:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    scratch.clear()


def whole_text(text_col: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a slice has at most `limit` bytes of text, or one row."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(text))
        sizes = pc.binary_length(col).fill_null(0).to_pylist()
        start = held = 0
        for i, n in enumerate(sizes):
            if i > start and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < len(sizes):
            yield batch.slice(start)


def mapped(df: DataFrame, make: Callable[[pa.RecordBatch], dict], schema: str | StructType, text: str | None = "text", limit: int = SLICE_BYTES) -> DataFrame:
    """`make` over df's rows, in slices by the column `text` where one is named; it returns the columns of `schema` by name."""
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    wanted = to_arrow_schema(schema)

    def run(batches):
        for part in slices(batches, text, limit) if text else batches:
            cols = make(part)
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) and c.type == f.type else pa.array(c, f.type) for f in wanted for c in [cols[f.name]]], schema=wanted)

    return df.mapInArrow(run, schema)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def bpe_ranks(path: str) -> dict[bytes, int]:
    """A file of ranks: base64 of a token's bytes, then its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def stitched(words: list[bytes], encode: Callable[[list[bytes]], list[list[int]]], token: Mapping[int, bytes]) -> list[list[int]]:
    """The ids of words, by an encoder whose time grows faster than a word's length.

    A sequence of tokens is a word's encoding if and only if each two neighbours, encoded as one word, stay as they
    are: no merge crosses a boundary before one crosses it in the pair alone. So parts are encoded by themselves and
    only tokens around a seam whose neighbours don't stay are encoded again, together, until all seams hold.
    `encode` gives the ids of byte strings, `token` the bytes of an id.
    """

    def join(ids: list[int]) -> bytes:
        return b"".join([token[i] for i in ids])

    def span(ids: list[int], reach: int) -> int:
        """How many of the first `reach` tokens have eight bytes each on average, one at least."""
        size, n = 0, 0
        for i in ids[:reach]:
            size, n = size + len(token[i]), n + 1
            if size >= 8 * reach:
                break
        return n

    parts = iter(encode([w[i : i + PART] for w in words for i in range(0, len(w), PART)]))
    out, seams = [], []
    for w in words:
        ids, at = [], []
        for _ in range(0, len(w), PART):
            at.append(len(ids))
            ids += next(parts)
        out.append(ids)
        seams.append(at[1:])
    for reach in (8, 16, 32):  # all seams at once
        pairs = [(k, c) for k, at in enumerate(seams) for c in at]
        if not pairs:
            return out
        kept = encode([join(out[k][c - 1 : c + 1]) for k, c in pairs])
        spans: list[tuple[int, int, int]] = []
        for (k, c), ids in zip(pairs, kept, strict=True):
            if ids != out[k][c - 1 : c + 1]:
                a, b = c - span(out[k][max(0, c - reach) : c][::-1], reach), c + span(out[k][c : c + reach], reach)
                if spans and spans[-1][0] == k and a <= spans[-1][2]:
                    _, a, before = spans.pop()
                    b = max(b, before)
                spans.append((k, a, b))
        again, seams = encode([join(out[k][a:b]) for k, a, b in spans]), [[] for _ in words]
        new, done = [[] for _ in words], [0] * len(words)
        for (k, a, b), ids in zip(spans, again, strict=True):
            new[k] += out[k][done[k] : a]
            seams[k] += [len(new[k])] * (a > 0)
            new[k] += ids
            seams[k] += [len(new[k])] * (b < len(out[k]))
            done[k] = b
        out = [n + o[d:] for n, o, d in zip(new, out, done, strict=True)]
    for k, at in enumerate(seams):  # what is left depends on all that stands before it, as in periodic words
        if at:
            out[k] = _from_left(out[k], at, encode, join, span)
    return out


def _from_left(ids: list[int], seams: list[int], encode: Callable, join: Callable, span: Callable) -> list[int]:
    """Settles the seams from left to right: what stands left of the place is always a valid encoding."""
    known: dict[bytes, list[int]] = {}

    def of(part: list[int]) -> list[int]:
        raw = join(part)
        if raw not in known:
            known[raw] = encode([raw])[0]
        return known[raw]

    settled, at, ends = ids[: seams[0]], seams[0], [*seams[1:], len(ids)]
    while at < len(ids):
        if of([settled[-1], ids[at]]) == [settled[-1], ids[at]]:
            end = next(e for e in ends if e > at)
            settled += ids[at:end]
            at = end
            continue
        end, take = at + span(ids[at : at + 32], 32), span(settled[-16:][::-1], 16)
        while True:
            new = of(settled[-take:] + ids[at:end])
            if take >= len(settled) or of([settled[-take - 1], new[0]]) == [settled[-take - 1], new[0]]:
                break
            take *= 2
        settled[-take:] = new
        at = end
    return settled


class Ranked:
    """Encodes pre-tokens by a rank file; never matches a pattern, so the length of a pre-token doesn't matter."""

    kept: dict = {}

    def __init__(self, path: str) -> None:
        import tiktoken

        ranks = bpe_ranks(path)
        self.token = {i: t for t, i in ranks.items()}
        self._piece = tiktoken.Encoding("ranks", pat_str="x", mergeable_ranks=ranks, special_tokens={})._encode_single_piece

    @classmethod
    def of(cls, path: str) -> Ranked:
        if path not in cls.kept:
            cls.kept[path] = cls(path)
        return cls.kept[path]

    def ids(self, piece: str) -> list[int]:
        raw = piece.encode()
        return self._piece(raw) if len(raw) <= PART else stitched([raw], lambda parts: list(map(self._piece, parts)), self.token)[0]
