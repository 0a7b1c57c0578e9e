"""Best-fit packing by sums of squares (operator 6).

Each task packs the pieces of its own documents, so nothing is shuffled. Pieces are placed block by block, in a block
from the longest to the shortest, where the sum over all residual gaps g of N(g)**2 becomes smallest, N(g) being the
number of open sequences with a gap of g tokens; a new one is opened only if a piece fits into none. Sequences that are still open go on to the next block.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.common import Ranked, bpe_ranks, column, slices, whole_text

CAPACITY = 1024
#: Bytes of ids that a task holds before it places them; more give a better order.
BLOCK_BYTES = 96 << 20
#: Characters of a run with no blank, or of blanks only, from which on a text is split outside the fast library.
RUN = 2048
_LONG_RUN = re.compile(rf"\S{{{RUN}}}|\s{{{RUN}}}")


def _has_long_run(text: str) -> bool:
    """A run of RUN characters covers a whole block of half as many, so most texts are told by their blocks alone."""
    half = RUN // 2
    blocks = (text[i : i + half] for i in range(0, len(text) - half + 1, half))
    return len(text) >= RUN and any(" " not in b or b.isspace() for b in blocks) and _LONG_RUN.search(text) is not None


class SumOfSquares:
    """Open sequences by their gap. place() gives a sequence's number and the offset in it."""

    def __init__(self, capacity: int = CAPACITY) -> None:
        self.capacity, self.opened = capacity, 0
        self.count = np.zeros(capacity + 1, np.int64)  # 0 and capacity stay 0: full and unopened ones don't count
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]

    def place(self, length: int) -> tuple[int, int]:
        """Among the open gaps that hold the piece, the one where the sum becomes smallest; only if there is none a new sequence.

        The sum changes by 2 (N(g - length) - N(g)) + 2 when a gap g shrinks to g - length. A gap that is filled
        exactly comes first, and ties go to the smallest gap.
        """
        if length >= self.capacity:
            self.opened += 1
            return self.opened - 1, 0
        n = self.count
        there = np.flatnonzero(n[length:]) + length
        if not len(there):
            gap = self.capacity
        elif there[0] == length:
            gap = length
        else:
            gap = int(there[(n[there - length] - n[there]).argmin()])
        if gap == self.capacity:
            number, self.opened = self.opened, self.opened + 1
        else:
            number = self.open[gap].pop()
            n[gap] -= 1
        if gap > length:
            self.open[gap - length].append(number)
            n[gap - length] += 1
        return number, self.capacity - gap


def pieces_of(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: only the first may be shorter than the capacity."""
    first = n % capacity or capacity
    return [(0, min(first, n))] + [(s, capacity) for s in range(first, n, capacity)]


def pack(docs: DataFrame, encode: Callable[[list[str]], list[np.ndarray]], id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids (little-endian unsigned 32-bit integers), sequence_id, offset.

    `encode` gives the ids of texts, each with its end mark (so at least one). Null texts are empty. Each row of docs
    is a document of its own, repeated rows too; other columns are ignored. Which documents share a sequence depends
    on how the input is split, so sequence_id holds the split's number; a task that is run again gives the same rows.
    """
    schema = "doc_id long, piece int, start long, length long, ids binary, sequence_id long, offset long"

    def placed(block: list, bins: SumOfSquares, task: int) -> Iterator[pa.RecordBatch]:
        rows = [(n, d, i, s) for d, (_, ids) in enumerate(block) for i, (s, n) in enumerate(pieces_of(len(ids), capacity))]
        rows.sort(key=lambda r: (-r[0], r[1], r[2]))
        for at in range(0, len(rows), 4096):
            part = [(n, d, i, s, *bins.place(n)) for n, d, i, s in rows[at : at + 4096]]
            yield pa.RecordBatch.from_arrays([
                pa.array([block[d][0] for _, d, *_ in part], pa.int64()), pa.array([r[2] for r in part], pa.int32()), pa.array([r[3] for r in part], pa.int64()), pa.array([r[0] for r in part], pa.int64()),
                pa.array([block[d][1][s : s + n].tobytes() for n, d, _, s, *_ in part], pa.binary()), pa.array([(task << 40) + r[4] for r in part], pa.int64()), pa.array([r[5] for r in part], pa.int64()),
            ], names=["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"])

    def run(batches):
        from pyspark import TaskContext

        task, bins, block, held = TaskContext.get().partitionId(), SumOfSquares(capacity), [], 0
        for part in slices(batches):
            ids = encode(column(part, "text").to_pylist())
            block += zip(column(part, "doc_id").to_pylist(), ids, strict=True)
            held += sum(x.nbytes for x in ids)
            if held >= BLOCK_BYTES:
                yield from placed(block, bins, task)
                block, held = [], 0
        yield from placed(block, bins, task)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text")).mapInArrow(run, schema)


class Encoder:
    """The ids that a `tokenizers` file gives to texts, each followed by an end id.

    The file's vocabulary and splitting pattern are those of the rank file beside it, which a faster library reads.
    Strings of the file's special tokens get their ids before anything is split, as that library does it (they strip
    nothing here, and match within words). Texts with long runs without a blank, or of blanks, are split by the pattern
    outside that library, whose matcher and merges give up on them.
    """

    kept: dict = {}

    def __init__(self, json_path: str, ranks_path: str, pattern: str, end: int) -> None:
        self.json_path, self.ranks_path, self.pattern, self.end = json_path, ranks_path, pattern, end

    def _loaded(self) -> tuple:
        key = (self.json_path, self.ranks_path, self.pattern)
        if key not in self.kept:
            import regex
            import tiktoken
            from tokenizers import Tokenizer

            added = Tokenizer.from_file(self.json_path).get_added_tokens_decoder()
            if any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added.values()):
                raise ValueError("special tokens that strip, match whole words or are normalized aren't supported")
            special = {t.content: i for i, t in added.items()}
            cut = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
            fast = tiktoken.Encoding("ranks", pat_str=self.pattern, mergeable_ranks=bpe_ranks(self.ranks_path), special_tokens={})
            self.kept[key] = special, cut, fast, Ranked.of(self.ranks_path), regex.compile(self.pattern)
        return self.kept[key]

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        special, cut, fast, ranked, split = self._loaded()

        def plain(text: str) -> np.ndarray:
            if not _has_long_run(text):
                return fast.encode_to_numpy(text, disallowed_special=())
            return np.array([i for piece in split.findall(text) for i in ranked.ids(piece)], np.uint32)

        def ids(text: str) -> list[np.ndarray]:
            if cut is None or not cut.search(text):
                return [plain(text)]
            return [np.array([special[part]], np.uint32) if part in special else plain(part) for part in cut.split(text) if part]

        return [np.concatenate([*ids(t), np.array([self.end], np.uint32)]).astype("<u4") for t in texts]

    def __reduce__(self):
        return Encoder, (self.json_path, self.ranks_path, self.pattern, self.end)
