"""Prefix trie of conversations, merged family by family (operator 12).

Conversations that are rebuilt from one base form a family. Turns are shuffled once, as digests, so that a family lies
together; its task rebuilds the conversations and makes the family's small trie. What is shuffled from then on are
combined nodes of families: by node to find what all families have there, by family to sum over subtrees, and by node
again to add these sums up.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lexiloom.llm.common import cleared, column, stored, whole_text

#: Conversations of consecutive ids that share a base; the ids of a block of bases are joined before a node's ids meet.
FAMILY, BLOCK = 20, 64
#: The most turns that a conversation takes from its base, less one.
HEADS = 4
#: Rows of an Arrow batch that a family task writes.
ROWS = 20_000
WORD = "[^\\x20\\x09-\\x0D]+"
ROOT = b""
_NODES = "base long, at int, end int, key binary, depth long, words long, n long, least long, n_ends long, ends string"


def turn_digest(role: Column, text: Column) -> Column:
    """Stands for a turn's role and text."""
    return F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256))


def families(df: DataFrame) -> DataFrame:
    """base, conv_id, turn, digest, words of each turn; turns without a conversation are left out."""
    c = F.col("conv_id").cast("long")
    plain = df.where(F.col("conv_id").isNotNull()).select(c.alias("conv_id"), F.col("turn").alias("turn"), whole_text("role").alias("role"), whole_text("text").alias("text"))
    return plain.select((F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"), "conv_id", "turn", turn_digest(F.col("role"), F.col("text")).alias("digest"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"))


def heads(conv_id: int) -> int:
    """How many turns of its base a conversation begins with."""
    return zlib.crc32(str(conv_id).encode()) % HEADS


def rebuilt(turns: dict[int, list], base: int) -> dict[int, list]:
    """A family's conversations from its members' own turns, in order."""
    return {c: turns.get(base, [])[: heads(c)] + own[heads(c) :] for c, own in sorted(turns.items())}


def family_trie(base: int, turns: dict[int, list[tuple[bytes, int]]]) -> Iterator[tuple]:
    """The nodes of one family's trie, as _NODES has them, a node before its subtree: nodes at..end-1 are the subtree of the node `at`.

    A node's key is a digest over the key of its parent and its last turn, so that equal prefixes have equal keys in
    all families.
    """
    top: list = [ROOT, 0, 0, None, [], {}]  # key, words, members, the least of them, those that end here, children by digest

    def joined(node: list, c: int) -> list:
        node[2] += 1
        node[3] = c if node[3] is None else node[3]  # ids ascend
        return node

    for c, path in rebuilt(turns, base).items():
        node = joined(top, c)
        for digest, words in path:
            child = node[5].get(digest)
            if child is None:
                child = node[5][digest] = [hashlib.blake2b(node[0] + digest, digest_size=16).digest(), words, 0, None, [], {}]
            node = joined(child, c)
        node[4].append(c)
    rows, stack = [], [(top, 0, None)]
    while stack:
        node, depth, done = stack.pop()
        if done is not None:  # the subtree is out
            rows[done][2] = len(rows)
            continue
        at, (key, words, n, least, ends, children) = len(rows), node
        rows.append([base, at, 0, key, depth, words, n, least, len(ends), ",".join(map(str, ends)) or None])
        stack.append((node, depth, at))
        stack += [(child, depth + 1, None) for child in children.values()]
    yield from rows


def _batched(rows: Iterator, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list = []
    for row in rows:
        held.append(row)
        if len(held) == ROWS:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def family_nodes(turns: DataFrame) -> DataFrame:
    """The nodes of all families' tries; a partition's families follow one another, so a task holds one of them at a time."""
    schema = StructType.fromDDL(_NODES)
    wanted = to_arrow_schema(schema)

    def run(batches):
        def rows():
            base, held = None, {}
            for batch in batches:
                for b, c, digest, words in zip(*(column(batch, n).to_pylist() for n in ("base", "conv_id", "digest", "words")), strict=True):
                    if b != base:
                        if held:
                            yield from family_trie(base, held)
                        base, held = b, {}
                    held.setdefault(c, []).append((digest, words))
            if held:
                yield from family_trie(base, held)

        return _batched(rows(), wanted)

    together = turns.repartition("base").sortWithinPartitions("base", "conv_id", F.asc_nulls_first("turn"), "digest")
    return together.select("base", "conv_id", "digest", "words").mapInArrow(run, schema)


def subtree_sums(nodes: DataFrame) -> DataFrame:
    """What each family adds to its nodes: key, depth, conv_id, n_convs, parent_conv_id, n_children, n_leaves, saved_tokens.

    nodes(base, at, end, key, depth, words, least, n_convs, conv_id, closed) have what all families know of a node. A
    node counts in the family of its least member only, so that sums over families count it once.
    """
    schema = StructType.fromDDL("key binary, depth long, conv_id long, n_convs long, parent_conv_id long, n_children long, n_leaves long, saved_tokens long")
    wanted = to_arrow_schema(schema)
    names = ("at", "end", "key", "depth", "words", "least", "n_convs", "conv_id", "closed")

    def of(family: list) -> Iterator[tuple]:
        leaves, saved = [0], [0]  # before each node
        children = [0] * len(family)
        parents: list[int | None] = [None] * len(family)
        path: list[int] = []
        for at, _, _, depth, words, least, n, conv_id, closed in family:
            own = least == conv_id
            del path[depth:]
            parents[at] = path[-1] if path else None
            path.append(at)
            leaves.append(leaves[-1] + (own and closed))
            saved.append(saved[-1] + own * (n - 1) * words)
            if own and parents[at] is not None:
                children[parents[at]] += 1
        for (at, end, key, depth, _, _, n, conv_id, _), parent, kids in zip(family, parents, children, strict=True):
            yield key, depth, conv_id, n, None if parent is None else family[parent][7], kids, leaves[end] - leaves[at], saved[end] - saved[at]

    def run(batches):
        def rows():
            base, held = None, []
            for batch in batches:
                for b, *row in zip(*(column(batch, n).to_pylist() for n in ("base", *names)), strict=True):
                    if b != base:
                        yield from of(held)
                        base, held = b, []
                    held.append(row)
            yield from of(held)

        return _batched(rows(), wanted)

    return nodes.repartition("base").sortWithinPartitions("base", "at").select("base", *names).mapInArrow(run, schema)


def ends_digests(nodes: DataFrame) -> DataFrame:
    """key, ends_sha256: the digest over the ascending ids that end at a node.

    Bases that follow one another are joined to blocks first. A node's blocks then pass through its digest in order,
    one at a time, so its ids are never held together.
    """
    ending = nodes.where("ends is not null").select("key", "base", "ends")
    blocks = ending.groupBy("key", F.expr(f"base div {FAMILY * BLOCK}").alias("block")).agg(F.sort_array(F.collect_list(F.struct("base", "ends"))).alias("e"))  # 2 * BLOCK bases at most
    joined = blocks.select("key", "block", F.array_join(F.transform("e", lambda s: s["ends"]), ",").alias("ends"))
    schema = StructType.fromDDL("key binary, ends_sha256 string")
    wanted = to_arrow_schema(schema)

    def run(batches):
        def rows():
            key, digest = None, None
            for batch in batches:
                for k, ends in zip(column(batch, "key").to_pylist(), column(batch, "ends").to_pylist(), strict=True):
                    if digest is None or k != key:
                        if digest is not None:
                            yield key, digest.hexdigest()
                        key, digest = k, hashlib.sha256(ends.encode())
                    else:
                        digest.update(b"," + ends.encode())
            if digest is not None:
                yield key, digest.hexdigest()

        return _batched(rows(), wanted)

    return joined.repartition("key").sortWithinPartitions("key", "block").select("key", "ends").mapInArrow(run, schema)


def prefix_trie(df: DataFrame) -> DataFrame:
    """The trie of df(conv_id, turn, role, text), a row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Null roles and texts count as empty, rows with a null conv_id are ignored, and so are other columns. Turns are
    ordered by turn, nulls first, then by their digests; repeated rows are turns of their own. An empty table has no
    node. A family's turns, some 60 bytes each whatever their texts, are held by one task.
    """
    spark, scratch = df.sparkSession, []
    nodes = stored(family_nodes(families(df)), "family-nodes", scratch)
    merged = nodes.groupBy("key").agg(F.sum("n").alias("n_convs"), F.min("least").alias("conv_id"), (F.sum("n") == F.sum("n_ends")).alias("closed"))
    known = nodes.select("base", "at", "end", "key", "depth", "words", "least").join(merged, "key")
    parts = subtree_sums(known)
    sums = parts.groupBy("key").agg(
        F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.min("parent_conv_id").alias("parent_conv_id"), F.min("n_convs").alias("n_convs"),
        *(F.sum(c).alias(c) for c in ("n_children", "n_leaves", "saved_tokens")),
    )
    none = hashlib.sha256(b"").hexdigest()
    whole = sums.join(ends_digests(nodes), "key", "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))
    out = stored(whole, "prefix-trie")
    cleared(spark, scratch)
    return out
