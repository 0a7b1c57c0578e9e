"""Edit-aware token counts (operator 1).

A document's pre-tokens are the leaves of a segment tree whose nodes hold sums of characters and of tokens. An edit
finds its leaves by descending the character sums, takes in the pre-tokens whose matching could have looked at the
edited characters, matches again from there only until the new boundaries meet old ones, and updates the sums above.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.common import PART, Ranked, column, mapped, whole_text

#: Pre-tokens in a leaf of the tree as it is built.
LEAF = 32
#: A pre-token's match can depend on this many characters behind its end: a run of blanks looks at the one that it
#: leaves to the next word and at what follows it, an apostrophe at two letters.
BEHIND = 2
#: Characters behind an edit that are read at first.
WINDOW = 32
REMEMBERED = 200_000
#: Bytes of text whose trees a worker holds at once; their lists take some thirty times as much.
SLICE = 1 << 20


class Counter:
    """Splits texts by the tokenizer's pattern and counts the tokens of pre-tokens; remembers counts within a bound."""

    kept: dict = {}

    def __init__(self, path: str, pattern: str) -> None:
        self.pattern, self.memory = regex.compile(pattern), {}
        self.bpe = Ranked.of(path)

    @classmethod
    def of(cls, path: str, pattern: str) -> Counter:
        if (path, pattern) not in cls.kept:
            cls.kept[path, pattern] = cls(path, pattern)
        return cls.kept[path, pattern]

    def counts(self, pieces: list[str]) -> list[int]:
        known = self.memory
        try:
            return [known[p] for p in pieces]
        except KeyError:
            if len(known) > REMEMBERED:
                known.clear()
            long = {}
            for p in set(pieces).difference(known):
                (known if len(p) <= PART else long)[p] = len(self.bpe.ids(p))
            return [known[p] if p in known else long[p] for p in pieces]


class TokenTree:
    """The segment tree of one text. `encoded` counts the pre-tokens that were counted since it was built."""

    def __init__(self, counter: Counter, text: str) -> None:
        self.counter, self.text, self.encoded = counter, text, 0
        pieces = counter.pattern.findall(text)
        self._build(list(map(len, pieces)), counter.counts(pieces))

    @classmethod
    def restored(cls, counter: Counter, text: str, chars: list[int], tokens: list[int]) -> TokenTree:
        """From the pre-tokens' lengths and counts as leaves() gave them, without encoding anything."""
        tree = cls.__new__(cls)
        tree.counter, tree.text, tree.encoded = counter, text, 0
        tree._build(chars, tokens)
        return tree

    def _build(self, chars: list[int], tokens: list[int]) -> None:
        self.leaf_chars = [chars[i : i + LEAF] for i in range(0, len(chars), LEAF)] or [[]]
        self.leaf_tokens = [tokens[i : i + LEAF] for i in range(0, len(tokens), LEAF)] or [[]]
        n = len(self.leaf_chars)
        self.base = 1 << (n - 1).bit_length()
        self.chars = [0] * self.base + list(map(sum, self.leaf_chars)) + [0] * (self.base - n)
        self.tokens = [0] * self.base + list(map(sum, self.leaf_tokens)) + [0] * (self.base - n)
        for i in range(self.base - 1, 0, -1):
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    @property
    def n_pretokens(self) -> int:
        return sum(map(len, self.leaf_chars))

    def leaves(self) -> tuple[list[int], list[int]]:
        return [x for leaf in self.leaf_chars for x in leaf], [x for leaf in self.leaf_tokens for x in leaf]

    def _at(self, char: int) -> tuple[int, int, int]:
        """Leaf, place in it and first character of the pre-token that holds the character; past the end, of the end."""
        if char >= self.chars[1]:
            leaf = len(self.leaf_chars) - 1
            return leaf, len(self.leaf_chars[leaf]), self.chars[1]
        node, start = 1, 0
        while node < self.base:
            node *= 2
            if char >= start + self.chars[node]:
                start += self.chars[node]
                node += 1
        leaf = node - self.base
        for k, n in enumerate(self.leaf_chars[leaf]):
            if char < start + n:
                return leaf, k, start
            start += n
        raise AssertionError("sums differ from the leaves")

    def _put(self, leaf: int, chars: list[int], tokens: list[int]) -> None:
        self.leaf_chars[leaf], self.leaf_tokens[leaf] = chars, tokens
        node = leaf + self.base
        self.chars[node], self.tokens[node] = sum(chars), sum(tokens)
        while node > 1:
            node //= 2
            self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
            self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    def edit(self, start: int, end: int, put: str) -> None:
        """Replaces the characters from start to end (exclusive) by `put`. Bounds beyond the text are cut to it."""
        self.edit_all([(start, end, put)])

    def edit_all(self, edits: list[tuple[int, int, str]]) -> None:
        """Applies edits by the characters of the present text, not overlapping, from the last to the first.

        An edit reads its surroundings only; the text is put together once, in the end.
        """
        text, size = self.text, len(self.text)
        done: list[tuple[int, int, str]] = []  # from the last in the text to the nearest
        for start, end, put in sorted(edits, reverse=True):
            start = min(max(start, 0), size)
            end = min(max(end, start), size)
            self._replace(start, end, put, lambda n, end=end: _behind(text, end, done, n))
            done.append((start, end, put))
        parts, at = [], 0
        for start, end, put in reversed(done):
            parts += [text[at:start], put]
            at = end
        self.text = "".join([*parts, text[at:]])

    def _replace(self, start: int, end: int, put: str, behind: Callable[[int], str]) -> None:
        """One edit on the tree; behind(n) are the next n characters of the text as it is now behind the edit."""
        shift = len(put) - (end - start)
        size = self.chars[1] + shift
        # The first pre-token that can change: the one whose end lies BEHIND characters before the edit or later.
        leaf, k, at = self._at(max(0, start - BEHIND))
        first = (leaf, k)
        # Old boundaries behind the edit are met again in step with the new matches.
        old_leaf, old_k, old_at = self._at(end)
        if old_at < end:
            old_at += self.leaf_chars[old_leaf][old_k]
            old_k += 1
        ahead, before = WINDOW, self.text[at:start] + put
        window = before + behind(ahead)
        pieces, here = [], at
        while here < size:
            while old_at + shift < here:
                while old_k >= len(self.leaf_chars[old_leaf]):
                    old_leaf, old_k = old_leaf + 1, 0
                old_at += self.leaf_chars[old_leaf][old_k]
                old_k += 1
            if here >= start + len(put) and old_at + shift == here:
                break
            m = self.counter.pattern.match(window, here - at) if here - at < len(window) else None
            if at + len(window) < size and (m is None or m.end() + BEHIND >= len(window) or window[m.end() :].isspace()):
                ahead *= 4  # what lies beyond the window could have a say
                window = before + behind(ahead)
                continue
            pieces.append(m[0])
            here = at + m.end()
        else:
            old_leaf, old_k = len(self.leaf_chars) - 1, len(self.leaf_chars[-1])
        counts = self.counter.counts(pieces)
        self.encoded += len(pieces)
        left, k = first
        head = (self.leaf_chars[left][:k] + list(map(len, pieces)), self.leaf_tokens[left][:k] + counts)
        tail = (self.leaf_chars[old_leaf][old_k:], self.leaf_tokens[old_leaf][old_k:])
        if left == old_leaf:
            self._put(left, head[0] + tail[0], head[1] + tail[1])
        else:
            self._put(left, *head)
            for i in range(left + 1, old_leaf):
                if self.leaf_chars[i]:
                    self._put(i, [], [])
            self._put(old_leaf, *tail)
        if max(len(self.leaf_chars[left]), len(self.leaf_chars[old_leaf])) > 8 * LEAF:
            self._build(*self.leaves())


def _behind(text: str, at: int, done: list[tuple[int, int, str]], n: int) -> str:
    """n characters from `at` on, with the edits done behind it, the nearest of them last."""
    out = []
    for start, end, put in reversed(done):
        out += [text[at : min(start, at + n)], put[: max(0, n - (start - at))]]
        n -= start - at + len(put)
        at = end
        if n <= 0:
            return "".join(out)
    return "".join([*out, text[at : at + n]])


def token_trees(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The trees to keep, beside their texts: doc_id, text, n_tokens, leaf_chars, leaf_tokens (arrays over the pre-tokens).

    A row comes out for each row that goes in. Null texts are empty. edited_counts() takes the table as it is.
    """

    def make(batch: pa.RecordBatch) -> dict:
        counter = Counter.of(ranks_path, pattern)
        trees = [TokenTree(counter, t) for t in column(batch, "text").to_pylist()]
        leaves = [t.leaves() for t in trees]
        return {"doc_id": column(batch, "doc_id"), "text": column(batch, "text"), "n_tokens": [t.n_tokens for t in trees], "leaf_chars": [x[0] for x in leaves], "leaf_tokens": [x[1] for x in leaves]}

    return mapped(docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text")), make, "doc_id long, text string, n_tokens long, leaf_chars array<int>, leaf_tokens array<int>", limit=SLICE)


def edited_counts(docs: DataFrame, ranks_path: str, pattern: str, edits: Callable[[str], list[tuple[int, int, str]]], id_col: str = "doc_id", text_col: str = "text", leaves: bool = False) -> DataFrame:
    """Counts before and after edits: doc_id, n_pretokens, n_tokens, n_edits, n_reencoded, n_tokens_after.

    `edits` gives a text's edits (start, end, replacement), by the characters of the text as given, not overlapping;
    they are applied from the last to the first. With `leaves`, docs has leaf_chars and leaf_tokens of token_trees()
    and the trees are restored from them. A row comes out for each row that goes in; null texts are empty; other
    columns are ignored.
    """
    names = ("n_pretokens", "n_tokens", "n_edits", "n_reencoded", "n_tokens_after")

    def make(batch: pa.RecordBatch) -> dict:
        counter, out = Counter.of(ranks_path, pattern), {n: [] for n in names}
        texts = column(batch, "text").to_pylist()
        kept = zip(column(batch, "leaf_chars").to_pylist(), column(batch, "leaf_tokens").to_pylist(), strict=True) if leaves else [None] * len(texts)
        for text, leaf in zip(texts, kept, strict=True):
            tree = TokenTree(counter, text) if leaf is None or leaf[0] is None else TokenTree.restored(counter, text, *leaf)
            before = (tree.n_pretokens, tree.n_tokens)
            todo = edits(text)
            tree.edit_all(todo)
            for n, v in zip(names, (*before, len(todo), tree.encoded, tree.n_tokens), strict=True):
                out[n].append(v)
        return out | {"doc_id": column(batch, "doc_id")}

    cols = [F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"), *(["leaf_chars", "leaf_tokens"] if leaves else [])]
    return mapped(docs.select(*cols), make, "doc_id long, " + ", ".join(f"{n} long" for n in names), limit=SLICE)
