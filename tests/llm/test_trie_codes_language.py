"""Operators 11 to 13 against plain versions of what they compute."""

import hashlib
import math
import os
import random
import re
import time
import zlib

import numpy as np
import pytest

from lexiloom.llm import conversation_trie, language, quality, queries, vector_codes

DATA = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


# ---- language ----------------------------------------------------------------------------------------------------------


def tree_of(texts, order):
    keys, n = np.unique(np.concatenate([language.grams(t.encode(), order) for t in texts]), return_counts=True)
    return language.Tree.of(keys, n, order), (keys, n)


def plain_bits(texts, order, context, symbol):
    """The code length of a symbol behind a context, straight from the texts."""
    counts = {}
    for t in texts:
        raw = bytes(order) + t.encode()
        for i in range(order, len(raw)):
            for k in range(order + 1):
                of = counts.setdefault(raw[i - k : i], {})
                of[raw[i]] = of.get(raw[i], 0) + 1
    out, excluded = 0.0, set()
    for k in range(order, -1, -1):
        of = counts.get(context[order - k :])
        if of is None:
            continue
        left = {s: n for s, n in of.items() if s not in excluded}
        total, distinct = sum(left.values()), len(left)
        if symbol in left:
            return out + math.log2((total + distinct) / left[symbol])
        if distinct:
            out += math.log2((total + distinct) / distinct)
        excluded = set(of)
    return out + math.log2(256 - len(excluded))


def test_code_lengths_are_those_of_a_plain_version_and_shares_add_up_to_one():
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcdé ñ") for _ in range(60)) for _ in range(5)]
    tree, _ = tree_of(texts, 3)
    for context in (bytes(3), b"abc", b"zzz", b"zbc", b"a b", b"\xc3\xa9a"):
        keys = np.array([int.from_bytes(context + bytes([s]), "big") for s in range(256)], np.uint64)
        got = tree.bits(keys)
        assert np.exp2(-got).sum() == pytest.approx(1)
        assert got == pytest.approx([plain_bits(texts, 3, context, s) for s in range(256)])


def test_a_text_has_the_same_code_length_by_table_and_by_trees():
    rng = random.Random(5)
    kinds = {"x": "abc ", "y": "bcdé ", "z": "q"}
    grams = {lang: tree_of(["".join(rng.choice(letters) for _ in range(300)) for _ in range(4)], language.ORDER)[1] for lang, letters in kinds.items()}
    lookup = language.Languages(grams).lookup
    for text in ("", "a", "abc abd", "ééé abc 漢字" * 40, "".join(rng.choice("abcdeé q") for _ in range(300_000))):
        want = [language.Tree.of(*grams[lang]).bits(language.grams(text.encode())).sum() for lang in sorted(grams)]
        assert lookup.bits(text.encode()) == pytest.approx(want)


def test_counts_of_grams_are_of_all_texts_whatever_the_partitions(spark, docs, texts, monkeypatch):
    monkeypatch.setattr(language, "HELD", 50)  # tasks pass on what they hold often
    rows = docs.select("text", "lang").collect()
    want = {}
    for r in rows:
        if r.lang is not None and r.text is not None:
            for g in language.grams(r.text.encode()).tolist():
                want[g] = want.get(g, 0) + 1
    assert {r.gram: r.n for r in language.gram_counts(docs).collect()} == want


def test_a_tree_keeps_its_most_frequent_grams(spark):
    docs = spark.createDataFrame([("a" * 300 + "".join(f"{i:04d}" for i in range(500)), "x")], "text string, lang string")
    whole = dict(zip(*map(np.ndarray.tolist, language.train(docs).grams["x"]), strict=True))
    for limit in (1, 50, 300):
        keys, n = language.train(docs, limit=limit).grams["x"]
        assert n.tolist() == [whole[k] for k in keys.tolist()] and int.from_bytes(b"aaaaa", "big") in keys.tolist()
        assert sorted(whole.values())[-len(n) :] == sorted(n) and 0.5 * limit < len(n) < 1.5 * limit + 1


def test_languages_of_awkward_rows(spark, awkward, empty):
    known = spark.createDataFrame([("the cat sat on the mat", "en"), ("der hund und die katze", "de"), (None, "fr"), ("no language", None)], "text string, lang string")
    model = language.train(known)
    assert sorted(model.grams) == ["de", "en"]
    asked = spark.createDataFrame([(1, "the mat"), (1, "the mat"), (2, "der hund"), (3, None), (4, ""), (5, "12 345 !?"), (None, "katze")], "doc_id long, text string")
    got = sorted(map(tuple, language.predict(asked, model).collect()), key=str)
    assert [(i, lang) for i, lang, _ in got] == [(1, "en"), (1, "en"), (2, "de"), (3, "und"), (4, "und"), (5, "und"), (None, "de")]
    assert all(0.5 < s <= 1 if lang != "und" else s == 0 for _, lang, s in got)
    assert language.predict(empty, model).count() == 0
    assert language.predict(awkward, language.train(awkward)).count() == awkward.count()
    nothing = language.train(empty)
    assert not nothing.grams and {r.lang_pred for r in language.predict(asked, nothing).collect()} == {"und"}


def test_equally_short_codes_go_to_the_least_name(spark):
    both = language.train(spark.createDataFrame([("same text", "b"), ("same text", "a")], "text string, lang string"))
    assert language.predict(spark.createDataFrame([(1, "same")], "doc_id long, text string"), both).first()[1:] == ("a", 0.5)


@needs_data
def test_held_out_languages(spark):
    got = queries.op11_language_id(spark, DATA)
    both = got.join(queries.documents(spark, DATA).select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(both) > 200 and sum(r.lang == r.lang_pred for r in both) / len(both) > 0.985
    assert got.where("held_out").count() == queries.documents(spark, DATA).where(quality.held_out()).count()


def test_a_long_text_takes_linear_time():
    tree = tree_of(["the cat sat on the mat"], language.ORDER)[1]
    lookup = language.Languages({"en": tree}).lookup
    for text in ("x" * 5_000_000, "the cat " * 600_000, "".join(chr(200 + i % 20_000) for i in range(1_000_000))):
        began = time.time()
        lookup.bits(text.encode())
        assert time.time() - began < 20


# ---- conversations -----------------------------------------------------------------------------------------------------


def plain_trie(rows):
    own = {}
    for c, t, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((t, role or "", text or ""))
    for turns in own.values():
        turns.sort(key=lambda x: (x[0] is not None, x[0] or 0, hashlib.sha256(f"{len(x[1])}:{x[1]}{x[2]}".encode()).digest()))
    full, members, kids = {}, {}, {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        full[c] = tuple(x[1:] for x in own.get(c - int(math.fmod(c, 20)), [])[:h] + turns[h:])
    for c, path in full.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    for path in members:
        if path:
            kids.setdefault(path[:-1], []).append(path)

    def sums(path):
        leaves, saved = int(path not in kids), (len(members[path]) - 1) * (len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0)
        for kid in kids.get(path, []):
            a, b = sums(kid)
            leaves, saved = leaves + a, saved + b
        return leaves, saved

    out = []
    for path, of in members.items():
        ends = ",".join(map(str, sorted(c for c in of if full[c] == path)))
        out.append((min(of), len(path), min(members[path[:-1]]) if path else None, len(of), len(kids.get(path, [])), *sums(path), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


CONVERSATION = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_trie_equals_a_plain_version(spark, seed):
    """Negative ids, absent bases, null turns, roles and texts, equal turns, a large group of copies."""
    rng = random.Random(seed)
    rows = []
    for c in range(-45, 160):
        if rng.random() < 0.8:
            for t in range(rng.randint(1, 6)):
                rows.append((c, None if t == 0 and rng.random() < 0.2 else rng.choice([t, t, 2]), rng.choice(["user", "assistant", None]), rng.choice(["a b", "", None, "hello there you", " x\ty ", "hello"])))
    rows += [(5000 + i, t, "u", "same old") for i in range(700 * (seed == 3)) for t in range(3)] + [(None, 1, "u", "nobody's")] + rows[:3]
    got = conversation_trie.prefix_trie(spark.createDataFrame(rows, CONVERSATION).repartition(5)).collect()
    assert sorted(map(tuple, got), key=str) == plain_trie(rows)


def test_trie_of_one_turn_and_of_nothing(spark):
    one = spark.createDataFrame([(7, 1, "u", "a b", "x", 1)], CONVERSATION + ", key string, base int")  # clashing names
    assert sorted(map(tuple, conversation_trie.prefix_trie(one).collect()), key=str) == plain_trie([(7, 1, "u", "a b")])
    assert conversation_trie.prefix_trie(one.limit(0)).count() == 0


def test_ends_pass_through_the_digest_block_by_block(spark, monkeypatch):
    monkeypatch.setattr(conversation_trie, "BLOCK", 2)
    rows = [(c, 0, "u", "a" if c % 3 else "b") for c in range(-300, 900)]
    got = conversation_trie.prefix_trie(spark.createDataFrame(rows, CONVERSATION)).collect()
    assert sorted(map(tuple, got), key=str) == plain_trie(rows)


def test_a_long_conversation(spark):
    rows = [(c, t, "u", f"turn {t}") for c in (40, 41, 59) for t in range(20_000)] + [(60, 0, "u", "word " * 2_000_000)]
    got = {(r.conv_id, r.depth): r for r in conversation_trie.prefix_trie(spark.createDataFrame(rows, CONVERSATION).repartition(4)).collect()}
    assert got[40, 20_000].n_leaves == 1 and got[40, 20_000].n_convs == 3 and got[40, 1].saved_tokens == 2 * 2 * 20_000 and got[60, 1].n_convs == 1


# ---- vector codes ------------------------------------------------------------------------------------------------------


def nearest(x, books):
    far = np.square(x[:, :, None] - books[:, None]).sum(3)
    codes = far.argmin(2)
    return codes.T, np.take_along_axis(far, codes[:, :, None], 2)[:, :, 0]


def plain_codes(vectors, parts=vector_codes.PARTS, entries=vector_codes.ENTRIES, rounds=vector_codes.ROUNDS):
    x = np.floor(256 * np.array(vectors, float)).astype(np.int64).reshape(len(vectors), parts, -1).swapaxes(0, 1)
    books = x[:, :entries].copy()
    for _ in range(rounds):
        codes = nearest(x, books)[0]
        for p in range(parts):
            for e in range(books.shape[1]):
                if (mine := x[p][codes[:, p] == e]).size:
                    books[p, e] = np.floor_divide(mine.sum(0), len(mine))
    codes, far = nearest(x, books)
    return ["".join(f"{c:02x}" for c in row) for row in codes], far.sum(0).tolist(), books


@pytest.mark.parametrize(("n", "spread"), [(1, 3), (2, 3), (33, 3), (700, 3), (5000, 40)])
def test_trees_assign_as_all_distances_do(n, spread):
    rng = np.random.default_rng(n)
    x = rng.integers(-spread, spread, (4, n, 3))
    books = x[:, rng.integers(0, n, min(n, 64))].copy()  # equal entries too
    codes, far = nearest(x, books)
    forest = vector_codes.build(x)
    got, errors = vector_codes.assign(forest, books)
    assert (got == codes).all() and (errors == far.sum(0)).all()
    counts, totals = vector_codes.sums(forest, books)
    for p in range(4):
        assert (counts[p] == np.bincount(codes[:, p], minlength=books.shape[1])).all()
        assert (totals[p] == [x[p][codes[:, p] == e].sum(0) for e in range(books.shape[1])]).all()


def test_whole_subtrees_are_assigned_at_once():
    """Far fewer single points than vectors meet entries when these lie apart."""
    rng = np.random.default_rng(1)
    centres = rng.integers(-20_000, 20_000, (2, 16, 4))
    x = centres[:, np.arange(4000) % 16] + rng.integers(-5, 5, (2, 4000, 4))
    found = list(vector_codes.filtered(vector_codes.build(x), centres))
    assert sum(len(f[0]) for f in found if len(f) == 3) < 800


def vectors_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, code string")


def test_codes_equal_a_plain_version(spark):
    rng = np.random.default_rng(3)
    good = [(i, rng.normal(0, 0.2, 32).astype(np.float32).tolist(), None if i % 7 == 0 else i % 3, "x") for i in range(-20, 400)]
    bad = [(1000, None, 1, "x"), (1001, [None] * 32, 1, "x"), (1002, [float("nan")] + [0.0] * 31, 1, "x"), (1003, [float("inf")] + [0.0] * 31, 1, "x"), (1004, [0.0] * 31, 1, "x"), (1005, [], 1, "x"), (1006, [0.0] * 16, 1, "x"), (1007, [7e4] + [0.0] * 31, 1, "x")]
    coded = vector_codes.compress(vectors_of(spark, good + bad).repartition(4))
    codes, errors, books = plain_codes([v for _, v, _, _ in good])
    assert {r.vec_id: (r.code, r.error) for r in coded.rows.collect()} == {i: (c, e) for (i, *_), c, e in zip(good, codes, errors, strict=True)}
    assert (coded.books == books).all()
    assert coded.digest == hashlib.sha256(",".join(map(str, books.ravel())).encode()).hexdigest()
    label = {i: lab for i, _, lab, _ in good}
    sums = {}
    for (i, *_), e in zip(good, errors, strict=True):
        sums[label[i]] = sums.get(label[i], 0) + e
    assert all(r.label_error == sums[r.label] for r in vector_codes.with_label_error(coded).collect())


def test_codes_of_repeated_ids_few_and_no_vectors(spark):
    rows = [(1, [0.5] * 16, 1, "x"), (1, [0.5] * 16, 1, "x"), (None, [0.25] * 16, None, "x")]
    coded = vector_codes.compress(vectors_of(spark, rows))
    assert sorted((r.vec_id is None, r.code, r.error) for r in coded.rows.collect()) == [(False, "00" * 16, 0)] * 2 + [(True, "02" * 16, 0)]
    none = vector_codes.compress(vectors_of(spark, rows).limit(0))
    assert none.rows.count() == 0 and vector_codes.with_label_error(none).count() == 0 and none.digest == hashlib.sha256(b"").hexdigest()
