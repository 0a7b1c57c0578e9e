"""Each operator against a plain version on a small table, and on awkward and empty ones."""

import base64
import collections
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lexiloom.llm import bpe, exact_dedup, line_dedup, media, near_dedup, packing, pii, quality, queries, substrings, token_counts
from lexiloom.llm.common import Ranked, bpe_ranks

RANKS = public_tokenizers.path(queries.RANKS)


@pytest.fixture(scope="module")
def plain_bpe():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe_ranks(RANKS), special_tokens={})


def sha(x) -> str:
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


# ---- 1 token counts --------------------------------------------------------------------------------------------------


def test_edited_counts_equal_full_counts(docs, texts, plain_bpe):
    got = by_id(token_counts.edited_counts(docs, RANKS, public_tokenizers.PATTERN, queries.masking_edits))
    for i, t in enumerate(texts):
        t = t or ""
        assert got[i].n_tokens == len(plain_bpe.encode_ordinary(t))
        assert got[i].n_tokens_after == len(plain_bpe.encode_ordinary(re.sub("[0-9]+", "0", t) + "\n"))
        assert got[i].n_reencoded <= got[i].n_pretokens + 3 * got[i].n_edits


def test_trees_under_random_edits(texts, plain_bpe):
    import random

    rng, counter = random.Random(5), token_counts.Counter(RANKS, public_tokenizers.PATTERN)
    for text in [t for t in texts if t][:60] + ["a" * 50, " " * 40, "it's " * 30]:
        tree = token_counts.TokenTree(counter, text)
        for _ in range(12):
            a = rng.randint(0, len(text))
            b = min(len(text), a + rng.choice([0, 0, 1, 3, 30]))
            put = rng.choice(["", " ", "  ", "'", "s", "'ll", "word", " 12", "\n", "x y z", "!"])
            text = text[:a] + put + text[b:]
            tree.edit(a, b, put)
            assert tree.text == text
            assert tree.n_tokens == len(plain_bpe.encode_ordinary(text))
            assert tree.chars[1] == len(text)


def test_only_edited_regions_are_encoded(plain_bpe):
    counter = token_counts.Counter(RANKS, public_tokenizers.PATTERN)
    tree = token_counts.TokenTree(counter, "some words of a text " * 2000)
    tree.edit(20_000, 20_003, "thing")
    assert tree.encoded < 10


def test_kept_trees_are_restored(docs, texts, plain_bpe):
    trees = token_counts.token_trees(docs, RANKS, public_tokenizers.PATTERN)
    got = by_id(token_counts.edited_counts(trees, RANKS, public_tokenizers.PATTERN, queries.masking_edits, leaves=True))
    assert all(got[i].n_tokens_after == len(plain_bpe.encode_ordinary(re.sub("[0-9]+", "0", t or "") + "\n")) for i, t in enumerate(texts))


@pytest.fixture(scope="module")
def long_words():
    """Words and runs far beyond what the libraries' matchers and merges take; periodic ones decide their tokens from the left."""
    rng = np.random.default_rng(2)
    letters = ["".join(rng.choice(list("etaoinshrdlu"), n)) for n in (1, 300, 16_000)]
    return [*letters, "lol" * 2001, "ab" * 1500 + "c" * 1999, "=" * 2050 + "-" * 1999, "漢字" * 4000, " " * 5000 + "x", "".join(rng.choice(list("的一是不了人我在有他"), 3000))]


def test_long_words_are_put_together_from_parts(long_words, plain_bpe):
    ranked, sql = Ranked.of(RANKS), bpe.SqlBpe(bpe_ranks(RANKS))
    assert {len(t) for t in bpe_ranks(RANKS)} >= {1, 2, 3} and all(ranked._piece(t) == [i] for t, i in list(bpe_ranks(RANKS).items())[::50])
    for w in long_words:
        whole = plain_bpe._encode_single_piece(w.encode())
        assert ranked.ids(w) == whole
        assert np.frombuffer(sql.encode([w.encode()])[0], "<u4").tolist() == whole


def test_very_long_runs_are_counted_encoded_and_packed(spark, long_words, plain_bpe):
    texts = [" ".join(long_words), " " * 1_000_000, "\n" * 300_000 + "x", "<|endoftext|>" + " " * 5000 + "<|endoftext|>y"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ids = [plain_bpe.encode_ordinary(texts[0]), [i for s in (" " * 1_000_000,) for i in Ranked.of(RANKS).ids(s)]]
    ids.append([i for s in ("\n" * 299_999, "\n", "x") for i in Ranked.of(RANKS).ids(s)])
    counts = by_id(token_counts.edited_counts(docs, RANKS, public_tokenizers.PATTERN, queries.masking_edits))
    coded = by_id(bpe.encode_decode(docs, RANKS, public_tokenizers.PATTERN))
    for i, x in enumerate(ids):
        assert counts[i].n_tokens == coded[i].n_tokens == len(x) and np.frombuffer(coded[i].ids, "<u4").tolist() == x
        assert bytes(coded[i].decoded) == texts[i].encode()
    packed = packing.pack(docs, queries.encoder()).orderBy("doc_id", "start").collect()
    for i, x in enumerate(ids):
        assert b"".join(bytes(r.ids) for r in packed if r.doc_id == i) == np.array([*x, queries.END_OF_TEXT], "<u4").tobytes()
    slow = Tokenizer.from_file(public_tokenizers.path(queries.TOKENIZER)).encode(texts[3], add_special_tokens=False).ids
    assert b"".join(bytes(r.ids) for r in packed if r.doc_id == 3) == np.array([*slow, queries.END_OF_TEXT], "<u4").tobytes()


# ---- 2 substring dedup -----------------------------------------------------------------------------------------------


def plain_repeats(words: list[list[bytes]], window: int) -> list[list[bytes]]:
    seen = collections.Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone |= set(range(i, i + window))
        out.append([x for i, x in enumerate(w) if i not in gone])
    return out


def plain_words(t):
    return re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())


@pytest.mark.parametrize("group", [substrings.GROUP, 1])
def test_repeats_equal_brute_force(docs, texts, group, monkeypatch):
    monkeypatch.setattr(substrings, "GROUP", group)  # 1: every shared gram goes the way of the largest groups
    got = by_id(substrings.remove_repeats(docs))
    words = [plain_words(t) for t in texts]
    kept = plain_repeats(words, substrings.WINDOW)
    assert sum(map(len, kept)) < sum(map(len, words))
    for i, (w, k) in enumerate(zip(words, kept, strict=True)):
        assert (got[i].n_words, got[i].n_removed, got[i].kept) == (len(w), len(w) - len(k), b" ".join(k).decode())


def test_repeats_within_periodic_texts(spark):
    texts = ["a b " * 60, "a " * 40, "a " * 35, "c " * 36, " ".join(map(str, range(100))), " ".join(map(str, range(50, 120)))]
    got = by_id(substrings.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    for i, k in enumerate(plain_repeats([plain_words(t) for t in texts], substrings.WINDOW)):
        assert got[i].kept == b" ".join(k).decode()


def test_repeated_rows_are_documents_of_their_own(spark):
    text = " ".join(map(str, range(40)))
    rows = substrings.remove_repeats(spark.createDataFrame([(1, text), (1, text), (None, "x"), (None, None)], "doc_id long, text string")).collect()
    assert sorted((r.n_words, r.n_removed) for r in rows) == [(0, 0), (1, 0), (40, 40), (40, 40)]


# ---- 3 byte-level BPE ------------------------------------------------------------------------------------------------


def test_sql_bpe_equals_the_library(docs, texts, plain_bpe):
    got = by_id(bpe.encode_decode(docs, RANKS, public_tokenizers.PATTERN))
    for i, t in enumerate(texts):
        ids = np.array(plain_bpe.encode_ordinary(t or ""), "<u4").tobytes()
        assert (got[i].n_tokens, bytes(got[i].ids), bytes(got[i].decoded)) == (len(ids) // 4, ids, (t or "").encode())


def test_sql_bpe_merges_leftmost_of_least_rank():
    ranks = {bytes([i]): i for i in range(256)} | {b"aa": 256, b"ab": 257, b"aaa": 258, b"aab": 259}
    sql = bpe.SqlBpe(ranks)
    plain = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
    words = [b"aaaaa", b"aab", b"baaab", b"abab", b"b", b""]
    ids = [np.frombuffer(x, "<u4").tolist() for x in sql.encode(words)]
    assert ids == [plain.encode_ordinary(w.decode()) for w in words]
    assert sql.decode([np.array(x, "<u4").tobytes() for x in ids]) == words


# ---- 4 line dedup ----------------------------------------------------------------------------------------------------


def plain_lines(rows, sites):
    spread, first = collections.defaultdict(set), {}
    for i, t, s in sorted(rows):
        for at, line in enumerate((t or "").split("\n")):
            if line.strip(" \t\n\v\f\r"):
                spread[line].add(s)
                first.setdefault(line, (i, at))
    out = {}
    for i, t, _ in rows:
        out[i] = None if t is None else "\n".join(x for at, x in enumerate(t.split("\n")) if not (len(spread.get(x, ())) >= sites and first[x] != (i, at)))
    return out


@pytest.mark.parametrize("sites", [2, 5, 10])
def test_line_dedup_equals_brute_force(spark, sites):
    rng = np.random.default_rng(sites)
    rows = []
    for i in range(300):
        lines = [f"own line {i} {j}" for j in range(rng.integers(0, 4))] + [f"shared {int(rng.zipf(1.5)) % 40}" for _ in range(rng.integers(0, 5))] + [""] * int(rng.integers(0, 2))
        rng.shuffle(lines)
        rows.append((i, None if i == 7 else "\n".join(lines), f"s{rng.integers(0, 16)}"))
    got = by_id(line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, source string"), sites=sites))
    want = plain_lines(rows, sites)
    assert {i: r.text for i, r in got.items()} == want
    assert any(w != t for (_, t, _), w in zip(rows, want.values(), strict=True))


def test_line_dedup_counts_exactly_where_the_sketch_is_near(spark):
    rows = [(i, f"line {n}", f"s{i}") for n in (9, 10, 11, 300) for i in range(n)]
    rows = [(k, t, s) for k, (_, t, s) in enumerate(rows)]
    got = by_id(line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, source string"), sites=10))
    assert {i: r.text for i, r in got.items()} == plain_lines(rows, 10)


def test_line_dedup_is_native(docs):
    import inspect

    plan = docs.sparkSession._jvm  # the plan of the operator holds no Python node
    text = inspect.getsource(line_dedup)
    assert plan and not re.search(r"udf|mapIn|applyIn|\.rdd", text)


# ---- 5 media ---------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("form", ["pgm", "bmp"])
def test_text_images_are_lossless(docs, texts, form):
    images = media.text_images(docs, form=form)
    got = by_id(media.media_columns(images, ["doc_id", "n_bytes", "media"]))
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        assert bytes(got[i].samples) == payload
        assert got[i].n_bytes == len(raw)
        assert len(got[i].dhash) == 16


def test_formats_round_trip():
    rng = np.random.default_rng(1)
    for shape in [(1, 1), (3, 5), (7, 4, 3), (2, 9, 3), (24, 24)]:
        a = rng.integers(0, 256, shape, dtype=np.uint8)
        assert (media.decode(media.encode_pgm(a)) == a).all()
        assert (media.decode(media.encode_bmp(a)) == a).all()


@pytest.mark.parametrize("most", [b"0", b"65536"])
def test_an_image_without_a_greatest_sample_is_damaged(most):
    assert media.decode(b"P5\n2 1\n" + most + b"\n\x00\x01") is None and media.decode(b"P2\n1 1\n" + most + b"\n0\n") is None


def test_other_netpbm_kinds():
    assert media.decode(b"P2\n# grey\n3 1\n15\n0 7 15\n").tolist() == [[0, 119, 255]]
    assert media.decode(b"P3 1 2 255 1 2 3 4 5 6").tolist() == [[[1, 2, 3]], [[4, 5, 6]]]
    assert media.decode(b"P1\n3 2\n1 0 1\n0 1 0\n").tolist() == [[0, 255, 0], [255, 0, 255]]
    assert media.decode(b"P4\n3 2\n" + bytes([0b10100000, 0b01000000])).tolist() == [[0, 255, 0], [255, 0, 255]]
    assert media.decode(b"P5 2 1 65535\n" + bytes([0, 0, 255, 255])).tolist() == [[0, 255]]
    assert [media.decode(x) for x in (None, b"", b"P5", b"P5 9 9 255\nshort", b"GIF89a", b"BMxx")] == [None] * 6


def test_area_resize_equals_means():
    a = np.arange(48 * 72, dtype=np.uint8).reshape(48, 72)
    assert np.allclose(media.area_resize(a, 8, 9), a.reshape(8, 6, 9, 8).mean((1, 3)))
    up = media.area_resize(np.array([[10, 20]], np.uint8), 2, 3)
    assert np.allclose(up, [[10, 15, 20]] * 2)
    whole = media.area_resize(np.random.default_rng(0).integers(0, 256, (37, 53)).astype(np.uint8), 5, 7)
    assert whole.shape == (5, 7)


def test_media_columns_on_odd_media(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, bytearray(b"junk"), "b"), (3, bytearray(media.encode_bmp(np.zeros((2, 2), np.uint8))), "c")], "id int, media binary, rows string")
    got = {r.id: r for r in media.media_columns(df, ["id"]).collect()}
    assert got[1].tile is None and got[2].dhash is None and got[3].rows == 2
    assert np.load(__import__("io").BytesIO(bytes(got[3].tile))).shape == (media.TILE, media.TILE)


# ---- 6 packing -------------------------------------------------------------------------------------------------------


def test_packing_is_whole_and_gapless(docs, texts):
    rows = packing.pack(docs, queries.encoder()).collect()
    slow = Tokenizer.from_file(public_tokenizers.path(queries.TOKENIZER))
    pieces, used = collections.defaultdict(dict), collections.defaultdict(list)
    for r in rows:
        pieces[r.doc_id][r.piece] = r
        used[r.sequence_id].append((r.offset, r.length))
    for i, t in enumerate(texts):
        ids = slow.encode(t or "", add_special_tokens=False).ids + [2]
        ps = [pieces[i][k] for k in range(len(pieces[i]))]
        assert b"".join(bytes(p.ids) for p in ps) == np.array(ids, "<u4").tobytes()
        assert [p.start for p in ps] == np.cumsum([0] + [p.length for p in ps])[:-1].tolist()
        assert all(p.length == 1024 for p in ps[1:]) and len(ps) == max(1, -(-len(ids) // 1024))
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024


def test_sum_of_squares_is_near_the_bound():
    rng = np.random.default_rng(2)
    lengths = np.sort(rng.integers(1, 1024, 5000))[::-1]
    bins = packing.SumOfSquares()
    for n in lengths:
        bins.place(int(n))
    assert bins.opened <= 1.02 * -(-lengths.sum() // 1024)


def test_long_runs_are_seen_wherever_they_lie():
    rng = np.random.default_rng(1)
    for n in (2046, 2047, 2048, 2049, 5000):
        for run in ("x" * n, " " * n, "\n\t" * (n // 2) + " " * (n % 2)):
            for at in rng.integers(0, 4000, 8):
                text = ("ab " * 2000)[:at].rstrip() + (" " if run[0] == "x" else "y") + run + (" " if run[0] == "x" else "y") + "ab " * 700
                assert packing._has_long_run(text) == (n >= 2048)


def test_the_rule_takes_the_smallest_sum():
    bins = packing.SumOfSquares(10)
    for gap, n in ((5, 3), (6, 1), (8, 2)):
        bins.count[gap] = n
        bins.open[gap] = list(range(100 * gap, 100 * gap + n))
    want = min((g for g in (5, 6, 8)), key=lambda g: (sum(x * x for x in np.add(bins.count, np.eye(11, dtype=int)[g - 2] - np.eye(11, dtype=int)[g])), g))
    number, offset = bins.place(2)
    assert (number // 100, offset) == (want, 10 - want)


# ---- 7 near dedup ----------------------------------------------------------------------------------------------------


def plain_classes(texts):
    sets = [near_dedup.shingles(t or "") for t in texts]
    up = list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if (texts[i] or "") == (texts[j] or "") or len(sets[i][0]) and near_dedup.similarity(sets[i], sets[j]) >= 0.8:
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return [root(i) for i in range(len(texts))]


def test_classes_equal_brute_force(docs, texts):
    got = by_id(near_dedup.near_classes(docs))
    want = plain_classes(texts)
    assert [got[i].class_id for i in range(len(texts))] == want
    sizes = collections.Counter(want)
    assert all(got[i].class_size == sizes[want[i]] for i in range(len(texts)))


def test_chains_and_groups_of_edited_copies(spark):
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(words)]
    for _ in range(12):  # a chain: each is like its neighbours, the ends aren't
        at = int(rng.integers(0, len(words) - 6))
        words = words[:at] + [f"n{int(rng.integers(1e9))}" for _ in range(4)] + words[at + 4 :]
        texts.append(" ".join(words))
    base = [f"v{i}" for i in range(200)]
    for _ in range(40):  # edited copies of a text that isn't there
        w = base[:]
        for at in rng.integers(0, 200, 2):
            w[at] = f"e{int(rng.integers(1e9))}"
        texts.append(" ".join(w))
    got = by_id(near_dedup.near_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    assert [got[i].class_id for i in range(len(texts))] == plain_classes(texts)


def star(n, seed=7):
    """Copies of a text with 7 or 8 of its words changed, each like the text but hardly like each other, and the text among them."""
    rng = np.random.default_rng(seed)
    base = [f"s{i}" for i in range(400)]
    texts = []
    for i in range(n):
        w = base[:]
        for at in rng.choice(79, 7 + i % 2, replace=False):
            w[at * 5 + 2] = f"c{i}x{at}"
        texts.append(" ".join(w))
    texts.insert(n // 3, " ".join(base))
    return texts


def family(pairs, seed=8):
    """Texts of one template, just too unlike each other but for pairs."""
    rng = np.random.default_rng(seed)
    base = [f"t{i}" for i in range(2000)]
    texts = []
    for i in range(pairs):
        at = rng.choice(399, 48, replace=False)
        for own in (at[6:27], at[27:48]):
            w = base[:]
            for j in at[:6]:
                w[j * 5 + 2] = f"p{i}x{j}"
            for j in own:
                w[j * 5 + 2] = f"o{i}x{j}x{own[0]}"
            texts.append(" ".join(w))
    return texts


def test_one_row_of_each_class_stays_though_rows_and_ids_repeat(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, long, "a"), (1, long, "b"), (1, long, "b"), (2, long + " more", "a"), (1, "other text of its own kind", "c"), (3, "other text of its own kind", "a"), (None, "third", None), (None, "third", None), (7, None, "x"), (8, "", "x"), (1, "", "y"), (1, None, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, __node string")
    kept = near_dedup.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([(1, long, "a"), (1, "other text of its own kind", "c"), (None, "third", None), (1, "", "y")], key=str)
    assert near_dedup.keep_one(df.limit(0)).collect() == []


def test_a_large_star_of_edited_copies_is_one_class(spark):
    texts = star(10_000)
    middle = near_dedup.shingles(texts[10_000 // 3])
    assert all(near_dedup.similarity(middle, near_dedup.shingles(t)) >= 0.8 for t in texts)  # so brute force joins all
    got = near_dedup.near_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert collections.Counter(r.class_id for r in got) == {0: len(texts)}


def test_pairs_inside_a_template_family_are_found(spark):
    texts = family(150)
    got = by_id(near_dedup.near_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    want = plain_classes(texts)
    assert len(set(want)) == 150  # brute force joins the pairs and nothing else
    assert [got[i].class_id for i in range(len(texts))] == want


def test_a_line_repeated_many_times_hides_no_copy(spark):
    texts = []
    for i in range(12):
        words = " ".join(f"d{i}x{j}" for j in range(200))
        line = " ".join(f"l{i}x{j}" for j in range(10))
        texts += [words, words + f" {line}" * (10, 20, 60)[i % 3]]
    got = by_id(near_dedup.near_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    want = plain_classes(texts)
    assert len(set(want)) == 12
    assert [got[i].class_id for i in range(len(texts))] == want


def test_blocks_of_a_bucket_meet_each_other(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    texts = family(20)
    got = by_id(near_dedup.near_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    assert [got[i].class_id for i in range(len(texts))] == plain_classes(texts)


def test_registers_estimate_probability_jaccard():
    rng = np.random.default_rng(6)
    e = rng.integers(1, 1 << 62, 400).astype(np.uint64)
    e.sort()
    x, y = rng.integers(1, 6, 300), rng.integers(1, 6, 300)
    a, b = (e[:300], x), (e[100:], y)
    full_x, full_y = np.zeros(400), np.zeros(400)
    full_x[:300], full_y[100:] = x, y
    exact = sum(1 / np.maximum(full_x / full_x[i], full_y / full_y[i]).sum() for i in range(100, 300))
    sig = near_dedup.signatures([a, b], 20_000)
    assert abs((sig[0] == sig[1]).mean() - exact) < 0.02
    near_dedup_similarity = near_dedup.similarity(a, b)
    assert abs(near_dedup_similarity - max(exact, 200 / 400)) < 1e-9


# ---- 8 exact dedup ---------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("key_bytes", [32, 1, 0])
def test_exact_dedup_equals_plain(docs, texts, key_bytes):
    norm = [re.sub("[\x20\x09-\x0d]+", " ", t or "") for t in texts]
    first, size = {}, collections.Counter(norm)
    for i, n in enumerate(norm):
        first.setdefault(n, i)
    got = by_id(exact_dedup.exact_dedup(docs, key_bytes=key_bytes))  # with less than the whole digest, texts that differ meet
    for i, n in enumerate(norm):
        assert got[i] == (i, first[n], size[n], first[n] == i, sha(n))


def test_exact_dedup_keeps_one_of_repeated_rows(awkward):
    rows = exact_dedup.exact_dedup(awkward).collect()
    assert len(rows) == 7
    same = [r for r in rows if r.text_sha256 == sha("same text here")]
    assert len(same) == 4 and sum(r.kept for r in same) == 1 and {r.keep_id for r in same} == {1}
    blank = [r for r in rows if r.text_sha256 == sha("")]
    assert {r.keep_id for r in blank} == {3} and [r.kept for r in sorted(blank, key=lambda r: r.doc_id or 0)] == [False, True, False]


# ---- 9 quality -------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def judged(spark):
    rng = np.random.default_rng(9)
    rows, labels = [], []
    for i in range(600):
        words = ["".join(rng.choice(list("abcdefgh"), rng.integers(2, 8))) for _ in range(rng.integers(5, 80))]
        good = i % 4 != 0
        if not good:
            words = [w.upper() + "!!" for w in words] if i % 8 else [w + "***" for w in words]
        rows.append((i, " ".join(words) + ".", "en", f"s{i % 5}", None))
        labels.append((i, int(good), 0))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels + [(5000, 1, 0), (None, 0, 0), (7, None, None)], "doc_id long, quality int, toxic int")


def test_ranker_is_right_on_held_out_rows(judged):
    docs, labels = judged
    out = quality.score(docs, quality.train(docs, labels)).join(labels.where("quality is not null"), "doc_id").withColumn("held_out", quality.held_out()).collect()
    held = [r for r in out if r.held_out]
    assert len(held) > 80
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    assert np.mean([r.predicted == r.quality for r in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in out)


def test_the_fit_is_the_least_loss_over_explicit_differences():
    """Plain gradient descent on the differences themselves finds the same strengths, and the quantile is the plain one."""
    rng = np.random.default_rng(3)
    x = np.zeros((300, quality.SHAPES + 4), np.float32)
    x[:, :6] = rng.normal(size=(300, 6))
    x[:, -4:] = rng.normal(size=(300, 4))
    better = x[:, 0] + 0.5 * x[:, 1] - x[:, -1] + rng.normal(0, 0.7, 300) > -0.8
    model = quality.fit_pairs(x, better, pairs=5000, penalty=0.05)
    z = (x - model.mean) / model.spread
    assert np.allclose(model.spread[-4:] * quality.GRAM_SCALE, x[:, -4:].std(0) + 1e-3, atol=1e-4)
    again = np.random.default_rng(7)
    good, bad = again.choice(np.flatnonzero(better), 5000), again.choice(np.flatnonzero(~better), 5000)
    d, w = z[good] - z[bad], np.zeros(z.shape[1])
    for _ in range(4000):
        w += 0.5 * (d.T @ (1 / (1 + np.exp(d @ w))) / len(d) - 0.05 * w)
    assert np.abs(w - model.weights).max() < 1e-3
    s = np.sort(model.strength(x))
    at = int(round((~better).mean() * len(s)))
    assert s[max(0, at - 4)] <= model.threshold <= s[min(len(s) - 1, at + 4)]
    assert np.array_equal(model.scores(x) >= quality.CUT, model.strength(x) >= model.threshold)


def test_words_alone_can_tell_bad_texts():
    rng = np.random.default_rng(4)
    fine, junk = [[f"{c}{i}" for i in range(60)] for c in ("word", "spam")]
    texts = [" ".join(rng.choice(fine + junk[: 60 * bad], 80)) for bad in rng.integers(0, 2, 800)]
    better = np.array(["spam" not in t for t in texts])
    x = np.array([quality.features(t) for t in texts])
    model = quality.fit_pairs(x[:500], better[:500])
    assert ((model.scores(x[500:]) >= quality.CUT) == better[500:]).mean() > 0.97


def test_grams_count_what_they_say():
    text = "Ab ab c ab" * 3
    words = text.lower().encode().split()
    want = np.zeros(quality.WORDS + quality.CHARS)
    h = [xxhash.xxh32_intdigest(w) for w in words]
    for v in h + [(a * 0x9E3779B1 % 2**32) ^ b for a, b in zip(h, h[1:], strict=False)]:
        want[v * 0x85EBCA6B % 2**32 >> 23] += 1
    raw = text.lower().encode()
    for i in range(len(raw) - 2):
        want[quality.WORDS + (int.from_bytes(raw[i : i + 3], "big") * 0xC2B2AE35 % 2**32 >> 23)] += 1
    want[: quality.WORDS] /= want[: quality.WORDS].sum()
    want[quality.WORDS :] /= want[quality.WORDS :].sum()
    assert np.allclose(quality.grams(text), np.sqrt(want)) and not quality.grams("").any() and not quality.grams("a").any() == (not want.any())
    long = "x1 yz " * 400_000  # longer than what is hashed at once
    assert abs((quality.grams(long)[quality.WORDS :] ** 2).sum() - 1) < 1e-9


def test_repeated_ids_are_one_labelled_row(spark, judged):
    docs, labels = judged
    twice = docs.unionByName(docs).unionByName(docs.withColumn("text", F.concat("text", F.lit(" zzz"))))
    a, b = quality.train(docs, labels), quality.train(twice, labels)
    assert np.allclose(a.weights, b.weights) and a.threshold == b.threshold


def test_held_out_labels_are_never_read(judged):
    docs, labels = judged
    flipped = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality.train(docs, labels), quality.train(docs, flipped)
    assert np.array_equal(a.weights, b.weights) and a.threshold == b.threshold


def test_more_rows_than_the_driver_takes_are_all_fitted(spark, judged, monkeypatch):
    """The fit over stored groups finds the least loss over all pairs of each group, and its threshold splits all rows."""
    docs, labels = judged
    monkeypatch.setattr(quality, "GROUP", 150)
    monkeypatch.setattr(quality, "RARER", 8)
    model = quality.train(docs.unionByName(docs.where("doc_id % 7 = 0")), labels, collected=100)
    chosen = {r.doc_id: r.quality > 0 for r in labels.where("quality is not null and doc_id is not null").where(~quality.held_out()).collect()}
    rows = sorted((r.doc_id, r.text) for r in docs.collect() if r.doc_id in chosen)
    better = np.array([chosen[i] for i, _ in rows])
    x = np.array([quality.features(t) for _, t in rows]).astype(np.float16).astype(float)
    assert np.allclose(model.mean, x.mean(0), atol=1e-5) and np.allclose(model.spread[: quality.SHAPES], x.std(0)[: quality.SHAPES] + 1e-3, atol=1e-4)
    groups = -(-len(chosen) // 150)
    part = np.array([r.g for r in spark.createDataFrame([(i,) for i, _ in rows], "doc_id long").coalesce(1).select(F.pmod(F.xxhash64("doc_id"), F.lit(groups)).alias("g")).collect()])
    z = (x - model.mean) / model.spread
    d = np.concatenate([(z[(part == g) & better][:, None] - z[(part == g) & ~better]).reshape(-1, z.shape[1]) for g in range(groups)])
    slope = 0.01 * model.weights - d.T @ (1 / (1 + np.exp(d @ model.weights))) / len(d)
    assert np.abs(slope).max() < 1e-3
    s = np.sort(model.strength(x))
    at = (~better).mean() * (len(s) - 1)
    assert s[int(at) - 6] <= model.threshold <= s[int(at) + 7]
    plain = quality.train(docs, labels)
    assert np.mean((model.scores(x) >= quality.CUT) == (plain.scores(x) >= quality.CUT)) > 0.98


def test_a_rare_label_is_dealt_to_all_groups(spark, judged, monkeypatch):
    docs, labels = judged
    monkeypatch.setattr(quality, "GROUP", 10)
    few = labels.where("quality = 1 or doc_id in (0, 4, 12)")
    model = quality.train(docs, few, collected=100)
    out = quality.score(docs, model).join(labels.where("quality is not null"), "doc_id").collect()
    rank = sorted(out, key=lambda r: r.score)
    assert np.mean([r.quality == 0 for r in rank[:100]]) > 0.9
    assert {r.predicted for r in quality.score(docs, quality.train(docs.limit(0), labels, collected=100)).collect()} == {1}


def test_ranker_without_evidence_rejects_nothing(docs, judged):
    for labels in (judged[1].limit(0), judged[1].where("quality = 1")):
        assert {r.predicted for r in quality.score(docs, quality.train(docs, labels)).collect()} == {1}


# ---- 10 personal data ------------------------------------------------------------------------------------------------


def plain_base(t):
    def luhn(s):
        total = 0
        for k, c in enumerate(reversed(s)):
            d = int(c) * (1 + k % 2)
            total += d - 9 * (d > 9)
        return total % 10 == 0

    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        digits = re.sub("[^0-9]", "", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


HARD = ["a@b.c@d.e x@y", "@a.b", "a@b..c a@b.c.", "x.y+z%@h-i.j-k.l", "a@b@c.d", "..@a.b", "a@b.c.d@e.f", "1.2.3.4.5.6.7.8 256.1.1.1 1.1.1.256 001.002.003.004", "4111-1111 1111-1111 4111111111111111 4111111111111112", "1 2 3 4 5 6 7 8 9 0 1 2 3", "+1 (2) ...9 +12345678 +123456789 +1234567890123456 ++1 23 45 67 89", "é+49 30 1234567é ü@x.y", "1" * 5000, "a" * 5000 + "@", "+" + "1 " * 3000]


def test_base_spans_equal_the_patterns(texts):
    for t in [t or "" for t in texts] + HARD:
        assert [s[:3] for s in pii.base_spans(t)] == plain_base(t)


def test_base_spans_on_random_strings():
    import random

    rng = random.Random(8)
    for _ in range(3000):
        t = "".join(rng.choice("0123456789.@+-() ab%é") for _ in range(rng.randint(0, 60)))
        assert [s[:3] for s in pii.base_spans(t)] == plain_base(t)


def test_found_spans_keep_the_base_and_add_secrets(spark, texts):
    key = "9c8b45435718dcc700c184a7e303cdc64c6a8f7f"
    more = [f'text token = "{key}" and more' for _ in range(20)] + ["plain text with words only"] * 50 + ["hash 1234567890abcdefghij in prose"] * 3
    every = [*texts, *more, *HARD]
    got = by_id(pii.find(spark.createDataFrame(list(enumerate(every)), "doc_id long, text string")))
    for i, t in enumerate(every):
        spans = [(s.kind, s.start, s.end) for s in got[i].spans if s.base]
        assert spans == plain_base(t or "")
        assert [s.kind for s in got[i].spans] == sorted((s.kind for s in got[i].spans), key=pii.KINDS.index)
    at = more[0].index(key)
    assert all(("secret", at, at + 40) in [(s.kind, s.start, s.end) for s in got[len(texts) + k].spans] for k in range(20))


def test_labelers_can_say_no():
    said = {
        ("email", "a@b.com"): 2, ("email", "a@b.c"): 0, ("ip", "8.8.8.8"): 2, ("ip", "010.2.3.4"): 1, ("ip", "203.0.113.9"): 0, ("card", "4111 1111 1111 1111"): 2, ("card", "9111111111111111"): 0,
        ("phone", "+1 555 123 4567"): 2, ("phone", "+999 1234567"): 2, ("phone", "+2111111111"): 2, ("phone", "+8311111111"): 0, ("phone", "555-123-4567"): 0, ("phone", "555-223-4567"): 2,
        ("iban", "DE89370400440532013000"): 2, ("iban", "DE8937040044053201300"): 0, ("iban", "ZZ89370400440532013000"): 0, ("secret", "ghp_16C7e42F292c6912E7710c838347Ae178B4a"): 2, ("secret", "some_long_snake_name_12"): 0,
    }
    assert {k: pii.gazetteer_vote(*k) for k in said} == said
    assert [pii.context_vote("ip", w, True) for w in ("version ", "server at ", "version on host ", "chip ", "hosts: ")] == [0, 2, 2, 1, 2]
    assert pii.context_vote("secret", "nothing ", False) == 0
    assert pii.shape_vote("ssn", "123-00-4567", False) == 0 and pii.shape_vote("iban", "DE89 3704 0044 0532 0130 00", False) == 2


def test_long_and_structured_secrets_are_candidates():
    key, jwt = "a1" * 200, "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NTY3ODkwIn0.dozjgNryP4J3jVmNHl0w5N_XgL0n3I9PlFUP0THsR8U"
    padded = "q83vEjRWeJCrze8SNFZ4kKvN7xI0VniQq83v+jRWeJCrze8SNFY="
    for secret in (key, jwt, "sk-proj-0123456789abcdefghij", padded):
        text = f'token: "{secret}", and on'
        assert [text[a:b] for kind, a, b, _ in pii.candidates(text) if kind == "secret"] == [secret]


def test_expectation_maximisation_equals_a_plain_one_over_single_items():
    rng = np.random.default_rng(8)
    votes = rng.choice(3, (400, 3), p=[0.3, 0.2, 0.5])
    votes[:250] = np.where(rng.random((250, 3)) < 0.8, 2, votes[:250])
    code = votes @ [9, 3, 1]
    each, n = np.unique(code, return_counts=True)
    post, told = pii.expectation_maximisation(np.zeros(len(each), int), each, n)
    q = [min(0.95, max(0.05, sum(v) / 6)) for v in votes]
    for _ in range(50):  # item by item, by the definition
        share = (sum(q) + 1) / (len(q) + 2)
        table = {}
        for c, prior in ((1, (1.1, 1.3, 2.0)), (0, (2.0, 1.3, 1.1))):
            weight = [x if c else 1 - x for x in q]
            for j in range(3):
                for v in range(3):
                    table[c, j, v] = (prior[v] + sum(x for x, vs in zip(weight, votes, strict=True) if vs[j] == v)) / (sum(prior) + sum(weight))
        new = []
        for vs in votes:
            yes, no = share, 1 - share
            for j, v in enumerate(vs):
                yes, no = yes * table[1, j, v], no * table[0, j, v]
            new.append(yes / (yes + no))
        q = new
    assert np.allclose(q, post[np.searchsorted(each, code)], atol=1e-9)
    assert np.allclose(told["email"], [table[1, j, 2] for j in range(3)], atol=1e-4)


def test_the_span_classifier_follows_its_posteriors():
    patterns = [("secret", v, 6, d, 40) for v in range(27) for d in (2, 5)]
    model = pii.train(patterns)
    post, _ = pii.expectation_maximisation(np.full(27, pii.KINDS.index("secret")), np.arange(27), np.full(27, 80))
    accepted = model.accepts([pii.KINDS.index("secret")] * 27, np.arange(27), [6] * 27, [2] * 27)
    post = post.round(model.TIE)
    assert (post == 0.5).any() and (accepted == (post >= 0.5)).all()  # ties are kept


def test_ties_are_kept_whatever_the_last_bits():
    for bit in (-1e-13, 0.0, 1e-13):
        w = np.zeros(len(pii.KINDS) + 32)
        w[-1] = bit
        assert pii.SpanModel(w, {}).accepts([0], [0], [1], [1]).all()
    w[-1] = -1e-6
    assert not pii.SpanModel(w, {}).accepts([0], [0], [1], [1]).any()


def test_random_keys_are_candidates_as_a_whole():
    rng = np.random.default_rng(5)
    letters = np.array(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"))
    for _ in range(2000):
        key = "".join(rng.choice(letters, 120))
        text = f"key = {key} and on"
        base = [(a, b) for _, a, b, _ in pii.base_spans(text)]
        assert base or (6, 126) in [(a, b) for kind, a, b, _ in pii.candidates(text) if kind == "secret"]


def test_redaction_masks_and_keeps_the_rest(spark):
    rows = [(1, "write a@b.c now", "x", 1), (2, None, "y", None), (3, "none", None, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string, found int")
    got = {r.doc_id: r for r in pii.redact(df).collect()}
    assert got[1] == (1, "write [EMAIL] now", "x", 1) and got[2].text is None and got[3] == (3, "none", None, 3)
    assert pii.masked("0123456789", [("ip", 2, 6, True), ("card", 4, 8, True)]) == "01[IP]89"


# ---- awkward and empty tables ----------------------------------------------------------------------------------------

EVERY = {
    "edited_counts": lambda d: token_counts.edited_counts(d, RANKS, public_tokenizers.PATTERN, queries.masking_edits),
    "remove_repeats": substrings.remove_repeats,
    "token_trees": lambda d: token_counts.token_trees(d, RANKS, public_tokenizers.PATTERN),
    "encode_decode": lambda d: bpe.encode_decode(d, RANKS, public_tokenizers.PATTERN),
    "dedup_lines": line_dedup.dedup_lines,
    "text_images": media.text_images,
    "pack": lambda d: packing.pack(d, queries.encoder()),
    "near_classes": near_dedup.near_classes,
    "exact_dedup": exact_dedup.exact_dedup,
    "score": lambda d: quality.score(d, quality.fit_pairs(np.zeros((0, len(quality.features("")))), np.zeros(0, bool))),
    "find": pii.find,
    "redact": pii.redact,
}


@pytest.mark.parametrize("name", EVERY)
def test_awkward_tables_give_a_row_for_each_row(name, awkward):
    rows = EVERY[name](awkward).collect()
    assert len(rows) == 7
    assert sum(r.doc_id is None for r in rows) == 2


@pytest.mark.parametrize("name", EVERY)
def test_empty_tables_give_no_rows(name, empty):
    assert EVERY[name](empty).collect() == []


def test_rank_files_are_base64(tmp_path):
    path = tmp_path / "ranks"
    path.write_bytes(b"\n".join(base64.b64encode(bytes([i])) + b" %d" % i for i in range(256)))
    assert bpe_ranks(str(path))[b"\xff"] == 255


@pytest.mark.parametrize("few", [0, 20, 200_000])
def test_components_follow_chains(spark, monkeypatch, few):
    monkeypatch.setattr(near_dedup, "FEW", few)
    rng = np.random.default_rng(12)
    edges = [(f"{i:03d}", f"{i + 1:03d}") for i in range(100) if i % 9] + [("500", "501"), ("501", "502"), ("502", "500"), ("700", "700")]
    edges = [edges[i] for i in rng.permutation(len(edges))]
    got = {bytes(r.node).decode(): bytes(r.label).decode() for r in near_dedup.components(spark.createDataFrame([(a.encode(), b.encode()) for a, b in edges], "a binary, b binary"), []).collect()}
    up = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in range(200):
        for a, b in edges:
            if a != b:
                up[a] = up[b] = min(up[a], up[b])
    assert got == up


def test_only_ascii_blanks_make_a_blank_line(spark):
    rows = [(i, "\u2028\n\u0085\n \t\r\n\x0b", f"s{i}") for i in range(12)]
    got = by_id(line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, source string")))
    assert got[0].text == rows[0][1] and got[1].text == " \t\r\n\x0b" and got[1]["__lines"] == 2
