"""One query for each operator of this subpackage, over whole tables and with production parameters."""

from __future__ import annotations

import re

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm import bpe, conversation_trie, exact_dedup, language, line_dedup, media, near_dedup, packing, pii, quality, substrings, token_counts, vector_codes
from lexiloom.llm.common import stored

RANKS, TOKENIZER = "byte_bpe_50k.tiktoken", "byte_bpe_50k.json"
END_OF_TEXT = 2


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def masking_edits(text: str) -> list[tuple[int, int, str]]:
    """The edits that op1 counts: each run of digits becomes 0, and a line feed is added at the end."""
    return [(m.start(), m.end(), "0") for m in re.finditer("[0-9]+", text)] + [(len(text), len(text), "\n")]


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees are built and kept once; the edits read them back."""
    how = public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    trees = stored(token_counts.token_trees(documents(spark, sf_dir), *how), "trees", compression="zstd")
    return token_counts.edited_counts(trees, *how, masking_edits, leaves=True)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.encode_decode(documents(spark, sf_dir), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(documents(spark, sf_dir).select("doc_id", "source", "text"))
    return out.select("doc_id", F.col("__lines").alias("n_lines"), F.col("__removed").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = media.media_columns(media.text_images(documents(spark, sf_dir)), ["doc_id", "n_bytes", "media"])
    return out.select(
        "doc_id", "n_bytes", F.length("samples").cast("long").alias("payload_bytes"), F.sha2("samples", 256).alias("payload_sha256"), F.crc32(F.expr("substring(samples, -32)")).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), F.col("dhash").alias("feature"), F.sha2("tile", 256).alias("tile_sha256"),
    )


def encoder() -> packing.Encoder:
    return packing.Encoder(public_tokenizers.path(TOKENIZER), public_tokenizers.path(RANKS), public_tokenizers.PATTERN, END_OF_TEXT)


def packed(docs: DataFrame) -> DataFrame:
    return packing.pack(docs, encoder()).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(documents(spark, sf_dir))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_classes(documents(spark, sf_dir))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, model).select("doc_id", quality.held_out().alias("held_out"), "score", "predicted")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    def named(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["base"])
    counts = [count(kind) for kind in ("email", "ip", "card", "phone")]
    return pii.find(documents(spark, sf_dir)).select("doc_id", *counts, F.sha2(named(base), 256).alias("base_sha256"), named(F.col("spans")).alias("spans"))


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = language.train(docs.where(~quality.held_out()))
    return language.predict(docs, model).select("doc_id", quality.held_out().alias("held_out"), "lang_pred", "score")


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = vector_codes.compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return vector_codes.with_label_error(coded).select("vec_id", "code", "error", "label_error", F.lit(coded.digest).alias("codebooks_sha256"))


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_substring_dedup, op3_byte_bpe, op4_line_dedup, op5_media_columns, op6_best_fit_packing, op7_near_dedup, op8_exact_dedup, op9_quality_classifier, op10_pii, op11_language_id, op12_conversation_trie, op13_vector_codes)}
WORDS_SQL = "select r, unnest(ws) as w, generate_subscripts(ws, 1) as pos, len(ws) as n from t"
#: crc32 of a decimal number, byte by byte over the table of remainders.
CRC_SQL = "xor(4294967295, list_reduce(list_transform(string_split(c::varchar, ''), lambda ch: ascii(ch)::bigint), lambda crc, b: xor(crc >> 8, crc_table[(xor(crc, b) & 255) + 1]), 4294967295::bigint))"
CRC_TABLE_SQL = "(select list_transform(range(256), lambda n: list_reduce(range(8), lambda crc, i: case when crc & 1 = 1 then xor(3988292384::bigint, crc >> 1) else crc >> 1 end, n::bigint)) as crc_table)"
_SQUARE = "sum((v.x - b.x) * (v.x - b.x))"


def _lloyd_sql() -> str:
    """The rounds: books0, then near0 and books1 of it, and so on to the last assignment."""
    out = []
    for r in range(vector_codes.ROUNDS + 1):
        out.append(f"far{r} as (select v.r, v.part, b.entry, {_SQUARE} as far from cut v join books{r} b on b.part = v.part and b.place = v.place group by v.r, v.part, b.entry), near{r} as materialized (select r, part, min((far, entry)) as best from far{r} group by r, part)")
        if r < vector_codes.ROUNDS:
            out.append(f"mean{r} as (select v.part, (n.best)[2] as entry, v.place, floor(sum(v.x)::double / count(*))::bigint as x from near{r} n join cut v on v.r = n.r and v.part = n.part group by all), books{r + 1} as materialized (select b.part, b.entry, b.place, coalesce(m.x, b.x) as x from books{r} b left join mean{r} m using (part, entry, place))")
    return ", ".join(out)


ORACLES = {
    "op2_substring_dedup": f"""
        with t as materialized (select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as ws from documents),
        words as ({WORDS_SQL}),
        starts as (select r, pos, n, w, string_agg(w, ' ') over (partition by r order by pos rows between current row and {substrings.WINDOW - 1} following) as seq from words),
        judged as (select r, pos, w, pos <= n - {substrings.WINDOW - 1} and count(*) over (partition by seq, pos <= n - {substrings.WINDOW - 1}) > 1 as again from starts),
        covered as (select r, pos, w, bool_or(again) over (partition by r order by pos rows between {substrings.WINDOW - 1} preceding and current row) as gone from judged),
        kept as (select r, count(*) filter (gone) as n_removed, string_agg(w, ' ' order by pos) filter (not gone) as kept from covered group by r)
        select doc_id, len(ws) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from t left join kept using (r)""",
    "op4_line_dedup": f"""
        with lines as (select doc_id, source, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from documents where text is not null),
        inked as (select * from lines where not regexp_full_match(line, '[\\x20\\x09-\\x0D]*')),
        wide as (select line, min(row(doc_id, pos)) as first from inked group by line having count(distinct coalesce(source, chr(1))) >= {line_dedup.SITES}),
        gone as (select s.doc_id, s.pos from inked s join wide w on s.line = w.line where row(s.doc_id, s.pos) <> w.first),
        kept as (select l.doc_id, string_agg(l.line, chr(10) order by l.pos) as text from lines l anti join gone g on l.doc_id = g.doc_id and l.pos = g.pos group by l.doc_id),
        n as (select doc_id, count(*) as n_lines from inked group by doc_id), r as (select doc_id, count(*) as n_removed from gone group by doc_id)
        select d.doc_id, coalesce(n_lines, 0) as n_lines, coalesce(n_removed, 0) as n_removed, sha256(coalesce(k.text, '')) as kept_sha256
        from documents d left join n using (doc_id) left join r using (doc_id) left join kept k using (doc_id)""",
    "op7_near_dedup": f"""
        with recursive t as materialized (select row_number() over () as r, text, least, copies, regexp_extract_all(text, '[^\\x09-\\x0D\\x1C-\\x20\\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]+') as ws
            from (select coalesce(text, '') as text, min(doc_id) as least, count(*) as copies from documents group by all)),
        words as ({WORDS_SQL}),
        starts as (select r, pos, n, string_agg(w, ' ') over (partition by r order by pos rows between current row and {near_dedup.SHINGLE - 1} following) as s from words),
        counted as materialized (select r, s, count(*) as c from starts where pos <= greatest(n - {near_dedup.SHINGLE - 1}, 1) group by r, s),
        sizes as materialized (select r, count(*) as n, sum(c) as total, max(c) as most from counted group by r),
        common as materialized (select a.r as x, b.r as y, count(*) as n, sum(least(a.c / p.total, b.c / q.total)) as shared from counted a join counted b on a.s = b.s and a.r < b.r join sizes p on p.r = a.r join sizes q on q.r = b.r group by a.r, b.r),
        pairs as materialized (select x, y, c.n / (a.n + b.n - c.n) as plain, shared, greatest(a.most, b.most) as most from common c join sizes a on a.r = x join sizes b on b.r = y),
        -- The probability Jaccard similarity is at most the shared probability, so few pairs need it.
        unsure as (select x, y from pairs where plain < {near_dedup.SIMILARITY} and most > 1 and shared >= {near_dedup.SIMILARITY} - 1e-6),
        both_ as (select u.x, u.y, a.s, a.c::double as cx, b.c::double as cy, p.total - sum(a.c) over (partition by u.x, u.y) as rest_x, q.total - sum(b.c) over (partition by u.x, u.y) as rest_y
            from unsure u join counted a on a.r = u.x join counted b on b.r = u.y and b.s = a.s join sizes p on p.r = u.x join sizes q on q.r = u.y),
        weighted as (select x, y, 1 / ((rest_x + sum(cx) over (partition by x, y order by cx / cy, s rows between current row and unbounded following)) / cx + (rest_y + coalesce(sum(cy) over (partition by x, y order by cx / cy, s rows between unbounded preceding and 1 preceding), 0)) / cy) as part from both_),
        links as (select x, y from pairs where plain >= {near_dedup.SIMILARITY} union all select x, y from weighted group by x, y having sum(part) >= {near_dedup.SIMILARITY}),
        edges as materialized (select x, y from links union all select y, x from links),
        reach as (select r as a, r as b from t union select reach.a, edges.y from reach join edges on edges.x = reach.b),
        heads as materialized (select a as r, min(b) as head from reach group by a),
        classes as (select head, min(least) as class_id, sum(copies)::bigint as class_size from heads join t using (r) group by head)
        select d.doc_id, c.class_id, c.class_size from documents d join t on t.text = coalesce(d.text, '') join heads using (r) join classes c using (head)""",
    "op8_exact_dedup": """
        with t as (select doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') as norm from documents),
        g as (select norm, min(doc_id) as keep_id, count(*) as group_size from t group by norm)
        select t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id as kept, sha256(t.norm) as text_sha256 from t join g on t.norm = g.norm""",
    "op12_conversation_trie": f"""
        with turns as (select conv_id as c, conv_id - conv_id % {conversation_trie.FAMILY} as base, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn nulls first, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) as pos from conversations where conv_id is not null),
        convs as (select distinct c, base, {CRC_SQL} % {conversation_trie.HEADS} as h from (select distinct c, base from turns), {CRC_TABLE_SQL}),
        whole as (select v.c, t.pos, t.role, t.text from convs v join turns t on t.c = v.base and t.pos <= v.h union all select v.c, (select count(*) from turns b where b.c = v.base and b.pos <= v.h) + t.pos - v.h, t.role, t.text from convs v join turns t on t.c = v.c and t.pos > v.h),
        paths as materialized (select c, pos as depth, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) as words, string_agg(sha256(length(role) || ':' || role || text), '' order by pos) over (partition by c order by pos rows unbounded preceding) as path from whole union all select c, 0, 0, '' from convs),
        lengths as (select c, max(depth) as len from paths group by c),
        nodes as materialized (select path, any_value(depth) as depth, any_value(words) as words, count(*) as n_convs, min(c) as conv_id, string_agg(c::varchar, ',' order by c) filter (len = depth) as ends from paths join lengths using (c) group by path),
        kids as (select left(path, length(path) - 64) as path, count(*) as n_children from nodes where depth > 0 group by 1),
        full_ as materialized (select n.*, coalesce(k.n_children, 0) as n_children from nodes n left join kids k using (path)),
        sums as (select a.path, sum((b.n_children = 0)::int)::bigint as n_leaves, sum((b.n_convs - 1) * b.words)::bigint as saved_tokens from full_ a join full_ b on starts_with(b.path, a.path) group by a.path)
        select f.conv_id, f.depth, p.conv_id as parent_conv_id, f.n_convs, f.n_children, s.n_leaves, s.saved_tokens, sha256(coalesce(f.ends, '')) as ends_sha256
        from full_ f join sums s using (path) left join nodes p on f.depth > 0 and p.path = left(f.path, length(f.path) - 64)""",
    "op13_vector_codes": f"""
        with kept as (select row_number() over (order by vec_id) as r, vec_id, label, embedding as v from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        cut as materialized (select r, (i - 1) // (len(v) // {vector_codes.PARTS}) as part, (i - 1) % (len(v) // {vector_codes.PARTS}) as place, floor({vector_codes.SCALE} * v[i]::double)::bigint as x from (select r, v, unnest(range(1, len(v) + 1)) as i from kept)),
        books0 as (select part, r - 1 as entry, place, x from cut where r <= {vector_codes.ENTRIES}), {_lloyd_sql()},
        coded as (select k.vec_id, k.label, string_agg(printf('%02x', (n.best)[2]), '' order by n.part) as code, sum((n.best)[1])::bigint as error from near{vector_codes.ROUNDS} n join kept k using (r) group by k.r, k.vec_id, k.label)
        select vec_id, code, error, sum(error) over (partition by label)::bigint as label_error, (select sha256(string_agg(x::varchar, ',' order by part, entry, place)) from books{vector_codes.ROUNDS}) as codebooks_sha256 from coded""",
}
