"""The operators' queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, byte_bpe, jaccard_join, language_id, near_dedup, neighbours, packing, prefix_trie, quality_rules, secret_scan, substring_dedup, token_counts, toxicity
from .common import table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.group(table(spark, sf_dir, "documents"), 85)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.histogram(table(spark, sf_dir, "documents"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digest(table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeats(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.digest(table(spark, sf_dir, "documents"))


def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.digest(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_language_id, op2_near_dedup, op3_token_counts, op4_byte_bpe, op5_substring_dedup, op6_toxicity, op7_neighbours, op8_packing, op9_secret_scan, op10_quality_rules,
        op11_jaccard_join, op12_prefix_trie, op13_tokenizer_alignment,
    )
}
WORD = r"[^\x20\x09-\x0D]+"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL: dict[str, str] = {
    "op10_quality_rules": rf"""
    with d as (select row_number() over () as r, doc_id, source as host, coalesce(text, '') as text from documents),
    w as (select r, unnest(regexp_extract_all(text, '{WORD}')) as word, generate_subscripts(regexp_extract_all(text, '{WORD}'), 1) as i from d),
    per_word as (select r, count(*) as n_words, sum(length(word)) as word_chars from w group by r),
    three as (select r, i, count(*) over (partition by r, word, w2, w3) as c from (select r, i, word, lead(word) over (partition by r order by i) as w2, lead(word, 2) over (partition by r order by i) as w3 from w) where w3 is not null),
    again as (select r, count(distinct i + k) as n_repeat_words from three cross join (values (0), (1), (2)) t(k) where c > 1 group by r),
    lines as (select r, host, text, line, {LOWER.format("line")} as low from (select *, unnest(string_split(text, chr(10))) as line from d) where regexp_matches(line, '{WORD}')),
    copies as (select r, count(*) - count(distinct line) as n_dup_lines from lines group by r),
    normal as (select r, host, text, array_to_string(regexp_extract_all(low, '{WORD}'), ' ') as line, len(regexp_extract_all(low, '{WORD}')) as words from lines),
    boilerplate as (select host, line from normal group by host, line having count(distinct text) > {quality_rules.MAX_DOCS}),
    gone as (select r, sum(words) as removed_words from normal n join boilerplate b on n.line = b.line and n.host is not distinct from b.host group by r),
    found as (select doc_id, coalesce(n_words, 0)::bigint as n_words, coalesce(word_chars, 0)::bigint as word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
        coalesce(n_dup_lines, 0)::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words, coalesce(removed_words, 0)::bigint as removed_words
        from d left join per_word using (r) left join copies using (r) left join again using (r) left join gone using (r))
    select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
        not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and 100 * removed_words <= {quality_rules.MAX_REMOVED_PERCENT} * n_words as kept from found
    """,
    "op11_jaccard_join": rf"""
    with recursive words as (select row_number() over () as r, doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '{WORD}') as w from documents),
    sets as (select distinct r, doc_id, unnest(case when len(w) >= 3 then list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as g from words),
    sizes as (select r, doc_id, count(*) as n from sets group by r, doc_id),
    pairs as (select x.r as a, y.r as b, count(*) as k from sets x join sets y on x.g = y.g and x.r < y.r group by x.r, y.r),
    links as (select x.doc_id as a, y.doc_id as b from pairs p join sizes x on x.r = p.a join sizes y on y.r = p.b where 100 * k >= {jaccard_join.PERCENT} * (x.n + y.n - k)),
    edges as (select a, b from links union select b, a from links),
    reached as (select a as x, a as y from edges union select x, b from reached join edges on a = y),
    least as (select x, min(y) as component_id from reached group by x)
    select w.doc_id, coalesce(n, 0)::bigint as n_shingles, coalesce(component_id, w.doc_id) as component_id from words w left join sizes s on s.r = w.r left join least on x = w.doc_id
    """,
    "op12_prefix_trie": r"""
    with recursive turns as (select conv_id as c, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as i, coalesce(role, '') as role, coalesce(text, '') as text
        from conversations where conv_id is not null),
    convs as (select c, n, xor(crc, 4294967295) % 6 as h from (select c, count(*) as n, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(c::varchar, ''), lambda x: ascii(x)::bigint)),
        lambda acc, b: list_reduce(list_prepend(xor(acc, b), [1::bigint, 2, 3, 4, 5, 6, 7, 8]), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))) as crc from turns group by c)),
    plans as (select a.c, a.n, a.h, a.c - a.c % 100 as base, least(a.h, coalesce(b.n, 0)) as taken from convs a left join convs b on b.c = a.c - a.c % 100),
    rebuilt as (select p.c, t.i as d, t.role, t.text from plans p join turns t on t.c = p.base and t.i <= p.taken
        union all select p.c, p.taken + t.i - p.h, t.role, t.text from plans p join turns t on t.c = p.c and t.i > p.h),
    members as (select c, d, length(text) as chars, list(struct_pack(r := role, x := text)) over (partition by c order by d) as node from rebuilt union all select c, 0, 0, [] from plans),
    lengths as (select c, max(d) as len from members group by c),
    nodes as (select node, d, min(c) as conv_id, count(*) as n_convs, any_value(chars) as chars, string_agg(case when d = len then c::varchar end, ',' order by c) as ends from members join lengths using (c) group by node, d),
    named as (select *, list_slice(node, 1, d - 1) as parent from nodes),
    kids as (select parent, d - 1 as d, count(*) as k from named where d > 0 group by parent, d),
    full_nodes as (select n.*, coalesce(k, 0) as k from named n left join kids on kids.parent = n.node and kids.d = n.d),
    below as (select m.node, m.d, sum((f.k = 0)::bigint) as n_leaves, sum((f.n_convs - 1) * f.chars) as saved from full_nodes f join members m on m.c = f.conv_id and m.d <= f.d group by m.node, m.d)
    select f.conv_id, f.d::bigint as depth, p.conv_id as parent_conv_id, f.n_convs::bigint as n_convs, f.k::bigint as n_children, b.n_leaves::bigint as n_leaves, b.saved::bigint as saved_tokens, sha256(coalesce(f.ends, '')) as ends_sha256
    from full_nodes f join below b on b.node = f.node and b.d = f.d left join full_nodes p on f.d > 0 and p.node = f.parent and p.d = f.d - 1
    """,
}
