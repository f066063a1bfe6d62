"""One query per operator over the given tables, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from habitatq.llm import (
    collocations, language_id, license_rules, packing, pairwise_quality, phrase_automata, positional_index, prefix_hashes, prefix_trie,
    quality_rules, simhash, suffix_array, url_filter,
)

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn: Callable) -> Callable:
    REGISTRY[fn.__name__] = fn
    return fn


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


@query
def op1_url_filter(spark, folder):
    return url_filter.filter_pages(table(spark, folder, "pages"))


@query
def op2_best_fit_packing(spark, folder):
    return packing.pack(table(spark, folder, "documents"), tokenizer)


@query
def op3_quality_rules(spark, folder):
    return quality_rules.rules(table(spark, folder, "documents"))


@query
def op4_simhash_near_dedup(spark, folder):
    return simhash.near_duplicates(table(spark, folder, "documents"))


@query
def op5_license_rules(spark, folder):
    return license_rules.scan(table(spark, folder, "documents"))


@query
def op6_repeated_phrases(spark, folder):
    return phrase_automata.without_repeats(table(spark, folder, "documents"))


@query
def op7_decontaminate(spark, folder):
    return positional_index.decontaminate(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op8_pairwise_quality(spark, folder):
    return pairwise_quality.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op9_suffix_array_dedup(spark, folder):
    return suffix_array.repeated_passages(table(spark, folder, "documents"))


@query
def op10_language_id(spark, folder):
    return language_id.identify(table(spark, folder, "documents"))


@query
def op11_collocations(spark, folder):
    return collocations.mine(table(spark, folder, "documents"))


@query
def op12_prefix_trie(spark, folder):
    return prefix_trie.trie(table(spark, folder, "conversations"))


@query
def op13_prefix_fingerprints(spark, folder):
    return prefix_hashes.with_edited(table(spark, folder, "documents"))


_WINDOWS = """
w as (select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \\t-\\r]+'), lambda x: x <> '') as ws from documents),
win as (select doc_id, p, array_to_string(list_slice(ws, p + 1, p + 50), ' ') as seq
        from (select doc_id, ws, unnest(range(0, len(ws) - 49)) as p from w)),
least as (select seq, min(doc_id) as m from win group by seq),
hit as (select doc_id, p, m from win join least using (seq) where m < doc_id)
"""

SQL["op5_license_rules"] = license_rules.sql()

SQL["op6_repeated_phrases"] = f"""with {_WINDOWS},
cov as (select distinct doc_id, p + k as i from hit cross join (select unnest(range(0, 50)) as k)),
word as (select doc_id, unnest(ws) as x, unnest(range(0, len(ws))) as i from w),
kept as (select doc_id, string_agg(x, ' ' order by i) as body from word anti join cov using (doc_id, i) group by doc_id),
gone as (select doc_id, count(*) as n from cov group by doc_id)
select w.doc_id, cast(len(ws) as bigint) as n_words, cast(coalesce(n, 0) as bigint) as n_removed,
       sha256(coalesce(body, '')) as kept_sha256
from w left join kept using (doc_id) left join gone using (doc_id)"""

SQL["op7_decontaminate"] = """with
low as (select 'd' as kind, doc_id as id, text from documents union all select 'b', item_id, text from benchmark),
w as (select kind, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as ws from low),
item as (select distinct id as item_id, n, array_to_string(list_slice(ws, p + 1, p + n), ' ') as seq
         from (select id, ws, least(10, len(ws)) as n, unnest(range(0, len(ws) - least(10, len(ws)) + 1)) as p from w where kind = 'b' and len(ws) > 0)),
size as (select distinct n from item),
win as (select id as doc_id, p, n, array_to_string(list_slice(ws, p + 1, p + n), ' ') as seq
        from (select id, ws, n, unnest(range(0, len(ws) - n + 1)) as p from w cross join size where kind = 'd')),
hit as (select doc_id, p, win.n, item_id from win join item on win.seq = item.seq and win.n = item.n),
cov as (select doc_id, count(distinct p + k) as n_hit from (select doc_id, p, unnest(range(0, n)) as k from hit) group by doc_id),
its as (select doc_id, count(*) as n_items, string_agg(name, ',' order by name) as names
        from (select distinct doc_id, cast(item_id as varchar) as name from hit) group by doc_id)
select w.id as doc_id, cast(len(ws) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
       cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from w left join cov on cov.doc_id = w.id left join its on its.doc_id = w.id where kind = 'd'"""

SQL["op9_suffix_array_dedup"] = f"""with {_WINDOWS},
mark as (select *, case when p > lag(p) over (partition by doc_id order by p) + 50 or lag(p) over (partition by doc_id order by p) is null
         then 1 else 0 end as fresh from hit),
run as (select *, sum(fresh) over (partition by doc_id order by p) as r from mark)
select doc_id, cast(min(p) as bigint) as first_word, cast(max(p) + 50 - min(p) as bigint) as n_words, arg_min(m, p) as source_doc_id
from run group by doc_id, r"""



SQL["op11_collocations"] = """with
piece as (select lang, list_filter(string_split_regex(piece, '[ \\t]+'), lambda x: x <> '') as ws
          from (select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\n-\\r]')) as piece from documents)),
size as (select lang, sum(len(ws)) as n from piece group by lang),
start as (select lang, ws, unnest(range(1, len(ws) + 1)) as i from piece),
gram as (select lang, k, array_to_string(ws[i:i + k - 1], ' ') as phrase, count(*) as f
         from (select lang, ws, i, unnest(range(1, least(5, len(ws) - i + 1) + 1)) as k from start) group by lang, k, phrase having count(*) >= 100),
part as (select lang, phrase, k, f, string_split(phrase, ' ') as ws, unnest(range(1, k)) as cut from gram where k > 1),
cut as (select part.lang, part.phrase, part.k, part.f as a, part.cut, l.f as l, r.f as r, size.n,
               (cast(1000 as hugeint) * part.f * size.n) // (cast(l.f as hugeint) * r.f) as score
        from part join gram l on l.lang = part.lang and l.phrase = array_to_string(part.ws[1:part.cut], ' ')
        join gram r on r.lang = part.lang and r.phrase = array_to_string(part.ws[part.cut + 1:part.k], ' ') join size on size.lang = part.lang),
best as (select * from cut qualify row_number() over (partition by lang, phrase order by score, cut) = 1),
free as (select * from best b where not exists (select 1 from gram g where g.lang = b.lang and g.k > b.k and 100 * g.f >= 100 * b.a
         and contains(' ' || g.phrase || ' ', ' ' || b.phrase || ' ')))
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, cast(a as bigint) as a, cast(l as bigint) as l,
       cast(r as bigint) as r, cast(n as bigint) as n, cast(score as bigint) as score
from free qualify row_number() over (partition by lang order by score desc, a desc, phrase) <= 2000"""

SQL["op12_prefix_trie"] = """with
byte as (select list_transform(range(256), lambda b: list_reduce(list_prepend(b, [0, 0, 0, 0, 0, 0, 0, 0]),
         lambda x, i: case when x % 2 = 1 then xor(3988292384, x >> 1) else x >> 1 end)) as crc),
turn as (select conv_id, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn nulls first,
         md5(strlen(coalesce(role, '')) || ' ' || coalesce(role, '') || coalesce(text, ''))) as ord from conversations where conv_id is not null),
size as (select conv_id, count(*) as n from turn group by conv_id),
plan as (select conv_id, n, conv_id - conv_id % 5 as lender, xor(4294967295, list_reduce(list_prepend(4294967295,
         list_transform(string_split(cast(conv_id as varchar), ''), lambda c: cast(ascii(c) as bigint))),
         lambda x, c: xor(x >> 8, crc[1 + xor(x, c) % 256]))) % 9 as h from size cross join byte),
built as (select plan.conv_id, ord as d, role, text from plan join turn on turn.conv_id = lender and ord <= h
          union all select plan.conv_id, ord - h + least(h, coalesce(l.n, 0)), role, text from plan join turn using (conv_id) left join size l on l.conv_id = lender where ord > h),
seq as (select plan.conv_id, coalesce(turns, []) as turns from plan left join
        (select conv_id, list({'role': role, 'text': text} order by d) as turns from built group by conv_id) using (conv_id)),
member as (select conv_id, len(turns) as n, d, turns[1:d] as path from (select conv_id, turns, unnest(range(0, len(turns) + 1)) as d from seq)),
node as (select path, d, min(conv_id) as node, count(*) as n_convs, case when d = 0 then 0 else strlen(path[d].text) end as bytes from member group by path, d),
spot as (select member.conv_id, n, d, node from member join node using (path, d)),
tree as (select node.node, node.d, up.node as up, node.n_convs, (node.n_convs - 1) * node.bytes as saved
         from node left join node up on up.d = node.d - 1 and up.path = node.path[1:node.d - 1]),
kids as (select up as node, d - 1 as d, count(*) as k from tree where d > 0 group by up, d),
under as (select distinct a.node, a.d, b.node as sub, b.d as sub_d from spot a join spot b on a.conv_id = b.conv_id and b.d >= a.d),
total as (select under.node, under.d, sum(saved) as saved, sum(case when k is null then 1 else 0 end) as leaves
          from under join tree on tree.node = sub and tree.d = sub_d left join kids on kids.node = sub and kids.d = sub_d group by under.node, under.d),
ends as (select node, d, string_agg(cast(conv_id as varchar), ',' order by conv_id) as ids from spot where d = n group by node, d)
select tree.node as conv_id, tree.d as depth, up as parent_conv_id, n_convs, cast(coalesce(k, 0) as bigint) as n_children, cast(leaves as bigint) as n_leaves,
       cast(total.saved as bigint) as saved_tokens, sha256(coalesce(ids, '')) as ends_sha256
from tree join total on total.node = tree.node and total.d = tree.d left join kids on kids.node = tree.node and kids.d = tree.d
left join ends on ends.node = tree.node and ends.d = tree.d"""
