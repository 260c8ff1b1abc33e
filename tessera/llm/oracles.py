"""DuckDB SQL of the operators that SQL can express, over whole tables and texts."""

from __future__ import annotations

from tessera.llm.chat import SQL as CHAT

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_LETTERS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_SPACED = r"'[^\x20\x09-\x0D]+'"

SHARDING = """
with d as (select *, ('0x' || substr(md5(coalesce(source, '')), 1, 2))::int % 4 as arrival from documents),
n as (select a, (select count(*) from d where arrival <= a) as rows_so_far from range(4) t(a))
select doc_id, length(text) as n_chars, sha256(text) as text_sha256, true as shard_ok, (select string_agg(rows_so_far, ',' order by a) from n) as version_rows, (select count(*) from documents) as store_rows, 0::bigint as full_tiers from documents
"""

DECONTAMINATE = f"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all({_LOWER}, {_LETTERS}) as w from documents),
b as (select item_id::varchar as item, regexp_extract_all({_LOWER}, {_LETTERS}) as w from benchmark),
bi as (select item, w, least(10, len(w)) as k, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) as i from b where len(w) > 0),
bw as (select distinct item, k, array_to_string(list_slice(w, i, i + k - 1), ' ') as g from bi),
di as (select r, w, k, unnest(generate_series(1, len(w) - k + 1)) as i from d, (select distinct k from bw) where len(w) >= k),
hit as (select r, item, i, di.k from di join bw on di.k = bw.k and array_to_string(list_slice(w, i, i + di.k - 1), ' ') = g),
covered as (select r, count(distinct p) as n_hit from (select r, unnest(generate_series(i, i + k - 1)) as p from hit) group by r),
said as (select r, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct r, item from hit) group by r)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join covered using (r) left join said using (r)
"""

SUBSTRINGS = f"""
with d as (select row_number() over (order by doc_id nulls first, text) as r, doc_id, regexp_extract_all(coalesce(text, ''), {_SPACED}) as w from documents),
i as (select r, w, unnest(generate_series(1, len(w) - 19)) as i from d where len(w) >= 20),
n as (select r, i, row_number() over (partition by array_to_string(list_slice(w, i, i + 19), ' ') order by r, i) as n from i),
gone as (select distinct r, unnest(generate_series(i, i + 19)) as p from n where n > 1),
word as (select r, doc_id, unnest(w) as word, generate_subscripts(w, 1) as p from d),
kept as (select r, count(g.p) as n_removed, string_agg(word, ' ' order by word.p) filter (where g.p is null) as kept from word left join gone g using (r, p) group by r)
select doc_id, len(w) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from d left join kept using (r)
"""

JACCARD = f"""
with recursive d as (select doc_id, regexp_extract_all({_LOWER}, {_SPACED}) as w from documents),
i as (select doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) as i from d where len(w) > 0),
s as (select distinct doc_id, array_to_string(list_slice(w, i, i + 4), ' ') as g from i),
n as (select doc_id, count(*) as n from s group by 1),
pair as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
link as (select x, y from pair join n a on a.doc_id = x join n b on b.doc_id = y where 100 * c >= 75 * (a.n + b.n - c)),
both_ways as (select x, y from link union select y, x from link),
reach as (select x, y from both_ways union select reach.x, both_ways.y from reach join both_ways on reach.y = both_ways.x)
select doc_id, coalesce(n, 0) as n_shingles, least(doc_id, least_y) as component_id from d left join n using (doc_id) left join (select x as doc_id, min(y) as least_y from reach group by 1) using (doc_id)
"""

COLLOCATIONS = rf"""
with p as (select coalesce(lang, 'und') as lang, unnest(string_split_regex({_LOWER}, '[.,;:!?\x0A-\x0D]')) as piece from documents),
w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from p),
n as (select lang, sum(len(w))::bigint as n from w group by 1),
spot as (select lang, w, k, unnest(generate_series(1, len(w) - k + 1)) as i from w, range(1, 6) t(k) where len(w) >= k),
f as (select lang, k, list_slice(w, i, i + k - 1) as g, array_to_string(list_slice(w, i, i + k - 1), ' ') as phrase, count(*) as f from spot group by 1, 2, 3, 4 having count(*) >= 100),
c as (select * from f where k > 1),
cut as (select c.lang, c.phrase, c.f as a, j, x.f as l, y.f as r, n, ((1000::hugeint * c.f * n) // (x.f::hugeint * y.f))::bigint as score
    from c join range(1, 5) t(j) on j < k join n on n.lang = c.lang
    join f x on x.lang = c.lang and x.phrase = array_to_string(list_slice(c.g, 1, j), ' ') join f y on y.lang = c.lang and y.phrase = array_to_string(list_slice(c.g, j + 1, c.k), ' ')),
best as (select * from cut qualify row_number() over (partition by lang, phrase order by score, j) = 1),
gone as (select distinct c.lang, c.phrase from c join c m on m.lang = c.lang and m.k > c.k and 100 * m.f >= 100 * c.f and contains(' ' || m.phrase || ' ', ' ' || c.phrase || ' '))
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score from best anti join gone using (lang, phrase) qualify rank <= 2000
"""

ORACLES: dict[str, str] = {
    "op4_chat": CHAT,
    "op5_sharding": SHARDING,
    "op7_decontaminate": DECONTAMINATE,
    "op9_substrings": SUBSTRINGS,
    "op10_jaccard": JACCARD,
    "op11_collocations": COLLOCATIONS,
}
