"""DuckDB SQL for the queries that SQL can express; the other tables of a result follow from these."""

from __future__ import annotations

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_COMPONENTS = """
reach as (select a as node, b as other from both_ways union select r.node, l.b from reach r join both_ways l on l.a = r.other),
comp as (select node, least(node, min(other)) as component from reach group by node)"""

NEAR_DUPLICATES = (
    r"""
with recursive d as (select doc_id, """
    + _WORDS.format(_LOWER.format("coalesce(text, '')"))
    + r""" as w from documents where doc_id is not null),
s as (select doc_id, list_sort(list_distinct(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end)) as s from d),
k as (select doc_id, s, len(s) as n, case when len(s) = 0 then doc_id else min(doc_id) over (partition by s) end as class_id from s),
reps as (select * from k where doc_id = class_id and n > 0),
item as (select doc_id, n, unnest(s) as x from reps),
pair as (select p.doc_id as a, q.doc_id as b, p.n as an, q.n as bn, count(*) as m from item p join item q on p.x = q.x and p.doc_id < q.doc_id and 100 * least(p.n, q.n) >= 85 * greatest(p.n, q.n) group by all),
link as (select a, b from pair where 100 * m >= 85 * (an + bn - m)),
both_ways as (select a, b from link union select b, a from link),"""
    + _COMPONENTS
    + """
select doc_id, n as n_shingles, coalesce(component, class_id) as component_id, coalesce(component, class_id) = doc_id as kept, class_id from k left join comp on node = class_id
"""
)

REPEATED_SPANS = (
    r"""
with d as (select doc_id, """
    + _WORDS.format(_LOWER.format("min(text)"))
    + r""" as w from documents where doc_id is not null group by doc_id),
long as (select doc_id, w, len(w) as n, min(doc_id) over (partition by w) as rep, count(*) over (partition by w) as copies from d where len(w) >= 50),
win as (select doc_id, p, array_to_string(w[p + 1:p + 50], ' ') as g from (select doc_id, w, unnest(range(0, n - 49)) as p from long where doc_id = rep)),
twice as (select g, min({'d': doc_id, 'p': p}) as f from win group by g having count(*) > 1),
cover as (select doc_id, f.d as first_doc, not (f.d = doc_id and f.p = p) as removed, case when f.d = doc_id and f.p <> p then greatest(p, f.p + 50) else p end as lo, p + 50 as hi from win join twice using (g)),
marked as (select *, max(hi) over (partition by doc_id, removed order by lo, hi rows between unbounded preceding and 1 preceding) as reached from cover where lo < hi),
island as (select *, sum(case when lo > reached then 1 else 0 end) over (partition by doc_id, removed order by lo, hi rows unbounded preceding) as i from marked)
select doc_id, min(lo) as start_word, max(hi) as end_word, removed, min(first_doc) as first_doc_id from island group by doc_id, removed, i
union all select doc_id, 0, n, doc_id <> rep, rep from long where copies > 1
"""
)

ARCHIVES = r"""
with p as (select page_id, coalesce(html, '') as payload from pages where page_id is not null),
h as (select page_id, strlen(payload) as payload_bytes, sha1(payload) as hex, max(page_id) over (partition by payload) as owner, row_number() over (partition by payload order by page_id desc) as r from p)
select page_id, cast(payload_bytes as bigint) as payload_bytes,
array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast(1 + ((('0x' || substr(hex, cast(1 + 5 * (i // 4) as bigint), 5))::bigint >> (15 - 5 * (i % 4))::int) & 31) as bigint), 1)), '') as payload_digest,
case when r = 1 then 'response' else 'revisit' end as record_type, case when r > 1 then owner end as refers_to from h
"""

NEAR_VECTORS = (
    """
with recursive v as (select vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings where vec_id is not null),
fine as (select vec_id, label, e, sqrt(list_dot_product(e, e)) as size from v where label is not null and len(e) > 0 and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and list_dot_product(e, e) > 0),
link as (select a.vec_id as a, b.vec_id as b from fine a join fine b on a.label = b.label and a.vec_id < b.vec_id and len(a.e) = len(b.e) and list_dot_product(a.e, b.e) >= 0.93 * a.size * b.size),
both_ways as (select a, b from link union select b, a from link),
degree as (select a as node, count(*) as n from both_ways group by a),"""
    + _COMPONENTS
    + """
select vec_id, coalesce(degree.n, 0) as n_links, coalesce(component, vec_id) as component_id, coalesce(component, vec_id) = vec_id as kept from v left join degree on degree.node = vec_id left join comp on comp.node = vec_id
"""
)

_STEP = "list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda x, y: xor(x // 2, (x % 2) * 3988292384))"
#: crc32, unsigned, of a string's UTF-8 bytes
CRC32 = (
    "xor(list_reduce(list_prepend(4294967295::bigint, list_transform(regexp_extract_all(hex(encode({})), '..'), lambda byte: ('0x' || byte)::bigint)), lambda c, b: " + _STEP + "), 4294967295)"
)

#: Two words of one length are near if they agree without the same letter; others if one is the other without a letter.
SPELLING_VARIANTS = (
    r"""
with recursive run as (select doc_id, """
    + _LOWER.format("x")
    + r""" as run, count(*) as n from (select doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]+')) as x from documents) group by all),
hashed as (select run, n, case when length(run) >= 6 then """
    + CRC32.format("coalesce(doc_id::varchar, '') || ':' || run")
    + """ else 1 end as h from run),
word as (select case when h % 199 = 0 then substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) else run end as word, sum(n)::bigint as n from hashed group by 1),
v as (select word, n from word where length(word) >= 6 and n >= 5),
cut as (select word, i, substr(word, 1, i) || substr(word, i + 2) as rest from (select word, unnest(range(0, length(word))) as i from v)),
near as (
select a.word, b.word as other from cut a join cut b on a.i = b.i and a.rest = b.rest and a.word <> b.word
union select v.word, cut.word from v join cut on cut.rest = v.word
union select cut.word, v.word from v join cut on cut.rest = v.word),
best as (select near.word, count(*)::bigint as n_near, min({'less': -o.n, 'other': other}) as best from near join v o on o.word = other group by near.word),
f as (select word, n, coalesce(n_near, 0) as n_near, case when -best.less >= 5 * n then best.other end as form, case when -best.less >= 5 * n then -best.less end as form_n from v left join best using (word)),
up as (select word, form as root from f where form is not null union all select up.word, f.form from up join f on f.word = up.root where f.form is not null),
last as (select up.word, up.root from up join f on f.word = up.root where f.form is null)
select f.word, form, coalesce(root, f.word) as root, n, n_near, form_n from f left join last on last.word = f.word
"""
)
