"""DuckDB SQL for the queries that SQL can express, written independently of them.

Texts are cut at the characters that the contract names.  A query without an
entry here is tested against brute force, an exact round trip or held-out
accuracy in tests/llm.
"""

from .urls import LISTED

_WORDS = "list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

OP1 = f"""
with d as (select row_number() over () as rid, doc_id, source, coalesce(text, '') as t, {_WORDS} as w from documents),
win as (select rid, p, array_to_string(w[p:p+4], ' ') as g from (select rid, w, unnest(range(1, len(w) - 3)) as p from d where len(w) >= 5)),
rep as (select rid, p from (select rid, p, count(*) over (partition by rid, g) as c from win) where c > 1),
cov as (select rid, count(distinct p + k) as n from rep, range(5) as r(k) group by rid),
ln as (select rid, source, t, unnest(string_split(t, chr(10))) as x from d),
filled as (select rid, count(*) - count(distinct x) as dup from ln where regexp_matches(x, '[^\\x20\\x09-\\x0D]') group by rid),
norm as (select rid, source, t, trim(regexp_replace(regexp_replace(lower(x), '[0-9]+', '0', 'g'), '[\\x20\\x09\\x0B-\\x0D]+', ' ', 'g'), ' ') as y from ln),
host as (select source, count(distinct t) as h from d group by source),
common as (select n.source, y from norm n join host using (source) where y <> '' group by n.source, y, h having count(distinct t) > 20 and (count(distinct t) > 0.01 * h or count(distinct t) > 300)),
lost as (select rid, sum(len(string_split(y, ' '))) as lost from norm join common using (source, y) group by rid),
o as (
  select doc_id, cast(len(w) as bigint) as n_words, cast(length(array_to_string(w, '')) as bigint) as word_chars,
    cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
    cast(coalesce(dup, 0) as bigint) as n_dup_lines, cast(coalesce(cov.n, 0) as bigint) as n_repeat_words, cast(coalesce(lost, 0) as bigint) as lost_words
  from d left join cov using (rid) left join filled using (rid) left join lost using (rid))
select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
  not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and lost_words <= 0.5 * n_words as kept from o
"""

OP2 = """
with recursive d as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w
  from documents),
sh as (
  select doc_id, list_sort(list_distinct(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 3), lambda p: array_to_string(w[p:p+4], ' ')) end)) as s from d),
cls as (select min(doc_id) as rep, s, len(s) as n, md5(array_to_string(s, chr(10))) as h from sh group by s),
tok as (select rep, n, unnest(s) as g from cls),
inter as (select a.rep as a, b.rep as b, a.n as na, b.n as nb, count(*) as c from tok a join tok b on a.g = b.g and a.rep < b.rep group by all),
lk as materialized (select a, b from inter where 100 * c >= 85 * (na + nb - c)),
ed as materialized (select a, b from lk union select b, a from lk),
reach(x, y) as (select a, a from ed union select r.x, e.b from reach r join ed e on r.y = e.a),
comp as (select x, min(y) as m from reach group by x)
select sh.doc_id, cast(len(sh.s) as bigint) as n_shingles,
  case when len(sh.s) = 0 then sh.doc_id else coalesce(m, rep) end as component_id,
  sh.doc_id = (case when len(sh.s) = 0 then sh.doc_id else coalesce(m, rep) end) as kept
from sh join cls on md5(array_to_string(sh.s, chr(10))) = cls.h left join comp on comp.x = cls.rep
"""

_HOST = "translate(regexp_extract(coalesce(url, ''), '^(?:[\\s\\S]*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = "regexp_extract(coalesce(url, ''), '^(?:[\\s\\S]*?)://[^/?#]*([^?#]*)', 1)"

def _canonical(host: str, path: str) -> str:
    return f"regexp_replace(regexp_replace({host}, '^www\\.', ''), ':(80|443)$', '') || regexp_replace({path}, '/+$', '')"


OP5 = f"""
with list(url) as (values {", ".join(f"('{u}')" for u in LISTED)}),
bad as (select distinct {_canonical(_HOST, _PATH)} as canonical from list),
p as (select row_number() over () as rid, page_id, {_HOST} as host, {_PATH} as path from pages),
c as (select *, {_canonical("host", "path")} as canonical from p),
rules(verdict, h, pre) as (values ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
best as (select rid, arg_max(h || pre, length(h || pre)) as rule, arg_max(verdict, length(h || pre)) as v from c join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, pre) group by rid),
o as (select rid, page_id, host, path, canonical <> '' and canonical in (select canonical from bad) as listed from c)
select page_id, host, path, rule, listed, coalesce(v, case when listed then 'block' else 'allow' end) as verdict from o left join best using (rid)
"""

OP6 = """
with t as (select distinct conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations),
c as (select conv_id, list({'r': role, 't': text} order by turn nulls first, md5(cast(length(role) as varchar) || ':' || role || text)) as l from t group by conv_id),
g as (select l, min(conv_id) as conv_id, count(*) as copies from c group by l),
kept as (select g.* from g where not exists (select 1 from c where len(c.l) > len(g.l) and c.l[1:len(g.l)] = g.l)),
b as (select conv_id, l, copies, unnest(range(0, cast(ceil(len(l) / 256.0) as bigint))) as block from kept)
select conv_id, block, cast(len(l) as bigint) as n_turns, copies,
  array_to_string(list_transform(l[block * 256 + 1 : block * 256 + 256], lambda x: '<|im_start|>' || x.r || chr(10) || x.t || '<|im_end|>' || chr(10)), '') as rendered
from b
"""

OP7 = """
with p as (select page_id, coalesce(html, '') as h, octet_length(encode(coalesce(html, ''))) as n from pages),
f as (select h, min(page_id) as first from p where n >= 100 group by h)
select page_id, cast(n as bigint) as payload_bytes, sha256(p.h) as payload_digest,
  case when page_id is distinct from first and first is not null then 'revisit' else 'response' end as record_type,
  case when page_id is distinct from first then first end as refers_to
from p left join f on p.h = f.h
"""

OP11 = """
with pieces as (select coalesce(lang, 'und') as lang, row_number() over () as rid, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) as piece from documents),
w as (select lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') as w from pieces),
ph as (select lang, k, array_to_string(w[p:p+k-1], ' ') as phrase, count(*) as f from (select lang, w, k, unnest(range(1, len(w) - k + 2)) as p from w, range(1, 5) as r(k) where len(w) >= k) group by all),
tot as (select lang, cast(sum(f) as bigint) as n from ph where k = 1 group by lang),
cand as materialized (select lang, k, phrase, f as a from ph where k > 1 and f >= 30),
fq as materialized (select lang, phrase, f from ph where f >= 30),
sub as (select lang, array_to_string(s[i:i+m-1], ' ') as phrase, max(a) as most from (select lang, s, a, m, unnest(range(1, len(s) - m + 2)) as i from (select lang, string_split(phrase, ' ') as s, a, k from cand where k > 2) x, range(2, 4) as r(m) where m < k) group by all),
kept as (select c.* from cand c left join sub using (lang, phrase) where most is null or 100 * most < 80 * a),
cut as (select lang, phrase, a, c, array_to_string(s[:c], ' ') as lp, array_to_string(s[c+1:], ' ') as rp from (select lang, phrase, a, string_split(phrase, ' ') as s, unnest(range(1, k)) as c from kept)),
sc as (select cut.*, x.f as l, y.f as r, (cast(2000000 as hugeint) * a) // (x.f + y.f) as score from cut join fq x on x.lang = cut.lang and x.phrase = lp join fq y on y.lang = cut.lang and y.phrase = rp),
best as (select lang, phrase, a, l, r, cast(score as bigint) as score from sc qualify row_number() over (partition by lang, phrase order by score, c) = 1)
select lang, rank, phrase, a, l, r, n, score from (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from best) join tot using (lang) where rank <= 2000
"""

OP12 = """
with d as (select doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') as t from documents),
g as (select t, min(doc_id) as keep_id, count(*) as group_size from d group by t),
r as (select doc_id, t, row_number() over (partition by t order by doc_id nulls last) as place from d)
select doc_id, keep_id, group_size, place = 1 as kept, sha256(t) as text_sha256 from r join g using (t)
"""

ORACLES = {
    "op1_line_frequency": OP1,
    "op2_setsketch_neardup": OP2,
    "op5_url_filter": OP5,
    "op6_chat_format": OP6,
    "op7_warc": OP7,
    "op11_phrase_collocations": OP11,
    "op12_exact_dedup": OP12,
}
