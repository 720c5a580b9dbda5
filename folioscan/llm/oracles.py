"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from folioscan.llm.line_dedup import MIN_CHARS, WINDOW
from folioscan.llm.quality_rules import STOP_WORDS

_WS = r"[\x20\x09-\x0D]"

OP1 = """
with d as materialized (select doc_id, hex(encode(coalesce(text, ''))) as h, cast(strlen(coalesce(text, '')) as bigint) as n from documents),
chunks as materialized (select doc_id, n, 1000 * c as base, substr(h, 2000 * c + 1, 2098) as part from (select doc_id, n, h, unnest(range(0, (n + 950) // 1000)) as c from d where n >= 50)),
hashed as materialized (select doc_id, base, j, hash(substr(part, 2 * j + 1, 100)) as k from (select doc_id, base, part, unnest(range(0, least(1000, n - 49 - base))) as j from chunks where n - 49 > base)),
twice as materialized (select k from hashed group by 1 having min(doc_id) < max(doc_id)),
strings as materialized (select s.doc_id, s.base + s.j as i, substr(part, 2 * s.j + 1, 100) as g from hashed s join twice t on s.k = t.k join chunks c on c.doc_id = s.doc_id and c.base = s.base),
later as (select s.doc_id, s.i from strings s join (select g, min(doc_id) as first from strings group by 1 having count(*) > 1) f on s.g = f.g where f.first < s.doc_id),
marked as (select *, case when i <= lag(i) over (partition by doc_id order by i) + 50 then 0 else 1 end as new from later),
runs as (select doc_id, min(i) as lo, max(i) + 50 as hi from (select *, sum(new) over (partition by doc_id order by i) as run from marked) group by doc_id, run),
edges as (select doc_id, 0 as lo, n as hi from d where doc_id not in (select doc_id from runs) union all
  select doc_id, 0, min(lo) from runs group by 1 union all select r.doc_id, r.hi, coalesce(lead(r.lo) over (partition by r.doc_id order by r.lo), d.n) from runs r join d on d.doc_id = r.doc_id),
kept as (select e.doc_id, string_agg(substr(h, 2 * lo + 1, 2 * (hi - lo)), '' order by lo) as h from edges e join d on d.doc_id = e.doc_id group by 1),
gone as (select doc_id, cast(sum(hi - lo) as bigint) as n_removed, count(*) as n_spans from runs group by 1)
select d.doc_id, d.n as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(from_hex(k.h)) as kept_sha256 from d join kept k on k.doc_id = d.doc_id left join gone g on g.doc_id = d.doc_id
"""

OP2 = rf"""
with lines as (
  select doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 as i, unnest(string_split(coalesce(text, ''), chr(10))) as line from documents
), solid as (
  select doc_id, i, t, length(t) as n, row_number() over w as p, sum(length(t)) over w as c
  from (select doc_id, i, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) as t from lines) where t <> '' window w as (partition by doc_id order by i)
), spans as (
  select a.doc_id, a.p as lo, b.p as hi from solid a join solid b on a.doc_id = b.doc_id and b.p between a.p and a.p + {WINDOW - 1} and (b.c - a.c + a.n >= {MIN_CHARS} or b.p = a.p + {WINDOW - 1})
), wins as (
  select doc_id, lo, min(hi) as hi from spans group by 1, 2 union select doc_id, max(lo), hi from spans group by doc_id, hi
), texts as (
  select w.doc_id, w.lo, w.hi, list(s.t order by s.p) as body from wins w join solid s on s.doc_id = w.doc_id and s.p between w.lo and w.hi group by 1, 2, 3
), marked as (
  select *, row_number() over (partition by body order by doc_id, lo) as nth from texts
), gone as (
  select distinct s.doc_id, s.i from marked m join solid s on s.doc_id = m.doc_id and s.p between m.lo and m.hi where nth > 1
), kept as (
  select l.doc_id, count(s.i) as n_lines, count(g.i) as n_removed, coalesce(string_agg(case when g.i is null then l.line end, chr(10) order by l.i), '') as text
  from lines l left join solid s using (doc_id, i) left join gone g using (doc_id, i) group by l.doc_id
)
select doc_id, n_lines, n_removed, cast(strlen(text) as bigint) as kept_bytes, sha256(text) as kept_sha256 from kept
"""


OP11 = r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (cast(-7 as bigint), cast(0 as bigint), 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), s as (
  select *, case when role in ('system', 'user', 'assistant') then 0 else length(role) + length(role) - length(replace(role, '~', '')) + 2 * len(regexp_extract_all(role, '\[/?(INST|ROLE)\]|<<SYS>>|<</SYS>>|</?s>')) end
    + length(text) + length(text) - length(replace(text, '~', '')) + 2 * len(regexp_extract_all(text, '\[/?(INST|ROLE)\]|<<SYS>>|<</SYS>>|</?s>'))
    + case role when 'system' then 15 when 'user' then 15 when 'assistant' then 9 else 17 end as form,
    row_number() over w as nth, count(*) over (partition by conv_id) as n from t window w as (partition by conv_id order by turn nulls first, role, text)
), p as (
  select *, sum(form) over (partition by conv_id order by nth) as stop from s
)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by nth)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by nth) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(stop) filter (role = 'assistant' or nth = n) as bigint) as formatted_chars,
  count(*) filter (role = 'assistant' or nth = n) as n_examples
from p group by conv_id
"""


def _op8() -> str:
    stops = ", ".join(f"'{w}'" for w in sorted({w for ws in STOP_WORDS.values() for w in ws}))
    return rf"""
with d as (select doc_id, coalesce(text, '') as text from documents),
w as (
  select doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from d
), s as (
  select doc_id, cast(len(words) as bigint) as n_words, cast(length(array_to_string(words, '')) as bigint) as word_chars,
    cast(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
    cast(len(lines) as bigint) as n_lines, cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines,
    cast(len(regexp_extract_all(text, '[!?]{{2,}}')) as bigint) as n_shouts,
    cast(len(list_filter(words, lambda x: lower(x) in ({stops}))) as bigint) as n_stop_words, words from w
), g as (
  select doc_id, unnest(range(1, len(words) - 1)) as i, words from s where len(words) >= 3
), h as (
  select doc_id, i, count(*) over (partition by doc_id, words[i], words[i + 1], words[i + 2]) as n from g
), c as (
  select doc_id, i, lead(i) over (partition by doc_id order by i) as next from h where n >= 2
), r as (
  select doc_id, sum(case when next is null then 3 else least(next - i, 3) end) as n from c group by 1
), t as (
  select s.*, cast(coalesce(r.n, 0) as bigint) as n_repeat_words from s left join r using (doc_id)
), j as (
  select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed, greatest(n_words, 1)::double as nw from t
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and n_words >= 50 and word_chars / nw between 2 and 14 and n_symbols / nw <= 0.1 and n_shouts / nw <= 0.3
    and n_stop_words / nw >= 0.02 and n_dup_lines / greatest(n_lines, 1)::double <= 0.5 as kept,
  n_lines, n_shouts, n_stop_words
from j
"""


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP6 = f"""
with d as (select doc_id, {_WORDS} as w from documents),
b as (select cast(item_id as varchar) as item, {_WORDS} as w from benchmark),
wins as (
  select item, list_slice(w, i, i + 9) as win, 10 as n from (select item, w, unnest(range(1, len(w) - 8)) as i from b where len(w) >= 10)
  union all select item, w, len(w) from b where len(w) between 1 and 9
), u as (select win, n, list(distinct item) as items from wins group by all),
sizes as (select distinct n from u),
hits as (
  select doc_id, i, x.n, u.items from (
    select doc_id, n, i, list_slice(w, i, i + n - 1) as win from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, sizes where len(w) >= n)
  ) x join u on u.win = x.win
), pos as (
  select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from hits) group by 1
), it as (
  select doc_id, list_sort(list_distinct(flatten(list(items)))) as items from hits group by 1
)
select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(len(items), 0) as bigint) as n_items,
  sha256(coalesce(array_to_string(items, ','), '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join pos using (doc_id) left join it using (doc_id)
"""

OP9 = """
with p as (select page_id, coalesce(url, '') as url, coalesce(html, '') as html from pages),
faulty as (
  select page_id, url, case when page_id % 97 = 5 then '?' || substr(html, 2) when page_id % 193 = 7 then left(html, greatest(length(html) - 1, 0)) else html end as h from p where page_id % 389 <> 11
), replicas as (
  select page_id, url, html as h, 1 as replica from p union all select page_id, url, h, 2 from faulty union all select -page_id - 1, url, h, 2 from faulty where page_id % 211 = 13
), r as (
  select page_id, replica, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10)
    || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(h) || chr(13) || chr(10) || chr(13) || chr(10) || h || chr(13) || chr(10) || chr(13) || chr(10) as record from replicas
), u as (
  select coalesce(a.page_id, b.page_id) as page_id, cast(strlen(a.record) as bigint) as length, sha256(a.record) as sha256, sha256(b.record) as replica_sha256
  from (select * from r where replica = 1) a full join (select * from r where replica = 2) b on a.page_id = b.page_id
), o as (
  select *, row_number() over (order by page_id) - 1 as ordinal, cast(coalesce(sum(length) over (order by page_id rows between unbounded preceding and 1 preceding), 0) as bigint) as before from u
)
select page_id, ordinal, case when sha256 is not null then before end as "offset", length, sha256, replica_sha256,
  case when sha256 is null then 'extra' when replica_sha256 is null then 'missing' when sha256 <> replica_sha256 then 'corrupt' else 'intact' end as status from o
"""

#: Materialized, so that a LIMIT around a query can't stall DuckDB.
_SQL = {"op11_prefix_targets": OP11, "op1_suffix_array_dedup": OP1, "op9_merkle_fixity": OP9, "op2_line_dedup": OP2, "op6_prefix_decontamination": OP6, "op8_quality_rules": _op8()}
ORACLES = {name: f"with answer as materialized ({sql}) select * from answer" for name, sql in _SQL.items()}
