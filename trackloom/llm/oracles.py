"""DuckDB SQL for the queries that SQL can express."""

from trackloom.llm import license_scan

SQL: dict[str, str] = {}


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


# The rules of op1, spelled for DuckDB's own pattern language.
_ENDS = r"""[.!?…。！？｡．؟۔।॥։።៖។၊။།༎‼⁇⁈⁉]["'”’»›)\]』」）］》〉*_]*(?:[\t-\r ]|$)|[。！？｡؟۔।॥]"""
_MENU = r"(?i)^[\t-\r ]*(?:home|menu|log ?in|sign ?in|sign ?up|search|contact|contact us|about|about us|next|previous|back to top|skip to content)[\t-\r .!?]*$"
_NOTICE = r"(?i)(?:all rights reserved|lorem ipsum|enable javascript|use cookies|uses cookies|cookie policy|privacy policy|terms of use|terms of service|terms and conditions|subscribe to our|click here to)"

SQL["op1_quality_rules"] = rf"""
with docs as (
  select row_number() over () as r, doc_id, coalesce(text, '') as t from documents
), cut as (
  select r, doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda w: w <> '') as w,
         list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) as l from docs
), lines as (
  select r, l, list_filter(l, lambda x: regexp_matches(x, {_text(_ENDS)})
    and not (len(regexp_extract_all(x, '[|›»]')) - len(regexp_extract_all(x, '[«‹]')) >= 2
      and len(regexp_extract_all(x, '[^\t-\r ]+')) <= 4 * (len(regexp_extract_all(x, '[|›»]')) - len(regexp_extract_all(x, '[«‹]')) + 1))
    and not regexp_matches(x, {_text(_MENU)})
    and not (regexp_matches(x, {_text(_NOTICE)}) and len(regexp_extract_all(x, '[^\t-\r ]+')) <= 15 * len(regexp_extract_all(x, {_text(_NOTICE)})))
    and len(regexp_extract_all(x, '[#*$%&<>]')) * 10 <= length(x)
    and len(regexp_extract_all(x, '!!')) < 3) as good from cut
), windows as (
  select r, unnest(list_transform(range(1, len(w) - 6), lambda i: {{'p': i, 'g': array_to_string(w[i:i + 7], ' ')}}), recursive := true) from cut
), repeated as (
  select r, p from (select r, p, count(*) over (partition by r, g) as n from windows) where n > 1
), covered as (
  select r, count(distinct p + k) as n from repeated, range(8) as q(k) group by r
), measured as (
  select c.doc_id, cast(len(c.w) as bigint) as n_words, cast(length(array_to_string(c.w, '')) as bigint) as word_chars,
    cast(length(c.t) - length(regexp_replace(c.t, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
    cast(len(c.l) - len(list_distinct(c.l)) as bigint) as n_dup_lines, coalesce(v.n, 0) as n_repeat_words,
    cast(len(c.l) as bigint) as n_lines, cast(len(g.good) as bigint) as n_kept_lines,
    length(array_to_string(c.l, '')) as a, length(array_to_string(g.good, '')) as b
  from cut c join lines g using (r) left join covered v using (r)
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed,
  not (n_words < 20 or 100 * n_repeat_words > 30 * n_words) and 100 * b >= 50 * a as kept, n_lines, n_kept_lines
from measured
"""

_PLACES = ", ".join(f"({k}, {_text(label)}, {n}, {t}, {_text(' '.join(w))})" for k, label, n, t, *w in license_scan.template_places(license_scan.TEMPLATES))
_PHRASES = ", ".join(f"({_text(p)}, {_text(label)})" for p, label in license_scan.PHRASES)

SQL["op7_license_scan"] = rf"""
with places(template, label, size, t, g) as (values {_PLACES}), phrases(p, label) as (values {_PHRASES}),
words as (
  select row_number() over () as r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') as w from documents
), flat as (
  select r, unnest(range(0, len(w))) as pos, w from words
), rolled as (
  select r, pos, array_to_string(w[pos + 1:pos + 2], ' ') as g2, array_to_string(w[pos + 1:pos + 3], ' ') as g3, len(w) - pos as n from flat
), base as (
  select r.r, r.pos, p.label from rolled r join phrases p on p.p = r.g2 or p.p = r.g3 where len(string_split(p.p, ' ')) <= r.n
), hits as (
  select r.r, p.template, p.label, p.size, r.pos, p.t, r.pos - p.t as d from rolled r join places p on p.g = r.g3 where r.n >= 3
), diagonals as (
  select distinct r, template, d from hits
), marked as (
  select *, case when d - lag(d) over (partition by r, template order by d) <= {license_scan.NEAR} then 0 else 1 end as new from diagonals
), grouped as (
  select *, sum(new) over (partition by r, template order by d) as span from marked
), spread as (
  select h.r, h.template, g.span, h.label, h.size, h.pos, h.t, h.pos + k as p_word, h.t + k as t_word from hits h join grouped g on g.r = h.r and g.template = h.template and g.d = h.d, range(3) as q(k)
), own as (
  select * from (select r, any_value(label) as label, least(count(distinct p_word), count(distinct t_word)) / greatest(max(size), max(pos) + 2 - min(pos) + 1) as share from spread group by r, template, span) x where 100 * share >= {license_scan.LEAST_SHARE}
), both_kinds as (
  select r, label from base union select r, label from own
)
select w.doc_id, cast(len(w.w) as bigint) as n_words, coalesce(b.n, 0) as n_base, b.lo as first_word, b.hi as last_word,
  coalesce(b.labels, '') as base_labels, coalesce(l.labels, '') as labels, coalesce(o.score, 0.0) as score
from words w
left join (select r, count(*) as n, min(pos) as lo, max(pos) as hi, string_agg(distinct label, ',' order by label) as labels from base group by r) b using (r)
left join (select r, string_agg(distinct label, ',' order by label) as labels from both_kinds group by r) l using (r)
left join (select r, max(share) as score from own group by r) o using (r)
"""

SQL["op3_substring_dedup"] = r"""
with words as (
  select row_number() over () as r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w from documents
), windows as (
  select r, doc_id, unnest(list_transform(range(1, len(w) - 11), lambda i: {'p': i, 'g': array_to_string(w[i:i + 12], ' ')}), recursive := true) from words where doc_id is not null
), marked as (
  select r, p from (select r, doc_id, p, min(doc_id) over (partition by g) as low from windows) where low < doc_id
), gone as (
  select distinct r, p + k as p from marked, range(13) as t(k)
), flat as (
  select r, unnest(w) as word, generate_subscripts(w, 1) as p from words
), kept as (
  select f.r, count(*) filter (where g.p is not null) as n_removed,
         coalesce(string_agg(f.word, ' ' order by f.p) filter (where g.p is null), '') as t
  from flat f left join gone g on g.r = f.r and g.p = f.p group by f.r
)
select w.doc_id, cast(len(w.w) as bigint) as n_words, cast(coalesce(k.n_removed, 0) as bigint) as n_removed,
       sha256(coalesce(k.t, '')) as kept_sha256
from words w left join kept k on k.r = w.r
"""

SQL["op8_jaccard_join"] = r"""
with recursive words as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w from documents
), shingles as (
  select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as g from words
), sizes as (
  select doc_id, count(*) as n from shingles group by doc_id
), common as (
  select a.doc_id as a, b.doc_id as b, count(*) as c from shingles a join shingles b on a.g = b.g and a.doc_id < b.doc_id group by a.doc_id, b.doc_id
), links as (
  select a, b from common join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * c >= 80 * (x.n + y.n - c)
), both_ways as (
  select a, b from links union all select b, a from links
), reach as (
  select doc_id as node, doc_id as other from documents
  union
  select r.node, l.b from reach r join both_ways l on l.a = r.other
)
select d.doc_id, coalesce(s.n, 0) as n_shingles, r.component_id
from documents d left join sizes s using (doc_id) join (select node, min(other) as component_id from reach group by node) r on r.node = d.doc_id
"""

SQL["op10_warc"] = """
with p as (
  select page_id, coalesce(html, '') as html from pages
), m as (
  select page_id, octet_length(encode(html)) as n, sha1(html) as d from p
), f as (
  select *, max(page_id) over (partition by d, n) as first from m
)
select page_id, cast(n as bigint) as payload_bytes, d as payload_digest,
       case when n >= 1000 and page_id < first then 'revisit' else 'response' end as record_type,
       case when n >= 1000 and page_id < first then first end as refers_to
from f
"""

SQL["op13_decontaminate"] = r"""
with docs as (
  select row_number() over () as r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') as w from documents
), items as (
  select item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') as w from benchmark
), sized as (
  select item_id, w, least(len(w), 10) as m from items where len(w) > 0
), windows as (
  select distinct item_id, m, array_to_string(w[pos + 1:pos + m], ' ') as g from (select item_id, w, m, unnest(range(0, len(w) - m + 1)) as pos from sized)
), lengths as (
  select distinct m from windows
), places as (
  select r, m, pos, array_to_string(w[pos + 1:pos + m], ' ') as g from (select r, w, m, unnest(range(0, len(w) - m + 1)) as pos from docs, lengths where len(w) >= m)
), met as (
  select p.r, p.m, p.pos, w.item_id from places p join windows w on w.m = p.m and w.g = p.g
), covered as (
  select r, count(distinct p) as n from (select r, unnest(range(pos, pos + m)) as p from met) group by r
), named as (
  select r, count(distinct item_id) as n, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) as ids from met group by r
)
select d.doc_id, cast(len(d.w) as bigint) as n_words, coalesce(c.n, 0) as n_hit, coalesce(i.n, 0) as n_items, sha256(coalesce(i.ids, '')) as items_sha256, coalesce(c.n, 0) > 0 as contaminated
from docs d left join covered c using (r) left join named i using (r)
"""
