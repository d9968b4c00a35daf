"""DuckDB SQL for the corpus operators that SQL can express."""

from __future__ import annotations

from bomlens.llm.secrets import COPIED_OWNERS, COPIED_REPOSITORIES, LIVE_LEAST, LIVE_OWNERS, PLACEHOLDER

_ASSIGN = (
    r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?)([A-Za-z0-9+/_.=-]+)"""
)


def _hits(kind: int, pattern: str, value: str) -> str:
    return f"""select rid, {kind} kind, start, start + length(hit) fin, {value} val from (
      select rid, unnest(hits) hit, unnest([list_sum([length(g) for g in gaps[1:i]])::bigint + coalesce(list_sum([length(h) for h in hits[1:i-1]]), 0)::bigint for i in range(1, len(hits) + 1)]) start
      from (select rid, regexp_extract_all(t, '{pattern}') hits, string_split_regex(t, '{pattern}') gaps from docs) x) y"""


OP3 = f"""
with docs as materialized (select row_number() over () rid, doc_id, coalesce(text, '') t, coalesce(source, '') own, coalesce(cast(doc_id as varchar), '') repo from documents),
found as materialized (
  select * from ({_hits(0, _ASSIGN, f"regexp_extract(hit, '^{_ASSIGN}$', 2)")}) where length(val) >= 6
  union all {_hits(1, "AKIA[A-Z0-9]{16,}", "hit")}
  union all {_hits(2, "[0-9a-f]{24,}", "hit")}),
counts as (select val, count(distinct own) owners, count(distinct repo) repositories from found join docs using (rid) group by val),
looked as (select found.*, owners, repositories, len(list_distinct(string_split(val, ''))) kinds from found join counts using (val)),
judged as (select *, owners <= {LIVE_OWNERS} and repositories < {COPIED_REPOSITORIES} and case when kind = 2 then length(val) >= {LIVE_LEAST} and regexp_matches(val, '[0-9]') and regexp_matches(val, '[A-Za-z]') and kinds >= 8
  else kinds >= 3 and not regexp_matches(val, '{PLACEHOLDER}') end live from looked),
named as (select rid, kind, start, fin, owners, repositories, ['assign', 'access', 'hex', 'live'][kind + 1] || ':' || start || ':' || fin label from judged),
alls as (select rid, kind, start, fin from judged union all select distinct rid, 3, fin - length(val), fin from judged where live),
per as (select rid, count(*) filter (kind = 0) n_assign, count(*) filter (kind = 1) n_access, count(*) filter (kind = 2) n_hex,
  string_agg(label, ',' order by start, kind, fin) base, count(*) filter (owners >= {COPIED_OWNERS} or repositories >= {COPIED_REPOSITORIES}) n_copied, max(owners) owners, max(repositories) repositories from named group by rid),
spans as (select rid, string_agg(['assign', 'access', 'hex', 'live'][kind + 1] || ':' || start || ':' || fin, ',' order by start, kind, fin) spans, count(*) filter (kind = 3) n_live from alls group by rid)
select doc_id, coalesce(n_assign, 0) n_assign, coalesce(n_access, 0) n_access, coalesce(n_hex, 0) n_hex, sha256(coalesce(base, '')) base_sha256,
  coalesce(spans, '') spans, coalesce(n_copied, 0) n_copied, coalesce(n_live, 0) n_live, coalesce(owners, 0) owners, coalesce(repositories, 0) repositories
from docs left join per using (rid) left join spans using (rid)
"""

OP9 = r"""
with recursive split as (
  select row_number() over () rid, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') ws
  from documents),
sh as materialized (
  select distinct rid, unnest(case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')] else [array_to_string(ws[i:i+4], ' ') for i in range(1, len(ws) - 3)] end) s from split),
sizes as (select rid, count(*) n from sh group by rid),
links as materialized (
  select x.rid a, y.rid b from (select p.rid, q.rid other, count(*) c from sh p join sh q using (s) where p.rid <> q.rid group by 1, 2) x
  join sizes sx on sx.rid = x.rid join sizes sy on sy.rid = x.other join split y on y.rid = x.other where 100 * c >= 80 * (sx.n + sy.n - c)),
reach as (select rid a, rid b from split union select reach.a, links.b from reach join links on links.a = reach.b)
select split.doc_id, coalesce(n, 0) n_shingles, min(o.doc_id) component_id
from split join reach on reach.a = split.rid join split o on o.rid = reach.b left join sizes on sizes.rid = split.rid group by split.rid, split.doc_id, n
"""

_B32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
OP4 = f"""
with digests as (select page_id, octet_length(encode(coalesce(html, ''))) n, sha1(coalesce(html, '')) hx from pages),
bits as (select *, list_aggregate([lpad(bin(('0x' || substr(hx, i * 10 + 1, 10))::bigint), 40, '0') for i in range(0, 4)], 'string_agg', '') b from digests),
named as (select page_id, n, list_aggregate([substr('{_B32}', 1 + list_sum([cast(substr(b, i * 5 + k, 1) as int) * (1 << (5 - k)) for k in range(1, 6)])::int, 1) for i in range(0, 32)], 'string_agg', '') digest from bits),
tops as (select digest, max(page_id) top from named group by digest)
select page_id, n payload_bytes, digest payload_digest, case when page_id < top then 'revisit' else 'response' end record_type, case when page_id < top then top end refers_to
from named join tops using (digest)
"""

OP8 = f"""
with caps as materialized (select row_number() over () rid, page_id, regexp_replace(lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '\\.+$', '') host,
  regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1) path, timestamp '2024-01-01' + to_days((((page_id % 366) + 366) % 366)::int) fetched from pages),
seen as (select distinct host, path from caps where host <> ''),
months as (select host, m, ('0x' || substr(md5(host || '#' || m), 1, 7))::bigint code from (select distinct host from seen) h, range(1, 13) r(m)),
coded as (select host, path, ('0x' || substr(md5(host || path), 1, 7))::bigint code from seen),
dated as (select host, regexp_replace(path, '/+', '/', 'g') path, code, make_date(2024, (1 + code % 12)::bigint, (1 + code % 28)::bigint)::timestamp added from coded),
entries(key, adds, dated) as (
  select 'host:' || host, code % 4 = 0, make_date(2024, m, (1 + code % 28)::bigint)::timestamp from months where code % 4 < 2
  union select 'prefix:' || host || regexp_replace(path, '/$', ''), true, added from dated where code % 3 = 0
  union select 'prefix:' || host || regexp_replace(path, '/$', ''), false, added + interval 60 day from dated where code % 3 = 0 and code % 2 = 0
  union select 'prefix:' || host || regexp_replace(upper(path), '/$', ''), true, added from dated where code % 3 = 1
  union select 'prefix:' || host || regexp_replace(path || '/a/b/c/d/e', '/+', '/', 'g'), true, added from dated where code % 3 = 1),
changes as (select *, lag(adds, 1, false) over (partition by key order by dated, adds desc) before from entries),
spans as materialized (select key, adds, dated valid_from, lead(dated) over (partition by key order by dated, adds desc) valid_to from changes where adds <> before),
rules as (select caps.rid, key, valid_from, valid_to, row_number() over (partition by caps.rid order by key) place, count(*) over (partition by caps.rid) n from caps join spans on spans.adds and valid_from <= fetched and (valid_to is null or valid_to > fetched)
  and (case when key like 'host:%' then host = substr(key, 6) or ends_with(host, '.' || substr(key, 6)) else host <> '' and starts_with(rtrim(regexp_replace(host || path, '/+', '/', 'g'), '/') || '/', substr(key, 8) || '/') end))
select page_id, host, fetched, n is not null listed, key rule, valid_from, valid_to, coalesce(n, 0) active_rules from caps left join rules on rules.rid = caps.rid and place = 1
"""

SQL: dict[str, str] = {"op3_secret_scan": OP3, "op4_warc_transactions": OP4, "op8_url_filter": OP8, "op9_ngram_jaccard": OP9}
