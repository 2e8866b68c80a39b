"""DuckDB SQL of the joins on word shingles: all pairs of distinct texts that share a shingle, and what links reach."""

from __future__ import annotations


def components(width: int, percent: int, more: str = "") -> str:
    """(doc_id, n_shingles, component_id) of each document; `more` adds columns."""
    return f"""
with recursive texts as (select text, min(doc_id) as least, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as words from documents group by text),
numbered as (select row_number() over () as k, * from texts),
grams as (select distinct k, unnest(case when len(words) = 0 then [] when len(words) < {width} then [array_to_string(words, ' ')]
  else list_transform(range(1, len(words) - {width} + 2), lambda i: array_to_string(words[i:i + {width - 1}], ' ')) end) as gram from numbered),
sizes as (select k, count(*) as n from grams group by k),
shared as (select a.k as a, b.k as b, count(*) as common from grams a join grams b on a.gram = b.gram and a.k < b.k group by all),
links as (select a, b from shared join sizes x on x.k = a join sizes y on y.k = b where 100 * common >= {percent} * (x.n + y.n - common)),
edges as (select a, b from links union all select b, a from links),
reach as (select k, k as other from numbered union select reach.k, edges.b from reach join edges on edges.a = reach.other),
named as (select r.k, min(o.least) as component_id from reach r join numbered o on o.k = r.other group by r.k)
select doc_id, n_shingles, component_id{more} from (
  select d.doc_id, coalesce(s.n, 0)::bigint as n_shingles, case when s.n is null then d.doc_id else c.component_id end as component_id
  from documents d join numbered t on t.text is not distinct from d.text left join sizes s on s.k = t.k join named c on c.k = t.k)
"""
