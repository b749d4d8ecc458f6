"""The queries that SQL can express, for DuckDB."""

from __future__ import annotations

import string

_LINE_DEDUP = f"""
with cut as (
  select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents
), line as (
  select doc_id, unnest(lines) as line, generate_subscripts(lines, 1) as pos from cut
), keyed as (
  select doc_id, line, pos, translate(
    trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    '{string.ascii_uppercase}', '{string.ascii_lowercase}') as key
  from line
), shared as (
  select key, max(doc_id) as keeper from keyed where length(key) >= 20
  group by key having count(distinct doc_id) >= 3
), marked as (
  select doc_id, line, pos, coalesce(doc_id <> keeper, false) as gone
  from keyed left join shared using (key)
)
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from marked group by doc_id
"""

_TOP_K = """
with whole as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as v
  from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select q.vec_id as query_id, c.vec_id,
    cast(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) as bigint) as score
  from whole q join whole c on q.vec_id <> c.vec_id where q.vec_id % 100 = 0
), numbered as (
  select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank
  from scored
)
select query_id, rank, vec_id, score from numbered where rank <= 10
"""


_DIVERGENCE = rf"""
with named as (
  select row_number() over () as doc, coalesce(lang, '') as lang, coalesce(source, '') as source,
    regexp_extract_all(
      translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'),
      '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as terms
  from documents
), word as (
  select doc, lang, source, unnest(terms) as term from named
), kept as (
  select lang, term, count(*) as n from word group by all having count(distinct doc) >= 10
), size as (
  select lang, count(*) as v, sum(n) as n from kept group by lang
), held as (
  select lang, source, term, count(*) as n from word semi join kept using (lang, term) group by all
), total as (
  select lang, source, sum(n) as n from held group by all
), grp as (
  select distinct lang, source from named
), chance as (
  select g.lang, g.source, k.term, coalesce(h.n, 0) as n,
    1 + 1000000000::hugeint * (coalesce(h.n, 0) + 2) // (coalesce(t.n, 0) + 2 * s.v) as p,
    1 + 1000000000::hugeint * (k.n + 2) // (s.n + 2 * s.v) as q
  from grp g join kept k using (lang) join size s using (lang)
  left join total t on t.lang = g.lang and t.source = g.source
  left join held h on h.lang = g.lang and h.source = g.source and h.term = k.term
), apart as (
  select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) as value
  from chance a join chance b on a.lang = b.lang and a.term = b.term and a.source <> b.source
  group by all
), part as (
  select a.lang, a.source, 'pair' as part, b.source as item, cast(coalesce(x.value, 0) as bigint) as value
  from grp a join grp b on a.lang = b.lang and a.source <> b.source
  left join apart x on x.lang = a.lang and x.source = a.source and x.item = b.source
  union all
  select lang, source, 'term', term, cast((p - q) * (p - q) // (p + q) as bigint)
  from chance where n > 0 and p > q
), ranked as (
  select *, cast(row_number() over (partition by lang, source, part order by value desc, item) as int) as rank
  from part
)
select lang, source, part, item, value, rank from ranked where part = 'pair' or rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_line_dedup": _LINE_DEDUP, "op10_exact_top_k": _TOP_K, "op11_source_divergence": _DIVERGENCE}
