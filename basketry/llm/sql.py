"""DuckDB SQL for the queries that SQL can express."""

QUALITY_RULES = r"""
with d as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
windows as (
  select doc_id, i, list_slice(words, i, i + 4) as gram
  from (select doc_id, words, unnest(generate_series(1, len(words) - 4)) as i from d where len(words) >= 5) t),
repeated as (
  select w.doc_id, w.i from windows w
  join (select doc_id, gram from windows group by doc_id, gram having count(*) > 1) g on g.doc_id = w.doc_id and g.gram = w.gram),
covered as (select doc_id, count(distinct i + k) as n from repeated, (select unnest(generate_series(0, 4)) as k) s group by doc_id),
m as (
  select d.doc_id, cast(len(words) as bigint) as n_words, cast(length(array_to_string(words, '')) as bigint) as word_chars,
    cast(length(text) - length(translate(text, '#*$%&|<>', '')) as bigint) as n_symbols,
    cast(len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) as bigint) as n_lines,
    cast(len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) as bigint) as n_unique,
    cast(coalesce(c.n, 0) as bigint) as n_repeat_words
  from d left join covered c on c.doc_id = d.doc_id),
f as (
  select *, n_lines - n_unique as n_dup_lines,
    cast((case when n_words < 10 then 1 else 0 end)
      + (case when 100 * n_repeat_words > 20 * n_words then 2 else 0 end)
      + (case when 100 * (n_lines - n_unique) > 60 * n_lines then 4 else 0 end)
      + (case when 100 * n_symbols > 20 * n_words then 8 else 0 end)
      + (case when word_chars < 1.5 * n_words then 16 else 0 end)
      + (case when word_chars > 15 * n_words then 32 else 0 end)
      + (case when n_words > 1000000 then 64 else 0 end) as bigint) as failed
  from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & 3 <> 0 as base_failed, failed & 63 = 0 as kept, failed
from f
"""

WARC = """
with p as (
  select cast(page_id as bigint) as page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
g as (select payload_digest, min(page_id) as first from p where payload_bytes >= 100 group by payload_digest),
r as (select p.*, g.first is not null and p.page_id is distinct from g.first as again, g.first from p left join g on g.payload_digest = p.payload_digest)
select page_id, payload_bytes, payload_digest, case when again then 'revisit' else 'response' end as record_type, case when again then first end as refers_to
from r
"""


def centroids_sql(k: int = 40, rounds: int = 5, dimensions: int = 64, scale: int = 256, seed: str = "2") -> str:
    """Every distance of every round, written out; ties go to the smaller number."""
    steps = []
    for i in range(rounds + 1):
        steps.append(
            f"""
d{i} as (select l.r, c.c, sum((l.x - c.m) * (l.x - c.m)) as far from parts l join c{i} c on c.d = l.d group by l.r, c.c),
a{i} as materialized (select r, c, far from (select *, row_number() over (partition by r order by far, c) as place from d{i}) t where place = 1)"""
        )
        if i < rounds:
            steps.append(
                f"""
s{i} as (select a.c, l.d, sum(l.x) as total, count(*) as n from a{i} a join parts l on l.r = a.r group by a.c, l.d),
c{i + 1} as materialized (
  select c, d, (total - ((total % n) + n) % n) // n as m from s{i}
  union all select c, d, m from c{i} where c not in (select c from s{i}))"""
            )
    return f"""
with kept as materialized (
  select cast(vec_id as bigint) as vec_id, row_number() over (order by sha256('{seed}:' || vec_id), vec_id) - 1 as r,
    list_transform(embedding, lambda x: cast(floor({scale} * cast(x as double)) as hugeint)) as v
  from embeddings where len(embedding) = {dimensions} and len(list_filter(embedding, lambda x: isfinite(x))) = {dimensions}),
parts as materialized (select r, unnest(v) as x, unnest(range({dimensions})) as d from kept),
c0 as (select r as c, d, x as m from parts where r < {k}),{",".join(steps)},
inertias as (select c, sum(far) as cluster_inertia from a{rounds} group by c),
digests as (select c, sha256(string_agg(cast(m as varchar), ',' order by d)) as centroid_sha256 from c{rounds} group by c)
select vec_id, cast(a.c as int) as cluster, cast(far as bigint) as distance, cast(cluster_inertia as bigint) as cluster_inertia,
  cast((select sum(cluster_inertia) from inertias) as bigint) as inertia, centroid_sha256
from a{rounds} a join kept on kept.r = a.r join inertias i on i.c = a.c join digests g on g.c = a.c
"""


CENTROIDS = centroids_sql()
