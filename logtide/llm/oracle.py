"""DuckDB twins of the queries that SQL can express.

op2 gives the seats one by one to the highest quotients. op1 looks for every run of lines directly: the shortest run of 50 words that
starts at a line, and the shortest that ends at it, compared as text. op5
compares the shingles of every window with those of every template. op9 scores
all pairs of a query and another row.
"""

from __future__ import annotations

from logtide.llm.licenses import TEMPLATES

_WORDS = r"len(regexp_extract_all({}, '[^\x20\x09-\x0D]+'))"

OP1 = rf"""
WITH lines AS (
  SELECT doc_id, ls, unnest(ls) AS line, unnest(range(len(ls))) AS pos
  FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL)),
real AS (
  SELECT doc_id, pos, line, {_WORDS.format("line")} AS words FROM lines),
seq AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS ord,
         sum(words) OVER (PARTITION BY doc_id ORDER BY pos) AS upto
  FROM real WHERE words > 0),
texts AS (SELECT doc_id, list(line ORDER BY ord) AS ls FROM seq GROUP BY doc_id),
ahead AS (
  SELECT doc_id, ord AS first, ord + count(*) OVER w - 1 AS last, sum(words) OVER w AS total
  FROM (SELECT *, upto - words AS before FROM seq)
  WINDOW w AS (PARTITION BY doc_id ORDER BY before RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING)),
back AS (
  SELECT doc_id, ord - count(*) OVER w + 1 AS first, ord AS last, sum(words) OVER w AS total
  FROM seq WINDOW w AS (PARTITION BY doc_id ORDER BY upto RANGE BETWEEN 49 PRECEDING AND CURRENT ROW)),
runs AS (
  SELECT DISTINCT doc_id, first, last, array_to_string(ls[first:last], chr(10)) AS run
  FROM (SELECT * FROM ahead UNION ALL SELECT * FROM back) JOIN texts USING (doc_id) WHERE total >= 50),
firsts AS (SELECT run, min((doc_id, first)) AS original FROM runs GROUP BY run),
later AS (SELECT doc_id, first, last FROM runs JOIN firsts USING (run) WHERE (doc_id, first) > original),
gone AS (
  SELECT DISTINCT s.doc_id, s.pos FROM seq s JOIN later l ON s.doc_id = l.doc_id AND s.ord BETWEEN l.first AND l.last),
marked AS (
  SELECT r.doc_id, r.pos, r.line, r.words > 0 AS is_real, g.pos IS NOT NULL AS is_gone
  FROM real r LEFT JOIN gone g USING (doc_id, pos)),
kept AS (
  SELECT doc_id, count_if(is_gone) AS n_removed, count_if(is_real AND NOT is_gone) AS n_left,
         string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT is_gone) AS text
  FROM marked GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(string_split(d.text, chr(10))), 0) AS INTEGER) AS n_lines,
       CAST(coalesce(k.n_removed, 0) AS INTEGER) AS n_removed,
       CASE WHEN coalesce(k.n_removed, 0) = 0 THEN d.text WHEN k.n_left = 0 THEN '' ELSE k.text END AS text
FROM documents d LEFT JOIN kept k USING (doc_id)"""

OP2 = rf"""
WITH RECURSIVE docs AS (
  SELECT doc_id, source, coalesce({_WORDS.format("text")}, 0) AS size,
         md5('17:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS draw,
         CAST('0x' || substr(md5('18:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8) AS BIGINT) AS deal
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST(ceil(count(*) / 512) AS BIGINT) AS shards,
         [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight,
         row_number() OVER (ORDER BY source NULLS LAST) - 1 AS no
  FROM docs GROUP BY source),
rates AS (
  SELECT CAST(0 AS DOUBLE) AS rate, CAST(-1 AS BIGINT) AS held, 0 AS turn
  UNION ALL
  SELECT (1.5::DOUBLE * sum(source_size) - 2::DOUBLE * coalesce(sum(source_size) FILTER (WHERE 2 * source_size <= rate * weight), 0))
           / sum(weight) FILTER (WHERE 2 * source_size > rate * weight),
         count(*) FILTER (WHERE 2 * source_size <= rate * weight), turn + 1
  FROM rates, sources GROUP BY rate, held, turn
  HAVING count(*) FILTER (WHERE 2 * source_size <= rate * weight) <> held),
goals AS (
  SELECT *, least(2::DOUBLE * source_size, (SELECT arg_max(rate, turn) FROM rates) * weight) AS target FROM sources),
seats AS (
  SELECT no, target / (2 * k + 1) AS quotient, k
  FROM (SELECT no, target, unnest(range(0, CAST(ceil(target / 16) AS BIGINT) + 40)) AS k FROM goals WHERE target > 0)),
given AS (
  SELECT no, count(*) AS n FROM (
    SELECT *, row_number() OVER (ORDER BY quotient DESC, no, k) AS r FROM seats)
  WHERE r <= (SELECT floor(sum(target) / 16 + 0.5) FROM goals) GROUP BY no),
dealt AS (
  SELECT d.*, g.no, g.source_size, g.target, d.deal % g.shards AS shard, coalesce(v.n, 0) AS source_quota
  FROM docs d JOIN goals g ON d.source IS NOT DISTINCT FROM g.source LEFT JOIN given v USING (no)),
parts AS (
  SELECT no, shard, CAST(sum(size) AS BIGINT) AS shard_size, any_value(source_quota) AS source_quota,
         any_value(source_size) AS source_size FROM dealt GROUP BY no, shard),
part_seats AS (
  SELECT no, shard, shard_size / (2 * k + 1) AS quotient, k, source_quota
  FROM (SELECT *, unnest(range(0, CAST(ceil(source_quota * shard_size / source_size) AS BIGINT) + 40)) AS k
        FROM parts WHERE shard_size > 0)),
part_given AS (
  SELECT no, shard, count(*) AS quota FROM (
    SELECT *, row_number() OVER (PARTITION BY no ORDER BY quotient DESC, shard, k) AS r FROM part_seats)
  WHERE r <= source_quota GROUP BY no, shard),
placed AS (
  SELECT d.*, p.shard_size, CAST(coalesce(g.quota, 0) AS BIGINT) AS quota, least(coalesce(g.quota, 0) * 16, 2 * p.shard_size) AS words,
         coalesce(sum(size) OVER (PARTITION BY d.no, d.shard ORDER BY draw, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM dealt d JOIN parts p ON d.no = p.no AND d.shard = p.shard LEFT JOIN part_given g ON d.no = g.no AND d.shard = g.shard)
SELECT doc_id, size, source_size, target, source, quota,
       CAST(CASE WHEN shard_size = 0 THEN 0 ELSE words // shard_size * size
            + greatest(0, least(size, words - words // shard_size * shard_size - before)) END AS BIGINT) AS taken
FROM placed"""

_TEMPLATE_ROWS = ",\n  ".join(f"('{n}', '{t}')" for n, t in TEMPLATES.items())

OP5 = rf"""
WITH templates(license, text) AS (VALUES
  {_TEMPLATE_ROWS}),
split AS (SELECT license, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS ws FROM templates),
parts AS (
  SELECT license, len(ws) AS l, least(5, len(ws)) AS k, greatest(1, len(ws) // 4) AS step,
         list_distinct(list_transform(range(1, len(ws) - least(5, len(ws)) + 2),
                                      lambda i: array_to_string(ws[i : i + least(5, len(ws)) - 1], ' '))) AS theirs
  FROM split),
docs AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS ws FROM documents WHERE text IS NOT NULL),
places AS (
  SELECT p.license, p.theirs, p.l, p.k, p.step, unnest(p.theirs) AS shingle FROM parts p),
found AS (
  SELECT d.doc_id, t.k, unnest(range(0, greatest(len(d.ws) - t.k + 1, 0))) AS at,
         unnest(list_transform(range(1, greatest(len(d.ws) - t.k + 2, 1)), lambda i: array_to_string(d.ws[i : i + t.k - 1], ' '))) AS shingle
  FROM docs d, (SELECT DISTINCT k FROM parts) t),
hits AS (
  SELECT f.doc_id, p.license, len(p.theirs) AS n, f.at, f.shingle, p.l, p.k, p.step
  FROM found f JOIN places p ON f.k = p.k AND f.shingle = p.shingle),
windows AS (
  -- a shingle at place a lies in the windows s * step with s * step <= a and a + k <= s * step + l + step - 1
  SELECT h.*, unnest(range(greatest(0, (h.at + h.k - h.l - h.step + 1 + h.step - 1) // h.step), h.at // h.step + 1)) * h.step AS word
  FROM hits h),
shares AS (
  SELECT w.doc_id, w.license, w.word, count(DISTINCT shingle) / any_value(n) AS containment
  FROM windows w JOIN docs d USING (doc_id)
  WHERE w.word <= greatest(len(d.ws) - w.l, 0)
  GROUP BY ALL)
SELECT doc_id, license, max(containment) AS containment, CAST(arg_max(word, (containment, -word)) AS INTEGER) AS word
FROM shares WHERE containment >= 0.8 GROUP BY doc_id, license"""

OP9 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5"""


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": OP1, "op2_mixing": OP2, "op5_license_scan": OP5, "op9_exact_search": OP9}
