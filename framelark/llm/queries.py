"""The thin queries of the training-data operators, each over its whole table, and their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embedding, licenses, linededup, media, mixing, packing, pii, quality, simhash, urlfilter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), (5, 2, 1), 3)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_dups(table(spark, sf_dir, "documents"), bits=4, words=4)
    return found.select("doc_id", simhash.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linededup.dedup_lines(table(spark, sf_dir, "documents"), least=10)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urlfilter.judged(table(spark, sf_dir, "pages").select("page_id", "url"), urlfilter.RULES, "allow")
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), accept=0.7)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(table(spark, sf_dir, "documents"), licenses.TEMPLATES, coverage=0.8)


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = media.probed(media.stored(table(spark, sf_dir, "documents")))
    return read.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), packing.LENGTHS)


def op9_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding.near_dups(table(spark, sf_dir, "embeddings"), threshold=0.9)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.found(table(spark, sf_dir, "documents"))
    base = [pii.listed(k, F.col(k)) for k in pii.KINDS]
    terms = F.transform("terms", lambda x: F.concat_ws(":", x["action"], x["s"].cast("string"), x["e"].cast("string")))
    return found.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in pii.KINDS),
        F.sha2(F.array_join(F.concat(*base), ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.concat(*base, terms), ",").alias("spans"),
    )


QUERIES = {
    q.__name__: q
    for q in (op1_mix_sources, op2_simhash, op3_line_dedup, op4_url_filter, op5_quality, op6_license_scan, op7_media, op8_packing, op9_embedding, op10_pii)
}

OP1_SQL = r"""
WITH s AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT AS h
  FROM documents),
b AS (SELECT source, sum(size)::BIGINT AS source_size FROM s GROUP BY source),
r AS (
  SELECT *, 3 * source_size AS cap,
         [5, 2, 1][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT]::BIGINT AS w
  FROM b),
f AS (
  SELECT *, (sum(source_size) OVER ())::BIGINT AS total,
         (sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - cap)::BIGINT AS before,
         (sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS w_from,
         row_number() OVER o AS pos
  FROM r WINDOW o AS (ORDER BY source_size::DOUBLE / w, source IS NULL, source)),
m AS (SELECT * FROM f WHERE (total - before) * w < cap * w_from ORDER BY pos LIMIT 1),
t AS (
  SELECT f.source, f.source_size,
         CASE WHEN f.pos >= m.pos THEN ((f.total - m.before) * f.w)::DOUBLE / m.w_from::DOUBLE ELSE f.cap::DOUBLE END AS target
  FROM f LEFT JOIN m ON true),
k AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS copies FROM t),
c AS (
  SELECT s.source, s.h, sum(s.size)::BIGINT AS size FROM s GROUP BY s.source, s.h),
u AS (SELECT *, (sum(size) OVER (PARTITION BY source ORDER BY h))::BIGINT AS upto FROM c),
x AS (
  SELECT u.source, u.h,
         k.target - k.copies * k.source_size > 0
         AND u.upto - u.size < k.target - k.copies * k.source_size
         AND (u.upto < k.target - k.copies * k.source_size
              OR u.upto - (k.target - k.copies * k.source_size) <= (k.target - k.copies * k.source_size) - (u.upto - u.size)) AS one_more
  FROM u JOIN k ON u.source IS NOT DISTINCT FROM k.source)
SELECT s.doc_id, s.size, k.source_size, k.target,
       (s.size * (k.copies + CASE WHEN x.one_more THEN 1 ELSE 0 END))::BIGINT AS taken
FROM s JOIN k ON s.source IS NOT DISTINCT FROM k.source
JOIN x ON s.source IS NOT DISTINCT FROM x.source AND s.h = x.h
"""

OP3_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS n FROM d),
k AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l),
o AS (SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= 10 GROUP BY key),
j AS (SELECT k.doc_id, k.line, k.n, coalesce(o.owner <> k.doc_id, false) AS lost FROM k LEFT JOIN o ON k.key = o.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT lost), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""

OP4_SQL = r"""
WITH p AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r(rule, r_host, r_path, verdict) AS (
  VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
         ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')),
f AS (
  SELECT p.page_id, p.host, p.path, r.rule, r.verdict,
         row_number() OVER (PARTITION BY p.page_id, p.host, p.path ORDER BY length(r.rule) DESC) AS n
  FROM p LEFT JOIN r ON (p.host = r.r_host OR ends_with(p.host, '.' || r.r_host)) AND starts_with(p.path, r.r_path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM f WHERE n = 1
"""

OP9_SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS norm
  FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
l AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE a.norm > 0 AND b.norm > 0 AND list_dot_product(a.e, b.e) / a.norm / b.norm >= 0.9),
c(vec_id, reached) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION
  SELECT c.vec_id, l.v FROM c JOIN l ON c.reached = l.u),
n AS (SELECT u, count(*) AS n FROM l GROUP BY u),
m AS (SELECT vec_id, min(reached) AS component_id FROM c GROUP BY vec_id)
SELECT m.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, m.component_id, m.vec_id = m.component_id AS kept
FROM m LEFT JOIN n ON m.vec_id = n.u
"""

OP10_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
k AS (
  SELECT r, 1 AS o, 'email' AS kind, regexp_extract_all(t, p) AS hits, string_split_regex(t, p) AS gaps
  FROM d, (SELECT '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+' AS p) WHERE contains(t, '@')
  UNION ALL SELECT r, 2, 'ip', regexp_extract_all(t, p), string_split_regex(t, p) FROM d, (SELECT '[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)' AS p) WHERE contains(t, '.')
  UNION ALL SELECT r, 3, 'card', regexp_extract_all(t, p), string_split_regex(t, p) FROM d, (SELECT '[0-9](?:[\x20-]?[0-9])+' AS p)
  UNION ALL SELECT r, 4, 'phone', regexp_extract_all(t, p), string_split_regex(t, p) FROM d, (SELECT '\+[0-9][\x20().0-9-]+[0-9]' AS p) WHERE contains(t, '+')),
u AS (
  SELECT r, o, kind, v, s, s + length(v) AS e, regexp_replace(v, '[^0-9]', '', 'g') AS digits FROM (
    SELECT r, o, kind, hits[i] AS v, coalesce(list_sum(list_transform(gaps[1:i], lambda x: length(x))), 0)::BIGINT + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0)::BIGINT AS s
    FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM k WHERE len(hits) > 0))),
base AS (
  SELECT r, o, kind, s, e, CASE kind WHEN 'email' THEN 'email:' || lower(v) WHEN 'ip' THEN 'ip:' || v ELSE kind || ':' || digits END AS entity
  FROM u
  WHERE CASE kind
    WHEN 'ip' THEN len(list_filter(string_split(v, '.'), lambda p: length(ltrim(p, '0')) > 3 OR coalesce(try_cast(nullif(ltrim(p, '0'), '') AS INT), 0) > 255)) = 0
    WHEN 'card' THEN length(digits) BETWEEN 16 AND 19 AND list_sum(list_transform(range(1, length(digits) + 1), lambda n:
      CASE WHEN n % 2 = 1 THEN digits[length(digits) - n + 1]::INT ELSE digits[length(digits) - n + 1]::INT * 2 - CASE WHEN digits[length(digits) - n + 1]::INT > 4 THEN 9 ELSE 0 END END)) % 10 = 0
    WHEN 'phone' THEN length(digits) BETWEEN 8 AND 15
    ELSE true END),
l AS (
  SELECT r, ls[i] AS line, coalesce(list_sum(list_transform(ls[1:i - 1], lambda x: length(x) + 1)), 0)::BIGINT AS a
  FROM (SELECT r, string_split(t, chr(10)) AS ls, unnest(range(1, len(string_split(t, chr(10))) + 1)) AS i FROM d WHERE r IN (SELECT r FROM base))),
b AS (SELECT l.r, l.a, l.line, base.entity, base.s, base.e FROM l JOIN base ON base.r = l.r AND base.s >= l.a AND base.e <= l.a + length(l.line)),
w AS (
  SELECT r, a, hits[i] AS v, a + coalesce(list_sum(list_transform(gaps[1:i], lambda x: length(x))), 0)::BIGINT + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0)::BIGINT AS s
  FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM (
    SELECT DISTINCT r, a, regexp_extract_all(line, '\pL{3,}') AS hits, string_split_regex(line, '\pL{3,}') AS gaps FROM b) WHERE len(hits) > 0)),
token AS (SELECT r, a, lower(v) AS term, s, s + length(v) AS e FROM w WHERE NOT EXISTS (SELECT 1 FROM base c WHERE c.r = w.r AND w.s < c.e AND c.s < w.s + length(w.v))),
near AS (
  SELECT DISTINCT r, entity, term, s, e FROM (
    SELECT b.r, b.entity, token.term, token.s, token.e,
           row_number() OVER (PARTITION BY b.r, b.s, b.e, b.entity, token.s >= b.e ORDER BY CASE WHEN token.s >= b.e THEN token.s ELSE -token.s END) AS n
    FROM b JOIN token ON token.r = b.r AND token.a = b.a AND (token.e <= b.s OR token.s >= b.e)) WHERE n <= 10),
pairs AS (SELECT entity, term, count(*) AS together FROM near GROUP BY entity, term),
corpus AS (
  SELECT r, lower(v) AS term, s - length(v) AS s, s AS e FROM (
    SELECT r, v, (sum(length(g) + length(v)) OVER (PARTITION BY r ORDER BY i))::BIGINT AS s FROM (
      SELECT r, unnest(hits) AS v, unnest(gaps[1:len(hits)]) AS g, unnest(range(1, len(hits) + 1)) AS i
      FROM (SELECT r, regexp_extract_all(t, '\pL{3,}') AS hits, string_split_regex(t, '\pL{3,}') AS gaps FROM d)))),
total AS (SELECT greatest(count(*), 1)::DOUBLE AS n FROM corpus),
frequency AS (SELECT term, count(*) AS n FROM corpus GROUP BY term),
rated AS (
  SELECT p.entity, p.term, CASE WHEN ic > 0 THEN 1 + ln(p.together / (f.n + 1.0)) / ic ELSE 0.0 END AS ratio
  FROM pairs p JOIN frequency f ON f.term = p.term JOIN (SELECT entity, -ln(least(count(*) / any_value(total.n), 1.0)) AS ic FROM near, total GROUP BY entity) c ON c.entity = p.entity),
marks AS (SELECT term, max(CASE WHEN ratio >= 0.95 THEN 'remove' ELSE 'generalise' END) AS kind FROM rated WHERE ratio >= 0.9 GROUP BY term),
added AS (
  SELECT corpus.r, corpus.s, corpus.e, marks.kind FROM corpus JOIN marks ON marks.term = corpus.term
  WHERE NOT EXISTS (SELECT 1 FROM base c WHERE c.r = corpus.r AND corpus.s < c.e AND c.s < corpus.e)),
spans AS (
  SELECT r, o, kind, s, e FROM base
  UNION ALL SELECT r, CASE kind WHEN 'generalise' THEN 5 ELSE 6 END, kind, s, e FROM added)
SELECT d.doc_id, count(*) FILTER (o = 1) AS n_email, count(*) FILTER (o = 2) AS n_ip, count(*) FILTER (o = 3) AS n_card, count(*) FILTER (o = 4) AS n_phone,
       sha256(coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY o, s) FILTER (o <= 4), '')) AS base_sha256,
       coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY o, s) FILTER (o IS NOT NULL), '') AS spans
FROM d LEFT JOIN spans ON spans.r = d.r GROUP BY d.r, d.doc_id
"""

SQL = {"op10_pii": OP10_SQL, "op1_mix_sources": OP1_SQL, "op3_line_dedup": OP3_SQL, "op4_url_filter": OP4_SQL, "op9_embedding": OP9_SQL}
