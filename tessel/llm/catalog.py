"""Registered queries of this subpackage: (spark, sf_dir) -> DataFrame, and DuckDB SQL where SQL expresses them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessel.llm import html_main, langid, mixing, ngram_join, packing, quality, secrets, sharding, vectors, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.main_text(_table(spark, sf_dir, "pages"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_table(spark, sf_dir, "documents"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(_table(spark, sf_dir, "documents"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(_table(spark, sf_dir, "documents"))


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages")).drop("url")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(_table(spark, sf_dir, "documents")).drop("copies")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


MIXING_SQL = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM per),
filling AS (
  SELECT *, CAST(3 * source_size AS DOUBLE) AS cap,
    row_number() OVER w AS pos,
    (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(3 * source_size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed WINDOW w AS (ORDER BY CAST(source_size AS DOUBLE) / weight, source NULLS LAST)),
water AS (SELECT arg_min(level, pos) AS water FROM filling WHERE weight * level <= cap),
targets AS (
  SELECT source, source_size, least(cap, coalesce(weight * water, cap)) AS target FROM filling LEFT JOIN water ON true),
rated AS (
  SELECT source, source_size, target, floor(coalesce(target / nullif(source_size, 0), 0)) AS whole FROM targets),
units AS (
  SELECT source, doc_id, size, CAST(count(*) * size AS DOUBLE) AS weight,
    CAST('0x' || substr(md5('9:' || coalesce(CAST(doc_id AS VARCHAR), '-') || ':' || size), 1, 13) AS BIGINT) / CAST(4503599627370496 AS DOUBLE) AS u
  FROM sized WHERE size > 0 GROUP BY source, doc_id, size),
heavy AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY weight DESC, doc_id NULLS LAST, size) AS nth FROM units QUALIFY nth <= 256),
walk AS (
  SELECT source, CAST(0 AS BIGINT) AS nth, CAST(target - whole * source_size AS DOUBLE) AS wanted, CAST(source_size AS DOUBLE) AS rest, false AS extra FROM rated
  UNION ALL
  SELECT w.source, h.nth, w.wanted - CASE WHEN h.u < greatest(0, least(1, coalesce(w.wanted / nullif(w.rest, 0), 0))) THEN h.weight ELSE 0 END, w.rest - h.weight,
    h.u < greatest(0, least(1, coalesce(w.wanted / nullif(w.rest, 0), 0)))
  FROM walk w JOIN heavy h ON w.source IS NOT DISTINCT FROM h.source AND h.nth = w.nth + 1),
ends AS (SELECT source, greatest(0, least(1, coalesce(arg_max(wanted, nth) / nullif(arg_max(rest, nth), 0), 0))) AS part FROM walk GROUP BY source),
drawn AS (
  SELECT h.source, h.doc_id, h.size, w.extra FROM heavy h JOIN walk w ON w.source IS NOT DISTINCT FROM h.source AND w.nth = h.nth)
SELECT s.doc_id, s.size, r.source_size, r.target, s.source,
  CAST((r.whole + CASE WHEN coalesce(d.extra, CAST('0x' || substr(md5('9:' || coalesce(CAST(s.doc_id AS VARCHAR), '-') || ':' || s.size), 1, 13) AS BIGINT) / CAST(4503599627370496 AS DOUBLE) < e.part) THEN 1 ELSE 0 END) * s.size AS BIGINT) AS taken
FROM sized s JOIN rated r ON s.source IS NOT DISTINCT FROM r.source JOIN ends e ON s.source IS NOT DISTINCT FROM e.source
LEFT JOIN drawn d ON s.source IS NOT DISTINCT FROM d.source AND s.doc_id IS NOT DISTINCT FROM d.doc_id AND s.size = d.size
"""

#: CRC-32 by half bytes; its table of 16 numbers is made by rule.
SHARDING_SQL = r"""
WITH crc AS (
  SELECT list_transform(range(0, 16), lambda n: list_reduce(list_prepend(n, range(0, 4)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
raw AS (SELECT doc_id, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS h FROM documents),
keyed AS (
  SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), '-') AS name, CAST(length(h) // 2 + 16 AS BIGINT) AS size,
    xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(h, '..'), lambda x: CAST('0x' || x AS BIGINT))),
      lambda c, b: xor(t[xor(t[xor(c, b) % 16 + 1], xor(c, b) >> 4) % 16 + 1], xor(t[xor(c, b) % 16 + 1], xor(c, b) >> 4) >> 4)), 4294967295) AS text_crc32,
    CAST('0x' || substr(md5(text), 1, 8) AS BIGINT) * 2147483648 + CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '-')), 1, 8) AS BIGINT) % 2147483648 AS key
  FROM raw, crc),
wanted AS (
  SELECT key, size * (CAST(30720 AS DOUBLE) / (SELECT sum(size) FROM keyed)) AS w, CAST('0x' || substr(md5('4:' || key || ':' || name), 1, 13) AS BIGINT) / CAST(4503599627370496 AS DOUBLE) AS u FROM keyed),
sample AS (SELECT list_sort(flatten(list(list_transform(range(0, CAST(least(floor(w) + CASE WHEN u < w - floor(w) THEN 1 ELSE 0 END, 30720) AS BIGINT)), lambda i: key)))) AS k FROM wanted),
cuts AS (SELECT DISTINCT k[greatest(1, CAST(floor(i * len(k) / CAST(1280 AS DOUBLE)) AS BIGINT))] AS cut FROM sample, (SELECT unnest(range(1, 1280)) AS i)),
placed AS (SELECT *, (SELECT count(*) FROM cuts WHERE cut <= key) AS range FROM keyed),
stats AS (SELECT range, sum(size) AS bytes FROM placed GROUP BY range),
fan AS (SELECT range, CAST(ceil(bytes / floor(mean)) AS BIGINT) AS parts FROM (SELECT *, avg(bytes) OVER () AS mean FROM stats) WHERE bytes > 2 * mean),
divided AS (
  SELECT p.*, coalesce(CAST('0x' || substr(md5('11:' || key || ':' || name), 1, 13) AS BIGINT) % parts, 0) AS sub FROM placed p LEFT JOIN fan USING (range)),
summed AS (
  SELECT *, sum(size) OVER w AS until, row_number() OVER w - 1 AS place, sum(size) OVER () AS total
  FROM divided WINDOW w AS (ORDER BY range, sub, key, doc_id NULLS FIRST, size, text_crc32 ROWS UNBOUNDED PRECEDING)),
sharded AS (SELECT *, CAST(least(39, (2 * until - size) * 40 // (2 * total)) AS INTEGER) AS shard FROM summed)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, CAST(place - min(place) OVER (PARTITION BY shard) AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM sharded
"""

_WORDS = r"""
docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
"""

#: Sets of shingles, pairs that share one, and what is reached from each document by links.
JOIN_SQL = f"""
WITH RECURSIVE {_WORDS}
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s FROM docs),
classes AS (SELECT s, min(doc_id) AS cls FROM sets GROUP BY s),
grams AS (SELECT cls, len(s) AS n, unnest(s) AS g FROM classes),
pairs AS (SELECT a.cls AS a, b.cls AS b FROM grams a JOIN grams b ON a.g = b.g AND a.cls <> b.cls GROUP BY a.cls, b.cls HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
reach AS (SELECT cls AS root, cls AS node FROM classes WHERE len(s) > 0 UNION SELECT r.root, p.b FROM reach r JOIN pairs p ON p.a = r.node),
least AS (SELECT root AS cls, min(node) AS component_id FROM reach GROUP BY root)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(l.component_id, s.doc_id) AS component_id
FROM sets s JOIN classes c ON c.s = s.s LEFT JOIN least l ON l.cls = c.cls
"""

#: All pairs; the Spark query may miss some by its stated recall.
VECTORS_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
u AS (
  SELECT vec_id, CASE WHEN n > 0 AND isfinite(n) THEN list_transform(e, lambda x: x / n) END AS e FROM (
    SELECT vec_id, e, CASE WHEN list_count(e) = len(e) THEN sqrt(list_dot_product(e, e)) END AS n FROM v)),
pairs AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_dot_product(a.e, b.e) >= 95e-2),
reach AS (SELECT vec_id AS root, vec_id AS node FROM v UNION SELECT r.root, p.b FROM reach r JOIN pairs p ON p.a = r.node),
least AS (SELECT root AS vec_id, min(node) AS component_id FROM reach GROUP BY root),
links AS (SELECT a AS vec_id, count(*) AS n FROM pairs GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, component_id = vec_id AS kept FROM least LEFT JOIN links USING (vec_id)
"""

#: The contract of a WARC record needs no archive to compute; the digest in base32 has no SQL function, so the hexadecimal
#: form is spelled out in groups of five bits.
WARC_SQL = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS n, sha1(payload) AS h FROM p),
bits AS (
  SELECT page_id, n, h, list_reduce(list_transform(range(1, 41), lambda i: lpad(bin(CAST('0x' || h[i] AS INTEGER)), 4, '0')), lambda a, b: a || b) AS b FROM d),
b32 AS (
  SELECT page_id, n, h, list_reduce(list_transform(range(0, 32), lambda i:
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + 16 * CAST(b[5*i+1] AS INTEGER) + 8 * CAST(b[5*i+2] AS INTEGER) + 4 * CAST(b[5*i+3] AS INTEGER) + 2 * CAST(b[5*i+4] AS INTEGER) + CAST(b[5*i+5] AS INTEGER)]), lambda x, y: x || y) AS digest FROM bits),
g AS (SELECT *, min(page_id) OVER (PARTITION BY h, n) AS first, count(*) OVER (PARTITION BY h, n) AS c FROM b32)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN c > 1 AND first IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN c > 1 AND first IS DISTINCT FROM page_id THEN first END AS refers_to
FROM g
"""

QUERIES = {
    q.__name__: q
    for q in (
        op1_html_extraction, op2_secret_scan, op3_ngram_jaccard_join, op4_sharding, op5_embedding_near_dedup,
        op6_language_id, op7_quality_rules, op8_warc, op9_mixing, op10_best_fit_packing,
    )
}
ORACLE_SQL = {"op3_ngram_jaccard_join": JOIN_SQL, "op4_sharding": SHARDING_SQL, "op5_embedding_near_dedup": VECTORS_SQL, "op8_warc": WARC_SQL, "op9_mixing": MIXING_SQL}
