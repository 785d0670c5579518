"""Queries over text analysis, the index and lexical retrieval."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessel.functions import text as tx
from tessel.operators import evaluation, lexical, mutation
from tessel.operators.index import merged, numbered, segment_postings, segments
from tessel.queries.registry import TOKENS, index, query, table
from tessel.sources import files

PROBE = "ering thble thing"
_Q = "q(term) AS (VALUES ('ering'), ('thble'), ('thing'))"
_TOP = "SELECT doc_id, round(sum(7e-1 * bm25 + 3e-1 * tfidf), 6) AS score FROM scored JOIN q USING (term) GROUP BY doc_id"


def _with(body: str, more: str = "") -> str:
    return f"WITH {TOKENS}{', ' + more if more else ''} {body}"


@query("t1_normalize", r"SELECT doc_id, trim(lower(regexp_replace(regexp_replace(text, '[^A-Za-z0-9 \t\n\r\f\x0B]', '', 'g'), '[ \t\n\r\f\x0B]+', ' ', 'g'))) AS norm FROM documents")
def t1(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.normalize(F.col("text")).alias("norm"))


@query("t2_tokenize", _with("SELECT doc_id, alltok AS tokens FROM toks"))
def t2(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.tokenize(F.col("text")).alias("tokens"))


@query("t3_remove_stopwords", _with("SELECT doc_id, tokens FROM toks"))
def t3(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.remove_stop_words(tx.tokenize(F.col("text"))).alias("tokens"))


@query("t4_porter_stem")
def t4(spark, d):
    words = table(spark, d, "documents").select(F.explode(tx.tokenize(F.col("text"))).alias("word")).distinct()
    return words.select("word", tx.stem_udf("word").alias("stem"))


@query("t5_analyze")
def t5(spark, d):
    return tx.analyze(table(spark, d, "documents"))


@query("t5_analyze_unstemmed", _with("SELECT doc_id, CAST(pos AS INTEGER) AS pos, term FROM words"))
def t5s(spark, d):
    return tx.analyze(table(spark, d, "documents"), "stop")


@query("t8_bigrams", _with("SELECT doc_id, a || ' ' || b AS bigram, count(*) AS n FROM (SELECT doc_id, unnest(alltok[:-2]) AS a, unnest(alltok[2:]) AS b FROM toks WHERE len(alltok) > 1) WHERE length(a) >= 3 AND length(b) >= 3 GROUP BY ALL"))
def t8(spark, d):
    return tx.bigram_counts(table(spark, d, "documents"))


@query("t9_url_params", r"""WITH q AS (SELECT page_id, regexp_extract(url, '\?([^#]*)', 1) AS raw FROM pages),
p AS (SELECT page_id, unnest(string_split(raw, '&')) AS part, unnest(range(len(string_split(raw, '&')))) AS i FROM q WHERE raw <> ''),
d AS (SELECT page_id, i, url_decode(replace(split_part(part, '=', 1), '+', ' ')) AS key, url_decode(replace(substr(part, instr(part, '=') + 1), '+', ' ')) AS value FROM p WHERE contains(part, '='))
SELECT page_id, key, value FROM d QUALIFY row_number() OVER (PARTITION BY page_id, key ORDER BY i DESC) = 1""")
def t9(spark, d):
    return table(spark, d, "pages").select("page_id", F.explode(files.query_params(F.col("url"))))


@query("t9_url_host", r"""SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host FROM pages""")
def t9h(spark, d):
    return table(spark, d, "pages").select("page_id", F.try_parse_url("url", F.lit("HOST")).alias("host"))


@query("t9_decoded_links", r"""SELECT doc_id, replace(lang, 'e', 'E f') AS lang, source || '&x=1' AS source FROM documents""")
def t9d(spark, d):
    url = F.concat(F.lit("http://h/p?lang=none&lang="), F.replace("lang", F.lit("e"), F.lit("%45+f")), F.lit("&flag&s%6Furce="), "source", F.lit("%26x%3D1#lang=no"))
    q = files.query_params(url)
    return table(spark, d, "documents").select("doc_id", q["lang"].alias("lang"), q["source"].alias("source"))


@query("t10_escape_json", "SELECT event_id, CAST(to_json({'type': event_type, 'props': props}) AS VARCHAR) AS body FROM events")
def t10(spark, d):
    return table(spark, d, "events").select("event_id", F.to_json(F.struct(F.col("event_type").alias("type"), "props")).alias("body"))


@query("s1_scan_lines", r"SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) AS INTEGER) AS line, text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents) WHERE text <> ''")
def s1(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.filter(F.split("text", "\n"), lambda x: x != "")).alias("i", "text"))
    return lines.select("doc_id", (F.col("i") + 1).alias("line"), "text")


@query("s12_json_ingest", "SELECT event_id, coalesce(CAST(json_extract_string(props, '$.k') AS INTEGER), 0) AS doc, coalesce(json_extract_string(props, '$.content'), '') AS content FROM events")
def s12(spark, d):
    e = table(spark, d, "events")
    j = F.from_json("props", "k INT, content STRING")
    return e.select("event_id", F.coalesce(j["k"], F.lit(0)).alias("doc"), F.coalesce(j["content"], F.lit("")).alias("content"))


@query("s13_page_ingest", r"SELECT page_id, '[' || url || ' - Page 1] ' || t AS body FROM (SELECT page_id, url, trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[ \t\n\r\f\x0B]+', ' ', 'g')) AS t FROM pages) WHERE length(t) > 20")
def s13(spark, d):
    p = table(spark, d, "pages").select("page_id", "url", files.page_text(F.col("html")).alias("t")).filter(F.length("t") > 20)
    return p.select("page_id", F.concat(F.lit("["), "url", F.lit(" - Page 1] "), "t").alias("body"))


_GEN = (["An essay on {topic}, {modifier}.", "{modifier} notes about {topic}."], ["rivers", "alloys", "maps"], ["short", "long"])


@query("s10_corpus_gen", """WITH t(t, l, r) AS (VALUES (0, 'An essay on ', NULL), (1, NULL, ' notes about ')), p(p, topic) AS (VALUES (0, 'rivers'), (1, 'alloys'), (2, 'maps')), m(m, modifier) AS (VALUES (0, 'short'), (1, 'long')), x AS (SELECT *, unnest(range(5)) AS k FROM t, p, m)
SELECT CAST(((k * 2 + t) * 3 + p) * 2 + m + 1 AS BIGINT) AS doc_id, CASE WHEN t = 0 THEN 'An essay on ' || topic || ', ' || modifier || '.' ELSE modifier || ' notes about ' || topic || '.' END || ' Ref ID ' || (((k * 2 + t) * 3 + p) * 2 + m + 1) AS text FROM x""")
def s10(spark, d):
    return files.generated(spark, *_GEN)


@query("s15_bench_corpus", "WITH b AS (SELECT row_number() OVER (ORDER BY item_id) - 1 AS doc_id, text FROM benchmark), n AS (SELECT count(*) AS n FROM b) SELECT r * n + doc_id AS doc_id, text || ' term_' || r || ' ' || (r * n + doc_id) AS text FROM b, n, range(CAST(ceil(2000 / n) AS BIGINT)) t(r) WHERE r * n + doc_id < 2000")
def s15(spark, d):
    b = table(spark, d, "benchmark")
    base = b.select((F.row_number().over(Window.orderBy("item_id")) - 1).cast("long").alias("doc_id"), "text")  # the small base of a bench corpus
    return files.repeated_corpus(base, 2000)


@query("i1_postings", _with("SELECT term, doc_id, tf, positions FROM post"))
def i1(spark, d):
    return index(spark, d).postings.select("term", "doc_id", "tf", "positions")


@query("i2_doc_len", _with("SELECT doc_id, dl FROM dlen"))
def i2(spark, d):
    return index(spark, d).doc_len


@query("i3_df", _with("SELECT term, df FROM dfs"))
def i3(spark, d):
    return index(spark, d).df


@query("i4_tf_lookup", _with("SELECT d.doc_id, coalesce(tf, 0) AS tf FROM dlen d LEFT JOIN (SELECT * FROM post WHERE term = 'thing') USING (doc_id)"))
def i4(spark, d):
    ix = index(spark, d)
    return ix.docs.select("doc_id").join(ix.postings.filter("term = 'thing'").select("doc_id", "tf"), "doc_id", "left").select("doc_id", F.coalesce("tf", F.lit(0)).alias("tf"))


@query("i5_corpus_stats", _with("SELECT n, round(avgdl, 6) AS avgdl FROM stats"))
def i5(spark, d):
    return index(spark, d).stats.select("n", F.round("avgdl", 6).alias("avgdl"))


@query("i6_max_term_score", _with("SELECT term, round(max(bm25), 6) AS max_bm25 FROM scored GROUP BY term"))
def i6(spark, d):
    return index(spark, d).bounds.select("term", F.round("max_bm25", 6).alias("max_bm25"))


@query("i7_skip_list", _with("SELECT term, doc_id, CAST(i AS INTEGER) AS idx FROM (SELECT term, doc_id, row_number() OVER (PARTITION BY term ORDER BY doc_id) - 1 AS i FROM post) WHERE i % 8 = 0"))
def i7(spark, d):
    return index(spark, d).skips()


@query("i8_positions", _with("SELECT doc_id, positions FROM post WHERE term = 'thing'"))
def i8(spark, d):
    return index(spark, d).postings.filter("term = 'thing'").select("doc_id", "positions")


@query("i9_posting_set", _with("SELECT DISTINCT doc_id FROM words WHERE term = 'ering'"))
def i9(spark, d):
    return lexical.containing(index(spark, d), "ering")


@query("i10_vocabulary", _with("SELECT DISTINCT term FROM words"))
def i10(spark, d):
    return index(spark, d).df.select("term")


@query("i11_segment_build", _with("SELECT term, p.doc_id, tf, positions, segment FROM post p JOIN (SELECT doc_id, CAST((row_number() OVER (ORDER BY doc_id) - 1) // CAST(ceil((SELECT count(*) FROM documents) / 4.0) AS BIGINT) AS INTEGER) AS segment FROM documents) s ON s.doc_id = p.doc_id"))
def i11(spark, d):
    return segment_postings(table(spark, d, "documents"), 4, "stop").drop("dl")


@query("v7_chunking", "SELECT doc_id, CAST((row_number() OVER (ORDER BY doc_id) - 1) // CAST(ceil((SELECT count(*) FROM documents) / 4.0) AS BIGINT) AS INTEGER) AS segment FROM documents")
def v7(spark, d):
    return segments(table(spark, d, "documents").select("doc_id"), 4)


@query("i12_merge_postings", _with("SELECT term, count(*) AS df FROM (SELECT term, doc_id FROM post UNION ALL SELECT term, doc_id FROM post WHERE doc_id % 2 = 0) GROUP BY term"))
def i12(spark, d):
    p = index(spark, d).postings
    return merged(p, p.filter("doc_id % 2 = 0")).groupBy("term").agg(F.count("*").alias("df"))


@query("i14_get_document", "SELECT doc_id, text FROM documents WHERE doc_id = 42")
def i14(spark, d):
    return table(spark, d, "documents").filter("doc_id = 42").select("doc_id", "text")


@query("i16_vbyte_size", _with("SELECT term, CAST(sum(CASE WHEN g < 128 THEN 1 WHEN g < 16384 THEN 2 WHEN g < 2097152 THEN 3 WHEN g < 268435456 THEN 4 ELSE 5 END) AS BIGINT) AS bytes FROM (SELECT term, doc_id - lag(doc_id, 1, 0) OVER (PARTITION BY term ORDER BY doc_id) AS g FROM post) GROUP BY term"))
def i16(spark, d):
    p = numbered(index(spark, d).postings)
    return p.select("term", evaluation.vbyte_size(F.col("gap")).alias("b")).groupBy("term").agg(F.sum("b").cast("long").alias("bytes"))


@query("v4_delta_decode", _with("SELECT term, doc_id, CAST(sum(g) OVER (PARTITION BY term ORDER BY doc_id) AS BIGINT) AS decoded FROM (SELECT term, doc_id, doc_id - lag(doc_id, 1, 0) OVER (PARTITION BY term ORDER BY doc_id) AS g FROM post)"))
def v4(spark, d):
    return numbered(index(spark, d).postings).select("term", "doc_id", "decoded")


@query("l1_l2_l3_scores", _with("SELECT term, doc_id, round(bm25, 6) AS bm25, round(tfidf, 6) AS tfidf, round(7e-1 * bm25 + 3e-1 * tfidf, 6) AS score FROM scored JOIN q USING (term)", _Q))
def l123(spark, d):
    ix = index(spark, d)
    s = ix.scored(ix.hits(PROBE.split()))
    return s.select("term", "doc_id", *(F.round(c, 6).alias(c) for c in ("bm25", "tfidf", "score")))


_L4 = _with(f"SELECT * FROM ({_TOP}) WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 10", _Q)


@query("l4_search_exhaustive", _L4)
def l4(spark, d):
    return lexical.search(index(spark, d), PROBE, 10)


@query("l4_search_stemmed")
def l4s(spark, d):
    return lexical.search(index(spark, d, "stem"), PROBE, 10)


@query("l5_search_pruned", _L4)
def l5(spark, d):
    return lexical.search_pruned(index(spark, d), PROBE, 10)


_PRUNED = """qs AS (SELECT term, 7e-1 * max(bm25) + 3e-1 * max(tfidf) AS bound, list_sort(list(7e-1 * bm25 + 3e-1 * tfidf), 'DESC')[10] AS kth FROM scored JOIN q USING (term) GROUP BY term),
th AS (SELECT coalesce(max(kth), 0) AS theta FROM qs), es AS (SELECT term, bound, sum(bound) OVER (ORDER BY bound, term) >= theta - 1e-9 AS essential, theta FROM qs, th),
dd AS (SELECT doc_id, bool_or(essential) AND sum(bound) >= any_value(theta) - 1e-9 AS able FROM post JOIN es USING (term) GROUP BY doc_id)"""


@query("l6_pruning_stats", _with("SELECT count(*) AS candidates, count(*) FILTER (WHERE able) AS evaluated, count(*) FILTER (WHERE NOT able) AS skipped FROM dd", f"{_Q}, {_PRUNED}"))
def l6(spark, d):
    return lexical.pruning_stats(index(spark, d), PROBE, 10)


_ADJACENT = "SELECT DISTINCT a.doc_id{more} FROM words a JOIN words b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 JOIN words c ON a.doc_id = c.doc_id AND c.pos = a.pos + 2 WHERE a.term = 'attion' AND b.term = 'thanedble' AND c.term = 'anea'"


@query("l7_phrase_docs", _with(_ADJACENT.format(more="")))
def l7(spark, d):
    return lexical.phrase(index(spark, d), ["attion", "thanedble", "anea"])


@query("l8_search_phrase", _with(_ADJACENT.format(more=", 1e0 AS score")))
def l8(spark, d):
    return lexical.search_phrase(index(spark, d), "Attion thanedble, anea")


@query("u2_boolean_and", _with("SELECT doc_id FROM post WHERE term = 'ering' INTERSECT SELECT doc_id FROM post WHERE term = 'this'"))
def u2(spark, d):
    return lexical.boolean_and(index(spark, d), ["ering", "this"])


@query("u1_boolean_or", _with("SELECT DISTINCT doc_id FROM post JOIN q USING (term)", _Q))
def u1(spark, d):
    return lexical.boolean_or(index(spark, d), PROBE.split())


@query("u4_boolean_not", _with("SELECT doc_id FROM post WHERE term = 'this' EXCEPT SELECT doc_id FROM post WHERE term = 'or'"))
def u4(spark, d):
    return lexical.boolean_not(index(spark, d), "this", "or")


_LOG = "log AS (SELECT event_id AS seq, CASE WHEN event_type = 'error' THEN 2 ELSE 1 END AS op, event_id % (SELECT count(*) FROM documents) AS doc_id, event_type || event_id AS content FROM events)"


def mutation_log(spark, d):
    n = table(spark, d, "documents").count()
    op = F.when(F.col("event_type") == "error", mutation.DELETE).otherwise(mutation.INSERT)
    return table(spark, d, "events").select(F.col("event_id").alias("seq"), op.alias("op"), (F.col("event_id") % n).alias("doc_id"), F.concat("event_type", F.col("event_id").cast("string")).alias("content"))


@query("m2_wal_replay", f"WITH {_LOG} SELECT doc_id, content FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seq DESC) AS r FROM log) WHERE r = 1 AND op <> 2")
def m2(spark, d):
    return mutation.replay(mutation_log(spark, d))


@query("m6_tombstones", f"WITH {_LOG} SELECT doc_id FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seq DESC) AS r FROM log) WHERE r = 1 AND op = 2")
def m6(spark, d):
    return mutation.tombstones(mutation_log(spark, d))


@query("m11_total_docs", f"WITH {_LOG} SELECT greatest(0, (SELECT count(*) FROM documents) - (SELECT count(*) FROM (SELECT doc_id, arg_max(op, seq) AS o FROM log GROUP BY doc_id) WHERE o = 2)) AS live_docs")
def m11(spark, d):
    return mutation.total_docs(table(spark, d, "documents"), mutation.tombstones(mutation_log(spark, d)))


@query("w8_m5_live_search", _with(f"SELECT * FROM ({_TOP}) WHERE score > 0 AND doc_id % 17 <> 0 ORDER BY score DESC, doc_id LIMIT 10", _Q))
def m5(spark, d):
    ix = index(spark, d)
    dead = ix.docs.filter("doc_id % 17 = 0").select("doc_id")
    return lexical.top(mutation.live(lexical.score_all(ix, PROBE.split()), dead), 10)


@query("m4_m7_add_document", "SELECT doc_id, text FROM documents WHERE doc_id % 10 <> 0 UNION ALL SELECT doc_id, reverse(text) FROM documents WHERE doc_id % 10 = 0 UNION ALL SELECT doc_id + 10000000, lower(text) FROM documents WHERE doc_id % 10 = 1")
def m4(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    new = docs.filter("doc_id % 10 = 0").withColumn("text", F.reverse("text")).unionByName(docs.filter("doc_id % 10 = 1").select((F.col("doc_id") + 10000000).alias("doc_id"), F.lower("text").alias("text")))
    both = docs.withColumn("v", F.lit(0)).unionByName(new.withColumn("v", F.lit(1)))
    return both.groupBy("doc_id").agg(F.max_by("text", "v").alias("text"))


_SHARD = """h AS (SELECT p.*, CAST(abs(p.doc_id) % 4 AS INTEGER) AS shard, dl FROM post p JOIN q USING (term) JOIN dlen USING (doc_id)),
ss AS (SELECT abs(doc_id) % 4 AS shard, count(*) AS n, avg(dl) AS avgdl FROM dlen GROUP BY 1), sd AS (SELECT shard, term, count(*) AS df FROM h GROUP BY ALL),
sc AS (SELECT shard, doc_id, round(sum(7e-1 * ln(1e0 + (n - df + 5e-1) / (df + 5e-1)) * (tf * 25e-1) / (tf + 15e-1 * (25e-2 + 75e-2 * dl / avgdl)) + 3e-1 * (CAST(tf AS DOUBLE) / dl * ln(CAST(n AS DOUBLE) / df))), 6) AS score FROM h JOIN ss USING (shard) JOIN sd USING (shard, term) GROUP BY shard, doc_id),
a AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY score DESC, doc_id) AS r FROM sc WHERE score > 0), b AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY score DESC, doc_id) AS r2 FROM a WHERE r <= 20 AND doc_id % 17 <> 0)"""


@query("m9_scatter_gather", _with("SELECT doc_id, shard, score FROM b WHERE r2 <= 10 ORDER BY score DESC, doc_id LIMIT 10", f"{_Q}, {_SHARD}"))
def m9(spark, d):
    ix = index(spark, d)
    return mutation.sharded_search(ix, PROBE, 10, 4, ix.docs.filter("doc_id % 17 = 0").select("doc_id"))


@query("m8_m10_sharded_phrase", _with(_ADJACENT.format(more=", CAST(abs(a.doc_id) % 4 AS INTEGER) AS shard")))
def m10(spark, d):
    return mutation.sharded_phrase(index(spark, d), ["attion", "thanedble", "anea"])


@query("m12_shard_bounds", _with("""SELECT shard, term, df, round(7e-1 * ln(1e0 + (n - df + 5e-1) / (df + 5e-1)) * part + 3e-1 * share * ln(CAST(n AS DOUBLE) / df), 6) AS max_score FROM (
  SELECT abs(p.doc_id) % 4 AS shard, term, count(*) AS df, max(tf * 25e-1 / (tf + 15e-1 * (25e-2 + 75e-2 * dl / s.avgdl))) AS part, max(CAST(tf AS DOUBLE) / dl) AS share, any_value(s.n) AS n
  FROM post p JOIN dlen USING (doc_id) JOIN (SELECT abs(doc_id) % 4 AS shard, count(*) AS n, avg(dl) AS avgdl FROM dlen GROUP BY 1) s ON s.shard = abs(p.doc_id) % 4 GROUP BY ALL)"""))
def m12(spark, d):
    return mutation.shard_bounds(index(spark, d)).select(F.col("shard").cast("long"), "term", "df", F.round("max_score", 6).alias("max_score"))


@query("a7_shard_rollup", _with("SELECT CAST(abs(doc_id) % 4 AS INTEGER) AS shard, count(*) AS docs, CAST(sum(dl) AS BIGINT) AS tokens FROM dlen GROUP BY 1"))
def a7(spark, d):
    return index(spark, d).doc_len.groupBy(mutation.shard_of(F.col("doc_id")).alias("shard")).agg(F.count("*").alias("docs"), F.sum("dl").alias("tokens"))
