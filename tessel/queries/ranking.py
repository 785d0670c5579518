"""Queries over fusion, filters, suggestion, display, evaluation and the search modes."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessel.operators import evaluation, fusion, lexical, suggest
from tessel.operators.dense import knn, vector_of
from tessel.plans.search import Engine
from tessel.queries.lexical import _Q, _TOP, PROBE, _with
from tessel.queries.registry import index, query, spread, table

_LEX = f"lex AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM (SELECT * FROM ({_TOP}) WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 20))"
_VEC = "e AS (SELECT vec_id AS doc_id, label, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS v FROM embeddings), qq AS (SELECT v AS qv FROM e WHERE doc_id = 7)"
_DEN = "den AS (SELECT *, row_number() OVER (ORDER BY sim DESC, doc_id) AS s FROM (SELECT doc_id, round(list_dot_product(v, qv), 6) AS sim FROM e, qq ORDER BY sim DESC, doc_id LIMIT 20))"
_RRF = "round(coalesce(1e0 / (60 + r), 0) + coalesce(1e0 / (60 + s), 0), 9) AS rrf, coalesce(score, 0) AS lexical_score, coalesce(sim, 0) AS dense_score FROM lex FULL JOIN den USING (doc_id)"


def _dense(spark, d, k=20):
    e = table(spark, d, "embeddings")
    return knn(e, vector_of(spark, e, 7), k).withColumnRenamed("vec_id", "doc_id")


@query("f1_rrf", _with(f"SELECT doc_id, {_RRF} ORDER BY rrf DESC, doc_id LIMIT 10", f"{_Q}, {_LEX}, {_VEC}, {_DEN}"))
def f1(spark, d):
    return fusion.rrf(lexical.search(index(spark, d), PROBE, 20), _dense(spark, d), 10)


@query("f2_hybrid_content", _with(f"SELECT doc_id, rrf, text FROM (SELECT doc_id, {_RRF} ORDER BY rrf DESC, doc_id LIMIT 10) LEFT JOIN documents USING (doc_id)", f"{_Q}, {_LEX}, {_VEC}, {_DEN}"))
def f2(spark, d):
    ix = index(spark, d)
    return fusion.rrf(lexical.search(ix, PROBE, 20), _dense(spark, d), 10).join(ix.docs, "doc_id", "left").select("doc_id", "rrf", "text")


_CROSS = """c AS (SELECT doc_id, text, len(alltok) AS nt, list_filter(list_transform(alltok, lambda t, i: CASE WHEN t IN ('ering', 'thble', 'thing') THEN i END), lambda x: x IS NOT NULL) AS p FROM toks),
cs AS (SELECT doc_id, round(CASE WHEN nt = 0 THEN 0 ELSE least(1e0, 5e-1 * len(p) / 3 + 2e-1 * CASE WHEN len(p) < 2 THEN 1e0 ELSE len(p) / CAST(p[-1] - p[1] + 1 AS DOUBLE) END + CASE WHEN contains(text, 'ering thble thing') THEN 3e-1 ELSE 0 END) END, 6) AS "cross" FROM c)"""


@query("f3_cross_score", _with('SELECT doc_id, "cross" FROM cs', _CROSS))
def f3(spark, d):
    return table(spark, d, "documents").select("doc_id", F.round(fusion.cross_score(PROBE, F.col("text")), 6).alias("cross"))


@query("f5_rerank", _with('SELECT doc_id, round(6e-1 * "cross" + 4e-1 * score / greatest(1e-4, max(score) OVER ()), 6) AS final, score AS l1, "cross" FROM lex JOIN cs USING (doc_id) ORDER BY final DESC, doc_id LIMIT 10', f"{_Q}, {_LEX}, {_CROSS}"))
def f5(spark, d):
    ix = index(spark, d)
    return fusion.rerank(PROBE, lexical.search(ix, PROBE, 20).join(ix.docs, "doc_id"), 10)


_CLICKS = "b AS (SELECT event_id % (SELECT count(*) FROM documents) AS doc_id, count(*) AS n_clicks, round(1 - exp(-5e-1 * count(*)), 6) AS boost FROM events WHERE event_type = 'click' GROUP BY 1)"


def _clicks(spark, d):
    n = table(spark, d, "documents").count()
    return table(spark, d, "events").filter("event_type = 'click'").select((F.col("event_id") % n).alias("doc_id"))


@query("p1_p2_click_boost", f"WITH {_CLICKS} SELECT * FROM b")
def p12(spark, d):
    return fusion.click_boost(_clicks(spark, d))


@query("p2_boosted_search", _with("SELECT doc_id, round(score * (1 + coalesce(boost, 0)), 6) AS score, coalesce(boost, 0) AS boost FROM lex LEFT JOIN b USING (doc_id)", f"{_Q}, {_LEX}, {_CLICKS}"))
def p2(spark, d):
    return fusion.boosted(lexical.search(index(spark, d), PROBE, 20), fusion.click_boost(_clicks(spark, d))).select("doc_id", "score", "boost")


_META = """meta AS (SELECT *, CASE WHEN contains(text, 'neural') OR contains(text, 'learning') OR contains(text, 'intelligence') THEN 'AI' WHEN contains(text, 'cloud') OR contains(text, 'microservices') OR contains(text, 'docker') THEN 'Cloud'
 WHEN contains(text, 'security') OR contains(text, 'cryptography') OR contains(text, 'cyber') THEN 'Security' WHEN contains(text, 'genome') OR contains(text, 'dna') OR contains(text, 'biology') THEN 'Genomics'
 WHEN contains(text, 'quantum') OR contains(text, 'computing') THEN 'Quantum' ELSE 'General' END AS category, CAST(2022 + doc_id % 4 AS INTEGER) AS year FROM documents)"""


@query("w6_w7_metadata", f"WITH {_META} SELECT doc_id, category, year FROM meta")
def w67(spark, d):
    return fusion.with_metadata(table(spark, d, "documents")).select("doc_id", "category", "year")


@query("w1_w2_w3_filter_expr", f"WITH {_META} SELECT doc_id FROM meta WHERE category = 'General' AND year >= 2024 AND year >= 2022 + 1e-6 AND source = 'src2'")
def w1(spark, d):
    docs = fusion.with_metadata(table(spark, d, "documents"))
    return docs.filter(fusion.filter_expr("category:General, year:>=2024,year:>2022,source:src2", {"year"}, set(docs.columns))).select("doc_id")


@query("w4_bitset_algebra", "SELECT doc_id FROM documents WHERE lang = 'en' INTERSECT SELECT doc_id FROM documents WHERE doc_id % 3 = 0 UNION SELECT doc_id FROM documents WHERE lang = 'es'")
def w4(spark, d):
    docs = table(spark, d, "documents")
    return docs.filter("lang = 'en'").select("doc_id").intersect(docs.filter("doc_id % 3 = 0").select("doc_id")).union(docs.filter("lang = 'es'").select("doc_id")).distinct()


@query("w5_metadata_upsert", "SELECT doc_id, coalesce(l.quality, -1) AS quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def w5(spark, d):
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"))


_SPELL = "asked(token) AS (VALUES ('eringg'), ('thbel'), ('thing')), cand AS (SELECT token, term, df, levenshtein(token, term) AS dd FROM asked, dfs WHERE abs(length(term) - length(token)) <= 2), best AS (SELECT *, row_number() OVER (PARTITION BY token ORDER BY dd, df DESC, term) AS r FROM cand WHERE dd <= 2)"


@query("q2_q3_spell", _with("SELECT token, coalesce(term, token) AS correction FROM asked LEFT JOIN (SELECT token, term FROM best WHERE r = 1) USING (token)", _SPELL))
def q2(spark, d):
    return suggest.corrections(index(spark, d), ["eringg", "thbel", "thing"])


@query("q1_corrected_query", _with("SELECT string_agg(coalesce(term, token), ' ' ORDER BY i) AS query FROM (SELECT token, i FROM (VALUES ('eringg', 1), ('thbel', 2), ('thing', 3)) v(token, i)) LEFT JOIN (SELECT token, term FROM best WHERE r = 1) USING (token)", _SPELL))
def q1(spark, d):
    return spark.createDataFrame([(suggest.correct_query(index(spark, d), "the eringg thbel thing"),)], "query string")


_TERMS = "sugg AS (SELECT key, CAST(sum(w) AS BIGINT) AS freq FROM (SELECT unnest(list_filter(alltok, lambda x: length(x) >= 3)) AS key, 1 AS w FROM toks UNION ALL SELECT a || ' ' || b, 2 FROM (SELECT unnest(alltok[:-2]) AS a, unnest(alltok[2:]) AS b FROM toks WHERE len(alltok) > 1) WHERE length(a) >= 3 AND length(b) >= 3) GROUP BY key)"


@query("q4_suggest_build", _with("SELECT key, freq FROM sugg", _TERMS))
def q4(spark, d):
    return suggest.suggest_terms(spread(table(spark, d, "documents").select("text")))


@query("q5_suggest", _with("SELECT key, freq FROM sugg WHERE starts_with(key, 'th') ORDER BY freq DESC, key LIMIT 5", _TERMS))
def q5(spark, d):
    return suggest.suggest(suggest.suggest_terms(spread(table(spark, d, "documents").select("text"))), "Th")


@query("q6_suggest_size", _with("SELECT count(*) AS terms FROM sugg", _TERMS))
def q6(spark, d):
    return suggest.suggest_terms(spread(table(spark, d, "documents").select("text"))).agg(F.count("*").alias("terms"))


@query("n1_snippet")
def n1(spark, d):
    return lexical.search(index(spark, d), PROBE, 10).join(index(spark, d).docs, "doc_id").select("doc_id", suggest.snippet_column(F.col("text"), PROBE.split(), 160, "html").alias("snippet"))


@query("n2_highlight", r"""SELECT doc_id, array_to_string(list_transform(list_filter(regexp_split_to_array(text, '[ \t\n\r\f\x0B]+'), lambda w: w <> ''), lambda w:
 CASE WHEN regexp_replace(w, '[^A-Za-z0-9]', '', 'g') <> '' AND (lower(regexp_replace(w, '[^A-Za-z0-9]', '', 'g')) = 'thing' OR contains(lower(regexp_replace(w, '[^A-Za-z0-9]', '', 'g')), 'thing') OR contains('thing', lower(regexp_replace(w, '[^A-Za-z0-9]', '', 'g')))) THEN '<b>' || w || '</b>' ELSE w END), ' ') AS shown FROM documents""")
def n2(spark, d):
    return table(spark, d, "documents").select("doc_id", suggest.highlight(F.col("text"), ["thing"]).alias("shown"))


@query("n3_truncate", "SELECT doc_id, CASE WHEN length(text) > 115 THEN substr(text, 1, 115) || '…' ELSE text END AS shown FROM documents")
def n3(spark, d):
    return table(spark, d, "documents").select("doc_id", suggest.truncated(F.col("text")).alias("shown"))


@query("n4_title", "SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN 'Document #' || doc_id WHEN length(trim(string_split(text, '.')[1])) > 5 AND length(trim(string_split(text, '.')[1])) < 85 THEN trim(string_split(text, '.')[1]) ELSE substr(text, 1, 75) || '...' END AS title FROM documents")
def n4(spark, d):
    return table(spark, d, "documents").select("doc_id", suggest.title(F.col("doc_id"), F.col("text")).alias("title"))


@query("n5_highlight_prefix", "SELECT p_partkey, CASE WHEN starts_with(lower(p_name), 're') THEN '<b>' || substr(p_name, 1, 2) || '</b>' || substr(p_name, 3) ELSE p_name END AS shown FROM part")
def n5(spark, d):
    return table(spark, d, "part").select("p_partkey", suggest.highlight_prefix(F.col("p_name"), "Re").alias("shown"))


_KW = [("a", "thing", 3.0), ("a", "ering", 2.0), ("b", "attion", 3.0), ("b", "oning", 1.0)]
_KWSQL = "kws(query_id, kw, weight) AS (VALUES ('a', 'thing', 3e0), ('a', 'ering', 2e0), ('b', 'attion', 3e0), ('b', 'oning', 1e0)), rel AS (SELECT query_id, doc_id, sum(weight) AS rel FROM documents, kws WHERE contains(lower(text), kw) GROUP BY ALL)"


@query("e1_relevance", f"WITH {_KWSQL} SELECT * FROM rel")
def e1(spark, d):
    return evaluation.relevance(table(spark, d, "documents").select("doc_id", "text"), spark.createDataFrame(_KW, "query_id string, kw string, weight double"))


_RANKED = "SELECT 'a' AS query_id, doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM (SELECT doc_id, round(sum(7e-1 * bm25 + 3e-1 * tfidf), 6) AS score FROM scored WHERE term IN ('ering', 'thing') GROUP BY doc_id) ORDER BY score DESC, doc_id LIMIT 10"


@query("e2_e3_e4_ndcg", _with(f"""SELECT query_id, round(dcg, 6) AS dcg, round(coalesce(idcg, 0), 6) AS idcg, round(coalesce(dcg / nullif(idcg, 0), 0), 6) AS ndcg FROM
 (SELECT query_id, sum((pow(2e0, coalesce(rel, 0)) - 1) / log2(rank + 1)) AS dcg FROM ({_RANKED}) LEFT JOIN rel USING (query_id, doc_id) GROUP BY 1)
 LEFT JOIN (SELECT query_id, sum((pow(2e0, rel) - 1) / log2(n + 1)) AS idcg FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, doc_id) AS n FROM rel) WHERE n <= 10 GROUP BY 1) USING (query_id)""", _KWSQL))
def e234(spark, d):
    gains = evaluation.relevance(table(spark, d, "documents").select("doc_id", "text"), spark.createDataFrame(_KW, "query_id string, kw string, weight double"))
    rank = F.row_number().over(Window.orderBy(F.desc("score"), "doc_id"))
    got = lexical.search(index(spark, d), "ering thing", 10).select(F.lit("a").alias("query_id"), "doc_id", rank.alias("rank"))
    return evaluation.ndcg(got, gains, 10)


_PAIR = """ranked AS (SELECT 'a' AS query_id, doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, 1 AS s FROM (SELECT doc_id, round(sum(7e-1 * bm25 + 3e-1 * tfidf), 6) AS score FROM scored WHERE term IN ('ering', 'thing') GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 10)
 UNION ALL SELECT 'b', doc_id, row_number() OVER (ORDER BY score DESC, doc_id), 1 FROM (SELECT doc_id, round(sum(7e-1 * bm25 + 3e-1 * tfidf), 6) AS score FROM scored WHERE term IN ('attion', 'oning') GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 10)
 UNION ALL SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, doc_id), 2 FROM rel QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, doc_id) <= 10 AND query_id = 'a'),
ideal AS (SELECT query_id, sum((pow(2e0, rel) - 1) / log2(n + 1)) AS idcg FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, doc_id) AS n FROM rel) WHERE n <= 10 GROUP BY 1),
got AS (SELECT s, query_id, round(coalesce(sum((pow(2e0, coalesce(rel, 0)) - 1) / log2(rank + 1)) / nullif(any_value(idcg), 0), 0), 6) AS ndcg FROM ranked LEFT JOIN rel USING (query_id, doc_id) LEFT JOIN ideal USING (query_id) GROUP BY ALL),
m AS (SELECT avg(coalesce(x.ndcg, 0)) AS b, avg(coalesce(y.ndcg, 0)) AS n FROM (SELECT * FROM got WHERE s = 1) x FULL JOIN (SELECT * FROM got WHERE s = 2) y USING (query_id))"""


@query("e4_e5_mean_gain", _with("SELECT round(b, 6) AS base_ndcg, round(n, 6) AS new_ndcg, round(CASE WHEN b = 0 THEN 0 ELSE (n - b) / b * 100 END, 4) AS gain_percent FROM m", f"{_KWSQL}, {_PAIR}"))
def e45(spark, d):
    """Two queries by the lexical search, against the ideal ranking of one of them."""
    gains = evaluation.relevance(table(spark, d, "documents").select("doc_id", "text"), spark.createDataFrame(_KW, "query_id string, kw string, weight double"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    base = None
    for name, text in (("a", "ering thing"), ("b", "attion oning")):
        got = lexical.search(index(spark, d), text, 10).select(F.lit(name).alias("query_id"), "doc_id", "score")
        base = got if base is None else base.unionByName(got)
    best = gains.filter("query_id = 'a'").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rel"), "doc_id"))).filter("rank <= 10")
    best = best.select("query_id", "doc_id", "rank")
    return evaluation.mean_gain(evaluation.ndcg(base.withColumn("rank", rank), gains), evaluation.ndcg(best, gains))


@query("a3_a4_latency", "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, round(count(*) / nullif(sum(value) / 1e6, 0), 6) AS qps FROM events GROUP BY event_type")
def a34(spark, d):
    return evaluation.latency(table(spark, d, "events"), "value", "event_type")


@query("a5_speedup", "SELECT round(avg(value) FILTER (WHERE event_type = 'view') / nullif(avg(value) FILTER (WHERE event_type = 'click'), 0), 6) AS speedup FROM events")
def a5(spark, d):
    mean = lambda t: F.avg(F.when(F.col("event_type") == t, F.col("value")))
    return table(spark, d, "events").agg(F.round(F.try_divide(mean("view"), mean("click")), 6).alias("speedup"))


_ENGINES: dict = {}


def engine(spark, d) -> Engine:
    key = spark.sparkContext.applicationId, d
    if key not in _ENGINES:
        docs = table(spark, d, "documents")
        e = Engine(docs, table(spark, d, "embeddings"), dead=docs.filter("doc_id % 17 = 0").select("doc_id"), analyzer="stop")
        e.index = index(spark, d)
        _ENGINES[key] = e
    return _ENGINES[key]


_LEXN = "lexn AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM (SELECT * FROM (" + _TOP + ") WHERE score > 0 ORDER BY score DESC, doc_id LIMIT {n}))"


@query("x1_search_bm25", _with("SELECT doc_id, score, category, year FROM lexn JOIN meta USING (doc_id) WHERE year >= 2023 AND doc_id % 17 <> 0 ORDER BY score DESC, doc_id LIMIT 10", f"{_Q}, {_LEXN.format(n=30)}, {_META}"))
def x1(spark, d):
    return engine(spark, d).search(PROBE, "bm25", 10, "year:>=2023").select("doc_id", "score", "category", "year")


@query("x1_search_wand", _with("SELECT doc_id, score FROM lexn JOIN meta USING (doc_id) WHERE doc_id % 17 <> 0 ORDER BY score DESC, doc_id LIMIT 10", f"{_Q}, {_LEXN.format(n=30)}, {_META}"))
def x1w(spark, d):
    return engine(spark, d).search(PROBE, "wand", 10).select("doc_id", "score")


@query("x1_search_hybrid", _with(f"""SELECT doc_id, rrf FROM (SELECT doc_id, {_RRF} ORDER BY rrf DESC, doc_id LIMIT 20) JOIN meta USING (doc_id) WHERE year >= 2023 AND doc_id % 17 <> 0 ORDER BY rrf DESC, doc_id LIMIT 10""",
    f"{_Q}, {_LEX}, {_META}, {_VEC}, " + _DEN.replace("FROM e, qq ORDER", "FROM e, qq WHERE 2022 + doc_id % 4 >= 2023 AND doc_id IN (SELECT doc_id FROM documents) ORDER")))
def x1h(spark, d):
    e = engine(spark, d)
    return e.search(PROBE, "hybrid", 10, "year:>=2023", vector_of(spark, e.vectors, 7)).select("doc_id", "rrf")


@query("x1_search_rerank", _with('SELECT doc_id, final FROM (SELECT doc_id, round(6e-1 * "cross" + 4e-1 * score / greatest(1e-4, max(score) OVER ()), 6) AS final FROM lexn JOIN cs USING (doc_id) ORDER BY final DESC, doc_id LIMIT 20) WHERE doc_id % 17 <> 0 ORDER BY final DESC, doc_id LIMIT 10', f"{_Q}, {_LEXN.format(n=50)}, {_CROSS}"))
def x1r(spark, d):
    return engine(spark, d).search(PROBE, "rerank", 10).select("doc_id", "final")


@query("x1_search_phrase", _with("SELECT DISTINCT a.doc_id, 1e0 AS score FROM words a JOIN words b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.term = 'anea' AND b.term = 'eriner' AND a.doc_id % 17 <> 0 ORDER BY doc_id LIMIT 10"))
def x1p(spark, d):
    return engine(spark, d).search("anea eriner", "phrase", 10).select("doc_id", "score")


@query("l9_search_facade", _with("SELECT doc_id, round(score * (1 + coalesce(boost, 0)), 6) AS score FROM lexn LEFT JOIN b USING (doc_id) WHERE doc_id % 17 <> 0 ORDER BY score DESC, doc_id LIMIT 10", f"{_Q}, {_LEXN.format(n=30)}, {_CLICKS}"))
def l9(spark, d):
    """Spelling, then the lexical search, then boosts by clicks."""
    e = engine(spark, d)
    boosted = Engine(e.docs, dead=e.dead, clicks=_clicks(spark, d), analyzer="stop")
    boosted.index = e.index
    return boosted.search("eringg thble thing", "bm25", 10, spell=True).select("doc_id", "score")


@query("x5_clicks", "SELECT event_id % 5 - 2 AS doc_id, count(*) AS n FROM events WHERE event_type = 'click' AND event_id % 5 - 2 > 0 GROUP BY 1")
def x5(spark, d):
    """Clicks on ids of 0 and less are refused."""
    clicks = table(spark, d, "events").filter("event_type = 'click'").select((F.col("event_id") % 5 - 2).alias("doc_id"))
    return clicks.filter("doc_id > 0").groupBy("doc_id").agg(F.count("*").alias("n"))


@query("x3_metrics", "SELECT format('search_requests_total {}', count(*)) || chr(10) || format('search_latency_avg_ms {:.3f}', sum(value) / (count(*) * 1000.0)) AS metrics FROM events")
def x3(spark, d):
    return engine(spark, d).metrics(table(spark, d, "events"))


@query("x4_health", "SELECT 'ok' AS status, count(*) AS n FROM documents")
def x4(spark, d):
    return engine(spark, d).health()


@query("x7_projection", _with("SELECT doc_id, round(score, 4) AS score, category, year FROM lexn JOIN meta USING (doc_id) WHERE doc_id % 17 <> 0 ORDER BY score DESC, doc_id LIMIT 5", f"{_Q}, {_LEXN.format(n=15)}, {_META}"))
def x7(spark, d):
    return engine(spark, d).search(PROBE, "bm25", 5).select("doc_id", F.round("score", 4).alias("score"), "category", "year")
