"""Queries over vectors."""

from pyspark.sql import functions as F

from tessel.operators import dense, graph
from tessel.queries.registry import query, table

_E = "e AS (SELECT vec_id, label, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS v FROM embeddings), q AS (SELECT v AS qv FROM e WHERE vec_id = 7)"


def _q(spark, d, i=7):
    e = table(spark, d, "embeddings")
    return e, dense.vector_of(spark, e, i)


@query("d1_inner_product", f"WITH {_E} SELECT vec_id, round(list_dot_product(v, qv), 6) AS sim FROM e, q")
def d1(spark, d):
    e, q = _q(spark, d)
    return e.select("vec_id", F.round(dense.dot(F.col("embedding"), dense.literal(q)), 6).alias("sim"))


@query("d2_knn_flat", f"WITH {_E} SELECT vec_id, round(list_dot_product(v, qv), 6) AS sim FROM e, q ORDER BY sim DESC, vec_id LIMIT 10")
def d2(spark, d):
    e, q = _q(spark, d)
    return dense.knn(e, q, 10)


@query("d2_knn_batch", f"WITH {_E}, s AS (SELECT a.vec_id AS query_id, b.vec_id, round(list_dot_product(a.v, b.v), 6) AS sim FROM e a, e b WHERE a.vec_id % 50 = 0), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS INTEGER) AS rank FROM s) SELECT * FROM r WHERE rank <= 10")
def d2b(spark, d):
    e = table(spark, d, "embeddings")
    return dense.knn_batch(e, e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 10)


@query("d3_d4_ann_search")
def d34(spark, d):
    """Every vector whose id is divisible by 50 is asked against the graph of all."""
    e = table(spark, d, "embeddings")
    return graph.search(graph.build(e), e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 10)


@query("d5_knn_filtered", f"WITH {_E} SELECT vec_id, round(list_dot_product(v, qv), 6) AS sim FROM e, q WHERE label IN (1, 3) ORDER BY sim DESC, vec_id LIMIT 10")
def d5(spark, d):
    e, q = _q(spark, d)
    return dense.knn(e, q, 10, F.col("label").isin(1, 3))


_S = f"{_E}, mm AS (SELECT vec_id, v, list_min(v) AS lo, list_max(v) AS hi FROM e), sq AS (SELECT vec_id, v, lo AS mn, CASE WHEN hi - lo <= 1e-8 THEN 1e0 ELSE (hi - lo) / 255 END AS sc FROM mm), qz AS (SELECT vec_id, v, mn, sc, list_transform(v, lambda x: CAST(greatest(0, least(255, round((x - mn) / sc))) AS INTEGER)) AS q FROM sq)"


@query("d6_sq8_quantize", f"WITH {_S} SELECT vec_id, round(mn, 9) AS min, round(sc, 9) AS scale, q FROM qz")
def d6(spark, d):
    s = dense.sq8(table(spark, d, "embeddings"))
    return s.select("vec_id", F.round("min", 9).alias("min"), F.round("scale", 9).alias("scale"), "q")


@query("d7_sq8_search", f"WITH {_S} SELECT vec_id, round(mn * list_sum(qv) + sc * list_dot_product(list_transform(qz.q, lambda x: CAST(x AS DOUBLE)), qv), 6) AS sim FROM qz, q ORDER BY sim DESC, vec_id LIMIT 10")
def d7(spark, d):
    e, q = _q(spark, d)
    return dense.sq8_search(dense.sq8(e), q, 10)


@query("d8_sq8_error", f"WITH {_S} SELECT count(*) AS vectors, count(*) FILTER (WHERE err < 5e-2) AS close FROM (SELECT list_max(list_transform(range(1, len(v) + 1), lambda i: abs(v[i] - (mn + q[i] * sc)))) AS err FROM qz)")
def d8(spark, d):
    e = table(spark, d, "embeddings")
    both = e.join(dense.sq8_dequantized(dense.sq8(e)).withColumnRenamed("embedding", "back"), "vec_id")
    err = F.array_max(F.zip_with("embedding", "back", lambda a, b: F.abs(a.cast("double") - b)))
    return both.agg(F.count("*").alias("vectors"), F.count(F.when(err < 0.05, 1)).alias("close"))


@query("d9_memory_bytes", "SELECT CAST(sum(4 * len(embedding)) AS BIGINT) AS flat_bytes, CAST(sum(len(embedding) + 8) AS BIGINT) AS sq8_bytes FROM embeddings")
def d9(spark, d):
    return dense.memory_bytes(table(spark, d, "embeddings"))


@query("d11_mean_pool", "WITH x AS (SELECT label AS doc_id, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings WHERE vec_id % 2 = 0), m AS (SELECT doc_id, i, avg(CAST(x AS DOUBLE)) AS x FROM x GROUP BY ALL), n AS (SELECT doc_id, sqrt(sum(x * x)) AS n FROM m GROUP BY doc_id) SELECT CAST(doc_id AS INTEGER) AS doc_id, CAST(i AS INTEGER) AS i, round(x / n, 6) AS x FROM m JOIN n USING (doc_id)")
def d11(spark, d):
    e = table(spark, d, "embeddings").select(F.col("label").alias("doc_id"), F.when(F.col("vec_id") % 2 == 0, 1).otherwise(0).alias("mask"), "embedding")
    return dense.mean_pool(e).select("doc_id", F.posexplode("embedding").alias("i", "x")).select("doc_id", "i", F.round("x", 6).alias("x"))


@query("d12_unit_check", f"WITH {_E} SELECT count(*) AS vectors, count(*) FILTER (WHERE abs(sqrt(list_dot_product(v, v)) - 1) < 1e-4) AS unit FROM e")
def d12(spark, d):
    return dense.unit_check(table(spark, d, "embeddings"))
