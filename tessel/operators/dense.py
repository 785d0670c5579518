"""Dense retrieval: exact and approximate nearest neighbours, scalar quantisation, pooling."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def literal(vector) -> Column:
    return F.array(*(F.lit(float(x)) for x in vector))


def knn(vectors: DataFrame, query, k: int = 10, predicate: Column | None = None) -> DataFrame:
    """(vec_id, sim): exact top k by inner product; a predicate filters before the scoring."""
    rows = vectors if predicate is None else vectors.filter(predicate)
    sim = F.round(dot(F.col("embedding"), literal(query)), 6)
    return rows.select("vec_id", sim.alias("sim")).orderBy(F.desc("sim"), "vec_id").limit(k)


def _packed(rows: DataFrame, name: str, block: int) -> DataFrame:
    """(name_ids, name_rows): blocks of up to `block` rows of (name, embedding) as packed arrays; null vectors left out."""

    def run(it):
        for batch in it:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                v = part.column(1)
                if len(set(pc.list_value_length(v).to_pylist())) > 1:
                    raise ValueError("vectors differ in length")
                ids, x = part.column(0).to_numpy(zero_copy_only=False), v.flatten().to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array([ids.astype(np.int64).tobytes()], pa.binary()), pa.array([x.astype(np.float64).tobytes()], pa.binary())], [f"{name}_ids", f"{name}_rows"])

    return rows.select(F.col(name).cast("long"), "embedding").filter("embedding is not null").mapInArrow(run, f"{name}_ids binary, {name}_rows binary")


def _best(row: np.ndarray, vec: np.ndarray, sim: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k entries of each row with the largest sim, then the least vec."""
    order = np.lexsort((vec, -sim, row))
    row, vec, sim = row[order], vec[order], sim[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[keep], vec[keep], sim[keep]


def knn_batch(vectors: DataFrame, queries: DataFrame, k: int = 10, block: int = 4096, query_block: int = 1024) -> DataFrame:
    """(query_id, vec_id, sim, rank) for all queries (query_id, embedding) against all vectors; null vectors match nothing.

    Both sides are packed into blocks and every block of queries meets every block of vectors, so neither the driver
    nor a task holds more than a block of each. A task keeps k per query while its vectors pass; the lists are merged.
    """
    asked = queries.select("query_id", "embedding").filter("embedding is not null")
    asked = asked.repartition(max(1, -(-asked.count() // query_block)))

    def run(it):
        ids, held = None, None
        for batch in it:
            for q_ids, q_rows, v_ids, v_rows in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if ids is None or (q_ids, q_rows) != ids:
                    if ids is not None:
                        yield from out(ids[0], held)
                    ids, held, m = (q_ids, q_rows), (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)), np.frombuffer(q_rows)
                    m = m.reshape(len(q_ids) // 8, -1)
                vec = np.frombuffer(v_ids, np.int64)
                sims = np.round(m @ np.frombuffer(v_rows).reshape(len(vec), -1).T, 6)
                least = np.partition(sims, len(vec) - k, axis=1)[:, len(vec) - k] if len(vec) > k else np.full(len(m), -np.inf)
                row, col = np.nonzero(~(sims < least[:, None]))
                held = _best(np.concatenate((held[0], row)), np.concatenate((held[1], vec[col])), np.concatenate((held[2], sims[row, col])), k)
        if ids is not None:
            yield from out(ids[0], held)

    def out(q_ids, held):
        yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(q_ids, np.int64)[held[0]]), pa.array(held[1]), pa.array(held[2])], ["query_id", "vec_id", "sim"])

    pairs = _packed(asked, "query_id", query_block).hint("shuffle_replicate_nl").crossJoin(_packed(vectors, "vec_id", block))
    found = pairs.mapInArrow(run, "query_id long, vec_id long, sim double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("sim"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def sq8(vectors: DataFrame) -> DataFrame:
    """(vec_id, min, scale, q): one byte per component, rounded half away from zero; scale 1 for flat vectors."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    lo, hi = F.array_min("x"), F.array_max("x")
    scale = F.when(hi - lo <= 1e-8, 1.0).otherwise((hi - lo) / 255)
    out = vectors.select("vec_id", x.alias("x")).withColumn("min", lo).withColumn("scale", scale)
    q = F.transform("x", lambda v: F.greatest(F.lit(0), F.least(F.lit(255), F.round((v - F.col("min")) / F.col("scale")).cast("int"))))
    return out.select("vec_id", "min", "scale", q.alias("q"))


def sq8_dequantized(quantized: DataFrame) -> DataFrame:
    return quantized.select("vec_id", F.transform("q", lambda b: F.col("min") + b * F.col("scale")).alias("embedding"))


def sq8_search(quantized: DataFrame, query, k: int = 10) -> DataFrame:
    """Asymmetric distance: min * sum(query) + scale * sum(byte * query)."""
    total = float(np.sum(np.asarray(query, np.float64)))
    sim = F.round(F.col("min") * total + F.col("scale") * dot(F.col("q"), literal(query)), 6)
    return quantized.select("vec_id", sim.alias("sim")).orderBy(F.desc("sim"), "vec_id").limit(k)


def memory_bytes(vectors: DataFrame) -> DataFrame:
    d = F.size("embedding").cast("long")
    return vectors.agg(F.sum(4 * d).alias("flat_bytes"), F.sum(d + 8).alias("sq8_bytes"))


def save_sq8(quantized: DataFrame, path: str) -> None:
    """Rows of sq8() with their components as bytes, and a row with marker and version."""
    raw = F.transform("q", lambda b: F.lpad(F.hex(b), 2, "0"))
    quantized.select("vec_id", "min", "scale", F.unhex(F.array_join(raw, "")).alias("bytes")).write.mode("overwrite").parquet(f"{path}/rows")
    quantized.sparkSession.createDataFrame([("SQ81", 1)], "magic string, version int").write.mode("overwrite").parquet(f"{path}/manifest")


def load_sq8(spark: SparkSession, path: str) -> DataFrame:
    head = spark.read.parquet(f"{path}/manifest").first()
    if head is None or (head["magic"], head["version"]) != ("SQ81", 1):
        raise ValueError(f"{path} holds no quantized vectors of version 1")
    at = F.sequence(F.lit(1), F.length("bytes"))
    digits = F.transform(at, lambda i: F.conv(F.hex(F.substring(F.col("bytes"), i, F.lit(1))), 16, 10).cast("int"))
    rows = spark.read.parquet(f"{path}/rows")
    return rows.select("vec_id", "min", "scale", F.when(F.length("bytes") > 0, digits).otherwise(F.array().cast("array<int>")).alias("q"))


def mean_pool(tokens: DataFrame) -> DataFrame:
    """(doc_id, embedding): mean of the unmasked token vectors (doc_id, mask, embedding), scaled to unit length."""
    long_ = tokens.filter("mask = 1").select("doc_id", F.posexplode("embedding").alias("i", "x"))
    mean = long_.groupBy("doc_id", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    v = mean.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("v"))
    norm = F.sqrt(dot(F.col("v"), F.col("v")))
    return v.select("doc_id", F.transform("v", lambda x: x / F.greatest(norm, F.lit(1e-12))).alias("embedding"))


def unit_check(vectors: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    norm = F.sqrt(dot(F.col("embedding"), F.col("embedding")))
    return vectors.agg(F.count("*").alias("vectors"), F.count(F.when(F.abs(norm - 1) < tolerance, 1)).alias("unit"))


def encode(texts: DataFrame, model: Callable[[list[str]], np.ndarray], column: str = "text", batch: int = 16, unit: float | None = None) -> DataFrame:
    """texts with embedding: the pluggable encoder gets `batch` texts at a time, null ones as empty.

    With `unit`, a vector whose norm is off 1 by more than that raises.
    """
    from pyspark.sql import types as T

    def run(it):
        for part in it:
            asked = part[column].fillna("").tolist()
            made = [np.asarray(model(asked[i : i + batch])) for i in range(0, len(asked), batch)]
            vectors = np.concatenate(made) if made else np.zeros((0, 0))
            if unit is not None and len(vectors) and np.abs(np.linalg.norm(vectors, axis=1) - 1).max() > unit:
                raise ValueError("the encoder's vectors are not of unit length")
            part["embedding"] = list(vectors)
            yield part

    return texts.mapInPandas(run, T.StructType([*texts.schema, T.StructField("embedding", T.ArrayType(T.FloatType()))]))


def vector_of(spark: SparkSession, vectors: DataFrame, vec_id: int) -> list[float]:
    return list(vectors.filter(F.col("vec_id") == vec_id).first()["embedding"])
