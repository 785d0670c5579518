"""Ranking quality, latency statistics and codec sizes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def relevance(docs: DataFrame, keywords: DataFrame) -> DataFrame:
    """(query_id, doc_id, rel): weights of the query's keywords (query_id, kw, weight) that a text contains in any case.

    The keyword table is a few rows of an evaluation set and is broadcast.
    """
    hit = F.contains(F.lower("text"), F.lower("kw"))
    got = docs.join(F.broadcast(keywords), hit).groupBy("query_id", "doc_id").agg(F.sum("weight").alias("rel"))
    return got


def dcg(gain: Column, rank: Column) -> Column:
    return F.sum((F.pow(F.lit(2.0), gain) - 1) / F.log2(rank + 1))


def ndcg(results: DataFrame, gains: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, dcg, idcg, ndcg): results (query_id, doc_id, rank) against gains (query_id, doc_id, rel) of the whole corpus."""
    got = results.filter(F.col("rank") <= k).join(gains, ["query_id", "doc_id"], "left")
    real = got.groupBy("query_id").agg(dcg(F.coalesce("rel", F.lit(0.0)), F.col("rank")).alias("dcg"))
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rel"), "doc_id"))
    ideal = gains.withColumn("nth", nth).filter(F.col("nth") <= k).groupBy("query_id").agg(dcg(F.col("rel"), F.col("nth")).alias("idcg"))
    out = real.join(ideal, "query_id", "left").withColumn("idcg", F.coalesce("idcg", F.lit(0.0)))
    return out.select("query_id", F.round("dcg", 6).alias("dcg"), F.round("idcg", 6).alias("idcg"), F.round(F.coalesce(F.try_divide("dcg", "idcg"), F.lit(0.0)), 6).alias("ndcg"))


def gain_percent(base: Column, new: Column) -> Column:
    return F.when(base == 0, 0.0).otherwise((new - base) / base * 100)


def mean_gain(base: DataFrame, new: DataFrame) -> DataFrame:
    """One row: mean ndcg over the queries of either result of ndcg(), and the gain in percent; a query that is missing counts 0."""
    both = base.select("query_id", F.col("ndcg").alias("b")).join(new.select("query_id", F.col("ndcg").alias("n")), "query_id", "full")
    means = both.agg(F.avg(F.coalesce("b", F.lit(0.0))).alias("base_ndcg"), F.avg(F.coalesce("n", F.lit(0.0))).alias("new_ndcg"))
    return means.select(F.round("base_ndcg", 6).alias("base_ndcg"), F.round("new_ndcg", 6).alias("new_ndcg"), F.round(gain_percent(F.col("base_ndcg"), F.col("new_ndcg")), 4).alias("gain_percent"))


def latency(samples: DataFrame, value: str = "value", *by: str) -> DataFrame:
    """mean, population deviation, interpolated percentiles and samples per second of latencies in microseconds."""
    p = lambda q: F.round(F.percentile(value, F.lit(q)), 6)
    return samples.groupBy(*by).agg(
        F.count("*").alias("n"), F.round(F.avg(value), 6).alias("mean"), F.round(F.stddev_pop(value), 6).alias("std"),
        p(0.5).alias("p50"), p(0.95).alias("p95"), p(0.99).alias("p99"), F.round(F.try_divide(F.count("*"), F.sum(value) / 1e6), 6).alias("qps"),
    )


def vbyte_size(value: Column) -> Column:
    """Bytes of a value in seven-bit groups."""
    return F.when(value < 128, 1).when(value < 16384, 2).when(value < 2097152, 3).when(value < 268435456, 4).otherwise(5)


def vbyte_encode(values: list[int], delta: bool = False) -> bytes:
    """Seven-bit groups, low first, the high bit on all but the last; with delta the differences from the value before."""
    out, before = bytearray(), 0
    for v in values:
        n, before = (v - before, v) if delta else (v, before)
        while n >= 128:
            out.append(n & 127 | 128)
            n >>= 7
        out.append(n)
    return bytes(out)


def vbyte_decode(raw: bytes, delta: bool = False) -> list[int]:
    data = np.frombuffer(raw, np.uint8)
    ends = np.flatnonzero(data < 128)
    starts = np.concatenate(([0], ends[:-1] + 1)) if len(ends) else ends
    out = [sum(int(b & 127) << 7 * i for i, b in enumerate(data[s : e + 1])) for s, e in zip(starts, ends, strict=True)]
    return np.cumsum(out).tolist() if delta else out


def vbyte_column(values: Column, delta: bool = False) -> Column:
    return F.pandas_udf(lambda s: s.map(lambda v: vbyte_encode([int(x) for x in v], delta)), T.BinaryType())(values)


def unvbyte_column(raw: Column, delta: bool = False) -> Column:
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda v: vbyte_decode(v, delta))

    return F.pandas_udf(run, T.ArrayType(T.LongType()))(raw)
