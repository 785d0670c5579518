"""Decorator that registers a query with its SQL, and frames shared by queries of one session."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessel.operators.index import Index

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
_INDEXES: dict[tuple, Index] = {}

#: Analysed tokens in SQL: normalised, split, stop words left out.
TOKENS = r"""
norm AS (SELECT doc_id, text, string_split(trim(lower(regexp_replace(regexp_replace(text, '[^A-Za-z0-9 \t\n\r\f\x0B]', '', 'g'), '[ \t\n\r\f\x0B]+', ' ', 'g'))), ' ') AS raw FROM documents),
toks AS (SELECT doc_id, text, list_filter(raw, lambda x: x <> '') AS alltok, list_filter(raw, lambda x: x <> '' AND x NOT IN ('a','an','and','are','as','at','be','by','for','from','has','he','in','is','it','its','of','on','that','the','to','was','will','with')) AS tokens FROM norm),
words AS (SELECT doc_id, unnest(tokens) AS term, unnest(range(len(tokens))) AS pos FROM toks),
post AS (SELECT term, doc_id, CAST(count(*) AS INTEGER) AS tf, list_sort(list(CAST(pos AS INTEGER))) AS positions FROM words GROUP BY ALL),
dlen AS (SELECT doc_id, CAST(len(tokens) AS INTEGER) AS dl FROM toks),
stats AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dlen),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
scored AS (SELECT p.*, df, dl, n, avgdl,
  ln(1e0 + (n - df + 5e-1) / (df + 5e-1)) * (tf * 25e-1) / (tf + 15e-1 * (25e-2 + 75e-2 * dl / avgdl)) AS bm25,
  CAST(tf AS DOUBLE) / dl * ln(CAST(n AS DOUBLE) / df) AS tfidf
  FROM post p JOIN dfs USING (term) JOIN dlen USING (doc_id), stats)
"""


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of files for each task of a table that is dealt out.
PART_BYTES = 16 << 20


def spread(rows: DataFrame) -> DataFrame:
    """A table's scan over all cores where its files are split into fewer parts, as a small table's are; else as it is.

    It is dealt to a task for each PART_BYTES of its files at least, so that what a task reads doesn't grow with the table.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    if rows.rdd.getNumPartitions() >= cores:
        return rows
    files = int(rows._jdf.queryExecution().optimizedPlan().collectLeaves().head().stats().sizeInBytes())
    return rows.repartition(max(cores, -(-files // PART_BYTES)))


def index(spark: SparkSession, sf_dir: str, analyzer: str = "stop") -> Index:
    """One index a session, table folder and analyser; its frames are persisted when first used."""
    key = spark.sparkContext.applicationId, sf_dir, analyzer
    if key not in _INDEXES:
        _INDEXES[key] = Index(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), analyzer)
    return _INDEXES[key]
