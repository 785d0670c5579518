"""Mutation log, tombstones and hash shards."""

from __future__ import annotations

import struct

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessel.functions.text import query_terms
from tessel.operators.index import Index, bm25, bm25_idf, tf_part, tfidf
from tessel.operators.lexical import phrase

INSERT, DELETE, UPDATE = 1, 2, 3


def replay(log: DataFrame) -> DataFrame:
    """(doc_id, content) that live after the log (seq, op, doc_id, content): the last write of each id wins."""
    last = F.max_by(F.struct("op", "content"), F.col("seq"))
    return log.groupBy("doc_id").agg(last.alias("w")).filter(F.col("w.op") != DELETE).select("doc_id", F.col("w.content").alias("content"))


def tombstones(log: DataFrame) -> DataFrame:
    return log.groupBy("doc_id").agg(F.max_by("op", "seq").alias("op")).filter(F.col("op") == DELETE).select("doc_id")


def live(rows: DataFrame, dead: DataFrame) -> DataFrame:
    return rows.join(dead.select("doc_id").distinct(), "doc_id", "left_anti")


def total_docs(docs: DataFrame, dead: DataFrame) -> DataFrame:
    """One row: documents less tombstones, at least 0; tombstones of unknown ids count."""
    n = docs.agg(F.count("*").alias("n")).join(F.broadcast(dead.agg(F.count_distinct("doc_id").alias("d"))))
    return n.select(F.greatest(F.lit(0).cast("long"), F.col("n") - F.col("d")).alias("live_docs"))


#: Marker and version at the head of a log file.
LOG_MAGIC, LOG_VERSION = 0x57414C31, 1


def log_record(op: int, doc_id: int, content: str | None) -> bytes:
    """One record of a log file: operation, id, length and UTF-8 bytes of the content, little-endian and unpadded."""
    raw = b"" if op == DELETE else (content or "").encode()
    return struct.pack("<BiI", op, doc_id, len(raw)) + raw


def log_records(raw: bytes) -> list[tuple[int, int, str]]:
    """(op, doc_id, content) of a log file; a record cut off at the end is left out, a wrong head raises."""
    if len(raw) < 8 or struct.unpack_from("<II", raw) != (LOG_MAGIC, LOG_VERSION):
        raise ValueError("not a log file")
    at, out = 8, []
    while at + 9 <= len(raw):
        op, doc_id, size = struct.unpack_from("<BiI", raw, at)
        if at + 9 + size > len(raw):
            break
        out.append((op, doc_id, raw[at + 9 : at + 9 + size].decode("utf-8", "replace")))
        at += 9 + size
    return out


class MutationLog:
    """A log table (seq, op, doc_id, content) under a path of any file system that Spark reaches.

    open() creates it where it is missing, append() adds rows, rows() reads what is there, clear() starts a new empty
    generation. A generation is a folder; the newest one counts, so a clear() that breaks off leaves the old one whole.
    """

    SCHEMA = "seq long, op int, doc_id long, content string"

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._at = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._at.getFileSystem(spark._jsc.hadoopConfiguration())

    def _generations(self) -> list[int]:
        if not self._fs.exists(self._at):
            return []
        names = (s.getPath().getName() for s in self._fs.listStatus(self._at))
        return sorted(int(n.split("=")[1]) for n in names if n.startswith("generation="))

    def _folder(self, n: int) -> str:
        return f"{self.path}/generation={n}"

    def _start(self, n: int) -> None:
        self.spark.createDataFrame([], self.SCHEMA).write.parquet(self._folder(n))

    def open(self) -> MutationLog:
        if not self._generations():
            self._start(0)
        return self

    def append(self, rows: DataFrame) -> None:
        self.open()
        rows.select(*(F.col(c).cast(t).alias(c) for c, t in (x.split() for x in self.SCHEMA.split(", ")))).write.mode("append").parquet(self._folder(self._generations()[-1]))

    def rows(self) -> DataFrame:
        found = self._generations()
        return self.spark.read.schema(self.SCHEMA).parquet(self._folder(found[-1])) if found else self.spark.createDataFrame([], self.SCHEMA)

    def clear(self) -> None:
        found = self._generations()
        self._start(found[-1] + 1 if found else 0)
        for n in found:
            self._fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(self._folder(n)), True)


def append_log(rows: DataFrame, path: str) -> None:
    MutationLog(rows.sparkSession, path).append(rows)


def shard_of(doc_id: Column, shards: int = 4) -> Column:
    return (F.abs(doc_id) % shards).cast("int")


def sharded_search(index: Index, text: str, k: int = 10, shards: int = 4, dead: DataFrame | None = None) -> DataFrame:
    """Top k over shards that each know only their own statistics: 2k a shard, tombstones dropped, k a shard, k in all."""
    spark = index.docs.sparkSession
    tokens = query_terms(text, index.analyzer)
    q = F.broadcast(spark.createDataFrame([(t, tokens.count(t)) for t in dict.fromkeys(tokens)], "term string, qtf int"))
    shard = shard_of(F.col("doc_id"), shards)
    stats = index.doc_len.groupBy(shard.alias("shard")).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    hits = index.hits(tokens).join(q, "term").withColumn("shard", shard)
    df = hits.groupBy("shard", "term").agg(F.count("*").alias("df"))
    p = hits.join(df, ["shard", "term"]).join(F.broadcast(stats), "shard")  # stats: one row a shard
    s = 0.7 * bm25(F.col("tf"), F.col("df"), F.col("n"), F.col("dl"), F.col("avgdl")) + 0.3 * tfidf(F.col("tf"), F.col("df"), F.col("n"), F.col("dl"))
    scored = p.groupBy("shard", "doc_id").agg(F.round(F.sum(F.col("qtf") * s), 6).alias("score")).filter("score > 0")
    nth = F.row_number().over(Window.partitionBy("shard").orderBy(F.desc("score"), "doc_id"))
    near = scored.withColumn("nth", nth).filter(F.col("nth") <= 2 * k)
    near = live(near, dead) if dead is not None else near
    near = near.withColumn("nth", nth).filter(F.col("nth") <= k)
    return near.select("doc_id", "shard", "score").orderBy(F.desc("score"), "doc_id").limit(k)


def shard_bounds(index: Index, shards: int = 4) -> DataFrame:
    """(shard, term, df, max_score): what each shard knows of its terms, from its own statistics; one aggregation."""
    shard = shard_of(F.col("doc_id"), shards).alias("shard")
    stats = F.broadcast(index.doc_len.groupBy(shard).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")))  # one row a shard
    p = index.postings.select("term", "tf", "dl", shard).join(stats, "shard")
    most = p.groupBy("shard", "term").agg(F.count("*").alias("df"), F.max(tf_part(F.col("tf"), F.col("dl"), F.col("avgdl"))).alias("part"), F.max(F.col("tf") / F.col("dl")).alias("share"), F.first("n").alias("n"))
    score = 0.7 * bm25_idf(F.col("df"), F.col("n")) * F.col("part") + 0.3 * F.col("share") * F.log(F.col("n") / F.col("df"))
    return most.select("shard", "term", "df", score.alias("max_score"))


def sharded_phrase(index: Index, tokens: list[str], shards: int = 4) -> DataFrame:
    return phrase(index, tokens).select("doc_id", shard_of(F.col("doc_id"), shards).alias("shard"))
