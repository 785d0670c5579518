"""Corpus pipeline: language, near duplicates, secrets, mixture, packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessel.llm import langid, mixing, ngram_join, packing, secrets
from tessel.llm._common import remove, shared_dir, small, staged


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose predicted language is a learned one and fits.

    Null and empty texts, texts without letters and texts in a script that no label taught go; rows that repeat stay as
    often as they occur. Columns are as they were.
    """
    return langid.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group stays: the least doc_id, null ids last, then the least hash of the text.

    A row is known by its doc_id and a hash of its text, so one id over two texts is two rows, each of its own group.
    Of rows equal in both, the first by their other columns stays. Rows without words (null or empty text) are in no
    group and stay. Columns are as they were.
    """
    own = F.xxhash64("text")
    key = F.struct(F.col("doc_id").isNull().alias("late"), F.col("doc_id").alias("id"), own.alias("own"))
    found = ngram_join.near_duplicates(docs.select(key.alias("doc_id"), "text")).filter("n_shingles > 0")
    kinds = found.groupBy("doc_id", "component_id").agg(F.count("*").alias("n"))
    kinds = kinds.select(F.col("doc_id.id").alias("id"), F.col("doc_id.own").alias("own"), (F.col("component_id") == F.col("doc_id")).alias("leads"), "n")
    marks = staged(kinds.filter("not leads or n > 1"), "marks")
    same = docs["doc_id"].eqNullSafe(F.col("id")) & (own == F.col("own"))
    out = docs.join(small(marks.select("id", "own"), 1_000_000), same, "left_anti").select(*docs.columns)
    again = staged(marks.filter("leads").select("id", "own"), "again")
    if again.isEmpty():
        return out
    nth = F.row_number().over(Window.partitionBy("id", "own").orderBy(*docs.columns))
    first = docs.join(small(again, 1_000_000), same).withColumn("nth", nth).filter("nth = 1")
    return out.unionByName(first.select(*docs.columns))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret is replaced by a mark and n_chars set anew; all documents stay, rows that repeat and null texts too."""
    return secrets.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources meet their target weights.

    Null texts count no words, and stay as often as their source's rate says. Columns are as they were, and repeats of a
    document are equal rows.
    """
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences; every row is packed, also one that repeats or is empty."""
    return packing.pack(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("secrets", secret_scan), ("mixture", mixture), ("packing", packed)]
#: Stages 1, 3 and 5 can't be expressed in SQL; the tests hold every stage's output against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over sf_dir's documents; a stage's files are deleted once the next one's are written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        out.write.parquet(f"{root}/{i}-{name}")
        if i:
            remove(spark, f"{root}/{i - 1}-{STAGES[i - 1][0]}")
        docs = spark.read.parquet(f"{root}/{i}-{name}")
    return docs
