"""Sources and sinks: text lines, whole files, flat vector files, JSON bodies, page texts, generated corpora."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MAX_DIM = 4096


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text): one document a non-empty line, ids from 1 in file order."""
    lines = spark.read.text(path).select("value", F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("m"))
    ids = lines.filter("value <> ''").rdd.zipWithIndex()  # ids follow the partitions; no sort in one task
    return ids.map(lambda x: (x[1] + 1, x[0]["value"])).toDF("doc_id long, text string")


def read_whole(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True)


def numbered(lines: DataFrame, order: str) -> DataFrame:
    """(doc_id, text) of a small table of lines: empty ones take no id."""
    return lines.filter("text <> ''").select(F.row_number().over(Window.orderBy(order)).alias("doc_id"), "text")


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write_vectors(vectors: DataFrame, path: str, rows: int = 1_000_000) -> None:
    """Flat files under path, each with counts n and dim and n rows of float32; files and rows are in the order of vec_id.

    Each range of ids is a task that writes one file of about `rows` vectors; nothing passes the driver.
    """
    parts = max(1, -(-vectors.count() // rows))
    cut = vectors.select("vec_id", "embedding").repartitionByRange(parts, "vec_id").sortWithinPartitions("vec_id")

    def run(it):
        from pyspark import TaskContext

        parts = [np.stack([np.asarray(r, "<f4") for r in part["embedding"]]) for part in it if len(part)]
        if not parts:
            return
        m, (system, base) = np.concatenate(parts), _fs(path)
        system.create_dir(base, recursive=True)
        name = f"part-{TaskContext.get().partitionId():06d}.bin"
        with system.open_output_stream(f"{base}/_{name}") as f:
            f.write(struct.pack("<ii", *m.shape))
            f.write(m.tobytes())
        system.move(f"{base}/_{name}", f"{base}/{name}")
        yield pd.DataFrame({"file": [name], "vectors": [len(m)]})

    cut.mapInPandas(run, "file string, vectors long").collect()  # one row a file


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(vec_id, embedding) from a flat file or a folder of them; ids count from 1 over the files in the order of their names.

    Only heads are read to number the files; a file is then read by one task. A malformed file raises.
    """

    def heads(it):
        for part in it:
            for name, size, raw in zip(part["path"], part["length"], part["head"], strict=True):
                n, dim = struct.unpack("<ii", raw) if len(raw) == 8 else (0, 0)
                if n <= 0 or not 0 < dim <= MAX_DIM or size < 8 + 4 * n * dim:
                    raise ValueError(f"{name} is not a vector file")
                yield pd.DataFrame({"path": [name], "n": [n]})

    def rows(it):
        for part in it:
            for before, raw in zip(part["before"], part["content"], strict=True):
                n, dim = struct.unpack_from("<ii", raw)
                m = np.frombuffer(raw, "<f4", n * dim, 8).reshape(n, dim)
                for at in range(0, n, 10_000):
                    ids = np.arange(before + at + 1, before + min(n, at + 10_000) + 1)
                    yield pd.DataFrame({"vec_id": ids, "embedding": list(m[at : at + 10_000])})

    found = spark.read.format("binaryFile").load(path)
    found = found.filter(~F.element_at(F.split("path", "/"), -1).startswith("_"))
    sizes = found.select("path", "length", F.substring("content", 1, 8).alias("head")).mapInPandas(heads, "path string, n long").collect()  # one row a file
    before, at = [], 0
    for r in sorted(sizes):
        before.append((r["path"], at))
        at += r["n"]
    places = F.broadcast(spark.createDataFrame(before, "path string, before long"))
    return found.select("path", "content").join(places, "path").select("before", "content").mapInPandas(rows, "vec_id long, embedding array<float>")


def parse_bodies(bodies: DataFrame, column: str = "body") -> DataFrame:
    """docId, content and category of JSON bodies; missing ones are 0 and ''."""
    j = F.from_json(column, "docId INT, content STRING, category STRING")
    return bodies.select("*", F.coalesce(j["docId"], F.lit(0)).alias("docId"), F.coalesce(j["content"], F.lit("")).alias("content"), F.coalesce(j["category"], F.lit("")).alias("category"))


def page_text(html: Column) -> Column:
    """Text of a page: tags removed, blanks collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]*>", " "), r"[ \t\n\r\f\x0B]+", " "))


def repeated_corpus(docs: DataFrame, total: int) -> DataFrame:
    """(doc_id, text) of `total` documents: docs (doc_id from 0 without gaps) over and over, each with its own two words at the end."""
    n = docs.count()
    if not n:
        return docs.select("doc_id", "text")
    r = F.explode(F.sequence(F.lit(0), F.lit(-(-total // n) - 1))).alias("r")
    rows = docs.select("doc_id", "text", r).withColumn("at", F.col("r") * n + F.col("doc_id")).filter(F.col("at") < total)
    return rows.select(F.col("at").alias("doc_id"), F.concat_ws(" ", F.col("text"), F.concat(F.lit("term_"), F.col("r").cast("string")), F.col("at").cast("string")).alias("text"))


def query_params(url: Column) -> Column:
    """Map of a url's query: %xx and + are decoded, the last of equal keys wins, a part without = is left out."""
    raw = F.regexp_extract(url, r"\?([^#]*)", 1)
    parts = F.filter(F.split(raw, "&"), lambda p: F.contains(p, F.lit("=")))
    pairs = F.transform(parts, lambda p: F.struct(F.coalesce(F.try_url_decode(F.substring_index(p, "=", 1)), F.substring_index(p, "=", 1)).alias("k"), F.coalesce(F.try_url_decode(F.substring(p, F.instr(p, "=") + 1, F.length(p))), F.substring(p, F.instr(p, "=") + 1, F.length(p))).alias("v")))
    last = F.filter(pairs, lambda e, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda x: x["k"] == e["k"]))
    return F.map_from_entries(last)


def generated(spark: SparkSession, templates: list[str], topics: list[str], modifiers: list[str], repeats: int = 5) -> DataFrame:
    """(doc_id, text): every template ({topic}, {modifier}) with every topic and modifier, `repeats` times."""
    t = spark.createDataFrame(list(enumerate(templates)), "t int, template string")
    p = spark.createDataFrame(list(enumerate(topics)), "p int, topic string")
    m = spark.createDataFrame(list(enumerate(modifiers)), "m int, modifier string")
    all_ = t.crossJoin(F.broadcast(p)).crossJoin(F.broadcast(m)).withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    n_p, n_m = len(topics), len(modifiers)
    doc_id = ((F.col("r") * len(templates) + F.col("t")) * n_p + F.col("p")) * n_m + F.col("m") + 1
    text = F.concat(F.replace(F.replace("template", F.lit("{topic}"), F.col("topic")), F.lit("{modifier}"), F.col("modifier")), F.lit(" Ref ID "), doc_id.cast("string"))
    return all_.select(doc_id.cast("long").alias("doc_id"), text.alias("text"))
