"""Inverted index as DataFrames: postings, lengths, statistics, bounds.

Postings are made document by document, without a shuffle; each carries its document's length, so that scoring needs no
join. Only statistics of terms are aggregated, with combination before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessel.functions.text import analyzed_tokens, remove_stop_words, slices, tokenize

K1, B = 1.5, 0.75
#: Width in doc_ids of the blocks in which a term's posting list is numbered.
BLOCK = 1 << 16
#: Cells of a histogram that narrows down the places of boundaries.
CELLS = 1024


def tf_part(tf: Column, dl: Column, avgdl: Column, k1: float = K1, b: float = B) -> Column:
    """What BM25 multiplies the inverse document frequency by."""
    return (tf * (k1 + 1)) / (tf + k1 * (1 - b + b * dl / avgdl))


def bm25_idf(df: Column, n: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def bm25(tf: Column, df: Column, n: Column, dl: Column, avgdl: Column, k1: float = K1, b: float = B) -> Column:
    return F.when((tf <= 0) | (df <= 0) | (avgdl <= 0), 0.0).otherwise(bm25_idf(df, n) * tf_part(tf, dl, avgdl, k1, b))


def tfidf(tf: Column, df: Column, n: Column, dl: Column) -> Column:
    return F.when((dl == 0) | (df == 0), 0.0).otherwise(tf / dl * F.log(n / df))


def _grouped(stem: bool):
    """Postings of batches of (doc_id, tokens): the tokens of a document are sorted by term and place at once."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in it for part in slices(whole)):
            words, lengths, terms = analyzed_tokens(batch.column(1), stem)
            if not len(words):
                continue
            doc = np.repeat(np.arange(len(lengths)), lengths)
            pos = np.arange(len(words)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            order = np.lexsort((pos, words, doc))
            doc, words, pos = doc[order], words[order], pos[order].astype(np.int32)
            first = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (words[1:] != words[:-1]))))
            tf = np.diff(np.append(first, len(words))).astype(np.int32)
            cols = [
                terms.take(pa.array(words[first])), batch.column(0).take(pa.array(doc[first])), pa.array(tf),
                pa.ListArray.from_arrays(pa.array(np.append(first, len(words)).astype(np.int32)), pa.array(pos)), pa.array(lengths[doc[first]].astype(np.int32)),
            ]
            yield pa.RecordBatch.from_arrays(cols, ["term", "doc_id", "tf", "positions", "dl"])

    return run


def postings_of(docs: DataFrame, analyzer: str = "stem") -> DataFrame:
    """(term, doc_id, tf, positions, dl) of docs(doc_id, text), one row a document and term; positions count after stop words."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    tokens = docs.select("doc_id", remove_stop_words(tokenize(F.coalesce("text", F.lit("")))).alias("tokens"))
    return tokens.mapInArrow(_grouped(analyzer == "stem"), f"term string, doc_id {kind}, tf int, positions array<int>, dl int")


class Index:
    """A lazily built index over docs(doc_id, text). Frames are persisted when `keep` is set; close() lets them go."""

    def __init__(self, docs: DataFrame, analyzer: str = "stem", keep: bool = True) -> None:
        self.docs, self.analyzer, self.keep = docs.select("doc_id", "text"), analyzer, keep
        self._held: list[DataFrame] = []
        self._known: dict[tuple[str, int], tuple] = {}

    def _kept(self, df: DataFrame) -> DataFrame:
        if self.keep:
            self._held.append(df.persist())
        return df

    def close(self) -> None:
        """Unpersists everything that the index holds."""
        for df in self._held:
            df.unpersist()
        self._held.clear()

    @cached_property
    def postings(self) -> DataFrame:
        """(term, doc_id, tf, positions, dl)."""
        return self._kept(postings_of(self.docs, self.analyzer))

    @cached_property
    def doc_len(self) -> DataFrame:
        return self._kept(self.docs.select("doc_id", F.size(remove_stop_words(tokenize(F.coalesce("text", F.lit(""))))).alias("dl")))

    @cached_property
    def stats(self) -> DataFrame:
        """One row: n, avgdl."""
        return self._kept(self.doc_len.agg(F.count("*").alias("n"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl")))

    @cached_property
    def totals(self) -> tuple[int, float]:
        """stats on the driver: two numbers."""
        r = self.stats.first()
        return r["n"], r["avgdl"]

    @cached_property
    def df(self) -> DataFrame:
        return self._kept(self.postings.groupBy("term").agg(F.count("*").alias("df")))

    def hits(self, tokens: list[str]) -> DataFrame:
        """Postings of some terms without positions; the filter reaches the files or the cached batches."""
        return self.postings.filter(F.col("term").isin(list(dict.fromkeys(tokens)))).select("term", "doc_id", "tf", "dl")

    def scored(self, postings: DataFrame, df: DataFrame | None = None) -> DataFrame:
        """postings with df, n, avgdl and the scores bm25, tfidf and score = 0.7 bm25 + 0.3 tfidf.

        df has a row for each term of postings, and is broadcast: postings hold the terms of a query. By default the
        terms' frequencies are counted from postings, which then must hold all of theirs.
        """
        n, avgdl = (F.lit(x) for x in self.totals)
        df = postings.groupBy("term").agg(F.count("*").alias("df")) if df is None else df
        p = postings.join(F.broadcast(df), "term").withColumns({"n": n, "avgdl": avgdl})
        b, t = bm25(F.col("tf"), F.col("df"), n, F.col("dl"), avgdl), tfidf(F.col("tf"), F.col("df"), n, F.col("dl"))
        return p.withColumn("bm25", b).withColumn("tfidf", t).withColumn("score", 0.7 * F.col("bm25") + 0.3 * F.col("tfidf"))

    @staticmethod
    def _bounds(postings: DataFrame, n: int, avgdl: float) -> DataFrame:
        part = F.max(tf_part(F.col("tf"), F.col("dl"), F.lit(avgdl))) if avgdl > 0 else F.lit(0.0)
        most = postings.groupBy("term").agg(F.count("*").alias("df"), part.alias("part"), F.max(F.col("tf") / F.col("dl")).alias("share"))
        most = most.withColumn("max_bm25", bm25_idf(F.col("df"), F.lit(n)) * F.col("part"))
        return most.select("term", "df", "max_bm25", (0.7 * F.col("max_bm25") + 0.3 * F.col("share") * F.log(F.lit(n) / F.col("df"))).alias("max_score"))

    @cached_property
    def bounds(self) -> DataFrame:
        """(term, df, max_bm25, max_score) of the whole vocabulary: upper bounds for pruning, in one aggregation without a join."""
        return self._kept(self._bounds(self.postings, *self.totals))

    def known(self, tokens: list[str], k: int) -> dict[str, tuple[int, float, float]]:
        """Term -> (df, max_score, k-th best score of the term alone, 0 if it has fewer), for the tokens of a query.

        Read once a term, from its own postings only, and then remembered on the driver.
        """
        new = [t for t in dict.fromkeys(tokens) if (t, k) not in self._known]
        if new:
            hits = self.hits(new)
            nth = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("score"), "doc_id"))
            best = self.scored(hits).withColumn("nth", nth).filter(F.col("nth") <= k)
            kth = best.groupBy("term").agg(F.max(F.when(F.col("nth") == k, F.col("score"))).alias("kth"))
            for r in self._bounds(hits, *self.totals).join(F.broadcast(kth), "term").collect():
                self._known[r["term"], k] = r["df"], r["max_score"], r["kth"] or 0.0
            for t in new:
                self._known.setdefault((t, k), (0, 0.0, 0.0))
        return {t: self._known[t, k] for t in tokens}

    def snapshot(self) -> Index:
        """A frozen view: DataFrames never change, so later additions build another index."""
        out = Index(self.docs, self.analyzer, keep=False)
        out.__dict__ |= {k: v for k, v in self.__dict__.items() if k in ("postings", "doc_len", "stats", "totals", "df", "bounds")}
        return out

    def sorted(self) -> Index:
        """The same index for many queries: postings lie sorted by term, so that a query reads only the batches of its terms."""
        out = self.snapshot()
        out.keep = True
        out.__dict__["postings"] = out._kept(self.postings.repartitionByRange("term").sortWithinPartitions("term", "doc_id"))
        return out

    def skips(self, every: int = 8) -> DataFrame:
        """(term, doc_id, idx) of every n-th posting."""
        return numbered(self.postings).filter(F.col("idx") % every == 0).select("term", "doc_id", F.col("idx").cast("int").alias("idx"))

    def save(self, path: str) -> None:
        """Postings sorted by term (so that row groups prune), lengths and documents, with a version marker."""
        self.postings.repartitionByRange("term").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{path}/postings")
        self.doc_len.write.mode("overwrite").parquet(f"{path}/doc_len")
        self.docs.write.mode("overwrite").parquet(f"{path}/docs")
        spark = self.docs.sparkSession
        spark.createDataFrame([("IIDX", 1, self.analyzer)], "magic string, version int, analyzer string").write.mode("overwrite").parquet(f"{path}/manifest")

    @classmethod
    def load(cls, spark, path: str) -> Index:
        m = spark.read.parquet(f"{path}/manifest").first()
        if m is None or (m["magic"], m["version"]) != ("IIDX", 1):
            raise ValueError(f"{path} holds no index of version 1")
        found = cls(spark.read.parquet(f"{path}/docs"), m["analyzer"], keep=False)
        found.__dict__["postings"] = spark.read.parquet(f"{path}/postings")
        found.__dict__["doc_len"] = spark.read.parquet(f"{path}/doc_len")
        return found


def numbered(postings: DataFrame) -> DataFrame:
    """(term, doc_id, idx, gap, decoded): place of each posting in its term's list, difference from the one before, running sum.

    A list is numbered in blocks of BLOCK doc_ids, and only the blocks of a term are put in line, so that the list of a
    common term is no single task's.
    """
    p = postings.select("term", "doc_id", F.floor(F.col("doc_id") / BLOCK).alias("block"))
    cells = p.groupBy("term", "block").agg(F.count("*").alias("n"), F.max("doc_id").alias("last"))
    line = Window.partitionBy("term").orderBy("block")
    cells = cells.select("term", "block", F.coalesce(F.sum("n").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.coalesce(F.lag("last").over(line), F.lit(0)).alias("last"))
    inside = Window.partitionBy("term", "block").orderBy("doc_id")
    p = p.join(cells, ["term", "block"])
    prev = F.coalesce(F.lag("doc_id").over(inside), F.col("last"))
    p = p.select("term", "doc_id", (F.col("before") + F.row_number().over(inside) - 1).alias("idx"), (F.col("doc_id") - prev).alias("gap"), "block", "last")
    decoded = F.col("last") + F.sum("gap").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    return p.select("term", "doc_id", "idx", "gap", decoded.alias("decoded"))


def cut_points(ids: DataFrame, ranks: list[int]) -> list[int]:
    """The ids (distinct longs in column doc_id) with the given ranks from 0, by histograms of CELLS cells that narrow down.

    Only histograms and one number a rank reach the driver, in as many passes as the ids' range has powers of CELLS.
    """
    ends = ids.agg(F.min("doc_id"), F.max("doc_id")).first()
    open_ = [(r, int(ends[0]), int(ends[1]), r) for r in ranks]  # rank, range of ids, rank within that range
    found: dict[int, int] = {}
    while open_:
        still = []
        for lo, hi in sorted({(lo, hi) for _, lo, hi, _ in open_}):
            width = max(1, -(-(hi - lo + 1) // CELLS))
            cell = F.floor((F.col("doc_id") - lo) / width)
            counts = sorted((r["c"], r["n"]) for r in ids.filter(F.col("doc_id").between(lo, hi)).groupBy(cell.alias("c")).agg(F.count("*").alias("n")).collect())
            for rank, a, b, left in [o for o in open_ if o[1:3] == (lo, hi)]:
                for c, n in counts:
                    if left < n:
                        at = lo + c * width
                        if width == 1:
                            found[rank] = at
                        else:
                            still.append((rank, at, min(b, at + width - 1), left))
                        break
                    left -= n
        open_ = still
    return [found[r] for r in ranks]


def segments(docs: DataFrame, count: int) -> DataFrame:
    """docs with segment: contiguous chunks of ceil(n / count) rows by doc_id, without a sort of the table."""
    n = docs.count()
    chunk = max(1, -(-n // max(1, count)))
    cuts = cut_points(docs.select("doc_id"), list(range(chunk, n, chunk))) if n else []
    return docs.withColumn("segment", sum(((F.col("doc_id") >= c).cast("int") for c in cuts), F.lit(0)))


def segment_postings(docs: DataFrame, count: int, analyzer: str = "stem") -> DataFrame:
    """Postings with the segment of their document: the segments' indexes in one pass over docs."""
    cuts = segments(docs.select("doc_id", "text"), count)
    both = cuts.select(F.struct("doc_id", "segment").alias("doc_id"), "text")
    return postings_of(both, analyzer).select("term", F.col("doc_id.doc_id").alias("doc_id"), "tf", "positions", "dl", F.col("doc_id.segment").alias("segment"))


def merged(*parts: DataFrame) -> DataFrame:
    """Postings of several indexes together; an id indexed twice is posted twice."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
