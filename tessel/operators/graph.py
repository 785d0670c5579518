"""Approximate nearest neighbours by hierarchical neighbour graphs, one a shard of vectors.

A vector's level falls off geometrically with a hash of its id. On each level a vector is linked with its nearest ones
there, found exactly, block by block, and with those that are linked with it. A search walks down the levels and then
keeps a beam on the lowest one. Shards are built and searched apart; the best of all shards win.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Vectors that a shard should hold; its graph is built and searched in one task.
SHARD_VECTORS = 10_000
#: Links a vector and level (twice as many on the lowest), width of the beam.
LINKS, BEAM = 16, 50
_NODES = "shard int, vec_id long, level int, entry boolean, raw binary, links array<array<int>>"


def _levels(ids: np.ndarray) -> np.ndarray:
    """Level of each vector: u in (0, 1) is a hash of its id."""
    h = (ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    u = ((h ^ (h >> np.uint64(29))) >> np.uint64(11)).astype(np.float64) / 2**53
    return np.minimum(16, (-np.log(np.maximum(u, 1e-12)) / math.log(LINKS)).astype(np.int64))


def _nearest(x: np.ndarray, k: int, block: int = 1024) -> np.ndarray:
    """Of each row of x, the k others with the largest inner product."""
    out = np.empty((len(x), k), np.int64)
    for at in range(0, len(x), block):
        sims = x[at : at + block] @ x.T
        sims[np.arange(len(sims)), np.arange(at, at + len(sims))] = -np.inf
        out[at : at + block] = np.argpartition(-sims, k - 1, axis=1)[:, :k] if k < len(x) - 1 else np.argsort(-sims, axis=1)[:, :k]
    return out


def _linked(x: np.ndarray, most: int) -> list[np.ndarray]:
    """Links of each row of x: its nearest ones, those that chose it (nearest first, twice `most` in all), and a ring.

    The ring joins the rows in their order, so that no part of the graph is out of reach.
    """
    n = len(x)
    if n < 2:
        return [np.zeros(0, np.int64)] * n
    near = _nearest(x, min(most, n - 1))
    source, target = np.repeat(np.arange(n), near.shape[1]), near.ravel()
    a, b = np.concatenate((source, target)), np.concatenate((target, source))
    sim = np.einsum("ij,ij->i", x[a], x[b])
    order = np.lexsort((-sim, a))
    a, b = a[order], b[order]
    cut = np.searchsorted(a, np.arange(n + 1))
    return [np.unique(np.concatenate((b[cut[i] : cut[i + 1]][: 3 * most], [(i + 1) % n, (i - 1) % n]))) for i in range(n)]


def _build(t: pa.Table) -> pa.Table:
    t = t.sort_by("vec_id")
    ids = t.column("vec_id").to_numpy()
    x = np.stack([np.asarray(v, np.float32) for v in t.column("embedding").to_pylist()])
    level = _levels(ids)
    links: list[list[list[int]]] = [[] for _ in ids]
    for at in range(int(level.max()) + 1):
        rows = np.flatnonzero(level >= at)
        for i, own in zip(rows, _linked(x[rows], 2 * LINKS if at == 0 else LINKS), strict=True):
            links[i].append(rows[own].tolist())
    entry = np.zeros(len(ids), bool)
    entry[int(np.argmax(level))] = True
    cols = [t.column("shard").combine_chunks(), pa.array(ids), pa.array(level.astype(np.int32)), pa.array(entry), pa.array([v.tobytes() for v in x], pa.binary()), pa.array(links, pa.list_(pa.list_(pa.int32())))]
    return pa.table(cols, names=["shard", "vec_id", "level", "entry", "raw", "links"])


def build(vectors: DataFrame, shards: int | None = None) -> DataFrame:
    """The graph of vectors(vec_id, embedding): a row a vector. Null vectors are left out; all others have one length."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter("embedding is not null and vec_id is not null")
    shards = shards or max(1, -(-rows.count() // SHARD_VECTORS))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))
    return rows.groupBy("shard").applyInArrow(_build, _NODES)


class _Walk:
    """A shard's graph in memory."""

    def __init__(self, t: pa.Table) -> None:
        t = t.sort_by("vec_id")
        self.ids = t.column("vec_id").to_numpy()
        raw = t.column("raw").to_pylist()
        self.x = np.frombuffer(b"".join(raw), np.float32).reshape(len(raw), -1)
        self.links = t.column("links").to_pylist()
        self.entry = int(np.flatnonzero(t.column("entry").to_numpy(zero_copy_only=False))[0])
        self.top = int(t.column("level").to_numpy().max())

    def beam(self, q: np.ndarray, k: int, width: int) -> list[tuple[float, int]]:
        """(similarity, row) of the k best that a beam of `width` finds."""
        at, sim = self.entry, float(self.x[self.entry] @ q)
        for level in range(self.top, 0, -1):
            while True:
                near = self.links[at][level]
                sims = self.x[near] @ q if near else np.zeros(0)
                if not len(sims) or sims.max() <= sim:
                    break
                sim, at = float(sims.max()), near[int(sims.argmax())]
        width = max(width, k)
        seen, todo, held = {at}, [(-sim, at)], [(sim, at)]
        while todo:
            best, at = heapq.heappop(todo)
            if len(held) >= width and -best < held[0][0]:
                break
            near = [i for i in self.links[at][0] if i not in seen]
            seen.update(near)
            for sim, i in zip((self.x[near] @ q).tolist(), near, strict=True) if near else ():
                if len(held) < width or sim > held[0][0]:
                    heapq.heappush(todo, (-sim, i))
                    heapq.heappush(held, (sim, i))
                    if len(held) > width:
                        heapq.heappop(held)
        return sorted(held, reverse=True)[:k]


def search(graph: DataFrame, queries: DataFrame, k: int = 10, width: int = BEAM) -> DataFrame:
    """(query_id, vec_id, sim, rank) of the k best of all shards for each of queries(query_id, embedding).

    Every shard is asked every query, in Arrow batches; sim is the inner product in double precision, ties go to the
    least vec_id. Queries travel to each shard once; null queries find nothing.
    """
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), "embedding").filter("embedding is not null")
    shards = graph.select(F.col("shard").alias("part")).distinct()
    asked = asked.join(F.broadcast(shards))  # shards: one row for SHARD_VECTORS vectors

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[int, int, float]] = []
        if left.num_rows and right.num_rows:
            walk = _Walk(left)
            for query, v in zip(right.column("query_id").to_pylist(), right.column("embedding").to_pylist(), strict=True):
                q = np.asarray(v, np.float64)
                for _, row in walk.beam(q.astype(np.float32), k, width):
                    out.append((query, int(walk.ids[row]), round(float(walk.x[row].astype(np.float64) @ q), 6)))
        return pa.table([pa.array([o[i] for o in out], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "vec_id", "sim"])

    found = graph.groupBy("shard").cogroup(asked.groupBy("part")).applyInArrow(run, "query_id long, vec_id long, sim double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("sim"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def save(graph: DataFrame, path: str) -> None:
    """The graph's rows by shard, and a row with its marker, version and parameters."""
    graph.write.mode("overwrite").partitionBy("shard").parquet(f"{path}/nodes")
    head = [("HNSW", 1, LINKS, BEAM)]
    graph.sparkSession.createDataFrame(head, "magic string, version int, links int, beam int").write.mode("overwrite").parquet(f"{path}/manifest")


def load(spark: SparkSession, path: str) -> DataFrame:
    head = spark.read.parquet(f"{path}/manifest").first()
    if head is None or (head["magic"], head["version"]) != ("HNSW", 1):
        raise ValueError(f"{path} holds no graph of version 1")
    return spark.read.schema(_NODES).parquet(f"{path}/nodes")


def build_from_file(spark: SparkSession, vectors: str, path: str) -> None:
    """Job: flat vector files to a saved graph."""
    from tessel.sources.files import read_vectors

    save(build(read_vectors(spark, vectors)), path)
