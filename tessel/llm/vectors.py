"""Embedding near-duplicates: random-hyperplane sign hashing in several tables, exact cosine, connected components.

1. Vectors of equal direction are one class. A class has a code: its side of every hyperplane of every table.
2. Only codes travel to the buckets of the tables. Classes of a bucket whose codes differ in few places stay; all
   others, the most by far, need no vector.
3. What stays is joined with its vectors and compared exactly, bucket by bucket. A pair counts in the first table where
   it meets, so a bucket yields sums and star edges, a row a class, and no list of pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm._common import discard, small, small_batches, staged, tidy
from tessel.llm.components import connected_components

#: Chance that a pair at the threshold meets in some table.
RECALL = 0.99
#: Standard deviations that the codes of a pair at the threshold may differ by beyond their mean.
SPREAD = 6
#: Classes of a bucket that one task compares at once; a larger bucket is cut into blocks and compared by pairs of blocks.
BLOCK = 1024
#: Rows that one group of small buckets should hold.
GROUP_ROWS = 20_000
_CELL = ["table", "dim", "bucket", "lo", "hi"]


def plan(vectors: int, threshold: float, recall: float = RECALL) -> tuple[int, int]:
    """(bits, tables): buckets of about eight vectors if signs were even, and tables enough for the recall at the threshold."""
    bits = max(8, math.ceil(math.log2(max(2, vectors) / 8)))
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - meet))


def most_different(threshold: float, places: int) -> float:
    """Places in which the codes of a pair at the threshold differ at most, SPREAD deviations above the mean."""
    p = math.acos(threshold) / math.pi
    return places * p + SPREAD * math.sqrt(places * p * (1 - p))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=-1, keepdims=True)
    return x / np.sqrt(np.einsum("...i,...i->...", x, x))[..., None] + 0.0


def _classes(vectors: DataFrame, raw: bool) -> DataFrame:
    """(vec_id, cls) and with `raw` also the packed vector; cls is the class of equal directions, null for unusable vectors."""
    kind = vectors.schema["vec_id"].dataType.simpleString()
    width = "<f4" if vectors.schema["embedding"].dataType.elementType.simpleString() == "float" else "<f8"

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            cls, packed = [], []
            for v in batch.column(1):
                v = v.values
                x = None if v is None or v.null_count or not len(v) else v.to_numpy(zero_copy_only=False).astype(np.float64)
                if x is None or not np.isfinite(x).all() or not x.any():
                    cls.append(None)
                    packed.append(None)
                    continue
                cls.append(int.from_bytes(hashlib.blake2b(_unit(x).tobytes(), digest_size=8).digest(), "little", signed=True))
                packed.append(x.astype(width).tobytes())
            cols = [batch.column(0), pa.array(cls, pa.int64()), *([pa.array(packed, pa.binary())] if raw else [])]
            yield pa.RecordBatch.from_arrays(cols, ["vec_id", "cls", "raw"][: len(cols)])

    return vectors.select("vec_id", "embedding").mapInArrow(tidy(run), f"vec_id {kind}, cls long" + ", raw binary" * raw)


def _coded(classes: DataFrame, width: str, bits: int, tables: int, seed: int) -> DataFrame:
    """(cls, dim, code): the signs of all tables, packed."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in it:
            raws, cls = batch.column(1).to_pylist(), batch.column(0).to_numpy()
            dims = np.array([len(r) for r in raws]) // np.dtype(width).itemsize
            for dim in np.unique(dims):
                if dim not in planes:
                    planes[dim] = np.random.RandomState(seed).standard_normal((dim, bits * tables))
                at = np.flatnonzero(dims == dim)
                x = _unit(np.frombuffer(b"".join(raws[i] for i in at), width).reshape(len(at), dim).astype(np.float64))
                code = np.packbits(x @ planes[dim] >= 0, axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(cls[at]), pa.array(np.full(len(at), dim, np.int32)), pa.array([c.tobytes() for c in code], pa.binary())], ["cls", "dim", "code"])

    return classes.select("cls", "raw").mapInArrow(tidy(run), "cls long, dim int, code binary")


def _signs(codes: list[bytes], bits: int, tables: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), -1), axis=1)[:, : bits * tables]


def _buckets(signs: np.ndarray, bits: int, tables: int) -> np.ndarray:
    return signs.reshape(len(signs), tables, bits) @ (1 << np.arange(bits, dtype=np.int64))


def _in_tables(coded: DataFrame, bits: int, tables: int, with_code: bool) -> DataFrame:
    """(table, dim, bucket) or (table, dim, bucket, cls, code): one row per class and table."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            bucket = _buckets(_signs(batch.column(2).to_pylist(), bits, tables), bits, tables) if batch.num_rows else np.zeros((0, tables), np.int64)
            for t in range(tables):
                cols = [pa.array(np.full(batch.num_rows, t, np.int32)), batch.column(1), pa.array(np.ascontiguousarray(bucket[:, t]))]
                yield pa.RecordBatch.from_arrays([*cols, batch.column(0), batch.column(2)][: 5 if with_code else 3], ["table", "dim", "bucket", "cls", "code"][: 5 if with_code else 3])

    return coded.select("cls", "dim", "code").mapInArrow(tidy(run), "table int, dim int, bucket long" + ", cls long, code binary" * with_code)


def _cells(t: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows of a cell, those of its upper block if it compares two blocks, else nothing)."""
    key = np.stack([t.column(c).to_numpy().astype(np.int64) for c in _CELL])
    order = np.lexsort((t.column("cls").to_numpy(), *key[::-1]))
    key = key[:, order]
    cut = np.flatnonzero(np.concatenate(([True], (key[:, 1:] != key[:, :-1]).any(axis=0), [True])))
    block = t.column("block").to_numpy()
    for i, j in zip(cut[:-1], cut[1:], strict=True):
        if j - i > 1:
            rows = order[i:j]
            yield rows, (block[rows] != key[3, i] if key[3, i] != key[4, i] else np.zeros(0, bool))


def _near(signs: np.ndarray, upper: np.ndarray, most: float) -> np.ndarray:
    """Matrix of the pairs of a cell whose codes differ in at most `most` places; above the diagonal, or across its blocks."""
    x = signs.astype(np.float32) * 2 - 1
    near = x @ x.T >= signs.shape[1] - 2 * most
    if len(upper):
        near &= ~upper[:, None] & upper[None, :]
    else:
        near = np.triu(near, 1)
    return near


def _partners(bits: int, tables: int, most: float):
    """Of the rows of some cells, those with a near code in their cell."""

    def run(t: pa.Table) -> pa.Table:
        codes, keep = t.column("code").to_pylist(), []
        for rows, upper in _cells(t):
            near = _near(_signs([codes[i] for i in rows], bits, tables), upper, most)
            keep.append(rows[near.any(axis=0) | near.any(axis=1)])
        return t.take(pa.array(np.concatenate(keep) if keep else np.zeros(0, np.int64))).drop_columns(["spread"])

    return run


def _stars(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Least member of each one's component under the links (i, j)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _linked(bits: int, tables: int, most: float, threshold: float, width: str):
    """(a, b, others) for every class with a link in one of some cells: b is the least class of its component there."""

    def run(t: pa.Table) -> pa.Table:
        codes, raws, cls, copies = t.column("code").to_pylist(), t.column("raw").to_pylist(), t.column("cls").to_numpy(), t.column("copies").to_numpy()
        table = t.column("table").to_numpy()
        out: list[list[np.ndarray]] = [[], [], []]
        for rows, upper in _cells(t):
            rows_cls = cls[rows]
            signs = _signs([codes[i] for i in rows], bits, tables)
            x = _unit(np.frombuffer(b"".join(raws[i] for i in rows), width).reshape(len(rows), -1).astype(np.float64))
            i, j = np.nonzero(_near(signs, upper, most) & (x @ x.T >= threshold - 1e-9))
            exact = np.concatenate([np.einsum("ij,ij->i", x[i[k : k + 65536]], x[j[k : k + 65536]]) for k in range(0, max(1, len(i)), 65536)])
            new = exact >= threshold
            bucket = _buckets(signs, bits, tables)
            for earlier in range(table[rows[0]]):
                new &= bucket[i, earlier] != bucket[j, earlier]
            i, j = i[new], j[new]
            if not len(i):
                continue
            others = np.zeros(len(rows), np.int64)
            np.add.at(others, i, copies[rows][j])
            np.add.at(others, j, copies[rows][i])
            some = np.unique(np.concatenate((i, j)))
            out[0].append(rows_cls[some])
            out[1].append(rows_cls[_stars(i, j, len(rows))[some]])
            out[2].append(others[some])
        a, b, n = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in out)
        return pa.table({"a": a, "b": b, "others": n})

    return run


def linked_classes(classes: DataFrame, width: str, threshold: float, seed: int = 5) -> DataFrame:
    """(a, b, others), staged: for each class a with links in some bucket, a class b of its component and the vectors linked.

    classes: staged (cls, raw, copies). A bucket of up to BLOCK classes is compared in one task. A larger one is cut into
    blocks by a hash; each pair of its blocks is a cell of its own, so that every pair of the bucket is compared once.
    """
    n = classes.count()
    bits, tables = plan(n, threshold)
    most = most_different(threshold, bits * tables)
    coded = staged(_coded(classes, width, bits, tables, seed), "coded")
    sizes = _in_tables(coded, bits, tables, False).groupBy("table", "dim", "bucket").agg(F.count("*").alias("m"))
    large = staged(sizes.filter(F.col("m") > BLOCK).select("table", "dim", "bucket", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks")), "large")
    rows = _in_tables(coded, bits, tables, True).join(small(large, 10_000), ["table", "dim", "bucket"], "left")
    rows = rows.withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, "block").alias("lo"), F.greatest(o, "block").alias("hi")))
    rows = rows.withColumn("cell", F.explode(meets)).select("table", "dim", "bucket", F.col("cell.lo").alias("lo"), F.col("cell.hi").alias("hi"), "block", "cls", "code")
    # whole cells travel together: one group of the plan holds many small ones, so that Python works on few large groups
    spread = F.pmod(F.xxhash64(*_CELL), F.lit(max(64, n * tables // GROUP_ROWS))).cast("int")
    cell = "table int, dim int, bucket long, lo int, hi int, block int, cls long, code binary"
    members = staged(rows.withColumn("spread", spread).groupBy("spread").applyInArrow(_partners(bits, tables, most), cell), "members")
    spread = F.pmod(F.xxhash64(*_CELL), F.lit(max(64, members.count() // GROUP_ROWS))).cast("int")
    full = members.join(classes.select("cls", "raw", "copies"), "cls").withColumn("spread", spread)
    found = full.groupBy("spread").applyInArrow(_linked(bits, tables, most, threshold, width), "a long, b long, others long")
    links = staged(found, "links")
    discard(coded, large, members)
    return links


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, seed: int = 5) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector.

    Vectors of equal direction are one class and link with each other; classes link where the exact cosine in double
    precision reaches the threshold. Pairs come from plan(): at the threshold at least RECALL of them are found, above
    it more, and none below it. n_links counts vectors, not classes. Null or zero vectors and such with null or
    non-finite components have no link and are their own component. Vectors of different length are never compared.
    A null vec_id takes part, but names no component. Rows that repeat link with each other. Labels and other columns
    are ignored, whatever their names. An empty table gives an empty result.
    """
    small_batches(vectors.sparkSession)
    width = "<f4" if vectors.schema["embedding"].dataType.elementType.simpleString() == "float" else "<f8"
    narrow = staged(_classes(vectors, False), "narrow")
    usable = _classes(vectors, True).filter("cls is not null")
    classes = staged(usable.groupBy("cls").agg(F.first("raw").alias("raw"), F.count("*").alias("copies"), F.min("vec_id").alias("least")), "classes")
    links = linked_classes(classes, width, threshold, seed)
    others = links.groupBy(F.col("a").alias("cls")).agg(F.sum("others").alias("others"))
    labels = connected_components(links).withColumnRenamed("node", "cls")
    known = classes.select("cls", "least", "copies").join(others, "cls", "left").join(labels, "cls", "left")
    known = known.select("cls", "least", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n"), F.coalesce("label", "cls").alias("label")).filter("n > 0")
    known = staged(known, "known")
    firsts = known.groupBy("label").agg(F.min("least").alias("component"))
    of = staged(known.join(firsts, "label").select("cls", "n", "component"), "members")
    discard(classes, links, known)
    out = narrow.select("vec_id", "cls").join(of, "cls", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.cast("long").alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
