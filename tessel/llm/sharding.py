"""Range sharding by sampled splitters, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessel.llm._common import staged

#: Fixed cost of a record besides its text, in bytes.
OVERHEAD = 16
#: The number that thirteen hexadecimal digits can't reach.
_SPAN = 16**13


def size_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + F.lit(OVERHEAD).cast("long")


def _digits(value: Column, n: int) -> Column:
    """The first n hexadecimal digits of the MD5 of value, as a number."""
    return F.conv(F.substring(F.md5(value), 1, n), 16, 10).cast("long")


def _name(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("string"), F.lit("-"))


def range_key(doc_id: Column, text: Column) -> Column:
    """32 bits of the text, then 31 of doc_id: copies lie side by side, and doc_id spreads them below."""
    return _digits(F.coalesce(text, F.lit("")), 8) * F.lit(1 << 31) + _digits(_name(doc_id), 8) % F.lit(1 << 31)


def splitters(keyed: DataFrame, ranges: int, per_range: int = 24, seed: int = 4) -> list[int]:
    """At most ranges - 1 boundaries: quantiles of a size-weighted sample of keys.

    A row enters the sample with the expected number ranges * per_range * size / total (deterministic: a hash of key and
    doc_id decides the fraction), so the sample is bounded whatever the table's size, and only quantiles reach the driver.
    """
    total = keyed.agg(F.sum("size")).first()[0]
    if not total:
        return []
    wanted = F.col("size") * F.lit(ranges * per_range / total)
    u = _digits(F.concat(F.lit(f"{seed}:"), F.col("key").cast("string"), F.lit(":"), _name(F.col("doc_id"))), 13) / F.lit(float(_SPAN))
    times = F.least(F.floor(wanted) + F.when(u < wanted - F.floor(wanted), 1).otherwise(0), F.lit(ranges * per_range))
    sample = keyed.select("key", times.cast("int").alias("times")).filter("times > 0")
    sample = sample.select(F.explode(F.array_repeat("key", F.col("times"))).alias("key"))
    got = sample.agg(F.sort_array(F.collect_list("key")).alias("k")).select(
        F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(ranges - 1)), lambda i: F.element_at("k", F.greatest(F.lit(1), (i * F.size("k") / ranges).cast("int"))))).alias("s")
    )
    return sorted(x for x in got.first()[0] if x is not None)


def _bucket(key: Column, cuts: list[int]) -> Column:
    """Number of cuts at or below key, by two steps over about sqrt(len(cuts)) each."""
    if not cuts:
        return F.lit(0)
    step = max(1, int(len(cuts) ** 0.5))
    groups = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    heads = F.array(*(F.lit(g[0]) for g in groups))
    table = F.array(*(F.array(*map(F.lit, g)) for g in groups))
    head = F.size(F.filter(heads, lambda s: s <= key))
    inner = F.size(F.filter(F.element_at(table, head), lambda s: s <= key))
    return F.when(head == 0, 0).otherwise((head - 1) * step + inner)


def shard_by_bytes(docs: DataFrame, shards: int = 40, ranges: int | None = None, overfull: float = 2.0) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: documents cut into shards of near equal bytes.

    Sampled splitters range-partition the keys into many more ranges than shards. Exact bytes and rows of the ranges
    are then counted; a range over `overfull` times the mean is subdivided by a hash of its records. Prefix sums over
    the ranges (a table of bounded size) plus a running sum inside each range give every record its exact place in
    one global order, and the shard is the place's share of all bytes: shards differ by at most about one record.
    Slots count 0, 1, ... inside a shard. Equal texts are neighbours in that order unless their range is subdivided.
    Null text has size 16; its checksum is that of no bytes. Null doc_ids are allowed; wholly equal rows are
    interchangeable. A very long text is one record of one shard. Columns besides doc_id and text are ignored, whatever
    their names. An empty table gives an empty result. More shards than rows leave shards empty.
    """
    keyed = docs.select(
        "doc_id",
        size_bytes(F.col("text")).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).cast("long").alias("text_crc32"),
        range_key(F.col("doc_id"), F.col("text")).alias("key"),
    )
    keyed = staged(keyed, "keys")
    ranges = ranges or shards * 32
    placed = keyed.withColumn("range", _bucket(F.col("key"), splitters(keyed, ranges)))
    stats = placed.groupBy("range").agg(F.sum("size").alias("bytes"))
    heavy = [(r["range"], int(r["bytes"])) for r in stats.collect()]  # one row a range, bounded by `ranges`
    mean = sum(b for _, b in heavy) / max(1, len(heavy))
    parts = {r: -(-b // max(1, int(mean))) for r, b in heavy if b > overfull * mean}
    sub = F.lit(0)
    if parts:
        fan = F.create_map(*(F.lit(x) for kv in parts.items() for x in kv))
        own = _digits(F.concat(F.lit("11:"), F.col("key").cast("string"), F.lit(":"), _name(F.col("doc_id"))), 13)
        sub = F.coalesce(own % F.try_element_at(fan, F.col("range")), F.lit(0)).cast("int")
    placed = placed.withColumn("sub", sub)
    cells = staged(placed.groupBy("range", "sub").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")), "cells")
    order = Window.orderBy("range", "sub").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(
        "range", "sub",
        F.coalesce(F.sum("bytes").over(order), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(order), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(Window.partitionBy()).alias("total"),
    )
    inside = Window.partitionBy("range", "sub").orderBy("key", "doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    done = placed.withColumns({"run": F.sum("size").over(inside), "nth": F.count("*").over(inside)}).join(F.broadcast(cells), ["range", "sub"])
    middle = 2 * (F.col("bytes_before") + F.col("run")) - F.col("size")
    whole = done.withColumn("middle", middle * shards).withColumn("double", 2 * F.col("total"))
    shard = F.least(F.lit(shards - 1), F.expr("middle div double").cast("int"))
    done = staged(whole.select("doc_id", "size", "text_crc32", shard.alias("shard"), (F.col("rows_before") + F.col("nth") - 1).alias("place")), "placed")
    firsts = done.groupBy("shard").agg(F.min("place").alias("first"))
    return done.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("place") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
