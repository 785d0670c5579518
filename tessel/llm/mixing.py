"""Mixing sources to target weights with DataFrame functions only.

A document is emitted floor(rate) times and once more if its hash-seeded draw is below a threshold. The threshold of the
first document of a source is the fraction of the rate; that of every later one is what is still wanted of extra copies,
divided by what is still to be drawn. That quotient is a martingale, so every document's chance of an extra copy is the
fraction (but where the quotient leaves 0..1), while a draw that misses is made up for by those that follow. Documents
follow each other by falling weight; after the LARGE heaviest ones of a source, the threshold stays as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessel.llm._common import WORD, small, staged

#: The number that thirteen hexadecimal digits can't reach.
_SPAN = float(16**13)
#: Documents of a source that are drawn one after another; what they weigh bounds how far the others can stray.
LARGE = 256
#: Parts of a source in which its heaviest documents are looked for.
SALTS = 16


def words(text: Column) -> Column:
    """Number of words of text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def draw(doc_id: Column, size: Column, seed: int) -> Column:
    """A number in [0, 1) that only seed, doc_id and size decide."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("-")), F.lit(":"), size.cast("string"))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(_SPAN)


def source_targets(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0, share: float = 1.0) -> DataFrame:
    """(source, source_size, target) from rows with source and size.

    Sources sorted by code point, null last, weigh `weights` in turn. The budget is `share` of all sizes. A source
    gets at most `most` times its size; what it can't take is shared again by weight. That fixed point has a closed
    form: with the sources ordered by how soon they fill up (size / weight), some first ones are full and the rest
    share what is left by weight. The table has one row per source; that is the only thing a single task sorts.
    An empty table gives an empty result; with no words at all each target is 0.
    """
    sources = staged(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    one = Window.orderBy(F.col("source").asc_nulls_last())
    sources = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(one) - 1) % len(weights) + 1).cast("int")))
    fill = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    after = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    full = F.lit(most) * F.col("source_size")
    level = (F.sum("source_size").over(Window.partitionBy()) * F.lit(share) - F.coalesce(F.sum(full).over(before), F.lit(0.0))) / F.sum("weight").over(after)
    sources = sources.select("source", "source_size", "weight", full.alias("full"), level.alias("level"), F.row_number().over(fill).alias("at"))
    free = sources.withColumn("free", F.col("weight") * F.col("level") <= F.col("full"))
    free = free.withColumn("water", F.min_by("level", F.when(F.col("free"), F.col("at"))).over(Window.partitionBy()))
    target = F.least(F.col("full"), F.coalesce(F.col("weight") * F.col("water"), F.col("full")))
    return free.select("source", "source_size", target.cast("double").alias("target"))


def _quotient(wanted: Column, left: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(wanted, left), F.lit(0.0))))


def thresholds(sized: DataFrame, targets: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """(rates, picks) from sized(doc_id, source, size) and source_targets().

    rates has a row per source: source_, source_size, target, whole_ (copies of each document), part_ (threshold of the
    documents without a pick). picks has a row for each of the LARGE heaviest units of a source: source_, id_, size_,
    extra_. A unit is all rows of a source that agree in doc_id and size; they share a draw and weigh together.
    """
    units = sized.filter("size > 0").groupBy("source", "doc_id", "size").agg((F.count("*") * F.col("size")).alias("weight"))
    order = [F.desc("weight"), F.col("doc_id").asc_nulls_last(), "size"]
    part = F.pmod(F.xxhash64("doc_id", "size"), F.lit(SALTS))  # the heaviest of each part first, so that no task ranks a whole source
    some = units.withColumn("part", part).withColumn("nth", F.row_number().over(Window.partitionBy("source", "part").orderBy(*order)))
    some = some.filter(F.col("nth") <= LARGE).drop("part", "nth")
    nth = F.row_number().over(Window.partitionBy("source").orderBy(*order))
    heavy = some.withColumn("nth", nth).filter(F.col("nth") <= LARGE).withColumn("u", draw(F.col("doc_id"), F.col("size"), seed))
    heavy = heavy.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("nth", "weight", "u", "doc_id", "size"))).alias("units"))
    rate = F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0))
    t = small(staged(targets.withColumn("whole_", F.floor(rate)).withColumnRenamed("source", "source_"), "targets"))
    start = F.struct(
        (F.col("target") - F.col("whole_") * F.col("source_size")).cast("double").alias("wanted"),
        F.col("source_size").cast("double").alias("left"),
        F.array().cast("array<boolean>").alias("picks"),
    )

    def step(state: Column, unit: Column) -> Column:
        extra = unit["u"] < _quotient(state["wanted"], state["left"])
        weight = unit["weight"].cast("double")
        return F.struct(
            (state["wanted"] - F.when(extra, weight).otherwise(0.0)).alias("wanted"),
            (state["left"] - weight).alias("left"),
            F.concat(state["picks"], F.array(extra)).alias("picks"),
        )

    drawn = t.join(heavy, F.col("source_").eqNullSafe(F.col("source")), "left")
    drawn = drawn.withColumn("state", F.aggregate(F.coalesce("units", F.array().cast(heavy.schema["units"].dataType)), start, step))
    drawn = staged(drawn.select("source_", "source_size", "target", "whole_", _quotient(F.col("state.wanted"), F.col("state.left")).alias("part_"), F.arrays_zip("units", "state.picks").alias("drawn")), "drawn")
    picks = drawn.select("source_", F.explode("drawn").alias("d"))
    picks = picks.select("source_", F.col("d.units.doc_id").alias("id_"), F.col("d.units.size").alias("size_"), F.col("d.picks").alias("extra_"))
    return drawn.drop("drawn"), picks


def _repeated(sized: DataFrame, narrow: DataFrame, seed: int, rates: dict) -> DataFrame:
    """sized with source_size, target and copies; narrow is its staged (doc_id, source, size)."""
    per, picks = thresholds(narrow, source_targets(narrow, **rates), seed)
    per, picks = small(per), small(staged(picks, "picks"))
    out = sized.join(per, F.col("source").eqNullSafe(F.col("source_")), "left").drop("source_")
    same = F.col("source").eqNullSafe(F.col("source_")) & F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("size") == F.col("size_"))
    out = out.join(picks, same, "left")
    extra = F.coalesce("extra_", draw(F.col("doc_id"), F.col("size"), seed) < F.col("part_"))
    return out.withColumn("copies", (F.col("whole_") + extra.cast("int")).cast("long"))


def mix_report(docs: DataFrame, seed: int = 9, **rates) -> DataFrame:
    """Per document: size, its source's size and target, the words that the mix takes from it, source and copies.

    rate = target / source_size; a document is taken floor(rate) times and once more by its draw (see above). Reruns
    agree. Rows of a source that agree in doc_id and size share a draw. A source without words has rate 0. Null text
    counts no words; null is a source of its own. Whole texts are counted, by the JVM alone. Columns besides doc_id,
    source and text are ignored, whatever their names. An empty table gives an empty result.
    """
    sized = staged(docs.select("doc_id", "source", words(F.col("text")).alias("size")), "sizes")
    out = _repeated(sized, sized, seed, rates)
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


def mix(docs: DataFrame, seed: int = 9, **rates) -> DataFrame:
    """docs with each row repeated `copies` times (0: left out), as in mix_report; all columns as they were, whatever their names."""
    narrow = staged(docs.select("doc_id", "source", words(F.col("text")).alias("size")), "sizes")
    rows = docs.select(F.struct("*").alias("row_"), "doc_id", "source", words(F.col("text")).alias("size"))
    out = _repeated(rows, narrow, seed, rates).filter("copies > 0")
    return out.select("row_", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("copy_")).select("row_.*")
