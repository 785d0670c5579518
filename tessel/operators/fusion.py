"""Fusion, reranking, click boosts and structured filters."""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tessel.functions.text import let, tokenize


def rrf(lexical: DataFrame, dense: DataFrame, k: int = 10, c: int = 60) -> DataFrame:
    """(doc_id, rrf, lexical_score, dense_score) from (doc_id, score) and (doc_id, sim): sum of 1 / (c + rank)."""
    one = lexical.select("doc_id", "score", F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")).alias("r"))  # short ranked lists
    two = dense.select("doc_id", "sim", F.row_number().over(Window.orderBy(F.desc("sim"), "doc_id")).alias("s"))
    part = lambda r: F.coalesce(1.0 / (c + F.col(r)), F.lit(0.0))
    out = one.join(two, "doc_id", "full").select("doc_id", F.round(part("r") + part("s"), 9).alias("rrf"), F.coalesce("score", F.lit(0.0)).alias("lexical_score"), F.coalesce("sim", F.lit(0.0)).alias("dense_score"))
    return out.orderBy(F.desc("rrf"), "doc_id").limit(k)


def cross_score(query: str, text: Column) -> Column:
    """Deterministic relevance of a text: 0.5 coverage + 0.2 density + 0.3 if the query occurs verbatim, at most 1.

    The text is analysed once: an expression named by let() is not worked out anew for each use.
    """
    words = re.sub(r"[^A-Za-z0-9 \t\n\r\f\x0b]", "", query).lower().split()
    if not words:
        return F.lit(0.0)
    verbatim = F.when(F.contains(text, F.lit(query)), 0.3).otherwise(0.0)
    wanted = sorted(set(words))

    def score(places: Column) -> Column:
        n = F.size(places)
        span = F.element_at(places, -1) - F.element_at(places, 1) + 1
        density = F.when(n < 2, 1.0).when(span > 1, n / span).otherwise(1.0)
        return F.least(F.lit(1.0), 0.5 * n / len(words) + 0.2 * density + verbatim)

    def of(tokens: Column) -> Column:
        places = F.filter(F.transform(tokens, lambda t, i: F.when(t.isin(wanted), i)), lambda i: i.isNotNull())
        return F.when(F.size(tokens) == 0, 0.0).otherwise(let(places, score))

    return let(tokenize(text), of)


def rerank(query: str, candidates: DataFrame, k: int = 10) -> DataFrame:
    """(doc_id, final, l1, cross) from candidates (doc_id, score, text): 0.6 cross + 0.4 score / max score."""
    most = F.greatest(F.lit(0.0001), F.max("score").over(Window.partitionBy()))  # candidates are a short list
    out = candidates.select("doc_id", F.col("score").alias("l1"), F.round(cross_score(query, F.col("text")), 6).alias("cross"), most.alias("m"))
    return out.select("doc_id", F.round(0.6 * F.col("cross") + 0.4 * F.col("l1") / F.col("m"), 6).alias("final"), "l1", "cross").orderBy(F.desc("final"), "doc_id").limit(k)


def click_boost(clicks: DataFrame) -> DataFrame:
    """(doc_id, n_clicks, boost) from clicks(doc_id): boost = 1 - exp(-0.5 n)."""
    return clicks.groupBy("doc_id").agg(F.count("*").alias("n_clicks")).withColumn("boost", F.round(1 - F.exp(-0.5 * F.col("n_clicks")), 6))


def boosted(results: DataFrame, boosts: DataFrame) -> DataFrame:
    """Results with score * (1 + boost), sorted again; applied after the top-k cut."""
    out = results.join(boosts.select("doc_id", "boost"), "doc_id", "left").withColumn("boost", F.coalesce("boost", F.lit(0.0)))
    return out.withColumn("score", F.round(F.col("score") * (1 + F.col("boost")), 6)).orderBy(F.desc("score"), "doc_id")


_RANGE = 1e12
_STEP = 1e-6


def filter_expr(expr: str, numeric: set[str], columns: set[str] | None = None) -> Column:
    """Predicate of `field:value,field:>=number,...`; commas mean and.

    A clause without a colon is ignored, but an expression of such clauses alone matches nothing; an empty one matches
    everything. The value isn't trimmed. > and < are >= and <= moved by 1e-6, and an open end is 1e12. An equality on a
    numeric field matches nothing, as does a field that doesn't exist. A bad number raises ValueError.
    """
    if not expr.strip():
        return F.lit(True)
    parts = []
    for clause in expr.split(","):
        field, colon, value = clause.strip().partition(":")
        if not colon:
            continue
        m = re.match(r"(>=|<=|>|<)(.*)", value, re.S)
        if columns is not None and field not in columns:
            parts.append(F.lit(False))
        elif m:
            x = float(m[2])
            lo, hi = (x + (_STEP if m[1] == ">" else 0), _RANGE) if m[1][0] == ">" else (-_RANGE, x - (_STEP if m[1] == "<" else 0))
            parts.append(F.col(field).cast("double").between(lo, hi) if field in numeric else F.lit(False))
        else:
            parts.append(F.lit(False) if field in numeric else F.col(field) == value)
    if not parts:
        return F.lit(False)
    out = parts[0]
    for p in parts[1:]:
        out = out & p
    return out


#: Categories and the words that decide them, first match first.
CATEGORIES = {
    "AI": ["neural", "learning", "intelligence"], "Cloud": ["cloud", "microservices", "docker"], "Security": ["security", "cryptography", "cyber"],
    "Genomics": ["genome", "dna", "biology"], "Quantum": ["quantum", "computing"],
}


def category(text: Column) -> Column:
    out = None
    for name, words in CATEGORIES.items():
        any_ = F.lit(False)
        for w in words:
            any_ = any_ | text.contains(w)
        out = F.when(any_, name) if out is None else out.when(any_, name)
    return out.otherwise("General")


def with_metadata(docs: DataFrame) -> DataFrame:
    return docs.withColumn("category", category(F.col("text"))).withColumn("year", (2022 + F.col("doc_id") % 4).cast("int"))


def cross_score_model(pairs: DataFrame, model: Callable[[list[str], list[str]], list[float]]) -> DataFrame:
    """pairs(query, text, ...) with cross: the logistic function of what a pluggable pair model says, 0 where either is empty.

    The model gets the queries and texts of an Arrow batch; it is loaded wherever it is called.
    """

    def run(it):
        for part in it:
            query, text = part["query"].fillna("").tolist(), part["text"].fillna("").tolist()
            some = [i for i, (q, t) in enumerate(zip(query, text, strict=True)) if q and t]
            part["cross"] = 0.0
            if some:
                said = model([query[i] for i in some], [text[i] for i in some])
                part.loc[part.index[some], "cross"] = [1 / (1 + math.exp(-x)) for x in said]
            yield part

    return pairs.mapInPandas(run, T.StructType([*pairs.schema, T.StructField("cross", T.DoubleType())]))
