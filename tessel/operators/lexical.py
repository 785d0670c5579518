"""Lexical retrieval: exhaustive and pruned top-k, phrases, boolean set operations."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.functions.text import query_terms
from tessel.operators.index import Index, bm25, tfidf


def top(df: DataFrame, k: int | None, score: str = "score") -> DataFrame:
    out = df.withColumn(score, F.round(score, 6))
    return out.orderBy(F.desc(score), "doc_id").limit(k) if k is not None else out


def _times(tokens: list[str]) -> Column:
    """How often the query holds a posting's term."""
    return F.element_at(F.create_map(*(F.lit(x) for kv in sorted(Counter(tokens).items()) for x in kv)), F.col("term"))


def score_all(index: Index, tokens: list[str], hits: DataFrame | None = None, df: DataFrame | None = None) -> DataFrame:
    """(doc_id, score) of every document that holds a query token; a repeated token counts as often."""
    if not tokens:
        return index.docs.select("doc_id", F.lit(0.0).alias("score")).limit(0)
    scored = index.scored(index.hits(tokens) if hits is None else hits, df)
    return scored.groupBy("doc_id").agg(F.sum(_times(tokens) * F.col("score")).alias("score")).filter("score > 0")


def search(index: Index, text: str, k: int = 10) -> DataFrame:
    """Top k of the exhaustive score, best first, ties by doc_id."""
    tokens = query_terms(text, index.analyzer)
    return top(score_all(index, tokens), k)


class Pruning:
    """What a pruned search knows beforehand: a threshold, the terms without which no document reaches it, and bounds."""

    def __init__(self, index: Index, text: str, k: int) -> None:
        self.index, self.tokens = index, query_terms(text, index.analyzer)
        self.known = index.known(self.tokens, k)
        times = Counter(self.tokens)
        #: No less than the k-th best score: k documents reach it by one term alone.
        self.theta = max((times[t] * kth for t, (_, _, kth) in self.known.items()), default=0.0)
        self.bound = {t: times[t] * most for t, (_, most, _) in self.known.items()}
        weak, total = set(), 0.0
        for t in sorted(self.bound, key=lambda t: (self.bound[t], t)):
            total += self.bound[t]
            if total >= self.theta - 1e-9:
                break
            weak.add(t)
        self.essential = [t for t in self.bound if t not in weak]

    def able(self) -> DataFrame:
        """(doc_id, bound, able) of every document with a query term; able: it holds an essential term and its bound reaches theta."""
        bound = F.element_at(F.create_map(*(F.lit(x) for kv in self.bound.items() for x in kv)), F.col("term"))
        rows = self.index.hits(self.tokens).groupBy("doc_id").agg(F.sum(bound).alias("bound"), F.max(F.col("term").isin(self.essential)).alias("essential"))
        return rows.select("doc_id", "bound", (F.col("essential") & (F.col("bound") >= self.theta - 1e-9)).alias("able"))


def search_pruned(index: Index, text: str, k: int = 10) -> DataFrame:
    """The same rows as search(): documents without an essential term, or whose bounds stay below the threshold, are not scored.

    Frequencies, bounds and the k-th best score of each query term are known to the index, so the search is one pass over
    the terms' postings; each document's are gathered once, tested by their bounds and then scored.
    """
    p = Pruning(index, text, k)
    if not p.tokens:
        return search(index, text, k)
    n, avgdl = (F.lit(x) for x in index.totals)
    pick = lambda values: F.element_at(F.create_map(*(F.lit(x) for kv in values.items() for x in kv)), F.col("term"))
    df = pick({t: d for t, (d, _, _) in p.known.items()})
    score = 0.7 * bm25(F.col("tf"), df, n, F.col("dl"), avgdl) + 0.3 * tfidf(F.col("tf"), df, n, F.col("dl"))
    rows = index.hits(p.tokens).groupBy("doc_id").agg(
        F.sum(pick(p.bound)).alias("bound"), F.max(F.col("term").isin(p.essential)).alias("essential"), F.sum(_times(p.tokens) * score).alias("score")
    )
    return top(rows.filter(F.col("essential") & (F.col("bound") >= p.theta - 1e-9) & (F.col("score") > 0)).select("doc_id", "score"), k)


def pruning_stats(index: Index, text: str, k: int = 10) -> DataFrame:
    """(candidates, evaluated, skipped) of search_pruned()."""
    p = Pruning(index, text, k)
    evaluated = F.count(F.when(F.col("able"), 1))
    return p.able().agg(F.count("*").alias("candidates"), evaluated.alias("evaluated"), (F.count("*") - evaluated).alias("skipped"))


def phrase(index: Index, tokens: list[str]) -> DataFrame:
    """(doc_id) of the documents in which the tokens stand one after another."""
    spark = index.docs.sparkSession
    if not tokens:
        return index.docs.select("doc_id").limit(0)
    wanted = F.broadcast(spark.createDataFrame(list(enumerate(tokens)), "i int, term string"))
    at = index.postings.filter(F.col("term").isin(tokens)).join(wanted, "term").select("doc_id", "i", F.explode("positions").alias("pos"))
    starts = at.groupBy("doc_id", (F.col("pos") - F.col("i")).alias("start")).agg(F.count_distinct("i").alias("n"))
    return starts.filter(F.col("n") == len(tokens)).select("doc_id").distinct()


def search_phrase(index: Index, text: str, analyzed: bool = False) -> DataFrame:
    """(doc_id, score 1.0). By default the phrase's raw tokens are looked up; `analyzed` runs the index's analyser on it."""
    raw = query_terms(text, index.analyzer) if analyzed else [t for t in "".join(c for c in text.lower() if c.isascii() and (c.isalnum() or c.isspace())).split()]
    return phrase(index, raw).select("doc_id", F.lit(1.0).alias("score"))


def containing(index: Index, term: str) -> DataFrame:
    return index.postings.filter(F.col("term") == term).select("doc_id").distinct()


def boolean_and(index: Index, terms: list[str]) -> DataFrame:
    hits = index.postings.filter(F.col("term").isin(terms))
    return hits.groupBy("doc_id").agg(F.count_distinct("term").alias("n")).filter(F.col("n") == len(set(terms))).select("doc_id")


def boolean_or(index: Index, terms: list[str]) -> DataFrame:
    return index.postings.filter(F.col("term").isin(terms)).select("doc_id").distinct()


def boolean_not(index: Index, keep: str, drop: str) -> DataFrame:
    return containing(index, keep).join(containing(index, drop), "doc_id", "left_anti")
