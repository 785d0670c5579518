"""search(): the engine's modes as one lazy DataFrame each, with a driver-side cache of collected results."""

from __future__ import annotations

from collections import OrderedDict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.operators import fusion, lexical, suggest
from tessel.operators.dense import knn
from tessel.operators.index import Index


class LruCache:
    """Least recently used results by key; a capacity of 0 or less keeps nothing."""

    def __init__(self, capacity: int = 128) -> None:
        self.capacity, self.held = capacity, OrderedDict()

    def get(self, key):
        if key not in self.held:
            return None
        self.held.move_to_end(key)
        return self.held[key]

    def put(self, key, value) -> None:
        if self.capacity <= 0:
            return
        self.held[key] = value
        self.held.move_to_end(key)
        while len(self.held) > self.capacity:
            self.held.popitem(last=False)

    def clear(self) -> None:
        self.held.clear()


class Engine:
    """Modes bm25, wand, phrase, hybrid, rerank over documents with text, category and year; unknown modes are bm25."""

    def __init__(self, docs: DataFrame, vectors: DataFrame | None = None, clicks: DataFrame | None = None, dead: DataFrame | None = None, analyzer: str = "stem", cache: int = 128) -> None:
        self.docs, self.vectors, self.clicks, self.dead = fusion.with_metadata(docs), vectors, clicks, dead
        self.index, self.cache = Index(docs, analyzer), LruCache(cache)

    def _shown(self, ranked: DataFrame, keep, k: int, score: str) -> DataFrame:
        rows = ranked.join(self.docs.select("doc_id", "text", "category", "year"), "doc_id").filter(keep)
        rows = rows.join(self.dead.select("doc_id"), "doc_id", "left_anti") if self.dead is not None else rows
        return rows.orderBy(F.desc(score), "doc_id").limit(k)

    def search(self, text: str, mode: str = "bm25", k: int = 10, where: str = "", vector=None, spell: bool = False) -> DataFrame:
        """Best first. Lexical ranks are taken before the filter, dense candidates after it; every mode filters, then cuts at k."""
        text = suggest.correct_query(self.index, text) if spell else text
        keep = fusion.filter_expr(where, {"year"}, {"category", "year", "source", "lang"} & set(self.docs.columns) | {"year", "category"})
        if mode == "phrase":
            return self._shown(lexical.search_phrase(self.index, text), keep, k, "score")
        if mode == "hybrid" and vector is not None and self.vectors is not None:
            allowed = self.docs.filter(keep).select(F.col("doc_id").alias("vec_id"))
            dense = knn(self.vectors.join(allowed, "vec_id", "left_semi"), vector, 2 * k).withColumnRenamed("vec_id", "doc_id")
            return self._shown(fusion.rrf(lexical.search(self.index, text, 2 * k), dense, 2 * k), keep, k, "rrf")
        if mode == "rerank":
            first = lexical.search(self.index, text, 5 * k).join(self.docs.select("doc_id", "text"), "doc_id")
            return self._shown(fusion.rerank(text, first, 2 * k), keep, k, "final")
        ranked = (lexical.search_pruned if mode == "wand" else lexical.search)(self.index, text, 3 * k)
        if self.clicks is not None:
            ranked = fusion.boosted(ranked, fusion.click_boost(self.clicks)).select("doc_id", "score")
        return self._shown(ranked, keep, k, "score")

    def collected(self, text: str, mode: str = "bm25", k: int = 10, where: str = "", spell: bool = False) -> list:
        """Rows of search(), remembered by mode, corrected text, k and filter; clicks and new documents empty the memory."""
        text = suggest.correct_query(self.index, text) if spell else text
        key = mode, text, k, where
        if (rows := self.cache.get(key)) is None:
            rows = self.search(text, mode, k, where).collect()
            self.cache.put(key, rows)
        return rows

    def click(self, doc_id: int) -> bool:
        """Counts a click; ids of 0 and less are refused."""
        if doc_id <= 0:
            return False
        new = self.docs.sparkSession.createDataFrame([(doc_id,)], "doc_id long")
        self.clicks = new if self.clicks is None else self.clicks.select("doc_id").unionByName(new)
        self.cache.clear()
        return True

    def insert(self, rows: DataFrame) -> None:
        """Adds or replaces documents (doc_id, text); the index is that of the new table."""
        old = self.docs.select("doc_id", "text")
        self.docs = fusion.with_metadata(old.join(rows.select("doc_id"), "doc_id", "left_anti").unionByName(rows.select("doc_id", "text")))
        self.index.close()
        self.index = Index(self.docs, self.index.analyzer)
        self.cache.clear()

    def delete(self, rows: DataFrame) -> None:
        """Marks documents (doc_id) as dead."""
        new = rows.select("doc_id")
        self.dead = new if self.dead is None else self.dead.select("doc_id").unionByName(new)
        self.cache.clear()

    def document(self, method: str, rows: DataFrame) -> bool:
        """Routes POST and DELETE of documents; other methods are not found."""
        if method not in ("POST", "DELETE"):
            return False
        (self.insert if method == "POST" else self.delete)(rows)
        return True

    def command(self, line: str, k: int = 10) -> list:
        """One line of a shell: `bm25 words`, `wand words`, `phrase words`, `rerank words`, `click id`; a bare line is bm25."""
        word, _, rest = line.strip().partition(" ")
        if word == "click":
            return [self.click(int(rest))] if rest.strip().lstrip("-").isdigit() else []
        mode, text = (word, rest) if word in ("bm25", "wand", "phrase", "rerank") else ("bm25", line)
        return self.collected(text, mode, k) if text.strip() else []

    def suggest(self, prefix: str, k: int = 5) -> DataFrame:
        return suggest.suggest(suggest.suggest_terms(self.docs), prefix, k)

    def metrics(self, latencies: DataFrame) -> DataFrame:
        """One row of Prometheus text from latencies(value) in microseconds."""
        n, total = F.count("*"), F.coalesce(F.sum("value"), F.lit(0.0))
        return latencies.agg(F.format_string("search_requests_total %d\nsearch_latency_avg_ms %.3f", n, F.coalesce(F.try_divide(total, n * 1000.0), F.lit(0.0))).alias("metrics"))

    def health(self) -> DataFrame:
        return self.index.stats.select(F.lit("ok").alias("status"), "n")
