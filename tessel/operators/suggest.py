"""Spelling correction, autocompletion, snippets and display."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tessel.functions.text import bigrams, query_terms, tokenize
from tessel.operators.index import Index


def corrections(index: Index, tokens: list[str], most: int = 2) -> DataFrame:
    """(token, correction): the token itself if indexed, else the nearest term within `most` edits, ties by df, then term.

    The few query tokens are broadcast; a length band is tested before the edit distance.
    """
    spark = index.docs.sparkSession
    asked = spark.createDataFrame([(t,) for t in dict.fromkeys(tokens)], "token string")
    near = index.df.join(F.broadcast(asked), F.abs(F.length("term") - F.length("token")) <= most)
    near = near.withColumn("d", F.levenshtein("token", "term", most)).filter("d >= 0")
    nth = F.row_number().over(Window.partitionBy("token").orderBy("d", F.desc("df"), "term"))
    best = near.withColumn("nth", nth).filter("nth = 1").select("token", "term")
    return asked.join(best, "token", "left").select("token", F.coalesce("term", "token").alias("correction"))


def correct_query(index: Index, text: str) -> str:
    """text with unknown words replaced; the original string if nothing changes."""
    tokens = query_terms(text, "stop")
    if not tokens:
        return text
    found = {r["token"]: r["correction"] for r in corrections(index, tokens).collect()}
    return " ".join(found[t] for t in tokens) if any(found[t] != t for t in tokens) else text


def suggest_terms(docs: DataFrame) -> DataFrame:
    """(key, freq): tokens of three characters or more weigh 1, pairs of such neighbours 2."""
    tokens = docs.select(tokenize(F.col("text")).alias("t"))
    single = tokens.select(F.explode(F.filter("t", lambda x: F.length(x) >= 3)).alias("key"), F.lit(1).alias("w"))
    pairs = tokens.select(F.explode(bigrams(F.col("t"))).alias("key"), F.lit(2).alias("w"))
    return single.unionByName(pairs).groupBy("key").agg(F.sum("w").alias("freq"))


def suggest(terms: DataFrame, prefix: str, k: int = 5) -> DataFrame:
    """(key, freq) of the k most frequent keys with the prefix; nothing for an empty prefix or k = 0."""
    if not prefix or k <= 0:
        return terms.limit(0)
    return terms.filter(F.col("key").startswith(prefix.lower())).orderBy(F.desc("freq"), "key").limit(k)


def highlight_prefix(text: Column, prefix: str) -> Column:
    n = len(prefix)
    bold = F.concat(F.lit("<b>"), F.substring(text, 1, n), F.lit("</b>"), F.substring(text, n + 1, 1 << 30))
    return F.when(F.lower(text).startswith(prefix.lower()), bold).otherwise(text) if n >= 2 else text


_TAGS = {"html": ("<b>", "</b>"), "ansi": ("\033[1;33m", "\033[0m"), "none": ("", "")}
_BLANK = " \t\n\r\x0b\x0c"


def _matches(word: str, terms: set[str]) -> bool:
    return bool(word) and (word in terms or any(len(q) >= 3 and (q in word or word in q) for q in terms))


def snippet(content: str | None, query: list[str], most: int = 140, form: str = "none") -> str | None:
    """The passage of at most `most` bytes that holds the most query words, its matches tagged and cuts marked.

    A window scores ten for each distinct matching word and one for each match; the first best one wins. Its ends move
    along the words together, so the text is passed once.
    """
    if content is None:
        return None
    raw = content.encode()
    if not raw or (len(raw) <= most and form == "none"):
        return content
    terms, spans, at = {t.lower() for t in query}, [], 0
    for piece in raw.translate(bytes.maketrans(_BLANK.encode(), b" " * 6)).split(b" "):
        if piece:
            spans.append((at, at + len(piece)))
        at += len(piece) + 1
    if not spans:
        return raw[:most].decode("utf-8", "ignore")
    if not terms:
        return content if len(raw) <= most else raw[:most].decode("utf-8", "ignore") + "…"
    words = ["".join(chr(b) for b in raw[s:e] if chr(b).isalnum() and b < 128).lower() for s, e in spans]
    hits = [_matches(w, terms) for w in words]
    counts: dict[str, int] = {}
    best, where, end, matches = -1, (0, 0), 0, 0
    for start in range(len(spans)):
        end = max(end, start)
        while end < len(spans) and (end == start or spans[end][1] - spans[start][0] <= most):
            if hits[end]:
                counts[words[end]] = counts.get(words[end], 0) + 1
                matches += 1
            end += 1
        if (score := 10 * len(counts) + matches) > best:
            best, where = score, (start, end)
        if hits[start]:
            matches -= 1
            counts[words[start]] -= 1
            if not counts[words[start]]:
                del counts[words[start]]
    left, right = _TAGS[form]
    shown = " ".join((left + w + right) if hits[i] and left else w for i, (s, e) in enumerate(spans[slice(*where)], where[0]) for w in [raw[s:e].decode("utf-8", "replace")])
    return ("…" if spans[where[0]][0] else "") + shown + ("…" if spans[where[1] - 1][1] < len(raw) else "")


def snippet_column(text: Column, query: list[str], most: int = 140, form: str = "none") -> Column:
    """snippet() as an Arrow UDF; meant for the few rows of a result."""
    return F.pandas_udf(lambda s: s.map(lambda t: snippet(t, query, most, form)), T.StringType())(text)


def highlight(text: Column, query: list[str], form: str = "html") -> Column:
    """The whole text with matching words tagged, blanks as single spaces; built from column functions."""
    terms = sorted({t.lower() for t in query})
    if form == "none" or not terms:
        return text
    left, right = _TAGS[form]

    def tag(w: Column) -> Column:
        clean = F.lower(F.regexp_replace(w, "[^A-Za-z0-9]", ""))
        hit = clean.isin(terms)
        for q in terms:
            if len(q) >= 3:
                hit = hit | clean.contains(q) | F.contains(F.lit(q), clean)
        return F.when(hit & (clean != ""), F.concat(F.lit(left), w, F.lit(right))).otherwise(w)

    return F.array_join(F.transform(F.filter(F.split(text, r"[ \t\n\r\f\x0B]+"), lambda w: w != ""), tag), " ")


def title(doc_id: Column, text: Column) -> Column:
    """Text before the first full stop if it has 6 to 84 characters, else the first 75 and dots."""
    first = F.trim(F.split(text, "[.]")[0])
    short = (F.length(first) > 5) & (F.length(first) < 85)
    return F.when(F.coalesce(text, F.lit("")) == "", F.concat(F.lit("Document #"), doc_id.cast("string"))).when(short, first).otherwise(F.concat(F.substring(text, 1, 75), F.lit("...")))


def truncated(text: Column, most: int = 115) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)

