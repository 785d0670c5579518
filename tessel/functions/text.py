"""Text analysis as column expressions; only the stemmer needs Python, and it runs on the distinct vocabulary."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

#: Words that the analysers leave out.
STOP_WORDS = ["a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "he", "in", "is", "it", "its", "of", "on", "that", "the", "to", "was", "will", "with"]
BLANKS = r"[ \t\n\r\f\x0B]"

#: Suffix rules of the stemmer in the order in which they are tried.
STEP_2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]

_VOWELS = re.compile("v+")


def _mask(word: str) -> str:
    """v and c for vowels and consonants; y is a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(word):
        out += "v" if ch in "aeiou" or (ch == "y" and i and out[-1] == "c") else "c"
    return out


def _measure(word: str) -> int:
    return len(_VOWELS.findall(_mask(word)))


def _short(word: str) -> bool:
    """Consonant, vowel, consonant at the end, the last not w, x or y."""
    return _mask(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _suffix(word: str, rules: dict[str, str], least: int) -> str:
    """The first rule whose suffix fits and whose stem measures at least `least`; a rule that doesn't apply yields to later ones."""
    for end, new in rules.items():
        if word.endswith(end) and _measure(word[: -len(end)]) >= least:
            return word[: -len(end)] + new
    return word


def stem(word: str) -> str:
    """Suffix-stripping stem of a word; words of one or two characters stay."""
    if len(word) <= 2:
        return word
    w = word.lower()
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    cut = next((n for end, n in (("eed", 0), ("ed", 2), ("ing", 3)) if w.endswith(end)), None)
    if cut == 0:
        w = w[:-1] if _measure(w[:-3]) else w
    elif cut and "v" in _mask(w[:-cut]):
        w = w[:-cut]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w[-2:-1] == w[-1:] and _mask(w)[-1] == "c":
            w = w if w[-1] in "lsz" else w[:-1]
        elif _measure(w) == 1 and _short(w):
            w += "e"
    if w.endswith("y") and "v" in _mask(w[:-1]):
        w = w[:-1] + "i"
    w = _suffix(_suffix(w, STEP_2, 1), STEP_3, 1)
    for end in STEP_4:
        base = w[: len(w) - len(end)]
        if not w.endswith(end):
            continue
        if end == "ion":  # ends the search, whether it is cut or not
            w = base if _measure(base) > 1 and base[-1] in "st" else w
            break
        if _measure(base) > 1:
            w = base
            break
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _short(w[:-1])):
            w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w) > 1 else w


@pandas_udf(T.StringType())
def stem_udf(words: pd.Series) -> pd.Series:
    return words.map(stem, na_action="ignore")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), in which value is worked out once a row however often it stands there."""
    return F.transform(F.array(value), use)[0]


def normalize(text: Column) -> Column:
    """ASCII letters and digits in lower case, runs of blanks as one space, everything else deleted without a split."""
    return F.trim(F.lower(F.regexp_replace(F.regexp_replace(text, r"[^A-Za-z0-9 \t\n\r\f\x0B]", ""), BLANKS + "+", " ")))


def tokenize(text: Column) -> Column:
    return F.filter(F.split(normalize(text), " "), lambda t: t != "")


def remove_stop_words(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: ~t.isin(STOP_WORDS))


def bigrams(tokens: Column, least: int = 3) -> Column:
    """Adjacent pairs of tokens that both have at least `least` characters."""
    n = F.greatest(F.lit(0), F.size(tokens) - 1)
    pairs = F.zip_with(F.slice(tokens, 1, n), F.slice(tokens, 2, n), lambda l, r: F.when((F.length(l) >= least) & (F.length(r) >= least), F.concat_ws(" ", l, r)))
    return F.filter(pairs, lambda p: p.isNotNull())


#: Tokens of which arrays are made at once.
SLICE = 1 << 18


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """batch, with token lists in column 1, in runs of rows that hold SLICE tokens at most, or of one longer row.

    Memory then follows neither the number of rows of a batch nor their lengths, only the longest document.
    """
    ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE, "right")))
        yield batch.slice(at, to - at)
        at = to


def analyzed_tokens(tokens: pa.Array, stemming: bool) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(number of each token's term, tokens a row, terms) of a batch of token lists; a distinct word is stemmed once."""
    lengths = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    words = tokens.flatten().dictionary_encode()
    terms, codes = words.dictionary, words.indices.to_numpy(zero_copy_only=False)
    if stemming:
        stems = pa.array([stem(w) for w in terms.to_pylist()], pa.string()).dictionary_encode()
        codes, terms = stems.indices.to_numpy(zero_copy_only=False)[codes] if len(codes) else codes, stems.dictionary
    return codes, lengths, terms


def analyze(docs: DataFrame, analyzer: str = "stem", text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, pos, term): positions are over the tokens left after the stop words. No shuffle: stems are made batch by batch."""
    tokens = remove_stop_words(tokenize(F.col(text)))
    if analyzer == "stop":
        return docs.select(key, F.posexplode(tokens).alias("pos", "term"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in it for part in slices(whole)):
            codes, lengths, terms = analyzed_tokens(batch.column(1), True)
            row = np.repeat(np.arange(len(lengths)), lengths)
            pos = np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(pos.astype(np.int32)), terms.take(pa.array(codes))], [key, "pos", "term"])

    return docs.select(key, tokens.alias("tokens")).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, pos int, term string")


def bigram_counts(docs: DataFrame, text: str = "text", key: str = "doc_id", least: int = 3) -> DataFrame:
    """(key, bigram, n): how often each pair of bigrams() stands in the texts of a key.

    Pairs are counted row by row, without a shuffle; only where a key has several rows are their counts added up.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in it for part in slices(whole)):
            codes, lengths, terms = analyzed_tokens(batch.column(1), False)
            row, codes, size = np.repeat(np.arange(len(lengths)), lengths), codes.astype(np.int64), len(terms)
            fits = (pc.utf8_length(terms).to_numpy(zero_copy_only=False) >= least)[codes]
            at = np.flatnonzero((row[1:] == row[:-1]) & fits[1:] & fits[:-1])
            if not len(at):
                continue
            pair, n = np.unique((row[at] * size + codes[at]) * size + codes[at + 1], return_counts=True)
            words = pc.binary_join_element_wise(terms.take(pa.array(pair // size % size)), terms.take(pa.array(pair % size)), " ")
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(pair // size**2)), words, pa.array(n.astype(np.int64))], [key, "bigram", "n"])

    out = docs.select(key, tokenize(F.col(text)).alias("tokens")).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, bigram string, n long")
    once = docs.groupBy(key).count().filter("count > 1").isEmpty()
    return out if once else out.groupBy(key, "bigram").agg(F.sum("n").alias("n"))


def query_terms(text: str, analyzer: str = "stem") -> list[str]:
    """Analysed tokens of a query string, on the driver."""
    kept = re.sub(r"[^A-Za-z0-9 \t\n\r\f\x0b]", "", text).lower().split()
    out = [t for t in kept if t not in STOP_WORDS]
    return [stem(t) for t in out] if analyzer == "stem" else out


def register(spark: SparkSession) -> None:
    """Makes porter_stem callable from SQL."""
    spark.udf.register("porter_stem", stem_udf)
