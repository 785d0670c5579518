"""Word pieces by greedy longest match, in the two forms that the two kinds of encoders read."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Ids of the special pieces.
UNKNOWN, START, END = 100, 101, 102
_BLANKS = re.compile(r"[ \t\n\r\x0b\x0c]+")


def read_vocabulary(spark: SparkSession, path: str) -> dict[str, int]:
    """Piece -> id from a text file with one piece a line; a vocabulary is some ten thousand lines, which its file's size bounds."""
    text = spark.read.text(path, wholetext=True).first()
    lines = (text["value"] if text else "").split("\n")
    return {piece.removesuffix("\r"): i for i, piece in enumerate(lines) if piece or i < len(lines) - 1}


def _longest(word: str, start: int, vocabulary: dict[str, int]) -> int:
    """End of the longest piece of word from start on; start if there is none."""
    mark = "##" if start else ""
    return next((end for end in range(len(word), start, -1) if mark + word[start:end] in vocabulary), start)


def word_pieces(word: str, vocabulary: dict[str, int]) -> list[int]:
    """Ids of a word for the single encoder: an unknown rest is one UNKNOWN and ends the word."""
    ids, at = [], 0
    while at < len(word):
        end = _longest(word, at, vocabulary)
        if end == at:
            return [*ids, UNKNOWN]
        ids.append(vocabulary["##" * (at > 0) + word[at:end]])
        at = end
    return ids


def single_ids(text: str | None, vocabulary: dict[str, int], most: int = 128) -> list[int]:
    """Ids of a text for the single encoder: START, pieces of the ASCII words in lower case, END; at most `most` in all."""
    clean = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "" if ord(c) < 128)
    ids = [START]
    for word in filter(None, _BLANKS.split(clean)):
        for piece in word_pieces(word, vocabulary):
            if len(ids) >= most - 1:
                break
            ids.append(piece)
    return [*ids, END]


def whole_word_pieces(word: str, vocabulary: dict[str, int]) -> list[int]:
    """Ids of a word for the pair encoder: a word with an unknown rest is UNKNOWN as a whole."""
    ids = word_pieces(word, vocabulary)
    broken = sum(_piece_lengths(word, vocabulary)) < len(word)
    return [vocabulary.get("[UNK]", UNKNOWN)] if broken else ids


def _piece_lengths(word: str, vocabulary: dict[str, int]) -> list[int]:
    out, at = [], 0
    while at < len(word) and (end := _longest(word, at, vocabulary)) > at:
        out.append(end - at)
        at = end
    return out


def pair_ids(query: list[str], text: list[str], vocabulary: dict[str, int], most: int = 128) -> tuple[list[int], list[int]]:
    """(ids, segments) of a pair of token lists: START query END text END.

    A token whose pieces reach half of `most` (query) or `most` - 1 (text) is cut there, but the tokens after it each still
    add one piece: the cap ends a token, not the list. Segment 1 begins at the first END.
    """
    start, end = vocabulary.get("[CLS]", START), vocabulary.get("[SEP]", END)
    ids = [start]
    for tokens, cap in ((query, most // 2), (text, most - 1)):
        for token in tokens:
            for piece in whole_word_pieces(token, vocabulary):
                ids.append(piece)
                if len(ids) >= cap:
                    break
        ids.append(end)
    first = ids.index(end)
    return ids, [int(i >= first) for i in range(len(ids))]


def encoded(texts: DataFrame, vocabulary: dict[str, int], column: str = "text", most: int = 128) -> DataFrame:
    """texts with ids, the single encoder's input; null texts are START END."""
    from pyspark.sql import types as T

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            ids = [single_ids(t, vocabulary, most) for t in batch.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int32()))], [*batch.schema.names, "ids"])

    return texts.mapInArrow(run, T.StructType([*texts.schema, T.StructField("ids", T.ArrayType(T.IntegerType()))]))
