"""Best-two-fit packing of tokenised documents into sequences of bounded length."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessel.llm._common import model, partitions, staged, tidy

LIMIT, END = 4096, 1
#: Pieces of one length that are ranked in one task at most on average; each length is ranked in as many cells as the
#: session has shuffle partitions, or in more.
CELL_ROWS = 100_000
#: Parts of words remembered by a worker before that memory is emptied.
CACHE_PARTS = 250_000
#: Bytes of text that are tokenized at once.
SLICE = 4 << 20
#: Texts with other characters go to the tokenizer whole: its Unicode rules are then decisive.
_PLAIN = re.compile("[\t-\r -~¡-įı-ɏ‐-‧€]*")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: How the tokenizer cuts a word of such a text, lower-cased, before it merges: it never joins two of these. For Arrow.
_PART = "('s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ɏ]+|[0-9²³¹¼-¾]|[^a-zªµºß-öø-ɏ0-9²³¹¼-¾]+)"


def _joined(raws: pa.Array, split: pa.Array, index: pa.Array) -> pa.Array:
    """Each list of split as the joined raws of its items; index holds the items' places in raws."""
    taken = raws.take(index)
    _, offsets, data = taken.buffers()
    ends = np.frombuffer(offsets, np.int64)[split.offsets.to_numpy()]
    return pa.Array.from_buffers(pa.large_binary(), len(split), [None, pa.py_buffer(ends), data])


class CachedTokenizer:
    """ids of texts. The tokenizer never joins across white space, so only distinct words are looked at.

    Words are cut into the parts that the tokenizer merges apart, and the ids of parts are remembered; unknown parts are
    encoded many at once, and the ids that end a part tell them apart again.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.parts: dict[str, bytes] = {}
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for w, i in vocab.items() if w.endswith("</w>")]] = True

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> None:
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            ids = np.array(self.tokenizer.encode(" ".join(part), add_special_tokens=False).ids, "<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(part):  # not one end a part: encode each alone
                self.parts.update(zip(part, self._whole(part), strict=True))
                continue
            raw, cuts = ids.tobytes(), [0, *(4 * ends).tolist()]
            self.parts.update((w, raw[i:j]) for w, i, j in zip(part, cuts[:-1], cuts[1:], strict=True))

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text.

        Texts are split into words and distinct words into parts in Arrow, which also joins their ids; Python sees each
        distinct part of the call once.
        """
        plain = ["<|" not in t and _PLAIN.fullmatch(t) is not None for t in texts]
        if len(self.parts) > CACHE_PARTS:
            self.parts.clear()
        words = pc.ascii_split_whitespace(pa.array([t.lower() for t, p in zip(texts, plain, strict=True) if p], pa.large_string()))
        word = words.flatten().dictionary_encode()
        parts = pc.ascii_split_whitespace(pc.ascii_rtrim_whitespace(pc.replace_substring_regex(word.dictionary, _PART, r"\1 ")))
        part = parts.flatten().dictionary_encode()
        distinct = part.dictionary.to_pylist()
        self._learn([p for p in distinct if p not in self.parts])
        raws = pa.array([self.parts[p] for p in distinct], pa.large_binary())
        known = iter(_joined(_joined(raws, parts, part.indices), words, word.indices).to_pylist())
        odd = iter(self._whole([t for t, p in zip(texts, plain, strict=True) if not p]))
        return [next(known) if p else next(odd) for p in plain]


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """batch in runs of rows of about SLICE bytes of text each; a longer text is a run of its own."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    cuts = [0, *(np.flatnonzero(np.diff(size // SLICE)) + 1).tolist(), batch.num_rows]
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        if i < j:
            yield batch.slice(i, j - i)


def pieces(docs: DataFrame, tokenizer: str | None = None, limit: int = LIMIT) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids with the end id, longer ones cut at `limit`."""
    path = tokenizer or default_tokenizer()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = model(("tokenizer", path), lambda: CachedTokenizer(path))
        end = np.array([END], "<u4").tobytes()
        for whole in it:
            for batch in _slices(whole):
                rows, out = [], [[], [], [], []]
                for i, raw in enumerate(tok.ids([t or "" for t in batch.column(1).to_pylist()])):
                    raw += end
                    for k, j in enumerate(range(0, len(raw), 4 * limit)):
                        part = raw[j : j + 4 * limit]
                        rows.append(i)
                        for c, v in zip(out, (k, j // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                            c.append(v)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(out[0], pa.int32()), *(pa.array(c, pa.int64()) for c in out[1:])], ["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(tidy(run, models=True), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def two_fit_pattern(left: np.ndarray, limit: int = LIMIT) -> tuple[list[int], int]:
    """(lengths of the next bin in order, bins that can be filled so one after another).

    left counts the lengths not yet packed. The bin takes the longest length left that fits, again and again. Then its
    smallest one is put back if two others fit the gap that it leaves more tightly. The choice depends only on which
    lengths are left, so the same bin follows until one of the lengths that it looked at and needs runs short.
    """
    index = np.arange(limit + 1)
    left = left.copy()
    have = left.copy()
    fits = np.maximum.accumulate(np.where(left > 0, index, 0))  # the longest length left up to each gap
    held: list[int] = []
    gap = limit
    while gap and (x := int(fits[gap])):
        times = int(min(left[x], gap // x))
        held += [x] * times
        left[x] -= times
        gap -= x * times
        if not left[x]:
            fits[x:] = np.where(fits[x:] == x, fits[x - 1], fits[x:])
    need = have - left
    if gap and len(held) > 1:
        small = held[-1]
        wide = gap + small
        a = index[1 : wide + 1]
        other = np.minimum(a, wide - a)
        second = fits[other]
        alone = (second == a) & (left[a] < 2)
        second = np.where(alone, fits[np.maximum(other - 1, 0)], second)
        total = np.where((left[a] > 0) & (second > 0), a + second, 0)
        at = int(total.argmax())
        if total[at] > small:
            held[-1:] = [int(a[at]), int(second[at])]
            need = np.maximum(need, np.bincount(held, minlength=limit + 1))
    asked = np.flatnonzero(need)
    return held, max(1, int((have[asked] // need[asked]).min()))


def best_two_fit(counts: np.ndarray, limit: int = LIMIT) -> tuple[np.ndarray, int]:
    """(slots, bins) from the number of pieces of each length 0..limit; the work depends on the lengths, not on the pieces.

    A slot is a row (length, first, taken, run, bin, offset): the pieces of that length with rank first .. first + taken
    - 1 lie in bins from `bin` on, `run` of them in each, from `offset` on. Slots are sorted by length and first.
    """
    left, done, slots, bins = counts.astype(np.int64).copy(), np.zeros(limit + 1, np.int64), [], 0
    left[0] = 0
    while left.any():
        held, times = two_fit_pattern(left, limit)
        offset, i = 0, 0
        while i < len(held):
            x = held[i]
            run = next((j for j in range(i, len(held)) if held[j] != x), len(held)) - i
            slots.append((x, int(done[x]), run * times, run, bins, offset))
            done[x] += run * times
            left[x] -= run * times
            offset += x * run
            i += run
        bins += times
    out = np.array(slots, np.int64).reshape(-1, 6)
    return out[np.lexsort((out[:, 1], out[:, 0]))], bins


def pack(docs: DataFrame, tokenizer: str | None = None, limit: int = LIMIT) -> DataFrame:
    """pieces() with sequence_id and offset, packed into sequences of at most `limit` tokens.

    Only the number of pieces of each length decides the bins, so the packing is global: one row a length, `limit` at
    most, reaches the driver and a table of slots of like size goes to the tasks. Pieces of a length are ranked by their
    place in the staged files, in cells of about CELL_ROWS whatever their ids, so neither a common length nor repeated
    rows meet in one task. Null text is empty: the end id alone. A very long text is tokenized whole by one task and cut.
    Rows that repeat a document are packed as often as they occur, pieces of equal length in the order of the files. An
    empty table gives an empty result; input columns besides doc_id and text are ignored, whatever their names.
    """
    cut = staged(pieces(docs, tokenizer, limit), "pieces")
    counts, n = np.zeros(limit + 1, np.int64), 0
    for r in cut.groupBy("length").count().collect():
        counts[r["length"]] = r["count"]
        n += r["count"]
    slots, _ = best_two_fit(counts, limit)
    at = F.struct(F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    placed = cut.withColumn("at_", at).withColumn("cell_", F.pmod(F.xxhash64("at_"), F.lit(max(partitions(docs.sparkSession), n // CELL_ROWS))))
    sizes = staged(placed.groupBy("length", "cell_").agg(F.count("*").alias("n_")), "cells")
    before = F.sum("n_").over(Window.partitionBy("length").orderBy("cell_").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("length", "cell_", F.coalesce(before, F.lit(0)).alias("before_"))
    inside = F.row_number().over(Window.partitionBy("length", "cell_").orderBy("at_")) - 1
    ranked = placed.withColumn("inside_", inside).join(sizes, ["length", "cell_"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before_") + F.col("inside_")).alias("rank"))
    most = int(counts.max()) + 1

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = slots[:, 0] * most + slots[:, 1]
        for b in it:
            length, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            s = slots[np.searchsorted(key, length * most + rank, side="right") - 1]
            place = rank - s[:, 1]
            sequence = s[:, 4] + place // s[:, 3]
            offset = s[:, 5] + length * (place % s[:, 3])
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = cut.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(tidy(run), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
