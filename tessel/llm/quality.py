"""Quality rules: base counts of whole texts and a linear-chain CRF that marks lines as content or boilerplate."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm._common import small_batches, tidy
from tessel.llm._text import mix, word_hashes

SYMBOLS = "#*$%&|<>"
#: Labelled documents that the CRF is fitted on at most, and characters of each.
FIT_DOCS, FIT_CHARS = 400, 6000
#: Share of a document's words in content lines from which it is kept.
CONTENT_SHARE = 0.5
BLOCK_CHARS = 1 << 20
#: Characters of a long text, and 3-word windows of it, that are looked at in one go.
SLICE, WINDOWS = 1 << 20, 1 << 20
_SPACE, _UPPER, _LETTER, _DIGIT, _SYMBOL, _BANG, _OTHER = range(7)


def _classes() -> np.ndarray:
    """Class of each code point below 0x3100; the last row stands for all beyond."""
    table = np.full(0x3100, _OTHER, np.uint8)
    for c in range(0x3100):
        x = chr(c)
        table[c] = _SPACE if x in " \t\n\r\x0b\x0c" else _UPPER if x.isupper() else _LETTER if x.isalpha() else _DIGIT if x.isdigit() else _SYMBOL if x in SYMBOLS else _BANG if x == "!" else _OTHER
    return table


_TABLE = _classes()
_KINDS = np.eye(7, dtype=np.int32)
FEATURES = ("bias", "few_words", "some_words", "many_words", "symbols_5", "symbols_20", "upper_30", "upper_70", "bangs_3", "bars", "digits_20", "repeats", "no_stop", "short_words", "sentence")


def _line_counts(joined: str, lines: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per line of joined: its characters by class, its words, its bars, and its last visible code point (0: none).

    The text is read in slices of SLICE characters, whatever the lengths of its lines.
    """
    counts, words, bars, last = np.zeros((lines, 7), np.int64), np.zeros(lines, np.int64), np.zeros(lines, np.int64), np.zeros(lines, np.uint32)
    line, before = 0, True  # the line at the slice's start; whether white space precedes it
    for at in range(0, len(joined), SLICE):
        codes = np.frombuffer(joined[at : at + SLICE].encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = _TABLE[np.minimum(codes, len(_TABLE) - 1)]
        broken = codes == 10
        of = np.cumsum(broken)
        here, of = int(of[-1]) + 1, of - broken
        text = ~broken
        counts[line : line + here] += np.bincount(of[text] * 7 + kind[text], minlength=7 * here).reshape(here, 7)
        solid = kind != _SPACE
        starts = solid.copy()
        starts[1:] &= ~solid[:-1]
        starts[0] &= before
        words[line : line + here] += np.bincount(of[starts], minlength=here)
        bars[line : line + here] += np.bincount(of[codes == 124], minlength=here)
        seen = np.flatnonzero(solid)
        ends = seen[np.append(of[seen][1:] != of[seen][:-1], True)] if len(seen) else seen
        last[line + of[ends]] = codes[ends]
        line, before = line + here - 1, not solid[-1]
    return counts, words, bars, last


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Of texts that are split into lines: features (lines x FEATURES), lines per text, words per line, and sums.

    The sums are, per text, its characters in words, its symbols and its lines with a word that equal an earlier line.
    """
    lines_of = np.array([t.count("\n") + 1 for t in texts])
    counts, words, bars, last = _line_counts("\n".join(texts), int(lines_of.sum()))
    again = np.zeros(len(words), bool)
    at, dups = 0, []
    for t in texts:
        seen: set[str] = set()
        found = 0
        for line in t.split("\n"):
            if line in seen:
                if words[at]:
                    again[at] = True
                    found += 1
            else:
                seen.add(line)
            at += 1
        dups.append(found)
    space, symbols = counts[:, _SPACE], counts[:, _SYMBOL]
    letters = np.maximum(1, counts[:, _UPPER] + counts[:, _LETTER])
    written = counts.sum(axis=1) - space
    visible = np.maximum(1, written)
    x = np.zeros((len(words), len(FEATURES)), np.float32)
    x[:, 0] = 1
    x[:, 1] = words <= 3
    x[:, 2] = (words > 3) & (words <= 12)
    x[:, 3] = words > 40
    x[:, 4] = symbols > 0.05 * visible
    x[:, 5] = symbols > 0.2 * visible
    x[:, 6] = counts[:, _UPPER] > 0.3 * letters
    x[:, 7] = counts[:, _UPPER] > 0.7 * letters
    x[:, 8] = counts[:, _BANG] > 0.03 * visible
    x[:, 9] = bars * 10 > words
    x[:, 10] = counts[:, _DIGIT] > 0.2 * visible
    x[:, 11] = again
    x[:, 12] = ~np.isin(last, [46, 33, 63, 58, 34, 8230])
    x[:, 13] = visible < 3 * words
    x[:, 14] = (words > 12) & (x[:, 12] == 0)
    first = np.cumsum(lines_of) - lines_of
    return x, lines_of, words, [np.add.reduceat(written, first), np.add.reduceat(symbols, first), np.array(dups)]


#: Features that speak for boilerplate in a line of its own, by name.
BAD = ("symbols_5", "upper_70", "bangs_3", "bars", "digits_20", "repeats")


def weak_labels(x: np.ndarray, lines_of: np.ndarray, words: np.ndarray, good: np.ndarray) -> np.ndarray:
    """Label of each line for the fit: 1 content, 0 boilerplate.

    A line with a feature of BAD and no sentence is boilerplate; a sentence (more than twelve words up to a full stop)
    without one is content; where both or neither hold, the label of the document that the line is from (good, one a
    line) decides. A line without words takes the label of the line before it.
    """
    bad = x[:, [FEATURES.index(f) for f in BAD]].any(axis=1)
    sentence = x[:, FEATURES.index("sentence")] > 0
    labels = np.where(bad & ~sentence, 0, np.where(sentence & ~bad, 1, good))
    first = np.zeros(len(words), bool)
    first[np.cumsum(lines_of) - lines_of] = True
    source = np.maximum.accumulate(np.where(first | (words > 0), np.arange(len(words)), 0))
    return labels[source]


def spliced(good: list[str], bad: list[str], seed: int = 7) -> tuple[list[str], list[int]]:
    """(texts, labels of their lines) that alternate between one to three lines of a good text and of a bad one.

    Labelled documents are mostly one thing throughout; from these texts the fit learns where labels change.
    """
    rnd = np.random.RandomState(seed)
    texts, labels = [], []
    for pair in zip(good, bad, strict=False):
        parts = [t.split("\n") for t in pair]
        turn, lines = int(rnd.randint(2)), []
        while parts[0] and parts[1]:
            n = int(rnd.randint(1, 4))
            now, parts[turn] = parts[turn][:n], parts[turn][n:]
            lines += now
            labels += [1 - turn] * len(now)
            turn = 1 - turn
        texts.append("\n".join(lines))
    return texts, labels


class LineCrf:
    """Linear-chain CRF with the labels 0 boilerplate and 1 content."""

    def __init__(self, emit: np.ndarray | None = None, step: np.ndarray | None = None) -> None:
        self.emit = np.zeros((len(FEATURES), 2)) if emit is None else emit
        self.step = np.zeros((2, 2)) if step is None else step

    @staticmethod
    def _padded(scores: np.ndarray, lines_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.argsort(-lines_of, kind="stable")
        first = np.cumsum(lines_of) - lines_of
        live = np.searchsorted(-lines_of[order], -np.arange(1, int(lines_of.max()) + 1), side="right")
        return order, first[order], live

    def fit(self, x: np.ndarray, lines_of: np.ndarray, labels: np.ndarray, rounds: int = 120, rate: float = 0.5, ridge: float = 1e-3) -> LineCrf:
        """Gradient ascent on the log likelihood of the labels, all sequences at once."""
        total = len(x)
        gold = np.eye(2)[labels]
        pair = np.ones(total, bool)
        pair[np.cumsum(lines_of) - lines_of] = False
        at = np.flatnonzero(pair)
        seen = np.zeros((2, 2))
        np.add.at(seen, (labels[at - 1], labels[at]), 1)
        for _ in range(rounds):
            s = x @ self.emit
            order, first, live = self._padded(s, lines_of)
            fwd, bwd = np.zeros((total, 2)), np.zeros((total, 2))
            for j, m in enumerate(live):
                rows = first[:m] + j
                fwd[rows] = s[rows] if not j else s[rows] + np.logaddexp(fwd[rows - 1, :1] + self.step[0], fwd[rows - 1, 1:] + self.step[1])
            for j in range(len(live) - 2, -1, -1):
                rows = first[: live[j + 1]] + j
                v = s[rows + 1] + bwd[rows + 1]
                bwd[rows] = np.logaddexp(self.step[:, 0] + v[:, :1], self.step[:, 1] + v[:, 1:])
            z = np.logaddexp.reduce(fwd + bwd, axis=1)
            p = np.exp(fwd + bwd - z[:, None])
            both = np.exp(fwd[at - 1][:, :, None] + self.step[None] + (s[at] + bwd[at])[:, None, :] - z[at][:, None, None]).sum(axis=0)
            self.emit += rate * (x.T @ (gold - p) / total - ridge * self.emit)
            self.step += rate * ((seen - both) / max(1, len(at)) - ridge * self.step)
        return self

    def decode(self, x: np.ndarray, lines_of: np.ndarray) -> np.ndarray:
        """Viterbi path of every sequence."""
        s = x @ self.emit
        order, first, live = self._padded(s, lines_of)
        best, back = np.zeros_like(s), np.zeros(s.shape, np.int8)
        for j, m in enumerate(live):
            rows = first[:m] + j
            if not j:
                best[rows] = s[rows]
                continue
            come = best[rows - 1][:, :, None] + self.step[None]
            back[rows] = come.argmax(axis=1)
            best[rows] = s[rows] + come.max(axis=1)
        path = np.ones(len(s), np.int8)
        ends = np.cumsum(lines_of) - 1
        path[ends] = (best[ends, 1] >= best[ends, 0]).astype(np.int8)
        for j in range(len(live) - 2, -1, -1):
            rows = first[: live[j + 1]] + j
            path[rows] = back[rows + 1, path[rows + 1]]
        return path


def repeated_words(words: np.ndarray) -> int:
    """Words inside 3-word windows that occur twice or more; windows are compared by hash, WINDOWS at a time."""
    if len(words) < 4:
        return 0
    with np.errstate(over="ignore"):
        h = mix(mix(words[:-2]) * np.uint64(3) + words[1:-1]) * np.uint64(5) + words[2:]
    twice = np.zeros(len(h), bool)
    parts = -(-len(h) // WINDOWS)
    for part in range(parts):
        at = np.flatnonzero(h % np.uint64(parts) == part) if parts > 1 else np.arange(len(h))
        _, where, times = np.unique(h[at], return_inverse=True, return_counts=True)
        twice[at] = times[where] > 1
    marked = np.zeros(len(words), bool)
    for i in range(3):
        marked[i : len(words) - 2 + i] |= twice
    return int(marked.sum())


def fit_texts(texts: list[str], good: list[int]) -> LineCrf:
    """CRF from texts that are each good (1) or bad (0)."""
    mixed, labels = spliced([t for t, q in zip(texts, good, strict=True) if q], [t for t, q in zip(texts, good, strict=True) if not q])
    labels = [q for t, q in zip(texts, good, strict=True) for _ in range(t.count("\n") + 1)] + labels
    x, lines_of, words, _ = line_features(texts + mixed)
    return LineCrf().fit(x.astype(np.float64), lines_of, weak_labels(x, lines_of, words, np.array(labels)))


def fit_crf(docs: DataFrame, labels: DataFrame) -> LineCrf:
    """CRF from the lines of at most FIT_DOCS labelled documents, FIT_CHARS characters each; see weak_labels().

    The documents are learned from as they are, and once more with good and bad ones spliced.

    labels has doc_id and quality (1 good, 0 bad). Rows enter by a hash of doc_id, half of either label. Without
    labelled rows the model has no opinion and takes every line as content.
    """
    u = F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(1 << 30))
    ids: dict[int, int] = {}
    for q in (0, 1):
        mine = labels.filter(F.col("quality") == q).select("doc_id").distinct()
        ids |= {r[0]: q for r in mine.orderBy(u, "doc_id").limit(FIT_DOCS // 2).collect()}
    if not ids:
        return LineCrf()
    rows = docs.filter(F.col("doc_id").isin(list(ids))).select("doc_id", F.substring("text", 1, FIT_CHARS).alias("text")).filter("text is not null").limit(FIT_DOCS).collect()
    rows = sorted(rows, key=lambda r: (r["doc_id"], r["text"]))
    if not rows:
        return LineCrf()
    return fit_texts([r["text"] for r in rows], [ids[r["doc_id"]] for r in rows])


def _blocks(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for batch in it:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= BLOCK_CHARS):
                size += len(texts[end]) + 1
                end += 1
            yield batch.slice(at, end - at), texts[at:end]
            at = end


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document its counts, base_failed, content_share and kept.

    Counts cover the whole text (null: empty, all zero, which fails the base rule). content_share is the share of
    words in lines that the CRF's best path marks as content (a tie of two paths goes to the label 0 within a text and
    to 1 at its end). kept: the base rules hold and that share is at least CONTENT_SHARE. Long texts are read in slices;
    what is held of one is a few numbers a line and a word. Rows that repeat get equal results; columns besides doc_id
    and text are ignored, whatever their names; an empty table gives an empty result.
    """
    crf = fit_crf(docs, labels)
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(it):
        for batch, texts in _blocks(it):
            x, lines_of, words, (chars, symbols, dups) = line_features(texts)
            path = crf.decode(x, lines_of)
            first = np.cumsum(lines_of) - lines_of
            n = np.add.reduceat(words, first)
            share = np.add.reduceat(words * path, first) / np.maximum(n, 1)
            repeats = np.array([repeated_words(w) for _, w in word_hashes([t.encode("utf-8", "replace") for t in texts])])
            failed = (n < 50) | (100 * repeats > 50 * n)
            kept = ~failed & (share >= CONTENT_SHARE)
            cols = [batch.column(0), n, chars, symbols, dups, repeats, failed, kept, share]
            yield pa.RecordBatch.from_arrays([pa.array(c) if not isinstance(c, pa.Array) else c for c in cols], ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share"])

    schema = f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double"
    return docs.select("doc_id", "text").mapInArrow(tidy(run), schema)
