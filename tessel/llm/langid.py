"""Language identification by cross-parsing entropy over suffix automata."""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessel.llm._common import local_table, model, small_batches, tidy

#: Bound of the sample that the automata are built from: characters a language, characters a row, rows a language.
FIT_CHARS, FIT_ROW_CHARS, FIT_ROWS = 24_000, 600, 80
#: Symbols of a piece, and pieces that are parsed side by side. Phrases run on over the edges of pieces.
PIECE, PIECES = 512, 2048
#: Rows below which pieces are parsed one by one where parses don't agree yet.
FEW = 16
UNKNOWN = "und"
#: Symbols that a phrase holds on average at least in a text that is of a known language at all.
LEAST_PHRASE = 1.5
#: Cells of the dense transition tables of a parser; languages beyond it keep their transitions sparse.
DENSE_CELLS = 8_000_000


def fold(codes: np.ndarray, alphabet: np.ndarray) -> np.ndarray:
    """Symbols of code points: 0 anything but a letter, 1 a letter unseen in training, 2.. the alphabet."""
    return alphabet[codes]


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


def _alphabet(texts: list[str]) -> np.ndarray:
    """Table from code point to symbol; every letter of texts has its own."""
    table = np.array([chr(c).isalpha() for c in range(sys.maxunicode + 1)], np.int32)
    seen = Counter(c for t in texts for c in t.lower() if c.isalpha())
    for i, (c, _) in enumerate(sorted(seen.items(), key=lambda x: (-x[1], x[0]))):
        table[ord(c)] = i + 2
    return table


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a sequence; state 0 is the start and every path is a substring."""
    trans: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        cur = len(trans)
        trans.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in trans[p]:
            trans[p][c] = cur
            p = link[p]
        if p != -1:
            q = trans[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(trans)
                trans.append(dict(trans[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and trans[p].get(c) == q:
                    trans[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return trans


class _Automaton:
    """One language's next state of (state, symbol), with a bit where a phrase ends.

    Its letters have numbers of their own: 0 no letter, 1 a letter that its sample lacks, 2.. the others. The
    transitions are a dense table if room allows, else sorted keys.
    """

    ENDS = np.int32(1 << 30)

    def __init__(self, symbols: np.ndarray, width: int, room: int) -> None:
        own = np.unique(symbols[symbols > 1])
        self.local = np.minimum(np.arange(width, dtype=np.int32), 1)
        self.local[own] = np.arange(2, len(own) + 2)
        self.width = len(own) + 2
        trans = suffix_automaton(self.local[symbols].tolist())
        key, to = (np.fromiter(x, np.int64) for x in ((s * self.width + c for s, out in enumerate(trans) for c in out), (t for out in trans for t in out.values())))
        start = np.zeros(self.width, np.int32)  # a phrase that ends here restarts with this symbol
        for c, t in trans[0].items():
            start[c] = t
        self.cells = len(trans) * self.width
        self.start = start | self.ENDS
        if self.cells <= room:
            self.table = np.tile(self.start, len(trans))
            self.table[key] = to
        else:
            self.table, order = None, np.argsort(key)
            self.key, self.to = np.append(key[order], np.iinfo(np.int64).max), np.append(to[order], 0).astype(np.int32)

    def next(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        if self.table is not None:
            return self.table[state * self.width + symbol]
        key = state.astype(np.int64) * self.width + symbol
        at = np.searchsorted(self.key, key)
        return np.where(self.key[at] == key, self.to[at], self.start[symbol])


    def walk(self, state: int, symbols: list[int], known: list[int]) -> tuple[list[int], list[bool]]:
        """(states, phrase ends) after each symbol, up to the first at which the known parse is met."""
        table, width, mask = memoryview(self.table) if self.table is not None else None, self.width, int(self.ENDS) - 1
        found, marks = [], []
        for c, k in zip(symbols, known, strict=True):
            nxt = table[state * width + c] if table is not None else int(self.next(np.array([state]), np.array([c]))[0])
            state = nxt & mask
            found.append(state)
            marks.append(nxt > mask)
            if state == k:
                break
        return found, marks


class Parser:
    """Automata of all languages over one alphabet."""

    def __init__(self, training: dict[str, str]) -> None:
        self.langs = sorted(training)
        self.alphabet = _alphabet([training[x] for x in self.langs])
        self.automata, room = [], DENSE_CELLS
        for lang in self.langs:
            made = _Automaton(squeeze(fold(_codes(training[lang].lower()), self.alphabet)), int(self.alphabet.max()) + 1, room)
            room -= made.cells if made.table is not None else 0
            self.automata.append(made)

    def phrases(self, pieces: np.ndarray, lengths: np.ndarray, before: np.ndarray | None = None, entry: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(phrases that end in each row of pieces, state after it), both by language.

        pieces has symbols, padded row by row, and lengths fall. before: the row that each row goes on from, -1 for none;
        such a row enters in that row's last state, the others in entry (by language; the start state by default). All rows
        are parsed at once from their assumed states. Where a row turns out to be entered in another state, it is parsed
        again up to the symbol at which both parses agree, which is a phrase or two.
        """
        n, langs, width = len(pieces), len(self.langs), pieces.shape[1]
        before = np.full(n, -1) if before is None else before
        ended, last = np.zeros((langs, n), np.int64), np.zeros((langs, n), np.int32)
        columns = np.ascontiguousarray(pieces.T).astype(np.int32)
        live = np.searchsorted(-lengths, -np.arange(1, width + 1), side="right")
        for k, automaton in enumerate(self.automata):
            enter = np.zeros(n, np.int32) if entry is None else entry[k].astype(np.int32)
            states = np.zeros((width, n), np.int32)
            ends = np.zeros((width, n), bool)
            state = enter.copy()
            for j in range(width):
                m = live[j]
                if not m:
                    break
                nxt = automaton.next(state[:m], automaton.local[columns[j, :m]])
                ends[j, :m] = nxt >> 30
                state[:m] = nxt & (_Automaton.ENDS - 1)
                states[j, :m] = state[:m]
            follows = before >= 0
            while True:
                due = np.flatnonzero(follows & (np.where(follows, state[before], enter) != enter))
                if not len(due):
                    break
                enter[due] = at = state[before[due]]
                for j in range(width):
                    on = lengths[due] > j
                    due, at = due[on], at[on]
                    if len(due) < FEW:
                        break
                    nxt = automaton.next(at, automaton.local[columns[j, due]])
                    ends[j, due] = nxt >> 30
                    at = nxt & (_Automaton.ENDS - 1)
                    apart = at != states[j, due]
                    states[j, due] = at
                    done = lengths[due] == j + 1
                    state[due[done]] = at[done]
                    due, at = due[apart], at[apart]
                for row, now in zip(due.tolist(), at.tolist(), strict=True):  # one by one: such texts may never agree
                    stop = int(lengths[row])
                    found, marks = automaton.walk(now, automaton.local[columns[j:stop, row]].tolist(), states[j:stop, row].tolist())
                    states[j : j + len(found), row] = found
                    ends[j : j + len(found), row] = marks
                    state[row] = states[stop - 1, row]
            ended[k], last[k] = ends.sum(axis=0), state
        return ended, last


def squeeze(symbols: np.ndarray) -> np.ndarray:
    """symbols with runs of 0 as one 0."""
    if len(symbols) < 2:
        return symbols
    keep = np.ones(len(symbols), bool)
    keep[1:] = (symbols[1:] != 0) | (symbols[:-1] != 0)
    return symbols[keep]


def _parser(training: dict[str, str]) -> Parser:
    """The parser of a worker process, built from the training text when first needed."""
    return model(("parser", tuple(sorted(training.items()))), lambda: Parser(training))


def training_text(rows: DataFrame) -> dict[str, str]:
    """Sample of text a language from rows with doc_id, text and lang; at most FIT_CHARS characters each.

    Rows enter by a hash of doc_id at a rate that gives each label about FIT_ROWS rows, so the sample is bounded and
    reruns agree; rows repeat no text twice.
    """
    rows = rows.filter("lang is not null and text is not null")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    rates = local_table(rows.sparkSession, {"lang": pa.array(list(counts), pa.string()), "rate": pa.array([FIT_ROWS / n for n in counts.values()], pa.float64())})
    u = F.pmod(F.xxhash64(F.lit(6), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    some = rows.withColumn("u", u).join(F.broadcast(rates), "lang").filter("u < rate")
    some = some.select("lang", F.substring("text", 1, FIT_ROW_CHARS).alias("text"), "u")
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("u", "text"))
    some = some.withColumn("nth", nth).filter(F.col("nth") <= 2 * FIT_ROWS).orderBy("lang", "nth")
    out: dict[str, list[str]] = {lang: [] for lang in counts}
    for r in some.collect():
        if r["text"] not in out[r["lang"]]:
            out[r["lang"]].append(r["text"])
    found = {lang: " ".join(texts)[:FIT_CHARS] for lang, texts in out.items()}
    least = min((len(t) for t in found.values() if t), default=0)
    return {lang: t[: max(least, FIT_CHARS // 4)] for lang, t in found.items() if t}  # near equal lengths: a longer text alone parses better


class _Counts:
    """Phrases of many texts in each language; pieces of texts are gathered and parsed side by side."""

    def __init__(self, parser: Parser, texts: int) -> None:
        self.parser, self.phrases = parser, np.zeros((max(1, len(parser.langs)), texts), np.int64)
        self.pieces: list[np.ndarray] = []
        self.owner: list[int] = []
        self.carried: tuple[int, np.ndarray] | None = None  # the text of the last piece parsed, and its states

    def add(self, text: int, symbols: np.ndarray) -> None:
        for j in range(0, len(symbols), PIECE):
            self.pieces.append(symbols[j : j + PIECE])
            self.owner.append(text)
            if len(self.pieces) >= PIECES:
                self.flush()

    def flush(self) -> None:
        if not self.pieces or not self.parser.langs:
            return
        lengths, owner = np.array([len(p) for p in self.pieces]), np.array(self.owner)
        order = np.argsort(-lengths, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        grid = np.zeros((len(order), int(lengths.max())), np.int32)
        for row, i in enumerate(order):
            grid[row, : lengths[i]] = self.pieces[i]
        before = np.full(len(order), -1)
        on = np.flatnonzero(owner[1:] == owner[:-1]) + 1
        before[place[on]] = place[on - 1]
        entry = np.zeros((len(self.parser.langs), len(order)), np.int32)
        if self.carried and self.carried[0] == owner[0]:
            entry[:, place[0]] = self.carried[1]
        ended, last = self.parser.phrases(grid, lengths[order], before, entry)
        for k in range(len(self.parser.langs)):
            np.add.at(self.phrases[k], owner[order], ended[k])
        self.carried = owner[-1], last[:, place[-1]]
        self.pieces.clear()
        self.owner.clear()


def _score(it: Iterator[pa.RecordBatch], training: dict[str, str], rows: int = 400) -> Iterator[pa.RecordBatch]:
    """(doc_id, lang_pred, score, phrase_rate) of batches of (doc_id, text)."""
    parser = _parser(training)
    for whole in it:
        for at in range(0, whole.num_rows, rows):
            batch = whole.slice(at, rows)
            texts = batch.column(1).to_pylist()
            n = len(texts)
            letters, symbols, counts = np.zeros(n, np.int64), np.zeros(n, np.int64), _Counts(parser, n)
            for i, t in enumerate(texts):
                s = squeeze(fold(_codes((t or "").lower()), parser.alphabet))
                letters[i], symbols[i] = np.count_nonzero(s), len(s)
                if letters[i]:
                    counts.add(i, s)
            counts.flush()
            phrases = counts.phrases + 1  # the last phrase ends with the text
            best, score = np.zeros(n, np.int64), np.zeros(n)
            if parser.langs:
                best, ordered = phrases.argmin(axis=0), np.sort(phrases, axis=0)
                second = ordered[1] if len(parser.langs) > 1 else symbols
                score = np.where(letters > 0, np.clip(1 - ordered[0] / np.maximum(second, 1), 0, 1), 0.0)
            pred = [parser.langs[b] if letters[i] and parser.langs else UNKNOWN for i, b in enumerate(best)]
            rate = np.where(letters > 0, phrases.min(axis=0) / np.maximum(symbols, 1), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(score), pa.array(rate)], ["doc_id", "lang_pred", "score", "phrase_rate"])


def held_out(doc_id: Column) -> Column:
    """Documents that nothing is learned from: crc32 of the id as text leaves 2 modulo 4. A null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def identify(docs: DataFrame, training: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, phrase_rate) of every document, from its whole text.

    Each language's automaton holds all substrings of its sample. A text is parsed greedily into the longest phrases
    that the sample holds; the fewer phrases per symbol, the lower the cross entropy. The language needing fewest
    wins, ties go to the first label by code point; score is 1 - phrases / phrases of the runner-up. Letters are
    lower-cased, other characters separate. Null text, text without letters, or a table without usable labels: `und`
    with score 0. Labels of held-out documents are never read. Long texts are parsed in pieces side by side, with the
    phrases of one pass. Rows that repeat get equal results; columns besides doc_id, text and lang are ignored, whatever
    their names; an empty table gives an empty result.
    """
    if training is None:
        training = training_text(docs.filter(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", "text").mapInArrow(tidy(lambda it: _score(it, training), models=True), f"doc_id {kind}, lang_pred string, score double, phrase_rate double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "phrase_rate")


def keep_identified(docs: DataFrame) -> DataFrame:
    """docs whose predicted language is a learned one and fits; columns as they were, whatever their names.

    Left out are texts that are null or without letters, all texts if no label is usable, and texts that even the best
    language needs more than one phrase for every LEAST_PHRASE symbols of: nearly none of its letters stand together in
    any sample, as in a script that was never learned.
    """
    training = training_text(docs.filter(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    at = docs.columns.index("text")
    small_batches(docs.sparkSession)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            asked = pa.RecordBatch.from_arrays([pa.array(range(batch.num_rows)), batch.column(at)], ["doc_id", "text"])
            for found in _score(iter([asked]), training):
                keep = [p != UNKNOWN and r * LEAST_PHRASE <= 1 for p, r in zip(found.column(1).to_pylist(), found.column(3).to_pylist(), strict=True)]
                yield batch.take(found.column(0).filter(pa.array(keep, pa.bool_())))

    return docs.mapInArrow(tidy(run, models=True), docs.schema)
