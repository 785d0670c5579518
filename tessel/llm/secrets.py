"""Secret scan: base patterns, and probabilistic automata inferred from labelled credentials that score the rest.

An automaton is inferred for each format by merging compatible states of the prefix tree of its labelled credentials.
Every candidate token is scored by how much likelier the automaton makes it than a model of ordinary tokens does.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import math
import random
import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm._common import discard, small_batches, staged, tidy

#: Fixed patterns of the base kinds, in the order of their ties: pattern, group that counts, least length.
BASE = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII), 2, 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 24),
}
#: The same hex spans at less cost: a maximal run of 24 and more starts where its first 24 do.
_HEX = re.compile(r"[0-9a-f]{24,}")
_ASSIGN_HINT = re.compile(r"[:=]")
#: Characters of candidates, and those among them at which a candidate is also looked at in parts.
ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_.=-"
SEPARATORS = "=/."
LEAST = 6
#: Formats whose credentials are labelled beside those in the texts: public prefixes, and runs as {characters:length}.
#: d digits, h lower-case hexadecimal, a lower case and digits, A letters and digits, b A with _ and -, B A with + and /.
FORMATS = {
    "github": "ghp_{A:36}",
    "gitlab": "glpat-{b:20}",
    "slack": "xoxb-{d:12}-{d:12}-{A:24}",
    "stripe": "sk_live_{A:24}",
    "platform": "sk-{A:48}",
    "google": "AIza{b:35}",
    "npm": "npm_{A:36}",
    "sendgrid": "SG.{b:22}.{b:43}",
    "cloud": "dop_v1_{h:64}",
    "shop": "shpat_{h:32}",
    "storage": "{B:40}",
    "jwt": "eyJ{b:33}.eyJ{b:60}.{b:43}",
}
_RUNS = {"d": ALPHABET[:10], "h": ALPHABET[:16], "a": ALPHABET[:36], "A": ALPHABET[:62], "b": ALPHABET[:62] + "_-", "B": ALPHABET[:62] + "+/"}
#: Examples of each of FORMATS.
EXAMPLES = 200
#: Characters of a kind's labelled credentials up to which the driver counts them; beyond it executors do, with equal results.
LOCAL_CHARS = 1 << 20
#: Bits by which a candidate must be likelier as a credential than as an ordinary token.
PRIOR_BITS = 30.0
#: A character that a state has not seen.
UNSEEN = math.log2(1e-4)
KINDS = (*BASE, "grammar")
_CLASSES = {"digit": "0123456789", "hex": "abcdef", "lower": "ghijklmnopqrstuvwxyz", "HEX": "ABCDEF", "UPPER": "GHIJKLMNOPQRSTUVWXYZ"}
_CLASS = {c: name for name, members in _CLASSES.items() for c in members}
_CODE = np.zeros(129, np.uint8)
_CODE[[ord(c) for c in ALPHABET]] = np.arange(1, len(ALPHABET) + 1)
_CODES = len(ALPHABET) + 1
_DOT = _CODE[ord(".")]
_PART_CODE = _CODE.copy()
_PART_CODE[[ord(c) for c in SEPARATORS]] = 0
#: Characters that are looked at in one go.
SLICE = 1 << 20


def _key(edges: dict[str, int], c: str) -> str:
    """The edge of a node that a character takes: its own, else its class's."""
    return c if c in edges else _CLASS.get(c, c)


def _level(strings: Iterable[str], edges: list[dict[str, int]], level: set[int], at: int) -> Counter:
    """How many strings go on from each node of a level with each character ("": end there), as {(node, character): n}."""
    out: Counter = Counter()
    for s in strings:
        q = 0
        for c in s[:at]:
            q = edges[q].get(_key(edges[q], c), -1)
            if q < 0:
                break
        else:
            if len(s) >= at and q in level:
                out[q, s[at : at + 1]] += 1
    return out


def _parsed(strings: Iterable[str], edges: list[dict[str, int]]) -> Counter:
    """How often whole strings take each edge of an automaton ("": end there); a character without an edge stays."""
    out: Counter = Counter()
    for s in strings:
        q = 0
        for c in s:
            key = _key(edges[q], c)
            out[q, key] += 1
            q = edges[q].get(key, q)
        out[q, ""] += 1
    return out


def _lengths(strings: Iterable[str]) -> Counter:
    return Counter((len(s), "") for s in strings)


class Local:
    """Labelled credentials that the driver holds and counts."""

    def __init__(self, strings: list[str]) -> None:
        self.strings, self.here = strings, [(0, s) for s in strings]

    def lengths(self) -> Counter:
        return _lengths(self.strings)

    def level(self, edges: list[dict[str, int]], level: set[int], at: int) -> Counter:
        """As _level, for levels one after another."""
        if at:
            self.here = [(edges[q][_key(edges[q], s[at - 1])], s) for q, s in self.here if len(s) >= at]
        self.here = [(q, s) for q, s in self.here if q in level]
        return Counter((q, s[at : at + 1]) for q, s in self.here)

    def parsed(self, edges: list[dict[str, int]]) -> Counter:
        return _parsed(self.strings, edges)


class Spread:
    """Labelled credentials of a staged table (s), counted where they are: only sums by node and character travel.

    heads: their first DEPTH + 1 characters, all that a tree looks at, if the driver can hold those; a few very long
    credentials then take no pass a level.
    """

    def __init__(self, table: DataFrame, count: int, heads: list[str] | None = None) -> None:
        self.table, self.count, self.heads = table, count, heads and Local(heads)

    def __len__(self) -> int:
        return self.count

    def _sum(self, tally: Callable[[Iterable[str]], Counter]) -> Counter:
        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out: Counter = Counter()
            for batch in it:
                out.update(tally(batch.column(0).to_pylist()))
            yield pa.RecordBatch.from_pydict({"q": pa.array([q for q, _ in out], pa.int64()), "c": pa.array([c for _, c in out], pa.string()), "n": pa.array(out.values(), pa.int64())})

        sums = self.table.mapInArrow(tidy(run), "q long, c string, n long").groupBy("q", "c").agg(F.sum("n").alias("n"))
        return Counter({(r["q"], r["c"]): r["n"] for r in sums.collect()})

    def lengths(self) -> Counter:
        return self._sum(_lengths)

    def level(self, edges: list[dict[str, int]], level: set[int], at: int) -> Counter:
        return self.heads.level(edges, level, at) if self.heads else self._sum(lambda strings: _level(strings, edges, level, at))

    def parsed(self, edges: list[dict[str, int]]) -> Counter:
        return self._sum(lambda strings: _parsed(strings, edges))


class Grammar:
    """Probabilistic finite automaton by state merging of a prefix tree.

    In the tree a character is an edge of its own where it is frequent among the strings that reach the node, else its
    class is. Two states merge if a Hoeffding bound finds no difference between their stopping and moving frequencies,
    here and below. The tree counts all strings, level by level, and goes on below a node that at least one in RESOLUTION
    of them reaches, down to DEPTH; a node below that is evidence for no difference. Where there are such nodes, all whole
    strings are then parsed by the automaton, so that its frequencies are those of all characters of all strings. Lengths
    have a distribution of their own, from three quarters of the shortest to half as much again as the longest.
    """

    #: Strings at a node, and a character's share of them, from which it is an edge of its own.
    OWN, SHARE = 20, 0.3
    RESOLUTION, DEPTH = 1000, 256

    def __init__(self, strings: list[str] | Spread, alpha: float = 0.05) -> None:
        source = strings if isinstance(strings, Spread) else Local(strings)
        self.seen = {n: k for (n, _), k in source.lengths().items()}
        self.total = sum(self.seen.values())
        self.shortest, self.longest = math.ceil(0.75 * min(self.seen)), int(1.5 * max(self.seen))
        self.count, self.final, self.moves, self.next = [], [], [], []
        level, at, whole = {self._node()}, 0, True
        while level:
            chars = defaultdict(dict)
            for (q, c), n in source.level(self.next, level, at).items():
                chars[q][c] = n
            below = set()
            for q in sorted(level):
                here = self.count[q] = sum(chars[q].values())
                self.final[q] = chars[q].pop("", 0)
                own = {c for c, n in chars[q].items() if c not in _CLASS or (here >= self.OWN and n >= self.SHARE * here)}
                parts: Counter = Counter()
                for c, n in chars[q].items():
                    parts[c if c in own else _CLASS[c]] += n
                for key in sorted(parts):
                    self.moves[q][key] = parts[key]
                    self.next[q][key] = self._node()
                    if at < self.DEPTH and parts[key] * self.RESOLUTION >= self.total:
                        below.add(self.next[q][key])
                    else:
                        whole = False
            level, at = below, at + 1
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self.tree_states = len(self.count)
        self._merge_all()
        if not whole:
            self._recount(source.parsed(self.next))

    def _recount(self, edges: Counter) -> None:
        self.moves, self.final = [{} for _ in self.states], [0 for _ in self.states]
        for (q, key), n in sorted(edges.items()):
            if key:
                self.moves[q][key] = n
            else:
                self.final[q] = n
        self.count = [self.final[q] + sum(self.moves[q].values()) for q in self.states]
        self.next = [{key: self.next[q].get(key, q) for key in self.moves[q]} for q in self.states]

    def of_length(self, n: int) -> float:
        """log2 probability of a length; minus infinity outside the lengths of the format."""
        if not self.shortest <= n <= self.longest:
            return -math.inf
        width = self.longest - self.shortest + 1
        rare = 0.1 * min(1, 256 / width)  # one very long string takes no weight from the others
        return math.log2((self.seen.get(n, 0) + rare) / (self.total + rare * width))

    def _node(self) -> int:
        self.count.append(0)
        self.final.append(0)
        self.moves.append({})
        self.next.append({})
        return len(self.count) - 1

    def _differ(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        return bool(n1 and n2) and abs(f1 / n1 - f2 / n2) > self.bound * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def _compatible(self, a: int, b: int) -> bool:
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            if self._differ(self.final[a], self.count[a], self.final[b], self.count[b]):
                return False
            for c in {*self.moves[a], *self.moves[b]}:
                if self._differ(self.moves[a].get(c, 0), self.count[a], self.moves[b].get(c, 0), self.count[b]):
                    return False
            stack += [(self.next[a][c], self.next[b][c]) for c in self.next[a] if c in self.next[b]]
        return True

    def _fold(self, a: int, b: int) -> None:
        """Adds the subtree of b into a."""
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            self.count[a] += self.count[b]
            self.final[a] += self.final[b]
            for c, n in self.moves[b].items():
                self.moves[a][c] = self.moves[a].get(c, 0) + n
            for c, t in self.next[b].items():
                if c in self.next[a]:
                    stack.append((self.next[a][c], t))
                else:
                    self.next[a][c] = t

    def _merge_all(self) -> None:
        """Blue states by falling count; each merges into the latest red state that it is compatible with, or turns red."""
        red, blue = [0], [(0, c) for c in self.next[0]]
        while blue:
            blue.sort(key=lambda x: (-self.count[self.next[x[0]][x[1]]], x))
            p, c = blue.pop(0)
            q = self.next[p][c]
            if q in red:
                continue
            for r in reversed(red):
                if self._compatible(r, q):
                    self.next[p][c] = r
                    self._fold(r, q)
                    blue = sorted({(r, x) for r in red for x, t in self.next[r].items() if t not in red})
                    break
            else:
                red.append(q)
                blue += [(q, x) for x in self.next[q]]
        place = {q: i for i, q in enumerate(red)}  # only red states are left
        self.count, self.final, self.moves = ([x[q] for q in red] for x in (self.count, self.final, self.moves))
        self.next = [{c: place[t] for c, t in self.next[q].items()} for q in red]
        self.states = range(len(red))

    def _move(self, q: int, c: str) -> tuple[float, int]:
        """(log2 probability, next state) of a character."""
        if n := self.moves[q].get(c, 0):
            return math.log2(n / self.count[q]), self.next[q][c]
        name = _CLASS.get(c)
        if name and (n := self.moves[q].get(name, 0)):
            return math.log2(n / self.count[q] / len(_CLASSES[name])), self.next[q][name]
        return UNSEEN, q

    def likelihood(self, s: str) -> float:
        """log2 probability of s given that it has the format; minus infinity outside the lengths of the format."""
        total, q = self.of_length(len(s)), 0
        for c in s if total > -math.inf else "":
            p, q = self._move(q, c)
            total += p
        return total

    def best(self) -> tuple[np.ndarray, np.ndarray]:
        """Upper bounds of log2 probabilities: of each first character, and of each second one after a first."""
        first, pair = np.full(len(ALPHABET) + 1, UNSEEN), np.full((len(ALPHABET) + 1,) * 2, UNSEEN)
        rows = {q: np.array([UNSEEN, *(self._move(q, c)[0] for c in ALPHABET)]) for q in self.states}
        first = np.maximum(first, rows[0])
        for q in self.states:
            for i, c in enumerate(ALPHABET, 1):
                pair[i] = np.maximum(pair[i], rows[self._move(q, c)[1]])
        return first, pair


def token_counts(tokens: list[str]) -> np.ndarray:
    """Counts of tokens' first characters, of their pairs of neighbours and of their lengths up to 256, one after another."""
    codes = _CODE[np.frombuffer("\n".join(["", *tokens, ""]).encode("ascii"), np.uint8)].astype(np.int32)
    edge = np.flatnonzero(codes == 0)
    start = edge[:-1] + 1
    pair = codes[:-1] * _CODES + codes[1:]
    pair = pair[(codes[:-1] > 0) & (codes[1:] > 0)]
    parts = (codes[start], _CODES), (pair, _CODES**2), (np.minimum(edge[1:] - start, 256), 257)
    return np.concatenate([np.bincount(x, minlength=n) for x, n in parts])


class Ordinary:
    """What tokens are like that are no credentials: a chain of characters and a distribution of lengths.

    background: sums of token_counts, as (place, count) of those above 0.
    """

    def __init__(self, tokens: list[str], background: list[tuple[int, int]]) -> None:
        counts = token_counts(tokens).astype(float)
        for place, n in background:
            counts[place] += n
        first, pair, lengths = np.split(counts, [_CODES, _CODES + _CODES**2])
        pair, lengths = pair.reshape(_CODES, _CODES), lengths + 0.5
        alone = pair.sum(axis=0) + first + 0.5  # what a character falls back on where it is rare after another
        alone /= alone.sum()
        self.first = np.log2((first + 3 * alone) / (first.sum() + 3))
        self.pair = np.log2((pair + 3 * alone) / (pair.sum(axis=1, keepdims=True) + 3))
        self.lengths = np.log2(lengths / lengths.sum())

    def likelihood(self, s: str) -> float:
        codes = _CODE[np.frombuffer(s.encode("ascii"), np.uint8)]
        return float(self.first[codes[0]] + self.pair[codes[:-1], codes[1:]].sum() + self.lengths[min(len(s), 256)])


def format_examples(n: int = EXAMPLES) -> dict[str, list[str]]:
    """n credentials of each of FORMATS, the same in every run."""
    out = {}
    for kind, form in FORMATS.items():
        rnd = random.Random(kind)
        out[kind] = [re.sub(r"\{(\w):(\d+)\}", lambda m: "".join(rnd.choices(_RUNS[m[1]], k=int(m[2]))), form) for _ in range(n)]
    return out


def ordinary_examples(n: int = 150) -> list[str]:
    """Tokens with digits and marks that are no credentials: dates, versions, numbers, addresses, names of files and things."""
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice(("ba", "con", "di", "er", "fil", "ing", "mo", "per", "re", "sta", "tion", "vi")) for _ in range(rnd.randint(1, 4)))
    digits = lambda k: "".join(rnd.choices("0123456789", k=k))
    makers = (
        lambda: f"20{digits(2)}-{digits(2)}-{digits(2)}", lambda: f"{digits(1)}.{digits(2)}.{digits(1)}-beta", lambda: digits(rnd.randint(6, 20)), lambda: f"{digits(3)}.{digits(3)}.{digits(2)}.{digits(3)}",
        lambda: f"IMG_{digits(8)}_{digits(6)}.jpg", lambda: f"{word()}-{digits(rnd.randint(1, 16))}", lambda: f"{word()}_{word()}_{word()}", lambda: word().capitalize() + word().capitalize() + word().capitalize(),
        lambda: f"{word()}/{word()}/{word()}.html", lambda: f"www.{word()}.example.com", lambda: f"{word()}-{word()}-{word()}", lambda: word().upper() + word().upper(), lambda: f"{word()}={digits(4)}", lambda: str(uuid.UUID(int=rnd.getrandbits(128))), lambda: f"-----{word()}-----",
    )
    return [t for make in makers for t in (make() for _ in range(n)) if len(t) >= LEAST]


class Scanner:
    """Spans of a text: base kinds by pattern, kind `grammar` by likelihood under the automata inferred for each format.

    own: credentials of a corpus by kind, which are all learned. known: made examples by format; a fifth of them, and half
    of ordinary_examples(), are held out of the fit. A threshold is PRIOR_BITS, or more if an ordinary token held out
    scores more; `recall` is the share of a format's held-out credentials that reach it. Background tokens of a corpus
    (counts as of Ordinary) may hide credentials, so they only teach what is ordinary.
    """

    def __init__(self, known: dict[str, list[str]], background: list[tuple[int, int]], own: dict[str, list[str] | Spread] | None = None) -> None:
        examples = sorted(set(ordinary_examples()), key=lambda t: hashlib.md5(t.encode()).digest())
        self.ordinary = Ordinary(examples[::2], background)
        self.grammars: dict[str, tuple[Grammar, float]] = {}
        self.recall: dict[str, float] = {}
        for kind, strings in [*(own or {}).items(), *known.items()]:
            if len(strings) < 10:
                continue
            held: list[str] = []
            if kind in known:
                strings = sorted(set(strings), key=lambda t: hashlib.md5(t.encode()).digest())
                held, strings = strings[: len(strings) // 5], strings[len(strings) // 5 :]
            grammar = Grammar(strings)
            bits = lambda s: grammar.likelihood(s) - self.ordinary.likelihood(s)  # noqa: B023, E731
            least = max(PRIOR_BITS, max(map(bits, examples[1::2])) + 1e-6)
            self.grammars[kind] = grammar, least
            if held:
                self.recall[kind] = sum(bits(s) >= least for s in held) / len(held)
        if self.grammars:
            first, pair = (np.max(x, axis=0) for x in zip(*(g.best() for g, _ in self.grammars.values()), strict=True))
            self.first, self.pair = (first - self.ordinary.first), (pair - self.ordinary.pair)
            self.least = min(x for _, x in self.grammars.values())
            of_length = np.full(257, -np.inf)
            for g, _ in self.grammars.values():
                for n in {*range(257), *g.seen, max(256, g.shortest), g.longest}:
                    of_length[min(n, 256)] = max(of_length[min(n, 256)], g.of_length(n))
            self.length = of_length - self.ordinary.lengths

    def bits(self, s: str) -> float:
        """By how many bits s passes the threshold of the format that it fits best."""
        if not self.grammars:
            return -math.inf
        ordinary = self.ordinary.likelihood(s)
        return max(g.likelihood(s) - ordinary - least for g, least in self.grammars.values())

    def _likely(self, codes: np.ndarray) -> Iterator[tuple[int, int]]:
        """Runs of candidate characters whose upper bound reaches the least threshold."""
        inside = codes > 0
        edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        start, end = edge[::2], edge[1::2]
        solid = np.maximum.accumulate(np.where(inside & (codes != _DOT), np.arange(len(codes)), -1))
        end = solid[end - 1] + 1  # full stops at the end are the sentence's
        long = end - start >= LEAST
        start, end = start[long], end[long]
        if not len(start):
            return
        step = np.zeros(len(codes))
        step[1:] = self.pair[codes[:-1], codes[1:]]
        step[start] = 0
        total = np.cumsum(step)
        bound = self.first[codes[start]] + total[end - 1] - total[start] + self.length[np.minimum(end - start, 256)]
        for i in np.flatnonzero(bound >= self.least - 1e-3):
            yield int(start[i]), int(end[i])

    def candidates(self, text: str) -> Iterator[tuple[int, int]]:
        """Places of tokens that may reach a threshold: maximal runs of ALPHABET, and their parts between SEPARATORS."""
        at = 0
        while at < len(text):
            stop = min(len(text), at + SLICE)
            while stop < len(text) and (ord(text[stop - 1]) >= 128 or _CODE[ord(text[stop - 1])]):
                stop += 1  # no token is cut
            codes = np.minimum(np.frombuffer(text[at:stop].encode("utf-32-le", "surrogatepass"), np.uint32), 128)
            found = {*self._likely(_CODE[codes]), *self._likely(_PART_CODE[codes])}
            yield from ((at + s, at + e) for s, e in sorted(found))
            at = stop

    def spans(self, text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
        """(base spans, further spans) as (start, end, kind)."""
        base: list[tuple[int, int, str]] = []
        if _ASSIGN_HINT.search(text):
            pattern, group, least = BASE["assign"]
            base += [(m.start(), m.end(), "assign") for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
        if "AKIA" in text:
            base += [(m.start(), m.end(), "access") for m in BASE["access"][0].finditer(text) if m.end() - m.start() >= 20]
        base += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
        more: list[tuple[int, int, str]] = []
        if self.grammars:
            scored = [(-self.bits(text[s:e]), s, e) for s, e in set(self.candidates(text)) if not any(x < e and s < y for x, y, _ in base)]
            for bits, s, e in sorted(scored):
                if bits <= 0 and not any(x < e and s < y for x, y, _ in more):
                    more.append((s, e, "grammar"))
        order = KINDS.index
        return sorted(base, key=lambda x: (x[0], order(x[2]))), sorted(more)


_RUN = re.compile(r"[A-Za-z0-9+/_.=-]{6,}")


def _learned(text: str) -> set[tuple[str, str]]:
    """(base kind, credential) of every base span of a text, and ("", token) of every run of ALPHABET that meets none."""
    out, spans = set(), []
    for kind, (pattern, group, least) in BASE.items():
        if kind == "hex":
            pattern, group = _HEX, 0
        if kind == "assign" and not _ASSIGN_HINT.search(text) or kind == "access" and "AKIA" not in text:
            continue
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                out.add((kind, m[group]))
                spans.append(m.span())
    if not spans:
        return out | {("", s) for s in _RUN.findall(text)}
    spans.sort()
    reach = [*itertools.accumulate((e for _, e in spans), max)]  # the spans up to one end there
    for m in _RUN.finditer(text):
        i = bisect.bisect_left(spans, (m.end(),))  # spans that start before the run ends
        if not i or reach[i - 1] <= m.start():
            out.add(("", m[0]))
    return out


def labelled(docs: DataFrame) -> tuple[dict[str, list[str] | Spread], list[tuple[int, int]]]:
    """All distinct labelled credentials of docs by base kind, and the counts (as of Ordinary) of all background tokens.

    A credential is what a base pattern captures, background tokens are the distinct runs of candidate characters that
    meet no base span; both come from every whole text, read in one pass. A kind's credentials are a list up to
    LOCAL_CHARS, else a Spread, whose table the caller discards.
    """
    spark = docs.sparkSession
    small_batches(spark)

    def found(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows = set().union(*(_learned(t) for t in batch.column(0).to_pylist() if t))
            yield pa.RecordBatch.from_pydict({"k": pa.array([k for k, _ in rows], pa.string()), "s": pa.array([s for _, s in rows], pa.string())})

    def counted(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_CODES + _CODES**2 + 257, np.int64)
        for batch in it:
            total += token_counts(batch.column(0).to_pylist())
        place = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"place": pa.array(place, pa.int64()), "n": pa.array(total[place], pa.int64())})

    table = staged(docs.select("text").mapInArrow(tidy(found), "k string, s string").distinct(), "labelled")
    sums = table.filter("k = ''").select("s").mapInArrow(tidy(counted), "place long, n long").groupBy("place").agg(F.sum("n").alias("n"))
    background = sorted((r["place"], r["n"]) for r in sums.collect())
    size, head = F.length("s"), F.substring("s", 1, Grammar.DEPTH + 1)
    sizes = table.filter("k <> ''").groupBy("k").agg(F.count("*").alias("n"), F.sum(size).alias("chars"), F.sum(F.length(head)).alias("heads")).collect()
    own: dict[str, list[str] | Spread] = {k: [] for k in BASE}
    for r in sizes:
        kind = table.filter(F.col("k") == r["k"])
        heads = [x[0] for x in kind.select(head).collect()] if r["heads"] <= LOCAL_CHARS < r["chars"] else None
        if r["chars"] <= LOCAL_CHARS:
            own[r["k"]] = [x["s"] for x in kind.collect()]
        else:
            own[r["k"]] = Spread(staged(kind.select("s"), "kind"), r["n"], heads)
    discard(table)
    return own, background


def fitted(docs: DataFrame, known: dict[str, list[str]] | None = None) -> Scanner:
    """Scanner from the credentials that docs label and from known ones by format (FORMATS' by default)."""
    own, background = labelled(docs)
    scanner = Scanner(format_examples() if known is None else known, background, own)
    discard(*(x.table for x in own.values() if isinstance(x, Spread)))
    return scanner


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def scan(docs: DataFrame, known: dict[str, list[str]] | None = None) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_grammar) of every document, from its whole text.

    Spans are kind:start:end in code points, end exclusive, by start, then kind as listed in KINDS. Null text counts
    as empty: no span, the hash of nothing. Kind `grammar` adds spans that meet no base span; of candidates that meet
    each other the one that passes its threshold by most bits is taken, ties to the first. Long texts are read in
    slices that cut no token. Rows that repeat get equal results; columns besides doc_id and text are ignored, whatever
    their names; an empty table gives an empty result.
    """
    scanner = fitted(docs, known)
    kind = docs.schema["doc_id"].dataType.simpleString()
    small_batches(docs.sparkSession)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            out = defaultdict(list)
            for t in batch.column(1).to_pylist():
                base, more = scanner.spans(t or "")
                for k in BASE:
                    out[f"n_{k}"].append(sum(x[2] == k for x in base))
                out["base_sha256"].append(hashlib.sha256(_joined(base).encode()).hexdigest())
                out["spans"].append(_joined(sorted(base + more, key=lambda x: (x[0], KINDS.index(x[2])))))
                out["n_grammar"].append(len(more))
            cols = {k: pa.array(v, pa.string() if k in ("base_sha256", "spans") else pa.int64()) for k, v in out.items()}
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), *cols.values()], ["doc_id", *cols])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_grammar long")


def redact(docs: DataFrame, mark: str = "[SECRET]", known: dict[str, list[str]] | None = None) -> DataFrame:
    """docs with every span found replaced by `mark` in text, n_chars set anew where text changed.

    No row is left out and no other column changes, whatever its name; null and empty texts stay as they are.
    """
    scanner = fitted(docs, known)
    small_batches(docs.sparkSession)
    at = docs.columns.index("text")
    size = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            texts = batch.column(at).to_pylist()
            sizes = batch.column(size).to_pylist() if size is not None else []
            for i, t in enumerate(texts):
                if not t or not (spans := sorted(sum(scanner.spans(t), []))):
                    continue
                done, out = 0, []
                for s, e, _ in spans:
                    if s >= done:
                        out += [t[done:s], mark]
                    done = max(done, e)
                texts[i] = "".join([*out, t[done:]])
                if sizes:
                    sizes[i] = len(texts[i])
            cols = list(batch.columns)
            cols[at] = pa.array(texts, batch.schema.field(at).type)
            if size is not None:
                cols[size] = pa.array(sizes, batch.schema.field(size).type)
            yield pa.RecordBatch.from_arrays(cols, schema=batch.schema)

    return docs.mapInArrow(tidy(run), docs.schema)
