"""Vectorised word tables: words of many texts at once, as 64-bit hashes in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_MIX = np.random.RandomState(20240229).randint(0, 2**63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_K = np.uint64(0x9E3779B97F4A7C15)
_POW = np.ones(4096, np.uint64)
with np.errstate(over="ignore"):
    _POW[1:] = np.cumprod(np.full(4095, 0x5851F42D4C957F2D, np.uint64), dtype=np.uint64)
#: Bytes of text that are hashed at once; a few arrays of eight times the size are held meanwhile.
BLOCK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def _words(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word of raw."""
    b = np.frombuffer(raw, np.uint8)
    word = ~_SPACE[b]
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    if len(b) and word[0]:
        edge = np.concatenate(([0], edge))
    starts = edge[::2]
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    at = np.flatnonzero(word)
    ends = edge[1::2] if len(edge) % 2 == 0 else np.append(edge[1::2], len(b))
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    place = np.arange(len(at)) - np.repeat(first, lengths)
    powers = _POW[place & 4095]
    if (far := place >> 12).any():  # words of over 4096 bytes: another factor for each further 4096
        powers = powers * mix(far.astype(np.uint64) + _K)
    sums = np.add.reduceat(_MIX[b[at]] * powers, first)
    return mix(sums + lengths.astype(np.uint64) * _K), starts


def _slices(raw: bytes) -> Iterator[bytes]:
    """raw in pieces of about BLOCK bytes, cut before white space."""
    at = 0
    while at < len(raw):
        end = at + BLOCK
        while end < len(raw) and raw[end] not in b" \t\n\r\x0b\x0c":
            end += 1
        yield raw[at:end]
        at = end


def word_hashes(raws: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
    """(index, hashes of the words) of every text, in order; words are runs without ASCII white space.

    Short texts are hashed together, long ones in slices, so memory stays near BLOCK bytes times about fifty.
    """
    with np.errstate(over="ignore"):
        i = 0
        while i < len(raws):
            if len(raws[i]) > BLOCK:
                yield i, np.concatenate([_words(s)[0] for s in _slices(raws[i])])
                i += 1
                continue
            j, total = i, 0
            while j < len(raws) and total + len(raws[j]) <= BLOCK:
                total += len(raws[j]) + 1
                j += 1
            j = max(j, i + 1)
            hashes, starts = _words(b" ".join(raws[i:j]))
            begins = np.cumsum([0, *(len(r) + 1 for r in raws[i:j])])
            cut = np.searchsorted(starts, begins)
            for k in range(i, j):
                yield k, hashes[cut[k - i] : cut[k - i + 1]]
            i = j


def shingle_set(words: np.ndarray, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; of the whole sequence if it has fewer words; empty without words."""
    if not len(words):
        return words
    with np.errstate(over="ignore"):
        n = max(1, len(words) - k + 1)
        h = np.full(n, np.uint64(min(k, len(words))))
        for i in range(min(k, len(words))):
            h = mix(h * _K + words[i : i + n])
    return np.unique(h)


def lower_ascii(text: str | None) -> bytes:
    """UTF-8 of text with A-Z lower-cased and nothing else; unpaired surrogates become '?'."""
    return (text or "").encode("utf-8", "replace").lower()
