"""Word hashes of whole texts, by NumPy over the UTF-8 bytes of many texts at once.

A word is a run of word bytes; A-Z count as a-z. A word's hash sums a random 64-bit number for each (place in the word,
byte) and is mixed with its length. The numbers come from a fixed seed, so hashes agree on every machine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes taken at once: arrays of about 40 bytes for each byte of text live at the same time.
CHUNK_BYTES = 1 << 20

_PLACES = 64
_TABLE = np.random.default_rng(20_011).integers(1, 1 << 63, size=(_PLACES, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLDED = np.arange(256)
_FOLDED[ord("A") : ord("Z") + 1] += 32
_TABLE_FOLDED = np.ascontiguousarray(_TABLE[:, _FOLDED]).ravel()
_TABLE_EXACT = np.ascontiguousarray(_TABLE).ravel()
_STEPS = np.random.default_rng(20_012).integers(1, 1 << 63, size=64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

#: ``[^\x20\x09-\x0D]+``
NOT_BLANK = np.ones(256, bool)
NOT_BLANK[[0x20, *range(0x09, 0x0E)]] = False
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` on lower-cased text
LETTERS_DIGITS = np.zeros(256, bool)
LETTERS_DIGITS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of SplitMix64)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: Kinds of a byte: 0 letter, 1 digit, 2 from 0x80, 3 end of a sentence, 4 other
_KIND = np.full(256, 4)
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = 0
_KIND[0x30:0x3A] = 1
_KIND[0x80:] = 2
_KIND[list(b".!?")] = 3
SHAPES = 5 * 5 * 3


def _shapes(buffer: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A number below SHAPES for the kinds of a word's first and last byte and its length."""
    return (_KIND[buffer[starts]] * 5 + _KIND[buffer[starts + lengths - 1]]) * 3 + np.digitize(lengths, [4, 8])


def _hashed(buffer: np.ndarray, word_bytes: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, hash, shape) of each word in a buffer."""
    inside = word_bytes[buffer]
    edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return starts, np.empty(0, np.uint64), starts
    lengths = ends - starts
    first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    place = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    index = (place % _PLACES) * 256 + buffer[inside]
    value = table[index]
    if lengths.max() > _PLACES:
        value = value * (2 * (place // _PLACES) + 1).astype(np.uint64)
    return starts, mixed(np.add.reduceat(value, first) + lengths.astype(np.uint64)), _shapes(buffer, starts, lengths)


def _pieces(texts: list[bytes | None], word_bytes: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(text number, bytes): long texts are cut in front of a non-word byte, so no word is cut."""
    for i, text in enumerate(texts):
        if not text:
            continue
        if len(text) <= CHUNK_BYTES:
            yield i, text
            continue
        at, view = 0, np.frombuffer(text, np.uint8)
        while at < len(text):
            end = min(len(text), at + CHUNK_BYTES)
            while end < len(text) and word_bytes[view[end]]:
                ahead = word_bytes[view[end : end + CHUNK_BYTES]]
                end += int(np.argmin(ahead)) if not ahead.all() else len(ahead)
            yield i, text[at:end]
            at = end


def word_hashes(texts: list[bytes | None], word_bytes: np.ndarray = NOT_BLANK, *, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and offsets: text i has ``hashes[offsets[i]:offsets[i + 1]]``. None has no words."""
    return _words(texts, word_bytes, fold)[:2]


def word_shapes(texts: list[bytes | None], word_bytes: np.ndarray = NOT_BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``word_hashes``, and the shape of each word."""
    return _words(texts, word_bytes, True)


def _words(texts: list[bytes | None], word_bytes: np.ndarray, fold: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    table = _TABLE_FOLDED if fold else _TABLE_EXACT
    counts = np.zeros(len(texts) + 1, np.int64)
    parts: list[np.ndarray] = []
    shapes: list[np.ndarray] = []
    batch: list[tuple[int, bytes]] = []

    def flush() -> None:
        if not batch:
            return
        buffer = np.frombuffer(b"\n".join(x for _, x in batch), np.uint8)
        starts, hashes, kinds = _hashed(buffer, word_bytes, table)
        bounds = np.cumsum([len(x) + 1 for _, x in batch])
        np.add.at(counts, np.array([i for i, _ in batch]) + 1, np.diff(np.searchsorted(starts, bounds), prepend=0))
        parts.append(hashes)
        shapes.append(kinds)
        batch.clear()

    size = 0
    for i, piece in _pieces(texts, word_bytes):
        if size + len(piece) > CHUNK_BYTES:
            flush()
            size = 0
        batch.append((i, piece))
        size += len(piece) + 1
    flush()
    joined = [np.concatenate(x) if x else np.empty(0, kind) for x, kind in ((parts, np.uint64), (shapes, np.int64))]
    return joined[0], np.cumsum(counts), joined[1]


def grams(hashes: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """Hash of each run of k words, in order; empty if there are fewer."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.full(n, np.uint64((k * 0x9E3779B97F4A7C15 + salt) & (2**64 - 1)))
    for j in range(k):
        total += mixed(hashes[j : j + n] * _STEPS[j % 64] + np.uint64(j))
    return mixed(total)


def shingle_sets(texts: list[bytes | None], k: int = 5) -> list[np.ndarray]:
    """Sorted distinct k-word shingles of each text; with fewer words the whole sequence is one; without words none."""
    hashes, offsets = word_hashes(texts)
    rolled = grams(hashes, k)
    out = []
    for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        n = hi - lo
        out.append(np.unique(rolled[lo : hi - k + 1]) if n >= k else grams(hashes[lo:hi], n) if n else hashes[:0])
    return out


def set_key(items: np.ndarray) -> bytes:
    """16 bytes that stand for a set of hashes."""
    with np.errstate(over="ignore"):
        parts = (mixed(items + np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64), mixed(items * _STEPS[7] + np.uint64(len(items))).sum(dtype=np.uint64))
    return mixed(np.array(parts, np.uint64)).tobytes()
