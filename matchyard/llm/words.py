"""Words and shingles of many documents at once, as 64-bit hashes in numpy arrays."""

from __future__ import annotations

import numpy as np

SEGMENT = 1 << 18
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INVERSE = np.uint64(pow(int(_P), -1, 2**64))
_powers: list[np.ndarray] = []

#: ASCII white space as the corpus contracts state it: space and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2^64, for a segment."""
    if not _powers:
        for p in (_P, _P_INVERSE):
            x = np.full(SEGMENT + 1, p, np.uint64)
            x[0] = 1
            _powers.append(np.multiply.accumulate(x))
    return _powers[0], _powers[1]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each byte span; spans are in order and don't overlap."""
    up, down = powers()
    out = np.empty(len(starts), np.uint64)
    first = 0
    while first < len(starts):
        base = int(starts[first])
        after = int(np.searchsorted(ends, base + SEGMENT, "right"))
        if after <= first:  # one span longer than a segment: its pieces' hashes are combined
            h = np.uint64(0)
            for at in range(base, int(ends[first]), SEGMENT):
                part = data[at : min(at + SEGMENT, int(ends[first]))]
                h = mix(np.array([h], np.uint64))[0] ^ np.sum(_BYTE[part] * up[: len(part)], dtype=np.uint64)
            out[first] = h
            first += 1
            continue
        part = data[base : int(ends[after - 1])]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE[part] * up[: len(part)], out=sums[1:])
        s, e = starts[first:after] - base, ends[first:after] - base
        out[first:after] = (sums[e] - sums[s]) * down[s]
        first = after
    return mix(out ^ ((ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def word_spans(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all documents, and each document's number of words before (one more entry)."""
    inside = ~space[data]
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | cut[1:-1]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:] | cut[1:-1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words, A-Z lower-cased, and each document's first word."""
    data = LOWER[data]
    starts, ends, first = word_spans(data, offsets)
    return span_hashes(data, starts, ends), first


def shingle_sets(words: np.ndarray, first: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document, sorted by hash, and where each document's begin.

    A document with fewer words than `size` has one shingle, all its words; one without words has none."""
    counts = np.diff(first)
    total = len(words)
    rolled = np.zeros(total, np.uint64)
    for j in range(size):
        rolled[: total - j] += words[j:] * powers()[0][j]
    owner = np.repeat(np.arange(len(counts)), counts)
    left = np.repeat(first[1:], counts) - np.arange(total)  # words from here to the document's end
    keep = left >= size
    hashes, owners = [mix(rolled[keep])], [owner[keep]]
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        for j in range(size - 1):
            has = counts[short] > j
            whole[has] += words[first[short[has]] + j] * powers()[0][j]
        hashes.append(mix(whole ^ np.uint64(0x5851F42D4C957F2D) * counts[short].astype(np.uint64)))
        owners.append(short)
    h, o = np.concatenate(hashes), np.concatenate(owners)
    order = np.lexsort((h, o))
    h, o = h[order], o[order]
    if len(h):
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
        h, o = h[fresh], o[fresh]
    return h, np.searchsorted(o, np.arange(len(counts) + 1))
