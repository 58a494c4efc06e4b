"""Hashes of words, word shingles and byte strings of many texts at a time, with numpy, a block of bytes after another.

A text is its UTF-8 bytes with A-Z in lower case; words are runs without the six ASCII blanks. A word's hash is a
polynomial over its bytes modulo 2^64 with random byte values, mixed (xxHash for words beyond LONG bytes); a shingle's
hash is a mix of its words' hashes. Arrays of eight bytes for each byte are made for BLOCK bytes at a time only, so a
very long text or word takes no more of them than a short one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

#: Odd, so that it has an inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes that are hashed together, and the longest word or string that goes through the polynomial.
BLOCK, LONG = 1 << 18, 1 << 12
_bytes = np.random.default_rng(20_240_131).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_blank = np.zeros(256, bool)
_blank[[9, 10, 11, 12, 13, 32]] = True
_powers = {}


def powers(base: int, n: int) -> np.ndarray:
    """1, base, base^2, ... modulo 2^64; kept, and doubled when longer ones are asked for."""
    held = _powers.get(base)
    if held is None or len(held) < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length())
        held = np.full(size, base, np.uint64)
        held[0] = 1
        _powers[base] = held = np.multiply.accumulate(held)
    return held[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits in which every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def spans_hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each data[start:end]; equal strings have equal hashes wherever they stand."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_bytes[data] * powers(BASE, len(data)), out=total[1:])
    out = mix((total[ends] - total[starts]) * powers(BASE_INVERSE, len(data) + 1)[starts])
    for i in np.flatnonzero(ends - starts > LONG).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]])
    return out


def word_spans(data: np.ndarray, blank: np.ndarray = _blank, cut=None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Starts, ends and hashes of the words of these bytes, block by block; the last byte must be a blank.

    cut(data, starts, ends): where to cut words in two; its place or the word's end.
    """
    at = 0
    while at < len(data):
        stop = min(at + BLOCK, len(data))
        if stop < len(data):  # end behind a blank
            back = blank[data[at:stop]][::-1].argmax()
            if blank[data[stop - 1 - back]]:
                stop -= back
            else:  # a word longer than a block
                first = at
                while not blank[data[stop - 1]]:
                    ahead = blank[data[stop : stop + BLOCK]]
                    stop += int(ahead.argmax()) + 1 if ahead.any() else len(ahead)
                name = xxhash.xxh3_64_intdigest(data[first : stop - 1])
                yield np.array([first]), np.array([stop - 1]), np.array([name], np.uint64)
                at = stop
                continue
        part = data[at:stop]
        edge = np.flatnonzero(np.diff(np.concatenate([[False], ~blank[part]])))
        if len(edge):
            starts, ends = edge[::2], edge[1::2]
            if cut is not None:
                places = cut(part, starts, ends)
                two = places < ends
                starts, ends = np.sort(np.concatenate([starts, places[two]])), np.sort(np.concatenate([ends, places[two]]))
            yield starts + at, ends + at, spans_hashed(part, starts, ends)
        at = stop


def words_hashed(texts: list[str] | list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts in a row, and how many words each text has."""
    raw = [(t.encode() if isinstance(t, str) else t).lower() for t in texts]
    bounds = np.cumsum([0] + [len(x) + 1 for x in raw])
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    del raw
    hashes, counts = [np.empty(0, np.uint64)], np.zeros(len(texts), np.int64)
    for starts, _, names in word_spans(data):
        hashes.append(names)
        low, high = np.searchsorted(bounds, [starts[0], starts[-1]], "right") - 1
        counts[low : high + 1] += np.diff(np.searchsorted(starts, bounds[low : high + 2]))
    return np.concatenate(hashes), counts


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of `size` words of one text, in order; of the whole sequence if it is shorter."""
    if not len(words):
        return words
    if len(words) < size:
        weights = powers(BASE_INVERSE, len(words) + 1)[1:]
        return mix((mix(words + np.uint64(len(words))) * weights).sum(keepdims=True))
    weights = powers(BASE, size + 1)[1:]
    n = len(words) - size + 1
    total = np.zeros(n, np.uint64)
    for i in range(size):
        total += words[i : i + n] * weights[i]
    return mix(total)
