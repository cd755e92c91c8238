"""Hashes of word shingles and MinHash signatures, many texts at a time in numpy.

Words are runs of bytes other than the six ASCII blanks, with A-Z in lower case. A
shingle is ``size`` successive words; a text of fewer words is one shingle as a whole.
Hashes have 64 bits and depend on nothing but the words.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

#: Bytes of text that are hashed at once; keeps the arrays in a core's cache.
CHUNK_BYTES = 1 << 19

_BLANKS = b" \t\n\x0b\x0c\r"
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """A permutation of the 64-bit numbers that spreads every bit (the splitmix64 finisher)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _series(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * _MULTIPLIER + np.uint64(seed))


_BYTE = _series(256, 1)
_IS_BLANK = np.zeros(256, dtype=bool)
_IS_BLANK[list(_BLANKS)] = True
_BYTE[_IS_BLANK] = 0
_PLACE = _series(64, 2) | np.uint64(1)


def _places(n: int) -> np.ndarray:
    """Multipliers of the first n bytes of a word."""
    global _PLACE
    if n > len(_PLACE):
        _PLACE = _series(max(n, 2 * len(_PLACE)), 2) | np.uint64(1)
    return _PLACE


def words(texts: Sequence[bytes], prefix: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and how many each text has.

    With ``prefix``, hashes of the words' first bytes, that many at most.
    """
    data = b" ".join(texts).translate(_LOWER)
    a = np.frombuffer(data, dtype=np.uint8)
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    first = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))  # where each text begins
    blank = _IS_BLANK[a]
    begins = np.flatnonzero(~blank & np.concatenate(([True], blank[:-1])))
    if not len(begins):
        return np.empty(0, dtype=np.uint64), np.zeros(len(texts), dtype=np.int64)
    counts = np.diff(np.append(np.searchsorted(begins, first), len(begins)))
    a = a[begins[0] :]
    starts = begins - begins[0]
    sizes = np.diff(np.append(starts, len(a)))
    place = np.arange(len(a), dtype=np.int64) - np.repeat(starts, sizes)
    place[blank[begins[0] :]] = 0
    values = _BYTE[a] * _places(int(place.max()) + 1)[place]
    if prefix is not None:
        values[place >= prefix] = 0
    return mix(np.add.reduceat(values, starts)), counts


def shingles(texts: Sequence[bytes], size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles in order, repeats included, and how many each text has."""
    word, counts = words(texts)
    ends = np.cumsum(counts)
    n = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    if not len(word):
        return word, n
    rolled = np.zeros(max(len(word) - size + 1, 0), dtype=np.uint64)
    for i in range(size):
        rolled = (rolled + word[i : len(word) - size + 1 + i]) * _MULTIPLIER
    rolled = mix(rolled)
    within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    at = np.repeat(ends - counts, n) + within
    short = np.repeat((counts > 0) & (counts < size), n)
    out = np.empty(len(at), dtype=np.uint64)
    out[~short] = rolled[at[~short]]
    for i in np.flatnonzero((counts > 0) & (counts < size)):  # texts shorter than a shingle
        h = np.uint64(counts[i])
        with np.errstate(over="ignore"):
            for w in word[ends[i] - counts[i] : ends[i]]:
                h = (h + w) * _MULTIPLIER
        out[int(n[:i].sum())] = mix(np.array([h ^ np.uint64(0xA5A5)], dtype=np.uint64))[0]
    return out, n


def chunks(texts: Sequence[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    """Texts as bytes, in runs of about ``CHUNK_BYTES``, with the place of each run's first."""
    run: list[bytes] = []
    begin = total = 0
    for i, text in enumerate(texts):
        data = (text or "").encode("utf-8", "surrogatepass")
        if run and total + len(data) > CHUNK_BYTES:
            yield begin, run
            run, begin, total = [], i, 0
        run.append(data)
        total += len(data)
    if run:
        yield begin, run


def signatures(hashes: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
    """MinHash signatures (texts x size, unsigned 32 bits) of texts that all have shingles."""
    out = np.empty((len(n), size), dtype=np.uint32)
    starts = np.cumsum(n) - n
    for j, factor in enumerate(_series(size, 3) | np.uint64(1)):
        out[:, j] = np.minimum.reduceat(((hashes * factor) >> np.uint64(32)).astype(np.uint32), starts)
    return out
