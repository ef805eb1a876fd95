"""Words and word n-grams of whole batches of texts as 64-bit hashes, with numpy."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

SPACES = (32, 9, 10, 11, 12, 13)
_BASE = 0x9E3779B97F4A7C15
_FACTORS = [0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3]
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """Finishing steps that spread every bit over all others."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


@lru_cache(maxsize=2)
def _bytes(lower: bool) -> np.ndarray:
    """A random number for each byte; A-Z as a-z where asked."""
    values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
    if lower:
        values[65:91] = values[97:123]
    return values


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    ahead = np.full(n, _BASE, dtype=np.uint64)
    back = np.full(n, pow(_BASE, -1, 1 << 64), dtype=np.uint64)
    ahead[0] = back[0] = 1
    return np.multiply.accumulate(ahead), np.multiply.accumulate(back)


def word_hashes(texts: list[str], lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``hashes, starts, ends, edges``: hash and byte range (within its own text) of each word; words ``edges[i]`` to
    ``edges[i + 1]`` belong to text ``i``. A word is a run without ASCII white space."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    hashes, starts, ends, counts = [], [], [], []
    at, size = 0, 0
    for end in range(1, len(raw) + 1):  # some MB at a time; a longer text goes alone
        size += len(raw[end - 1]) + 1
        if size >= 1 << 20 or end == len(raw):
            _hash_some(raw[at:end], lower, hashes, starts, ends, counts)
            at, size = end, 0
    join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, dtype=kind)
    return (join(hashes, np.uint64), join(starts, np.int64), join(ends, np.int64),
            np.concatenate([[0], np.cumsum(join(counts, np.int64))]).astype(np.int64))


def _hash_some(raw: list[bytes], lower: bool, hashes: list, starts: list, ends: list, counts: list) -> None:
    data = np.frombuffer(b" ".join([*raw, b""]), dtype=np.uint8)
    space = np.isin(data, SPACES)
    before = np.concatenate([[True], space[:-1]])
    first = np.flatnonzero(~space & before)
    last = np.flatnonzero(space & ~before)
    # each byte is mixed with its place in its word before the sum, so the hash is no polynomial in them
    word = np.maximum(np.cumsum(~space & before) - 1, 0)
    place = (np.arange(len(data)) - (first[word] if len(first) else 0)).astype(np.uint64)
    running = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(mix(_bytes(lower)[data] ^ place * np.uint64(_BASE)))])
    hashes.append(mix(running[last] - running[first]))
    sizes = np.array([len(r) + 1 for r in raw], dtype=np.int64)
    begins = np.concatenate([[0], np.cumsum(sizes)])
    edges = np.searchsorted(first, begins)
    own = np.repeat(begins[:-1], np.diff(edges))
    starts.append(first - own)
    ends.append(last - own)
    counts.append(np.diff(edges))


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` words."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    if width <= len(_FACTORS):
        total = np.zeros(n, dtype=np.uint64)
        for k in range(width):
            total += words[k:k + n] * np.uint64(_FACTORS[k])
        return mix(total)
    size = 1 << max(10, int(len(words) + 1).bit_length())
    ahead, back = _powers(size)
    running = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(words * ahead[:len(words)])])
    return mix((running[width:] - running[:-width]) * back[:n])


def shingle_sets(texts: list[str], width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text. With fewer words than ``width``, the whole sequence is the one
    shingle; without words there is none."""
    words, _, _, edges = word_hashes(texts)
    windows = window_hashes(words, width)
    out = []
    for a, b in zip(edges[:-1], edges[1:]):
        if b - a >= width:
            out.append(np.unique(windows[a:b - width + 1]))
        elif b > a:
            total = int(b - a) * _BASE
            for k in range(a, b):
                total += int(words[k]) * _FACTORS[k - a]
            out.append(mix(np.array([total & _MASK], dtype=np.uint64)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out
