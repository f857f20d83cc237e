"""Word shingles of many texts at once, as sorted arrays of 64-bit hashes, with NumPy only."""

from __future__ import annotations

import hashlib

import numpy as np

WIDTH = 5
_BASE, _UNBASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POW: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_TURN = [np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


#: Bytes whose words are hashed at once, so that tables of powers stay short whatever the length of a text (a longer word is one block).
BLOCK = 1 << 18


def _powers(n: int) -> list[np.ndarray]:
    if len(_POW[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, b in enumerate((_BASE, _UNBASE)):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            _POW[k] = np.multiply.accumulate(steps)
    return _POW


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts in order, and where each text's words begin (one entry more than texts)."""
    lens = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    ends = np.cumsum(lens)
    a = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    space = (a == 32) | ((a >= 9) & (a <= 13))
    edge = np.flatnonzero(np.diff(space, prepend=True))
    starts, stops = edge[0::2], edge[1::2]
    h = np.empty(len(starts), np.uint64)
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(starts // BLOCK)) + 1, [len(starts)]]) if len(starts) else [0]
    for x, y in zip(cuts[:-1], cuts[1:]):
        low = starts[x]
        part = a[low : stops[y - 1]]
        up, down = _powers(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)], out=sums[1:])
        h[x:y] = (sums[stops[x:y] - low] - sums[starts[x:y] - low]) * down[starts[x:y] - low]
    h = mix(h + (stops - starts).astype(np.uint64) * _TURN[0])
    return h, np.concatenate([[0], np.searchsorted(starts, ends)])


def shingle_sets(texts: list[str], width: int = WIDTH) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles: A-Z lower-cased, words split at
    space and bytes 9 to 13; fewer words than `width` are one shingle; no word, an empty set."""
    out: list[np.ndarray] = []
    chunk: list[bytes] = []
    size = 0
    for t in texts:
        b = t.encode("utf-8", "surrogatepass").lower()
        chunk.append(b)
        size += len(b)
        if size > 1 << 21:
            out += _sets(chunk, width)
            chunk, size = [], 0
    return out + (_sets(chunk, width) if chunk else [])


def _sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    h, at = word_hashes(texts)
    n = len(h) - width + 1
    full = np.zeros(0, np.uint64)
    if n > 0:
        full = h[:n] * _TURN[0]
        for k in range(1, width):
            full = mix(full + h[k : n + k] * _TURN[k % 5])
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= width:
            out.append(np.unique(full[a : b - width + 1]))
        elif b > a:
            x = np.full(1, b - a, np.uint64)
            for k in range(a, b):
                x = mix(x * _TURN[1] + h[k : k + 1])
            out.append(x)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def fingerprint(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def coefficients(count: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(seed)
    return r.integers(0, 1 << 31, count, np.uint32) * np.uint32(2) + np.uint32(1), r.integers(0, 1 << 32, count, np.uint32)


def signature(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minima of len(a) hash functions over a set that isn't empty."""
    x = (s >> np.uint64(32)).astype(np.uint32)
    best = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for k in range(0, len(x), 4096):
        np.minimum(best, (x[None, k : k + 4096] * a[:, None] + b[:, None]).min(axis=1), out=best)
    return best


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    k = np.searchsorted(b, a)
    k[k == len(b)] = 0
    return int((b[k] == a).sum()) if len(b) else 0
