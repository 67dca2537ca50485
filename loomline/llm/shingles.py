"""Sets of word shingles of documents as sorted 64-bit hashes, computed for many documents at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WORDS = 5
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits whose every bit depends on all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.full(n, base, np.uint64)
        out[0] = 1
        return np.cumprod(out, dtype=np.uint64)


_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)
_cache: dict[str, np.ndarray] = {"up": _powers(_BASE, 1 << 16), "down": _powers(_INVERSE, 1 << 16)}


def _table(name: str, n: int) -> np.ndarray:
    if len(_cache[name]) < n:
        _cache[name] = _powers(_BASE if name == "up" else _INVERSE, 1 << n.bit_length())
    return _cache[name]


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each run of bytes other than ASCII white space."""
    data = np.frombuffer(raw, np.uint8)
    blank = _SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]]).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _table("up", len(data))[: len(data)], out=total[1:])
        return mix((total[end] - total[start]) * _table("down", len(data) + 1)[start] + (end - start).astype(np.uint64) * _ODD), start


def shingle_sets(texts: list[str | None], size: int = 1 << 19) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each text: A-Z lower-cased, words between ASCII white space, WORDS at a time; a
    text of fewer words has one shingle, one without words none."""
    raws = [(t or "").encode(errors="surrogatepass").lower() for t in texts]
    at = 0
    while at < len(raws):
        n, total = at, 0
        while n < len(raws) and (n == at or total + len(raws[n]) < size):
            total += len(raws[n]) + 1
            n += 1
        part = raws[at:n]
        ends = np.cumsum([len(r) + 1 for r in part])
        hashes, start = word_hashes(b"\n".join(part) + b"\n")
        upto = np.searchsorted(start, ends)
        with np.errstate(over="ignore"):
            run = np.zeros(max(0, len(hashes) - WORDS + 1), np.uint64)
            for k in range(WORDS):
                run = run * _ODD + hashes[k : k + len(run)]
            run = mix(run)
            first = 0
            for last in upto.tolist():
                words = last - first
                if words >= WORDS:
                    found = np.sort(run[first : last - WORDS + 1])
                    yield found[np.concatenate([[True], found[1:] != found[:-1]])]
                elif words:
                    h = np.uint64(words)
                    for w in hashes[first:last]:
                        h = h * _ODD + w
                    yield mix(np.array([h], np.uint64))
                else:
                    yield np.zeros(0, np.uint64)
                first = last
        at = n


def set_hash(s: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a whole set, as two signed numbers."""
    with np.errstate(over="ignore"):
        a, b = mix(s).sum(dtype=np.uint64), mix(s ^ _ODD).sum(dtype=np.uint64)
    return int(a.view(np.int64)), int(b.view(np.int64))


def common_count(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())
