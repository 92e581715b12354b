"""Word hashes of whole batches of texts at once, with numpy over their bytes."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np

_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 2**64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out, dtype=np.uint64)


@dataclass
class Words:
    """hash: of each word; first: the index of each text's first word, and one more entry for the end; start, stop: byte
    places of each word in data."""

    hash: np.ndarray
    first: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    data: bytes


def words(texts: list[str | None]) -> Words:
    """Words are what white space of ASCII separates; nulls have none."""
    raw = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    data = b" ".join([*raw, b""])
    sizes = np.fromiter((len(r) + 1 for r in raw), dtype=np.int64, count=len(raw))
    ends = np.cumsum(sizes)
    b = np.frombuffer(data, dtype=np.uint8)
    gap = np.concatenate([[True], _SPACE[b], [True]])
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    start, stop = edge[::2], edge[1::2]
    with np.errstate(over="ignore"):
        total = np.zeros(len(b) + 1, dtype=np.uint64)
        np.cumsum((b.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, max(1, len(b)))[: len(b)], out=total[1:])
        h = mix((total[stop] - total[start]) * _powers(_INVERSE, max(1, len(b)))[start] + (stop - start).astype(np.uint64))
    first = np.concatenate([[0], np.searchsorted(start, ends)])
    return Words(h, first, start, stop, data)


def word_keys(w: Words) -> list[bytes | None]:
    """128 bits of each text's words, whatever white space is between them; None without any."""
    raw = w.hash.tobytes()
    return [hashlib.blake2b(raw[8 * a : 8 * z], digest_size=16).digest() if z > a else None for a, z in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)]


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """The hash of every n consecutive entries, by position of the first; empty where there are fewer than n."""
    if len(h) < n:
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        total = np.concatenate([[np.uint64(0)], np.cumsum(h * _powers(_BASE, len(h)), dtype=np.uint64)])
        return mix((total[n:] - total[:-n]) * _powers(_INVERSE, len(h) - n + 1))


def slices(texts: list[str | None], most: int = 2_000_000):
    """(from, to) of runs of texts with about `most` characters; one text may have more."""
    at, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t or "")
        if size >= most:
            yield at, k + 1
            at, size = k + 1, 0
    if at < len(texts):
        yield at, len(texts)
