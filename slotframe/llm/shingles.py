"""Word shingles of whole texts as sets of 64-bit hashes, for a batch of texts at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
BASE = np.uint64(0xD1342543DE82EF95)
SPAN = 1 << 15
_rng = np.random.Generator(np.random.PCG64(2024))
LETTER = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix64(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * M2
        x = (x ^ (x >> np.uint64(27))) * M3
        return x ^ (x >> np.uint64(31))


def powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out, dtype=np.uint64)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word of all texts, and how many words each text has. A-Z count as a-z; words are what lies between
    spaces and the control characters 9 to 13."""
    raw = np.frombuffer(b" ".join(texts).lower() + b" ", np.uint8)
    word = ((raw < 9) | (raw > 13)) & (raw != 32)
    edge = np.flatnonzero(np.diff(word, prepend=False, append=False))
    begin, end = edge[::2], edge[1::2]
    hashed = (end - begin).astype(np.uint64) * M1
    # sums are taken over SPAN bytes at a time, or one longer word: a word's hash is the same wherever the sum begins
    cuts = np.unique(np.append(np.searchsorted(begin, np.arange(0, len(raw), SPAN)), len(begin)))
    most = int((end[cuts[1:] - 1] - begin[cuts[:-1]]).max(initial=0))
    power, back = powers(most, BASE), powers(most, np.uint64(pow(int(BASE), -1, 1 << 64)))
    value, before = np.empty(most, np.uint64), np.zeros(most + 1, np.uint64)
    with np.errstate(over="ignore"):
        for lo, hi in zip(cuts.tolist(), cuts[1:].tolist()):
            at, n = begin[lo], int(end[hi - 1] - begin[lo])
            np.take(LETTER, raw[at: at + n], out=value[:n], mode="clip")
            value[:n] *= power[:n]
            np.cumsum(value[:n], out=before[1: n + 1])
            first = begin[lo:hi] - at
            hashed[lo:hi] += (before[end[lo:hi] - at] - before[first]) * back[first]
    close = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    return mix64(hashed), np.diff(np.searchsorted(begin, close), prepend=0)


def shingle_sets(texts: list[str | None], width: int) -> Iterator[np.ndarray]:
    """The distinct shingles of each text, sorted. A text with fewer words than ``width`` has all its words as one; one
    without words, or a null, has none."""
    raw = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    words, counts = word_hashes(raw)
    ends = np.cumsum(counts)
    with np.errstate(over="ignore"):
        rolled = words.copy()
        for k in range(1, width):
            rolled = mix64(rolled[: len(words) - k]) * M1 + words[k:] if len(words) > k else rolled[:0]
        for n, end in zip(counts.tolist(), ends.tolist()):
            if n >= width:
                yield np.unique(mix64(rolled[end - n: end - width + 1]))
            elif n:
                value = words[end - n: end - n + 1]
                for k in range(1, n):
                    value = mix64(value) * M1 + words[end - n + k]
                yield mix64(value + np.uint64(n))
            else:
                yield np.zeros(0, np.uint64)
