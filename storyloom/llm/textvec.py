"""Word hashes of many texts at once, on numpy arrays: Rabin-Karp prefix sums over bytes and over words, modulo 2**64."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
#: Bytes of text that are worked on at once.
SLICE = 1 << 20
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _upto(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(n + n // 8, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def spans_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hash of values[start:end] for each span, from one prefix sum."""
    up, down = _upto(len(values) + 1)
    prefix = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=prefix[1:])
    return (prefix[ends] - prefix[starts]) * down[starts]


def spans(lengths: Iterable[int], most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of texts, given by their lengths, of about `most` bytes; a longer text is a range of its own."""
    a = i = size = 0
    for i, n in enumerate(lengths, 1):
        if size and size + n > most:
            yield a, i - 1
            a, size = i - 1, 0
        size += n + 1
    if i > a:
        yield a, i


def slices(texts: list[bytes], most: int = SLICE) -> Iterator[tuple[int, int]]:
    return spans(map(len, texts), most)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word `[^\\x20\\x09-\\x0D]+` of all texts, and where each text's words begin (one more: the end)."""
    buf = b"\n".join(texts) + b"\n"
    a = np.frombuffer(buf, np.uint8)
    word = ~((a == 32) | ((a >= 9) & (a <= 13)))
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    if len(word) and word[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[0::2], edge[1::2]
    h = mix(spans_hash(a.astype(np.uint64) + np.uint64(1), starts, ends) + (ends - starts).astype(np.uint64))
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(x) + 1 for x in texts], out=offsets[1:])
    return h, np.searchsorted(starts, offsets)


def windows(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of `width` words; runs may cross texts."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    at = np.arange(n)
    return mix(spans_hash(words, at, at + width))


def sliding(f, x: np.ndarray, width: int) -> np.ndarray:
    """f (np.minimum or np.maximum) over each run of `width`, by doubling."""
    done, out = 1, x
    while done < width:
        step = min(done, width - done)
        out = f(out[:-step], out[step:]) if step < len(out) else out[:0]
        done += step
    return out
