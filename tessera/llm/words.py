"""Vectorised words, hashes and windows over a batch of UTF-8 texts (numpy; no per-word Python).

A hash is 64 bits: a polynomial over a word's bytes, mixed; windows combine the words' hashes in order.
Separators are single ASCII bytes, so bytes and code points give the same words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
#: Multiplier between the words of a window.
STEP = U(0xD6E8FEB86659FD93)

#: Byte tables: True for a byte of a word.
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = True
ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
SAME = np.arange(256, dtype=np.uint8)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and their offsets from 0; a null is an empty text."""
    texts = column.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser over unsigned 64-bit values."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x ^= x >> U(29)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(32)
    return x


def spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the words before each text (one longer than the texts); no word crosses texts."""
    flag = inside[data]
    n = len(data)
    before = np.empty(n + 1, bool)
    before[0], before[1:] = False, flag
    before[offsets[:-1]] = False
    starts = np.flatnonzero(flag & ~before[:n])
    after = np.empty(n + 1, bool)
    after[:n], after[n] = flag, False
    after[offsets[1:]] = False
    ends = np.flatnonzero(flag & ~after[1:]) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and its inverse to the powers below n, modulo 2**64."""
    have = _POWERS.get("up")
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", BASE), ("down", INVERSE)):
            out = np.full(size, U(base))
            out[0] = 1
            _POWERS[name] = np.multiply.accumulate(out)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, letters: np.ndarray = SAME) -> np.ndarray:
    """A hash of each span of bytes, read through the byte table `letters`."""
    up, down = powers(len(data) + 1)
    sums = np.empty(len(data) + 1, U)
    sums[0] = 0
    own = letters[data].astype(U)
    own += U(1)
    own *= up[: len(data)]
    np.cumsum(own, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U) * U(0xA24BAED4963EE407))


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of `size` hashes, at its first place; runs across texts are for the caller to leave out."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, U)
    out = hashes[:n].copy()
    for k in range(1, size):
        out *= STEP
        out += hashes[k : k + n]
    return mix(out)


def owners(counts_before: np.ndarray) -> np.ndarray:
    """The text of each word."""
    return np.repeat(np.arange(len(counts_before) - 1), np.diff(counts_before))


def within(counts_before: np.ndarray, size: int) -> np.ndarray:
    """First places of all windows of `size` words that lie in one text."""
    n = np.maximum(np.diff(counts_before) - size + 1, 0)
    first = np.repeat(counts_before[:-1], n)
    return first + np.arange(len(first)) - np.repeat(np.cumsum(n) - n, n)


def sums_by(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sums of values between neighbouring edges."""
    total = np.zeros(len(values) + 1, np.int64 if values.dtype != U else U)
    np.cumsum(values, out=total[1:])
    return total[edges[1:]] - total[edges[:-1]]
