"""Hashed word-shingle sets of many texts at once (numpy, inside tasks)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U = np.uint64
CHUNK = 1 << 20  # bytes of text handled together


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTES = mix(np.arange(1, 257, dtype=U))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = U(0x9E3779B97F4A7C15)


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, U)
    out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of every run of non-blank bytes."""
    a = np.frombuffer(data, np.uint8)
    filled = ~_SPACE[a]
    edge = np.flatnonzero(filled[1:] != filled[:-1]) + 1
    if len(a) and filled[0]:
        edge = np.concatenate([[0], edge])
    if len(a) and filled[-1]:
        edge = np.concatenate([edge, [len(a)]])
    start, stop = edge[::2], edge[1::2]
    if not len(start):
        return start, np.zeros(0, U)
    length = stop - start
    at = np.flatnonzero(filled)
    within = np.arange(len(at)) - np.repeat(np.cumsum(length) - length, length)
    value = _BYTES[a[at]] * _powers(int(length.max()))[within]
    first = np.cumsum(length) - length
    return start, mix(np.add.reduceat(value, first) + length.astype(U))


def sets_of(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sizes, signatures, values): sorted distinct 64-bit shingle values, text after text.

    A text with fewer than n words has its whole sequence as one shingle, none without words.
    """
    ends = np.cumsum([len(t) + 1 for t in texts])
    start, h = word_hashes(b"\n".join(texts) + b"\n")
    doc = np.searchsorted(ends, start, side="right")
    words = np.bincount(doc, minlength=len(texts))
    first = np.cumsum(words) - words
    s = h * U(0xD6E8FEB86659FD93) + U(1)
    for i in range(1, n):
        s = mix(s[: len(s) - 1 or None] if len(s) > 1 else s[:0]) + h[i:] * U(0xD6E8FEB86659FD93 + 2 * i)
        if not len(s):
            break
    s = mix(s)
    at = np.arange(len(s))
    full = doc[at] == doc[at + n - 1] if len(s) else np.zeros(0, bool)
    owner, value = doc[: len(s)][full], s[full]
    short = np.flatnonzero((words > 0) & (words < n))
    if len(short):
        one = []
        for d in short:
            v = U(words[d] + 77)
            for x in h[first[d] : first[d] + words[d]]:
                v = mix(np.array([v ^ x], U))[0] + U(words[d])
            one.append(v)
        owner, value = np.concatenate([owner, short]), np.concatenate([value, np.array(one, U)])
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    keep = np.ones(len(value), bool)
    keep[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    owner, value = owner[keep], value[keep]
    sizes = np.bincount(owner, minlength=len(texts))
    sig = np.zeros(len(texts), U)
    some = np.flatnonzero(sizes)
    if len(some):
        at = (np.cumsum(sizes) - sizes)[some]
        sig[some] = mix(np.add.reduceat(mix(value), at) ^ mix(np.bitwise_xor.reduceat(value, at) + sizes[some].astype(U)))
    return sizes, sig, value


def pack(values: np.ndarray) -> bytes:
    """Eight bytes a value."""
    return values.astype("<u8").tobytes()


def unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u8").astype(U)


def chunks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """(from, to) of stretches of at most CHUNK bytes, or a single longer text."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        if i > begin and size + len(t) > CHUNK:
            yield begin, i
            begin, size = i, 0
        size += len(t)
    if begin < len(texts):
        yield begin, len(texts)
