"""The gamma draws of :mod:`readweave.functions.random` for arrays of keys: same keys, same tries, by whole arrays instead of row by row."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from readweave.functions.random import TRIES

#: Draws made at once.
AT_ONCE = 1 << 15
#: Texts of fewer draws are hashed one by one.
FEW = 600
_K = [int(abs(math.sin(i + 1)) * 2**32) & 0xFFFFFFFF for i in range(64)]
_TURN = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: The longest text that is one block of md5.
ONE_BLOCK = 55


def md5_start(words: list[np.ndarray | int], size: int) -> tuple[np.ndarray, np.ndarray]:
    """First two words of the md5 of ``size`` texts of one block each, given as its 16 words; an integer stands for all texts."""
    a, b, c, d = (np.full(size, x, np.uint32) for x in _START)
    f, g = np.empty(size, np.uint32), np.empty(size, np.uint32)
    for i in range(64):
        if i < 16:
            np.bitwise_and(np.bitwise_xor(c, d, out=f), b, out=f)
            f ^= d
            k = i
        elif i < 32:
            np.bitwise_and(np.bitwise_xor(b, c, out=f), d, out=f)
            f ^= c
            k = (5 * i + 1) % 16
        elif i < 48:
            np.bitwise_xor(np.bitwise_xor(b, c, out=f), d, out=f)
            k = (3 * i + 5) % 16
        else:
            np.bitwise_or(np.invert(d, out=f), b, out=f)
            f ^= c
            k = 7 * i % 16
        word = words[k]
        f += a
        if isinstance(word, np.ndarray):
            f += word
            word = 0
        f += np.uint32((_K[i] + word) & 0xFFFFFFFF)
        turn = _TURN[i // 16][i % 4]
        np.left_shift(f, np.uint32(turn), out=g)
        f >>= np.uint32(32 - turn)
        f |= g
        f += b
        a, d, c, b, f = d, c, b, f, a
    return a + np.uint32(_START[0]), b + np.uint32(_START[1])


def _shares(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Uniforms from the first 52 bits of digests."""
    bits = first.byteswap().astype(np.uint64) << np.uint64(20) | second.byteswap().astype(np.uint64) >> np.uint64(12)
    return bits / float(1 << 52)


def _digits(x: np.ndarray) -> np.ndarray:
    return np.searchsorted(10 ** np.arange(1, 19), x, side="right") + 1


def uniforms(seed: int, tr: np.ndarray, n: np.ndarray, ends: list[str]) -> list[np.ndarray]:
    """What ``portable_uniform`` gives for the keys ``tr``, ``n`` and each of ``ends``, which are equally long and differ in their last letter."""
    out = [np.empty(len(tr)) for _ in ends]
    head = f"{int(seed)}|".encode()
    shape = _digits(np.maximum(tr, 0)) * 32 + _digits(np.maximum(n, 0))
    shape[(tr < 0) | (n < 0)] = 0
    for kind in np.unique(shape):
        at = np.flatnonzero(shape == kind)
        size = len(head) + kind // 32 + 1 + kind % 32 + 1 + len(ends[0])
        if not kind or size > ONE_BLOCK or len(at) < FEW:
            for values, end in zip(out, ends, strict=True):
                digests = (hashlib.md5(head + f"{t}|{k}|{end}".encode()).digest() for t, k in zip(tr[at].tolist(), n[at].tolist(), strict=True))
                values[at] = [(int.from_bytes(x[:7], "big") >> 4) / float(1 << 52) for x in digests]
            continue
        words: list[np.ndarray | int] = [0] * 16

        def put(place: int, byte, words=words) -> None:
            words[place // 4] = words[place // 4] + (byte << (8 * (place % 4)))

        place = 0
        for text, key, digits in ((head, tr, kind // 32), (b"|", n, kind % 32), (b"|" + ends[0][:-1].encode(), None, 0)):
            for byte in text:
                put(place, byte)
                place += 1
            left = None if key is None else key[at].astype(np.uint32 if digits < 10 else np.uint64)
            for k in range(int(digits) - 1, -1, -1):
                higher = left // 10
                put(place + k, (left - higher * 10 + 48).astype(np.uint32))
                left = higher
            place += int(digits)
        put(place + 1, 0x80)
        words[14] = 8 * int(size)
        for values, end in zip(out, ends, strict=True):
            own = list(words)
            own[place // 4] = own[place // 4] + (ord(end[-1]) << (8 * (place % 4)))
            values[at] = _shares(*md5_start(own, len(at)))
    return out


def gamma(seed: int, shape: np.ndarray, tr: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``gamma`` of the same seed, shapes and keys."""
    d = np.where(shape < 1, shape + 1, shape) - 1.0 / 3.0
    out, left = d.copy(), np.arange(len(d))
    with np.errstate(invalid="ignore", divide="ignore"):
        for t in range(TRIES):
            if not len(left):
                break
            r, a, s = uniforms(seed, tr[left], n[left], [f"{t}|{x}" for x in "ras"])
            z, own = np.sqrt(-2.0 * np.log(1.0 - r)) * np.cos(2.0 * math.pi * a), d[left]
            w = 1.0 + z / np.sqrt(9.0 * own)
            v = w * w * w
            good = (w > 0) & (np.log(1.0 - s) < 0.5 * z * z + own * (1.0 - v + 3.0 * np.log(w)))
            out[left[good]] = (own * v)[good]
            left = left[~good]
    small = np.flatnonzero(shape < 1)
    if len(small):
        out[small] *= uniforms(seed, tr[small], n[small], ["p"])[0] ** (1.0 / shape[small])
    return out


def _drawn(seed: int, n: int, batch: int, columns: list[pa.Array]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ends of the rows, numbers and values of the draws of rows tr, from, shape."""
    keys, first, shapes = (c.to_numpy(zero_copy_only=False) for c in columns)
    counts = np.minimum(batch, n - first)
    ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    of = np.repeat(np.arange(len(keys)), counts)
    number = np.arange(ends[-1]) - np.repeat(ends[:-1] - first, counts)
    parts = [slice(i, i + AT_ONCE) for i in range(0, len(of), AT_ONCE)]
    return ends, number, np.concatenate([np.zeros(0), *(gamma(seed, shapes[of[p]], keys[of[p]], number[p]) for p in parts)])


def gammas(seed: int, n: int, batch: int):
    """A function of columns tr, from, shape: the draws number from, from + 1, ... below ``n`` of a transcript, at most ``batch``."""

    @F.arrow_udf(ArrayType(DoubleType()))
    def drawn(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for columns in batches:
            ends, _, values = _drawn(seed, n, batch, list(columns))
            yield pa.ListArray.from_arrays(pa.array(ends), pa.array(values))

    return drawn


def gamma_sums(seed: int, n: int, batch: int):
    """A function of batches tr, from, shape for ``mapInArrow``: n, sum of a task's draws of each number."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(n), np.zeros(n, bool)
        for part in batches:
            _, number, values = _drawn(seed, n, batch, part.columns)
            total += np.bincount(number, values, n)
            seen[number] = True
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["n", "sum"])

    return summed
