"""The start of MD5 digests of many short texts at once, for draws over pairs."""

from __future__ import annotations

import hashlib

import numpy as np

#: Digits of a digest that make a draw, in bits.
BITS = 52
_K = np.floor(np.abs(np.sin(np.arange(1, 65))) * 2.0**32).astype(np.uint32)
_TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_START = np.array([0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476], np.uint32)
#: Longest text whose digest takes one block; digests of a call.
_ONE_BLOCK, _AT_ONCE = 55, 1 << 14


def _md5(words: list[np.ndarray], shape: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """The first two words of the digests of one block each; ``words``: sixteen arrays that broadcast to ``shape``."""
    a, b, c, d = (np.full(shape, v, np.uint32) for v in _START)
    f, t = np.empty(shape, np.uint32), np.empty(shape, np.uint32)
    for i in range(64):
        if i < 16:
            g = i
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif i < 32:
            g = (5 * i + 1) % 16
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif i < 48:
            g = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            g = 7 * i % 16
            np.invert(d, out=f)
            f |= b
            f ^= c
        a += f
        a += words[g] + _K[i]
        turn = _TURNS[i // 16][i % 4]
        np.left_shift(a, turn, out=t)
        np.right_shift(a, 32 - turn, out=a)
        a |= t
        a += b
        a, b, c, d = d, a, b, c
    return a + _START[0], b + _START[1]


def _bytes(texts: np.ndarray, at: int) -> np.ndarray:
    """Texts of one length as rows of 64 bytes, from byte ``at``."""
    out = np.zeros((len(texts), 64), np.uint8)
    length = len(texts[0])
    out[:, at : at + length] = np.frombuffer(b"".join(texts), np.uint8).reshape(len(texts), length)
    return out


def _by_length(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    lengths, own = np.array([len(t) for t in texts]), np.array(texts, object)
    return [(at, own[at]) for at in (np.flatnonzero(lengths == n) for n in np.unique(lengths))]


def heads_between(starts: list[bytes], ends: list[bytes], low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places i, j and head of all pairs with low[i] <= head < high[i]; head: the first 13 hex digits of the MD5 of starts[i] + ends[j]."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.empty(0, np.int64),) * 3]
    for rows, left in _by_length(starts):
        for columns, right in _by_length(ends):
            at, whole = len(left[0]), len(left[0]) + len(right[0])
            if whole > _ONE_BLOCK:
                for i, start in zip(rows, left):
                    head = np.array([int(hashlib.md5(start + e).hexdigest()[:13], 16) for e in right])
                    hit = np.flatnonzero((low[i] <= head) & (head < high[i]))
                    out.append((np.full(len(hit), i), columns[hit], head[hit]))
                continue
            first, second = _bytes(left, 0).view("<u4"), _bytes(right, at)
            second[:, whole] = 0x80
            second[:, 56:58] = (8 * whole % 256, 8 * whole // 256)
            second = second.view("<u4")
            step = max(1, _AT_ONCE // len(right))
            for k in range(0, len(left), step):
                i, some = rows[k : k + step], first[k : k + step]
                words = [second[None, :1, g] if (second[:, g] == second[0, g]).all() else second[None, :, g] for g in range(16)]
                words = [w | some[:, None, g] if 4 * g < at else w for g, w in enumerate(words)]
                a, b = _md5(words, (len(some), len(right)))
                a = a.byteswap()
                x, y = np.nonzero(a <= (np.minimum(high[i], (1 << BITS) - 1) >> 20).astype(np.uint32)[:, None])
                head = (a[x, y].astype(np.int64) << 20) | (b[x, y].byteswap() >> 12)
                hit = (low[i[x]] <= head) & (head < high[i[x]])
                out.append((i[x[hit]], columns[y[hit]], head[hit]))
    return tuple(np.concatenate(c) for c in zip(*out))
