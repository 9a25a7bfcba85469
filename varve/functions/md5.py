"""MD5 of very many short texts at once: every pairing of some heads with some tails."""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import md5

import numpy as np

#: Constants and rotations of MD5's 64 steps, its starting state, and hashes that are worked out at a time (their state stays in the cache).
_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_TURNS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
HASHES, ONE_BLOCK = 32_768, 55


def _words(texts: list[bytes], at: int, end: bytes = b"") -> np.ndarray:
    """(texts, 16) words of one MD5 block in which each text, all of one length, starts at byte `at` and `end` follows it."""
    out = np.zeros((len(texts), 64), np.uint8)
    size = len(texts[0])
    out[:, at : at + size] = np.frombuffer(b"".join(texts), np.uint8).reshape(len(texts), size)
    if end:
        out[:, at + size] = 0x80
        out[:, 56:] = np.frombuffer(end, np.uint8)
    return out.view("<u4")


def _md5(block: list, shape) -> list[np.ndarray]:
    """The four words of each MD5 of one-block messages; `block` has 16 words that broadcast to `shape`, None for 0."""
    a, b, c, d = (np.full(shape, v, np.uint32) for v in _START)
    f, turned = np.empty(shape, np.uint32), np.empty(shape, np.uint32)
    for i in range(64):
        kind = i // 16
        if kind == 0:
            np.bitwise_xor(c, d, out=f), np.bitwise_and(f, b, out=f), np.bitwise_xor(f, d, out=f)
        elif kind == 1:
            np.bitwise_xor(b, c, out=f), np.bitwise_and(f, d, out=f), np.bitwise_xor(f, c, out=f)
        elif kind == 2:
            np.bitwise_xor(b, c, out=f), np.bitwise_xor(f, d, out=f)
        else:
            np.invert(d, out=f), np.bitwise_or(f, b, out=f), np.bitwise_xor(f, c, out=f)
        word, turn = block[(i, 5 * i + 1, 3 * i + 5, 7 * i)[kind] % 16], _TURNS[kind][i % 4]
        f += a
        f += np.uint32(_SINES[i]) if word is None else word + np.uint32(_SINES[i])
        np.left_shift(f, turn, out=turned), np.right_shift(f, 32 - turn, out=f), np.bitwise_or(f, turned, out=f)
        f += b
        a, b, c, d, f = d, f, b, c, a
    return [v + np.uint32(s) for v, s in zip((a, b, c, d), _START)]


def md5_blocks(heads: list[bytes], tails: list[bytes]) -> Iterator[tuple[np.ndarray, slice, np.ndarray]]:
    """(places of tails, places of heads, their MD5s: tails x heads x 4 big-endian words) until all pairs head + tail are done.

    Texts whose heads are equally long, and whose tails are, share the layout of their block: their MD5s are worked out together, a few
    thousand at a time. Texts beyond one MD5 block are hashed one by one. Heads of one length should follow each other.
    """
    head_size, tail_size = np.array([len(h) for h in heads], int), np.array([len(t) for t in tails], int)
    ends = np.append(np.flatnonzero(np.diff(head_size)) + 1, len(heads))
    for first, end in zip([0, *ends[:-1]], ends) if heads else ():
        span, a = slice(int(first), int(end)), int(head_size[first])
        left = _words(heads[span], 0)
        for b in np.unique(tail_size):
            rows = np.flatnonzero(tail_size == b)
            if a + b > ONE_BLOCK:
                for i in rows:
                    digests = b"".join(md5(h + tails[i], usedforsecurity=False).digest() for h in heads[span])
                    yield np.array([i]), span, np.frombuffer(digests, ">u4").astype(np.uint32).reshape(1, -1, 4)
                continue
            right = _words([tails[i] for i in rows], a, int(8 * (a + b)).to_bytes(8, "little"))
            step = max(1, HASHES // left.shape[0])
            for at in range(0, len(rows), step):
                some = right[at : at + step]
                block = []
                for w in range(16):
                    own, other = left[None, :, w], some[:, None, w]
                    block.append(own if 4 * w + 4 <= a else own | other if 4 * w < a else other if other.any() else None)
                yield rows[at : at + step], span, np.stack([v.byteswap() for v in _md5(block, (len(some), left.shape[0]))], axis=-1)


def md5_halves(heads: list[bytes], tails: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The MD5s of head + tail as two matrices (tails x heads) of 64 bits, the first half and the second."""
    high, low = (np.empty((len(tails), len(heads)), np.uint64) for _ in "ab")
    for rows, some, u in md5_blocks(heads, tails):
        wide = u.astype(np.uint64)
        high[rows, some] = wide[..., 0] << np.uint64(32) | wide[..., 1]
        low[rows, some] = wide[..., 2] << np.uint64(32) | wide[..., 3]
    return high, low
