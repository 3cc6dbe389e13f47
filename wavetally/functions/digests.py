"""MD5 of many short texts at once: its 64 steps run on numpy arrays that hold a number for each
text. A text here is a beginning and a decimal number behind it."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_SINES = np.array([int(abs(np.sin(i + 1)) * 2**32) for i in range(64)], np.uint32)
_ORDER = np.array([(i, 5 * i + 1, 3 * i + 5, 7 * i)[i // 16] % 16 for i in range(64)])
_LEFT = np.array([(7, 12, 17, 22, 5, 9, 14, 20, 4, 11, 16, 23, 6, 10, 15, 21)[i // 16 * 4 + i % 4] for i in range(64)], np.uint32)
_RIGHT = np.uint32(32) - _LEFT

#: Texts at a time: arrays of so many numbers stay near the processor, and calls are few.
TEXTS = 65_536


def _first_words(words: list[int | np.ndarray], count: int) -> tuple[np.ndarray, np.ndarray]:
    """The first two words of the digests of ``count`` blocks, each given by 16 words: one number
    for all blocks, or an array."""
    vary = [w if isinstance(w, np.ndarray) else None for w in words]
    add = _SINES + np.array([w if v is None else 0 for w, v in zip(words, vary, strict=True)], np.uint32)[_ORDER]
    a, b, c, d = (np.full(count, x, np.uint32) for x in _START)
    t = np.empty(count, np.uint32)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, t)
            np.bitwise_and(t, b, t)
            np.bitwise_xor(t, d, t)
        elif i < 32:
            np.bitwise_xor(b, c, t)
            np.bitwise_and(t, d, t)
            np.bitwise_xor(t, c, t)
        elif i < 48:
            np.bitwise_xor(b, c, t)
            np.bitwise_xor(t, d, t)
        else:
            np.invert(d, t)
            np.bitwise_or(t, b, t)
            np.bitwise_xor(t, c, t)
        np.add(a, t, a)
        np.add(a, add[i, ...], a)
        if (w := vary[_ORDER[i]]) is not None:
            np.add(a, w, a)
        np.left_shift(a, _LEFT[i, ...], t)
        np.right_shift(a, _RIGHT[i, ...], a)
        np.bitwise_or(a, t, a)
        np.add(a, b, a)
        a, b, c, d = d, a, b, c
    return a + np.uint32(_START[0]), b + np.uint32(_START[1])


def _behind(first: int, last: int, at: int) -> np.ndarray:
    """16 rows of words: the numbers from ``first`` to before ``last``, of equally many digits,
    from byte ``at`` of a block on, and what ends a block."""
    digits, k = len(str(first)), np.arange(first, last)
    block = np.zeros((last - first, 64), np.uint8)
    for i in range(at + digits - 1, at - 1, -1):
        k, unit = np.divmod(k, 10)
        block[:, i] = unit + ord("0")
    block[:, at + digits] = 0x80
    words = np.ascontiguousarray(block.view("<u4").T.astype(np.uint32))
    words[14] = 8 * (at + digits)
    return words


def md5_heads(beginnings: list[bytes], n: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """The first eight bytes, most significant first, of MD5 over each beginning with each number
    from 0 to before n behind it. i, k, heads: a row for each beginning from ``i`` on, a column
    for each number from ``k`` on. Texts too long for one block are digested one by one."""
    groups: list[int] = [i for i in range(len(beginnings)) if i == 0 or len(beginnings[i]) != len(beginnings[i - 1])]
    first = 0
    while first < n:
        last = min(n, first + TEXTS, 10 ** len(str(first)))
        for start, end in zip(groups, groups[1:] + [len(beginnings)], strict=True):
            at = len(beginnings[start])
            if at + len(str(first)) > 55:
                for i in range(start, end):
                    digests = b"".join([hashlib.md5(b"%b%d" % (beginnings[i], k), usedforsecurity=False).digest() for k in range(first, last)])
                    yield i, first, np.frombuffer(digests, ">u8")[None, ::2].astype(np.uint64)
                continue
            behind = _behind(first, last, at)
            one = (behind == behind[:, :1]).all(axis=1)
            step = max(1, TEXTS // (last - first))
            for i in range(start, end, step):
                some = beginnings[i : min(i + step, end)]
                before = np.frombuffer(b"".join(x.ljust(64, b"\0") for x in some), "<u4").reshape(-1, 16).astype(np.uint32)
                words: list[int | np.ndarray] = []
                for j in range(16):
                    of = before[:1, j] if (before[:, j] == before[0, j]).all() else before[:, j]
                    both = of[:, None] + (behind[j, :1] if one[j] else behind[j])
                    words.append(int(both[0, 0]) if both.size == 1 else np.ascontiguousarray(np.broadcast_to(both, (len(some), last - first))).reshape(-1))
                a, b = _first_words(words, len(some) * (last - first))
                yield i, first, np.stack([a, b], axis=1).astype("<u4").view(">u8").astype(np.uint64).reshape(len(some), -1)
        first = last
