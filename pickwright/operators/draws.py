"""Winners of many trials from md5, whole columns at a time; the Python part of :func:`scenarios.outcome_trials`."""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle

# workers need numpy and pandas, not this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Digests made at once, so that the columns stay in a core's cache.
AT_ONCE = 32_768
START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
TURNS = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4


def _block(state: list[np.ndarray], words: Sequence[np.ndarray | int]) -> list[np.ndarray]:
    """MD5 of one more block of 16 words, each an array or one number for all messages."""
    a, b, c, d = (v.copy() for v in state)
    f, s = np.empty_like(a), np.empty_like(a)
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
        f += a
        if isinstance(words[g], int):
            f += np.uint32((SINES[i] + words[g]) & 0xFFFFFFFF)
        else:
            f += np.uint32(SINES[i])
            f += words[g]
        np.right_shift(f, np.uint32(32 - TURNS[i]), out=s)
        np.left_shift(f, np.uint32(TURNS[i]), out=f)
        f |= s
        f += b
        a, d, c, b, f = d, c, b, f, a
    return [v + w for v, w in zip(state, (a, b, c, d), strict=True)]


def top_bits(heads: Sequence[bytes], tails: np.ndarray) -> np.ndarray:
    """First 52 bits of md5(head + tail) for all heads, of one length, and all rows of ``tails``, bytes of one length."""
    n, size = tails.shape
    h = len(heads[0])
    blocks = (h + size + 8) // 64 + 1
    text = np.zeros((n, 64 * blocks), np.uint8)
    text[:, h : h + size] = tails
    text[:, h + size] = 0x80
    text[:, -8:] = np.frombuffer((8 * (h + size)).to_bytes(8, "little"), np.uint8)
    words: list[np.ndarray | int] = [int(c[0]) if (c == c[0]).all() else c for c in np.ascontiguousarray(text.view("<u4").T)]
    front = np.frombuffer(b"".join(v.ljust(-(-h // 4) * 4, b"\0") for v in heads), "<u4").reshape(len(heads), -1)
    for j in range(front.shape[1]):
        words[j] = front[:, j : j + 1] | np.asarray(words[j], np.uint32)
    state = [np.full((len(heads), n), v, np.uint32) for v in START]
    for i in range(blocks):
        state = _block(state, words[16 * i : 16 * i + 16])
    return (state[0].byteswap().astype(np.int64) << 20) | (state[1].byteswap() >> np.uint32(12))


def summed_draws(keys: Sequence[str], trials: int):
    """A pandas map: rows of ``keys``, ``_tail``, ``_bound``, ``_a`` and ``_b`` to the sums of a batch, per keys, with a list of one sum per trial.

    A trial's side is the first where the first 52 bits of md5(trial + tail) are below the bound.
    """
    keys = list(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if not len(rows):
                continue
            cell = rows.groupby(keys, sort=False, dropna=False).ngroup().to_numpy()
            heads, firsts = np.unique(cell, return_index=True)
            a, b, bound = (rows[c].to_numpy() for c in ("_a", "_b", "_bound"))
            tails = [t.encode() for t in rows["_tail"]]
            sizes = np.array([len(t) for t in tails])
            kept = np.zeros((trials, len(heads)))
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                text = np.frombuffer(b"".join(tails[i] for i in at), np.uint8).reshape(len(at), size)
                first = 0
                while first < trials:
                    # names of one block of trials have the same number of digits
                    last = min(trials, first + max(1, AT_ONCE // len(at)), 10 ** len(str(first)))
                    bits = top_bits([str(t).encode() for t in range(first, last)], text)
                    won = np.where(bits < bound[at], a[at], b[at])
                    spots = cell[at] + len(heads) * np.arange(last - first)[:, None]
                    kept[first:last] += np.bincount(spots.ravel(), won.ravel(), (last - first) * len(heads)).reshape(last - first, -1)
                    first = last
            out = rows.iloc[firsts][keys].reset_index(drop=True)
            out["_sums"] = list(kept.T)
            out["_all"] = np.bincount(cell, a + b, len(heads))
            yield out

    return run
