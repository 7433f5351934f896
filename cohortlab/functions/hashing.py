"""Reproducible pseudo-random numbers from md5 of a seed and the row identity.

They do not depend on partitioning or execution order, so a lost executor recomputes the same
draws, and any SQL engine with md5 can repeat them.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_RANGE = float(16**13)


def _col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def digest(seed, *ids) -> Column:
    """Hex md5 of ``seed|id|id...``."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[_col(i).cast("string") for i in ids]))


def hash_key(seed, *ids) -> Column:
    """First 52 bits of the digest as a non-negative bigint."""
    return F.conv(F.substring(digest(seed, *ids), 1, 13), 16, 10).cast("bigint")


def hash_uniform(seed, *ids) -> Column:
    """Uniform double in [0, 1)."""
    return hash_key(seed, *ids) / F.lit(HASH_RANGE)


def poisson_steps() -> list[tuple[str, int]]:
    """Inverse Poisson(1) distribution on 32-bit hex digits: weight is the first k with hex < step.

    Hex digits sort like the numbers they write, so no conversion to a number is needed. The ladder ends where 32
    bits tell no further step apart.
    """
    steps, cdf, term, k = [], 0.0, math.exp(-1.0), 0
    while True:
        cdf += term
        bound = format(int(cdf * 2**32), "08x")
        if steps and bound == steps[-1][0] or len(bound) > 8:
            return steps
        steps.append((bound, k))
        k += 1
        term /= k


#: The weight above the last step.
POISSON_CUT = len(poisson_steps())


def poisson_weight(hex8: str) -> Column:
    """Poisson(1) weight of the SQL text of a uniform in eight hex digits."""
    whens = " ".join(f"WHEN {hex8} < '{bound}' THEN {k}D" for bound, k in poisson_steps())
    return F.expr(f"CASE {whens} ELSE {POISSON_CUT}D END")


_TURNS = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
_SINES = [int(abs(math.sin(i + 1)) * 2**32) & 0xFFFFFFFF for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: Messages hashed at once, so that a step's numbers stay in the cache; and the longest one of a single block.
_MD5_ROWS, _MD5_BYTES = 8192, 55


def _md5_blocks(words: np.ndarray) -> np.ndarray:
    """MD5 state, messages x 4, of padded one-block messages given as 16 x messages little-endian words."""
    u, n = np.uint32, words.shape[1]
    a, b, c, d = (np.full(n, v, u) for v in _START)
    f, t = np.empty(n, u), np.empty(n, u)
    empty = [not w.any() for w in words]
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
            g = (7 * i) % 16
            np.bitwise_not(d, out=f)
            f |= b
            f ^= c
        f += a
        f += u(_SINES[i])
        if not empty[g]:
            f += words[g]
        a, d, c = d, c, b
        np.left_shift(f, u(_TURNS[i]), out=t)
        f >>= u(32 - _TURNS[i])
        f |= t
        b = b + f
    return np.stack([v + u(s) for v, s in zip((a, b, c, d), _START)], axis=1)


def md5_words(tails: list[bytes], heads: list[bytes]) -> np.ndarray:
    """MD5 of every head + tail as four big-endian 32-bit numbers: tails x heads x 4.

    Short messages are hashed many at a time, array by array; longer ones one by one.
    """
    out = np.empty((len(tails), len(heads), 4), np.uint32)
    lengths, sizes = np.array([len(t) for t in tails]), np.array([len(h) for h in heads])
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        first = np.frombuffer(b"".join(heads[j] for j in at.tolist()), np.uint8).reshape(len(at), size)
        for length in np.unique(lengths).tolist():
            rows = np.flatnonzero(lengths == length)
            if size + length > _MD5_BYTES:
                for i in rows.tolist():
                    for j in at.tolist():
                        out[i, j] = np.frombuffer(hashlib.md5(heads[j] + tails[i]).digest(), ">u4")
                continue
            last = np.frombuffer(b"".join(tails[i] for i in rows.tolist()), np.uint8).reshape(len(rows), length)
            step = max(1, _MD5_ROWS // len(at))
            for k in range(0, len(rows), step):
                own = rows[k : k + step]
                text = np.zeros((len(own), len(at), 64), np.uint8)
                text[:, :, :size] = first
                text[:, :, size : size + length] = last[k : k + step, None, :]
                text[:, :, size + length] = 0x80
                text[:, :, 56:58] = np.frombuffer((8 * (size + length)).to_bytes(2, "little"), np.uint8)
                words = np.ascontiguousarray(text.reshape(-1, 64).view("<u4").T)
                out[np.ix_(own, at)] = _md5_blocks(words).byteswap().reshape(len(own), len(at), 4)
    return out
