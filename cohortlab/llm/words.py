"""Words of whole Arrow columns at once: where they start and end, in which row, and a 64-bit hash of each.

Everything works on the UTF-8 bytes of a column. ASCII separators never occur inside a longer character,
so words found on bytes are the words found on code points.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes hashed in one go; a longer row is cut at a separator, so its words stay whole.
CHUNK = 1 << 18
#: Bytes of the rows handed out together by ``runs``; a longer row comes alone.
RUN = 1 << 20

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: For bags of words: everything in ASCII but letters separates.
NOT_LETTERS = np.array([b < 128 and not chr(b).isalpha() for b in range(256)])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit numbers over all bits (the finalizer known from splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BASE = 0x9E3779B97F4A7C15
STEP = np.uint64(0xD6E8FEB86659FD93)
BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS: dict[str, np.ndarray] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        n = max(n, CHUNK + 1)
        _POWERS["up"] = _powers(BASE, n)
        _POWERS["down"] = _powers(pow(BASE, -1, 1 << 64), n)
    return _POWERS["up"], _POWERS["down"]


class Words(NamedTuple):
    """Columns, one entry per word, in reading order."""

    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    prefix: tuple[np.ndarray, ...] = ()


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; NULL counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def runs(offsets: np.ndarray, limit: int = RUN) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``limit`` bytes together; a longer row comes alone."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def _cut(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> Iterator[tuple[int, int]]:
    """Byte ranges of about CHUNK bytes that end at a row's end or at a separator."""
    at, n = 0, len(data)
    while at < n:
        to = min(at + CHUNK, n)
        if to < n:
            row_end = offsets[np.searchsorted(offsets, to, "right") - 1]
            if row_end > at:
                to = int(row_end)
            else:
                back = np.flatnonzero(separators[data[at:to]])
                if len(back):
                    to = at + int(back[-1]) + 1
                else:  # a single word longer than a chunk
                    ahead, stop = to, int(offsets[np.searchsorted(offsets, to, "right")])
                    while ahead < stop and not separators[data[ahead : ahead + CHUNK]].any():
                        ahead += CHUNK
                    to = min(stop, ahead + int(np.argmax(separators[data[ahead : ahead + CHUNK]])) + 1) if ahead < stop else stop
        yield at, to
        at = to


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACES, prefixes: tuple[int, ...] = ()) -> Words:
    """All maximal runs of other bytes than ``separators``, row by row; also hashes of their first so many bytes."""
    parts = []
    for lo, hi in _cut(data, offsets, separators):
        piece = data[lo:hi]
        inside = ~separators[piece]
        heads = offsets[np.searchsorted(offsets, lo) : np.searchsorted(offsets, hi)] - lo
        begin = inside.copy()
        begin[1:] &= ~inside[:-1]
        begin[heads] = inside[heads]
        finish = inside.copy()
        finish[:-1] &= ~inside[1:]
        tails = heads[heads > 0] - 1
        finish[tails] = inside[tails]
        s, e = np.flatnonzero(begin), np.flatnonzero(finish) + 1
        if not len(s):
            continue
        up, down = _tables(len(piece) + 1)
        total = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(BYTE[piece] * up[: len(piece)], out=total[1:])
        h = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))
        heads_of = [mix((total[np.minimum(s + k, e)] - total[s]) * down[s] + np.uint64(k << 32)) for k in prefixes]
        parts.append((s + lo, e + lo, h, *heads_of))
    if not parts:
        none, no_hash = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        return Words(none, none, none, no_hash, (no_hash,) * len(prefixes))
    start, end, h, *heads_of = (np.concatenate(x) for x in zip(*parts, strict=True))
    return Words(np.searchsorted(offsets, start, "right") - 1, start, end, h, tuple(heads_of))


def rolling(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every ``width`` neighbours, by position of the first (also across rows: mask by row)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out = out * STEP + hashes[k : k + n]
    return mix(out)


def shingles(w: Words, n_rows: int, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of all shingles of ``width`` words; a shorter row has its whole sequence as one."""
    per_row = np.bincount(w.row, minlength=n_rows)
    n = len(w.row) - width + 1
    if n > 0:
        whole = w.row[:n] == w.row[width - 1 :]
        rows, out = w.row[:n][whole], rolling(w.hash, width)[whole]
    else:
        rows, out = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    short = np.flatnonzero((per_row > 0) & (per_row < width))
    if len(short):
        first = np.concatenate([[0], np.cumsum(per_row)])[short]
        h = per_row[short].astype(np.uint64)
        for k in range(width - 1):
            more = k < per_row[short]
            h = np.where(more, h * STEP + w.hash[np.minimum(first + k, len(w.hash) - 1)], h)
        rows, out = np.concatenate([rows, short]), np.concatenate([out, mix(h)])
        order = np.argsort(rows, kind="stable")
        rows, out = rows[order], out[order]
    return rows, out


def distinct(rows: np.ndarray, hashes: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each row, concatenated, and the row offsets. ``rows`` ascend."""
    bounds = np.searchsorted(rows, np.arange(n_rows + 1))
    parts = [np.unique(hashes[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    sizes = np.array([len(p) for p in parts], np.int64)
    flat = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return flat, np.concatenate([[0], np.cumsum(sizes)])
