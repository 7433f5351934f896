"""Licence texts and notices in documents, by the Dice coefficient of word bigrams.

A text is normalised (A-Z lower-cased; everything in ASCII but letters and digits separates words) and taken apart three
ways: lines, paragraphs (ended by an empty line), the whole. A unit U is a hit for a template T if 2 |U n T| / (|U| + |T|), over
sets of bigrams, is THRESHOLD or more; a unit of one word has the word itself as its only bigram. For licences of several
paragraphs and those inside lines, windows of each template's number of words go over the words of the whole text besides.

Size bounds prune: only templates with |U| t / (2 - t) <= |T| <= |U| (2 - t) / t can reach t, and then |U n T| >= |U| t / (2 - t).
All bigrams of a batch are tested against those of all templates at once; only units with enough hits are compared with
templates, and of these only with those within the size bounds.

Defined results: NULL, empty and wordless texts have no hits; repeated rows are scanned alike. Of scores within NEAR of the highest the one with most
common bigrams is best, then the highest, then the template whose name sorts first; a notice is never best where the numbers are those of another version. Positions are code points, end exclusive, from the first to the last word of the unit. Other columns are never read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Mapping
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .license_texts import TEMPLATES
from .words import LOWER, Words, column_bytes, mix, rolling, runs, words

THRESHOLD = 0.8
#: Scores this near are told apart by common bigrams. Most words of templates in which numbers are versions.
NEAR, NOTICE = 0.1, 60
#: Everything in ASCII but letters and digits.
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
#: Entries of the table that most bigrams are ruled out by.
TABLE = 1 << 18


class Library(NamedTuple):
    """Templates as sorted bigram sets, by size."""

    names: list[str]
    sets: list[np.ndarray]
    sizes: np.ndarray
    every: np.ndarray
    table: np.ndarray
    lengths: np.ndarray  # in words
    owners: np.ndarray  # templates of each bigram of ``every``, one after the other
    cuts: np.ndarray
    numbers: list[set[int] | None]  # those in short templates


def bigrams(hashes: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(unit, bigram) of the words of ascending units; single words stand for themselves."""
    same = unit[1:] == unit[:-1]
    before, after = np.append(False, same), np.append(same, False)
    alone = np.flatnonzero(~before & ~after)
    pair = np.flatnonzero(same)
    at, h = np.concatenate([pair, alone]), np.concatenate([rolling(hashes, 2)[pair] if len(pair) else np.zeros(0, np.uint64), mix(hashes[alone])])
    order = np.argsort(at, kind="stable")
    return unit[at[order]], h[order]


def library(templates: Mapping[str, str] = TEMPLATES) -> Library:
    found = []
    for name, text in sorted(templates.items()):
        raw = LOWER[np.frombuffer(text.encode(), np.uint8)]
        w = words(raw, np.array([0, len(raw)]), NOT_ALNUM)
        if len(w.row):
            found.append((name, np.unique(bigrams(w.hash, w.row)[1]), len(w.row), _numbers(raw, w, 0, len(w.row)) if len(w.row) <= NOTICE else None))
    found.sort(key=lambda x: (len(x[1]), x[0]))
    every = np.unique(np.concatenate([s for _, s, _, _ in found]))
    at = np.searchsorted(every, np.concatenate([s for _, s, _, _ in found]))
    owners = np.repeat(np.arange(len(found)), [len(s) for _, s, _, _ in found])[np.argsort(at, kind="stable")]
    cuts = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(every)))])
    table = np.zeros(TABLE, bool)
    table[(every % np.uint64(TABLE)).astype(np.int64)] = True
    sizes, lengths = np.array([len(s) for _, s, _, _ in found]), np.array([n for _, _, n, _ in found])
    return Library([n for n, _, _, _ in found], [s for _, s, _, _ in found], sizes, every, table, lengths, owners, cuts, [x for _, _, _, x in found])


def _numbers(data: np.ndarray, w: Words, first: int, last: int) -> set[int]:
    """Hashes of the words from first to before last that begin with a digit."""
    head = data[w.start[first:last]]
    return set(w.hash[first:last][(head >= 0x30) & (head <= 0x39)].tolist())


def _other_version(lib: Library, t: int, data: np.ndarray, w: Words, first: int, last: int) -> bool:
    """Whether a place lacks numbers of a notice and has others, within two words behind it too."""
    if not lib.numbers[t]:
        return False
    stop = min(last + 3, int(np.searchsorted(w.row, w.row[first], "right")))
    here = _numbers(data, w, first, stop)
    return bool(lib.numbers[t] - here and here - lib.numbers[t])


def _known(lib: Library, h: np.ndarray) -> np.ndarray:
    """Whether bigrams are in any template."""
    out = lib.table[(h % np.uint64(TABLE)).astype(np.int64)]
    at = np.flatnonzero(out)
    k = np.minimum(np.searchsorted(lib.every, h[at]), len(lib.every) - 1)
    out[at] = lib.every[k] == h[at]
    return out


def _hits(lib: Library, hashes: np.ndarray, unit: np.ndarray, threshold: float) -> Iterator[tuple[int, int, float, int]]:
    """(unit, template, score, common bigrams) of all units that reach the threshold."""
    of, h = bigrams(hashes, unit)
    known = _known(lib, h)
    share = threshold / (2 - threshold)
    n = int(of[-1]) + 1 if len(of) else 0
    # repeats count here, so this bound only rules out units with fewer hits than the smallest template needs
    least = int(np.ceil(lib.sizes[0] * share))
    some = np.bincount(of[known], minlength=n) >= max(least, 1)
    keep = some[of]
    if not keep.any():
        return
    order = np.lexsort([h[keep], of[keep]])
    u, x, k = of[keep][order], h[keep][order], known[keep][order]
    new = np.concatenate([[True], (u[1:] != u[:-1]) | (x[1:] != x[:-1])])
    u, x, k = u[new], x[new], k[new]
    start = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]]))
    size = np.diff(np.append(start, len(u)))
    inside = np.add.reduceat(k.astype(np.int64), start)
    for s, m in zip(start[inside >= size * share - 1e-9].tolist(), size[inside >= size * share - 1e-9].tolist(), strict=True):
        own = x[s : s + m]
        for t in range(int(np.searchsorted(lib.sizes, m * share - 1e-9)), int(np.searchsorted(lib.sizes, m / share + 1e-9, "right"))):
            common = len(np.intersect1d(own, lib.sets[t], assume_unique=True))
            dice = 2 * common / (m + len(lib.sets[t]))
            if dice >= threshold:
                yield int(u[s]), t, dice, common


def _windows(lib: Library, hashes: np.ndarray, row: np.ndarray, threshold: float) -> Iterator[tuple[int, int, int, float, int]]:
    """(first word, last word, template, score, common bigrams) of windows of a template's number of words that reach the threshold, cut to known bigrams at both ends.

    Windows begin at every bigram of the template; only those with enough of its bigrams are compared. Of overlapping windows of a template the best stays.
    """
    h = rolling(hashes, 2)
    at = np.flatnonzero(row[1:] == row[:-1])
    at = at[_known(lib, h[at])] if len(at) else at
    if not len(at):
        return
    k = np.searchsorted(lib.every, h[at])
    n = lib.cuts[k + 1] - lib.cuts[k]
    owner = lib.owners[np.repeat(lib.cuts[k] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
    order = np.argsort(owner, kind="stable")
    place, count = np.repeat(at, n)[order], np.bincount(owner, minlength=len(lib.names))
    share, first = threshold / (2 - threshold), 0
    for t in np.flatnonzero(count).tolist():
        own = place[first : first + count[t]]
        first += int(count[t])
        width = int(lib.lengths[t]) - 1
        if width < 1 or len(own) < lib.sizes[t] * share - 1e-9:
            continue
        stop = np.minimum(own + width, np.searchsorted(row, row[own], "right") - 1)
        enough = np.searchsorted(own, stop) - np.arange(len(own)) >= lib.sizes[t] * share - 1e-9
        begin, stop = own[enough], stop[enough]
        for part in np.split(np.arange(len(begin)), np.flatnonzero(begin[1:] >= stop[:-1]) + 1):
            yield from _best(lib, t, h, own, begin[part], stop[part], threshold) if len(part) else ()


def _best(lib: Library, t: int, h: np.ndarray, own: np.ndarray, begin: np.ndarray, stop: np.ndarray, threshold: float) -> Iterator[tuple[int, int, int, float, int]]:
    """Hits among windows that hang together, which begin and stop at these bigrams; ``own`` are the places of the template's bigrams."""
    low, size = int(begin[0]), int(lib.sizes[t])
    value = h[low : int(stop[-1])].tolist()
    ours = np.zeros(len(value), bool)
    ours[own[np.searchsorted(own, low) : np.searchsorted(own, stop[-1])] - low] = True
    is_ours = ours.tolist()
    inside: Counter = Counter()
    a = z = common = 0
    found = []
    for s, e in zip((begin - low).tolist(), (stop - low).tolist(), strict=True):
        for i in range(z, e):
            inside[value[i]] += 1
            common += is_ours[i] and inside[value[i]] == 1
        z = e
        for i in range(a, s):
            inside[value[i]] -= 1
            if not inside[value[i]]:
                del inside[value[i]]
                common -= is_ours[i]
        a = s
        # the window without what follows its last known bigram has no lower score
        if 2 * common >= threshold * (common + size) - 1e-9:
            found.append((2 * common / (len(inside) + size), s, e))
    taken = np.zeros(len(value), bool)
    for _, s, e in sorted(found, key=lambda x: (-x[0], x[1])):
        e = s + int(np.flatnonzero(ours[s:e])[-1]) + 1
        if taken[s:e].any():
            continue
        u = set(value[s:e])
        common = len({v for v, x in zip(value[s:e], is_ours[s:e], strict=True) if x})
        dice = 2 * common / (len(u) + size)
        if dice >= threshold:
            taken[s:e] = True
            yield low + s, low + e, t, dice, common


def _units(data: np.ndarray, offsets: np.ndarray, row: np.ndarray, start: np.ndarray) -> dict[str, np.ndarray]:
    """The unit of every word, numbered in reading order, for each way of taking texts apart."""
    breaks = np.flatnonzero(data == 0x0A)
    # an empty line: a line feed whose next line feed has only white space between
    filled = np.concatenate([[0], np.cumsum(~np.isin(data, (0x20, 0x09, 0x0D, 0x0A)))])
    gaps = breaks[:-1][filled[breaks[:-1]] == filled[breaks[1:]]] if len(breaks) > 1 else breaks[:0]
    # numbers of ends and of rows before a word together number the units
    return {"line": np.searchsorted(breaks, start) + row, "paragraph": np.searchsorted(gaps, start) + row, "text": row}


def _written(hits: set) -> str:
    return ",".join(f"{k}:{n}:{s}:{e}:{v:.4f}" for s, e, k, n, v in sorted(hits))


def licenses(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, license, score, n_hits, hits, n_windows, windows) of every row: the best template, and all hits as unit:template:start:end:score."""
    lib = library(templates)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = column_bytes(b.column(1))
            found: list[set] = [set() for _ in range(b.num_rows)]
            windows: list[set] = [set() for _ in range(b.num_rows)]
            named: list[list] = [[] for _ in range(b.num_rows)]
            for a, z in runs(offsets):
                own, offs = data[offsets[a] : offsets[z]], offsets[a : z + 1] - offsets[a]
                w = words(LOWER[own], offs, NOT_ALNUM)
                if not len(w.row):
                    continue
                hits = [
                    (int(np.searchsorted(unit, u)), int(np.searchsorted(unit, u, "right")) - 1, kind, *hit)
                    for kind, unit in _units(own, offs, w.row, w.start).items() for u, *hit in _hits(lib, w.hash, unit, threshold)
                ]
                hits += [(first, last, "window", *hit) for first, last, *hit in _windows(lib, w.hash, w.row, threshold)]
                for first, last, kind, t, score, common in hits:
                    r = int(w.row[first])
                    chars = lambda at, r=r: len(own[offs[r] : at].tobytes().decode())
                    (windows if kind == "window" else found)[a + r].add((chars(w.start[first]), chars(w.end[last]), kind, lib.names[t], score))
                    if not _other_version(lib, t, own, w, first, last):
                        named[a + r].append((score, common, lib.names[t]))
            top = [max(x[0] for x in f) if f else 0.0 for f in named]
            best = [min(((-c, -v, n) for v, c, n in f if v >= m - NEAR), default=None) for f, m in zip(named, top, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([None if x is None else x[2] for x in best], pa.string()),
                    pa.array([0.0 if x is None else -x[1] for x in best], pa.float64()),
                    pa.array([len(f) for f in found], pa.int64()),
                    pa.array([_written(f) for f in found], pa.string()),
                    pa.array([len(f) for f in windows], pa.int64()),
                    pa.array([_written(f) for f in windows], pa.string()),
                ],
                names=["_id", "license", "score", "n_hits", "hits", "n_windows", "windows"],
            )

    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(
        each, f"_id {id_type}, license string, score double, n_hits bigint, hits string, n_windows bigint, windows string"
    )
