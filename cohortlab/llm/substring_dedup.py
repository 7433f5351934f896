"""Repeated passages: every window of WINDOW words that also starts in a document with a smaller id is removed.

* A window's minimiser is the smallest hash among its runs of MINIMISER words. Consecutive windows with one minimiser travel as one packed
  string (a super-k-mer) to the minimiser's bucket: about three words are sent per window instead of thirteen.
* A task sends one compressed block per bucket and batch.
* In a bucket the words become numbers (exactly, by a dictionary), equal windows are brought together by sorting, and the smallest id
  of each is taken. Hashes only order the rows: neighbours are compared word by word, and on a collision all 13 numbers are sorted.
* Minimisers that a sample finds often enough to fill a bucket (a passage that very many documents share) are dealt over several
  parts by id. Parts give the smallest id of each of their windows; a join over parts (by a 128-bit digest of the window, at most
  one row per part and window) gives the smallest of all. The sample only decides the way; every window is counted.

Defined results: NULL and empty texts have no words; NULL ids are greater than all others (and equal among themselves); rows
that repeat with their id have no smaller one, so they remove nothing from each other. Ids are whole numbers. Other columns are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlab.session import cut_lineage

from .words import Words, column_bytes, mix, rolling, runs, words

WINDOW, MINIMISER = 13, 2
#: Bytes of text per bucket, about; its super-k-mers are some three times as many.
BUCKET_BYTES = 4 << 20
#: Rows sampled for frequent minimisers (one in so many), the buckets' worth that makes one frequent, and the most that are listed:
#: the shares sum to 1, so beyond that many none is large.
SAMPLE_ONE_OF, HOT_SHARE, MOST_HOT = 64, 1.5, 10_000
#: Windows in the sample that a frequent minimiser has at least: more than a handful of documents could make.
LEAST_SAMPLED = 200.0
#: The id that stands for NULL.
NO_ID = np.iinfo(np.int64).max
SPACE = 0x20
#: Of compression: packed strings are most of what is shuffled.
LEVEL = 6


def _minimisers(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, number of windows, minimiser) of all super-k-mers, in reading order."""
    n = len(w.row) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    pair = rolling(w.hash, MINIMISER)
    least = pair[:n].copy()
    for k in range(1, WINDOW - MINIMISER + 1):
        np.minimum(least, pair[k : k + n], out=least)
    whole = w.row[:n] == w.row[WINDOW - 1 :]
    at = np.flatnonzero(whole)
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least = least[at]
    new = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (least[1:] != least[:-1]) | (w.row[at[1:]] != w.row[at[:-1]])])
    start = np.flatnonzero(new)
    return at[start], np.diff(np.append(start, len(at))), least[start]


def _gather(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The byte ranges one after the other, and where each begins."""
    size = end - start
    offsets = np.concatenate([[0], np.cumsum(size)])
    return data[np.repeat(start - offsets[:-1], size) + np.arange(offsets[-1])], offsets


def _frequent(rows: DataFrame, buckets: int) -> dict[int, int]:
    """Parts by minimiser, for those that would fill a bucket."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = column_bytes(b.column(0))
            for a, z in runs(offsets):
                _, n, least = _minimisers(words(data[offsets[a] : offsets[z]], offsets[a : z + 1] - offsets[a]))
                kind, at = np.unique(least, return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(kind.view(np.int64)), pa.array(np.bincount(at, n, minlength=len(kind)))], names=["m", "windows"])

    sample = rows.filter(F.pmod(F.xxhash64("_id", "_text"), F.lit(SAMPLE_ONE_OF)) == 0).select("_text")
    counts = cut_lineage(sample.mapInArrow(each, "m bigint, windows double").groupBy("m").agg(F.sum("windows").alias("windows")))
    total = counts.agg(F.sum("windows")).first()[0] or 0.0
    limit = max(HOT_SHARE * total / buckets, LEAST_SAMPLED)
    return {r["m"]: 2 + int(r["windows"] / limit) for r in counts.filter(F.col("windows") > limit).orderBy(F.desc("windows")).limit(MOST_HOT).collect()}


def _packed(rows: DataFrame, buckets: int, hot: dict[int, int]) -> DataFrame:
    """(part, block): the super-k-mers of a batch for a part. Buckets are parts 0 to ``buckets`` - 1, parts of frequent minimisers follow."""
    known = np.array(sorted(hot), np.int64)
    parts_of = np.array([hot[m] for m in sorted(hot)], np.int64)
    first_part = buckets + np.concatenate([[0], np.cumsum(parts_of)])[:-1] if len(known) else np.zeros(0, np.int64)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=LEVEL)
        for b in batches:
            every, tags = b.column(0).to_numpy(), b.column(1).to_numpy()
            data, offsets = column_bytes(b.column(2))
            for a, z in runs(offsets, 16 << 20):
                own = data[offsets[a] : offsets[z]]
                w = words(own, offsets[a : z + 1] - offsets[a])
                at, n, least = _minimisers(w)
                if not len(at):
                    continue
                ids, tag = every[a:z][w.row[at]], tags[a:z][w.row[at]]
                part = (least % np.uint64(buckets)).astype(np.int64)
                if len(known):
                    signed = least.view(np.int64)
                    k = np.minimum(np.searchsorted(known, signed), len(known) - 1)
                    is_hot = known[k] == signed
                    dealt = mix(ids.astype(np.uint64)) % parts_of[k].astype(np.uint64)
                    part = np.where(is_hot, first_part[k] + dealt.astype(np.int64), part)
                order = np.argsort(part, kind="stable")
                cut = np.flatnonzero(np.diff(part[order], prepend=-1))
                place = at - np.searchsorted(w.row, w.row[at])  # the word's number in its row
                out, padded = [], np.append(own, np.uint8(SPACE))
                for lo, hi in zip(cut.tolist(), [*cut[1:].tolist(), len(order)], strict=True):
                    s = order[lo:hi]
                    # every string has n + 12 words; each word is followed by one space, so no lengths are needed
                    size = n[s] + WINDOW - 1
                    word = np.repeat(at[s] - np.concatenate([[0], np.cumsum(size)])[:-1], size) + np.arange(size.sum())
                    text, o = _gather(padded, w.start[word], w.end[word] + 1)
                    text[o[1:] - 1] = SPACE
                    head = np.concatenate([[len(s)], np.diff(ids[s], prepend=0), place[s], n[s]]).astype("<i8").tobytes()
                    out.append((int(part[s[0]]), squeeze.compress(head + tag[s].astype("<i8").tobytes() + text.tobytes())))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p for p, _ in out], pa.int64()), pa.array([x for _, x in out], pa.binary())], names=["part", "block"]
                )

    return rows.select("_id", "_tag", "_text").mapInArrow(each, "part bigint, block binary")


class Windows:
    """The windows of a part: who has them, where, and their words as numbers."""

    def __init__(self, blocks: list[bytes]):
        loose = zstandard.ZstdDecompressor()
        heads, tags, texts = [], [], []
        for block in blocks:
            raw = loose.decompress(block)
            k = int(np.frombuffer(raw, "<i8", 1)[0])
            head = np.frombuffer(raw, "<i8", 3 * k, 8).reshape(3, k)
            heads.append(np.vstack([np.cumsum(head[0]), head[1:]]))
            tags.append(np.frombuffer(raw, "<i8", k, 8 + 24 * k))
            texts.append(np.frombuffer(raw, np.uint8, offset=8 + 32 * k))
        ids, place, n = np.hstack(heads)
        text = np.concatenate(texts)
        w = words(text, np.array([0, len(text)]))
        own, offsets = _gather(text, w.start, w.end)
        del w, text, texts
        column = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(own)])
        coded = column.dictionary_encode()
        self.dictionary, self.word = coded.dictionary, coded.indices.to_numpy()
        # a string of n windows has n + 12 words; columns from here on have one entry per window
        string = np.repeat(np.arange(len(n)), n)
        within = np.arange(len(string)) - np.repeat(np.concatenate([[0], np.cumsum(n)])[:-1], n)
        self.at = np.concatenate([[0], np.cumsum(n + WINDOW - 1)])[:-1][string] + within
        self.id, self.tag, self.place = ids[string], np.concatenate(tags)[string], place[string] + within

    def by_content(self) -> tuple[np.ndarray, np.ndarray]:
        """(order, start): windows with equal ones together, and where each group starts."""
        key = rolling(mix(self.word.astype(np.uint64)), WINDOW)[self.at]
        order = np.argsort(key, kind="stable")
        k = key[order]
        same = k[1:] == k[:-1]
        i, j = self.at[order[1:][same]], self.at[order[:-1][same]]
        if not all((self.word[i + d] == self.word[j + d]).all() for d in range(WINDOW)):  # two windows with one hash
            order = np.lexsort([self.word[self.at + d] for d in range(WINDOW)])
            same = np.ones(len(order) - 1, bool)
            for d in range(WINDOW):
                x = self.word[self.at[order] + d]
                same &= x[1:] == x[:-1]
        return order, np.flatnonzero(np.concatenate([[True], ~same]))

    def names(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit digests of windows, the same in every part, made of 128-bit digests of their words."""
        raw = b"".join(hashlib.blake2b(w, digest_size=16).digest() for w in self.dictionary.to_pylist())
        halves = np.frombuffer(raw, "<u8").reshape(-1, 2)
        return tuple(rolling(halves[:, k][self.word], WINDOW)[self.at[which]].view(np.int64) for k in (0, 1))


RANGES = "id bigint, tag bigint, place bigint, n bigint"
FOUND = f"{RANGES}, name1 bigint, name2 bigint, least bigint, ids array<bigint>, places array<bigint>, tags array<bigint>"


def _ranges(id_: np.ndarray, tag: np.ndarray, place: np.ndarray) -> dict[str, pa.Array]:
    """Windows as ranges of windows, neighbours joined."""
    order = np.lexsort([place, tag, id_])
    i, t, p = id_[order], tag[order], place[order]
    new = np.flatnonzero(np.concatenate([[True], (i[1:] != i[:-1]) | (t[1:] != t[:-1]) | (p[1:] != p[:-1] + 1)])) if len(i) else np.zeros(0, np.int64)
    n = np.diff(np.append(new, len(i)))
    return {"id": pa.array(i[new]), "tag": pa.array(t[new], pa.int64()), "place": pa.array(p[new]), "n": pa.array(n)}


def _counted(buckets: int):
    """For a bucket: the ranges of windows that start in a row with a smaller id too. For a part of a frequent minimiser: its windows,
    the smallest id of each, and who has them."""

    def of(table: pa.Table) -> pa.Table:
        w = Windows(table["block"].to_pylist())
        order, start = w.by_content()
        least = np.minimum.reduceat(w.id[order], start)
        if table["part"][0].as_py() < buckets:
            later = order[w.id[order] > np.repeat(least, np.diff(np.append(start, len(order))))]
            own = _ranges(w.id[later], w.tag[later], w.place[later])
        else:
            name1, name2 = w.names(order[start])
            offsets = pa.array(np.append(start, len(order)), pa.int32())
            lists = {"ids": w.id, "places": w.place, "tags": w.tag}
            own = {"name1": pa.array(name1), "name2": pa.array(name2), "least": pa.array(least)}
            own |= {k: pa.ListArray.from_arrays(offsets, pa.array(v[order])) for k, v in lists.items()}
        n = len(next(iter(own.values())))
        kinds = {"ids": pa.list_(pa.int64()), "places": pa.list_(pa.int64()), "tags": pa.list_(pa.int64())}
        names = [c.split(" ")[0] for c in FOUND.split(", ")]
        return pa.table({c: own.get(c, pa.nulls(n, kinds.get(c, pa.int64()))) for c in names})

    return of


def _later_holders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        least, ids, places, tags = b.columns
        n = np.diff(ids.offsets.to_numpy())
        later = ids.flatten().to_numpy() > np.repeat(least.to_numpy(), n)
        yield pa.RecordBatch.from_pydict(_ranges(*(x.flatten().to_numpy(zero_copy_only=False)[later] for x in (ids, tags, places))))


def _removed(rows: DataFrame) -> DataFrame:
    """(id, tag, place, n): ranges of windows to be removed."""
    whole = rows.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    buckets = max(1, whole // BUCKET_BYTES)
    hot = _frequent(rows, buckets)
    found = _packed(rows, buckets, hot).groupBy("part").applyInArrow(_counted(buckets), FOUND)
    names = [c.split(" ")[0] for c in RANGES.split(", ")]
    if not hot:
        return found.select(*names)
    found = cut_lineage(found)
    parts = found.filter("least is not null")
    least = parts.groupBy("name1", "name2").agg(F.min("least").alias("least"))
    met = parts.select("name1", "name2", "ids", "places", "tags").join(least, ["name1", "name2"]).select("least", "ids", "places", "tags")
    return found.filter("least is null").select(*names).unionByName(met.mapInArrow(_later_holders, RANGES))


def _without(data: np.ndarray, offsets: np.ndarray, removed: list[tuple[list[int], list[int]] | None]) -> Iterator[tuple[int, int, bytes]]:
    """(words, words removed, the others joined by one space) of each row."""
    w = words(data, offsets)
    count = np.bincount(w.row, minlength=len(removed))
    first = np.concatenate([[0], np.cumsum(count)])
    change = np.zeros(len(w.row) + 1, np.int64)
    for r, found in enumerate(removed):
        if found is not None:
            place, n = (np.array(x, np.int64) for x in found)
            np.add.at(change, first[r] + place, 1)
            np.add.at(change, first[r] + place + n + WINDOW - 1, -1)
    kept = np.cumsum(change[:-1]) == 0
    # each word with the byte after it, which becomes a space
    text, o = _gather(np.append(data, np.uint8(SPACE)), w.start[kept], w.end[kept] + 1)
    text[o[1:] - 1] = SPACE
    left = np.bincount(w.row[kept], minlength=len(removed))
    cut = o[np.concatenate([[0], np.cumsum(left)])]
    for r in range(len(removed)):
        yield int(count[r]), int(count[r] - left[r]), text[cut[r] : cut[r + 1] - (left[r] > 0)].tobytes()


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """(_id, n_words, n_removed, kept_sha256) of every row, and kept_text on demand."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    # the tag tells rows apart whose id repeats with another text: 64 bits of the text, nothing where no id repeats
    again = docs.groupBy(own.alias("_id")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count()
    tag = F.xxhash64(text) if again else F.lit(0).cast("long")
    rows = docs.select(F.col(id_col).cast("long").alias("_given"), own.alias("_id"), tag.alias("_tag"), text.alias("_text"))
    ranges = _removed(rows).groupBy("id", "tag").agg(F.collect_list("place").alias("place"), F.collect_list("n").alias("n"))
    met = rows.join(ranges, (F.col("_id") == F.col("id")) & (F.col("_tag") == F.col("tag")), "left").select("_given", "_text", "place", "n")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = column_bytes(b.column(1))
            for a, z in runs(offsets):
                place, n = (b.column(k).slice(a, z - a).to_pylist() for k in (2, 3))
                removed = [None if x is None else (x, y) for x, y in zip(place, n, strict=True)]
                found = list(_without(data[offsets[a] : offsets[z]], offsets[a : z + 1] - offsets[a], removed))
                columns = [
                    b.column(0).slice(a, z - a), pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64()),
                    pa.array([hashlib.sha256(x[2]).hexdigest() for x in found], pa.string()),
                ]
                if with_text:
                    columns.append(pa.array([x[2].decode() for x in found], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=["_id", "n_words", "n_removed", "kept_sha256", "kept_text"][: len(columns)])

    return met.mapInArrow(each, "_id bigint, n_words bigint, n_removed bigint, kept_sha256 string" + ", kept_text string" * with_text)
