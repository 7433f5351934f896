"""Threshold-scaled sketches of word shingles: every hash below a fixed fraction of the range is kept.

The number kept grows with the document, so sketches merge by union and containment can be estimated between a page and a book.
A text none of whose hashes is below keeps its smallest one (dropped again by a merge with anything below).

For the edited text of a document, documents are range-partitioned by id with splitters from a sample of the ids; each
range also gets the first row of the next, so neighbours meet without a second shuffle of texts. A task streams its sorted rows.

Defined results: NULL counts as empty; texts without words have the empty fingerprint, and are like each other (1.0) and unlike all
others (0.0); fewer words than a shingle make one shingle. Rows are ordered by id, rows of one id by the hash of the text, NULL ids
come last; after the last row comes the first, after an only row itself. Ids are whole numbers. Other columns are never read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .words import column_bytes, runs, shingles, words

WIDTH = 5
#: One hash of KEEP_ONE_OF is kept; BYTES of each are written.
KEEP_ONE_OF, BYTES = 4, 6
LIMIT = np.uint64((1 << 64) // KEEP_ONE_OF)
#: Ids sampled for the splitters, per range.
SAMPLES_PER_RANGE = 20


def sketches(column: pa.Array) -> list[np.ndarray]:
    """Sorted kept hashes of each text."""
    out = []
    data, offsets = column_bytes(column)
    for a, b in runs(offsets):
        n = b - a
        rows, h = shingles(words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]), n, WIDTH)
        kept = h < LIMIT
        cut, whole = np.searchsorted(rows[kept], np.arange(n + 1)), np.searchsorted(rows, np.arange(n + 1))
        low = h[kept]
        for k in range(n):
            own = low[cut[k] : cut[k + 1]]
            if not len(own) and whole[k] < whole[k + 1]:
                own = h[whole[k] : whole[k + 1]].min(keepdims=True)
            out.append(np.unique(own >> np.uint64(64 - 8 * BYTES)))
    return out


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of two texts together."""
    both = np.union1d(a, b)
    below = both[both < LIMIT >> np.uint64(64 - 8 * BYTES)]
    return below if len(below) else both[:1]


def written(sketch: np.ndarray) -> str:
    return base64.b64encode(sketch.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :BYTES].tobytes()).decode()


def read(fingerprint: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(fingerprint), np.uint8).reshape(-1, BYTES)
    return np.hstack([raw, np.zeros((len(raw), 8 - BYTES), np.uint8)]).view("<u8").ravel().astype(np.uint64)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard similarity."""
    if not len(a) and not len(b):
        return 1.0
    both = np.sort(np.concatenate([a, b]))
    common = int((both[1:] == both[:-1]).sum())
    return common / (len(both) - common)


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated part of the first text's shingles that the second has."""
    return len(np.intersect1d(a, b, assume_unique=True)) / len(a) if len(a) else 1.0


def edited(text: str, after: str) -> str:
    """``text`` with its last quarter replaced by the beginning of ``after``."""
    k = len(text) // 4
    return text[: len(text) - k] + after[:k]


def _with_next(docs: DataFrame, id_col: str, text_col: str, ranges: int) -> DataFrame:
    """(_range, _end, _id, _text), range-partitioned and sorted; rows with _end come last in a range and belong to the next."""
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    ids = rows.select("_id").filter("_id is not null")
    n = ids.count()
    part = min(1.0, ranges * SAMPLES_PER_RANGE / max(n, 1))
    sample = sorted(r["_id"] for r in ids.filter(F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) < int(part * (1 << 30))).collect())
    splitters = sorted({sample[len(sample) * k // ranges] for k in range(1, ranges)}) if sample else []
    bounds = F.split(F.lit(",".join(map(str, splitters))), ",").cast("array<bigint>") if splitters else F.array().cast("array<bigint>")
    steps = [1 << k for k in reversed(range(len(splitters).bit_length()))] or [1]
    found = F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda at, s: F.when(F.get(bounds, at + s - 1) <= F.col("_id"), at + s).otherwise(at))
    # rows without id: sixteen ranges of the text's hash, after all others
    hashed = rows.withColumn("_hash", F.xxhash64("_text"))
    placed = hashed.withColumn("_range", F.when(F.col("_id").isNull(), len(splitters) + 9 + F.shiftright("_hash", 60).cast("int")).otherwise(found))
    heads = placed.groupBy("_range").agg(F.min(F.struct("_id", "_hash")).alias("_key"))
    # one row per range: far fewer than documents; the last range is followed by the first
    order = Window.orderBy("_range")
    heads = heads.withColumn("_to", F.coalesce(F.lag("_range").over(order), F.max("_range").over(Window.partitionBy(F.lit(0)))))
    heads = heads.select(F.col("_range").alias("_r"), "_key", "_to")
    ends = (
        placed.join(F.broadcast(heads), (F.col("_range") == F.col("_r")) & F.col("_id").eqNullSafe(F.col("_key._id")) & (F.col("_hash") == F.col("_key._hash")))
        .dropDuplicates(["_range"]).select(F.col("_to").alias("_range"), F.lit(True).alias("_end"), "_id", "_hash", "_text")
    )
    every = placed.select("_range", F.lit(False).alias("_end"), "_id", "_hash", "_text").unionByName(ends)
    return every.repartitionById(ranges, "_range").sortWithinPartitions("_range", "_end", F.col("_id").asc_nulls_last(), "_hash")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """(_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, in_edited) of every row."""
    if ranges is None:
        ranges = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None  # (range, id, text, sketch) of the row that waits for its next
        for b in batches:
            if not b.num_rows:
                continue
            own = sketches(b.column(4))
            done = []
            for at, end, i, text, sketch in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(4).to_pylist(), own, strict=True):
                if before is not None and before[0] == at:
                    done.append((*before[1:], text, sketch))
                before = None if end else (at, i, text, sketch)
            for k in range(0, len(done), 1000):
                part = done[k : k + 1000]
                texts = [edited(text, after) for _, text, _, after, _ in part]
                changed = sketches(pa.array(texts, pa.string()))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([x[0] for x in part], pa.int64()),
                        pa.array([len(x[1]) for x in part], pa.int64()),
                        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts]),
                        pa.array([written(x[2]) for x in part]),
                        pa.array([written(s) for s in changed]),
                        pa.array([likeness(x[2], s) for x, s in zip(part, changed, strict=True)]),
                        pa.array([likeness(x[2], x[4]) for x in part]),
                        pa.array([containment(x[2], s) for x, s in zip(part, changed, strict=True)]),
                    ],
                    names=NAMES,
                )

    return _with_next(docs, id_col, text_col, ranges).mapInArrow(each, ", ".join(f"{n} {k}" for n, k in zip(NAMES, KINDS, strict=True)))


NAMES = ["_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "in_edited"]
KINDS = ["bigint", "bigint", "string", "string", "string", "double", "double", "double"]
