"""Importance resampling of documents towards the text of a target table.

1. Features are runs of consecutive words; a feature's bucket is the CRC-32 of its bytes modulo the number of buckets. Tasks count buckets
   in arrays; the log ratios of target to corpus (``gains``), one number per bucket, go to the driver and back as an array.
2. A second scan scores every document: the mean gain of its features plus Gumbel noise drawn from a hash of its id, so taking the highest
   scores samples without replacement. (id, words, features, weight, score) are written to the shared folder, no texts.
3. The cutoff is found by bisection on the number itself: a job counts exactly how many rows lie at or above some thresholds, which
   halves the range LEVELS times, until the range is one number. Ties at the cutoff are cut by the id in the same way, and rows
   that repeat with id and score by their row number. Nothing is sorted to find the cutoff, and each job returns a few counts.
4. Only the drawn rows are range-partitioned, by (score, id, row number), so no tie fills a range; a row's rank is its position in its
   partition plus the rows of the partitions before.

Defined results: NULL texts and texts without words have no features, weight 0 and a score, and are not drawn where a least number of
words is asked for; NULL ids hash like empty ones and rank behind others of the same score; equal rows are ranked in any order; an
empty table gives an empty result, an empty target gains from T = 0. Other columns are never read. Ids are whole numbers.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlab.session import cut_lineage

from .words import LOWER, column_bytes, runs, words

#: Bytes that separate words: all of ASCII but digits and letters (after lower-casing).
SEPARATORS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
#: Halvings of a range per counting job.
LEVELS = 4
#: Longer words are hashed one by one.
SHORT = 40


def _crc_table() -> np.ndarray:
    crc = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        crc = np.where(crc & 1, (crc >> 1) ^ np.uint32(0xEDB88320), crc >> 1)
    return crc


CRC = _crc_table()


def crc_after(before: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of what ``before`` stands for, followed by data[start:end]; arrays of equal length."""
    crc = ~before
    length = end - start
    live = np.flatnonzero((length > 0) & (length <= SHORT))
    for k in range(int(length[live].max()) if len(live) else 0):
        live = live[length[live] > k]
        now = crc[live]
        crc[live] = CRC[(now ^ data[start[live] + k]) & 0xFF] ^ (now >> np.uint32(8))
    out = ~crc
    for k in np.flatnonzero(length > SHORT).tolist():
        out[k] = zlib.crc32(data[start[k] : end[k]].tobytes(), int(before[k]))
    return out


def features(column: pa.Array, longest: int, buckets: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, last row, words of each row, row of each feature, its bucket) for runs of rows of bounded size."""
    data, offsets = column_bytes(column)
    blank = np.array([0x20], np.uint8)
    for a, b in runs(offsets):
        own = LOWER[data[offsets[a] : offsets[b]]]
        w = words(own, offsets[a : b + 1] - offsets[a], SEPARATORS)
        now = crc_after(np.zeros(len(w.row), np.uint32), own, w.start, w.end)
        rows, crcs = [w.row], [now]
        for n in range(1, min(longest, len(w.row))):
            # a run of n words, a blank, and the word that follows in the same row
            here = np.flatnonzero(w.row[:-n] == w.row[n:])
            spaced = crc_after(now[here], blank, np.zeros(len(here), np.int64), np.ones(len(here), np.int64))
            now = np.zeros(len(w.row) - n, np.uint32)
            now[here] = crc_after(spaced, own, w.start[here + n], w.end[here + n])
            rows.append(w.row[here])
            crcs.append(now[here])
        yield a, b, np.bincount(w.row, minlength=b - a), np.concatenate(rows), (np.concatenate(crcs) % np.uint32(buckets)).astype(np.int64)


def bucket_counts(docs: DataFrame, text_col: str, longest: int, buckets: int) -> np.ndarray:
    """How many features of all texts fall into each bucket."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(buckets, np.int64)
        for b in batches:
            for _, _, _, _, at in features(b.column(0), longest, buckets):
                count += np.bincount(at, minlength=buckets)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(count[some])], names=["bucket", "n"])

    counted = docs.select(F.col(text_col).alias("_text")).mapInArrow(each, "bucket bigint, n bigint")
    out = np.zeros(buckets, np.int64)
    for r in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # one row per bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the smoothed ratio) of every bucket, in doubles."""
    buckets = len(corpus)
    s_all, t_all = float(corpus.sum() + buckets), float(target.sum() + buckets)
    return np.array([math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def noise(name: str) -> int:
    """Gumbel noise from a hash, in thousandths."""
    h = int(hashlib.sha256(name.encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", longest: int = 1, seed: int = 2024) -> DataFrame:
    """(_id, n_words, n_features, weight, score) of every row."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_pylist()
            for first, last, n_words, row, at in features(b.column(1), longest, len(gain)):
                n = np.bincount(row, minlength=last - first)
                total = np.bincount(row, gain[at], minlength=last - first).astype(np.int64)  # whole numbers, exact in doubles
                weight = np.where(n > 0, total // np.maximum(n, 1), 0)
                drawn = [noise(f"{seed}:{'' if i is None else i}") for i in ids[first:last]]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(first, last - first), pa.array(n_words.astype(np.int64)), pa.array(n), pa.array(weight), pa.array(weight + np.array(drawn, np.int64))],
                    names=["_id", "n_words", "n_features", "weight", "score"],
                )

    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(
        each, f"_id {id_type}, n_words bigint, n_features bigint, weight bigint, score bigint"
    )


def cutoff(rows: DataFrame, key: Column, wanted: int) -> tuple[int, int]:
    """(c, n): c is the greatest number that ``wanted`` rows or more reach with ``key``; n rows are above it.

    Bisection by exact counts: a job counts at 2^LEVELS - 1 thresholds between what too few and what enough rows reach.
    """
    ends = rows.agg(F.min(key).alias("low"), F.max(key).alias("high")).first()
    enough, few, above = ends["low"], ends["high"] + 1, 0  # all rows reach ``enough``, ``above`` of them ``few``
    while few - enough > 1:
        parts = min(1 << LEVELS, few - enough)
        at = [enough + (few - enough) * k // parts for k in range(1, parts)]
        reach = rows.agg(*[F.count_if(key >= F.lit(x)).alias(f"n{k}") for k, x in enumerate(at)]).first()
        hits = [(x, n) for x, n in zip(at, reach, strict=True)]
        more = [(x, n) for x, n in hits if n >= wanted]
        less = [(x, n) for x, n in hits if n < wanted]
        if more:
            enough = more[-1][0]
        if less:
            few, above = less[0]
    return enough, above


def draw(rows: DataFrame, wanted: int) -> Column:
    """Which of (score, _id, row) belong to the ``wanted`` highest scores; ties to smaller ids, NULL ids last, then smaller row numbers."""
    if wanted <= 0:
        return F.lit(False)
    taken, tied = F.lit(False), F.lit(True)
    for key, known in ((F.col("score"), None), (F.bitwise_not("_id"), "_id"), (F.bitwise_not("row"), None)):
        own = rows.filter(tied)
        if known is not None:  # NULL ids come behind all others
            named = own.filter(F.col(known).isNotNull()).count()
            if named < wanted:
                taken, tied, wanted = taken | (tied & F.col(known).isNotNull()), tied & F.col(known).isNull(), wanted - named
                continue
            tied = tied & F.col(known).isNotNull()
            own = rows.filter(tied)
        c, above = cutoff(own, key, wanted)
        taken, tied, wanted = taken | (tied & (key > F.lit(c))), tied & (key == F.lit(c)), wanted - above
        if rows.filter(tied).count() == wanted:
            return F.coalesce(taken | tied, F.lit(False))
    return F.coalesce(taken | tied, F.lit(False))


def ranked(rows: DataFrame, partitions: int) -> DataFrame:
    """``rows`` with their rank by (score, _id, row)."""
    order = [F.col("score").desc(), F.col("_id").asc_nulls_last(), F.col("row")]
    placed = cut_lineage(rows.repartitionByRange(partitions, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    held = sorted((r["part"], r["n"]) for r in placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    before, total = {}, 0
    for p, n in held:
        before[p] = total
        total += n
    starts = F.array(*[F.lit(before.get(p, 0)).cast("long") for p in range(held[-1][0] + 1)]) if held else F.array(F.lit(0).cast("long"))
    at = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn("rank", F.get(starts, part.cast("int")) + at + 1).drop("_at")


def resample(
    docs: DataFrame, target: DataFrame, share: tuple[int, int] = (10, 100), id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
    longest: int = 1, buckets: int = 10_000, seed: int = 2024, least_words: int = 20,
) -> DataFrame:
    """(_id, n_features, weight, score, rank) of every row; ``share`` of the rows with ``least_words`` words are drawn."""
    gain = gains(bucket_counts(docs, text_col, longest, buckets), bucket_counts(target, target_col, longest, buckets))
    # the row number tells rows apart that repeat; it is fixed by the checkpoint
    rows = cut_lineage(scored(docs, gain, id_col, text_col, longest, seed).withColumn("row", F.monotonically_increasing_id()))
    long_enough = F.col("n_words") >= least_words
    wanted = share[0] * rows.filter(long_enough).count() // share[1]
    chosen = draw(rows.filter(long_enough), wanted)
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    top = ranked(rows.filter(long_enough & chosen), partitions)
    rest = rows.filter(~(long_enough & chosen)).withColumn("rank", F.lit(None).cast("long"))
    return top.unionByName(rest).select("_id", "n_features", "weight", "score", "rank")
