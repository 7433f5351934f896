"""Shards of nearly equal bytes by sampled splitters, with DataFrame operations alone.

Rows are ordered by (hash of the text, hash of the id), so equal texts lie together and even a group of copies can be cut.

1. Size-weighted key samples: a row is drawn with a probability in proportion to its bytes, decided by a hash, so a
   second run draws the same ones. The sample's size follows the number of ranges, not the rows.
2. Weighted quantiles of the sample are the splitters; every row finds its range by binary search.
3. Ranges that came out overfull (rows or bytes) are subdivided by splitters sampled in them, until none is.
4. A range fits one task: running sums inside it, on top of the totals of the ranges before, give every row its exact
   position; shard k takes the rows whose middle lies between k and k + 1 parts of the total, so an end is off by half a row at most.

Repeated rows (equal id and text) are counted first and dealt out one by one at the end, so they cannot overfill a range.

Defined results: NULL texts have size 1 and the CRC of the empty text; a NULL id is hashed like a value; an empty table gives an empty
result; equal keys are in any order. Other columns are never read.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortlab.session import cut_lineage

#: Ranges per shard at least, rows of a range at most (about), and samples per range.
RANGES_PER_SHARD, ROWS_PER_RANGE, SAMPLES_PER_RANGE = 8, 1_000_000, 32
#: A range is overfull beyond this multiple of its due share.
OVERFULL = 2.0

Key = tuple[int, int]


def _longs(values: list[int]) -> Column:
    """An array literal; one string in the plan whatever its length."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>") if values else F.array().cast("array<bigint>")


def _range_of(splitters: list[Key]) -> Column:
    """How many splitters are at or below (h, g): binary search."""
    if not splitters:
        return F.lit(0)
    a, b = _longs([x for x, _ in splitters]), _longs([x for _, x in splitters])
    steps = [1 << k for k in reversed(range(len(splitters).bit_length()))]

    def go(at: Column, step: Column) -> Column:
        x, y = F.get(a, at + step - 1), F.get(b, at + step - 1)
        below = (x < F.col("h")) | ((x == F.col("h")) & (y <= F.col("g")))
        return F.when(below, at + step).otherwise(at)  # beyond the end x is NULL

    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), go)


def _quantiles(sample: list[tuple[Key, float]], parts: int) -> list[Key]:
    """Keys that cut the weight of a sample into equal parts."""
    sample = sorted(sample)
    total, at, out = sum(w for _, w in sample), 0.0, []
    for key, w in sample:
        at += w
        if at >= total * (len(out) + 1) / parts and len(out) < parts - 1:
            out.append(key)
            while at >= total * (len(out) + 1) / parts and len(out) < parts - 1:
                out.append(key)
    return out


def _after(key: Key) -> Key:
    """The next key that there can be."""
    h, g = key
    return (h, g + 1) if g < (1 << 63) - 1 else (min(h + 1, (1 << 63) - 1), -(1 << 63))


def _drawn(rows: DataFrame, wanted: Column, seed: int) -> DataFrame:
    """(h, g, range, w): rows drawn with probability ``wanted``; w is ``wanted`` where it is over 1."""
    u = F.shiftrightunsigned(F.xxhash64("h", "g", F.lit(seed)), 11) / F.lit(float(1 << 53))
    return rows.withColumn("w", wanted).filter(u < F.col("w")).select("h", "g", "range", F.greatest("w", F.lit(1.0)).alias("w"))


def _splitters(rows: DataFrame, ranges: int, total_bytes: int, total_rows: int) -> tuple[list[Key], list]:
    """Splitters and the totals (range, bytes, rows) of their ranges."""
    weight = F.col("size") * F.col("n")
    first = _drawn(rows.withColumn("range", F.lit(0)), weight * (ranges * SAMPLES_PER_RANGE / total_bytes), 0).collect()
    splitters = sorted(set(_quantiles([((r["h"], r["g"]), r["w"]) for r in first], ranges)))
    for turn in itertools.count(1):
        placed = rows.withColumn("range", _range_of(splitters))
        totals = placed.groupBy("range").agg(F.sum(weight).alias("bytes"), F.sum("n").alias("rows"), F.count(F.lit(1)).alias("keys")).orderBy("range").collect()
        due_bytes, due_rows = OVERFULL * total_bytes / ranges, OVERFULL * max(total_rows / ranges, ROWS_PER_RANGE)
        full = {t["range"]: math.ceil(max(t["bytes"] / due_bytes, t["keys"] / due_rows)) + 1 for t in totals if t["keys"] > 1 and (t["bytes"] > due_bytes or t["keys"] > due_rows)}
        if not full:
            return splitters, totals
        # as many samples as parts want, from the overfull ranges alone; by bytes or by rows, whichever is over
        bytes_in = {t["range"]: t["bytes"] for t in totals}
        keys_in = {t["range"]: t["keys"] for t in totals}
        rate = F.lit(0.0)
        for at, parts in full.items():
            by_bytes = weight * (parts * SAMPLES_PER_RANGE / bytes_in[at]) if bytes_in[at] > due_bytes else F.lit(parts * SAMPLES_PER_RANGE / keys_in[at])
            rate = F.when(F.col("range") == at, by_bytes).otherwise(rate)
        more = _drawn(placed, rate, turn).collect()
        for at, parts in full.items():
            own = [((r["h"], r["g"]), r["w"]) for r in more if r["range"] == at]
            # a key that is worth a part by itself also ends there, so what follows it is a range of its own
            splitters += _quantiles(own, parts) + [_after(key) for key, w in own if w >= SAMPLES_PER_RANGE]
        splitters = sorted(set(splitters))


def shard(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, size, text_crc32, shard, slot) of every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(
        F.col(id_col).alias("_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("h"), F.xxhash64(id_col).alias("g"),
    )
    rows = cut_lineage(keyed.groupBy("_id", "size", "text_crc32", "h", "g").agg(F.count(F.lit(1)).alias("n")))
    whole = rows.agg(F.sum(F.col("size") * F.col("n")).alias("bytes"), F.sum("n").alias("rows")).first()
    total_bytes, total_rows = whole["bytes"] or 1, whole["rows"] or 0
    ranges = max(shards * RANGES_PER_SHARD, math.ceil(total_rows / ROWS_PER_RANGE))
    splitters, totals = _splitters(rows, ranges, total_bytes, total_rows)
    start_bytes, start_rows = [0] * (len(splitters) + 1), [0] * (len(splitters) + 1)
    held = {t["range"]: (t["bytes"], t["rows"]) for t in totals}
    for k in range(len(splitters)):
        b, r = held.get(k, (0, 0))
        start_bytes[k + 1], start_rows[k + 1] = start_bytes[k] + b, start_rows[k] + r
    inside = Window.partitionBy("range").orderBy("h", "g", "_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    weight = F.col("size") * F.col("n")
    placed = (
        rows.withColumn("range", _range_of(splitters))
        .withColumn("at_byte", F.coalesce(F.sum(weight).over(inside), F.lit(0)) + F.get(_longs(start_bytes), F.col("range")))
        .withColumn("at_row", F.coalesce(F.sum("n").over(inside), F.lit(0)) + F.get(_longs(start_rows), F.col("range")))
        .select("_id", "size", "text_crc32", "at_byte", "at_row", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("copy"))
        .select(
            "_id", "size", "text_crc32", (F.col("at_row") + F.col("copy")).alias("at_row"),
            F.floor((F.col("at_byte") + (F.col("copy") + 0.5) * F.col("size")) * shards / F.lit(total_bytes)).cast("int").alias("shard"),
        )
    )
    placed = cut_lineage(placed)
    heads = {r["shard"]: r["first"] for r in placed.groupBy("shard").agg(F.min("at_row").alias("first")).collect()}
    return placed.select("_id", "size", "text_crc32", "shard", (F.col("at_row") - F.get(_longs([heads.get(k, 0) for k in range(shards)]), F.col("shard"))).alias("slot"))
