"""Exact deduplication with a two-pass Bloom filter: only rows that may repeat are shuffled.

Pass 1 takes a digest of every normalised text and marks, in a filter of saturating two-state cells, which
cells were hit once and which more than once. Pass 2 tests every row: a digest all of whose cells were hit more
than once may be repeated. Only those rows are grouped by digest, the others pass straight through.

A false positive costs a row in the shuffle and nothing else: the grouping is by the full SHA-256.

Defined results: a NULL text counts as empty; empty texts are equal to each other and to texts of white space
alone; equal rows with equal ids (repeated rows) are ordered arbitrarily, exactly one of each group is kept;
a NULL id comes after all others; an empty table gives an empty result. Other columns are never looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlab.session import cut_lineage

#: Bits per row, and the most bits of the filter. Beyond (rows > MAX_BITS / BITS_PER_ROW) the filter lets more
#: rows pass into the shuffle; results stay the same. It is broadcast: 32 MB at most.
BITS_PER_ROW, MAX_BITS, PROBES = 32, 1 << 28, 2
#: Bits of one segment of the filter, which one task of pass 1 merges.
SEGMENT = 1 << 19
DROPPED = b" \t\n\x0b\x0c\r"


def normalised(text: str | None) -> bytes:
    return (text or "").encode().translate(None, DROPPED)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, _n_chars, _sha): code points of the text and SHA-256 of the normalised text."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([len(t or "") for t in texts], pa.int64()),
                    pa.array([hashlib.sha256(normalised(t)).digest() for t in texts], pa.binary()),
                ],
                names=["_id", "_n_chars", "_sha"],
            )

    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(
        each, f"_id {id_type}, _n_chars bigint, _sha binary"
    )


def _cells(sha: pa.Array, bits: int) -> np.ndarray:
    """PROBES cells per digest, as a table rows x PROBES."""
    raw = np.frombuffer(b"".join(sha.to_pylist()), "<u8").reshape(-1, 4)[:, :PROBES]
    return (raw & np.uint64(bits - 1)).astype(np.int64)


def filter_bits(rows: int) -> int:
    wanted = max(SEGMENT, rows * BITS_PER_ROW)
    return min(MAX_BITS, 1 << (wanted - 1).bit_length())


def repeated_cells(rows: DataFrame, bits: int) -> bytes:
    """Pass 1: a bit per cell that says whether it was hit at least twice."""

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            # cells hit twice within a batch need to be sent twice, not more often
            cells, n = np.unique(_cells(b.column(0), bits), return_counts=True)
            cells = np.sort(np.concatenate([cells, cells[n > 1]]))
            cut = np.searchsorted(cells, np.arange(0, bits + 1, SEGMENT))
            full = np.flatnonzero(np.diff(cut))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(full.astype(np.int32)),
                    pa.array([(cells[cut[s] : cut[s + 1]] - s * SEGMENT).astype("<u4").tobytes() for s in full], pa.binary()),
                ],
                names=["segment", "cells"],
            )

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows arrive sorted by segment; state is one array of a segment
        now, count = -1, np.zeros(SEGMENT, np.uint8)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([now], pa.int32()), pa.array([np.packbits(count > 1).tobytes()], pa.binary())], names=["segment", "bits"]
            )

        for b in batches:
            for segment, cells in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if segment != now:
                    if now >= 0:
                        yield out()
                    now, count = segment, np.zeros(SEGMENT, np.uint8)
                # a cell comes once or twice in one row
                at = np.frombuffer(cells, "<u4")
                uniq, n = np.unique(at, return_counts=True)
                count[uniq] = np.minimum(count[uniq] + n, 2)
        if now >= 0:
            yield out()

    parts = (
        rows.select("_sha")
        .mapInArrow(hits, "segment int, cells binary")
        .repartition(max(1, bits // SEGMENT), "segment")
        .sortWithinPartitions("segment")
        .mapInArrow(merged, "segment int, bits binary")
        .collect()  # bits / 8 bytes together, 32 MB at most
    )
    whole = bytearray(bits // 8)
    for p in parts:
        at = p["segment"] * SEGMENT // 8
        whole[at : at + SEGMENT // 8] = p["bits"]
    return bytes(whole)


def with_maybe(rows: DataFrame, cells: bytes, bits: int, sha_col: str = "_sha") -> DataFrame:
    """Pass 2: adds ``_maybe``, false only for digests that occur once."""
    shared = rows.sparkSession.sparkContext.broadcast(cells)

    @F.pandas_udf("boolean")
    def maybe(sha: pd.Series) -> pd.Series:
        twice = np.frombuffer(shared.value, np.uint8)
        at = _cells(pa.array(sha, pa.binary()), bits)
        # packbits puts the first cell into the highest bit
        return pd.Series(((twice[at >> 3] >> (7 - (at & 7))) & 1).all(axis=1).astype(bool))

    return rows.withColumn("_maybe", maybe(sha_col))


def duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: _id, _keep_id, _group_size, _kept, _sha.

    Of equal texts the one with the most code points stays, then the one with the smallest id.
    """
    # the row number tells rows apart that repeat with their id; it is fixed by the checkpoint
    rows = cut_lineage(digests(docs, id_col, text_col).withColumn("_row", F.monotonically_increasing_id()))
    bits = filter_bits(rows.count())
    marked = with_maybe(rows, repeated_cells(rows, bits), bits)
    alone = marked.filter("not _maybe").select(
        "_id", F.col("_id").alias("_keep_id"), F.lit(1).cast("long").alias("_group_size"), F.lit(True).alias("_kept"), "_sha"
    )
    again = marked.filter("_maybe").select("_id", "_n_chars", "_sha", "_row")
    order = F.struct((-F.col("_n_chars")).alias("less"), F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_row").alias("row"))
    best = again.groupBy("_sha").agg(F.min(order).alias("_first"), F.count(F.lit(1)).alias("_group_size"))
    grouped = again.join(best, "_sha").select(
        "_id", F.col("_first.id").alias("_keep_id"), "_group_size", (F.col("_row") == F.col("_first.row")).alias("_kept"), "_sha"
    )
    return alone.unionByName(grouped)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Rows whose digest occurs once are not shuffled; of the others the whole rows meet by digest.
    """
    narrow = cut_lineage(digests(docs, id_col, text_col))
    bits = filter_bits(narrow.count())
    cells = repeated_cells(narrow, bits)
    sha = F.pandas_udf(_sha_series, "binary")
    # the row travels as one struct, so its column names can't clash with those used here
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), sha(F.col(text_col)).alias("_sha"))
    marked = with_maybe(whole, cells, bits)
    order = [F.length(F.coalesce(f"_doc.{text_col}", F.lit(""))).desc(), F.col(f"_doc.{id_col}").asc_nulls_last()]
    # a group of copies is thinned in salted parts first, so that no task gets all of a large one
    again = marked.filter("_maybe").withColumn("_salt", F.pmod(F.hash(f"_doc.{id_col}"), F.lit(64)))
    for keys in (["_sha", "_salt"], ["_sha"]):
        again = again.withColumn("_turn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_turn = 1").drop("_turn")
    return marked.filter("not _maybe").select("_doc.*").unionByName(again.select("_doc.*"))


def _sha_series(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: hashlib.sha256(normalised(t)).digest())
