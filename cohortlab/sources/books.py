"""Report books: sheets in folders of their own, and a table of contents that says which folders count.

A write goes to fresh folders first; then one new table of contents, a single file moved into place, makes it count. Whatever breaks off
before that leaves the book as it was. Folders that no longer count are deleted last. One writer at a time.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


def _folder(spark: SparkSession, book: str):
    """(file system, path maker) of a book."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    return path(book).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def _contents(spark: SparkSession, book: str) -> tuple[int, dict[str, str]]:
    """(number of the newest table of contents, sheet -> folder); 0 and nothing for a book that is not there."""
    fs, path = _folder(spark, book)
    numbers = [int(f.getPath().getName().removeprefix("contents-")) for f in fs.globStatus(path(f"{book}/contents-*")) or []]
    if not numbers:
        return 0, {}
    n = max(numbers)
    return n, json.loads(spark.read.option("wholetext", True).text(f"{book}/contents-{n:09d}").first()[0])


def _publish(spark: SparkSession, book: str, number: int, sheets: dict[str, str]) -> None:
    """Make these sheets the book, then delete what does not count any more."""
    fs, path = _folder(spark, book)
    draft = path(f"{book}/draft-{uuid.uuid4().hex}")
    out = fs.create(draft)
    out.write(bytearray(json.dumps(sheets).encode()))
    out.close()
    if not fs.rename(draft, path(f"{book}/contents-{number:09d}")):
        raise OSError(f"the table of contents of {book} could not be moved into place")
    for f in fs.globStatus(path(f"{book}/*")) or []:
        name = f.getPath().getName()
        if name not in sheets.values() and name != f"contents-{number:09d}":
            fs.delete(f.getPath(), True)


def _written(df: DataFrame, book: str) -> str:
    folder = f"sheet-{uuid.uuid4().hex}"
    df.write.parquet(f"{book}/{folder}")
    return folder


def write_report_sheet(df: DataFrame, book: str, sheet: str) -> None:
    """Replace one sheet and keep the others."""
    spark = df.sparkSession
    folder = _written(df, book)
    number, sheets = _contents(spark, book)
    _publish(spark, book, number + 1, {**sheets, sheet: folder})


def write_report_book(sheets: dict[str, DataFrame], book: str) -> None:
    """Replace all sheets at once; each keeps its own columns."""
    if not sheets:
        raise ValueError("a book has at least one sheet")
    spark = next(iter(sheets.values())).sparkSession
    folders = {sheet: _written(df, book) for sheet, df in sheets.items()}
    _publish(spark, book, _contents(spark, book)[0] + 1, folders)


def report_sheets(spark: SparkSession, book: str) -> list[str]:
    """The sheets of a book, in the order in which they were first written."""
    return list(_contents(spark, book)[1])


def read_report_sheet(spark: SparkSession, book: str, sheet: str) -> DataFrame:
    """One sheet with its own columns; a sheet that is not in the book has no rows and no columns."""
    folder = _contents(spark, book)[1].get(sheet)
    return spark.range(0).select() if folder is None else spark.read.parquet(f"{book}/{folder}")
