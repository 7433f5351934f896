"""Tables in the shared folder that stand for what made them, and can be deleted before the session ends."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from cohortlab.session import fresh_path

#: Shuffle files go when the execution that made them ends.
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def released_shuffles(spark: SparkSession) -> Iterator[None]:
    """Inside, an action's shuffle files are deleted at its end: its result must be a written table."""
    before = spark.conf.get(RELEASE, "false")
    spark.conf.set(RELEASE, "true")
    try:
        yield
    finally:
        spark.conf.set(RELEASE, before)


class Scratch:
    """Written tables of one operator."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.paths: dict[int, tuple[DataFrame, str]] = {}

    def keep(self, df: DataFrame) -> DataFrame:
        """``df`` as a written table: any task can read it again."""
        path = fresh_path(self.spark, "scratch")
        df.write.parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(table)] = (table, path)
        return table

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing will read any more."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for t in tables:
            found = self.paths.pop(id(t), None)
            if found is not None:
                path = jvm.org.apache.hadoop.fs.Path(found[1])
                path.getFileSystem(conf).delete(path, True)
