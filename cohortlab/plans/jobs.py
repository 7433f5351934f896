"""Independent jobs whose results are stored one by one, so that a run that was cut off goes on at the job, not at the learner."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession


def job_name(*parts) -> str:
    """Name of a job after what it does: other parameters are another job."""
    return hashlib.md5(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()


def finished_folders(spark: SparkSession, path: str, prefix: str) -> set[str]:
    """``name`` of every folder ``prefix + name`` below ``path`` that was written completely."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    marks = fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{path}/{prefix}*/_SUCCESS"))
    return {m.getPath().getParent().getName().removeprefix(prefix) for m in (marks or [])}


def stored(spark: SparkSession, path: str, jobs: dict[str, Callable[[], DataFrame]], parallelism: int = 4, pool: str | None = None, files: int | None = 1) -> DataFrame:
    """Rows of all ``jobs``; those with a complete folder below ``path`` are read, the others run side by side and are written.

    A job that fails ends the run after those beside it; what they wrote stays. ``pool`` names the scheduler pool of the jobs, so that
    in a session with ``spark.scheduler.mode=FAIR`` a learner with many jobs does not hold up another one. Whether a stored
    result belongs to the data at hand is the caller's matter: one path, one set of data. No jobs at all are an error. A result is written by
    ``files`` tasks at most; None leaves it to as many as made it.
    """
    if not jobs:
        raise ValueError("no jobs")
    done = finished_folders(spark, path, "job-")

    def run(name: str) -> None:
        if pool is not None:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", pool)
        rows = jobs[name]()
        (rows if files is None else rows.coalesce(files)).write.mode("overwrite").parquet(f"{path}/job-{name}")

    with ThreadPool(parallelism) as threads:
        threads.map(inheritable_thread_target(spark)(run), [n for n in jobs if n not in done], chunksize=1)
    return spark.read.parquet(*[f"{path}/job-{n}" for n in jobs])
