"""Helpers shared by the corpus operators: tables, the shared folder, files in it, materialised stages."""

from __future__ import annotations

import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session, or one of
    our own where that is unset, as in tests on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        app = spark.sparkContext.applicationId
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if app not in _own:
            _own[app] = "file://" + tempfile.mkdtemp(prefix="waveloom-")
        base = _own[app]
    return base.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/waveloom/{name}-{uuid.uuid4().hex[:12]}"


_passing = threading.local()


@contextmanager
def passing():
    """Tables that :func:`materialize` makes inside, in this thread, are deleted at the end, all but those in the list that
    this gives. What is lazy and reads others must be written before."""
    outer, made, kept = getattr(_passing, "made", None), [], []
    _passing.made = made
    try:
        yield kept
    finally:
        _passing.made = outer
        for df in made:
            if not any(df is x for x in kept):
                discard(df)
        if outer is not None:
            outer.extend(kept)


#: Spark deletes the shuffle files of an execution at its end, in place of some time after the driver collects its garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_deleted(spark: SparkSession):
    """Executions inside delete their shuffle files once they end."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet into the shared folder and read it back. A lost
    executor then costs a re-read, not a recomputation. Nothing but the file is left: shuffles on the way to it go."""
    path = fresh_path(df.sparkSession, name)
    with shuffles_deleted(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.waveloom_path = path
    if getattr(_passing, "made", None) is not None:
        _passing.made.append(out)
    return out


def discard(df: DataFrame) -> None:
    """Delete the files behind a table made by :func:`materialize` that nothing reads any more."""
    path = getattr(df, "waveloom_path", None)
    if path:
        spark = df.sparkSession
        hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)


#: Rows that go to Python at a time. Whole texts are wide: a batch should hold a few MB.
ARROW_ROWS = 500


def spread(df: DataFrame, rows: int = ARROW_ROWS) -> DataFrame:
    """Rows on their way to Python: dealt out when the input has fewer partitions than the cluster has
    cores (small or unsplittable files), and taken together, without a shuffle, where it has many times as many,
    so that a task's counts span more than a handful of rows; and in Arrow batches of few rows."""
    conf, cores = df.sparkSession.conf, df.sparkSession.sparkContext.defaultParallelism
    if not 0 < int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= rows:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    n = df.rdd.getNumPartitions()
    return df.repartition(cores) if n < cores else df.coalesce(max(4 * cores, n // 8)) if n > 8 * cores else df


#: What this worker process ran last, and functions that drop what it keeps from task to task.
_running: list[str] = [""]
kept_in_process: list = []


def begin(name: str) -> None:
    """A task of another kind begins in this worker process: what the last kind kept goes."""
    if _running[0] != name:
        _running[0] = name
        for drop in kept_in_process:
            drop()


def end() -> None:
    """Hand memory that is free back to the system: workers live on from task to task and stage to stage."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def worker(run):
    """For functions over Arrow batches: a worker process holds what its present kind of task needs, and no more."""
    name = f"{run.__module__}.{run.__qualname__}"

    def wrapped(batches):
        from waveloom.llm import common

        common.begin(name)
        try:
            yield from run(batches)
        finally:
            common.end()

    return wrapped


def open_fs(uri: str):
    """(filesystem, path) for a URI of any store that pyarrow reaches: file, hdfs, s3, gs."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if uri.startswith("/"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


@contextmanager
def committed_file(uri: str):
    """A binary file that appears under its name only when complete: retried and speculative task
    attempts write under a name of their own and replace each other whole."""
    filesystem, path = open_fs(uri)
    filesystem.create_dir(path.rpartition("/")[0], recursive=True)
    attempt = f"{path}.{uuid.uuid4().hex[:8]}.attempt"
    with filesystem.open_output_stream(attempt, compression=None) as out:
        yield out
    filesystem.move(attempt, path)


def byte_slices(sizes, limit: int):
    """(first, last) ranges of rows of about ``limit`` bytes each, one row at least."""
    first, held = 0, 0
    for i, n in enumerate(sizes):
        if i > first and held + n > limit:
            yield first, i
            first, held = i, 0
        held += n
    if first < len(sizes):
        yield first, len(sizes)
