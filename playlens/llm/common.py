"""Scratch tables and small column helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a shared file that go through the driver's gateway at once.
PIECE = 1 << 22
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where it is unset, one made for a session on this machine alone.

    On a cluster, whose machines share no such folder, an unset option is refused.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        folder = tempfile.mkdtemp(prefix="playlens-")
        spark.conf.set("spark.checkpoint.dir", folder)
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def _hadoop_path(spark: SparkSession, path: str):
    context = spark.sparkContext
    found = context._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(context._jsc.hadoopConfiguration()), found


def delete(spark: SparkSession, path: str) -> None:
    """Remove a scratch folder."""
    files, found = _hadoop_path(spark, path)
    files.delete(found, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the session's JVM ends."""
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    files, found = _hadoop_path(spark, path)
    files.deleteOnExit(found)
    return path


# Paths of tables written inside of calls of ``settled``.
_passing: list[list[str]] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again, which cuts its lineage."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    for paths in _passing:
        paths.append(path)
    df.write.option("compression", "zstd").parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.scratch = path
    return found


def release(*frames: DataFrame) -> None:
    """Remove tables made by ``written`` that no plan reads any more.

    Collecting the driver's garbage lets Spark remove the shuffle files behind them.
    """
    for frame in frames:
        delete(frame.sparkSession, frame.scratch)
    gc.collect()
    frames[0].sparkSession.sparkContext._jvm.System.gc()


def settled(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What ``make`` returns, written; the tables that were written on the way to it are removed."""
    _passing.append([])
    try:
        done = written(make(), name)
    finally:
        paths = _passing.pop()
    for path in paths:
        if path != done.scratch:
            delete(spark, path)
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return done


def shared_file(spark: SparkSession, name: str, data: bytes | Iterable[bytes]) -> str:
    """Put a bounded file, or one given in pieces, in the shared folder and let Spark copy it to every executor.

    Returns the name for ``SparkFiles.get``.
    """
    path = scratch_path(spark, name)
    files, found = _hadoop_path(spark, path)
    out = files.create(found)
    try:
        for piece in [data] if isinstance(data, bytes) else data:
            for at in range(0, len(piece), PIECE):
                out.write(piece[at : at + PIECE])
    finally:
        out.close()
    spark.sparkContext.addFile(files.makeQualified(found).toString())
    return path.rsplit("/", 1)[1]


def sparing(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The function of a task, which gives the memory it has freed back to the machine at its end.

    A Python worker lives on from stage to stage, and what its allocators hold back for
    later adds up beside the memory of the executor that it belongs to.
    """

    @wraps(run)
    def ran(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return ran


def give_back() -> None:
    """Return this process's free memory to the machine, where its C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(text, UPPER, UPPER.lower())


def crc_of_id(column: Column) -> Column:
    """crc32 of an id written as text."""
    return F.crc32(column.cast("string").cast("binary"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
