"""Shared pieces: the scratch folder, bounded samples, folds by crc32, and byte views of Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy pass works on; a longer text is a pass of its own.
SLICE_BYTES = 1 << 20
#: A key is hot if it holds more than one part in this many of all rows; so fewer keys than this can be.
HOT_PARTS = 4096


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which every executor of a cluster shares.

    Only where that setting is missing (a local session, as in tests) a temporary folder is set instead.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not str(spark.sparkContext.master).startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """These settings of the session meanwhile."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: lineage ends there, and lost executors can't take it away.

    Its shuffle files are removed once it is written, not when the driver happens to collect its garbage.
    """
    path = scratch(df.sparkSession, name)
    with settings(df.sparkSession, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, *tables: DataFrame) -> None:
    """Removes materialized tables that nothing reads any more."""
    for files in (df.inputFiles() for df in tables):
        if files:
            folder = spark._jvm.org.apache.hadoop.fs.Path(files[0].rpartition("/")[0])
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def new_names(taken: list[str], n: int) -> list[str]:
    """Column names that docs doesn't have."""
    prefix = "_"
    while any(c.lower().startswith(prefix + "own") for c in taken):
        prefix += "_"
    return [f"{prefix}own{k}" for k in range(n)]


def is_hot(size: Column, total: int) -> Column:
    """Whether a key of that many rows is hot. Fewer than HOT_PARTS keys of a table can be."""
    return (size > 1) & (size * HOT_PARTS > total)


def join_split(left: DataFrame, right: DataFrame, hot: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """left joined with right, which holds a key once: rows of the hot keys stay where they are, the rest is shuffled.

    `hot` has fewer than HOT_PARTS rows, so it and its rows of right may be broadcast at any size of the tables.
    """
    mark = F.broadcast(hot.select(*keys).distinct())
    its = F.broadcast(right.join(mark, keys, "left_semi"))
    there = left.join(mark, keys, "left_semi").join(its, keys, how)
    return there.unionByName(left.join(mark, keys, "left_anti").join(right, keys, how))


def crc_fold(id_col: str, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo folds; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def whole_text(text_col: str) -> Column:
    return F.coalesce(F.col(text_col), F.lit(""))


def bounded_sample(labelled: DataFrame, label: str, id_col: str, per_class: int, most_classes: int = 64) -> DataFrame:
    """About per_class rows of every class, chosen by a hash of the id, so reruns agree.

    Counts come from all rows; the sample size doesn't grow with the input. Only the
    most_classes commonest classes are kept.
    """
    counts = labelled.groupBy(label).count().orderBy(F.desc("count"), F.asc(label)).limit(most_classes).collect()
    keep = F.lit(False)
    unit = F.pmod(F.xxhash64(F.lit(17), F.col(id_col)), F.lit(1 << 40)) / float(1 << 40)
    for row in counts:
        share = min(1.0, per_class / max(1, row["count"]))
        keep = keep | ((F.col(label) == F.lit(row[label])) & (unit < share))
    return labelled.where(keep)


def released(rows):
    """The function over a partition's batches, after which the worker gives back the memory that it freed.

    Workers are kept for later tasks, and many of them share an executor.
    """

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from rows(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library; it then keeps what it freed
                pass

    return made


def byte_views(column: pa.Array, slice_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of rows of at most slice_bytes, one row at least. No nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if len(column) == 0:
        return
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        end = int(np.searchsorted(offsets, offsets[first] + slice_bytes, side="right")) - 1
        end = min(max(end, first + 1), len(column))
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def slices(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, their bytes, their offsets), slice by slice over all batches of a partition."""
    for batch in batches:
        for first, end, data, offsets in byte_views(batch.column(text)):
            yield batch.slice(first, end - first), data, offsets
