"""Cutting the lineage of iterations through the checkpoint folder that all executors share."""

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType
from pyspark.sql.window import Window


def _shared(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder stands in only where that is unset, in local sessions."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not str(context.master).startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df, computed and written to the shared folder."""
    _shared(df.sparkSession)
    return df.checkpoint()


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has yet."""
    return f"{_shared(spark)}/{name}-{uuid.uuid4().hex}"


def _added_up(name: str, last: str | None):
    """Adds what comes before to each row of a partition, in its order, and gives it the row before; only the last row is kept, so none are held."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, prior = 0, None
        for batch in (b for b in batches if b.num_rows):
            value = pc.fill_null(batch.column(name), 0).to_numpy(zero_copy_only=False)
            made = {name: pc.add(batch.column("_before"), pa.array(total + np.cumsum(value) - value, pa.int64()))}
            total += int(value.sum())
            if last:
                own = batch.column(last)
                made[last] = pa.concat_arrays([batch.column("_prior").slice(0, 1) if prior is None else prior, own.slice(0, len(own) - 1)])
                prior = own.slice(len(own) - 1)
            names = [c for c in batch.schema.names if c not in ("_before", "_prior")]
            yield pa.RecordBatch.from_arrays([made.get(c, batch.column(c)) for c in names], names=names)

    return rows


def running_total(df: DataFrame, order: list[str], value: Column, name: str, last: str | None = None) -> DataFrame:
    """df and the sum of value over all rows before, in that order; no task orders more than its range of rows. The column `last` gets its value of the row before.

    Ranges are ordered and written, and summed; what comes before each, a row for each partition, is joined back, and the rows of a
    range are added up as they are read, without another shuffle or a window that holds them.
    """
    ranged = cut(df.withColumn(name, value.cast("long")).repartitionByRange(*order).sortWithinPartitions(*order)).withColumn("_range", F.spark_partition_id())
    ends = [F.max_by(last, "_row").alias("_last")] if last else []
    sums = ranged.withColumn("_row", F.monotonically_increasing_id()).groupBy("_range").agg(F.sum(name).alias("_sum"), *ends)
    over = Window.orderBy("_range")
    prior = [F.lag("_last").over(over).alias("_prior")] if last else []
    before = sums.select("_range", F.coalesce(F.sum("_sum").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), *prior)
    placed = ranged.join(F.broadcast(before), "_range").drop("_range")
    kinds = StructType([StructField(f.name, f.dataType) for f in placed.drop("_before", "_prior").schema])
    return placed.mapInArrow(_added_up(name, last), kinds)
