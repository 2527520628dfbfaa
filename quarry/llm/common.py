"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_path

#: Bytes of text handled at once inside a Python worker.
SLICE_BYTES = 2 << 20
#: Bytes of one Arrow batch sent to a Python worker.
ARROW_BATCH_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One whole input table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches by bytes, so that very long texts don't pile up in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BATCH_BYTES))


def materialize(df: DataFrame, name: str, compression: str = "none") -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back.

    Cuts the lineage with files that every executor can read, so a lost executor costs a
    re-read and not a recomputation, and a result used twice is computed once. Small tables are
    written plain: the compressors' buffers outside the heap cost more than they save.
    """
    path = checkpoint_path(df.sparkSession, name, unique=True)
    df.write.option("compression", compression).parquet(path)
    spark = df.sparkSession
    out = spark.read.schema(df.schema).parquet(path)
    # What was shuffled for the table is not needed any more. Spark drops shuffle files once the
    # driver's JVM has collected the plan behind them; asked for here, so that a job of several
    # tables holds one table's shuffles on the executors' disks at a time.
    spark.sparkContext._jvm.System.gc()
    return out


def materialize_by(df: DataFrame, name: str, column: str) -> tuple[DataFrame, DataFrame]:
    """As ``materialize``, in buckets by ``column``; read back as any files, and by buckets: then what
    is grouped by ``column`` is read in place and not shuffled. As many buckets as a shuffle has
    partitions.

    Buckets need a table; its name goes at once, its files stay in the checkpoint folder.
    """
    spark = df.sparkSession
    path = checkpoint_path(spark, name, unique=True)
    named = path.rsplit("/", 1)[-1].replace("-", "_")
    buckets = min(int(spark.conf.get("spark.sql.shuffle.partitions")), int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets")))
    df.write.option("compression", "none").option("path", path).bucketBy(buckets, column).saveAsTable(named, format="parquet")
    by_bucket = spark.table(named)
    spark.sql(f"DROP TABLE {named}")
    spark.sparkContext._jvm.System.gc()  # see materialize
    return spark.read.schema(df.schema).parquet(path), by_bucket


def shrink_heaps(spark: SparkSession) -> None:
    """Let the executors' JVMs collect, so that they return heap which earlier jobs have touched.

    A JVM keeps the heap that it once took; what it doesn't use is missing to the Python workers
    beside it. A task for each core, so each idle executor has some.
    """
    cores = spark.sparkContext.defaultParallelism
    asked = F.java_method(F.lit("java.lang.System"), F.lit("gc"))
    spark.range(0, cores, 1, cores).select(asked.alias("done")).write.format("noop").mode("overwrite").save()


def give_back() -> None:
    """Return freed memory to the system, so that a worker that waits for its next task is small."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # GNU libc has it
    if trim is not None:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], text: str = "text",
           limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into zero-copy slices of about ``limit`` bytes of column ``text``.

    A row longer than ``limit`` makes a slice of its own; rows are never cut.
    """
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(text))
        start, size = 0, 0
        for i, n in enumerate(pc.fill_null(pc.binary_length(col), 0).to_pylist()):
            if size and size + n > limit:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        if start < batch.num_rows:
            yield batch.slice(start)
    give_back()


def list_array(values, offsets, kind: pa.DataType) -> pa.ListArray:
    """A list column from flat values and int32 offsets."""
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))
