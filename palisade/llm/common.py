"""Helpers that the training-data operators share."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A word is a run of anything but the six ASCII white-space characters; ``bytes.split()`` cuts alike.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; only where none is configured, a local one (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = f"file://{tempfile.mkdtemp(prefix='palisade-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path


@contextlib.contextmanager
def configured(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for the queries that are planned inside; what was set before comes back."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


#: What a written table needs no more is its shuffle files: they go at the end of the write, not when the driver collects garbage.
CLEAN = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def _file(spark: SparkSession, path: str):
    """The path as Hadoop's, and the file system that holds it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Cuts lineage: writes ``df`` to the shared folder and reads it back.

    The files are on storage that outlives any executor, so what is built on them need not recompute. They go when
    ``release`` is called or else when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.mode("overwrite")
    with configured(spark, CLEAN):
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    place, files = _file(spark, path)
    files.deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


class SortedTable:
    """A table of the shared folder in buckets by a column, each sorted, so that joins on the column neither shuffle nor sort.

    It is read with ``ORDERED`` set where the query is planned.
    """

    def __init__(self, df: DataFrame, name: str, by: str, order: list[str], buckets: int):
        spark = df.sparkSession
        self.name, path = f"{name}_{uuid.uuid4().hex}", f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        with configured(spark, CLEAN | ORDERED):
            df.repartition(buckets, by).write.bucketBy(buckets, by).sortBy(*order).option("path", path).format("parquet").saveAsTable(self.name)
        place, files = _file(spark, path)
        files.deleteOnExit(place)
        self.df, self._drop = spark.table(self.name), lambda: (spark.sql(f"drop table {self.name}"), files.delete(place, True))

    def release(self) -> None:
        self._drop()


#: Sorted buckets are read as such, joins may be on more than the buckets' column, and a union of buckets stays in them.
ORDERED = {
    "spark.sql.legacy.bucketedTableScan.outputOrdering": "true", "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.requireAllClusterKeysForDistribution": "false", "spark.sql.unionOutputPartitioning": "true",
}


def shared_file(spark: SparkSession, name: str, data: bytes) -> str:
    """Writes bytes, of a size that the driver holds, to a new file in the shared folder; its path."""
    path = f"{shared_dir(spark)}/{name}"
    place, files = _file(spark, path)
    out = files.create(place, True)
    out.write(data)
    out.close()
    files.deleteOnExit(place)
    return path


def release(df: DataFrame) -> None:
    """Deletes the files behind a materialized frame that nothing will read again."""
    spark = df.sparkSession
    root = shared_dir(spark)
    for file in {f[: f.index("/", len(root) + 1)] for f in df.inputFiles() if f.startswith(root.replace("file:///", "file:/")) or f.startswith(root)}:
        place, files = _file(spark, file)
        files.delete(place, True)


def binary_texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The column's values as UTF-8; null becomes empty."""
    values = batch.column(column)
    kind = pa.large_binary() if pa.types.is_large_string(values.type) else pa.binary()
    return [v or b"" for v in values.cast(kind).to_pylist()]


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that one piece holds at most about ``limit`` bytes of text (or one row)."""
    start = size = 0
    lengths = pa.compute.binary_length(batch.column(column)).to_pylist()
    for i, n in enumerate(lengths):
        if size and size + (n or 0) > limit:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n or 0
    if start < batch.num_rows:
        yield batch.slice(start)


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], clear: Callable[[], None] | None = None):
    """``run`` for mapInArrow; a worker, which Spark keeps for later tasks, gives back what it holds when the task ends."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            if clear:
                clear()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
                ctypes.CDLL(None).malloc_trim(0)

    return task


def distributed_rank(df: DataFrame, parts: list[str], cell: list[str], order: list[Column], name: str) -> DataFrame:
    """Adds ``name``: the 1-based rank within ``parts`` by (``cell``, ``order``) without one task per part.

    Rows are counted by cell (pre-aggregated), the small table of counts is summed up, and only the rows of one
    cell are sorted together. Cells must be chosen so that their rows fit a task. Null keys form their own part.
    """
    keys = [*parts, *cell]
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*parts) if parts else Window.partitionBy(F.lit(0))
    before = before.orderBy(*[F.col(c).asc_nulls_last() for c in cell]).rowsBetween(Window.unboundedPreceding, -1)
    renamed = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], "_before"
    )
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    return (
        df.join(renamed, on)
        .withColumn(name, F.col("_before") + F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
        .drop("_before", *[f"_k_{k}" for k in keys])
    )
