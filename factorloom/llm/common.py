"""What the corpus operators share: tables, the shared folder, splits, batches."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from factorloom.sources.shared import new_path

#: Bytes of text that a numeric kernel takes at once; bounds the memory of a task.
SLICE_BYTES = 4_000_000
#: Bytes of a batch that the JVM hands to a Python worker, at most about.
BATCH_BYTES = 8_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder that the driver and all executors share, under spark.checkpoint.dir; only a local session may go without that."""
    return new_path(spark)


def removed(spark: SparkSession, folder: str) -> None:
    """Delete a folder of written tables that nothing reads any more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, path: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives lost executors."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text is 1 modulo 3; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample_share(rows: int, bound: int) -> float:
    """Share of rows to keep so that about `bound` stay."""
    return min(1.0, bound / max(1, rows))


def hashed_share(key: Column, share: float, seed: int) -> Column:
    """Deterministic sampling by key: keeps about `share` of the keys."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1_000_003)) < F.lit(int(share * 1_000_003))


def bounded(spark: SparkSession) -> None:
    """Bound the bytes of batches for Python workers, as rows may hold very long texts; a size that the session sets stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == "67108864b":  # the default
        spark.conf.set(key, str(BATCH_BYTES))


@lru_cache(maxsize=1)
def _trim() -> Callable[[int], int]:
    """The C library's way to give freed memory back, where it has one."""
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda keep: 0)


def tidy() -> None:
    """Give memory that a kernel has freed back to the system: workers are kept from stage to stage."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def as_text(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """A text column as one large_string array; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def slices(batch: pa.RecordBatch, text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds about `most` bytes of text, and a row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield batch.slice(start)


def map_text(df: DataFrame, text: str, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str | StructType, most: int = SLICE_BYTES) -> DataFrame:
    """Run a kernel over slices of a table. `make` is called once a task and returns the kernel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = make()
        gc.disable()  # the kernels make many small objects and no cycles
        try:
            for batch in batches:
                for part in slices(batch, text, most):
                    out = kernel(part)
                    if out is not None:
                        yield out
                    del out
                    tidy()
        finally:
            gc.enable()

    bounded(df.sparkSession)
    return df.mapInArrow(run, schema)


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, bound: int, seed: int = 17) -> DataFrame:
    """About `bound` documents with their label (columns text, label), by a hash of the id.

    Held-out ids and null labels are left out; of several labels of an id the largest counts. The
    sampled labels, at most a few more than `bound` small rows, are broadcast; texts are not shuffled.
    """
    known = labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(column).cast("int").alias("label"))
    share = sample_share(known.count(), bound)
    chosen = known.where(hashed_share(F.col("doc_id"), share, seed))
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "label")


def scored(docs: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str) -> DataFrame:
    """Run a scoring kernel over doc_id, text and held_out of every row."""
    return map_text(docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")), "text", make, schema)


def kept(docs: DataFrame, make: Callable[[], Callable[[pa.Array], pa.Array]]) -> DataFrame:
    """The rows, in all their columns, whose text the kernel marks as true. Columns may have any names."""

    def filtering() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        keep = make()
        return lambda part: part.filter(keep(as_text(part.column("text"))))

    return map_text(docs, "text", filtering, docs.schema)
