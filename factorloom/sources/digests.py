"""Fingerprints of files of any size, and a stored manifest to hold them against."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.sources.shared import exists

#: Bytes of a file that a task holds at once.
PIECE = 8 << 20
FINGERPRINT = "name string, bytes long, sha256 string"


def pieces(uri: str, size: int) -> Iterator[bytes]:
    """A file's bytes in order, `size` at a time. The path is one that Spark lists, in a store that pyarrow knows (file, hdfs, s3, gs)."""
    system, path = (fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")) if uri.startswith("file:") else fs.FileSystem.from_uri(quote(uri, safe=":/@"))
    with system.open_input_stream(path, compression=None) as f:
        while piece := f.read(size):
            yield piece


def listing(spark: SparkSession, folder: str, pattern: str) -> list[tuple[str, int]]:
    """Path and bytes of the files in a folder, empty ones too, which Spark's own readers leave out; by the driver, which lists files for every reader."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{pattern}")
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where) or []
    return [(s.getPath().toString(), s.getLen()) for s in found if s.isFile()]


def fingerprints(spark: SparkSession, folder: str, pattern: str = "*", piece: int = PIECE) -> DataFrame:
    """Name, size and SHA-256 of the files that match; a file is read in pieces by one task, files in parallel."""
    found = spark.createDataFrame(listing(spark, folder, pattern), "path string, length long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, sums = batch.column("path").to_pylist(), []
            for path in paths:
                digest = hashlib.sha256()
                for part in pieces(path, piece):
                    digest.update(part)
                sums.append(digest.hexdigest())
            yield pa.record_batch([pa.array([p.rsplit("/", 1)[-1] for p in paths], pa.string()), batch.column("length"), pa.array(sums, pa.string())], ["name", "bytes", "sha256"])

    return found.repartition(4 * spark.sparkContext.defaultParallelism, "path").mapInArrow(run, FINGERPRINT)


def compared(now: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files of either side with their state: same, changed, missing (only in the manifest) or new."""
    said = manifest.select("name", F.col("sha256").alias("_said"))
    state = F.when(F.col("sha256").isNull(), "missing").when(F.col("_said").isNull(), "new").when(F.col("sha256") == F.col("_said"), "same").otherwise("changed")
    return now.join(said, "name", "full").select("name", "bytes", "sha256", state.alias("state"))


def checked(spark: SparkSession, folder: str, manifest: str, pattern: str = "*") -> DataFrame:
    """The folder's files against the manifest stored at a path. Where there is none yet, it is recorded, and every file is new."""
    now = fingerprints(spark, folder, pattern)
    if exists(spark, manifest):
        return compared(now, spark.read.schema(FINGERPRINT).option("header", True).csv(manifest))
    first = compared(now, spark.createDataFrame([], FINGERPRINT))
    now.write.option("header", True).csv(manifest)
    return first
