"""Token counts of documents in flat token files by a separator scan.

A flat token file holds fixed-width ids of documents on end; an end-of-document id closes each, and
there is no index. Files are read in blocks of bytes, many blocks to a file. A block gives the places
of its end ids and how many ids follow the last; a prefix scan over a file's blocks gives each block
the ids and the documents that blocks before it left open, and so every document's number and size.

Rows: an empty or null text is a document of no tokens; ids after a file's last end id form a
document only if there are any; repeated rows and ids count as documents of their own; an empty
table gives no rows; a text that spells out a token of the vocabulary such as <|endoftext|> is one
document, in which that token counts. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factorloom.llm import common, store, tokens

#: Closes a document. No text gives it: it is beyond the vocabulary, whose own end-of-text token a text may spell out.
END_ID = 0xFFFF
#: Ids of this vocabulary and END_ID fit 16 bits.
ID_TYPE = "<u2"
#: Bytes of a token file that one row of the scan reads.
BLOCK_BYTES = 4_000_000
#: Bytes after which a writer begins a new file.
FILE_BYTES = 256_000_000

MANIFEST = "doc_id long, file string, ordinal long"


def write_token_files(docs: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID, id_type: str = ID_TYPE) -> DataFrame:
    """Write all documents' ids to flat files in a shared folder; the written manifest tells which document is where.

    A file gets its name once complete and each attempt of a task has names of its own, so the files
    of a lost or repeated attempt are never read: the manifest, a table, names those that count.
    """
    path = path or tokens.vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, ctx = tokens.encoder(path).encode, TaskContext.get()
        name = f"{folder}/tokens/{ctx.partitionId()}-{ctx.taskAttemptId()}"
        parts = (p for b in batches for p in common.slices(b, "text"))
        part, number = next(parts, None), 0
        while part is not None:
            uri, size, ordinal = f"{name}-{number}.bin", 0, 0
            with store.new_file(uri) as out:
                while part is not None and size < FILE_BYTES:
                    got = encode(common.as_text(part.column("text")))
                    if ((got.values == end_id) | (got.values > np.iinfo(id_type).max)).any():
                        raise ValueError(f"a text gives the id {end_id}, which closes documents, or one beyond {id_type}")
                    n = got.lengths() + 1
                    flat = np.full(n.sum(), end_id, id_type)
                    flat[np.arange(len(got.values)) + np.repeat(np.arange(len(n)), n - 1)] = got.values
                    out.write(flat.tobytes())
                    size += flat.nbytes
                    yield pa.record_batch([part.column("doc_id").cast(pa.int64()), pa.array([uri] * len(n)), pa.array(range(ordinal, ordinal + len(n)), pa.int64())], ["doc_id", "file", "ordinal"])
                    ordinal += len(n)
                    part = next(parts, None)
            number += 1

    return common.written(docs.select("doc_id", "text").mapInArrow(run, MANIFEST), f"{folder}/manifest")


def scan(spark: SparkSession, files: DataFrame, end_id: int = END_ID, id_type: str = ID_TYPE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Documents of flat token files (column file): file, ordinal, start, n_tokens; start counts ids from the file's begin.

    The blocks are scanned once and their ends written as rows; a window over a file's blocks stitches
    them. A document may span any number of blocks.
    """
    width = np.dtype(id_type).itemsize
    block_bytes = max(width, block_bytes // width * width)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column("file").to_pylist():
                system, path = store.opened(uri)
                size = system.get_file_info(path).size
                if size % width:
                    raise ValueError(f"{uri} has {size} bytes, not a multiple of {width}")
                n = -(-size // block_bytes)
                yield pa.record_batch([pa.array([uri] * n), pa.array(range(n), pa.int64())], ["file", "block"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, block in zip(batch.column("file").to_pylist(), batch.column("block").to_pylist(), strict=True):
                ids = np.frombuffer(store.read_range(uri, block * block_bytes, block_bytes), id_type)
                ends = np.flatnonzero(ids == end_id)
                # the ids before each end id since the one before it in the block, and at the last row those after the last end
                sizes = np.diff(np.concatenate([[-1], ends, [len(ids)]])) - 1
                yield pa.record_batch([pa.array([uri]), pa.array([block], pa.int64()), pa.array([len(ends)], pa.int64()), pa.array([int(sizes[-1])], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([sizes.tolist()], pa.list_(pa.int64()))], ["file", "block", "ends", "tail", "n_ids", "sizes"])

    listed = files.select("file").mapInArrow(blocks, "file string, block long").repartition(max(1, 4 * spark.sparkContext.defaultParallelism), "file", "block")
    found = listed.mapInArrow(find, "file string, block long, ends long, tail long, n_ids long, sizes array<long>")
    w = W.partitionBy("file").orderBy("block")
    before = w.rowsBetween(W.unboundedPreceding, -1)
    # the prefix scan: documents closed before the block, ids before it, and ids left open: those after the last end of any earlier block
    ids_before = F.coalesce(F.sum("n_ids").over(before), F.lit(0))
    open_from = F.coalesce(F.last(F.when(F.col("ends") > 0, F.col("_upto") - F.col("tail")), ignorenulls=True).over(before), F.lit(0))
    final = F.col("block") == F.max("block").over(W.partitionBy("file"))
    stitched = (
        found.withColumn("_before", ids_before)
        .withColumn("_upto", F.col("_before") + F.col("n_ids"))
        .withColumn("_first", F.coalesce(F.sum("ends").over(before), F.lit(0)))
        .withColumn("_open", open_from)
        .withColumn("_final", final)
    )
    each = stitched.select("file", "_first", "_before", "_open", "_final", "ends", F.posexplode("sizes").alias("_at", "_size"))
    closed = each.where((F.col("_at") < F.col("ends")) | F.col("_final"))
    carried = F.when(F.col("_at") == 0, F.col("_before") - F.col("_open")).otherwise(0)
    counted = closed.select("file", (F.col("_first") + F.col("_at")).alias("ordinal"), (F.col("_size") + carried).alias("n_tokens"), (F.col("_at") == F.col("ends")).alias("_rest"))
    return counted.where(~F.col("_rest") | (F.col("n_tokens") > 0)).select("file", "ordinal", "n_tokens")


def count_tokens(docs: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID, id_type: str = ID_TYPE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id and n_tokens of every document, read from the flat files that are written first."""
    manifest = write_token_files(docs, folder, path, end_id, id_type)
    counts = scan(docs.sparkSession, manifest.select("file").distinct(), end_id, id_type, block_bytes)
    return manifest.hint("merge").join(counts, ["file", "ordinal"]).select("doc_id", "n_tokens")
