"""Token counts of flat, unindexed token files: a vectorised search for the end-of-document id.

A file is nothing but ids of a fixed width, each document ended by one id. Files are cut into blocks of a set number
of ids; numpy finds the separators of each block without looking at its neighbours; a prefix scan over the separators
of a file stitches documents that cross blocks. ``write_flat_files`` makes such files on any store that Spark writes.

Defined results: an empty document is a separator alone (n_tokens 0); ids after a file's last separator are one
document with ``complete`` false; an empty file has no documents; a length that is not a multiple of the width fails.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import encode_documents


def write_flat_files(docs: DataFrame, ranks_path: str, pattern: str, path: str, *, end_id: int, files_rows: int = 10_000) -> None:
    """Two-byte little-endian ids of each document and ``end_id``. Spark's text writer puts the bytes and, as its line
    separator, the end id; a file has ``files_rows`` documents at most, and so a bounded size."""
    ids = encode_documents(docs, ranks_path, pattern, outputs=("ids_u2",))  # one Python worker a task
    rows = ids.select(F.col("ids_u2").cast("string").alias("value"))
    rows.write.option("lineSep", end_id.to_bytes(2, "little").decode("latin-1")).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", files_rows).text(path)


def count_documents(spark: SparkSession, path: str, *, end_id: int, width: int = 2, block_ids: int = 1 << 20) -> DataFrame:
    """shard (file name), doc_no (place in its file), start (ids before it in the file, separators included),
    n_tokens (without the end id), complete."""
    step = width * block_ids
    files = spark.read.format("binaryFile").load(path).where("length > 0").select(F.regexp_extract("path", "[^/]*$", 0).alias("shard"), "length", "content")
    blocks = files.select("shard", "length", "content", F.explode(F.expr(f"sequence(0L, (length - 1) div {step})")).alias("block"))
    blocks = blocks.select("shard", "length", "block", F.expr(f"substring(content, cast(block * {step} + 1 as int), {step})").alias("content"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, length, block, content in zip(*(batch.column(c) for c in ("shard", "length", "block", "content")), strict=True):
                if length.as_py() % width:
                    raise ValueError(f"{shard}: {length} bytes are no multiple of {width}")
                ids = np.frombuffer(content.as_buffer(), f"<u{width}")
                ends, n = np.flatnonzero(ids == end_id), length.as_py() // width
                at, complete = ends + block.as_py() * block_ids, np.ones(len(ends), bool)
                if (block.as_py() + 1) * block_ids >= n and (not len(ids) or ids[-1] != end_id):
                    at, complete = np.append(at, n), np.append(complete, False)
                yield pa.RecordBatch.from_arrays([pa.array([shard.as_py()] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(complete)], ["shard", "at", "complete"])

    ends = blocks.mapInArrow(run, "shard string, at bigint, complete boolean")
    w = Window.partitionBy("shard").orderBy("at")  # a file is of bounded size
    start = F.lag("at", 1, -1).over(w) + 1
    return ends.select("shard", (F.row_number().over(w) - 1).cast("long").alias("doc_no"), start.alias("start"), (F.col("at") - start).alias("n_tokens"), "complete")
