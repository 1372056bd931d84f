"""Token ids as ORC files.

Texts are dealt out by doc_id ranges and sorted, encoded, and written as ORC stripes: ids as integers with ORC's run
length encoding, row indexes every `stride` rows, and a Bloom filter on doc_id, so that readers take stripes in
parallel and skip those whose metadata rules a doc_id out. The files follow one another in ascending doc_id order.
A document's start is the sum of its file's start (files are few: their totals are summed up in order) and of the
documents before it in the file.

Defined cases. Null or empty text: the end id alone. Null doc_id sorts first. Repeated rows are written again; their
order among themselves is open. Empty table: empty files, no rows. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import new_folder, scratch, staged, table
from .tokens import Encoder

END = 2
SCHEMA = "doc_id long, ids array<int>"


def encode(docs: DataFrame, vocabulary: str | None = None, end: int | None = END) -> DataFrame:
    """doc_id and ids of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(vocabulary)
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                ids, ends = encoder.batch(part.column(1).to_pylist(), end)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids.view(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def write(docs: DataFrame, path: str, vocabulary: str | None = None, end: int | None = END, stride: int = 10_000, stripe_bytes: int = 64 << 20) -> None:
    """Write docs' ids to path in ascending doc_id order."""
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    options = {"orc.create.index": "true", "orc.row.index.stride": str(stride), "orc.stripe.size": str(stripe_bytes), "orc.rows.between.memory.checks": "500", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "compression": "lz4"}
    encode(ordered, vocabulary, end).write.options(**options).orc(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The written rows with the file each lies in; filters on doc_id reach the stripes' statistics and Bloom filters."""
    return spark.read.schema(SCHEMA).orc(path).select("doc_id", "ids", F.col("_metadata.file_path").alias("file"))


def digests(rows: DataFrame) -> DataFrame:
    """doc_id, file, n_tokens and the crc32 of the ids as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            ends = lists.offsets.to_numpy()
            data = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False).astype("<u4")).view(np.uint8))
            crc = [zlib.crc32(data[4 * s : 4 * e]) for s, e in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(np.diff(ends).astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "file", "n_tokens", "ids_crc32"])

    return rows.select("doc_id", "ids", "file").mapInArrow(run, "doc_id long, file string, n_tokens long, ids_crc32 long")


def positions(found: DataFrame) -> DataFrame:
    """found (doc_id, file, n_tokens, ...) with start, the ids of all documents before."""
    totals = found.groupBy("file").agg(F.sum("n_tokens").alias("t"), F.min(F.struct("doc_id")).alias("lo"), F.max(F.struct("doc_id")).alias("hi"))
    before = totals.select(F.col("file").alias("__file"), (F.sum("t").over(Window.orderBy("lo", "hi", "file").rowsBetween(Window.unboundedPreceding, 0)) - F.col("t")).alias("__before"))
    inside = F.sum("n_tokens").over(Window.partitionBy("file").orderBy("doc_id", "ids_crc32").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens")
    return found.withColumn("__inside", inside).join(before, F.col("file") == F.col("__file")).withColumn("start", F.col("__before") + F.col("__inside"))


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "token-ids")
    write(table(spark, sf_dir, "documents"), path)
    scratch(spark, path)
    found = staged(digests(read(spark, path)), "token-digests")
    return positions(found).select("doc_id", "start", "n_tokens", "ids_crc32")


QUERIES = {"op1_token_output": op1_token_output}
ORACLES: dict[str, str] = {}
