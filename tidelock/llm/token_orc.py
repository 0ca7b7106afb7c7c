"""Token-ID output as ORC: encode whole texts, write ids in ascending doc_id order, read the files back.

Layout: one directory of ORC files, each a range of doc_id. Columns: doc_id, part (ordinal of the range), local_start
(ids of the range before the document), n_tokens, ids array<int>. ORC stores integers by run-length encoding (version
2: short repeats, direct, patched base, delta) and keeps minima, maxima and row indexes for each stripe and row group;
Bloom filters on doc_id let a look-up skip stripes. Stripes are read in parallel, each by itself.
"""

from __future__ import annotations

import zlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import pieces
from .common import fresh_dir, shuffle_parts

END_ID = 1
FILE_SCHEMA = "doc_id bigint, part int, local_start bigint, n_tokens bigint, ids array<int>"
#: Fixed values of the format.
ORC_OPTIONS = {
    "compression": "zstd",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.create.index": "true",
    "orc.row.index.stride": "1000",
    "orc.stripe.size": str(64 << 20),
}


def encode_partition(batches, path: str, end_id: int | None):
    """Rows (doc_id, text) of one range in order -> rows of the file. One pass; a chunk of texts is held at a time."""
    from pyspark import TaskContext

    part, before, enc = TaskContext.get().partitionId(), 0, pieces.encoder(path)
    for batch in pieces.released(batches):
        ids_col, texts = batch.column(0), pieces.filled(batch.column(1))
        for a, b in pieces.chunks(texts):
            ids, offsets = enc.encode(texts.slice(a, b - a))
            if end_id is not None:
                ids, offsets = pieces.with_end(ids, offsets, end_id)
            lengths = np.diff(offsets)
            yield pa.RecordBatch.from_arrays(
                [
                    ids_col.slice(a, b - a).cast(pa.int64()),
                    pa.array(np.full(b - a, part, np.int32)),
                    pa.array(before + offsets[:-1]),
                    pa.array(lengths),
                    pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids)),
                ],
                names=["doc_id", "part", "local_start", "n_tokens", "ids"],
            )
            before += int(offsets[-1])


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = END_ID) -> None:
    """Write the ids of docs (doc_id, text; other columns are not read) to ORC files in ascending doc_id order.

    Null and empty texts give the end id alone; rows with a null doc_id come first; rows that share a doc_id stand by
    the hash of their text. Texts are dealt by ranges of doc_id before they are encoded, so no text is encoded twice,
    and a lost executor costs its ranges only. An empty table gives files without rows.
    """
    spark = docs.sparkSession
    ranged = (
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .repartitionByRange(shuffle_parts(spark), "doc_id")
        .sortWithinPartitions("doc_id", F.xxhash64("text"))
    )
    ranged.mapInArrow(partial(encode_partition, path=tokenizer, end_id=end_id), FILE_SCHEMA).write.options(**ORC_OPTIONS).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The files with `start`: ids of all documents before, over all ranges."""
    rows = spark.read.schema(FILE_SCHEMA).orc(path)
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    before = totals.select("part", F.coalesce(F.sum("_n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    # One row for each written range: as many as shuffle partitions, whatever the input.
    return rows.join(F.broadcast(before), "part").select("doc_id", (F.col("_before") + F.col("local_start")).alias("start"), "n_tokens", "ids")


def crc_of_ids(batches):
    """(doc_id, start, n_tokens, ids) -> the same with the checksum of the ids in place of the ids."""
    for batch in batches:
        col = batch.column(3)
        values = np.asarray(col.flatten(), np.int32).astype("<u4").view(np.uint8)
        ends = np.concatenate([[0], np.cumsum(np.asarray(col.value_lengths().fill_null(0)), dtype=np.int64)]) * 4
        crc = np.fromiter((zlib.crc32(values[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)), np.int64, len(col))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(crc)], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """Ids of some documents; the predicate reaches the ORC reader, which skips stripes by minima, maxima and Bloom filter."""
    return spark.read.schema(FILE_SCHEMA).orc(path).where(F.col("doc_id").isin(doc_ids)).select("doc_id", "ids")


def digest(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write docs, read the files back and return doc_id, start, n_tokens and ids_crc32 from what was read."""
    path = fresh_dir(docs.sparkSession, "token-orc")
    write_tokens(docs, path, tokenizer)
    return read_tokens(docs.sparkSession, path).mapInArrow(crc_of_ids, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


__all__ = ["digest", "lookup", "read_tokens", "write_tokens"]
