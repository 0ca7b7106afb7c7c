"""Packing by minimum bin slack: fill windows of 2048 ids with whole remainders of documents.

Every document is encoded, ended, and cut into full windows and one remainder. Full windows are sequences of their own.
Remainders of equal length are alike, so packing works on their histogram (at most 2047 counts, whatever the number of
documents): the longest length left opens a window, a subset-sum over the bounded multiset of lengths (a bitset of 2049
bits, counts split into powers of two) finds the fill closest to capacity, and backtracking gives how many of each
length it takes. That multiset is laid down as often as the counts allow, so each step uses up a length. Documents then
take their places by their rank among the pieces of their length.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import pieces
from .common import materialize, small

CAPACITY, END_ID = 2048, 1
PIECE_SCHEMA = "doc_id bigint, start bigint, length int, doc_tokens bigint, part int, local_rank bigint, ids binary"
PLACE_SCHEMA = "_length int, _rank_from bigint, _rank_to bigint, _first_sequence bigint, _offset bigint"


def cut_partition(batches, path: str, capacity: int, end_id: int):
    """(doc_id, text) -> pieces with their ids (little-endian unsigned 32 bits) and their rank among the part's pieces of their length."""
    from pyspark import TaskContext

    part, enc, seen = TaskContext.get().partitionId(), pieces.encoder(path), np.zeros(capacity + 1, np.int64)
    for batch in pieces.released(batches):
        doc_ids, texts = batch.column(0), pieces.filled(batch.column(1))
        for a, b in pieces.chunks(texts):
            ids, offsets = pieces.with_end(*enc.encode(texts.slice(a, b - a)), end_id)
            totals = np.diff(offsets)
            n_pieces = -(-totals // capacity)
            doc = np.repeat(np.arange(b - a), n_pieces)
            nth = np.arange(len(doc)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)
            start = nth * capacity
            length = np.minimum(totals[doc] - start, capacity)
            order = np.argsort(length, kind="stable")
            ordered = length[order]
            rank = np.empty(len(doc), np.int64)
            rank[order] = seen[ordered] + np.arange(len(doc)) - np.searchsorted(ordered, ordered)
            seen += np.bincount(length, minlength=capacity + 1)
            ends = np.concatenate([offsets[doc] + start, offsets[-1:]]).astype(np.int32) * 4
            yield pa.RecordBatch.from_arrays(
                [
                    doc_ids.slice(a, b - a).cast(pa.int64()).take(pa.array(doc)),
                    pa.array(start),
                    pa.array(length.astype(np.int32)),
                    pa.array(totals[doc]),
                    pa.array(np.full(len(doc), part, np.int32)),
                    pa.array(rank),
                    pa.BinaryArray.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(ends), pa.py_buffer(ids.astype("<u4"))]),
                ],
                names=["doc_id", "start", "length", "doc_tokens", "part", "local_rank", "ids"],
            )


def best_fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths, within counts, whose sum comes closest to room without passing it."""
    reach, mask, layers = 1, (1 << (room + 1)) - 1, []
    for length in sorted((x for x, n in counts.items() if n and x <= room), reverse=True):
        left, m = min(counts[length], room // length), 1
        while left:
            m = min(m, left)
            now = (reach | reach << (m * length)) & mask
            if now != reach:
                layers.append((length, m, reach))
                reach = now
            left, m = left - m, m * 2
        if reach >> room:
            break
    at, taken = reach.bit_length() - 1, {}
    for length, m, before in reversed(layers):
        if not before >> at & 1:
            taken[length] = taken.get(length, 0) + m
            at -= m * length
    return taken


def plan_windows(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Places (length, first rank, end rank, first sequence, offset) for all pieces: those of a rank range stand at offset of successive sequences."""
    left = {x: n for x, n in counts.items() if n}
    used, places, sequence = dict.fromkeys(left, 0), [], 0
    while left:
        longest = max(left)
        fill = best_fill(left | {longest: left[longest] - 1}, capacity - longest)
        fill[longest] = fill.get(longest, 0) + 1
        times, offset = min(left[x] // m for x, m in fill.items()), 0
        for length in sorted(fill, reverse=True):
            for _ in range(fill[length]):
                places.append((length, used[length], used[length] + times, sequence, offset))
                used[length] += times
                offset += length
            left[length] -= times * fill[length]
            if not left[length]:
                del left[length]
        sequence += times
    return places


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids.

    Null and empty texts are documents of the end id alone. Rows may repeat; each is packed. An empty table gives no
    rows. The ids are written once to the shared folder; the driver gets the histogram of lengths (capacity rows at
    most), and ranks over all documents come from counts per written part and length.
    """
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    cut = source.mapInArrow(partial(cut_partition, path=tokenizer, capacity=capacity, end_id=end_id), PIECE_SCHEMA)
    spark_cut = _written(cut)
    counts = materialize(spark_cut.groupBy(F.col("part").alias("_part"), F.col("length").alias("_len")).agg(F.count(F.lit(1)).alias("_n")), "pack-counts")
    histogram = {r["_len"]: r["_n"] for r in counts.groupBy("_len").agg(F.sum("_n").alias("_n")).collect()}
    places = spark.createDataFrame(plan_windows(histogram, capacity), PLACE_SCHEMA)
    before = Window.partitionBy("_len").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("_part", "_len", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    ranked = spark_cut.join(small(materialize(bases, "pack-bases")), (F.col("part") == F.col("_part")) & (F.col("length") == F.col("_len")))
    ranked = ranked.withColumn("_rank", F.col("_base") + F.col("local_rank"))
    # A place for each length of each multiset: some thousands of rows, bounded by the capacity.
    at = (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_rank_from")) & (F.col("_rank") < F.col("_rank_to"))
    return ranked.join(F.broadcast(places), at).select(
        "doc_id", "start", F.col("length").cast("bigint").alias("length"), "doc_tokens",
        (F.col("_first_sequence") + F.col("_rank") - F.col("_rank_from")).alias("sequence_id"), F.col("_offset").alias("offset"), "ids",
    )


def _written(cut: DataFrame) -> DataFrame:
    from .common import fresh_dir

    path = fresh_dir(cut.sparkSession, "pack-pieces")
    cut.write.option("compression", "zstd").parquet(path)
    return cut.sparkSession.read.schema(cut.schema).parquet(path)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id, length, ids (bytes of the pieces in order of offset)."""
    rows = packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("_p"))
    return rows.select("sequence_id", "length", F.expr("aggregate(_p, cast('' as binary), (a, x) -> concat(a, x.ids))").alias("ids"))


def digest(docs: DataFrame, tokenizer: str) -> DataFrame:
    return pack(docs, tokenizer).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
