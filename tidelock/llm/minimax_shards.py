"""Sharding by minimax contiguous partition, with DataFrame functions only.

Equal texts are never parted: groups of them, in the order of their hashes, are the atomic groups. Sizes of 16,384 ranges
of hashes (a bounded list) go to the driver, where a binary search finds the smallest capacity at which a greedy pass
needs no more shards than there are. Only the ranges that a cut can fall into are then split again and again, until each
is one group: so the capacity is the least one over the groups themselves. The cuts then made keep to it and lie as near
to even as it allows. Rows learn their shard from 23 comparisons, without a join. Slots come from each written part's
order and from counts by part and shard, so no task gathers a shard.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, small

SHARDS, UNIT_BITS, ROW_BYTES = 24, 14, 8
#: Bits of the hash by which ranges are split at a time.
SPLIT_BITS = 8


def least_capacity(sizes: list[int], shards: int) -> int:
    """The smallest capacity with which the sizes, in order, fill at most so many shards."""
    prefix = np.concatenate([[0], np.cumsum(np.asarray(sizes, np.int64))])

    def fits(capacity: int) -> bool:
        at = 0
        for _ in range(shards):
            at = int(np.searchsorted(prefix, prefix[at] + capacity, "right")) - 1
            if at >= len(sizes):
                return True
        return at >= len(sizes)

    low, high = max(max(sizes, default=0), -(-int(prefix[-1]) // shards)), int(prefix[-1])
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if fits(mid) else (mid + 1, high)
    return low


def cuts(sizes: list[int], shards: int) -> list[int]:
    """First group of each shard after the first. No shard passes least_capacity(); each ends as near an even share of what is left as that allows."""
    n, capacity = len(sizes), least_capacity(sizes, shards)
    prefix = np.concatenate([[0], np.cumsum(np.asarray(sizes, np.int64))])
    reach = np.searchsorted(prefix, prefix + capacity, "right") - 1
    need = np.zeros(n + 1, np.int64)
    for i in range(n - 1, -1, -1):
        need[i] = 1 + need[reach[i]]
    out, at = [], 0
    for left in range(shards - 1, 0, -1):
        target = prefix[at] + (prefix[-1] - prefix[at]) / (left + 1)
        end = int(np.searchsorted(prefix, target))
        if end > at and end <= n and target - prefix[end - 1] < prefix[end] - target:
            end -= 1
        first = int(np.searchsorted(-need, -left))  # the first place from which the shards left suffice
        at = max(at, first, min(end, int(reach[at])))
        out.append(at)
    return out


def _ranges(rows: DataFrame, bits: int) -> np.ndarray:
    """(first hash, last hash, size) of the groups in each range of hashes that share their upper bits."""
    got = rows.groupBy(F.shiftright("_h", 64 - bits).alias("_k")).agg(F.min("_h").alias("a"), F.max("_h").alias("z"), F.sum("size").alias("s")).toArrow()
    return np.array(sorted(zip(*(got[c].to_pylist() for c in "azs"), strict=True)), np.int64).reshape(-1, 3)


def group_ranges(rows: DataFrame, shards: int, bits: int = UNIT_BITS, step: int = SPLIT_BITS) -> np.ndarray:
    """Ranges (first hash, last hash, size) of the groups, in order, whose least capacity is that of the groups themselves. rows: _h, size; written."""
    units = _ranges(rows, bits)
    while bits < 64:
        # With a capacity from `low` on, cut j lies after what whole ranges fill at `low`, and not after j times `high`.
        sizes, prefix = units[:, 2].tolist(), np.concatenate([[0], np.cumsum(units[:, 2])])
        high = least_capacity(sizes, shards)
        low = max([-(-int(prefix[-1]) // shards), *units[units[:, 0] == units[:, 1], 2].tolist()])
        spans, at = [], 0
        for j in range(1, shards):
            at = min(max(at, int(np.searchsorted(prefix, prefix[at] + low, "right")) - 1), len(sizes))
            upto = int(np.searchsorted(prefix, j * high, "left"))
            part = units[at:upto]
            if low < high and (part[:, 0] != part[:, 1]).any():
                spans.append((at, upto))
        if not spans:
            break
        inside, split = np.zeros(len(units), bool), F.lit(False)
        for a, b in spans:
            inside[a:b] = True
        starts, ends = np.flatnonzero(np.diff(inside.astype(int), prepend=0) == 1), np.flatnonzero(np.diff(inside.astype(int), append=0) == -1)
        for a, b in zip(starts, ends, strict=True):
            split = split | F.col("_h").between(int(units[a, 0]), int(units[b, 1]))
        bits = min(64, bits + step)
        finer = np.concatenate([units[~inside], _ranges(rows.where(split), bits)])
        units = finer[np.argsort(finer[:, 0])]
    return units


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row.

    size is the UTF-8 bytes of the text plus 8; a null text counts as empty and shares its group. Repeated rows each
    get a slot. Null ids are kept. An empty table gives no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = materialize(
        docs.select(
            F.col("doc_id").cast("bigint").alias("doc_id"), (F.octet_length(text) + F.lit(ROW_BYTES)).cast("bigint").alias("size"),
            F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.xxhash64(text).alias("_h"),
        ), "shard-rows",
    )
    units = group_ranges(rows.select("_h", "size"), shards)
    shard = F.lit(0)
    for c in cuts(units[:, 2].tolist(), shards):
        if c < len(units):
            shard = shard + (F.col("_h") >= F.lit(int(units[c, 0]))).cast("int")
    placed = rows.withColumn("shard", shard).sortWithinPartitions("shard", "_h", "doc_id").withColumn("_at", F.monotonically_increasing_id())
    placed = materialize(placed.withColumns({"_part": F.shiftright("_at", 33), "_at": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))}), "shard-placed")
    counts = placed.groupBy(F.col("_part").alias("_p"), F.col("shard").alias("_s")).agg(F.count(F.lit(1)).alias("_n"))
    inside = Window.partitionBy("_p").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("_s").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.coalesce(F.sum("_n").over(inside), F.lit(0))
    shifts = materialize(counts.select("_p", "_s", shift.alias("_shift")), "shard-shifts")
    return placed.join(small(shifts), (F.col("_part") == F.col("_p")) & (F.col("shard") == F.col("_s"))).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_at") + F.col("_shift")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
