"""Temporal cross-validation: label intervals, purge, embargo, k-folds, walk-forward windows, combinatorial splits and paths.

Rows are (pos, start, end): position and the label's interval, in bars or microseconds. Folds are small driver tables joined to rows.
"""

from __future__ import annotations

import datetime as dt
import math
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import DataError
from ..shared import materialize, small

DAY_US = 86_400_000_000


def intervals(spark: SparkSession, n: int, horizon: int = 0) -> DataFrame:
    """Bar-mode labels of n rows: [i, min(i + horizon, n - 1)]."""
    return spark.range(n).select(F.col("id").alias("pos"), F.col("id").alias("start"), F.least(F.col("id") + horizon, F.lit(n - 1)).alias("end"))


def positions(df: DataFrame, *order: str, name: str = "pos") -> DataFrame:
    """df with the place of each row in the order of some columns, from 0. Ranges are sorted by themselves and shifted by the counts before them."""
    ranged = df.repartitionByRange(*[F.col(c).asc_nulls_first() for c in order]).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    ranged = materialize(ranged.withColumns({"_part": F.shiftright("_at", 33).cast("int"), "_at": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))}), "positions")
    counts = sorted((r["_part"], r["count"]) for r in ranged.groupBy("_part").count().collect())  # a row for each task
    starts = np.concatenate([[0], np.cumsum([n for _, n in counts])]).tolist()
    table = df.sparkSession.createDataFrame([(p, s) for (p, _), s in zip(counts, starts, strict=False)], "_part int, _start long")
    return ranged.join(F.broadcast(table), "_part").withColumn(name, F.col("_start") + F.col("_at")).drop("_part", "_at", "_start")


def ranks(df: DataFrame, column: str) -> DataFrame:
    """(column, rank) of each different value: ascending, ties averaged. Values are counted first, ranges of them ranked by themselves and shifted by the counts before them."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("_n")).repartitionByRange(F.col(column).asc_nulls_first())
    counts = materialize(counts.withColumn("_part", F.spark_partition_id()), "ranks")
    totals = sorted((r["_part"], r["_t"]) for r in counts.groupBy("_part").agg(F.sum("_n").alias("_t")).collect())  # a row for each task
    starts = np.concatenate([[0], np.cumsum([n for _, n in totals])]).tolist()
    table = df.sparkSession.createDataFrame([(p, s) for (p, _), s in zip(totals, starts, strict=False)], "_part int, _start long")
    before = F.sum("_n").over(Window.partitionBy("_part").orderBy(F.col(column).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1))
    rank = F.col("_start") + F.coalesce(before, F.lit(0)) + (F.col("_n") + 1) / 2
    return counts.join(F.broadcast(table), "_part").select(column, rank.cast("double").alias("rank"))


def event_intervals(df: DataFrame, start: str, end: str, *order: str) -> DataFrame:
    """Event-mode labels: (pos, start, end) in microseconds, pos by the order given (start by default). A row whose start lies before that of the row ahead, an end before its start, a missing time, and times with and without a zone side by side are errors."""
    kinds = {dict(df.dtypes)[c] for c in (start, end)}
    if kinds == {"timestamp", "timestamp_ntz"}:
        raise DataError("one of the label times has a time zone and the other has none")
    if kinds - {"timestamp", "timestamp_ntz", "date"}:
        raise DataError(f"label times must be timestamps or dates, not {sorted(kinds)}")
    if not df.where(F.col(start).isNull() | F.col(end).isNull()).isEmpty():
        raise DataError("a label lacks a time")
    micros = {c: F.unix_micros(F.col(c).cast("timestamp")) for c in (start, end)}
    rows = positions(df, *(order or (start, end))).select("pos", micros[start].alias("start"), micros[end].alias("end"))
    check_intervals(rows)
    return rows


def check_intervals(rows: DataFrame) -> None:
    """Raises where a label ends before it starts or starts before the label of the row ahead: neighbours meet by their place, without a window over all."""
    if first := rows.where("end < start").orderBy("pos").first():
        raise DataError(f"the label at position {first['pos']} ends before it starts")
    ahead = rows.select((F.col("pos") + 1).alias("pos"), F.col("start").alias("_before"))
    if first := rows.join(ahead, "pos").where("start < _before").orderBy("pos").first():
        raise DataError(f"labels are not sorted by start: position {first['pos']} is earlier than the one ahead")


def duration_us(value) -> int:
    """Microseconds of a duration: text such as '5D' or '36 hours', a timedelta or a Timedelta. Negative ones and what is no duration are errors."""
    try:
        found = pd.Timedelta(value)
    except (ValueError, TypeError) as e:
        raise DataError(f"{value!r} is no duration") from e
    if found is pd.NaT or found < pd.Timedelta(0):
        raise DataError(f"a duration is not negative: {value!r}")
    return found.value // 1000


def is_duration(value) -> bool:
    return isinstance(value, str | dt.timedelta | np.timedelta64 | pd.Timedelta)


def format_seconds(seconds: float | None) -> str:
    """Days and hh:mm:ss, with fractions where there are any."""
    if seconds is None or seconds != seconds:
        return "-"
    sign, left = ("-" if seconds < 0 else ""), round(abs(seconds) * 1_000_000)
    days, left = divmod(left, DAY_US)
    whole, micros = divmod(left, 1_000_000)
    text = f"{whole // 3600:02d}:{whole // 60 % 60:02d}:{whole % 60:02d}" + (f".{micros:06d}".rstrip("0") if micros else "")
    return sign + (f"{days} day{'s' if days != 1 else ''} " if days else "") + text


def fold_bounds(n: int, k: int) -> list[tuple[int, int]]:
    """Bounds of k blocks; the first n mod k have one row more."""
    q, r = divmod(n, k)
    ends = [q * (i + 1) + min(i + 1, r) for i in range(k)]
    return list(zip([0, *ends[:-1]], ends, strict=True))


def embargo_rows(n: int, embargo: float | int) -> int:
    """A fraction below 1 is rounded up to rows; a whole number is rows."""
    if isinstance(embargo, float) and not embargo.is_integer():
        if not 0 <= embargo < 1:
            raise DataError("an embargo is a fraction below 1 or a whole number of rows")
        return math.ceil(embargo * n)
    if embargo < 0:
        raise DataError("an embargo is not negative")
    return int(embargo)


def purged_splits(spark: SparkSession, rows: DataFrame, blocks: dict[int, list[tuple[int, int]]], n: int, embargo: int | str | dt.timedelta = 0) -> DataFrame:
    """(split, pos, role): role is test, train, purged or embargo. blocks: test blocks [first, end) of each split, by position.

    Purged: intervals that touch a block's span [its first start, its greatest end], ends included. Embargoed: the next
    rows after the later of the block's end and the last row that starts within the span; or, with a duration, the rows
    that start after the span and not later than that much after it. A split without training rows is an error.
    """
    us = duration_us(embargo) if is_duration(embargo) else 0
    table = spark.createDataFrame([(s, a, b) for s, bs in blocks.items() for a, b in bs], "split int, a long, b long")
    spans = rows.join(F.broadcast(table), (F.col("pos") >= F.col("a")) & (F.col("pos") < F.col("b"))).groupBy("split", "a", "b").agg(F.min("start").alias("lo"), F.max("end").alias("hi"))
    if is_duration(embargo) or embargo == 0:
        anchors, after = spans.withColumn("anchor", F.lit(0).cast("long")), f"start > s.hi and start <= s.hi + {us}"
    else:
        # The greatest position that starts inside each span: one aggregate over rows, for a table of as many spans as blocks.
        anchors = rows.join(F.broadcast(spans), F.col("start") <= F.col("hi")).groupBy("split", "a", "b", "lo", "hi").agg(F.greatest(F.max("pos"), F.col("b") - 1).alias("anchor"))
        after = f"pos > s.anchor and pos <= s.anchor + {embargo}"
    each = anchors.groupBy("split").agg(F.collect_list(F.struct("a", "b", "lo", "hi", "anchor")).alias("spans"))
    all_rows = rows.crossJoin(F.broadcast(each))  # one row per split and position is the result
    role = F.expr(f"""case when exists(spans, s -> pos >= s.a and pos < s.b) then 'test'
        when exists(spans, s -> start <= s.hi and end >= s.lo) then 'purged'
        when exists(spans, s -> {after}) then 'embargo' else 'train' end""")
    return all_rows.select("split", "pos", role.alias("role"))


def require_training(splits: DataFrame) -> DataFrame:
    """splits, or an error that names the first split without a training row."""
    empty = splits.groupBy("split").agg(F.count_if(F.col("role") == "train").alias("_n")).where("_n = 0").orderBy("split").first()
    if empty:
        raise DataError(f"split {empty['split']}: purge and embargo leave no row to train on")
    return splits


def _embargo(n: int, embargo):
    return embargo if is_duration(embargo) else embargo_rows(n, embargo)


def kfold(spark: SparkSession, rows: DataFrame, n: int, k: int, embargo: float | int | str = 0) -> DataFrame:
    """Purged k-fold. A duration as embargo needs rows of event_intervals()."""
    return purged_splits(spark, rows, {i: [b] for i, b in enumerate(fold_bounds(n, k))}, n, _embargo(n, embargo))


def combinatorial_blocks(n: int, groups: int, k: int) -> tuple[list[tuple[int, ...]], dict[int, list[tuple[int, int]]]]:
    """Lexicographic k-subsets of groups and the contiguous test blocks of each."""
    bounds, combos = fold_bounds(n, groups), list(combinations(range(groups), k))
    blocks = {}
    for s, combo in enumerate(combos):
        merged: list[tuple[int, int]] = []
        for g in combo:
            a, b = bounds[g]
            merged = [*merged[:-1], (merged[-1][0], b)] if merged and merged[-1][1] == a else [*merged, (a, b)]
        blocks[s] = merged
    return combos, blocks


def combinatorial(spark: SparkSession, rows: DataFrame, n: int, groups: int, k: int, embargo: float | int | str = 0) -> DataFrame:
    return purged_splits(spark, rows, combinatorial_blocks(n, groups, k)[1], n, _embargo(n, embargo))


def group_of(n: int, groups: int):
    """Column: the group of a position, in closed form (the first n mod groups have one more)."""
    q, r = divmod(n, groups)
    p = F.col("pos")
    return F.when(p < r * (q + 1), F.floor(p / (q + 1))).otherwise(r + F.floor((p - r * (q + 1)) / max(q, 1))).cast("int")


def paths(spark: SparkSession, groups: int, k: int) -> DataFrame:
    """(path, grp, split): path p takes, in each group, the group's p-th split."""
    pairs = spark.createDataFrame([(s, g) for s, c in enumerate(combinations(range(groups), k)) for g in c], "split int, grp int")
    return pairs.select((F.row_number().over(Window.partitionBy("grp").orderBy("split")) - 1).alias("path"), "grp", "split")


def assemble(path_table: DataFrame, predictions: DataFrame) -> DataFrame:
    """predictions (split, grp, pos, value) put together along paths."""
    return F.broadcast(path_table).join(predictions, ["split", "grp"]).select("path", "pos", "value")


def walk_forward(n: int, train_fraction: float, k: int, gap: int = 0, expanding: bool = True) -> list[tuple[int, int, int, int, int]]:
    """(fold, train_from, train_end, test_from, test_end); rows left over at the end are not used."""
    first = math.floor(train_fraction * n)
    size = (n - first - gap) // k
    if first < 1 or size < 1:
        raise DataError("too few rows for these walk-forward windows")
    return [(i, 0 if expanding else i * size, first + i * size, first + gap + i * size, first + gap + (i + 1) * size) for i in range(k)]


def chronological(n: int, test_size: float | int = 0.25, gap: int = 0) -> tuple[int, int]:
    """End of train and start of test: the last rows are the test, a fraction rounded half to even."""
    test = round(test_size * n) if isinstance(test_size, float) else test_size
    if not 0 < test < n - gap:
        raise DataError("nothing is left to train or to test on")
    return n - test - gap, n - test


def diagram(folds: list[tuple[int, int, int, int, int]], n: int, width: int = 60) -> str:
    def line(f):
        cells = ["." for _ in range(width)]
        for a, b, mark in ((f[1], f[2], "="), (f[3], f[4], "#")):
            for i in range(a * width // n, max(a * width // n + 1, b * width // n)):
                cells[min(i, width - 1)] = mark
        return f"{f[0]:>3} " + "".join(cells)

    return "\n".join(line(f) for f in folds)


def runs(df: DataFrame, *keys: str) -> DataFrame:
    """(keys, first, last): the runs of neighbouring positions, by the difference of position and rank within keys."""
    w = Window.partitionBy(*keys).orderBy("pos")
    return df.select(*keys, "pos").distinct().withColumn("_g", F.col("pos") - F.row_number().over(w)).groupBy(*keys, "_g").agg(F.min("pos").alias("first"), F.max("pos").alias("last")).drop("_g")


def leaks(splits: DataFrame, rows: DataFrame) -> DataFrame:
    """(split, pos) of training rows that are test rows too, or whose label touches the span of a run of test rows. A span for each run, not a pair of rows for each pair."""
    test = splits.where("role = 'test'")
    blocks = runs(test, "split")
    at = test.join(rows, "pos").join(small(blocks), "split").where((F.col("pos") >= F.col("first")) & (F.col("pos") <= F.col("last")))
    spans = at.groupBy("split", "first", "last").agg(F.min("start").alias("lo"), F.max("end").alias("hi"))
    train = splits.where("role = 'train'")
    both = train.select("split", "pos").intersect(test.select("split", "pos"))
    touching = train.join(rows, "pos").join(small(spans), "split").where((F.col("start") <= F.col("hi")) & (F.col("end") >= F.col("lo")))
    return touching.select("split", "pos").union(both).distinct()


def assert_no_leak(splits: DataFrame, rows: DataFrame) -> None:
    """Raises where training and test rows, or their labels, overlap."""
    if not leaks(splits, rows).isEmpty():
        raise DataError("train and test labels overlap")
