"""Data-quality rules. Counters of all row-wise rules are one aggregate per table; ordered rules share one window pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PRICES = ("open", "high", "low", "close")


def row_counters(df: DataFrame, keys: list[str]) -> DataFrame:
    """Per symbol: rows, duplicate timestamps, missing, infinite, non-positive and impossible prices."""
    eps = 1e-12
    whole = F.expr(" and ".join(f"{c} is not null" for c in PRICES))
    o, h, lo, c = (F.col(x) for x in PRICES)
    impossible = whole & ((h < F.greatest(o, c, lo) - eps) | (lo > F.least(o, c, h) + eps))
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        (F.count("timestamp") - F.count_distinct("timestamp")).alias("n_duplicate_times"),
        F.count_if(impossible).alias("n_impossible"),
        F.count_if(F.expr(" or ".join(f"{x} <= 0" for x in PRICES))).alias("n_nonpositive"),
        F.count_if(F.expr(" or ".join(f"abs({x}) = double('Infinity')" for x in PRICES))).alias("n_infinite"),
        *[F.count_if(F.col(x).isNull() | F.isnan(x)).alias(f"n_missing_{x}") for x in PRICES],
    )


def duplicate_rows(df: DataFrame) -> DataFrame:
    """n_duplicate_rows: later copies of whole rows."""
    return df.groupBy(*df.columns).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("n_duplicate_rows"))


def examples(df: DataFrame, condition: Column, value: str = "timestamp", seq: str = "_seq", k: int = 5) -> list[str]:
    """The first k different values, in input order, of the rows that meet a condition."""
    rows = df.where(condition).groupBy(F.col(value).cast("string").alias("v")).agg(F.min(seq).alias("_at"))
    return [r["v"] for r in rows.orderBy("_at").limit(k).collect()]


def repeated(df: DataFrame, keys: list[str], seq: str = "_seq", k: int = 5) -> list[str]:
    """The first k timestamps that repeat within keys, in the order of their second row."""
    rows = df.where("timestamp is not null").groupBy(*keys, "timestamp").agg(F.count(F.lit(1)).alias("_n"), F.max(seq).alias("_at")).where("_n > 1")
    return [r["v"] for r in rows.groupBy(F.col("timestamp").cast("string").alias("v")).agg(F.min("_at").alias("_at")).orderBy("_at").limit(k).collect()]


def missing_values(df: DataFrame, besides: tuple[str, ...] = ("timestamp",)) -> DataFrame:
    """One row: per column the number of nulls and NaN."""
    kinds = {c: t for c, t in df.dtypes if c not in besides}
    return df.agg(*[F.count_if(F.col(c).isNull() | F.isnan(c) if t in ("float", "double") else F.col(c).isNull()).alias(c) for c, t in kinds.items()])


def first_backward(df: DataFrame, time: str, seq: str, keys: list[str]) -> DataFrame:
    """Per key, the first strict decrease of time in input order: (seq, before, after)."""
    w = Window.partitionBy(*keys).orderBy(seq)
    rows = df.where(F.col(time).isNotNull()).withColumn("_p", F.lag(time).over(w)).where(F.col(time) < F.col("_p"))
    return rows.groupBy(*keys).agg(F.min_by(F.struct(F.col(seq).alias("seq"), F.col("_p").alias("before"), F.col(time).alias("after")), F.col(seq)).alias("_r")).select(*keys, "_r.*")


def out_of_order(df: DataFrame, time: str, seq: str, keys: list[str]) -> DataFrame:
    """Per key: strict decreases of time in input order."""
    w = Window.partitionBy(*keys).orderBy(seq)
    rows = df.where(F.col(time).isNotNull()).withColumn("_p", F.lag(time).over(w))
    return rows.groupBy(*keys).agg(F.count_if(F.col(time) < F.col("_p")).alias("n_backward"))


def gaps(df: DataFrame, multiple: float, keys: list[str]) -> DataFrame:
    """Per symbol: median spacing (seconds), gaps over so many medians, longest gap. Below a day's spacing, gaps that cross a date are session breaks."""
    w = Window.partitionBy(*keys).orderBy("timestamp")
    nxt = F.lead("timestamp").over(w)
    steps = df.select(*keys, "timestamp").distinct().withColumn("_next", nxt).where("_next is not null")
    seconds = (F.expr("unix_micros(cast(_next as timestamp)) - unix_micros(cast(timestamp as timestamp))") / 1e6).cast("double")
    steps = steps.withColumns({"_gap": seconds, "_crosses": F.to_date("_next") > F.to_date("timestamp")})
    medians = steps.groupBy(*keys).agg(F.expr("percentile(_gap, 0.5)").alias("median_seconds"), F.count(F.lit(1)).alias("_n"))
    big = (F.col("_gap") > multiple * F.col("median_seconds")) & ~((F.col("median_seconds") < 86400) & F.col("_crosses")) & (F.col("_n") >= 2)
    return steps.join(medians, keys).groupBy(*keys).agg(F.max("median_seconds").alias("median_seconds"), F.count_if(big).alias("n_gaps"), F.max(F.when(big, F.col("_gap"))).alias("longest_gap"))


def stale_runs(df: DataFrame, value: str, least: int, keys: list[str]) -> DataFrame:
    """Per key: runs of `least` or more equal consecutive values, and the longest run."""
    w = Window.partitionBy(*keys).orderBy("timestamp")
    changed = F.col(value).eqNullSafe(F.lag(value).over(w))
    rows = df.where(F.col(value).isNotNull()).withColumn("_c", F.when(changed, 0).otherwise(1))
    runs = rows.withColumn("_run", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy(*keys, "_run").agg(F.count(F.lit(1)).alias("_len"))
    return runs.groupBy(*keys).agg(F.count_if(F.col("_len") >= least).alias("n_runs"), F.max("_len").alias("longest_run"))


def extreme_returns(df: DataFrame, value: str, limit: float, keys: list[str]) -> DataFrame:
    """Per key: returns beyond the limit, the worst one with its sign and its time. Prices that are not positive are null."""
    w = Window.partitionBy(*keys).orderBy("timestamp")
    p = F.when(F.col(value) > 0, F.col(value))
    rows = df.withColumn("_p", p).withColumn("_r", F.try_divide(F.col("_p"), F.lag("_p").over(w)) - 1)
    return rows.groupBy(*keys).agg(F.count_if(F.abs("_r") > limit).alias("n_extreme"), F.max_by("_r", F.struct(F.abs("_r"), "timestamp")).alias("worst"), F.max_by("timestamp", F.struct(F.abs("_r"), "timestamp")).alias("worst_time"))


def synchrony(df: DataFrame) -> DataFrame:
    """Per symbol of a panel: its share of all timestamps and those it lacks inside the span all symbols have."""
    times = df.select("timestamp", "symbol").distinct()
    spans = times.groupBy("symbol").agg(F.min("timestamp").alias("_a"), F.max("timestamp").alias("_b"))
    common = spans.agg(F.max("_a").alias("_from"), F.min("_b").alias("_to"))
    every = times.select("timestamp").distinct().crossJoin(F.broadcast(common)).agg(F.count(F.lit(1)).alias("_all"), F.count_if(F.col("timestamp").between(F.col("_from"), F.col("_to"))).alias("_inner"))
    own = times.crossJoin(F.broadcast(common)).groupBy("symbol").agg(F.count(F.lit(1)).alias("n_times"), F.count_if(F.col("timestamp").between(F.col("_from"), F.col("_to"))).alias("_own"))
    return own.crossJoin(F.broadcast(every)).select("symbol", "n_times", (F.col("n_times") / F.col("_all")).alias("coverage"), (F.col("_inner") - F.col("_own")).alias("n_missing_inside"))
