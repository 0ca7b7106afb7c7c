"""Regimes by trailing volatility, drawdown and trend, and performance within them."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import windows as wn


def volatility(df: DataFrame, value: str, rows: int = 63, periods: float = 252.0, keys: tuple[str, ...] = ()) -> DataFrame:
    """df with _vol: annual trailing deviation up to the row before."""
    w = Window.partitionBy(*keys).orderBy("timestamp")
    return df.withColumn("_vol", wn.rolling_std(F.col(value), w, rows, max(5, rows // 2)) * math.sqrt(periods))


def volatility_regimes(df: DataFrame, value: str, rows: int = 63, quantiles: tuple[float, ...] = (1 / 3, 2 / 3), labels: tuple[str, ...] = ("low", "normal", "high"), periods: float = 252.0) -> DataFrame:
    """df with regime: bins (a, b] of trailing volatility at its quantiles over the sample; tied cuts leave it null."""
    v = volatility(df, value, rows, periods)
    cuts = v.agg(*[F.expr(f"percentile(_vol, {q!r})").alias(f"_q{i}") for i, q in enumerate(quantiles)])
    v = v.crossJoin(F.broadcast(cuts))
    out = F.when(F.col("_vol") <= F.col("_q0"), labels[0])
    for i in range(1, len(quantiles)):
        out = out.when(F.col("_vol") <= F.col(f"_q{i}"), labels[i])
    out = out.when(F.col("_vol").isNotNull(), labels[-1])
    for i in range(1, len(quantiles)):
        out = F.when(F.col(f"_q{i}") > F.col(f"_q{i - 1}"), out)
    return v.withColumn("regime", out).drop("_vol", *[f"_q{i}" for i in range(len(quantiles))])


def drawdown_regimes(df: DataFrame, value: str, cuts: tuple[float, ...] = (-0.1, -0.2), labels: tuple[str, ...] | None = None) -> DataFrame:
    """df with regime: bins [a, b) of the drawdown at the row before, null on the first. labels: from no drawdown to the deepest, one more than cuts."""
    names = labels or tuple(["normal", "drawdown", "deep_drawdown"][: len(cuts) + 1] if len(cuts) <= 2 else [f"level_{i}" for i in range(len(cuts) + 1)])
    w = Window.orderBy("timestamp")
    d = df.withColumn("_e", wn.equity(F.col(value), w)).withColumn("_d", wn.drawdown(F.col("_e"), w)).withColumn("_d", F.lag("_d").over(w))
    out = F.when(F.col("_d").isNull(), F.lit(None).cast("string"))
    for c, name in zip(sorted(cuts), reversed(names), strict=False):
        out = out.when(F.col("_d") < c, name)
    return d.withColumn("regime", out.otherwise(names[0])).drop("_e", "_d")


def trend_regimes(df: DataFrame, value: str, rows: int = 126) -> DataFrame:
    """df with regime, bull or bear: sign of the growth over the `rows` rows before; null until there are so many."""
    w = Window.orderBy("timestamp").rowsBetween(-rows, -1)
    g = F.when(F.count(F.lit(1)).over(w) == rows, F.product(1 + F.coalesce(F.col(value), F.lit(0.0))).over(w) - 1)
    return df.withColumn("_g", g).withColumn("regime", F.when(F.col("_g") > 0, "bull").when(F.col("_g").isNotNull(), "bear")).drop("_g")


def performance(df: DataFrame, value: str, periods: float = 252.0, least: int = 40) -> DataFrame:
    """Per regime: n, time_share, mean, vol, sharpe (null for too few rows), hit_rate, pnl_share, first (to order by)."""
    rows = df.where(F.col("regime").isNotNull() & F.col(value).isNotNull())
    every = rows.agg(F.count(F.lit(1)).alias("_n"), F.sum(value).alias("_s"))
    each = rows.groupBy("regime").agg(
        F.count(F.lit(1)).alias("n"), (F.avg(value) * periods).alias("mean"), (F.stddev_samp(value) * math.sqrt(periods)).alias("vol"),
        F.avg((F.col(value) > 0).cast("double")).alias("hit_rate"), F.sum(value).alias("_sum"), F.min("timestamp").alias("first"),
    ).crossJoin(F.broadcast(every))
    sharpe = F.when(F.col("n") >= least, F.try_divide(F.col("mean"), F.col("vol")))
    return each.select("regime", "n", (F.col("n") / F.col("_n")).alias("time_share"), "mean", "vol", sharpe.alias("sharpe"), "hit_rate", F.try_divide(F.col("_sum"), F.col("_s")).alias("pnl_share"), "first")
