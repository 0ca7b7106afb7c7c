"""Column builders over ordered windows. NULL is the only missing value: divisions are try_divide, NaN never enters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

START = Window.unboundedPreceding


def clean(c: Column) -> Column:
    """NaN and infinities as NULL."""
    c = c.cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def pct_change(c: Column, w: WindowSpec, k: int = 1) -> Column:
    return F.try_divide(c, F.lag(c, k).over(w)) - 1


def diff_from_zero(c: Column, w: WindowSpec) -> Column:
    """First difference whose first row is the value itself."""
    return c - F.coalesce(F.lag(c).over(w), F.lit(0.0))


def rolling_mean(c: Column, w: WindowSpec, rows: int, least: int = 1, lagged: bool = True) -> Column:
    frame = w.rowsBetween(-rows, -1) if lagged else w.rowsBetween(1 - rows, 0)
    return F.when(F.count(c).over(frame) >= least, F.avg(c).over(frame))


def rolling_std(c: Column, w: WindowSpec, rows: int, least: int, lagged: bool = True) -> Column:
    frame = w.rowsBetween(-rows, -1) if lagged else w.rowsBetween(1 - rows, 0)
    return F.when(F.count(c).over(frame) >= least, F.stddev_samp(c).over(frame))


def causal_volatility(ret: Column, w: WindowSpec, rows: int = 20) -> Column:
    """Trailing sample deviation up to the row before; expanding (two values at least) where the window is too short."""
    every = w.rowsBetween(START, -1)
    return F.coalesce(rolling_std(ret, w, rows, max(2, rows // 2)), F.when(F.count(ret).over(every) >= 2, F.stddev_samp(ret).over(every)))


def equity(ret: Column, w: WindowSpec) -> Column:
    return F.product(1 + F.coalesce(ret, F.lit(0.0))).over(w.rowsBetween(START, 0))


def drawdown(eq: Column, w: WindowSpec) -> Column:
    """eq / running peak - 1, the peak at least 1. eq is a column, not a window expression."""
    return eq / F.greatest(F.max(eq).over(w.rowsBetween(START, 0)), F.lit(1.0)) - 1


def carried(c: Column, w: WindowSpec) -> Column:
    """Last value that is not null."""
    return F.last(c, True).over(w.rowsBetween(START, 0))


def average_rank(c: Column, *keys: str) -> Column:
    """Ascending rank within keys, ties averaged; nulls share the lowest ranks."""
    rank = F.rank().over(Window.partitionBy(*keys).orderBy(c.asc_nulls_first()))
    return rank + (F.count(F.lit(1)).over(Window.partitionBy(*keys, c)) - 1) / 2


def island(change: Column, w: WindowSpec) -> Column:
    """Running number of changes: the id of a run."""
    return F.sum(change.cast("long")).over(w.rowsBetween(START, 0))


def correlation(x: Column, y: Column, least: int) -> Column:
    """Aggregate: Pearson correlation of the pairs of finite values; null for fewer than `least` or a constant, where corr itself divides by zero."""
    x, y = clean(x), clean(y)
    pair = x.isNotNull() & y.isNotNull()
    x, y = F.when(pair, x), F.when(pair, y)
    return F.when(F.count(x) >= least, F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


def autocorrelations(df: DataFrame, value: str, order: str, lags: int) -> DataFrame:
    """(lag, rho) for lags 1.. of one series: sum(x_t x_t-k) / sum(x^2) on demeaned values, 0 without variance."""
    x = df.where(F.col(value).isNotNull()).crossJoin(F.broadcast(df.agg(F.avg(value).alias("_m")))).select(F.col(order).alias("_o"), (F.col(value) - F.col("_m")).alias("_x"))
    w = Window.orderBy("_o")
    x = x.select("_x", *[F.lag("_x", k).over(w).alias(f"_l{k}") for k in range(1, lags + 1)])
    sums = x.agg(F.sum(F.col("_x") * F.col("_x")).alias("_s"), *[F.sum(F.col("_x") * F.col(f"_l{k}")).alias(f"_c{k}") for k in range(1, lags + 1)])
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), F.coalesce(F.try_divide(F.col(f"_c{k}"), F.col("_s")), F.lit(0.0)).alias("rho")) for k in range(1, lags + 1)]))
    return sums.select(pairs.alias("_p")).select("_p.*")
