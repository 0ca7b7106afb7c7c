"""Statistics of return series as aggregates, and the scalars made from them."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import normal

TINY = 1e-14


def periodic_rate(rate: float, periods: float) -> float:
    if periods <= 0 or rate <= -1:
        raise ValueError("periods must be positive and the rate above -1")
    return (1 + rate) ** (1 / periods) - 1


def moments_by(df: DataFrame, value: str, keys: list[str], rate: float = 0.0, periods: float = 252.0) -> DataFrame:
    """Per key: n, mean, std (sample), skew and kurt (population, kurt of a normal is 3) of values that are not null; skew and kurt are null without variance."""
    x = F.col(value) - periodic_rate(rate, periods)
    scale, std = F.max(F.abs(x)), F.stddev_samp(x)
    flat = std <= TINY * scale
    return df.where(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(x).alias("mean"), std.alias("std"), F.when(~flat, F.skewness(x)).alias("skew"), F.when(~flat, F.kurtosis(x) + 3).alias("kurt"),
        F.when(~flat, F.try_divide(F.avg(x), std)).alias("sharpe"),
    )


def sharpe_by(df: DataFrame, value: str, keys: list[str], periods: float = 252.0, rate: float = 0.0) -> DataFrame:
    """Per key: n, total and annual Sharpe ratio; null for fewer than two values or none that vary."""
    m = moments_by(df, value, keys, rate, periods)
    return m.select(*keys, "n", (F.col("mean") * F.col("n")).alias("total"), (F.col("sharpe") * math.sqrt(periods)).alias("sharpe"))


def sharpe_error(m: DataFrame) -> DataFrame:
    """Moments with the standard error of the Sharpe ratio per period; null where its variance is not positive."""
    v = 1 - F.col("skew") * F.col("sharpe") + (F.col("kurt") - 1) / 4 * F.col("sharpe") * F.col("sharpe")
    return m.withColumn("sharpe_se", F.when((v > 0) & (F.col("n") > 1), F.sqrt(v / (F.col("n") - 1))))


def psr_z(m: DataFrame, benchmark: float = 0.0) -> DataFrame:
    """Moments with z of the probabilistic Sharpe ratio against a Sharpe ratio per period."""
    return sharpe_error(m).withColumn("psr_z", F.try_divide(F.col("sharpe") - benchmark, F.col("sharpe_se")))


def psr(sharpe: float, n: int, skew: float, kurt: float, benchmark: float = 0.0) -> tuple[float, float]:
    v = 1 - skew * sharpe + (kurt - 1) / 4 * sharpe**2
    if v <= 0 or n < 2:
        return math.nan, math.nan
    z = (sharpe - benchmark) * math.sqrt(n - 1) / math.sqrt(v)
    return normal.cdf(z), z


def least_track_record(sharpe: float, skew: float, kurt: float, benchmark: float = 0.0, confidence: float = 0.95) -> float:
    if sharpe <= benchmark:
        return math.inf
    v = 1 - skew * sharpe + (kurt - 1) / 4 * sharpe**2
    return 1 + v * (normal.quantile(confidence) / (sharpe - benchmark)) ** 2


def deflated_sharpe(m: dict, n_trials: float, variance: float | None = None, exact: bool = False) -> dict:
    """PSR at the Sharpe ratio that the best of so many trials without skill would reach. m: n, sharpe, skew, kurt per period."""
    v = 1 / (m["n"] - 1) if variance is None else variance
    top = normal.expected_max(round(n_trials)) if exact else normal.expected_max_closed(n_trials)
    hurdle = math.sqrt(v) * top
    p, z = psr(m["sharpe"], m["n"], m["skew"], m["kurt"], hurdle)
    return {"dsr": p, "z": z, "hurdle": hurdle, "variance": v}


def adjusted_sharpe(sharpe: float, rho: list[float], q: int) -> float:
    """Annual Sharpe ratio under autocorrelation: sharpe * q / sqrt(q + 2 * sum (q - k) rho_k)."""
    d = q + 2 * sum((q - k) * r for k, r in enumerate(rho, 1) if k < q)
    return sharpe * q / math.sqrt(d) if d > 0 else math.nan


def growth_by(df: DataFrame, value: str, keys: list[str], periods: float = 252.0) -> DataFrame:
    """Per key: compound annual growth; -1 once all is lost."""
    g = F.product(1 + F.col(value))
    return df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.when(g > 0, F.pow(g, periods / F.count(F.lit(1))) - 1).otherwise(-1.0).alias("cagr"))


def max_drawdown_by(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("timestamp").rowsBetween(Window.unboundedPreceding, 0)
    rows = df.where(F.col(value).isNotNull()).withColumn("_e", F.product(1 + F.col(value)).over(w))
    rows = rows.withColumn("_d", F.col("_e") / F.greatest(F.max("_e").over(w), F.lit(1.0)) - 1)
    return rows.groupBy(*keys).agg(F.min("_d").alias("max_drawdown"))


def adjust_p(df: DataFrame, key: str, p: str, method: str) -> DataFrame:
    """(key, p, adjusted) by bonferroni, holm or bh. A list of p-values is one family, so one window."""
    n = F.count(F.lit(1)).over(Window.partitionBy())
    if method == "bonferroni":
        return df.select(key, p, F.least(F.lit(1.0), F.col(p) * n).alias("adjusted"))
    w = Window.orderBy(p, key)
    ranked = df.select(key, p, F.row_number().over(w).alias("_r"), n.alias("_n"))
    if method == "holm":
        step = F.max(F.col(p) * (F.col("_n") - F.col("_r") + 1)).over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, 0))
    elif method == "bh":
        step = F.min(F.col(p) * F.col("_n") / F.col("_r")).over(Window.orderBy(F.desc("_r")).rowsBetween(Window.unboundedPreceding, 0))
    else:
        raise ValueError(f"unknown method {method}")
    return ranked.select(key, p, F.least(F.lit(1.0), step).alias("adjusted"))
