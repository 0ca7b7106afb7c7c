"""Causality by perturbing the future: a causal strategy's weights up to a cutoff do not move when later rows do.

All trials run in one plan: bars are crossed with a small table of trials (cutoff, scheme), the strategy's windows take
the trial into their partitions, and one aggregate compares with the baseline. Draws are hashes of (seed, trial, symbol,
time), so they do not depend on partitioning.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.folds import positions
from ..shared import materialize, small

SCHEMES = ("additive", "multiplicative", "permute", "replace", "extreme")
PRICES = ("open", "high", "low", "close")


@dataclass(frozen=True)
class Bars:
    """What a strategy gets: the long frame, its partition keys, and windows over them."""

    df: DataFrame
    keys: tuple[str, ...] = ("symbol",)

    def ts_window(self) -> Window:
        return Window.partitionBy(*self.keys).orderBy("timestamp")

    def xs_window(self) -> Window:
        return Window.partitionBy(*[k for k in self.keys if k != "symbol"], "timestamp")


Strategy = Callable[[Bars], DataFrame]


def uniform(*parts: Column) -> Column:
    """Uniform in (0, 1) from a hash."""
    return (F.pmod(F.xxhash64(*parts), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def gaussian(*parts: Column) -> Column:
    return F.sqrt(-2 * F.log(uniform(*parts, F.lit("r")))) * F.cos(2 * math.pi * uniform(*parts, F.lit("a")))


def perturb(bars: DataFrame, trials: DataFrame, magnitude: float = 0.5, seed: int = 0) -> DataFrame:
    """bars once per trial (trial, cutoff, scheme), rows after the cutoff changed by the scheme; rows up to it are untouched."""
    spread = bars.groupBy("symbol").agg(F.stddev_pop("close").alias("_sd"), F.stddev_pop(F.log(F.when(F.col("close") > 0, F.col("close")))).alias("_lsd"))
    rows = bars.crossJoin(F.broadcast(trials)).join(small(spread), "symbol")  # trials: some dozens of rows
    draw = (F.lit(seed), F.col("trial"), F.col("symbol"), F.col("timestamp").cast("string"))
    future = F.col("timestamp") > F.col("cutoff")
    # Order of rows within the future (or past) of a symbol, by time and by hash: pairs of both orders permute or sample.
    part = Window.partitionBy("trial", "symbol", future)
    rows = rows.withColumns({
        "_future": future, "_n": F.row_number().over(part.orderBy("timestamp")) - 1, "_h": F.row_number().over(part.orderBy(F.xxhash64(*draw), "timestamp")) - 1, "_size": F.count(F.lit(1)).over(part),
    })
    past = F.coalesce(F.max(F.when(~F.col("_future"), F.col("_size"))).over(Window.partitionBy("trial", "symbol")), F.lit(0))
    rows = rows.withColumn("_past", past)
    values = [*PRICES, "volume"]
    # A cyclic shift of the hashed order is never the identity for two rows or more.
    want = F.when(F.col("scheme") == "permute", F.pmod(F.col("_h") + 1, F.col("_size"))).when((F.col("scheme") == "replace") & (F.col("_past") > 0), F.pmod(F.xxhash64(*draw, F.lit("p")), F.greatest(F.col("_past"), F.lit(1))))
    rows = rows.withColumn("_want", F.when(F.col("_future"), want).cast("long")).withColumn("_from_future", F.col("scheme") == "permute")
    source = rows.where("scheme in ('permute', 'replace')").select(
        F.col("trial").alias("_t"), F.col("symbol").alias("_s"), F.col("_future").alias("_f"), F.when(F.col("_future"), F.col("_h")).otherwise(F.col("_n")).cast("long").alias("_k"), *[F.col(v).alias(f"_v_{v}") for v in values]
    )
    rows = rows.join(source, (F.col("trial") == F.col("_t")) & (F.col("symbol") == F.col("_s")) & (F.col("_from_future") == F.col("_f")) & (F.col("_want") == F.col("_k")), "left")
    lowest = F.least(*[F.col(p) for p in PRICES])
    shift = F.greatest(3 * magnitude * F.coalesce("_sd", F.lit(0.0)) * gaussian(*draw), -lowest / 2)
    factor = F.exp(3 * magnitude * F.coalesce("_lsd", F.lit(0.0)) * gaussian(*draw))
    jump = F.when(F.pmod(F.xxhash64(*draw), F.lit(2)) == 0, 0.2).otherwise(5.0)

    def changed(v: str) -> Column:
        c = F.col(v).cast("double")
        price = v in PRICES
        new = F.when(F.col("scheme") == "additive", c + shift if price else c * (1 + uniform(*draw, F.lit(v)))).when(F.col("scheme") == "multiplicative", c * factor).when(F.col("scheme") == "extreme", c * jump).otherwise(F.coalesce(F.col(f"_v_{v}").cast("double"), c))
        return F.when(F.col("_future"), new).otherwise(c)

    return rows.select("trial", "cutoff", "scheme", "timestamp", "symbol", *[changed(v).alias(v) for v in values])


def differences(base: DataFrame, new: DataFrame, rtol: float = 1e-9, atol: float = 1e-12) -> DataFrame:
    """Per trial: weights up to the cutoff that moved, the first of them (time, symbol, before, after), the largest move (infinite where one side is null)."""
    b = base.select("timestamp", "symbol", F.col("weight").alias("_b"))
    rows = new.where(F.col("timestamp") <= F.col("cutoff")).join(b, ["timestamp", "symbol"], "left")
    a, c = F.col("_b"), F.col("weight")
    same = a.eqNullSafe(c) | F.coalesce(F.abs(a - c) <= atol + rtol * F.abs(c), F.lit(False))
    gap = F.when(a.isNull() != c.isNull(), F.lit(float("inf"))).otherwise(F.abs(a - c))
    first = F.min(F.when(~same, F.struct("timestamp", "symbol", F.col("_b").alias("original"), F.col("weight").alias("perturbed"))))
    out = rows.groupBy("trial", "scheme").agg(F.count_if(~same).alias("n_changed"), first.alias("_f"), F.max(F.when(~same, gap)).alias("largest"))
    return out.select("trial", "scheme", "n_changed", F.col("_f.timestamp").alias("first_changed"), "largest", F.col("_f.symbol").alias("first_symbol"), F.col("_f.original").alias("original"), F.col("_f.perturbed").alias("perturbed"))


def run(strategy: Strategy, bars: DataFrame, first: float = 0.2, k: int = 8, schemes: tuple[str, ...] = SCHEMES, magnitude: float = 0.5, seed: int = 42) -> DataFrame:
    """Per trial: scheme, n_changed, first_changed, largest. bars: timestamp, symbol, OHLCV."""
    return _run(strategy, bars, _table(bars, first, k, schemes), magnitude, seed)


def places(n: int, first: float, k: int) -> list[int]:
    """Evenly spaced places from the given share of n to the last but one, rounded half to even."""
    return np.unique(np.round(np.linspace(max(1, math.floor(first * n)), n - 2, k)).astype(int)).tolist() if n >= 4 else []


def cutoffs(bars: DataFrame, first: float, k: int, besides: tuple[int, ...] = ()) -> list:
    """The decision times at places() of the calendar, and those at other places (negative: from the end). Only these reach the driver."""
    calendar = bars.select("timestamp").distinct()
    n = calendar.count()
    at = [*places(n, first, k), *(p % n for p in besides if n)]
    placed = positions(calendar, "timestamp").where(F.col("pos").isin(at)) if at else calendar.limit(0).withColumn("pos", F.lit(0))
    times = {r["pos"]: r["timestamp"] for r in placed.collect()}
    return [times[p] for p in at]


def _table(bars: DataFrame, first: float, k: int, schemes: tuple[str, ...]) -> list[tuple]:
    return [(i, c, s) for i, (c, s) in enumerate((c, s) for c in cutoffs(bars, first, k) for s in schemes)]


def _run(strategy: Strategy, bars: DataFrame, table: list[tuple], magnitude: float, seed: int, until=None) -> DataFrame:
    """Differences of the trials in table; until: compare up to this time in place of each cutoff."""
    trials = bars.sparkSession.createDataFrame(table, "trial int, cutoff timestamp_ntz, scheme string")
    moved = perturb(bars, trials, magnitude, seed)
    judged = trials if until is None else trials.withColumn("cutoff", F.lit(until).cast("timestamp_ntz"))
    new = strategy(Bars(moved, ("trial", "symbol"))).join(F.broadcast(judged), "trial")
    return differences(strategy(Bars(bars)), new)


def run_all(strategy: Strategy, bars: DataFrame, first: float = 0.2, k: int = 8, schemes: tuple[str, ...] = SCHEMES, magnitude: float = 0.5, seed: int = 42) -> tuple[list, list[dict]]:
    """Rows of run and errors. Trials run in one plan; where that fails, each runs by itself, and those that fail are errors."""
    table = _table(bars, first, k, schemes)
    try:
        return _run(strategy, bars, table, magnitude, seed).collect(), []  # a row per trial
    except Exception:
        rows, errors = [], []
        for trial in table:
            try:
                rows += _run(strategy, bars, [trial], magnitude, seed).collect()
            except Exception as e:
                errors.append({"trial": trial[0], "scheme": trial[2], "error": f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"})
        return rows, errors


def n_unstable(strategy: Strategy, bars: DataFrame, rtol: float = 1e-9, atol: float = 1e-12) -> int:
    """Weights that differ between two baseline runs. The first is written out, so that one run cannot serve as both."""
    a = materialize(strategy(Bars(bars)).select("timestamp", "symbol", F.col("weight").alias("_a")), "baseline")
    b = strategy(Bars(bars)).select("timestamp", "symbol", F.col("weight").alias("_b"))
    x, y = F.col("_a"), F.col("_b")
    same = x.eqNullSafe(y) | F.coalesce(F.abs(x - y) <= atol + rtol * F.abs(y), F.lit(False))
    return a.join(b, ["timestamp", "symbol"], "full").agg(F.count_if(~same)).first()[0]


def control_changes(strategy: Strategy, bars: DataFrame, magnitude: float = 0.5, seed: int = 42) -> int | None:
    """Weights that move when everything after the first time is perturbed; none: the trials say nothing. Null where the strategy fails."""
    try:
        ends = cutoffs(bars, 0.0, 0, (0, -1))
        got = _run(strategy, bars, [(0, ends[0], "extreme")], magnitude, seed + 1, ends[-1]).first() if ends else None
        return got["n_changed"] if got else 0
    except Exception:
        return None
