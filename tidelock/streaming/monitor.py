"""Bars, quality counters and a stateful tracker over a stream of ticks (symbol, ts, price, size), with watermarks. An extension beyond batch audits."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bars(ticks: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """OHLCV per window and symbol; rows later than the watermark are dropped by Spark."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    rows = ticks.withWatermark("ts", late).groupBy(w.alias("window"), "symbol").agg(
        F.min_by("price", "ts").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "ts").alias("close"), F.sum("size").alias("volume"), F.count(F.lit(1)).alias("n_ticks")
    )
    return rows.select(F.col("window.start").alias("timestamp"), "symbol", "open", "high", "low", "close", "volume", "n_ticks")


def quality(ticks: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """The row-wise data rules per window and symbol: ticks, missing, infinite and non-positive prices, and different times."""
    p = F.col("price")
    rows = ticks.withWatermark("ts", late).groupBy(F.window("ts", width).alias("window"), "symbol").agg(
        F.count(F.lit(1)).alias("n_ticks"), F.count_if(p.isNull() | F.isnan(p)).alias("n_missing"), F.count_if(F.abs(p) == float("inf")).alias("n_infinite"), F.count_if(p <= 0).alias("n_nonpositive"),
        F.min("ts").alias("first"), F.max("ts").alias("last"),
    )
    return rows.select(F.col("window.start").alias("timestamp"), "symbol", "n_ticks", "n_missing", "n_infinite", "n_nonpositive", "first", "last")


def sessions(ticks: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of each symbol: spans of ticks without a longer gap."""
    rows = ticks.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("s"), "symbol").agg(F.count(F.lit(1)).alias("n_ticks"))
    return rows.select(F.col("s.start").alias("start"), F.col("s.end").alias("end"), "symbol", "n_ticks")


EVENTS = "symbol string, ts timestamp, kind string, value double"
#: Of each symbol: the last time (microseconds) and price, the length of the run of equal prices, the peak, and whether the price is below the drawdown limit.
STATE = "last long, price double, run long, peak double, below boolean"


def walk(frame: pd.DataFrame, state: tuple, stale: int, gap_us: int, drawdown: float) -> tuple[list[tuple], tuple]:
    """Events (ts, kind, value) of one symbol's ticks in order, and the state after them: a run that reaches `stale` equal prices, a gap, a drawdown that falls below its limit."""
    last, price, run, peak, below = state
    out = []
    ordered = frame.sort_values(["ts", "price"], kind="stable")
    for at, p in zip(ordered["ts"], ordered["price"], strict=True):
        if p is None or p != p:
            continue
        us = at.value // 1000
        if last is not None and us - last > gap_us:
            out.append((at, "gap", (us - last) / 1e6))
        run = run + 1 if price is not None and p == price else 1
        if run == stale:
            out.append((at, "stale", float(run)))
        peak = p if peak is None else max(peak, p)
        fallen = peak > 0 and p / peak - 1 < -drawdown
        if fallen and not below:
            out.append((at, "drawdown", p / peak - 1))
        last, price, below = us, p, fallen
    return out, (last, price, run, peak, below)


def track(ticks: DataFrame, stale: int = 5, gap_seconds: float = 3600.0, drawdown: float = 0.2, late: str = "1 hour") -> DataFrame:
    """Events of a stream, as they happen. The state of a symbol is a handful of numbers, kept between batches; its ticks are taken in the order of time within a batch, and rows later than the watermark are dropped."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else (None, None, 0, None, False)
        events, held = walk(pd.concat(list(frames)), held, stale, int(gap_seconds * 1e6), drawdown)
        state.update(held)
        if events:
            yield pd.DataFrame([(key[0], *e) for e in events], columns=["symbol", "ts", "kind", "value"])

    rows = ticks.withWatermark("ts", late).select("symbol", "ts", F.col("price").cast("double").alias("price"))
    return rows.groupBy("symbol").applyInPandasWithState(step, EVENTS, STATE, "append", GroupStateTimeout.NoTimeout)


def track_batch(ticks: DataFrame, stale: int = 5, gap_seconds: float = 3600.0, drawdown: float = 0.2) -> DataFrame:
    """The same events of a finished table."""

    def whole(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        events, _ = walk(frame, (None, None, 0, None, False), stale, int(gap_seconds * 1e6), drawdown)
        return pd.DataFrame([(key[0], *e) for e in events], columns=["symbol", "ts", "kind", "value"])

    return ticks.select("symbol", "ts", F.col("price").cast("double").alias("price")).groupBy("symbol").applyInPandas(whole, EVENTS)
