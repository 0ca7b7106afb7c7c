"""Tables from files and frames, adapters for other tools' results, and synthetic markets."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import DataError
from ..operators import prepare as pr
from ..operators import quality


def load(spark: SparkSession, source: str | pd.DataFrame | DataFrame) -> DataFrame:
    """A table with normalised names. The suffix of a path picks the reader; text stays text, so that raw timestamps can be judged."""
    if isinstance(source, DataFrame):
        df = source
    elif isinstance(source, pd.DataFrame | pd.Series):
        df = spark.createDataFrame(flat(source.to_frame(source.name or "close") if isinstance(source, pd.Series) else source))
    else:
        suffix = source.rsplit(".", 1)[-1].lower()
        readers = {"csv": lambda: spark.read.option("header", True).csv(source), "parquet": lambda: spark.read.parquet(source), "pq": lambda: spark.read.parquet(source)}
        if suffix not in readers:
            raise DataError(f".{suffix} is no known format; use .csv or .parquet")
        try:
            df = readers[suffix]()
        except Exception as e:
            raise DataError(f"{source} cannot be read: {e}") from e
    return pr.normalise_columns(df)


def flat(frame: pd.DataFrame) -> pd.DataFrame:
    """A pandas frame with its index as columns: two levels are timestamp and symbol, whichever of them holds the times; a named or dated index is one column."""
    index = frame.index
    if isinstance(index, pd.MultiIndex):
        if index.nlevels != 2:
            raise DataError(f"an index has the levels timestamp and symbol, not {index.nlevels}")
        dated = [pd.api.types.is_datetime64_any_dtype(index.levels[i]) for i in (0, 1)]
        if sum(dated) != 1:
            raise DataError("one level of the index must hold the times, the other the symbols")
        names = ["timestamp", "symbol"] if dated[0] else ["symbol", "timestamp"]
        return frame.set_axis(index.set_names(names)).reset_index().astype({"symbol": str})
    if isinstance(index, pd.DatetimeIndex):
        return frame.rename_axis(index.name or "timestamp").reset_index()
    return frame.reset_index() if index.name else frame


def load_raw(spark: SparkSession, source, timestamp_column: str | None = None, symbol_column: str | None = None) -> DataFrame:
    """All rows as they came: timestamp, symbol (`_` where there is none), numbers, and _seq, the order of input."""
    df = load(spark, source)
    time, symbol = pr.time_column(df, timestamp_column), pr.symbol_column(df, symbol_column)
    df = pr.parse_time(df, time).drop(time).withColumnRenamed("_ts", "timestamp").drop("_aware", "_offset", "_bad")
    df = pr.coerce_numbers(df, tuple(x for x in (symbol,) if x))
    df = df.withColumn("symbol", F.col(symbol).cast("string") if symbol else F.lit("_"))
    if symbol and symbol != "symbol":
        df = df.drop(symbol)
    if pr.price_column(df) is None:
        raise DataError(f"no price column among {df.columns}")
    return df.withColumn("_seq", F.monotonically_increasing_id())  # captured right after the scan


def load_prices(spark: SparkSession, source, timestamp_column: str | None = None, symbol_column: str | None = None, seq: str | None = None) -> tuple[DataFrame, list[str]]:
    """Prepared bars (timestamp, symbol, prices) and what was done. seq: a column that gives the order of input."""
    rows, log = pr.prepare(load_raw(spark, source, timestamp_column, symbol_column), seq or "_seq", ("symbol",))
    return rows.drop("_seq"), log


def raw_times(spark: SparkSession, source, timestamp_column: str | None = None, symbol_column: str | None = None) -> dict:
    """What prepared bars no longer tell of raw timestamps: n_bad, examples (the first five different bad texts), n_aware, n_naive, offsets, n_backward (steps back in input order, by symbol) and the first of them."""
    df = load(spark, source).withColumn("_seq", F.monotonically_increasing_id())
    symbol = pr.symbol_column(df, symbol_column)
    df = pr.parse_time(df, pr.time_column(df, timestamp_column)).withColumn("_key", F.col(symbol).cast("string") if symbol else F.lit("_"))
    good = ~F.col("_bad") & F.col("_ts").isNotNull()
    counts = df.agg(F.count_if(~good).alias("n_bad"), F.count_if(good & F.col("_aware")).alias("n_aware"), F.count_if(good & ~F.col("_aware")).alias("n_naive"), F.sort_array(F.collect_set("_offset")).alias("offsets")).first()
    back = quality.out_of_order(df, "_ts", "_seq", ["_key"]).agg(F.coalesce(F.sum("n_backward"), F.lit(0))).first()[0]
    time = pr.time_column(load(spark, source), timestamp_column)
    bad = df.where(~good & F.col(time).isNotNull()).groupBy(F.col(time).cast("string").alias("text")).agg(F.min("_seq").alias("_first")).orderBy("_first").limit(5)
    pair = quality.first_backward(df, "_ts", "_seq", ["_key"]).orderBy("seq").first() if back else None
    return counts.asDict() | {"n_backward": back, "examples": [r["text"] for r in bad.collect()], "first_backward": [str(pair["before"]), str(pair["after"])] if pair else None}


def load_returns(spark: SparkSession, source, column: str | None = None) -> DataFrame:
    df = load(spark, source)
    ret = pr.returns_column(pr.coerce_numbers(df), column)
    time = pr.time_column(df)
    df = pr.parse_time(pr.coerce_numbers(df, (time,)), time)
    rows = df.select(F.col("_ts").alias("timestamp"), F.col(ret).cast("double").alias("ret"))
    if rows.where(F.abs("ret") == float("inf")).limit(1).count():
        raise DataError("returns hold infinite values")
    return rows.where(F.col("ret").isNotNull() & ~F.isnan("ret"))


def load_trials(spark: SparkSession, source) -> DataFrame:
    """(timestamp, trial, ret) of a table with a column per trial; trials are numbered in the order of their columns."""
    df = load(spark, source)
    time = pr.time_column(df)
    df = time_indexed(pr.coerce_numbers(df, (time,)), time, "trials")
    names = [c for c, t in df.dtypes if t in pr.NUMERIC]
    if not names:
        raise DataError(f"no numeric column among {df.columns}")
    items = F.explode(F.array(*[F.struct(F.lit(i).alias("trial"), F.col(f"`{c}`").cast("double").alias("ret")) for i, c in enumerate(names)]))
    return df.select("timestamp", items.alias("_i")).select("timestamp", "_i.*")


@dataclass
class Artifacts:
    """Results of another tool. Trial returns are long: timestamp, trial, ret."""

    # The names of the tables.
    returns: DataFrame | None = None
    trial_returns: DataFrame | None = None
    trial_params: DataFrame | None = None
    benchmark: DataFrame | None = None
    prices: DataFrame | None = None
    signals: DataFrame | None = None
    positions: DataFrame | None = None
    trades: DataFrame | None = None
    features: DataFrame | None = None
    target: DataFrame | None = None
    metadata: dict = field(default_factory=dict)
    notes: list[str] = field(default_factory=list)

    def validate(self) -> Artifacts:
        """Raises where there is nothing to audit or tables do not fit each other; what merely limits the audit becomes a note."""
        if all(getattr(self, k) is None for k in ("returns", "trial_returns", "prices", "signals", "positions", "trades", "features")):
            raise DataError("there is nothing to audit: give returns or prices at least")
        needed = {"returns": {"timestamp"}, "trial_returns": {"timestamp", "trial", "ret"}, "benchmark": {"timestamp"}, "prices": {"timestamp"}, "signals": {"timestamp"}, "positions": {"timestamp"}, "features": {"timestamp"}, "target": {"timestamp"}}
        for name, columns in needed.items():
            table = getattr(self, name)
            if table is not None and (lost := columns - set(table.columns)):
                raise DataError(f"{name} lacks {sorted(lost)}")
        if self.trial_params is not None and self.trial_returns is not None:
            a, b = self.trial_params.count(), self.trial_returns.select("trial").distinct().count()
            if a != b:
                raise DataError(f"{a} rows of parameters for {b} trials")
        if self.target is not None and self.features is None:
            self.notes.append("a target without features is not checked")
        if self.trades is not None and (lost := {"signal_time", "execution_time"} - set(self.trades.columns)):
            self.notes.append(f"the ledger lacks {' and '.join(sorted(lost))}; timing is not checked")
        return self


class Adapter(Protocol):
    def load(self, source) -> Artifacts: ...


class TableAdapter:
    """A mapping of names to tables or paths."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def load(self, source: dict) -> Artifacts:
        known = set(Artifacts.__dataclass_fields__) - {"notes"}
        if unknown := set(source) - known:
            raise DataError(f"unknown tables {sorted(unknown)}; known: {sorted(known)}")
        return Artifacts(**{k: v if k == "metadata" else load(self.spark, v) for k, v in source.items()}).validate()


class ResultsAdapter:
    """Another tool's export: returns, or equity that becomes returns; ledgers with other names for their times.

    returns_column, equity_column: which column it is (one of them; found by name otherwise). trade_columns: the ledger's
    names of signal_time and execution_time. Every conversion is noted.
    """

    # Usual names of a ledger's times.
    RENAMES = {"signal_ts": "signal_time", "decision_time": "signal_time", "entry_signal": "signal_time", "fill_time": "execution_time", "exec_time": "execution_time", "execution_ts": "execution_time"}

    def __init__(self, spark: SparkSession, returns_column: str | None = None, equity_column: str | None = None, timestamp_column: str | None = None, trade_columns: dict[str, str] | None = None, net: bool = True):
        if returns_column and equity_column:
            raise DataError("give returns_column or equity_column, not both")
        if unknown := set(trade_columns or {}) - {"signal_time", "execution_time"}:
            raise DataError(f"trade_columns names signal_time and execution_time, not {sorted(unknown)}")
        self.spark, self.returns_column, self.equity_column, self.timestamp_column, self.trade_columns, self.net = spark, returns_column, equity_column, timestamp_column, dict(trade_columns or {}), net

    def load(self, source, trades=None, trial_returns=None, benchmark=None, prices=None, metadata: dict | None = None) -> Artifacts:
        df, notes = load(self.spark, source), []
        df = time_indexed(df, self.timestamp_column, "returns")
        equity = pr.normal_name(self.equity_column) if self.equity_column else "equity" if "equity" in df.columns and pr.first_of(df.columns, pr.RETURN_NAMES) is None and not self.returns_column else None
        if equity:
            if equity not in df.columns:
                raise DataError(f"no column {equity!r} among {df.columns}")
            notes.append(f"returns were made from {equity}; the first bar has none")
            returns = equity_returns(df.select("timestamp", F.col(equity).cast("double").alias("equity")))
        else:
            returns = df.select("timestamp", F.col(pr.returns_column(df, self.returns_column)).cast("double").alias("ret"))
        ledger = None
        if trades is not None:
            ledger = load(self.spark, trades)
            for old, new in ({pr.normal_name(v): k for k, v in self.trade_columns.items()} or self.RENAMES).items():
                if self.trade_columns and old not in ledger.columns:
                    raise DataError(f"the ledger has no column {old!r}")
                if old in ledger.columns and old != new:
                    ledger = ledger.withColumnRenamed(old, new)
                    notes.append(f"{old} was read as {new}")
        other = {k: time_indexed(load(self.spark, v), None, k) for k, v in (("benchmark", benchmark),) if v is not None}
        other |= {k: load(self.spark, v) for k, v in (("trial_returns", trial_returns), ("prices", prices)) if v is not None}
        return Artifacts(returns=returns, trades=ledger, notes=notes, metadata={"returns_are": "net" if self.net else "gross"} | (metadata or {}), **other).validate()


def time_indexed(df: DataFrame, timestamp_column: str | None, name: str) -> DataFrame:
    """df with a timestamp column of parsed times; times that repeat are an error, not dropped."""
    time = pr.time_column(df, timestamp_column)
    rows = pr.parse_time(pr.coerce_numbers(df, (time,)), time).drop(time, "_aware", "_offset", "_bad").withColumnRenamed("_ts", "timestamp").where("timestamp is not null")
    if again := rows.groupBy("timestamp").count().where("count > 1").orderBy("timestamp").first():
        raise DataError(f"{name}: the time {again['timestamp']} stands {again['count']} times")
    return rows


def equity_returns(df: DataFrame) -> DataFrame:
    if df.where("equity <= 0").limit(1).count():
        raise DataError("equity must be positive")
    w = Window.orderBy("timestamp")
    return df.select("timestamp", (F.col("equity") / F.lag("equity").over(w) - 1).alias("ret")).where("ret is not null")


def synthetic_benchmark(prices: DataFrame, column: str = "close") -> DataFrame:
    """(timestamp, ret): change of a price series, 0 on the first row."""
    w = Window.orderBy("timestamp")
    return prices.select("timestamp", F.when(F.lag("timestamp").over(w).isNull(), 0.0).otherwise(F.try_divide(F.col(column), F.lag(column).over(w)) - 1).alias("ret"))


def export_synthetic(path: str, n: int = 1500, seed: int = 2026, ar1: float = -0.15) -> str:
    """Write a synthetic market: .csv rounded to 6 decimals, or .parquet."""
    frame = synthetic(n, seed, ar1=ar1)
    if path.lower().endswith(".csv"):
        frame.round(6).to_csv(path, index=False)
    elif path.lower().endswith((".parquet", ".pq")):
        frame.astype({"timestamp": "datetime64[us]"}).to_parquet(path, index=False)  # Spark has no nanoseconds
    else:
        raise DataError(f"{path} is no .csv or .parquet")
    return path


def synthetic(n: int = 1500, seed: int = 42, start: str = "2015-01-01", mu: float = 6e-4, sigma: float = 9e-3, stress: float = 2.2, stay: float = 0.985, ar1: float = 0.0) -> pd.DataFrame:
    """OHLCV of one asset: two volatility states, AR(1) shocks, valid bars, volume doubled in stress. The state is a recursion, so it is made on one machine."""
    rng = np.random.default_rng(seed)
    flips = rng.random(n) > stay
    state = np.cumsum(flips) % 2
    z, shock = rng.standard_normal(n), np.zeros(n)
    for t in range(n):
        shock[t] = z[t] + (ar1 * shock[t - 1] if t else 0.0)
    ret = mu + sigma * np.where(state, stress, 1.0) * shock
    close = 100 * np.exp(np.cumsum(ret))
    open_ = np.concatenate([[100.0], close[:-1]]) * np.exp(0.1 * sigma * rng.standard_normal(n))
    reach = np.abs(rng.standard_normal((2, n))) * sigma / 2
    high, low = np.maximum(open_, close) * (1 + reach[0]), np.minimum(open_, close) * (1 - reach[1])
    volume = (rng.integers(500_000, 1_500_000, n) * np.where(state, 2, 1)).astype(np.int64)
    return pd.DataFrame({"timestamp": pd.bdate_range(start, periods=n), "open": open_, "high": high, "low": low, "close": close, "volume": volume})


def synthetic_universe(spark: SparkSession, symbols: int = 12, n: int = 1500, seed: int = 7) -> DataFrame:
    """A long panel: each symbol is made by itself, seeded by its ordinal, around one market path."""
    market = synthetic(n, seed)["close"].pct_change().fillna(0.0).to_numpy()

    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        k = int(pdf["id"].iloc[0])
        own = synthetic(n, seed + 1 + k)
        beta = 0.5 + np.random.default_rng(seed + k).random()
        scale = np.exp(np.cumsum(beta * market)) / 1.0
        for c in ("open", "high", "low", "close"):
            own[c] = (own[c] * scale).round(4)
        own.insert(1, "symbol", f"S{k:03d}")
        return own

    schema = "timestamp timestamp_ntz, symbol string, open double, high double, low double, close double, volume long"
    return spark.range(symbols).groupBy("id").applyInPandas(make, schema)
