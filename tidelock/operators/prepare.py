"""Names, timestamps, numbers and rows of raw tables: detection, coercion, sorting and deduplication with a log."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import DataError
from ..shared import small

# Names that tables use for the columns of the model.
ALIASES = {"adj close": "adj_close", "adjclose": "adj_close", "adjusted close": "adj_close", "o": "open", "h": "high", "l": "low", "c": "close", "v": "volume", "vol": "volume"}
TIME_NAMES = ("timestamp", "datetime", "date", "time", "ts")
PRICE_NAMES = ("close", "adj_close", "price")
SYMBOL_NAMES = ("symbol", "ticker", "asset", "instrument", "secid", "code")
RETURN_NAMES = ("returns", "return", "ret", "strategy_returns", "pnl")
NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")
FORMATS = ("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][XXX][XX]", "yyyy-MM-dd HH:mm:ss[.SSSSSS][ ][XXX][XX]", "yyyy-MM-dd", "yyyy/MM/dd", "MM/dd/yyyy")
OFFSET = r"(Z|[+-]\d{2}:?\d{2})$"


def normal_name(name: str) -> str:
    low = name.strip().lower()
    return ALIASES.get(low, ALIASES.get(low.replace("_", " "), re.sub(r"\s+", "_", low)))


def normalise_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[normal_name(c) for c in df.columns])


def first_of(columns: list[str], names: tuple[str, ...]) -> str | None:
    return next((n for n in names if n in columns), None)


def time_column(df: DataFrame, explicit: str | None = None) -> str:
    found = normal_name(explicit) if explicit else first_of(df.columns, TIME_NAMES)
    if found not in df.columns:
        raise DataError(f"no timestamp column among {df.columns}; name it with timestamp_column=")
    return found


def price_column(df: DataFrame) -> str | None:
    return first_of(df.columns, PRICE_NAMES)


def symbol_column(df: DataFrame, explicit: str | None = None) -> str | None:
    return normal_name(explicit) if explicit else first_of(df.columns, SYMBOL_NAMES)


def returns_column(df: DataFrame, explicit: str | None = None) -> str:
    found = normal_name(explicit) if explicit else first_of(df.columns, RETURN_NAMES)
    numeric = [c for c, t in df.dtypes if t in NUMERIC]
    found = found or (numeric[0] if len(numeric) == 1 else None)
    if found not in df.columns:
        raise DataError(f"no returns column among {df.columns}")
    return found


def parse_time(df: DataFrame, column: str) -> DataFrame:
    """df with _ts (timestamp_ntz, UTC where any value has an offset), _aware and _bad (a value that is no time)."""
    kind = dict(df.dtypes)[column]
    if kind in NUMERIC:
        raise DataError(f"{column} is numeric; timestamps are text, dates or timestamps")
    if kind != "string":
        return df.withColumns({"_ts": F.col(column).cast("timestamp_ntz"), "_aware": F.lit(kind == "timestamp"), "_offset": F.lit(None).cast("string"), "_bad": F.lit(False)})
    text = F.trim(F.col(column))
    parsed = F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in FORMATS])
    offset = F.regexp_extract(text, OFFSET, 1)
    return df.withColumns({"_ts": parsed.cast("timestamp_ntz"), "_aware": offset != "", "_offset": F.when(offset != "", offset), "_bad": F.col(column).isNull() | parsed.isNull()})


def coerce_numbers(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Text columns of which every value parses become doubles; one pass decides for all."""
    text = [c for c, t in df.dtypes if t == "string" and c not in keep]
    if not text:
        return df
    fits = df.agg(*[((F.count(F.col(c).try_cast("double")) == F.count(c)) & (F.count(c) > 0)).alias(c) for c in text]).first()
    return df.withColumns({c: F.col(c).try_cast("double") for c in text if fits[c]})


def prepare(df: DataFrame, seq: str, keys: tuple[str, ...] = (), keep: str = "last") -> tuple[DataFrame, list[str]]:
    """Rows with a timestamp, one per (timestamp, keys): the last (or first) in input order `seq`. Returns the rows and what was done.

    One aggregate that combines before the shuffle, however often a key repeats.
    """
    timed = df.where(F.col("timestamp").isNotNull())
    pick = F.max_by if keep == "last" else F.min_by
    rest = [c for c in df.columns if c not in ("timestamp", *keys)]
    kept = timed.groupBy("timestamp", *keys).agg(pick(F.struct(*rest), F.col(seq)).alias("_row")).select(*[c if c in ("timestamp", *keys) else F.col(f"_row.{c}").alias(c) for c in df.columns])
    counts = df.agg(F.count(F.lit(1)).alias("all"), F.count("timestamp").alias("timed")).first()
    left = kept.count()
    log = []
    if counts["all"] > counts["timed"]:
        log.append(f"dropped {counts['all'] - counts['timed']} rows without a timestamp")
    if counts["timed"] > left:
        log.append(f"dropped {counts['timed'] - left} rows that repeat a timestamp, keeping the {keep}")
    if left < 2:
        raise DataError("at least two rows with a timestamp are needed")
    return kept, log


def completed(df: DataFrame, *values: str) -> DataFrame:
    """Every timestamp by every symbol; missing values are null. The grid has the size of the panel's full matrix."""
    return grid(df, df).join(df.select("timestamp", "symbol", *values), ["timestamp", "symbol"], "left")


def grid(times_of: DataFrame, symbols_of: DataFrame) -> DataFrame:
    """(timestamp, symbol): all timestamps of one table by all symbols of another."""
    return times_of.select("timestamp").distinct().crossJoin(small(symbols_of.select("symbol").distinct()))


# ---- access to panels


def times(df: DataFrame) -> DataFrame:
    return df.select("timestamp").distinct().orderBy("timestamp")


def symbols(df: DataFrame) -> DataFrame:
    return df.select("symbol").distinct().orderBy("symbol")


def of_symbol(df: DataFrame, symbol: str) -> DataFrame:
    return df.where(F.col("symbol") == symbol).drop("symbol")


def wide(df: DataFrame, column: str) -> DataFrame:
    """A column per symbol, a row per timestamp. For the edge of the API: panels are long inside."""
    names = [r[0] for r in symbols(df).collect()]  # the columns of the result
    return df.groupBy("timestamp").pivot("symbol", names).agg(F.first(column)).orderBy("timestamp")


# ---- what strategies and callers hand in


def float_cast(df: DataFrame) -> DataFrame:
    """Numbers become doubles; booleans, times and text stay."""
    return df.withColumns({c: F.col(c).cast("double") for c, t in df.dtypes if t in NUMERIC or t.startswith("decimal")})


def one_column(df: DataFrame, name: str = "returns", beside: tuple[str, ...] = ("timestamp",)) -> str:
    """The only numeric column beside the named ones."""
    found = [c for c, t in df.dtypes if c not in beside and (t in NUMERIC or t.startswith("decimal"))]
    if len(found) != 1:
        raise DataError(f"{name} must have one numeric column, not {found}")
    return found[0]


def clean_returns(df: DataFrame, column: str, name: str = "returns", missing: str = "omit") -> DataFrame:
    """Rows of finite returns. Infinite ones are an error; missing ones go, or are an error under `raise`."""
    x = F.col(column).cast("double")
    gone = x.isNull() | F.isnan(x)
    got = df.agg(F.count_if(F.abs(x) == float("inf")).alias("inf"), F.count_if(gone).alias("gone")).first()
    if got["inf"]:
        raise DataError(f"{name} hold {got['inf']} infinite values")
    if got["gone"] and missing == "raise":
        raise DataError(f"{name} hold {got['gone']} missing values")
    return df.withColumn(column, x).where(~gone)


def _refuse(rows: DataFrame, what: str) -> None:
    if first := rows.first():
        raise DataError(f"{what}: {first[0]}")


def panel_signals(raw: DataFrame, prices: DataFrame, name: str = "weight") -> DataFrame:
    """(timestamp, symbol, weight) on all timestamps and symbols of prices, null where nothing was said. raw is long, or wide with a column per symbol; what prices do not have is an error."""
    if "symbol" not in raw.columns:
        columns = [c for c in raw.columns if c != "timestamp"]
        items = F.explode(F.array(*[F.struct(F.lit(c).alias("symbol"), F.col(f"`{c}`").cast("double").alias(name)) for c in columns]))
        raw = raw.select("timestamp", items.alias("_i")).select("timestamp", "_i.*")
    raw = raw.select("timestamp", F.col("symbol").cast("string").alias("symbol"), F.col(name).cast("double").alias(name))
    _refuse(raw.select("symbol").distinct().join(small(symbols(prices)), "symbol", "left_anti").orderBy("symbol"), "signals for a symbol that has no prices")
    _refuse(raw.select("timestamp").distinct().join(times(prices), "timestamp", "left_anti").orderBy("timestamp"), "signals at a time that has no prices")
    return grid(prices, prices).join(raw, ["timestamp", "symbol"], "left")


def single_signal(raw, prices: DataFrame, name: str = "weight") -> DataFrame:
    """(timestamp, weight) on all timestamps of prices. raw: a table with a timestamp and one numeric column, or as many values as there are rows."""
    if not isinstance(raw, DataFrame):
        values, index = [None if v is None or v != v else float(v) for v in raw], times(prices).collect()
        if len(values) != len(index):
            raise DataError(f"{len(values)} signals for {len(index)} rows")
        return prices.sparkSession.createDataFrame([(t[0], v) for t, v in zip(index, values, strict=True)], f"timestamp {dict(prices.dtypes)['timestamp']}, {name} double")
    column = one_column(raw, "signals", ("timestamp", "symbol"))
    _refuse(raw.select("timestamp").distinct().join(times(prices), "timestamp", "left_anti").orderBy("timestamp"), "signals at a time that has no prices")
    return times(prices).join(raw.select("timestamp", F.col(column).cast("double").alias(name)), "timestamp", "left")


def aligned(reference: DataFrame, series: DataFrame, value: str, fill: float | None = None) -> DataFrame:
    """The times of reference with the value that series has there, or null (or fill)."""
    rows = reference.select("timestamp").distinct().join(series.select("timestamp", value), "timestamp", "left")
    return rows if fill is None else rows.withColumn(value, F.coalesce(F.col(value), F.lit(fill)))


def chart_points(n: int, most: int = 400) -> list[int]:
    """At most so many positions of n, evenly spaced and rounded half to even, ends included."""
    if n <= most:
        return list(range(n))
    return sorted({round(i * (n - 1) / (most - 1)) for i in range(most)})


def downsampled(df: DataFrame, most: int = 400) -> DataFrame:
    """The rows of a series by time at chart_points(). One series, so one window."""
    n = df.count()
    if n <= most:
        return df
    at = df.sparkSession.createDataFrame([(p,) for p in chart_points(n, most)], "_p int")
    return df.withColumn("_p", F.row_number().over(Window.orderBy("timestamp")) - 1).join(F.broadcast(at), "_p", "left_semi").drop("_p")  # at most `most` rows
