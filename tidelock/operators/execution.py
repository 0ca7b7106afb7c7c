"""Fills, costs and simulation. A panel is simulated symbol by symbol in one plan; weights are fractions of equity decided at the close."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import ConfigError, DataError
from ..functions import moments
from ..shared import small
from . import prepare
from . import windows as wn

# ---- costs: functions from a row's columns to a fraction of equity. Rows have trade, price, vol, adv, capital.


@dataclass(frozen=True)
class Cost:
    name: str
    build: Callable[[], Column]

    def scaled(self, m: float) -> Cost:
        return Cost(self.name, lambda: m * self.build())


def size() -> Column:
    return F.abs("trade")


def shares() -> Column:
    """Traded shares: |trade| * capital / price; 0 without a price."""
    return F.coalesce(F.try_divide(F.abs("trade") * F.col("capital"), F.when(F.col("price") > 0, F.col("price"))), F.lit(0.0))


def bps(rate: float, name: str = "commission") -> Cost:
    return Cost(name, lambda: size() * rate / 1e4)


def percentage(rate: float) -> Cost:
    return Cost("commission", lambda: size() * rate)


def per_share(fee: float, least: float = 0.0) -> Cost:
    return Cost("commission", lambda: F.when(size() > 0, F.greatest(shares() * fee, F.lit(least)) / F.col("capital")).otherwise(0.0))


def per_order(fee: float) -> Cost:
    return Cost("commission", lambda: F.when(size() > 0, F.lit(fee) / F.col("capital")).otherwise(0.0))


def tax(rate: float, side: str = "both") -> Cost:
    sides = {"both": size, "buy": lambda: F.greatest(F.col("trade"), F.lit(0.0)), "sell": lambda: F.greatest(-F.col("trade"), F.lit(0.0))}
    if side not in sides:
        raise ConfigError(f"side is one of {sorted(sides)}")
    return Cost("tax", lambda: sides[side]() * rate / 1e4)


def half_spread(spread_bps: float) -> Cost:
    return Cost("spread", lambda: size() * (spread_bps / 2) / 1e4)


def half_spread_series(column: str) -> Cost:
    """Spread in bps from a column that quoted_spread() filled."""
    return Cost("spread", lambda: size() * (F.col(column) / 2) / 1e4)


def slippage(rate: float) -> Cost:
    return Cost("slippage", lambda: size() * rate / 1e4)


def volatility_slippage(k: float = 0.1) -> Cost:
    return Cost("slippage", lambda: size() * k * F.coalesce("vol", F.lit(0.0)))


def size_slippage(coef: float = 10.0) -> Cost:
    return Cost("slippage", lambda: size() * coef * F.when(F.col("adv") > 0, shares() / F.col("adv")).otherwise(0.0) / 1e4)


def square_root_impact(y: float = 1.0) -> Cost:
    return Cost("impact", lambda: size() * y * F.coalesce("vol", F.lit(0.0)) * F.when(F.col("adv") > 0, F.sqrt(shares() / F.col("adv"))).otherwise(0.0))


@dataclass(frozen=True)
class CostModel:
    """Sum of components; those of one name add up. Custom components are Cost(name, function)."""

    parts: tuple[Cost, ...] = ()

    def columns(self) -> dict[str, Column]:
        out: dict[str, Column] = {}
        for p in self.parts:
            out[p.name] = out[p.name] + p.build() if p.name in out else p.build()
        return out or {"none": F.lit(0.0)}

    def without(self, name: str) -> CostModel:
        return CostModel(tuple(p for p in self.parts if p.name != name))

    def scaled(self, m: float) -> CostModel:
        return CostModel(tuple(p.scaled(m) for p in self.parts))


def quoted_spread(bars: DataFrame, quotes: DataFrame, keys: list[str]) -> DataFrame:
    """bars with spread_bps: quotes of exactly the bar's time, carried forward, 0 before the first."""
    w = Window.partitionBy(*keys).orderBy("timestamp")
    rows = bars.join(quotes, [*keys, "timestamp"], "left")
    return rows.withColumn("spread_bps", F.coalesce(wn.carried(F.col("spread_bps"), w), F.lit(0.0)))


# ---- fills


def lagged_target(lag: int, w: Window) -> Column:
    return F.coalesce(F.lag("weight", lag).over(w) if lag else F.col("weight"), F.lit(0.0))


def market_fill(bars: DataFrame, keys: list[str], fill: str = "close", lag: int = 1) -> DataFrame:
    """bars (with weight) and held, trade, gross, price. fill: close (lag 0 or more), next_close or next_open (lag 1 or more)."""
    if fill not in ("close", "next_close", "next_open") or lag < LEAST_LAG.get(fill, 0):
        raise ConfigError(f"fill {fill!r} with lag {lag} is not known; next_* needs a lag of 1 or more")
    w = Window.partitionBy(*keys).orderBy("timestamp")
    rows = bars.withColumn("held", lagged_target(lag, w)).withColumns({"_old": F.coalesce(F.lag("held").over(w), F.lit(0.0)), "_prev": F.lag("close").over(w)})
    rows = rows.withColumn("trade", F.col("held") - F.col("_old"))
    if fill == "next_open":
        overnight = F.coalesce(F.try_divide(F.col("open"), F.col("_prev")) - 1, F.lit(0.0))
        day = F.coalesce(F.try_divide(F.col("close"), F.col("open")) - 1, F.lit(0.0))
        gross, price = (1 + F.col("_old") * overnight) * (1 + F.col("held") * day) - 1, F.col("open")
    else:
        gross, price = F.col("_old") * F.coalesce(F.try_divide(F.col("close"), F.col("_prev")) - 1, F.lit(0.0)), F.col("close")
    return rows.withColumns({"gross": gross, "price": F.coalesce(price, F.col("close"))}).drop("_old", "_prev")


#: A fill takes (bars with weight, keys) and adds held, trade, gross and price. Own ones are registered, or given to simulate() as they are.
Fill = Callable[[DataFrame, list[str]], DataFrame]
FILLS: dict[str, Callable[[int], Fill]] = {
    "close": lambda lag: lambda bars, keys: market_fill(bars, keys, "close", lag),
    "next_close": lambda lag: lambda bars, keys: market_fill(bars, keys, "next_close", lag),
    "next_open": lambda lag: lambda bars, keys: market_fill(bars, keys, "next_open", lag),
    "limit": lambda lag: lambda bars, keys: limit_fill(bars, keys),
}
LEAST_LAG = {"next_close": 1, "next_open": 1}


def fill_model(fill: str | Fill, lag: int = 1) -> Fill:
    """The fill of that name, or the function itself."""
    if callable(fill):
        return fill
    if fill not in FILLS or lag < LEAST_LAG.get(fill, 0):
        raise ConfigError(f"fill {fill!r} with lag {lag} is not known; fills: {sorted(FILLS)}; next_* needs a lag of 1 or more")
    return FILLS[fill](lag)


LIMIT_SCHEMA = "held double, trade double, gross double, price double, ordered int, filled int"


def limit_fill(bars: DataFrame, keys: list[str], offset_bps: float = 10.0) -> DataFrame:
    """Orders of the bar before at its close -/+ offset: a buy fills if the low reaches it, at the better of limit and open; else it lapses.

    Whether a weight is held depends on whether earlier orders filled, so a symbol's bars are walked in order, each symbol by itself.
    A missing or zero price gives no return.
    """
    import pandas as pd

    def change(now: float, before: float) -> float:
        return now / before - 1 if before and before == before and now == now else 0.0

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("timestamp").reset_index(drop=True)
        held, prev, want, out = 0.0, None, 0.0, []
        for o, h, lo, c, target in zip(pdf["open"], pdf["high"], pdf["low"], pdf["close"], pdf["weight"], strict=True):
            old, trade, price, gross, ordered, filled = held, 0.0, c, 0.0, 0, 0
            if prev is not None:
                if want != held:
                    ordered = 1
                    buy = want > held
                    limit = prev * (1 - offset_bps / 1e4) if buy else prev * (1 + offset_bps / 1e4)
                    if lo <= limit if buy else h >= limit:
                        price, filled = (min(limit, o) if buy else max(limit, o)), 1
                        trade, held = want - held, want
                gross = (1 + old * change(price, prev)) * (1 + held * change(c, price)) - 1 if filled else old * change(c, prev)
            out.append((held, trade, gross, price, ordered, filled))
            prev, want = c, 0.0 if pd.isna(target) else float(target)
        return pd.concat([pdf, pd.DataFrame(out, columns=["held", "trade", "gross", "price", "ordered", "filled"])], axis=1)

    fields = ", ".join(f"`{n}` {t}" for n, t in bars.dtypes)
    return bars.groupBy(*keys).applyInPandas(walk, f"{fields}, {LIMIT_SCHEMA}")


def _not_infinite(bars: DataFrame) -> DataFrame:
    endless = F.abs(F.col("weight").cast("double")) == float("inf")
    return bars.withColumn("weight", F.when(endless, F.raise_error(F.lit("a weight is infinite"))).otherwise(F.col("weight").cast("double")))


def _market_context(bars: DataFrame, w, capital: float, vol_rows: int) -> DataFrame:
    """bars with vol, adv (both of the rows before) and capital, which costs read."""
    rows = bars.withColumn("_ret", wn.pct_change(F.col("close"), w))
    return rows.withColumns({"vol": wn.causal_volatility(F.col("_ret"), w, vol_rows), "adv": wn.rolling_mean(F.col("volume").cast("double"), w, 20), "capital": F.lit(float(capital))}).drop("_ret")


def _costs(model: CostModel | None) -> dict[str, Column]:
    """Columns by name; a component that is negative anywhere is an error."""
    parts = {n: F.coalesce(c, F.lit(0.0)) for n, c in (model or CostModel()).columns().items()}
    return {n: F.when(c < 0, F.raise_error(F.lit(f"cost {n} is negative"))).otherwise(c) for n, c in parts.items()}


def simulate(bars: DataFrame, keys: list[str], costs: CostModel | None = None, fill: str | Fill = "close", lag: int = 1, capital: float = 1e6, vol_rows: int = 20) -> DataFrame:
    """bars (with weight; null is flat, infinite an error) and held, trade, gross, one column cost_<name> per component, cost and net. Volatility and ADV are of the rows before."""
    w = Window.partitionBy(*keys).orderBy("timestamp")
    rows = _market_context(fill_model(fill, lag)(_not_infinite(bars), keys), w, capital, vol_rows)
    parts = _costs(costs)
    rows = rows.withColumns({f"cost_{n}": c for n, c in parts.items()})
    total = sum((F.col(f"cost_{n}") for n in parts), F.lit(0.0))
    return rows.withColumn("cost", total).withColumn("net", F.col("gross") - F.col("cost"))


def portfolio(sim: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Sums over symbols per timestamp: gross, cost, net, turnover (sum |trade|), net_turnover (|sum trade|)."""
    return sim.groupBy(*keys, "timestamp").agg(
        F.sum("gross").alias("gross"), F.sum("cost").alias("cost"), F.sum("net").alias("net"), F.sum(F.abs("trade")).alias("turnover"), F.abs(F.sum("trade")).alias("net_turnover")
    )


def portfolio_weights(sim: DataFrame) -> DataFrame:
    """(timestamp, symbol, held) on the whole calendar of the panel: each symbol is simulated on its own rows, and holds its last weight where it has none; 0 before its first."""
    w = Window.partitionBy("symbol").orderBy("timestamp")
    return prepare.completed(sim, "held").withColumn("held", F.coalesce(wn.carried(F.col("held"), w), F.lit(0.0)))


def fill_rate(sim: DataFrame) -> DataFrame:
    """(symbol, fill_rate) of limit orders: filled of ordered, 1 without orders."""
    return sim.groupBy("symbol").agg(F.coalesce(F.try_divide(F.sum("filled"), F.sum("ordered")), F.lit(1.0)).alias("fill_rate"))


# ---- effective-dated fees

#: Rates are fractions of value, by segment and date; an open end is null.
FEE_SCHEMA = "segment string, valid_from date, valid_to date, tax_buy double, tax_sell double, exchange double, regulator double, stamp_buy double, indirect double"


def charge(trades: DataFrame, schedule: DataFrame) -> DataFrame:
    """trades (trade_id, value, side, segment, day, brokerage) with `charge` and `n_schedules` (0: not covered, 2 or more: overlap)."""
    covered = (F.col("segment") == F.col("_seg")) & (F.col("day") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("day") <= F.col("valid_to")))
    rows = trades.join(small(schedule.withColumnRenamed("segment", "_seg")), covered, "left")
    buy = F.col("side") == "buy"
    levy = F.col("value") * (F.col("exchange") + F.col("regulator"))
    total = F.col("value") * (F.when(buy, F.col("tax_buy")).otherwise(F.col("tax_sell"))) + levy + F.when(buy, F.col("value") * F.col("stamp_buy")).otherwise(0.0) + F.col("indirect") * (F.col("brokerage") + levy)
    return rows.groupBy(*trades.columns).agg(F.first(total, True).alias("charge"), F.count("_seg").alias("n_schedules"))


@dataclass(frozen=True)
class Fees:
    """Rates of one segment between two dates, both included; an open end is None."""

    segment: str
    valid_from: dt.date
    valid_to: dt.date | None = None
    tax_buy: float = 0.0
    tax_sell: float = 0.0
    exchange: float = 0.0
    regulator: float = 0.0
    stamp_buy: float = 0.0
    indirect: float = 0.0

    def row(self) -> tuple:
        return tuple(vars(self).values())


@dataclass(frozen=True)
class Provider:
    """A named set of dated fees. Overlaps are an error when it is made; days and segments it does not cover, when it is used."""

    name: str
    fees: tuple[Fees, ...]

    def __post_init__(self):
        for segment in self.segments():
            spans = sorted((f.valid_from, f.valid_to or dt.date.max) for f in self.fees if f.segment == segment)
            if any(b[0] <= a[1] for a, b in zip(spans, spans[1:], strict=False)):
                raise ConfigError(f"fees of {segment} overlap")

    def segments(self) -> list[str]:
        return sorted({f.segment for f in self.fees})

    def schedule(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([f.row() for f in self.fees], FEE_SCHEMA)

    def charge(self, trades: DataFrame) -> DataFrame:
        """charge() of trades, or an error that names the first trade without a schedule and where coverage starts."""
        found = charge(trades, self.schedule(trades.sparkSession))
        if lost := found.where("n_schedules <> 1").orderBy("day").first():
            if lost["segment"] not in self.segments():
                raise DataError(f"{lost['segment']!r} is no segment of {self.name}; known: {self.segments()}")
            raise DataError(f"{self.name} has no fees for {lost['segment']} on {lost['day']}; they start on {min(f.valid_from for f in self.fees if f.segment == lost['segment'])}")
        return found

    def cost(self, segment: str, brokerage_bps: float = 0.0, cap: float | None = None) -> Cost:
        """A component of a cost model: the charges of each bar's trade at that day's rates, brokerage (in bps, at most `cap` an order) included. A schedule is some rows, so it is part of the expression."""
        if segment not in self.segments():
            raise ConfigError(f"{segment!r} is no segment of {self.name}; known: {self.segments()}")

        def build() -> Column:
            value = F.abs("trade") * F.col("capital")
            brokerage = value * brokerage_bps / 1e4
            brokerage = brokerage if cap is None else F.least(brokerage, F.lit(float(cap)))
            total, buy, day = F.raise_error(F.lit(f"{self.name} has no fees for {segment} on a day of these bars")).cast("double"), F.col("trade") > 0, F.to_date("timestamp")
            for f in self.fees:
                if f.segment == segment:
                    levy = value * (f.exchange + f.regulator)
                    sums = value * F.when(buy, f.tax_buy + f.stamp_buy).otherwise(f.tax_sell) + levy + brokerage + f.indirect * (brokerage + levy)
                    inside = day.between(F.lit(f.valid_from), F.lit(f.valid_to)) if f.valid_to else day >= F.lit(f.valid_from)
                    total = F.when(inside, sums).otherwise(total)
            return F.when(F.coalesce(F.col("trade"), F.lit(0.0)) != 0, total / F.col("capital")).otherwise(0.0)

        return Cost("statutory", build)


_FROM, _CHANGE = dt.date(2024, 10, 1), dt.date(2026, 4, 1)
_COMMON = {"regulator": 10 / 1e7, "indirect": 0.18}
# Charges on the National Stock Exchange of India as published, fractions of value (of the premium for options).
NSE = Provider("india_nse", (
    Fees("equity_delivery", _FROM, None, 0.001, 0.001, 0.0000297, stamp_buy=0.00015, **_COMMON),
    Fees("equity_intraday", _FROM, None, 0.0, 0.00025, 0.0000297, stamp_buy=0.00003, **_COMMON),
    Fees("equity_futures", _FROM, _CHANGE - dt.timedelta(days=1), 0.0, 0.0002, 0.0000173, stamp_buy=0.00002, **_COMMON),
    Fees("equity_futures", _CHANGE, None, 0.0, 0.0005, 0.0000173, stamp_buy=0.00002, **_COMMON),
    Fees("equity_options", _FROM, _CHANGE - dt.timedelta(days=1), 0.0, 0.001, 0.0003503, stamp_buy=0.00003, **_COMMON),
    Fees("equity_options", _CHANGE, None, 0.0, 0.0015, 0.0003503, stamp_buy=0.00003, **_COMMON),
))


# ---- reports


def turnover_by_year(trades: DataFrame) -> DataFrame:
    per = trades.groupBy("timestamp").agg(F.sum(F.abs("trade")).alias("g"), F.abs(F.sum("trade")).alias("n"))
    return per.groupBy(F.year("timestamp").alias("year")).agg(F.sum("g").alias("gross_turnover"), F.sum("n").alias("net_turnover"), F.count_if(F.col("g") > 0).alias("trading_bars"))


def turnover_statistics(trades: DataFrame, periods: float = 252.0) -> DataFrame:
    """One row: gross and net totals, mean and annual turnover, bars with a trade, and the holding period in bars (2 / mean)."""
    per = trades.groupBy("timestamp").agg(F.sum(F.abs("trade")).alias("g"), F.abs(F.sum("trade")).alias("n"))
    return per.agg(
        F.sum("g").alias("gross_turnover"), F.sum("n").alias("net_turnover"), F.avg("g").alias("mean_turnover"), (F.avg("g") * periods).alias("annual_turnover"),
        F.count_if(F.col("g") > 0).alias("trading_bars"), F.try_divide(F.lit(2.0), F.avg("g")).alias("holding_bars"),
    )


def headline(returns: DataFrame, value: str = "ret", keys: tuple[str, ...] = (), periods: float = 252.0) -> DataFrame:
    """Per key: n, sharpe, cagr, max_drawdown, volatility (annual) and total return of the returns that are not null."""
    rows = returns.where(F.col(value).isNotNull())
    flat = rows if keys else rows.withColumn("_all", F.lit(0))
    by = list(keys) or ["_all"]
    m = moments.sharpe_by(flat, value, by, periods).select(*by, "n", "sharpe")
    rest = flat.groupBy(*by).agg((F.stddev_samp(value) * periods**0.5).alias("volatility"), (F.product(1 + F.col(value)) - 1).alias("total_return"))
    out = m.join(rest, by).join(moments.growth_by(flat, value, by, periods), by).join(moments.max_drawdown_by(flat, value, by), by)
    return out.select(*keys, "n", "sharpe", "cagr", "max_drawdown", "volatility", "total_return")


def timing(ledger: DataFrame) -> DataFrame:
    """Latency of executions after signals in seconds: counts at zero and before, min, median, max."""
    sec = F.expr("(unix_micros(cast(execution_time as timestamp)) - unix_micros(cast(signal_time as timestamp))) / 1e6").cast("double")
    rows = ledger.select(sec.alias("s"))
    return rows.agg(
        F.count("s").alias("n_trades"), F.count_if(F.col("s") == 0).alias("n_instant"), F.count_if(F.col("s") < 0).alias("n_before_signal"),
        F.min("s").alias("min_seconds"), F.expr("percentile(s, 0.5)").alias("median_seconds"), F.max("s").alias("max_seconds"),
    )


def attribution(port: DataFrame, sim: DataFrame, periods: float = 252.0) -> DataFrame:
    """(component, total, annual): gross, each cost with a minus sign, and net."""
    names = [c for c in sim.columns if c.startswith("cost_")]
    n = port.agg(F.count(F.lit(1)).alias("_n"))
    sums = sim.agg(F.sum("gross").alias("gross"), *[(-F.sum(c)).alias(c[5:]) for c in names], F.sum("net").alias("net")).crossJoin(F.broadcast(n))
    items = F.explode(F.array(*[F.struct(F.lit(c).alias("component"), F.col(c).alias("total")) for c in ("gross", *[c[5:] for c in names], "net")]))
    return sums.select("_n", items.alias("_i")).select("_i.component", "_i.total", (F.col("_i.total") / F.col("_n") * periods).alias("annual"))


def scenario_rows(bars: DataFrame, scenarios: dict[str, dict]) -> DataFrame:
    """(scenario, timestamp, symbol, gross, cost, net, trade) of several simulations of one panel. Market fills share one pass of windows, and an explode lays the scenarios out; other fills are simulated by themselves."""
    w = Window.partitionBy("symbol").orderBy("timestamp")
    market = {n: s for n, s in scenarios.items() if s.get("fill", "close") in ("close", "next_close", "next_open")}
    columns = ["scenario", "timestamp", "symbol", "gross", "cost", "net", "trade"]
    out = None
    for name in scenarios.keys() - market.keys():
        one = simulate(bars, ["symbol"], **scenarios[name]).withColumn("scenario", F.lit(name)).select(*columns)
        out = one if out is None else out.unionByName(one)
    if market:
        for s in market.values():
            fill_model(s.get("fill", "close"), s.get("lag", 1))
        lags = sorted({x for s in market.values() for x in (s.get("lag", 1), s.get("lag", 1) + 1)})
        rows = _market_context(_not_infinite(bars), w, 1e6, 20).withColumns({f"_w{k}": lagged_target(k, w) for k in lags} | {"_prev": F.lag("close").over(w)})
        zero = F.lit(0.0)
        by_close = F.coalesce(F.try_divide(F.col("close"), F.col("_prev")) - 1, zero)
        overnight, day = F.coalesce(F.try_divide(F.col("open"), F.col("_prev")) - 1, zero), F.coalesce(F.try_divide(F.col("close"), F.col("open")) - 1, zero)
        items = []
        for name, s in market.items():
            held, old, opening = F.col(f"_w{s.get('lag', 1)}"), F.col(f"_w{s.get('lag', 1) + 1}"), s.get("fill", "close") == "next_open"
            gross = (1 + old * overnight) * (1 + held * day) - 1 if opening else old * by_close
            price = F.coalesce(F.col("open"), F.col("close")) if opening else F.col("close")
            items.append(F.struct(F.lit(name).alias("scenario"), (held - old).alias("trade"), gross.alias("gross"), price.alias("price"), F.lit(float(s.get("capital", 1e6))).alias("capital")))
        rows = rows.drop("capital").withColumn("_s", F.explode(F.array(*items))).select("*", "_s.*").drop("_s")
        cost = F.lit(None).cast("double")
        for name, s in market.items():
            cost = F.when(F.col("scenario") == name, sum(_costs(s.get("costs")).values(), zero)).otherwise(cost)
        one = rows.withColumn("cost", cost).withColumn("net", F.col("gross") - F.col("cost")).select(*columns)
        out = one if out is None else out.unionByName(one)
    return out


def scenario_table(bars: DataFrame, scenarios: dict[str, dict], periods: float = 252.0, since=None) -> DataFrame:
    """(scenario, n, total, sharpe) of several simulations of one panel, in one plan; from a time on, if given."""
    rows = portfolio(scenario_rows(bars, scenarios), ("scenario",))
    return moments.sharpe_by(rows if since is None else rows.where(F.col("timestamp") >= F.lit(since)), "net", ["scenario"], periods)


def roll_spread(bars: DataFrame, keys: list[str]) -> DataFrame:
    """Effective spread 2*sqrt(-cov(d log p, lag)); 0 if the covariance is not negative, null for fewer than 4 prices."""
    w = Window.partitionBy(*keys).orderBy("timestamp")
    rows = bars.where("close > 0").withColumn("_d", F.log("close") - F.lag(F.log("close")).over(w)).withColumn("_l", F.lag("_d").over(w))
    cov = F.covar_samp("_d", "_l")
    return rows.groupBy(*keys).agg(F.when(F.count(F.lit(1)) >= 4, F.when(cov < 0, 2 * F.sqrt(-cov)).otherwise(0.0)).alias("roll_spread"))


#: Names of fills that a strategy may declare but bars cannot test.
UNTESTABLE = ("intrabar", "event", "vwap", "twap")


@dataclass
class BreakEven:
    bps: float | None = None
    multiplier: float | None = None
    notes: list[str] = field(default_factory=list)


def break_even(mean_gross: float, mean_turnover: float, mean_cost: float) -> BreakEven:
    if mean_gross <= 0:
        return BreakEven(notes=["no gross profit to break even on"])
    inf = float("inf")
    return BreakEven(mean_gross / mean_turnover * 1e4 if mean_turnover else inf, mean_gross / mean_cost if mean_cost else inf)
