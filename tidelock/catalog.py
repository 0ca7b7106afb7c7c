"""Queries of the audit engine over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import moments
from .operators import causality, execution, leakage, prepare, quality, regimes, resample, selection
from .operators import windows as wn
from .operators.tables import BARS_SQL, INDEX_SQL, bars, index_bars, ledger, load
from .plans import folds
from .sources import tables

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
DAY = "yyyy-MM-dd"


def _counts(sql: str) -> str:
    """SQL with every count_if(..) as a bigint, as Spark has it."""
    out, at = [], 0
    while (start := sql.find("count_if(", at)) >= 0:
        end, depth = start + len("count_if("), 1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        out += [sql[at:start], "cast(", sql[start:end], " as bigint)"]
        at = end
    return "".join([*out, sql[at:]])


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def day(c: str = "timestamp"):
    return F.date_format(c, DAY).alias("day")


def r6(c) -> object:
    """Rounded to 6 decimals; a zero has no sign."""
    return F.round(c, 6) + 0.0


def weighted(df: DataFrame) -> DataFrame:
    """Bars with the weight of a moving-average cross: long while the mean of 5 closes is above that of 20; null before 20 bars."""
    w = Window.partitionBy("symbol").orderBy("timestamp")
    fast, slow = wn.rolling_mean(F.col("close"), w, 5, 5, False), wn.rolling_mean(F.col("close"), w, 20, 20, False)
    return df.withColumn("weight", F.when(slow.isNotNull(), (fast > slow).cast("double")))


def index_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.orderBy("timestamp")  # one value a week: a short series
    return index_bars(spark, sf_dir).withColumn("ret", wn.pct_change(F.col("close"), w))


def trial_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(timestamp, trial, ret): long-or-flat on the weekly index against its mean of 2 + 2 * trial weeks, 12 trials."""
    w = Window.orderBy("timestamp")
    x = index_returns(spark, sf_dir)
    x = x.select("timestamp", "ret", *[F.lag(F.when(F.col("close") > wn.rolling_mean(F.col("close"), w, 2 + 2 * k, 1, False), 1.0).otherwise(0.0)).over(w).alias(f"s{k}") for k in range(12)])
    rows = x.where("ret is not null").select("timestamp", F.explode(F.array(*[F.struct(F.lit(k).alias("trial"), (F.col("ret") * F.coalesce(F.col(f"s{k}"), F.lit(0.0))).alias("ret")) for k in range(12)])).alias("_x"))
    return rows.select("timestamp", "_x.trial", "_x.ret")


W = "over (partition by symbol order by ts)"
B = f"with b as ({BARS_SQL})"
RET = f"{B}, r as (select *, close / nullif(lag(close) {W}, 0) - 1 as ret from b)"
WT = f"""{B}, w0 as (select *, count(close) over f as nf, avg(close) over f as fast, count(close) over s as ns, avg(close) over s as slow from b
  window f as (partition by symbol order by ts rows 4 preceding), s as (partition by symbol order by ts rows 19 preceding)),
wt as (select *, case when ns >= 20 then case when fast > slow then 1.0 else 0.0 end end as weight from w0)"""


def sim_sql(lag: int, fill: str = "close") -> str:
    held = f"coalesce(lag(weight, {lag}) {W}, 0)" if lag else "coalesce(weight, 0)"
    gross = "old * coalesce(close / nullif(prev, 0) - 1, 0)" if fill == "close" else "(1 + old * coalesce(open / nullif(prev, 0) - 1, 0)) * (1 + held * coalesce(close / nullif(open, 0) - 1, 0)) - 1"
    return f"""{WT}, h as (select *, {held} as held, lag(close) {W} as prev from wt), o as (select *, coalesce(lag(held) {W}, 0) as old from h),
sim as (select *, held - old as trade, {gross} as gross, {'close' if fill == 'close' else 'open'} as price from o)"""


COSTS = execution.CostModel((execution.bps(1.0), execution.half_spread(4.0), execution.slippage(2.0)))
NET = f"""{sim_sql(1)}, c as (select *, abs(trade) * 1.0 / 1e4 as commission, abs(trade) * 2.0 / 1e4 as spread, abs(trade) * 2.0 / 1e4 as slippage from sim),
n as (select *, commission + spread + slippage as cost, gross - (commission + spread + slippage) as net from c)"""
IDX = f"with i as ({INDEX_SQL}), x as (select ts, close, close / nullif(lag(close) over (order by ts), 0) - 1 as ret from i)"
# The mean over a frame of varying length, from running sums.
TRIALS = f"""{IDX}, c as (select *, sum(close) over (order by ts) as run, row_number() over (order by ts) as p from x), k as (select unnest(range(12)) as trial),
s as (select c.ts, c.p, c.ret, trial, case when c.close * least(c.p, 2 + 2 * trial) > c.run - coalesce(d.run, 0) then 1.0 else 0.0 end as on_ from c cross join k left join c d on d.p = c.p - (2 + 2 * trial)),
t as (select ts, trial, ret * coalesce(o, 0) as ret from (select *, lag(on_) over (partition by trial order by ts) as o from s) where ret is not null)"""

# ---- rows and quality


@query(f"{B} select strftime(ts, '%Y-%m-%d') as day, symbol, round(open, 6) as open, round(high, 6) as high, round(low, 6) as low, round(close, 6) as close, volume from b")
def bars_daily(spark, sf_dir):
    return bars(spark, sf_dir).select(day(), "symbol", *[r6(F.col(c)).alias(c) for c in ("open", "high", "low", "close")], "volume")


@query("select strftime(ts, '%Y-%m-%d %H:%M:%S') as time, event_type, value from (select *, row_number() over (partition by date_trunc('hour', ts), event_type order by event_id desc) as n from events) where n = 1")
def prep_dedup_last(spark, sf_dir):
    e = load(spark, sf_dir, "events").withColumn("timestamp", F.date_trunc("hour", F.col("ts").cast("timestamp")).cast("timestamp_ntz"))
    kept, _ = prepare.prepare(e, "event_id", ("event_type",))
    return kept.select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("time"), "event_type", "value")


@query(f"""{B} select symbol, count(*) as n_rows, count(ts) - count(distinct ts) as n_duplicate_times, count_if(high < greatest(open, close, low) - 1e-12 or low > least(open, close, high) + 1e-12) as n_impossible,
count_if(open <= 0 or high <= 0 or low <= 0 or close <= 0) as n_nonpositive, count_if(isinf(open) or isinf(high) or isinf(low) or isinf(close)) as n_infinite, count_if(open is null) as n_missing_open,
count_if(high is null) as n_missing_high, count_if(low is null) as n_missing_low, count_if(close is null) as n_missing_close from b group by symbol""")
def dq_counters(spark, sf_dir):
    return quality.row_counters(bars(spark, sf_dir), ["symbol"])


RAW = "select l_shipdate as ts, l_returnflag as symbol, l_extendedprice / l_quantity as close from lineitem"


@query("select l_returnflag as symbol, count(*) as n_rows, count(l_shipdate) - count(distinct l_shipdate) as n_duplicate_times from lineitem group by 1")
def dq_duplicates(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem").select(F.col("l_shipdate").alias("timestamp"), F.col("l_returnflag").alias("symbol"), *[(F.col("l_extendedprice") / F.col("l_quantity")).alias(c) for c in quality.PRICES])
    return quality.row_counters(li, ["symbol"]).select("symbol", "n_rows", "n_duplicate_times")


@query("select coalesce(sum(n - 1), 0)::bigint as n_duplicate_rows from (select count(*) as n from lineitem group by l_orderkey, l_linenumber)")
def dq_duplicate_rows(spark, sf_dir):
    return quality.duplicate_rows(load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"))


@query("select o_orderpriority as symbol, count_if(o_orderdate < p) as n_backward from (select *, lag(o_orderdate) over (partition by o_orderpriority order by o_orderkey) as p from orders) group by 1")
def dq_monotonic(spark, sf_dir):
    o = load(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "symbol")
    return quality.out_of_order(o, "o_orderdate", "o_orderkey", ["symbol"])


@query("select count_if(p_name is null) as p_name, count_if(p_brand is null) as p_brand, count_if(p_retailprice is null or isnan(p_retailprice)) as p_retailprice from part")
def dq_nulls(spark, sf_dir):
    return quality.missing_values(load(spark, sf_dir, "part").select("p_name", "p_brand", "p_retailprice"))


@query(f"""{B}, g as (select symbol, ts, lead(ts) {W} as nx from (select distinct symbol, ts from b)), s as (select symbol, epoch_us(nx) / 1e6 - epoch_us(ts) / 1e6 as gap, nx::date > ts::date as cross_ from g where nx is not null),
m as (select symbol, quantile_cont(gap, 0.5) as med, count(*) as n from s group by 1)
select symbol, round(max(med), 3) as median_seconds, count_if(big) as n_gaps, round(max(case when big then gap end), 3) as longest_gap
from (select s.*, med, n, gap > 5 * med and not (med < 86400 and cross_) and n >= 2 as big from s join m using (symbol)) group by symbol""")
def dq_gaps(spark, sf_dir):
    g = quality.gaps(bars(spark, sf_dir), 5.0, ["symbol"])
    return g.select("symbol", F.round("median_seconds", 3).alias("median_seconds"), "n_gaps", F.round("longest_gap", 3).alias("longest_gap"))


@query("""with e as (select event_type as symbol, ts, event_id, user_id % 3 as v from events), c as (select *, case when v is not distinct from lag(v) over (partition by symbol order by ts, event_id) then 0 else 1 end as ch from e),
r as (select symbol, sum(ch) over (partition by symbol order by ts, event_id) as run from c), l as (select symbol, run, count(*) as n from r group by 1, 2)
select symbol, count_if(n >= 4) as n_runs, max(n) as longest_run from l group by 1""")
def dq_stale_runs(spark, sf_dir):
    e = load(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), F.struct("ts", "event_id").alias("timestamp"), (F.col("user_id") % 3).alias("v"))
    return quality.stale_runs(e, "v", 4, ["symbol"])


@query(f"{RET} select symbol, count_if(abs(ret) > 0.5) as n_extreme, round(arg_max(ret, abs(ret)), 6) as worst from r group by symbol")
def dq_extreme(spark, sf_dir):
    e = quality.extreme_returns(bars(spark, sf_dir), "close", 0.5, ["symbol"])
    return e.select("symbol", "n_extreme", r6(F.col("worst")).alias("worst"))


@query(f"""{B}, t as (select distinct ts, symbol from b), s as (select symbol, min(ts) as a, max(ts) as z from t group by 1), c as (select max(a) as a, min(z) as z from s),
u as (select count(*) as n, count_if(ts between c.a and c.z) as ni from (select distinct ts from t), c)
select t.symbol, count(*) as n_times, round(count(*) / max(u.n), 6) as coverage, (max(u.ni) - count_if(t.ts between c.a and c.z))::bigint as n_missing_inside from t, c, u group by t.symbol""")
def dq_sync(spark, sf_dir):
    s = quality.synchrony(bars(spark, sf_dir))
    return s.select("symbol", "n_times", r6(F.col("coverage")).alias("coverage"), "n_missing_inside")


# ---- series


@query(f"{RET} select strftime(ts, '%Y-%m-%d') as day, symbol, round(ret, 6) + 0.0 as ret from r")
def returns_simple(spark, sf_dir):
    w = Window.partitionBy("symbol").orderBy("timestamp")
    return bars(spark, sf_dir).select(day(), "symbol", r6(wn.pct_change(F.col("close"), w)).alias("ret"))


@query(f"""{B}, g as (select t.ts, s.symbol, b.close from (select distinct ts from b) t cross join (select distinct symbol from b) s left join b on b.ts = t.ts and b.symbol = s.symbol),
r as (select ts, symbol, close / nullif(lag(close) {W}, 0) - 1 as ret from g) select strftime(ts, '%Y-%m-%d') as day, count(ret) as n, round(avg(ret), 6) + 0.0 as ret from r group by ts""")
def returns_reference(spark, sf_dir):
    w = Window.partitionBy("symbol").orderBy("timestamp")
    grid = prepare.completed(bars(spark, sf_dir), "close").withColumn("ret", wn.pct_change(F.col("close"), w))
    return grid.groupBy("timestamp").agg(F.count("ret").alias("n"), r6(F.avg("ret")).alias("ret")).select(day(), "n", "ret")


@query(f"{IDX} select strftime(ts, '%Y-%m-%d') as day, round(product(1 + coalesce(ret, 0)) over (order by ts), 6) as equity from x")
def equity_curve(spark, sf_dir):
    return index_returns(spark, sf_dir).select(day(), F.round(wn.equity(F.col("ret"), Window.orderBy("timestamp")), 6).alias("equity"))


@query(f"{IDX}, e as (select ts, product(1 + coalesce(ret, 0)) over (order by ts) as e from x) select strftime(ts, '%Y-%m-%d') as day, round(e / greatest(max(e) over (order by ts), 1) - 1, 6) + 0.0 as drawdown from e")
def drawdown(spark, sf_dir):
    w = Window.orderBy("timestamp")
    x = index_returns(spark, sf_dir).withColumn("e", wn.equity(F.col("ret"), w))
    return x.select(day(), r6(wn.drawdown(F.col("e"), w)).alias("drawdown"))


@query(f"""{RET}, v as (select ts, symbol, case when count(ret) over f >= 10 then stddev_samp(ret) over f end as a, case when count(ret) over g >= 2 then stddev_samp(ret) over g end as z from r
window f as (partition by symbol order by ts rows between 20 preceding and 1 preceding), g as (partition by symbol order by ts rows between unbounded preceding and 1 preceding))
select strftime(ts, '%Y-%m-%d') as day, symbol, round(coalesce(a, z), 6) as vol from v""")
def causal_vol(spark, sf_dir):
    w = Window.partitionBy("symbol").orderBy("timestamp")
    x = bars(spark, sf_dir).withColumn("ret", wn.pct_change(F.col("close"), w))
    return x.select(day(), "symbol", F.round(wn.causal_volatility(F.col("ret"), w), 6).alias("vol"))


@query(f"{B} select strftime(ts, '%Y-%m-%d') as day, symbol, round(avg(volume) over (partition by symbol order by ts rows between 20 preceding and 1 preceding), 6) as adv from b")
def adv_lagged(spark, sf_dir):
    w = Window.partitionBy("symbol").orderBy("timestamp")
    return bars(spark, sf_dir).select(day(), "symbol", F.round(wn.rolling_mean(F.col("volume").cast("double"), w, 20), 6).alias("adv"))


# ---- execution

SIM_OUT = "strftime(ts, '%Y-%m-%d') as day, symbol, held, trade, round(gross, 6) + 0.0 as gross"


def _fill(spark, sf_dir, fill, lag):
    s = execution.simulate(weighted(bars(spark, sf_dir)), ["symbol"], None, fill, lag)
    return s.select(day(), "symbol", "held", "trade", r6(F.col("gross")).alias("gross"))


for _lag in (0, 1, 2):
    def _close(spark, sf_dir, lag=_lag):
        return _fill(spark, sf_dir, "close", lag)

    _QUERIES[f"fill_close_lag{_lag}"], _SQL[f"fill_close_lag{_lag}"] = _close, f"{sim_sql(_lag)} select {SIM_OUT} from sim"


@query(f"{sim_sql(1, 'next_open')} select {SIM_OUT} from sim")
def fill_next_open(spark, sf_dir):
    return _fill(spark, sf_dir, "next_open", 1)


# The walk of the limit orders as a recursion over each symbol's rows.
LIMIT_SQL = f"""with recursive {WT[5:]}, q as (select *, row_number() over (partition by symbol order by ts) as p, lag(close) {W} as prev, coalesce(lag(weight) {W}, 0) as want from wt),
walk as (select symbol, p, 0.0::double as held, 0 as ordered, 0 as filled, 0.0::double as gross from q where p = 1
 union all select symbol, p, case when hit then want else held end, (want <> held)::integer, hit::integer,
  case when hit then (1 + held * (price / prev - 1)) * (1 + want * (close / price - 1)) - 1 else held * (close / prev - 1) end
 from (select q.symbol, q.p, w.held, want, prev, close, want <> w.held and case when want > w.held then low <= prev * (1 - 0.001) else high >= prev * (1 + 0.001) end as hit,
  case when want > w.held then least(prev * (1 - 0.001), open) else greatest(prev * (1 + 0.001), open) end as price from walk w join q on q.symbol = w.symbol and q.p = w.p + 1))"""


@query(f"{LIMIT_SQL} select symbol, sum(ordered)::bigint as orders, sum(filled)::bigint as fills, round(sum(gross), 6) as gross, round(case when sum(ordered) > 0 then sum(filled) / sum(ordered) else 1 end, 6) as fill_rate from walk group by symbol")
def fill_limit(spark, sf_dir):
    s = execution.limit_fill(weighted(bars(spark, sf_dir)), ["symbol"])
    total = s.groupBy("symbol").agg(F.sum("ordered").alias("orders"), F.sum("filled").alias("fills"), F.round(F.sum("gross"), 6).alias("gross"))
    return total.join(execution.fill_rate(s), "symbol").select("symbol", "orders", "fills", "gross", F.round("fill_rate", 6).alias("fill_rate"))


@query(f"{NET} select strftime(ts, '%Y-%m-%d') as day, symbol, round(commission, 9) as cost_commission, round(spread, 9) as cost_spread, round(slippage, 9) as cost_slippage, round(cost, 9) as cost, round(net, 6) + 0.0 as net from n")
def cost_breakdown(spark, sf_dir):
    s = execution.simulate(weighted(bars(spark, sf_dir)), ["symbol"], COSTS)
    return s.select(day(), "symbol", *[F.round(c, 9).alias(c) for c in ("cost_commission", "cost_spread", "cost_slippage", "cost")], r6(F.col("net")).alias("net"))


@query(f"""{sim_sql(1)}, q as (select sim.*, case when dayofmonth(sim.ts) <= 10 then 2.0 + dayofmonth(sim.ts) end as quote from sim), f as (select *, coalesce(last_value(quote ignore nulls) over (partition by symbol order by ts rows unbounded preceding), 0) as spread_bps from q)
select strftime(ts, '%Y-%m-%d') as day, symbol, spread_bps, round(abs(trade) * spread_bps / 2 / 1e4, 9) as cost_spread from f""")
def cost_series_spread(spark, sf_dir):
    b = weighted(bars(spark, sf_dir))
    quotes = b.where(F.dayofmonth("timestamp") <= 10).select("timestamp", "symbol", (F.dayofmonth("timestamp") + 2.0).alias("spread_bps"))
    s = execution.simulate(execution.quoted_spread(b, quotes, ["symbol"]), ["symbol"], execution.CostModel((execution.half_spread_series("spread_bps"),)))
    return s.select(day(), "symbol", "spread_bps", F.round("cost_spread", 9).alias("cost_spread"))


@query("""with t as (select o_orderkey as trade_id, o_totalprice as value, case when o_orderkey % 2 = 0 then 'buy' else 'sell' end as side, o_orderdate::date as d from orders)
select trade_id, round(value * case when side = 'buy' then 0.001 else 0.002 end + value * (x + 0.000001) + case when side = 'buy' then value * 0.00015 else 0 end + 0.18 * (5 + value * (x + 0.000001)), 6) as charge, 1::bigint as n_schedules
from (select *, case when d < date '1996-01-01' then 0.0000325 else 0.0000297 end as x from t)""")
def cost_statutory(spark, sf_dir):
    schedule = spark.sql("select 'delivery' as segment, date'1900-01-01' as valid_from, date'1995-12-31' as valid_to, 0.001D as tax_buy, 0.002D as tax_sell, 0.0000325D as exchange, 0.000001D as regulator, 0.00015D as stamp_buy, 0.18D as indirect"
                         " union all select 'delivery', date'1996-01-01', null, 0.001D, 0.002D, 0.0000297D, 0.000001D, 0.00015D, 0.18D")  # fmt: skip
    t = load(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("trade_id"), F.col("o_totalprice").alias("value"), F.when(F.col("o_orderkey") % 2 == 0, "buy").otherwise("sell").alias("side"),
        F.lit("delivery").alias("segment"), F.to_date("o_orderdate").alias("day"), F.lit(5.0).alias("brokerage"),
    )
    return execution.charge(t, schedule).select("trade_id", F.round("charge", 6).alias("charge"), "n_schedules")


@query(f"""{sim_sql(1)}, v as (select *, close / nullif(prev, 0) - 1 as ret from sim), u as (select *, coalesce(case when count(ret) over f >= 10 then stddev_samp(ret) over f end, case when count(ret) over g >= 2 then stddev_samp(ret) over g end, 0) as vol, avg(volume) over f as adv from v
window f as (partition by symbol order by ts rows between 20 preceding and 1 preceding), g as (partition by symbol order by ts rows between unbounded preceding and 1 preceding))
select strftime(ts, '%Y-%m-%d') as day, symbol, round(coalesce(case when adv > 0 then abs(trade) * vol * sqrt(abs(trade) * 1e6 / price / adv) else 0 end, 0), 6) + 0.0 as impact from u""")
def impact_sqrt(spark, sf_dir):
    s = execution.simulate(weighted(bars(spark, sf_dir)), ["symbol"], execution.CostModel((execution.square_root_impact(),)))
    return s.select(day(), "symbol", r6(F.col("cost_impact")).alias("impact"))


@query(f"{NET} select strftime(ts, '%Y-%m-%d') as day, round(sum(gross), 6) + 0.0 as gross, round(sum(cost), 9) as cost, round(sum(net), 6) + 0.0 as net, sum(abs(trade)) as turnover from n group by ts")
def portfolio_net(spark, sf_dir):
    p = execution.portfolio(execution.simulate(weighted(bars(spark, sf_dir)), ["symbol"], COSTS))
    return p.select(day(), r6(F.col("gross")).alias("gross"), F.round("cost", 9).alias("cost"), r6(F.col("net")).alias("net"), "turnover")


@query(f"{sim_sql(1)}, p as (select ts, sum(abs(trade)) as g, abs(sum(trade)) as n from sim group by ts) select year(ts)::integer as year, sum(g) as gross_turnover, sum(n) as net_turnover, count_if(g > 0) as trading_bars from p group by 1")
def turnover_by_year(spark, sf_dir):
    return execution.turnover_by_year(execution.simulate(weighted(bars(spark, sf_dir)), ["symbol"]))


@query("""with t as (select (epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 1e6 as s from lineitem join orders on l_orderkey = o_orderkey)
select count(s) as n_trades, count_if(s = 0) as n_instant, count_if(s < 0) as n_before_signal, min(s) as min_seconds, quantile_cont(s, 0.5) as median_seconds, max(s) as max_seconds from t""")
def timing_report(spark, sf_dir):
    return execution.timing(ledger(spark, sf_dir))


@query(f"""{NET}, s as (select sum(gross) as g, -sum(commission) as c, -sum(spread) as p, -sum(slippage) as l, sum(net) as n, count(distinct ts) as k from n)
select component, round(total, 6) + 0.0 as total, round(total / k * 252, 6) + 0.0 as annual from (select 'gross' as component, g as total, k from s union all select 'commission', c, k from s union all select 'spread', p, k from s union all select 'slippage', l, k from s union all select 'net', n, k from s)""")
def attribution(spark, sf_dir):
    s = execution.simulate(weighted(bars(spark, sf_dir)), ["symbol"], COSTS)
    return execution.attribution(execution.portfolio(s), s).select("component", r6(F.col("total")).alias("total"), r6(F.col("annual")).alias("annual"))


def _sharpe_sql(rows: str, key: str, value: str) -> str:
    return f"select {key}, count(*) as n, round(avg({value}) * count(*), 6) + 0.0 as total, round(avg({value}) / nullif(stddev_samp({value}), 0) * sqrt(252), 6) + 0.0 as sharpe from ({rows}) group by {key}"


def _sharpe_out(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, "n", r6(F.col("total")).alias("total"), r6(F.col("sharpe")).alias("sharpe"))


_LAGS = " union all ".join(f"select 'lag_{k}' as scenario, v from ({sim_sql(k)} select sum(gross) as v from sim group by ts)" for k in (0, 1, 2, 5))


@query(_sharpe_sql(f"{_LAGS} union all select 'next_open' as scenario, v from ({sim_sql(1, 'next_open')} select sum(gross) as v from sim group by ts)", "scenario", "v"))
def lag_sensitivity(spark, sf_dir):
    b = weighted(bars(spark, sf_dir))
    return _sharpe_out(execution.scenario_table(b, {f"lag_{k}": {"lag": k} for k in (0, 1, 2, 5)} | {"next_open": {"fill": "next_open"}}), "scenario")


@query(_sharpe_sql(" union all ".join(f"select 'x{m}' as scenario, v from ({NET} select sum(gross - {m} * cost) as v from n group by ts)" for m in (0, 1, 2, 4)), "scenario", "v"))
def cost_sensitivity(spark, sf_dir):
    b = weighted(bars(spark, sf_dir))
    return _sharpe_out(execution.scenario_table(b, {f"x{m}": {"costs": COSTS.scaled(m)} for m in (0, 1, 2, 4)}), "scenario")


# ---- statistics


@query(_sharpe_sql(f"{RET} select symbol, ret from r where ret is not null", "symbol", "ret"))
def sharpe_by_symbol(spark, sf_dir):
    w = Window.partitionBy("symbol").orderBy("timestamp")
    return _sharpe_out(moments.sharpe_by(bars(spark, sf_dir).withColumn("ret", wn.pct_change(F.col("close"), w)), "ret", ["symbol"]), "symbol")


M = f"""{IDX}, a as (select count(ret) as n, avg(ret) as m, stddev_samp(ret) as sd, stddev_pop(ret) as sp from x),
mo as (select max(a.n) as n, max(a.m) as mean, max(a.sd) as std, avg((ret - a.m) ** 3) / max(a.sp) ** 3 as skew, avg((ret - a.m) ** 4) / max(a.sp) ** 4 as kurt, max(a.m) / max(a.sd) as sharpe from x, a where ret is not null),
se as (select *, sqrt((1 - skew * sharpe + (kurt - 1) / 4 * sharpe * sharpe) / (n - 1)) as sharpe_se from mo)"""


@query(f"{M} select n, round(mean, 6) as mean, round(std, 6) as std, round(skew, 6) as skew, round(kurt, 6) as kurt from mo")
def moments_index(spark, sf_dir):
    return moments.moments_by(index_returns(spark, sf_dir), "ret", []).select("n", *[F.round(c, 6).alias(c) for c in ("mean", "std", "skew", "kurt")])


@query(f"{M} select n, round(sharpe, 6) as sharpe, round(sharpe_se, 6) as sharpe_se from se")
def sharpe_se(spark, sf_dir):
    return moments.sharpe_error(moments.moments_by(index_returns(spark, sf_dir), "ret", [])).select("n", *[F.round(c, 6).alias(c) for c in ("sharpe", "sharpe_se")])


@query(f"{M} select n, round((sharpe - 0.02) / sharpe_se, 6) as psr_z from se")
def psr_z(spark, sf_dir):
    return moments.psr_z(moments.moments_by(index_returns(spark, sf_dir), "ret", []), 0.02).select("n", F.round("psr_z", 6).alias("psr_z"))


@query(f"{IDX} select round(product(1 + ret) ** (252.0 / count(ret)) - 1, 6) as cagr from x where ret is not null")
def cagr(spark, sf_dir):
    return moments.growth_by(index_returns(spark, sf_dir), "ret", []).select(F.round("cagr", 6).alias("cagr"))


@query(f"{TRIALS}, e as (select trial, ts, product(1 + ret) over (partition by trial order by ts) as e from t), d as (select trial, e / greatest(max(e) over (partition by trial order by ts), 1) - 1 as d from e) select trial::integer as trial, round(min(d), 6) + 0.0 as max_drawdown from d group by trial")
def max_drawdown(spark, sf_dir):
    return moments.max_drawdown_by(trial_matrix(spark, sf_dir), "ret", ["trial"]).select("trial", r6(F.col("max_drawdown")).alias("max_drawdown"))


@query()
def autocorr(spark, sf_dir):
    return wn.autocorrelations(index_returns(spark, sf_dir), "ret", "timestamp", 5).select("lag", r6(F.col("rho")).alias("rho"))


_SQL["autocorr"] = f"{IDX}, y as (select ts, ret - (select avg(ret) from x) as d from x where ret is not null), z as (select {', '.join(f'sum(d * l{k}) / sum(d * d) as r{k}' for k in range(1, 6))} from (select d, {', '.join(f'lag(d, {k}) over (order by ts) as l{k}' for k in range(1, 6))} from y)) " + " union all ".join(f"select {k}::integer as lag, round(r{k}, 6) + 0.0 as rho from z" for k in range(1, 6))


@query(f"{B}, d as (select symbol, ts, ln(close) - lag(ln(close)) {W} as d from b where close > 0), l as (select symbol, ts, d, lag(d) {W} as p from d), c as (select symbol, covar_samp(d, p) as c, count(*) as n from l group by 1) select symbol, round(case when n >= 4 then case when c < 0 then 2 * sqrt(-c) else 0 end end, 6) as roll_spread from c")
def roll_spread(spark, sf_dir):
    return execution.roll_spread(bars(spark, sf_dir), ["symbol"]).select("symbol", F.round("roll_spread", 6).alias("roll_spread"))


PV = f"{TRIALS}, pv as (select trial::integer as trial, least(1.0, (trial + 1) * (trial + 1) / 400.0) as p from t group by trial)"


def _pvalues(spark, sf_dir):
    k = F.col("trial") + 1
    return trial_matrix(spark, sf_dir).groupBy("trial").count().select("trial", F.least(F.lit(1.0), k * k / 400.0).alias("p"))


@query(f"{PV}, o as (select *, row_number() over (order by p, trial) as r, count(*) over () as n from pv) select trial, round(p, 6) as p, round(least(1.0, max(p * (n - r + 1)) over (order by r)), 6) as adjusted from o")
def padjust_holm(spark, sf_dir):
    return moments.adjust_p(_pvalues(spark, sf_dir), "trial", "p", "holm").select("trial", F.round("p", 6).alias("p"), F.round("adjusted", 6).alias("adjusted"))


@query(f"{PV}, o as (select *, row_number() over (order by p, trial) as r, count(*) over () as n from pv) select trial, round(p, 6) as p, round(least(1.0, min(p * n / r) over (order by r desc)), 6) as adjusted from o")
def padjust_bh(spark, sf_dir):
    return moments.adjust_p(_pvalues(spark, sf_dir), "trial", "p", "bh").select("trial", F.round("p", 6).alias("p"), F.round("adjusted", 6).alias("adjusted"))


@query(f"{PV} select trial, round(p, 6) as p, round(least(1.0, p * count(*) over ()), 6) as adjusted from pv")
def padjust_bonferroni(spark, sf_dir):
    return moments.adjust_p(_pvalues(spark, sf_dir), "trial", "p", "bonferroni").select("trial", F.round("p", 6).alias("p"), F.round("adjusted", 6).alias("adjusted"))


# ---- cross-validation

# Labels of all orders: from the order on for as many days as its line numbers add up to, by order time.
EVENTS_SQL = """ev as (select o_orderkey as k, o_orderdate as t0, o_orderdate + to_days(sum(l_linenumber)::integer) as t1 from orders join lineitem on l_orderkey = o_orderkey group by 1, 2),
r as (select row_number() over (order by t0, t1, k) - 1 as pos, epoch_us(t0) as s, epoch_us(t1) as e from ev), nn as (select count(*) as n from r)"""


def order_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, li = load(spark, sf_dir, "orders"), load(spark, sf_dir, "lineitem")
    lines = li.groupBy("l_orderkey").agg(F.sum("l_linenumber").cast("int").alias("days"))
    return o.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", F.col("o_orderdate").alias("opened"), F.expr("o_orderdate + make_dt_interval(days)").alias("closed"))


def event_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    rows = folds.event_intervals(order_events(spark, sf_dir), "opened", "closed", "opened", "closed", "o_orderkey")
    return rows, rows.count()


def _bounds_sql(k: int) -> str:
    return f"g as (select i::integer as g, i * (n // {k}) + least(i, n % {k}) as a, (i + 1) * (n // {k}) + least(i + 1, n % {k}) as b from nn, range({k}) t(i))"


KFOLD_SQL = f"{_bounds_sql(5)}, bl as (select g as split, a, b from g)"
CPCV_SQL = f"""{_bounds_sql(6)}, cb as (select row_number() over (order by x.g, y.g) - 1 as split, x.g as i, y.g as j from g x, g y where x.g < y.g),
bl as (select split, x.a, y.b from cb join g x on x.g = i join g y on y.g = j where j = i + 1 union all select split, g.a, g.b from cb join g on g.g in (i, j) where j > i + 1)"""


def _splits_sql(blocks: str, rows: str = "0", us: int | None = None) -> str:
    """rows: SQL for the embargo in rows, with n; us: an embargo in microseconds in its place."""
    after = "f.s > hi and f.s <= hi + " + str(us) if us is not None else f"f.pos > anchor and f.pos <= anchor + {rows}"
    return f"""with {EVENTS_SQL}, {blocks}, sp as (select split, a, b, min(s) as lo, max(e) as hi from bl join r on pos >= a and pos < b group by 1, 2, 3),
an as (select split, a, b, lo, hi, greatest(b - 1, max(pos)) as anchor from sp join r on s <= hi group by 1, 2, 3, 4, 5),
x as (select split, f.pos, bool_or(f.pos >= a and f.pos < b) as test, bool_or(f.s <= hi and f.e >= lo) as purged, bool_or({after}) as emb from r f, an, nn group by 1, 2)
select split::integer as split, case when test then 'test' when purged then 'purged' when emb then 'embargo' else 'train' end as role, count(*) as n, min(pos)::bigint as first_pos, max(pos)::bigint as last_pos from x group by 1, 2"""


def _roles(df: DataFrame) -> DataFrame:
    return df.groupBy("split", "role").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))


@query(_splits_sql(KFOLD_SQL))
def purged_kfold_counts(spark, sf_dir):
    rows, n = event_rows(spark, sf_dir)
    return _roles(folds.kfold(spark, rows, n, 5))


@query(_splits_sql(KFOLD_SQL, "ceil(0.05 * n)"))
def embargo_counts(spark, sf_dir):
    rows, n = event_rows(spark, sf_dir)
    return _roles(folds.kfold(spark, rows, n, 5, 0.05))


@query(_splits_sql(KFOLD_SQL, us=20 * 86_400_000_000))
def embargo_duration(spark, sf_dir):
    rows, n = event_rows(spark, sf_dir)
    return _roles(folds.kfold(spark, rows, n, 5, "20 days"))


@query(_splits_sql(CPCV_SQL, "3"))
def cpcv_splits(spark, sf_dir):
    rows, n = event_rows(spark, sf_dir)
    return _roles(folds.combinatorial(spark, rows, n, 6, 2, 3))


@query("with c as (select row_number() over (order by a, b) - 1 as split, a, b from range(6) x(a), range(6) y(b) where a < b), p as (select split, a as grp from c union all select split, b from c) select (row_number() over (partition by grp order by split) - 1)::integer as path, grp::integer as grp, split::integer as split from p")
def cpcv_paths(spark, sf_dir):
    return folds.paths(spark, 6, 2)


# Windows over all rows of the trial matrix: half for the first training, four tests, a gap of two rows.
WF_SQL = f"""{TRIALS}, nn as (select count(distinct ts) as n from t), sz as (select n // 2 as f, (n - n // 2 - 2) // 4 as z from nn),
wf as (select i as fold, 0 as a, f + i * z as b, f + 2 + i * z as c, f + 2 + (i + 1) * z as d from sz, range(4) q(i))"""


def windows_of(trials: DataFrame) -> list[tuple[int, int, int, int, int]]:
    return folds.walk_forward(selection.finite_matrix(trials).select("timestamp").distinct().count(), 0.5, 4, 2)


@query(f"{WF_SQL} select fold::integer as fold, a::bigint as train_from, b::bigint as train_end, c::bigint as test_from, d::bigint as test_end from wf")
def wf_windows(spark, sf_dir):
    return spark.createDataFrame(windows_of(trial_matrix(spark, sf_dir)), "fold int, train_from long, train_end long, test_from long, test_end long")


WF_CHOICE = f"""{WF_SQL}, p as (select *, row_number() over (partition by trial order by ts) - 1 as p from t),
fs as (select fold, trial, avg(ret) filter (p >= a and p < b) / nullif(stddev_samp(ret) filter (p >= a and p < b), 0) as tr, avg(ret) filter (p >= c and p < d) / nullif(stddev_samp(ret) filter (p >= c and p < d), 0) as te from p, wf group by 1, 2),
fk as (select *, row_number() over (partition by fold order by tr desc nulls last, trial) as n from fs)"""


@query(f"{WF_CHOICE} select fold::integer as fold, trial::integer as trial, round(tr, 6) as train_sharpe, round(te, 6) as test_sharpe from fk where n = 1")
def wf_selection(spark, sf_dir):
    t = trial_matrix(spark, sf_dir)
    s = selection.walk_forward_selection(t, windows_of(t))
    return s.select("fold", "trial", F.round("train_sharpe", 6).alias("train_sharpe"), F.round("test_sharpe", 6).alias("test_sharpe"))


CSCV = f"""{TRIALS}, bk as (select trial, ret, ntile(6) over (partition by trial order by ts) - 1 as b from t), st as (select trial, b, count(*) as n, sum(ret) as s, sum(ret * ret) as q from bk group by 1, 2),
cm as (select row_number() over (order by i, j, k) - 1 as combo, [i, j, k] as bs from range(6) x(i), range(6) y(j), range(6) z(k) where i < j and j < k),
ag as (select combo, trial, list_contains(bs, b) as inn, sum(n) as n, sum(s) as s, sum(q) as q from st, cm group by 1, 2, 3),
sh as (select combo, trial, inn, case when (q - n * (s / n) * (s / n)) / (n - 1) > 1e-20 then s / n / sqrt((q - n * (s / n) * (s / n)) / (n - 1)) end as sr from ag),
w as (select a.combo, a.trial, a.sr as i, o.sr as o from sh a join sh o on a.combo = o.combo and a.trial = o.trial and a.inn and not o.inn),
rk as (select *, rank() over (partition by combo order by coalesce(o, '-inf'::double)) + (count(*) over (partition by combo, coalesce(o, '-inf'::double)) - 1) / 2 as r, count(*) over (partition by combo) as n, row_number() over (partition by combo order by i desc nulls last, trial) as k from w),
best as (select combo, trial, i, o, r, r / (n + 1) as w, ln(r / (n + 1) / (1 - r / (n + 1))) as logit from rk where k = 1)"""


@query(f"{CSCV} select combo::integer as combo, trial::integer as winner, round(i, 6) as is_sharpe, round(o, 6) as oos_sharpe, round(r, 6) as oos_rank, round(logit, 6) + 0.0 as logit from best")
def cscv_combos(spark, sf_dir):
    c = selection.cscv(trial_matrix(spark, sf_dir), 6)
    return c.select("combo", "winner", *[F.round(x, 6).alias(x) for x in ("is_sharpe", "oos_sharpe", "oos_rank")], r6(F.col("logit")).alias("logit"))


@query(f"{CSCV} select count(*) as n_combos, round(avg((logit <= 0)::integer), 6) as pbo, round(regr_slope(o, i), 6) as slope, round(regr_intercept(o, i), 6) as intercept, round(avg((o < 0)::integer), 6) as p_loss, round(quantile_cont(logit, 0.5), 6) + 0.0 as median_logit from best")
def cscv_pbo(spark, sf_dir):
    p = selection.pbo(selection.cscv(trial_matrix(spark, sf_dir), 6))
    return p.select("n_combos", *[F.round(c, 6).alias(c) for c in ("pbo", "slope", "intercept", "p_loss")], r6(F.col("median_logit")).alias("median_logit"))


# ---- surfaces, regimes, leakage

GRID = f"{TRIALS}, g as (select trial::integer as trial, (trial % 4)::integer as a, (trial // 4)::integer as b, avg(ret) / nullif(stddev_samp(ret), 0) as sharpe, avg(case when ts < timestamp '1995-06-01' then ret end) as early from t group by trial)"


def _grid(spark, sf_dir):
    t = trial_matrix(spark, sf_dir)
    early = F.when(F.col("timestamp") < F.lit("1995-06-01").cast("timestamp_ntz"), F.col("ret"))
    g = t.groupBy("trial").agg(F.try_divide(F.avg("ret"), F.stddev_samp("ret")).alias("sharpe"), F.avg(early).alias("early"))
    return g.withColumns({"a": (F.col("trial") % 4).cast("int"), "b": F.floor(F.col("trial") / 4).cast("int")})


@query(f"{GRID} select g.trial, round(g.sharpe, 6) as sharpe, count(o.trial) as n_near, round(avg(o.sharpe), 6) as near_mean, round(quantile_cont(o.sharpe, 0.5), 6) as near_median from g left join g o on greatest(abs(g.a - o.a), abs(g.b - o.b)) = 1 group by g.trial, g.sharpe")
def surface_neighbours(spark, sf_dir):
    n = selection.neighbours(_grid(spark, sf_dir), ["a", "b"], "sharpe")
    return n.select("trial", F.round("sharpe", 6).alias("sharpe"), "n_near", F.round("near_mean", 6).alias("near_mean"), F.round("near_median", 6).alias("near_median"))


@query(f"{GRID}, rk as (select rank() over (order by sharpe) + (count(*) over (partition by sharpe) - 1) / 2 as x, rank() over (order by early) + (count(*) over (partition by early) - 1) / 2 as y from g) select count(*) as n, round(corr(x, y), 6) as spearman from rk")
def surface_spearman(spark, sf_dir):
    return selection.spearman(_grid(spark, sf_dir), "sharpe", "early").select("n", F.round("spearman", 6).alias("spearman"))


VOL = f"""{IDX}, v as (select ts, ret, case when count(ret) over f >= 10 then stddev_samp(ret) over f end * sqrt(252) as vol from x window f as (order by ts rows between 20 preceding and 1 preceding)),
q as (select quantile_cont(vol, 1/3) as q0, quantile_cont(vol, 2/3) as q1 from v), g as (select ts, ret, case when q1 > q0 then case when vol <= q0 then 'low' when vol <= q1 then 'normal' when vol is not null then 'high' end end as regime from v, q)"""


@query(f"{VOL} select strftime(ts, '%Y-%m-%d') as day, regime from g")
def regime_vol(spark, sf_dir):
    return regimes.volatility_regimes(index_returns(spark, sf_dir), "ret", 20).select(day(), "regime")


@query(f"{IDX}, e as (select ts, product(1 + coalesce(ret, 0)) over (order by ts) as e from x), d as (select ts, e / greatest(max(e) over (order by ts), 1) - 1 as d from e), l as (select ts, lag(d) over (order by ts) as d from d) select strftime(ts, '%Y-%m-%d') as day, case when d < -0.2 then 'deep_drawdown' when d < -0.1 then 'drawdown' when d is not null then 'normal' end as regime from l")
def regime_drawdown(spark, sf_dir):
    return regimes.drawdown_regimes(index_returns(spark, sf_dir), "ret").select(day(), "regime")


@query(f"{IDX}, g as (select ts, case when count(*) over f = 26 then product(1 + coalesce(ret, 0)) over f - 1 end as g from x window f as (order by ts rows between 26 preceding and 1 preceding)) select strftime(ts, '%Y-%m-%d') as day, case when g > 0 then 'bull' when g is not null then 'bear' end as regime from g")
def regime_trend(spark, sf_dir):
    return regimes.trend_regimes(index_returns(spark, sf_dir), "ret", 26).select(day(), "regime")


@query(f"{VOL}, k as (select * from g where regime is not null and ret is not null), a as (select count(*) as n, sum(ret) as s from k) select regime, count(*) as n, round(count(*) / max(a.n), 6) as time_share, round(avg(ret) * 252, 6) as mean, round(stddev_samp(ret) * sqrt(252), 6) as vol, round(case when count(*) >= 40 then avg(ret) * 252 / (stddev_samp(ret) * sqrt(252)) end, 6) as sharpe, round(avg((ret > 0)::integer), 6) as hit_rate, round(sum(ret) / max(a.s), 6) as pnl_share from k, a group by regime")
def perf_by_regime(spark, sf_dir):
    p = regimes.performance(regimes.volatility_regimes(index_returns(spark, sf_dir), "ret", 20), "ret")
    return p.select("regime", "n", *[F.round(c, 6).alias(c) for c in ("time_share", "mean", "vol", "sharpe", "hit_rate", "pnl_share")])


FEAT = f"{IDX}, f as (select ts, ret, lag(ret, 1) over (order by ts) as back, lead(ret, 3) over (order by ts) as ahead, {', '.join(f'lead(ret, {h}) over (order by ts) as f{h}' for h in range(1, 6))} from x)"


@query(f"{FEAT} " + " union all ".join(f"select '{n}' as feature, {h}::integer as lead, round(corr({n}, f{h}), 6) + 0.0 as corr from f" for n in ("back", "ahead") for h in range(1, 6)))
def leak_future_corr(spark, sf_dir):
    w = Window.orderBy("timestamp")
    x = index_returns(spark, sf_dir).withColumns({"back": F.lag("ret", 1).over(w), "ahead": F.lead("ret", 3).over(w)})
    return leakage.feature_correlations(x, ["back", "ahead"], "ret").select("feature", "lead", r6(F.col("corr")).alias("corr"))


@query(f"{WT}, r as (select *, close / nullif(lag(close) {W}, 0) - 1 as ret from wt), n as (select weight, lead(ret) {W} as nx from r) select count(*) as n, count_if(sign(weight) = sign(nx)) as hits from n where weight <> 0 and nx <> 0")
def foresight_hits(spark, sf_dir):
    w = Window.partitionBy("symbol").orderBy("timestamp")
    return leakage.foresight(weighted(bars(spark, sf_dir)).withColumn("ret", wn.pct_change(F.col("close"), w)), ["symbol"])


def trailing_mean(b: causality.Bars) -> DataFrame:
    return b.df.select(*b.keys, "timestamp", wn.rolling_mean(F.col("close"), b.ts_window(), 5, 1, False).alias("weight"))


def next_close(b: causality.Bars) -> DataFrame:
    return b.df.select(*b.keys, "timestamp", F.lead("close").over(b.ts_window()).alias("weight"))


# What must come out: weights of the past alone never move; those of the next close move once in each symbol that has rows on both sides of the cutoff (two after it, to permute them).
CUTS = f"""{B}, c as (select ts, row_number() over (order by ts) - 1 as p, count(*) over () as n from (select distinct ts from b)),
ats as (select distinct round_even(f + (n - 2 - f) * i / 7.0, 0)::bigint as p from (select max(n) as n, greatest(1, floor(0.2 * max(n)))::bigint as f from c), range(8) q(i)),
cut as (select ts as cutoff, row_number() over (order by c.p) - 1 as k from c join ats using (p)),
sc as (select scheme, i from (values ('additive', 0), ('multiplicative', 1), ('permute', 2), ('replace', 3), ('extreme', 4)) v(scheme, i))"""


@query(f"""{CUTS} select 'trailing_mean' as strategy, (5 * k + i)::integer as trial, scheme, 0::bigint as n_changed from cut, sc
union all select 'next_close', (5 * k + i)::integer, scheme, (select count(*) from (select symbol from b group by symbol having min(ts) <= cutoff and count(*) filter (ts > cutoff) > case scheme when 'permute' then 1 else 0 end)) from cut, sc""")
def perturb_extreme_diff(spark, sf_dir):
    """A causal and a non-causal strategy under perturbed futures."""
    b = bars(spark, sf_dir)
    parts = [causality.run(s, b).select(F.lit(n).alias("strategy"), "trial", "scheme", "n_changed") for n, s in (("trailing_mean", trailing_mean), ("next_close", next_close))]
    return parts[0].unionByName(parts[1])


def _values(df: DataFrame) -> np.ndarray:
    return np.array([r[0] for r in df.where("ret is not null").orderBy("timestamp").select("ret").collect()])  # one return series


@query()
def bootstrap_ci(spark, sf_dir):
    x = _values(index_returns(spark, sf_dir))
    return resample.interval(resample.bootstrap(spark, x, resample.sharpe_rows, 1000))


@query()
def reality_check(spark, sf_dir):
    rows = trial_matrix(spark, sf_dir).groupBy("timestamp").pivot("trial", list(range(12))).agg(F.first("ret")).orderBy("timestamp").drop("timestamp").collect()
    got = resample.reality_check(spark, np.array([list(r) for r in rows]), 500)
    return spark.createDataFrame([(got["rc_p"], got["spa_p"], got["best"])], "rc_p double, spa_p double, best int")


BLOCK_SQL = f"""{IDX}, y as (select row_number() over (order by ts) as p, ret - (select avg(ret) from x) as d from x where ret is not null), nn as (select count(*) as n, greatest(5, ceil(sqrt(log10(count(*)))))::bigint as kn from y),
mm as (select n, kn, least(ceil(sqrt(n))::bigint + kn, n - 1) as far from nn), lg as (select unnest(range(0, far + 1)) as k from mm),
cv as (select k, sum(u.d * v.d) / max(n) as c from lg, mm, y u join y v on v.p + k = u.p group by k),
si as (select k, c, abs(c / (select c from cv where k = 0)) < 2 * sqrt(log10(n) / n) as quiet from cv, mm),
ru as (select k, count(*) filter (quiet) over (order by k rows between current row and 4 following) as q, count(*) over (order by k rows between current row and 4 following) as w from si),
la as (select coalesce((select min(k) from ru, mm where k >= 1 and k <= far - kn + 1 and q = 5 and w = 5), max(far)) as m from mm),
bg as (select least(2 * m, far) as g, n from la, mm),
sm as (select max(n) as n, 2 * sum(least(1.0, 2 * (1 - k / g)) * k * c) as spread, (select c from cv where k = 0) + 2 * sum(least(1.0, 2 * (1 - k / g)) * c) as level from cv, bg where k >= 1 and k <= g),
ln as (select n, pow(2 * spread * spread / (2.0 * level * level) * n, 1.0 / 3) as st, pow(2 * spread * spread / (4.0 / 3 * level * level) * n, 1.0 / 3) as ci, level from sm)"""


@query(f"{BLOCK_SQL} select 'stationary' as method, round(case when level <= 0 then 1 else least(greatest(1, st), 3 * sqrt(n), n / 3) end, 6) as length from ln union all select 'circular', round(case when level <= 0 then 1 else least(greatest(1, ci), 3 * sqrt(n), n / 3) end, 6) from ln")
def block_length(spark, sf_dir):
    x = _values(index_returns(spark, sf_dir))
    return spark.createDataFrame([(m, round(resample.block_length(x, m), 6)) for m in ("stationary", "circular")], "method string, length double")


@query()
def effective_trials(spark, sf_dir):
    return spark.createDataFrame([(selection.effective_trials(trial_matrix(spark, sf_dir)),)], "effective_trials double")


# The normal distribution by Simpson's rule on a grid of 1/1000, for the SQL side alone.
PHI = "greatest(0.0, 0.5 + (select sum(case when u = 0 or u = 2000 then 1 when u % 2 = 1 then 4 else 2 end * exp(-0.5 * ({x} * u / 2000.0) * ({x} * u / 2000.0))) from range(2001) q(u)) * ({x} / 2000.0) / 3 / sqrt(2 * pi()))"
#: Quantiles of the normal distribution at 1 - 1/12 and 1 - 1/(12 e), and Euler's constant.
HURDLE = "(1 - 0.5772156649015329) * 1.3829941271006392 + 0.5772156649015329 * 1.8712297693581532"


@query(f"{M}, h as (select *, sqrt(1.0 / (n - 1)) * ({HURDLE}) as hurdle from se), z as (select hurdle, (sharpe - hurdle) / sharpe_se as z from h) select round({PHI.format(x='z')}, 6) as dsr, round(z, 6) as z, round(hurdle, 6) as hurdle from z")
def deflated_sharpe(spark, sf_dir):
    m = moments.moments_by(index_returns(spark, sf_dir), "ret", []).first().asDict()
    d = moments.deflated_sharpe(m, 12)
    return spark.createDataFrame([(round(d["dsr"], 6), round(d["z"], 6), round(d["hurdle"], 6))], "dsr double, z double, hurdle double")


# ---- alignment, ranks and surfaces

GRID_SQL = "g as (select t.ts, s.symbol, b.close from (select distinct ts from b) t cross join (select distinct symbol from b) s left join b on b.ts = t.ts and b.symbol = s.symbol)"


@query(f"{B}, {GRID_SQL} select symbol, count(*) as n_cells, count(*) - count(close) as n_missing, round(sum(close), 2) as total from g group by symbol")
def grid_completion(spark, sf_dir):
    g = prepare.completed(bars(spark, sf_dir), "close")
    n = F.count(F.lit(1))
    return g.groupBy("symbol").agg(n.alias("n_cells"), (n - F.count("close")).alias("n_missing"), F.round(F.sum("close"), 2).alias("total"))


@query(f"{WT}, g as (select t.ts, s.symbol, wt.weight from (select distinct ts from wt) t cross join (select distinct symbol from wt) s left join wt on wt.ts = t.ts and wt.symbol = s.symbol) select strftime(ts, '%Y-%m-%d') as day, symbol, coalesce(last_value(weight ignore nulls) {W[:-1]} rows unbounded preceding), 0) as held from g")
def weights_carried(spark, sf_dir):
    w = Window.partitionBy("symbol").orderBy("timestamp")
    g = prepare.completed(weighted(bars(spark, sf_dir)), "weight")
    return g.select(day(), "symbol", F.coalesce(wn.carried(F.col("weight"), w), F.lit(0.0)).alias("held"))


@query(f"""{B}, q as (select ts, symbol, 2.0 + volume % 5 as spread_bps from b where volume % 2 = 0)
select strftime(b.ts, '%Y-%m-%d') as day, b.symbol, coalesce(last_value(q.spread_bps ignore nulls) over (partition by b.symbol order by b.ts rows unbounded preceding), 0) as spread_bps from b left join q using (ts, symbol)""")
def quotes_carried(spark, sf_dir):
    b = bars(spark, sf_dir)
    quotes = b.where("volume % 2 = 0").select("timestamp", "symbol", (F.lit(2.0) + F.col("volume") % 5).alias("spread_bps"))
    return execution.quoted_spread(b, quotes, ["symbol"]).select(day(), "symbol", "spread_bps")


@query("select l_orderkey, l_linenumber, rank() over (partition by l_orderkey order by l_quantity nulls first) + (count(*) over (partition by l_orderkey, l_quantity) - 1) / 2 as rank from lineitem")
def rank_average_ties(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", wn.average_rank(F.col("l_quantity"), "l_orderkey").alias("rank"))


@query(f"{TRIALS}, v as (select trial from t group by trial having stddev_pop(ret) > 0) select x.trial::integer as a, y.trial::integer as b, round(corr(x.ret, y.ret), 6) as corr from t x join t y on x.ts = y.ts where x.trial in (from v) and y.trial in (from v) group by x.trial, y.trial")
def trial_correlations(spark, sf_dir):
    return selection.correlation_pairs(trial_matrix(spark, sf_dir)).select("a", "b", F.round("corr", 6).alias("corr"))


@query(f"{TRIALS}, h as (select ts, trial, ret from t where not (trial = 3 and extract(month from ts) = 1)), f as (select ts from h group by ts having count(ret) = 12) select trial::integer as trial, count(*) as n, round(sum(ret), 6) + 0.0 as total from h where ts in (from f) group by trial")
def trials_complete(spark, sf_dir):
    holes = trial_matrix(spark, sf_dir).where(~((F.col("trial") == 3) & (F.month("timestamp") == 1)))
    return selection.finite_matrix(holes).groupBy("trial").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("ret")).alias("total"))


@query(f"{GRID}, n as (select g.trial, g.sharpe, max(o.sharpe) as m from g join g o on greatest(abs(g.a - o.a), abs(g.b - o.b)) = 1 group by g.trial, g.sharpe) select trial, round(sharpe, 6) as sharpe from n where sharpe >= m order by n.sharpe desc, trial limit 10")
def surface_maxima(spark, sf_dir):
    near = selection.neighbours(_grid(spark, sf_dir), ["a", "b"], "sharpe")
    return selection.local_maxima(near, "sharpe").select("trial", F.round("sharpe", 6).alias("sharpe"))


@query(f"{IDX}, e as (select ts, close / nullif(lag(close) over (order by ts), 0) - 1 as returns from i) select strftime(ts, '%Y-%m-%d') as day, round(returns, 6) + 0.0 as returns from e where returns is not null")
def returns_from_equity(spark, sf_dir):
    got = tables.equity_returns(index_bars(spark, sf_dir).withColumnRenamed("close", "equity"))
    return got.select(day(), r6(F.col("ret")).alias("returns"))


def queries() -> dict[str, Query]:
    from . import catalog_rules, catalog_tables  # they register themselves  # noqa: F401

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return {name: _counts(sql) for name, sql in _SQL.items()}
