"""Queries of costs, statistics, folds, out-of-sample evidence and surfaces, each with its SQL."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from .audit.findings import Severity, verdict
from .catalog import B, CPCV_SQL, EVENTS_SQL, GRID, HURDLE, IDX, KFOLD_SQL, NET, PHI, TRIALS, VOL, W, WF_CHOICE, WF_SQL, WT, COSTS, M, _grid, day, event_rows, index_returns, query, r6, sim_sql, trial_matrix, weighted, windows_of  # noqa: F401, I001
from .functions import moments, normal
from .operators import execution, prepare, quality, regimes, resample, selection
from .operators import windows as wn
from .operators.tables import bars, index_bars, ledger, load  # noqa: F401
from .plans import folds

# ---- costs


def _one_cost(cost):
    def run(spark, sf_dir):
        s = execution.simulate(weighted(bars(spark, sf_dir)), ["symbol"], execution.CostModel((cost,)))
        return s.select(day(), "symbol", F.round(f"cost_{cost.name}", 9).alias("cost"))

    return run


_U = f"""{sim_sql(1)}, v as (select *, close / nullif(prev, 0) - 1 as ret from sim), u as (select *, coalesce(case when count(ret) over f >= 10 then stddev_samp(ret) over f end, case when count(ret) over g >= 2 then stddev_samp(ret) over g end, 0) as vol, avg(volume) over f as adv from v
window f as (partition by symbol order by ts rows between 20 preceding and 1 preceding), g as (partition by symbol order by ts rows between unbounded preceding and 1 preceding))"""
_KINDS = {
    "cost_percentage": (execution.percentage(0.0012), "abs(trade) * 0.0012"),
    "cost_per_share": (execution.per_share(0.01, 5.0), "case when trade <> 0 then greatest(coalesce(abs(trade) * 1e6 / nullif(price, 0), 0) * 0.01, 5.0) / 1e6 else 0 end"),
    "cost_per_order": (execution.per_order(7.5), "case when trade <> 0 then 7.5 / 1e6 else 0 end"),
    "cost_tax_sell": (execution.tax(10.0, "sell"), "greatest(-trade, 0) * 10.0 / 1e4"),
    "cost_tax_buy": (execution.tax(10.0, "buy"), "greatest(trade, 0) * 10.0 / 1e4"),
    "cost_volatility": (execution.volatility_slippage(0.1), "abs(trade) * 0.1 * vol"),
    "cost_size": (execution.size_slippage(10.0), "abs(trade) * 10.0 * coalesce(case when adv > 0 then abs(trade) * 1e6 / price / adv end, 0) / 1e4"),
    "cost_custom": (execution.Cost("own", lambda: F.abs("trade") * F.when(F.col("volume") > 2, 0.001).otherwise(0.002)), "abs(trade) * case when volume > 2 then 0.001 else 0.002 end"),
}
for _name, (_cost, _sql) in _KINDS.items():
    _run = _one_cost(_cost)
    _run.__name__ = _name
    query(f"{_U} select strftime(ts, '%Y-%m-%d') as day, symbol, round({_sql}, 9) as cost from u")(_run)

# The dated fees of the reference schedule, for the SQL side.
NSE_SQL = """fees(segment, a, z, tb, ts_, ex, st) as (values ('equity_delivery', date '2024-10-01', date '9999-12-31', 0.001, 0.001, 0.0000297, 0.00015), ('equity_intraday', date '2024-10-01', date '9999-12-31', 0, 0.00025, 0.0000297, 0.00003),
('equity_futures', date '2024-10-01', date '2026-03-31', 0, 0.0002, 0.0000173, 0.00002), ('equity_futures', date '2026-04-01', date '9999-12-31', 0, 0.0005, 0.0000173, 0.00002),
('equity_options', date '2024-10-01', date '2026-03-31', 0, 0.001, 0.0003503, 0.00003), ('equity_options', date '2026-04-01', date '9999-12-31', 0, 0.0015, 0.0003503, 0.00003))"""


@query(f"with {NSE_SQL} select segment, strftime(a, '%Y-%m-%d') as valid_from, case when z < date '9999-01-01' then strftime(z, '%Y-%m-%d') end as valid_to, tb::double as tax_buy, ts_::double as tax_sell, ex::double as exchange, 1e-6 as regulator, st::double as stamp_buy, 0.18::double as indirect from fees")
def fee_schedule(spark, sf_dir):
    f = execution.NSE.schedule(spark)
    return f.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("valid_from", "valid_to")})


#: Orders lie before the schedule's first day; so many days later they lie on both sides of its change.
SHIFT_DAYS = 11_000
_CHARGE = "v * case when buy then tb + st else ts_ end + v * (ex + 1e-6) + br + 0.18 * (br + v * (ex + 1e-6))"
_TRADES = f"t as (select o_orderkey as trade_id, o_totalprice as v, o_orderkey % 2 = 0 as buy, case o_orderkey % 4 when 0 then 'equity_delivery' when 1 then 'equity_intraday' when 2 then 'equity_futures' else 'equity_options' end as segment, o_orderdate::date + {SHIFT_DAYS} as d, 20.0 as br from orders)"


@query(f"with {NSE_SQL}, {_TRADES} select trade_id, round(({_CHARGE}) - br, 6) as charge from t join fees f on f.segment = t.segment and d between a and z")
def provider_charges(spark, sf_dir):
    k = F.col("o_orderkey") % 4
    t = load(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("trade_id"), F.col("o_totalprice").alias("value"), F.when(F.col("o_orderkey") % 2 == 0, "buy").otherwise("sell").alias("side"),
        F.when(k == 0, "equity_delivery").when(k == 1, "equity_intraday").when(k == 2, "equity_futures").otherwise("equity_options").alias("segment"),
        F.date_add(F.to_date("o_orderdate"), SHIFT_DAYS).alias("day"), F.lit(20.0).alias("brokerage"),
    )
    return execution.NSE.charge(t).select("trade_id", F.round("charge", 6).alias("charge"))


@query(f"""with {NSE_SQL}, {sim_sql(1)[5:]}, z as (select sim.*, abs(trade) * 1e6 as v, trade > 0 as buy, least(abs(trade) * 1e6 * 3.0 / 1e4, 20.0) as br, ts::date + {SHIFT_DAYS} as d from sim),
j as (select z.*, tb, ts_, ex, st from z join fees f on f.segment = 'equity_futures' and d between f.a and f.z) select strftime(d, '%Y-%m-%d') as day, symbol, round(case when trade <> 0 then ({_CHARGE}) / 1e6 else 0 end, 9) as cost from j""")
def provider_component(spark, sf_dir):
    """The provider as a component of the cost model, with brokerage up to a cap, on bars moved to the schedule's days."""
    b = weighted(bars(spark, sf_dir)).withColumn("timestamp", F.expr(f"timestamp + interval {SHIFT_DAYS} days"))
    s = execution.simulate(b, ["symbol"], execution.CostModel((execution.NSE.cost("equity_futures", 3.0, 20.0),)))
    return s.select(day(), "symbol", F.round("cost_statutory", 9).alias("cost"))


@query(f"{WT}, h as (select ts, symbol, open, close, weight, coalesce(lag(weight) {W}, 0) as held from wt), o as (select *, held - coalesce(lag(held) {W}, 0) as trade from h) select strftime(ts, '%Y-%m-%d') as day, symbol, held, trade, round(held * coalesce(close / nullif(open, 0) - 1, 0), 6) + 0.0 as gross from o")
def fill_custom(spark, sf_dir):
    """A fill of one's own: in at the open, out at the close."""

    def session(rows, keys):
        w = Window.partitionBy(*keys).orderBy("timestamp")
        held = rows.withColumn("held", execution.lagged_target(1, w)).withColumn("_old", F.coalesce(execution.lagged_target(2, w), F.lit(0.0)))
        return held.withColumns({"trade": F.col("held") - F.col("_old"), "gross": F.col("held") * F.coalesce(F.try_divide(F.col("close"), F.col("open")) - 1, F.lit(0.0)), "price": F.col("open")}).drop("_old")

    s = execution.simulate(weighted(bars(spark, sf_dir)), ["symbol"], None, session)
    return s.select(day(), "symbol", "held", "trade", r6(F.col("gross")).alias("gross"))


@query(f"{sim_sql(1)}, g as (select t.ts, s.symbol, sim.held from (select distinct ts from sim) t cross join (select distinct symbol from sim) s left join sim on sim.ts = t.ts and sim.symbol = s.symbol) select strftime(ts, '%Y-%m-%d') as day, symbol, coalesce(last_value(held ignore nulls) {W[:-1]} rows unbounded preceding), 0) as held from g")
def portfolio_calendar(spark, sf_dir):
    s = execution.simulate(weighted(bars(spark, sf_dir)), ["symbol"])
    return execution.portfolio_weights(s).select(day(), "symbol", "held")


@query(f"{sim_sql(1)}, p as (select ts, sum(abs(trade)) as g, abs(sum(trade)) as n from sim group by ts) select round(sum(g), 6) as gross_turnover, round(sum(n), 6) as net_turnover, round(avg(g), 6) as mean_turnover, round(avg(g) * 252, 6) as annual_turnover, count(*) filter (g > 0) as trading_bars, round(2 / avg(g), 6) as holding_bars from p")
def turnover_stats(spark, sf_dir):
    t = execution.turnover_statistics(execution.simulate(weighted(bars(spark, sf_dir)), ["symbol"]))
    return t.select("trading_bars", *[F.round(c, 6).alias(c) for c in t.columns if c != "trading_bars"])


@query(f"""{TRIALS}, e as (select trial, ts, ret, product(1 + ret) over (partition by trial order by ts) as e from t), d as (select *, e / greatest(max(e) over (partition by trial order by ts), 1) - 1 as d from e)
select trial::integer as trial, count(*) as n, round(avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(252), 6) as sharpe, round(case when product(1 + ret) > 0 then pow(product(1 + ret), 252.0 / count(*)) - 1 else -1 end, 6) as cagr, round(min(d), 6) + 0.0 as max_drawdown, round(stddev_samp(ret) * sqrt(252), 6) as volatility, round(product(1 + ret) - 1, 6) + 0.0 as total_return from d group by trial""")
def headline_metrics(spark, sf_dir):
    h = execution.headline(trial_matrix(spark, sf_dir), "ret", ("trial",))
    return h.select("trial", "n", *[r6(F.col(c)).alias(c) for c in ("sharpe", "cagr", "max_drawdown", "volatility", "total_return")])


@query(f"{NET}, p as (select ts, sum(gross) as g, sum(cost) as c, sum(abs(trade)) as t from n group by ts), m as (select avg(g) as g, avg(c) as c, avg(t) as t from p) select round(case when g > 0 then g / t * 1e4 end, 4) as bps, round(case when g > 0 then g / c end, 6) as multiplier from m")
def break_even_cost(spark, sf_dir):
    p = execution.portfolio(execution.simulate(weighted(bars(spark, sf_dir)), ["symbol"], COSTS))
    m = p.agg(F.avg("gross").alias("g"), F.avg("turnover").alias("t"), F.avg("cost").alias("c")).first()
    be = execution.break_even(m["g"], m["t"], m["c"])
    return spark.createDataFrame([(None if be.bps is None else round(be.bps, 4), None if be.multiplier is None else round(be.multiplier, 6))], "bps double, multiplier double")


# ---- statistics


@query("select n_nationkey as rate, case when n_nationkey >= 0 then round(pow(1 + n_nationkey / 100.0, 1 / 252.0) - 1, 9) end as periodic from nation")
def risk_free_periodic(spark, sf_dir):
    rates = [r[0] for r in load(spark, sf_dir, "nation").select("n_nationkey").collect()]  # 25 rows
    return spark.createDataFrame([(k, round(moments.periodic_rate(k / 100, 252), 9)) for k in rates], "rate int, periodic double")


MOM = f"""{TRIALS}, a as (select trial, count(ret) as n, avg(ret) as m, stddev_samp(ret) as sd, stddev_pop(ret) as sp from t group by trial),
mo as (select t.trial, max(a.n) as n, max(a.m / nullif(a.sd, 0)) as sharpe, avg((ret - a.m) ** 3) / max(a.sp) ** 3 as skew, avg((ret - a.m) ** 4) / max(a.sp) ** 4 as kurt from t join a using (trial) where a.sd > 0 group by t.trial)"""


def _trial_moments(spark, sf_dir):
    return [r.asDict() for r in moments.moments_by(trial_matrix(spark, sf_dir), "ret", ["trial"]).where("sharpe is not null").collect()]  # a row a trial


@query(f"{MOM} select trial::integer as trial, round(case when sharpe > -0.05 then 1 + (1 - skew * sharpe + (kurt - 1) / 4 * sharpe * sharpe) * pow(1.6448536269514722 / (sharpe + 0.05), 2) end, 4) as needed from mo")
def track_record(spark, sf_dir):
    """Least track record of each trial against a Sharpe ratio of -0.05 a period; null where it is not above."""
    rows = [(m["trial"], moments.least_track_record(m["sharpe"], m["skew"], m["kurt"], -0.05)) for m in _trial_moments(spark, sf_dir)]
    return spark.createDataFrame([(t, None if math.isinf(x) else round(x, 4)) for t, x in rows], "trial int, needed double")


@query(f"{MOM}, z as (select *, (sharpe + 0.05) * sqrt(n - 1) / sqrt(1 - skew * sharpe + (kurt - 1) / 4 * sharpe * sharpe) as z from mo) select trial::integer as trial, round(z, 6) as z, round({PHI.format(x='z')}, 6) as psr from z")
def psr_trials(spark, sf_dir):
    rows = [(m["trial"], *moments.psr(m["sharpe"], m["n"], m["skew"], m["kurt"], -0.05)) for m in _trial_moments(spark, sf_dir)]
    return spark.createDataFrame([(t, round(z, 6), round(p, 6)) for t, p, z in rows], "trial int, z double, psr double")


@query(f"{MOM}, v as (select var_samp(sharpe) as v from mo), h as (select mo.*, sqrt(v) * ({HURDLE}) as hurdle from mo, v), z as (select *, (sharpe - hurdle) * sqrt(n - 1) / sqrt(1 - skew * sharpe + (kurt - 1) / 4 * sharpe * sharpe) as z from h) select trial::integer as trial, round(hurdle, 6) as hurdle, round({PHI.format(x='z')}, 6) as dsr from z")
def deflated_trials(spark, sf_dir):
    """Deflated Sharpe ratio of each trial, with the spread of all trials' ratios."""
    found = _trial_moments(spark, sf_dir)
    mean = sum(m["sharpe"] for m in found) / len(found)
    spread = sum((m["sharpe"] - mean) ** 2 for m in found) / (len(found) - 1)
    rows = [(m["trial"], moments.deflated_sharpe(m, 12, spread)) for m in found]
    return spark.createDataFrame([(t, round(d["hurdle"], 6), round(d["dsr"], 6)) for t, d in rows], "trial int, hurdle double, dsr double")


@query("""with g as (select i / 1000.0 - 9 as x from range(18001) q(i)), f as (select x, exp(-x * x / 2) / sqrt(2 * pi()) as f from g), c as (select x, f, (sum(f) over (order by x) - f / 2) / 1000.0 as c from f),
k(n) as (values (2), (3), (10), (100)) select n::integer as n, round(sum(x * n * f * pow(c, n - 1)) / 1000.0, 5) as expected from k, c group by n""")
def expected_maxima(spark, sf_dir):
    """Expected maximum of n normals, against a plain sum over a grid."""
    return spark.createDataFrame([(n, round(normal.expected_max(n), 5)) for n in (2, 3, 10, 100)], "n int, expected double")


@query(f"select i::integer as i, round({PHI.format(x='(i / 4.0 - 3)')}, 9) as cdf from range(25) t(i)")
def normal_cdf(spark, sf_dir):
    return spark.createDataFrame([(i, round(normal.cdf(i / 4 - 3), 9)) for i in range(25)], "i int, cdf double")


@query("select n_nationkey as k, round(least(1.0, 2 * (select sum(exp(lgamma(61) - lgamma(i + 1) - lgamma(61 - i) - 60 * ln(2))) from range(61) q(i) where i <= least(20 + n_nationkey, 40 - n_nationkey))), 9) as p from nation where n_nationkey < 20")
def binomial_p(spark, sf_dir):
    """Two-sided p-values of 20 + k hits of 60."""
    ks = sorted(r[0] for r in load(spark, sf_dir, "nation").where("n_nationkey < 20").select("n_nationkey").collect())
    return spark.createDataFrame([(k, round(normal.binomial_two_sided(20 + k, 60), 9)) for k in ks], "k int, p double")


@query(f"""{IDX}, y as (select ts, ret, ret - (select avg(ret) from x) as d from x where ret is not null), z as (select sum(d * lag1) / sum(d * d) as r1, sum(d * lag2) / sum(d * d) as r2, sum(d * lag3) / sum(d * d) as r3, avg(ret) / stddev_samp(ret) as s from (select *, lag(d, 1) over (order by ts) as lag1, lag(d, 2) over (order by ts) as lag2, lag(d, 3) over (order by ts) as lag3 from y))
select round(case when 4 + 2 * (3 * r1 + 2 * r2 + r3) > 0 then s * 4 / sqrt(4 + 2 * (3 * r1 + 2 * r2 + r3)) end, 6) as adjusted from z""")
def sharpe_adjusted(spark, sf_dir):
    """Sharpe ratio of four periods under autocorrelation."""
    x = index_returns(spark, sf_dir)
    rho = [r["rho"] for r in wn.autocorrelations(x, "ret", "timestamp", 3).orderBy("lag").collect()]
    s = moments.moments_by(x, "ret", []).first()["sharpe"]
    got = moments.adjusted_sharpe(s, rho, 4)
    return spark.createDataFrame([(None if got != got else round(got, 6),)], "adjusted double")


@query(f"{TRIALS}, sv as (select trial, avg(ret) / nullif(stddev_samp(ret), 0) as value from t group by trial) select round(quantile_cont(value, 0.025), 6) as low, round(quantile_cont(value, 0.975), 6) as high, round(stddev_samp(value), 6) as se, round(avg((value <= 0)::integer), 6) as p_below, count(value) as n from sv where value is not null")
def interval_of_values(spark, sf_dir):
    """What becomes of bootstrap values: here the trials' Sharpe ratios stand for them."""
    v = trial_matrix(spark, sf_dir).groupBy("trial").agg(F.try_divide(F.avg("ret"), F.stddev_samp("ret")).alias("value"))
    return resample.interval(v).select("n", *[F.round(c, 6).alias(c) for c in ("low", "high", "se", "p_below")])


@query(f"{TRIALS}, h as (select * from t where not (trial = 5 and extract(month from ts) = 3)), n as (select count(distinct ts) as n from h) select trial::integer as trial, case when count(ret) = max(n.n) then round(avg(ret) / nullif(stddev_samp(ret), 0), 6) end as sharpe from h, n group by trial")
def sharpe_columns(spark, sf_dir):
    """Sharpe ratio of each column of a matrix, none where the column has a hole."""
    t = trial_matrix(spark, sf_dir).where(~((F.col("trial") == 5) & (F.month("timestamp") == 3)))
    return selection.column_sharpes(t).select("trial", F.round("sharpe", 6).alias("sharpe"))


# ---- folds and out-of-sample evidence


@query("select n_nationkey as n, (n_nationkey + 20 - round_even(0.25 * (n_nationkey + 20), 0) - 2)::integer as train_end, (n_nationkey + 20 - round_even(0.25 * (n_nationkey + 20), 0))::integer as test_from from nation")
def chronological_split(spark, sf_dir):
    ns = sorted(r[0] for r in load(spark, sf_dir, "nation").select("n_nationkey").collect())  # 25 rows
    return spark.createDataFrame([(n, *folds.chronological(n + 20, 0.25, 2)) for n in ns], "n int, train_end int, test_from int")


@query(f"""with {EVENTS_SQL}, {KFOLD_SQL}, nv as (select split, f.pos, f.s, f.e, f.pos >= a and f.pos < b as test from r f, bl), sp as (select split, min(s) as lo, max(e) as hi from nv where test group by 1)
select split::integer as split, count(*) as n from nv join sp using (split) where not test and s <= hi and e >= lo group by 1""")
def leaks_unpurged(spark, sf_dir):
    """Training rows whose label touches a test block, in plain folds without purge."""
    rows, n = event_rows(spark, sf_dir)
    table = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(folds.fold_bounds(n, 5))], "split int, a long, b long")
    plain = rows.crossJoin(F.broadcast(table)).select("split", "pos", F.when((F.col("pos") >= F.col("a")) & (F.col("pos") < F.col("b")), "test").otherwise("train").alias("role"))  # five splits
    return folds.leaks(plain, rows).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {EVENTS_SQL}, {KFOLD_SQL} select g.g as split, 0::bigint as n from g")
def leaks_purged(spark, sf_dir):
    """The same after the purge: none."""
    rows, n = event_rows(spark, sf_dir)
    found = folds.leaks(folds.require_training(folds.kfold(spark, rows, n, 5)), rows).groupBy("split").agg(F.count(F.lit(1)).alias("n"))
    return spark.range(5).select(F.col("id").cast("int").alias("split")).join(found, "split", "left").select("split", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query("with d(t, us) as (values ('5D', 5 * 86400000000), ('36 hours', 36 * 3600000000), ('90min', 5400000000), ('1 days 02:00:00', 26 * 3600000000), ('250 ms', 250000)) select t as text, us::bigint as us, case when us >= 86400000000 then (us // 86400000000)::varchar || case when us // 86400000000 = 1 then ' day ' else ' days ' end else '' end || lpad((us % 86400000000 // 3600000000)::varchar, 2, '0') || ':' || lpad((us % 3600000000 // 60000000)::varchar, 2, '0') || ':' || lpad((us % 60000000 // 1000000)::varchar, 2, '0') || case when us % 1000000 > 0 then '.' || rtrim(lpad((us % 1000000)::varchar, 6, '0'), '0') else '' end as written from d")
def durations(spark, sf_dir):
    return spark.createDataFrame([(t, u := folds.duration_us(t), folds.format_seconds(u / 1e6)) for t in ("5D", "36 hours", "90min", "1 days 02:00:00", "250 ms")], "text string, us long, written string")


@query(f"""{WF_CHOICE}, o as (select wf.fold, p.ts, p.ret from fk join wf using (fold) join p on p.trial = fk.trial and p.p >= wf.c and p.p < wf.d where fk.n = 1) select fold::integer as fold, strftime(ts, '%Y-%m-%d') as day, round(ret, 6) + 0.0 as ret from o""")
def wf_returns(spark, sf_dir):
    t = trial_matrix(spark, sf_dir)
    return selection.walk_forward_returns(t, windows_of(t)).select("fold", day(), r6(F.col("ret")).alias("ret"))


@query(f"""{WF_SQL}, y as (select ret, row_number() over (order by ts) - 1 as p from t where trial = 3) select fold::integer as fold, count(ret) as n, round(avg(ret) / nullif(stddev_samp(ret), 0), 6) as test_sharpe from y, wf where p >= c and p < d group by fold""")
def wf_single(spark, sf_dir):
    t = trial_matrix(spark, sf_dir)
    s = selection.walk_forward_single(t.where("trial = 3").select("timestamp", "ret"), windows_of(t))
    return s.select("fold", "n", F.round("test_sharpe", 6).alias("test_sharpe"))


@query(f"""{WF_CHOICE}, o as (select p.ret from fk join wf using (fold) join p on p.trial = fk.trial and p.p >= wf.c and p.p < wf.d where fk.n = 1), so as (select count(*) as n, avg(ret) / stddev_samp(ret) * sqrt(252) as sr from o),
f as (select count(*) as folds, count(*) filter (te > 0) as up, quantile_cont(te, 0.5) * sqrt(252) as med, stddev_samp(te) * sqrt(252) as dev, avg(tr) * sqrt(252) as ism from fk where n = 1)
select so.n::bigint as n, round(sr, 4) as oos_sharpe, folds::bigint as folds, up::bigint as positive_folds, round(med, 4) as median, round(dev, 4) as deviation, round(case when ism > 0 then sr / ism end, 4) as kept,
((sr <= 0)::integer + (2 * up < folds)::integer + coalesce((ism > 0 and sr / ism > 0 and sr / ism < 0.5)::integer, 0) + (so.n < 60)::integer)::bigint as n_weak from so, f""")
def oos_evidence(spark, sf_dir):
    t, root = trial_matrix(spark, sf_dir), math.sqrt(252)
    table = windows_of(t)
    each = selection.walk_forward_selection(t, table).collect()
    total = moments.sharpe_by(selection.walk_forward_returns(t, table).withColumn("k", F.lit(0)), "ret", ["k"]).first()
    trained = [r["train_sharpe"] for r in each if r["train_sharpe"] is not None]
    e = selection.oos_evidence([None if r["test_sharpe"] is None else r["test_sharpe"] * root for r in each], total["sharpe"], total["n"], sum(trained) / len(trained) * root)
    rounded = lambda x: None if x is None else round(x, 4)
    return spark.createDataFrame([(e["n"], rounded(e["oos_sharpe"]), e["folds"], e["positive_folds"], rounded(e["median"]), rounded(e["deviation"]), rounded(e["kept"]), len(e["weak"]))], "n long, oos_sharpe double, folds long, positive_folds long, median double, deviation double, kept double, n_weak long")


_PATHS = f"""{TRIALS}, p as (select *, row_number() over (partition by trial order by ts) - 1 as pos from t), nn as (select max(pos) + 1 as n from p), g as (select i::integer as g, i * (n // 6) + least(i, n % 6) as a, (i + 1) * (n // 6) + least(i + 1, n % 6) as b from nn, range(6) q(i)),
cb as (select row_number() over (order by x.g, y.g) - 1 as split, x.g as i, y.g as j from g x, g y where x.g < y.g), pg as (select p.*, g.g from p join g on pos >= a and pos < b),
emb as (select split, max(case when j = i + 1 then null else x.b end) as e1, max(y.b) as e2 from cb join g x on x.g = i join g y on y.g = j group by split),
ro as (select cb.split, pg.*, case when pg.g in (i, j) then 'test' when (pos >= e1 and pos < e1 + 2) or (pos >= e2 and pos < e2 + 2) then 'embargo' else 'train' end as role from cb join emb using (split), pg),
fs as (select split, trial, avg(ret) filter (role = 'train') / nullif(stddev_samp(ret) filter (role = 'train'), 0) as tr from ro group by 1, 2), w as (select split, trial from (select *, row_number() over (partition by split order by tr desc nulls last, trial) as n from fs) where n = 1),
sg as (select split, i as grp from cb union select split, j from cb), pt as (select split, grp, row_number() over (partition by grp order by split) - 1 as path from sg),
pr as (select path, ro.pos, ro.ret from pt join w using (split) join ro on ro.split = pt.split and ro.g = pt.grp and ro.trial = w.trial)"""


def _path_returns(spark, sf_dir):
    t = trial_matrix(spark, sf_dir)
    n = t.select("timestamp").distinct().count()
    splits = folds.combinatorial(spark, folds.intervals(spark, n), n, 6, 2, 2)
    return selection.path_returns(t, splits, n, 6, 2)


@query(f"{_PATHS} select path::integer as path, pos::bigint as pos, round(ret, 6) + 0.0 as value from pr")
def paths_assembled(spark, sf_dir):
    return _path_returns(spark, sf_dir).select("path", "pos", r6(F.col("value")).alias("value"))


@query(f"{_PATHS} select path::integer as path, count(ret) as n, round(avg(ret) / nullif(stddev_samp(ret), 0), 6) as sharpe from pr group by path")
def path_sharpes(spark, sf_dir):
    return selection.path_sharpes(_path_returns(spark, sf_dir)).select("path", "n", F.round("sharpe", 6).alias("sharpe"))


# ---- surfaces, regimes and severities


@query(f"""{GRID}, nb as (select g.trial, g.sharpe, g.early, g.a, g.b, count(o.trial) as n_near, quantile_cont(o.sharpe, 0.5) as med, avg(o.sharpe) as mean, max(o.sharpe) as mx from g left join g o on greatest(abs(g.a - o.a), abs(g.b - o.b)) = 1 group by all),
al as (select count(*) as n, stddev_pop(sharpe) as sd, max(sharpe) as best, quantile_cont(early, 0.5) as em from g), be as (select * from nb order by sharpe desc, trial limit 1)
select al.n, be.trial as best_trial, round(be.sharpe, 6) as value, be.n_near, round(med, 6) as near_median, round(mean, 6) as near_mean, round(case when be.sharpe > 0 then med / be.sharpe end, 6) as plateau, round((be.sharpe - mean) / nullif(sd, 0), 6) as spike,
case when not be.sharpe > 0 then 'undetermined' when med / be.sharpe >= 0.7 then 'robust' when med / be.sharpe < 0.4 then 'fragile' else 'moderate' end as reading,
round(case when best > 0 then (select avg((g.sharpe >= 0.5 * al.best)::integer) from g) end, 6) as share_above_half, (select count(*) from nb where sharpe >= mx and n_near > 0) as n_maxima, round(be.early, 6) as oos_at_best, round(em, 6) as oos_median from al, be""")
def surface_analysis(spark, sf_dir):
    s = selection.surface(_grid(spark, sf_dir), ["a", "b"], "sharpe", "early")
    rounded = lambda x: None if x is None or x != x else round(x, 6)
    row = (s["n"], s["best_trial"], rounded(s["value"]), s["n_near"], *[rounded(s[k]) for k in ("near_median", "near_mean", "plateau", "spike")], s["reading"], rounded(s["share_above_half"]), len(s["maxima"]), rounded(s["oos_at_best"]), rounded(s["oos_median"]))
    return spark.createDataFrame([row], "n long, best_trial int, value double, n_near long, near_median double, near_mean double, plateau double, spike double, reading string, share_above_half double, n_maxima long, oos_at_best double, oos_median double")


@query(f"{GRID} select b as row, round(avg(sharpe) filter (a = 0), 6) as a0, round(avg(sharpe) filter (a = 1), 6) as a1, round(avg(sharpe) filter (a = 2), 6) as a2, round(avg(sharpe) filter (a = 3), 6) as a3 from g where trial < 11 group by b")
def surface_slice(spark, sf_dir):
    cells = selection.surface_slice(_grid(spark, sf_dir).where("trial < 11"), "a", "b", "sharpe", {})
    return cells.select(F.col("b").alias("row"), *[F.round(F.col(str(k)), 6).alias(f"a{k}") for k in range(4)])


@query(f"{GRID}, sp as (select corr(x, y) as rho from (select rank() over (order by sharpe) + (count(*) over (partition by sharpe) - 1) / 2 as x, rank() over (order by early) + (count(*) over (partition by early) - 1) / 2 as y from g)) select 'SENS-002' as rule, case when rho < 0 then 'WARN' else 'PASS' end as severity from sp")
def ranks_verdict(spark, sf_dir):
    rho = selection.spearman(_grid(spark, sf_dir), "sharpe", "early").first()["spearman"]
    return spark.createDataFrame([("SENS-002", "WARN" if rho < 0 else "PASS")], "rule string, severity string")


@query(f"{VOL}, k as (select regime, avg(ret) * 252 / (stddev_samp(ret) * sqrt(252)) as sr, count(*) as n from g where regime is not null and ret is not null group by 1), o as (select avg(ret) / stddev_samp(ret) as sr from x) select case when o.sr > 0 and (select count(*) from k where n >= 40 and sr < 0) > 0 then 'WARN' when o.sr > 0 then 'PASS' else 'INFO' end as severity, (select count(*) from k where n >= 40 and sr < 0) as n_bad from o")
def regime_verdict(spark, sf_dir):
    x = index_returns(spark, sf_dir)
    rows = regimes.performance(regimes.volatility_regimes(x, "ret", 20), "ret").collect()
    overall = moments.sharpe_by(x.where("ret is not null").withColumn("k", F.lit(0)), "ret", ["k"]).first()["sharpe"]
    bad = sum(r["sharpe"] is not None and r["sharpe"] < 0 for r in rows)
    return spark.createDataFrame([("WARN" if bad and overall > 0 else "PASS" if overall > 0 else "INFO", bad)], "severity string, n_bad long")


_FOUND = """f as (select symbol, rule, severity from (select o_orderpriority as symbol, 'DATA-004' as rule, case when count(*) > count(distinct o_orderdate) then 2 else 0 end as severity from orders group by 1
union all select o_orderpriority, 'DATA-007', case when count(*) filter (o_totalprice <= 0) > 0 then 3 else 0 end from orders group by 1 union all select o_orderpriority, 'DATA-013', case when max(o_totalprice) > 50 * min(o_totalprice) then 1 else 0 end from orders group by 1))"""


@query(f"with {_FOUND}, m as (select rule, max(severity) as s, string_agg(symbol, ',' order by symbol) filter (severity > 0) as symbols from f group by rule) select rule, case s when 0 then 'PASS' when 1 then 'INFO' when 2 then 'WARN' else 'FAIL' end as severity, coalesce(symbols, '') as symbols, (select case max(s) when 3 then 'FAIL' when 2 then 'WARN' else 'PASS' end from m) as verdict from m")
def severities_merged(spark, sf_dir):
    """Severities of each symbol merged to the worst of each rule, and the verdict of all."""
    from .audit.findings import Finding

    o = load(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "symbol")
    wide = o.groupBy("symbol").agg(
        F.when(F.count(F.lit(1)) > F.count_distinct("o_orderdate"), 2).otherwise(0).alias("DATA-004"), F.when(F.count_if(F.col("o_totalprice") <= 0) > 0, 3).otherwise(0).alias("DATA-007"),
        F.when(F.max("o_totalprice") > 50 * F.min("o_totalprice"), 1).otherwise(0).alias("DATA-013"),
    )
    rules = ("DATA-004", "DATA-007", "DATA-013")
    long = wide.select("symbol", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"`{r}`").alias("s")) for r in rules])).alias("_x")).select("symbol", "_x.*")
    merged = long.groupBy("rule").agg(F.max("s").alias("s"), F.array_join(F.slice(F.sort_array(F.collect_list(F.when(F.col("s") > 0, F.col("symbol")))), 1, 5), ",").alias("symbols")).collect()  # a row a rule
    found = [Finding(r["rule"], Severity(r["s"]), "") for r in merged]
    return spark.createDataFrame([(r["rule"], Severity(r["s"]).name, r["symbols"], verdict(found)) for r in merged], "rule string, severity string, symbols string, verdict string")
