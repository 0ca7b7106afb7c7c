"""Queries of sources, preparation, alignment, comparison and streams, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .audit import lineage
from .catalog import B, IDX, RAW, RET, WT, W, day, index_returns, query, r6, trailing_mean, weighted  # noqa: F401
from .operators import causality, leakage, prepare, quality
from .operators import windows as wn
from .operators.tables import bars, index_bars, load
from .plans import folds
from .shared import fresh_dir
from .sources import tables
from .streaming import monitor

# ---- sources


@query("select p_brand, count(*) as n, round(sum(p_retailprice), 2) as total from part group by 1")
def scan_parquet(spark, sf_dir):
    t = tables.load(spark, f"{sf_dir}/part.parquet")
    return t.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("p_retailprice"), 2).alias("total"))


@query("select n_regionkey::varchar as n_regionkey, count(*) as n, max(upper(n_name)) as last from nation group by 1")
def scan_csv(spark, sf_dir):
    """A table written as CSV with odd names and read back: names are normalised, text stays text."""
    path = fresh_dir(spark, "nation") + ".csv"
    load(spark, sf_dir, "nation").select(F.col("n_regionkey").alias(" N_RegionKey"), F.col("n_name").alias("N Name ")).write.option("header", True).csv(path)
    return tables.load(spark, path).groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("n"), F.max(F.upper("n_name")).alias("last"))


RAW_PRICES = "select o_orderkey as k, o_orderdate as ts, o_orderpriority as symbol, o_totalprice as close from orders"


def raw_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders as raw rows of text: `Date`, `Ticker`, `Adj Close`, many to a day."""
    o = load(spark, sf_dir, "orders")
    return o.select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("Date"), F.col("o_orderpriority").alias("Ticker"), F.col("o_totalprice").cast("string").alias("Adj Close"), F.col("o_orderkey").alias("key"))


@query(f"select strftime(ts, '%Y-%m-%d') as day, symbol, arg_max(close, k) as adj_close from ({RAW_PRICES}) group by 1, 2")
def prices_loaded(spark, sf_dir):
    """Detection of columns, parsing, coercion, and the last row of each day and symbol."""
    rows, _ = tables.load_prices(spark, raw_prices(spark, sf_dir), seq="key")
    return rows.select(day(), "symbol", "adj_close")


@query(f"{IDX} select strftime(ts, '%Y-%m-%d') as day, round(ret, 6) + 0.0 as ret from x where ret is not null")
def returns_loaded(spark, sf_dir):
    rows = index_returns(spark, sf_dir).select(F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("Date"), F.col("ret").alias("Strategy Returns"))
    return tables.load_returns(spark, rows).select(day(), r6(F.col("ret")).alias("ret"))


@query(f"{IDX} select strftime(ts, '%Y-%m-%d') as day, case when row_number() over (order by ts) = 1 then 0.0 else round(ret, 6) + 0.0 end as ret from x")
def benchmark_synthetic(spark, sf_dir):
    return tables.synthetic_benchmark(index_bars(spark, sf_dir)).select(day(), r6(F.col("ret")).alias("ret"))


@query(f"""{IDX}, e as (select ts, close / nullif(lag(close) over (order by ts), 0) - 1 as returns from i), l as (select count(*) as trades, count(*) filter (l_shipdate < o_orderdate) as early from lineitem join orders on l_orderkey = o_orderkey)
select count(returns) as n, round(sum(returns), 6) as total, max(trades) as trades, max(early) as early from e, l""")
def results_adapted(spark, sf_dir):
    """Another tool's export: equity under its own name, and a ledger with other names of its times."""
    o, li = load(spark, sf_dir, "orders"), load(spark, sf_dir, "lineitem")
    ledger = li.join(o, li["l_orderkey"] == o["o_orderkey"]).select(F.col("o_orderdate").alias("Decided At"), F.col("l_shipdate").alias("exec_time"))
    adapter = tables.ResultsAdapter(spark, equity_column="Value", trade_columns={"signal_time": "Decided At", "execution_time": "exec_time"})
    a = adapter.load(index_bars(spark, sf_dir).select(F.col("timestamp").alias("Date"), F.col("close").alias("Value")), ledger)
    early = a.trades.agg(F.count(F.lit(1)).alias("trades"), F.count_if(F.col("execution_time") < F.col("signal_time")).alias("early"))
    return a.returns.agg(F.count("ret").alias("n"), F.round(F.sum("ret"), 6).alias("total")).crossJoin(F.broadcast(early))  # one row each


# ---- preparation

TEXTS = """tx as (select o_orderkey as k, o_orderdate as t, o_orderkey % 7 as m, case o_orderkey % 7 when 0 then 'n/a' when 1 then strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '+02:00' when 2 then strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')
 when 3 then strftime(o_orderdate, '%Y/%m/%d') when 4 then strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || 'Z' when 5 then strftime(o_orderdate, '%m/%d/%Y') else strftime(o_orderdate, '%Y-%m-%d') end as text from orders)"""


def time_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times of orders as text in seven forms by key: bad, with offsets, plain, with slashes."""
    o, m, f = load(spark, sf_dir, "orders"), F.col("o_orderkey") % 7, lambda p: F.date_format("o_orderdate", p)
    text = F.when(m == 0, "n/a").when(m == 1, F.concat(f("yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00"))).when(m == 2, f("yyyy-MM-dd HH:mm:ss")).when(m == 3, f("yyyy/MM/dd")).when(m == 4, F.concat(f("yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))).when(m == 5, f("MM/dd/yyyy")).otherwise(f("yyyy-MM-dd"))
    return o.select("o_orderkey", text.alias("time"))


@query(f"with {TEXTS} select k, strftime(case m when 0 then null when 1 then t - interval 2 hours else t end, '%Y-%m-%d %H:%M:%S') as parsed, m in (1, 4) as aware, case m when 1 then '+02:00' when 4 then 'Z' end as zone, m = 0 as bad from tx")
def times_parsed(spark, sf_dir):
    p = prepare.parse_time(time_texts(spark, sf_dir), "time")
    return p.select(F.col("o_orderkey").alias("k"), F.date_format("_ts", "yyyy-MM-dd HH:mm:ss").alias("parsed"), F.col("_aware").alias("aware"), F.col("_offset").alias("zone"), F.col("_bad").alias("bad"))


@query(f"with {TEXTS}, s as (select *, case m when 0 then null when 1 then t - interval 2 hours else t end as p from tx), g as (select *, lag(p) over (order by k) as b from s where p is not null) select count(*) filter (m = 0) as n_bad, count(*) filter (m in (1, 4)) as n_aware, count(*) filter (m not in (0, 1, 4)) as n_naive, '+02:00,Z' as zones, (select count(*) from g where p < b) as n_backward, 'n/a' as examples, (select strftime(b, '%Y-%m-%d %H:%M:%S') || ' > ' || strftime(p, '%Y-%m-%d %H:%M:%S') from g where p < b order by k limit 1) as first_backward from s")
def dq_raw_times(spark, sf_dir):
    """Unparseable times, mixed zones, and steps back in input order with the first of them."""
    t = tables.raw_times(spark, time_texts(spark, sf_dir).repartitionByRange(1, "o_orderkey").sortWithinPartitions("o_orderkey").select("time", F.lit(1.0).alias("close")))
    first = " > ".join(t["first_backward"]) if t["first_backward"] else None
    return spark.createDataFrame([(t["n_bad"], t["n_aware"], t["n_naive"], ",".join(t["offsets"]), t["n_backward"], ",".join(t["examples"]), first)], "n_bad long, n_aware long, n_naive long, zones string, n_backward long, examples string, first_backward string")


@query("select p_brand, round(sum(p_retailprice), 2) as price, sum(p_size)::double as size, count(*) filter (p_partkey % 11 = 0) as odd from part group by 1")
def numbers_coerced(spark, sf_dir):
    """Text of which every value is a number becomes one; a column with anything else stays text."""
    p = load(spark, sf_dir, "part").select("p_brand", F.col("p_retailprice").cast("string").alias("price"), F.col("p_size").cast("string").alias("size"), F.when(F.col("p_partkey") % 11 == 0, "odd").otherwise(F.col("p_size").cast("string")).alias("mixed"))
    c = prepare.coerce_numbers(p, ("p_brand",))
    kinds = dict(c.dtypes)
    assert (kinds["price"], kinds["size"], kinds["mixed"]) == ("double", "double", "string")
    return c.groupBy("p_brand").agg(F.round(F.sum("price"), 2).alias("price"), F.sum("size").alias("size"), F.count_if(F.col("mixed") == "odd").alias("odd"))


@query(f"{B} select strftime(ts, '%Y-%m-%d') as day, round(max(close) filter (symbol = '1-URGENT'), 2) as urgent, round(max(close) filter (symbol = '5-LOW'), 2) as low from b group by ts")
def prices_wide(spark, sf_dir):
    return prepare.wide(bars(spark, sf_dir), "close").select(day(), F.round("`1-URGENT`", 2).alias("urgent"), F.round("`5-LOW`", 2).alias("low"))


@query(f"{B} select strftime(ts, '%Y-%m-%d') as day, round(close, 2) as close, volume from b where symbol = '3-MEDIUM'")
def symbol_rows(spark, sf_dir):
    return prepare.of_symbol(bars(spark, sf_dir), "3-MEDIUM").select(day(), F.round("close", 2).alias("close"), "volume")


@query(f"{B} select 'time' as what, strftime(ts, '%Y-%m-%d') as value from (select distinct ts from b) union all select 'symbol', symbol from (select distinct symbol from b)")
def calendar_and_symbols(spark, sf_dir):
    b = bars(spark, sf_dir)
    return prepare.times(b).select(F.lit("time").alias("what"), day().alias("value")).unionByName(prepare.symbols(b).select(F.lit("symbol").alias("what"), F.col("symbol").alias("value")))


@query(f"{B}, t as (select distinct ts from b), s as (select distinct symbol from b), g as (select ts, symbol, w from b join lateral (select case when volume % 3 = 0 then volume / 10.0 end as w) q on volume % 3 = 0) select strftime(t.ts, '%Y-%m-%d') as day, s.symbol, g.w as weight from t cross join s left join g using (ts, symbol)")
def signals_coerced(spark, sf_dir):
    """Signals for some rows of a panel on its whole calendar."""
    b = bars(spark, sf_dir)
    raw = b.where("volume % 3 = 0").select("timestamp", "symbol", (F.col("volume") / 10.0).alias("weight"))
    return prepare.panel_signals(raw, b).select(day(), "symbol", "weight")


@query(f"{IDX} select strftime(ts, '%Y-%m-%d') as day, case when dayofmonth(ts) > 15 then floor(close) end as weight from x")
def signal_single(spark, sf_dir):
    x = index_bars(spark, sf_dir)
    return prepare.single_signal(x.where(F.dayofmonth("timestamp") > 15).select("timestamp", "close"), x).select(day(), F.floor("weight").cast("double").alias("weight"))


@query(f"{RET} select symbol, count(ret) as n, round(sum(ret), 6) as total from r where ret is not null group by symbol")
def returns_cleaned(spark, sf_dir):
    x = bars(spark, sf_dir).withColumn("ret", wn.pct_change(F.col("close"), Window.partitionBy("symbol").orderBy("timestamp")))
    odd = x.withColumn("ret", F.coalesce("ret", F.lit(float("nan"))))
    return prepare.clean_returns(odd, "ret").groupBy("symbol").agg(F.count("ret").alias("n"), F.round(F.sum("ret"), 6).alias("total"))


@query("select l_linestatus, typeof(any_value(l_quantity)) as kind, sum(l_linenumber)::double as numbers, round(sum(l_tax), 4) as tax from lineitem group by 1")
def floats_cast(spark, sf_dir):
    li = prepare.float_cast(load(spark, sf_dir, "lineitem"))
    return li.groupBy("l_linestatus").agg(F.upper(F.first(F.typeof("l_linenumber"))).alias("kind"), F.sum("l_linenumber").alias("numbers"), F.round(F.sum("l_tax"), 4).alias("tax"))


@query(f"{IDX}, e as (select ts, row_number() over (order by ts) - 1 as p, count(*) over () as n, product(1 + coalesce(ret, 0)) over (order by ts) as e from x), ats as (select distinct round_even(i * (n - 1) / 99.0, 0)::bigint as p from (select max(n) as n from e), range(100) q(i)) select strftime(ts, '%Y-%m-%d') as day, round(e, 6) as equity from e where p in (from ats)")
def chart_points(spark, sf_dir):
    e = index_returns(spark, sf_dir).select("timestamp", wn.equity(F.col("ret"), Window.orderBy("timestamp")).alias("equity"))
    return prepare.downsampled(e, 100).select(day(), F.round("equity", 6).alias("equity"))


@query(f"{B}, i as (select ts, avg(close) as ret from b where volume % 2 = 0 group by ts), t as (select distinct ts from b) select strftime(t.ts, '%Y-%m-%d') as day, round(i.ret, 4) as ret, round(coalesce(i.ret, 0), 4) as filled from t left join i using (ts)")
def benchmark_aligned(spark, sf_dir):
    b = bars(spark, sf_dir)
    some = b.where("volume % 2 = 0").groupBy("timestamp").agg(F.avg("close").alias("ret"))
    whole = prepare.aligned(b, some, "ret").join(prepare.aligned(b, some, "ret", 0.0).withColumnRenamed("ret", "filled"), "timestamp")
    return whole.select(day(), F.round("ret", 4).alias("ret"), F.round("filled", 4).alias("filled"))


# ---- quality with examples


@query("""with d as (select o_orderdate, max(o_orderkey) as m from orders group by o_orderpriority, o_orderdate having count(*) > 1), f as (select strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') as t from d group by o_orderdate order by min(m) limit 5)
select min(t) as first, max(t) as last, count(*) as n from f""")
def dq_examples(spark, sf_dir):
    """The first five times that repeat, in the order of input."""
    o = load(spark, sf_dir, "orders").select(F.col("o_orderdate").alias("timestamp"), F.col("o_orderpriority").alias("symbol"), F.col("o_orderkey").alias("_seq"))
    found = quality.repeated(o, ["symbol"])
    return spark.createDataFrame([(min(found, default=None), max(found, default=None), len(found))], "first string, last string, n long")


@query("select string_agg(v, ',' order by a) as firsts from (select upper(substr(n_name, 1, 1)) as v, min(n_nationkey) as a from nation where n_regionkey > 0 group by 1 order by 2 limit 5)")
def dq_first_values(spark, sf_dir):
    n = load(spark, sf_dir, "nation").select(F.upper(F.substring("n_name", 1, 1)).alias("v"), F.col("n_nationkey").alias("_seq"), "n_regionkey")
    return spark.createDataFrame([(",".join(quality.examples(n, F.col("n_regionkey") > 0, "v")),)], "firsts string")


@query(f"{RET} select symbol, round(arg_max(ret, (abs(ret), ts)), 6) as worst, strftime(arg_max(ts, (abs(ret), ts)), '%Y-%m-%d') as day from r where ret is not null group by symbol")
def dq_worst_time(spark, sf_dir):
    e = quality.extreme_returns(bars(spark, sf_dir), "close", 0.5, ["symbol"])
    return e.select("symbol", r6(F.col("worst")).alias("worst"), day("worst_time"))


# ---- predicates, joins and comparison


@query(f"{WT}, f as (select min(ts) as since from wt where weight is not null) select strftime(since, '%Y-%m-%d') as since, count(*) filter (ts >= since) as n, count(*) filter (ts < since) as ahead from wt, f group by since")
def evaluation_window(spark, sf_dir):
    w = weighted(bars(spark, sf_dir))
    since = w.where("weight is not null").agg(F.min("timestamp").alias("since"))
    return w.crossJoin(F.broadcast(since)).groupBy(day("since").alias("since")).agg(F.count_if(F.col("timestamp") >= F.col("since")).alias("n"), F.count_if(F.col("timestamp") < F.col("since")).alias("ahead"))  # one row


@query(f"""{B}, v as (select ts, symbol, avg(close) over (partition by symbol order by ts rows 4 preceding) as w, volume from b), c as (select ts as cutoff from (select ts, row_number() over (order by ts) as p, count(*) over () as n from (select distinct ts from b)) where p = n // 2),
m as (select *, case when volume % 4 = 0 then w + 1 when volume % 4 = 1 then w * (1 + 1e-12) when volume % 4 = 2 then null else w end as x from v, c where ts <= cutoff)
select count(*) filter (volume % 4 in (0, 2)) as n_changed, strftime(min(ts) filter (volume % 4 in (0, 2)), '%Y-%m-%d') as first_changed, (max(case when x is null then 'infinity'::double when volume % 4 = 0 then round(abs(x - w), 6) end)) as largest from m""")
def tolerance_compare(spark, sf_dir):
    """Weights of a changed run held against the baseline, up to a cutoff: moved, within the tolerance, missing."""
    b = bars(spark, sf_dir)
    n = b.select("timestamp").distinct().count()
    cut = causality.cutoffs(b, 0.0, 0, (n // 2 - 1,))[0]
    m = F.col("volume") % 4
    base = trailing_mean(causality.Bars(b))
    new = base.join(b.select("timestamp", "symbol", "volume"), ["timestamp", "symbol"]).withColumn("weight", F.when(m == 0, F.col("weight") + 1).when(m == 1, F.col("weight") * (1 + 1e-12)).when(m == 3, F.col("weight")))
    got = causality.differences(base, new.withColumns({"trial": F.lit(0), "scheme": F.lit("x"), "cutoff": F.lit(cut)}))
    return got.select("n_changed", day("first_changed").alias("first_changed"), F.col("largest"))


@query(f"{B}, i as (select ts, avg(close) as level from b where volume > 1 group by ts) select symbol, count(*) as n, round(sum(close - level), 2) as gap from b join i using (ts) group by symbol")
def time_aligned(spark, sf_dir):
    b = bars(spark, sf_dir)
    level = b.where("volume > 1").groupBy("timestamp").agg(F.avg("close").alias("level"))
    return b.join(level, "timestamp").groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("close") - F.col("level")), 2).alias("gap"))


@query("select c_mktsegment, count(*) as n from customer where not exists (select 1 from orders where o_custkey = c_custkey) group by 1")
def anti_joined(spark, sf_dir):
    c, o = load(spark, sf_dir, "customer"), load(spark, sf_dir, "orders")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left_anti").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


@query(f"""{B}, c as (select ts, row_number() over (order by ts) as p, count(*) over () as n from (select distinct ts from b)), cut as (select ts as cutoff, row_number() over (order by ts) - 1 as k from c where p in (n // 3, 2 * n // 3)),
sc as (select unnest(['additive', 'extreme', 'multiplicative', 'permute', 'replace']) as scheme) select scheme, strftime(cutoff, '%Y-%m-%d') as cutoff, count(*) as n, count(*) filter (ts <= cutoff) as n_past, round(sum(close) filter (ts <= cutoff), 2) as past from b, cut, sc group by 1, 2""")
def perturb_rows(spark, sf_dir):
    """Every trial holds every bar, those up to the cutoff unchanged."""
    b = bars(spark, sf_dir)
    n = b.select("timestamp").distinct().count()
    cuts = causality.cutoffs(b, 0.0, 0, (n // 3 - 1, 2 * n // 3 - 1))
    table = [(i, c, s) for i, (c, s) in enumerate((c, s) for c in cuts for s in causality.SCHEMES)]
    p = causality.perturb(b, spark.createDataFrame(table, "trial int, cutoff timestamp_ntz, scheme string"))
    past = F.col("timestamp") <= F.col("cutoff")
    return p.groupBy("scheme", day("cutoff").alias("cutoff")).agg(F.count(F.lit(1)).alias("n"), F.count_if(past).alias("n_past"), F.round(F.sum(F.when(past, F.col("close"))), 2).alias("past"))


@query(f"""{B}, c as (select ts, row_number() over (order by ts) - 1 as p, count(*) over () as n from (select distinct ts from b)), ats as (select distinct round_even(f + (n - 2 - f) * i / 5.0, 0)::bigint as p from (select max(n) as n, greatest(1, floor(0.4 * max(n)))::bigint as f from c), range(6) q(i))
select strftime(ts, '%Y-%m-%d') as cutoff from c where p in (from ats)""")
def cutoff_times(spark, sf_dir):
    got = causality.cutoffs(bars(spark, sf_dir), 0.4, 6)
    return spark.createDataFrame([(t,) for t in got], "cutoff timestamp_ntz").select(day("cutoff").alias("cutoff"))


@query(f"{IDX}, t as (select ts, ret, lead(ret, 1) over (order by ts) as n1, lag(ret) over (order by ts) * 2 + 1 as twin, lag(ret) over (order by ts) as target from x) select 'ret' as feature, 0::integer as lead, round(corr(ret, target), 6) + 0.0 as corr from t union all select 'ret', 1, round(corr(ret, n1), 6) + 0.0 from t union all select 'twin', 0, 1.0 from t group by 2 union all select 'twin', 1, round(corr(twin, n1), 6) + 0.0 from t")
def leak_target(spark, sf_dir):
    """A feature that is the target in other units, beside one that is not."""
    before = F.lag("ret").over(Window.orderBy("timestamp"))
    x = index_returns(spark, sf_dir).withColumns({"twin": before * 2 + 1, "target": before})
    return leakage.feature_correlations(x, ["ret", "twin"], "ret", "target", 1).select("feature", "lead", r6(F.col("corr")).alias("corr"))


# ---- fingerprints


@query("""select count(*) as n, sum(('0x' || substr(md5(concat_ws(chr(31), o_orderkey::varchar, o_custkey::varchar, o_orderstatus, coalesce(nullif(o_orderpriority, '5-LOW'), chr(0)))), 1, 15))::bigint::hugeint)::varchar as digest from orders""")
def table_fingerprint(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")).alias("p"))
    return lineage.row_sums(o).select("n", F.col("digest").cast("string").alias("digest"))


# ---- label order and runs of positions


@query("""with e as (select o_orderkey as k, o_orderdate as a, o_orderdate + to_days(sum(l_linenumber)::integer) as z from orders join lineitem on l_orderkey = o_orderkey group by 1, 2)
select row_number() over (order by a, z, k) - 1 as pos, epoch_us(a) as start, epoch_us(z) as "end" from e""")
def event_labels(spark, sf_dir):
    from .catalog import event_rows

    return event_rows(spark, sf_dir)[0]


@query("select grp, min(p)::bigint as first, max(p)::bigint as last from (select l_returnflag as grp, o as p, o - row_number() over (partition by l_returnflag order by o) as g from (select distinct l_returnflag, l_orderkey as o from lineitem)) group by grp, g")
def position_runs(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("grp"), F.col("l_orderkey").alias("pos"))
    return folds.runs(li, "grp").select("grp", "first", "last")


# ---- streams

TICKS = "tk as (select event_type as symbol, ts, value as price, user_id as size from events)"


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"), F.col("user_id").alias("size"))


def streamed(spark: SparkSession, sf_dir: str, work) -> DataFrame:
    """What a stream over the events gives: all of them in one go, then the table it wrote."""
    raw = load(spark, sf_dir, "events")
    source = spark.readStream.schema(raw.schema).parquet(f"{sf_dir}/events*.parquet")
    made = work(source.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"), F.col("user_id").alias("size")))
    out = fresh_dir(spark, "stream")
    made.writeStream.format("parquet").option("path", out).option("checkpointLocation", fresh_dir(spark, "stream-checkpoint")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(made.schema).parquet(out)


@query(f"with {TICKS} select strftime(date_trunc('hour', ts), '%Y-%m-%d %H') as hour, symbol, arg_min(price, ts) as open, max(price) as high, min(price) as low, arg_max(price, ts) as close, sum(size)::bigint as volume, count(*) as n_ticks from tk group by 1, 2")
def stream_bars(spark, sf_dir):
    b = monitor.bars(ticks(spark, sf_dir))
    return b.select(F.date_format("timestamp", "yyyy-MM-dd HH").alias("hour"), "symbol", "open", "high", "low", "close", "volume", "n_ticks")


@query(f"with {TICKS} select strftime(date_trunc('hour', ts), '%Y-%m-%d %H') as hour, symbol, count(*) as n_ticks, count(*) filter (price is null or isnan(price)) as n_missing, count(*) filter (price <= 0) as n_nonpositive, count(*) filter (isinf(price)) as n_infinite from tk group by 1, 2")
def stream_quality(spark, sf_dir):
    q = monitor.quality(ticks(spark, sf_dir))
    return q.select(F.date_format("timestamp", "yyyy-MM-dd HH").alias("hour"), "symbol", "n_ticks", "n_missing", "n_nonpositive", "n_infinite")


@query(f"with {TICKS}, g as (select *, case when ts - lag(ts) over (partition by symbol order by ts) < interval 90 minutes then 0 else 1 end as f from tk), s as (select *, sum(f) over (partition by symbol order by ts) as k from g) select symbol, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as start, count(*) as n_ticks from s group by symbol, k")
def stream_sessions(spark, sf_dir):
    s = monitor.sessions(ticks(spark, sf_dir), "90 minutes")
    return s.select("symbol", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n_ticks")


@query(f"""with {TICKS}, o as (select symbol, ts, round(price / 20) as price from tk where price is not null), l as (select *, lag(ts) over w as pt, lag(price) over w as pp, max(price) over w as peak from o window w as (partition by symbol order by ts)),
r as (select *, sum(case when price is not distinct from pp and pt is not null then 0 else 1 end) over (partition by symbol order by ts) as run, coalesce(peak > 0 and price / nullif(peak, 0) - 1 < -0.9, false) as below from l),
p as (select *, row_number() over (partition by symbol, run order by ts) as nth, coalesce(lag(below) over (partition by symbol order by ts), false) as was from r)
select symbol, kind, count(*) as n, round(sum(v), 3) as total from (select symbol, 'gap' as kind, (epoch_us(ts) - epoch_us(pt)) / 1e6 as v from p where epoch_us(ts) - epoch_us(pt) > 7200000000
union all select symbol, 'stale', 4.0 from p where nth = 4 union all select symbol, 'drawdown', price / peak - 1 from p where below and not was) group by 1, 2""")
def stream_events(spark, sf_dir):
    """The stateful tracker, run as a stream to its end."""
    work = lambda t: monitor.track(t.withColumn("price", F.round(F.col("price") / 20)), 4, 7200.0, 0.9)
    return streamed(spark, sf_dir, work).groupBy("symbol", "kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 3).alias("total"))
