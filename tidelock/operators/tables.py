"""Views of the driver's tables in the engine's model: bars, index bars, event bars, ledgers, raw rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long OHLCV panel keyed (timestamp, symbol) from orders: open and close by least and greatest order key."""
    o = load(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_orderdate").alias("timestamp"), F.col("o_orderpriority").alias("symbol")).agg(
        F.min_by("o_totalprice", "o_orderkey").alias("open"), F.max("o_totalprice").alias("high"), F.min("o_totalprice").alias("low"),
        F.max_by("o_totalprice", "o_orderkey").alias("close"), F.count(F.lit(1)).alias("volume"),
    )


def index_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(timestamp, close): mean order price of each week; a smooth series for compounding."""
    o = load(spark, sf_dir, "orders")
    return o.groupBy(F.date_trunc("week", F.col("o_orderdate").cast("timestamp")).cast("timestamp_ntz").alias("timestamp")).agg(F.avg("o_totalprice").alias("close"))


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades: signal_time, execution_time."""
    o, li = load(spark, sf_dir, "orders"), load(spark, sf_dir, "lineitem")
    return li.join(o, li["l_orderkey"] == o["o_orderkey"]).select("l_orderkey", F.col("o_orderdate").alias("signal_time"), F.col("l_shipdate").alias("execution_time"))


def by_time(*keys: str) -> Window:
    return Window.partitionBy(*keys).orderBy("timestamp")


BARS_SQL = """
select o_orderdate as ts, o_orderpriority as symbol, arg_min(o_totalprice, o_orderkey) as open, max(o_totalprice) as high, min(o_totalprice) as low,
  arg_max(o_totalprice, o_orderkey) as close, count(*) as volume from orders group by 1, 2
"""
INDEX_SQL = "select date_trunc('week', o_orderdate) as ts, avg(o_totalprice) as close from orders group by 1"
