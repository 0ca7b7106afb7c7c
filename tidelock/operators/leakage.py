"""Leakage of targets and of the future into features and signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import normal
from . import windows as wn


def feature_correlations(df: DataFrame, features: list[str], ret: str, target: str | None = None, leads: int = 5) -> DataFrame:
    """(feature, lead, corr): correlation of each feature with the target (lead 0) and with returns 1.. rows ahead, all in one aggregate."""
    w = Window.orderBy("timestamp")
    rows = df.withColumns({f"_f{h}": F.lead(ret, h).over(w) for h in range(1, leads + 1)})
    against = ([(0, F.col(target))] if target else []) + [(h, F.col(f"_f{h}")) for h in range(1, leads + 1)]
    wide = rows.agg(*[wn.correlation(F.col(f), c, 10).alias(f"{f}|{h}") for f in features for h, c in against])
    items = F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(h).alias("lead"), F.col(f"`{f}|{h}`").alias("corr")) for f in features for h, _ in against])
    return wide.select(F.explode(items).alias("_i")).select("_i.*")


def leaking(corrs: DataFrame, limit: float = 0.98) -> DataFrame:
    """The first lead at which each feature gives the future or the target away."""
    return corrs.where(F.abs("corr") >= limit).groupBy("feature").agg(F.min("lead").alias("lead"))


def foresight(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: n and hits of sign(weight) against the sign of the next return, zeros left out, pooled over symbols."""
    w = Window.partitionBy(*keys).orderBy("timestamp")
    rows = df.withColumn("_next", F.lead("ret").over(w)).where("weight <> 0 and _next <> 0")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.signum("weight") == F.signum("_next")).alias("hits"))


def foresight_reading(n: int, hits: int, most: float = 0.75, least: int = 50) -> tuple[float | None, float | None, bool]:
    """Hit rate, two-sided p-value, and whether both are beyond chance."""
    if n < least:
        return None, None, False
    p = normal.binomial_two_sided(hits, n)
    return hits / n, p, hits / n > most and p < 1e-6
