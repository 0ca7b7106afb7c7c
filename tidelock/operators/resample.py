"""Bootstraps, automatic block length, and data-snooping tests. A replicate is a unit of work; draws are seeded by replicate, not by partition."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

METHODS = ("iid", "circular", "moving", "stationary")


def indices(n: int, rng: np.random.Generator, method: str, block: float) -> np.ndarray:
    if method == "iid":
        return rng.integers(0, n, n)
    if method == "stationary":
        fresh = rng.random(n) < 1 / max(1.0, block)
        fresh[0] = True
        starts, at = rng.integers(0, n, n), np.arange(n)
        last = np.maximum.accumulate(np.where(fresh, at, 0))
        return (starts[last] + at - last) % n
    size = max(1, min(n, round(block)))
    k = -(-n // size)
    first = rng.integers(0, n if method == "circular" else n - size + 1, k)
    out = (first[:, None] + np.arange(size)).ravel()[:n]
    return out % n


def block_length(x: np.ndarray, method: str = "stationary") -> float:
    """Automatic block length after Politis and White with the 2009 correction, between 1 and the lesser of 3 sqrt(n) and n / 3."""
    n = len(x)
    eps = x - x.mean() if n else x
    if n < 8 or not float(eps @ eps) > 0:
        return 1.0
    quiet = max(5, math.ceil(math.sqrt(math.log10(n))))  # so many lags in a row without correlation end the dependence
    far = min(math.ceil(math.sqrt(n)) + quiet, n - 1)
    cov = np.array([float(eps[k:] @ eps[: n - k]) for k in range(far + 1)]) / n
    silent = np.abs(cov / cov[0]) < 2 * math.sqrt(math.log10(n) / n)
    last = next((m for m in range(1, far - quiet + 2) if silent[m : m + quiet].all()), far)
    lags = np.arange(1, min(2 * last, far) + 1)
    taper = np.minimum(1.0, 2 * (1 - lags / lags[-1]))  # flat to the middle, then a straight line to 0
    spread, level = 2 * float((taper * lags * cov[lags]).sum()), float(cov[0] + 2 * (taper * cov[lags]).sum())
    if level <= 0 or spread == 0:
        return 1.0
    best = (2 * spread**2 / ((2 if method == "stationary" else 4 / 3) * level**2) * n) ** (1 / 3)
    return float(min(max(1.0, best), 3 * math.sqrt(n), n / 3))


def sharpe_rows(m: np.ndarray) -> np.ndarray:
    sd = m.std(axis=-1, ddof=1)
    with np.errstate(all="ignore"):
        return np.where(sd > 1e-14 * np.abs(m).max(axis=-1), m.mean(axis=-1) / sd, np.nan)


def bootstrap(spark: SparkSession, x: np.ndarray, statistic, replicates: int = 1000, method: str = "stationary", block: float | None = None, seed: int = 42) -> DataFrame:
    """(rep, value): statistic of each replicate. statistic takes a matrix of rows and gives a value for each; the series has the size of one return series."""
    block = block_length(x, method) if block is None else block

    def work(frames):
        for f in frames:
            rows = np.stack([x[indices(len(x), np.random.default_rng([seed, int(r)]), method, block)] for r in f["id"]]) if len(f) else np.zeros((0, len(x)))
            yield pd.DataFrame({"rep": f["id"], "value": np.asarray(statistic(rows), float)})

    parts = max(1, min(replicates // 64 + 1, spark.sparkContext.defaultParallelism))
    return spark.range(0, replicates, 1, parts).mapInPandas(work, "rep long, value double")


def interval(values: DataFrame, confidence: float = 0.95) -> DataFrame:
    """One row: low, high, se, p_below (share of 0 or less), n of finite replicates."""
    a = (1 - confidence) / 2
    rows = values.where(~F.isnan("value") & F.col("value").isNotNull())
    return rows.agg(F.expr(f"percentile(value, {a})").alias("low"), F.expr(f"percentile(value, {1 - a})").alias("high"), F.stddev_samp("value").alias("se"), F.avg((F.col("value") <= 0).cast("double")).alias("p_below"), F.count(F.lit(1)).alias("n"))


def reality_check(spark: SparkSession, matrix: np.ndarray, replicates: int = 1000, block: float | None = None, seed: int = 42) -> dict:
    """p-values of White's Reality Check and of Hansen's consistent SPA for excess returns (rows by trials).

    Replicates are drawn twice from the same seeds: first each task sums its means and their squares by trial, which gives
    the deviations; then each replicate is reduced to whether its maxima reach those observed. Only counts reach the driver.
    """
    n, trials = matrix.shape
    if n < 10:
        return {"rc_p": math.nan, "spa_p": math.nan, "best": None}
    mean, root = matrix.mean(0), math.sqrt(n)
    block = block_length(matrix[:, int(np.argmax(mean))]) if block is None else block
    held = spark.sparkContext.broadcast(matrix)  # one trial matrix, as the caller holds it already
    every = spark.range(0, replicates, 1, spark.sparkContext.defaultParallelism)

    def shifted(f):
        m = held.value
        for r in f["id"]:
            yield m[indices(n, np.random.default_rng([seed, int(r)]), "stationary", block)].mean(0) - mean

    def sums(frames):
        total = np.zeros((2, trials))
        for f in frames:
            for x in shifted(f):
                total += x, x * x
        yield pd.DataFrame({"trial": np.arange(trials), "s": total[0], "q": total[1]})

    got = every.mapInPandas(sums, "trial long, s double, q double").groupBy("trial").agg(F.sum("s").alias("s"), F.sum("q").alias("q")).orderBy("trial").collect()  # a row a trial
    s, q = np.array([r["s"] for r in got]), np.array([r["q"] for r in got])
    omega = root * np.sqrt(np.maximum(0.0, (q - s * s / replicates) / max(1, replicates - 1)))
    ok = omega > 1e-14
    scaled = root * mean[ok] / omega[ok]
    reached = max(0.0, float(scaled.max())) if ok.any() else math.nan
    centre = np.where(scaled >= -math.sqrt(2 * math.log(math.log(n))), mean[ok], 0.0)

    def hits(frames):
        for f in frames:
            rc, spa = 0, 0
            for x in shifted(f):
                rc += root * x.max() >= root * mean.max()
                spa += bool(ok.any()) and max(0.0, float((root * ((x + mean)[ok] - centre) / omega[ok]).max())) >= reached
            yield pd.DataFrame({"rc": [int(rc)], "spa": [int(spa)]})

    n_rc, n_spa = every.mapInPandas(hits, "rc long, spa long").agg(F.sum("rc"), F.sum("spa")).first()
    return {"rc_p": (1 + n_rc) / (1 + replicates), "spa_p": (1 + n_spa) / (1 + replicates) if ok.any() else math.nan, "best": int(np.argmax(mean))}
