"""Trial matrices (timestamp, trial, ret): CSCV, walk-forward and combinatorial selection, effective trials, parameter surfaces."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import DataError
from ..plans import folds as plan
from ..shared import materialize, small
from . import windows as wn


def finite_matrix(trials: DataFrame) -> DataFrame:
    """Rows of timestamps at which every trial has a return."""
    n = trials.select("trial").distinct().count()
    whole = trials.where(F.col("ret").isNotNull()).groupBy("timestamp").count().where(F.col("count") == n).select("timestamp")
    return trials.join(whole, "timestamp", "left_semi")


def blocks(trials: DataFrame, s: int) -> DataFrame:
    """(trial, block, n, total, squares): sufficient statistics of each of s equal blocks of time."""
    b = F.ntile(s).over(Window.partitionBy("trial").orderBy("timestamp")) - 1
    return trials.select("trial", "ret", b.alias("block")).groupBy("trial", "block").agg(F.count("ret").alias("n"), F.sum("ret").alias("total"), F.sum(F.col("ret") * F.col("ret")).alias("squares"))


def combos(spark: SparkSession, s: int, most: int = 5000, seed: int = 42) -> DataFrame:
    """(combo, block): in-sample blocks of the subsets of half the blocks, lexicographic; above `most` a seeded choice without replacement."""
    every = list(combinations(range(s), s // 2))
    if len(every) > most:
        every = [every[i] for i in sorted(np.random.default_rng(seed).choice(len(every), most, replace=False))]
    return spark.createDataFrame([(i, b) for i, c in enumerate(every) for b in c], "combo int, block int")


def _sharpe(n: str, total: str, squares: str):
    mean = F.try_divide(F.col(total), F.col(n))
    var = F.try_divide(F.col(squares) - F.col(n) * mean * mean, F.col(n) - 1)
    return F.when(var > 1e-20, mean / F.sqrt(var))


def cscv(trials: DataFrame, s: int = 10, most: int = 5000, seed: int = 42) -> DataFrame:
    """One row per combination: winner, is_sharpe, oos_sharpe, oos_rank (ties averaged, undefined lowest), w = rank / (N + 1), logit."""
    spark = trials.sparkSession
    if s % 2:
        raise DataError("the number of blocks must be even")
    stats = blocks(trials, s)
    whole = stats.groupBy("trial").agg(*[F.sum(c).alias(f"all_{c}") for c in ("n", "total", "squares")])
    inside = F.broadcast(combos(spark, s, most, seed)).join(stats, "block").groupBy("combo", "trial").agg(*[F.sum(c).alias(c) for c in ("n", "total", "squares")])
    both = inside.join(small(whole), "trial")
    both = both.withColumns({f"o_{c}": F.col(f"all_{c}") - F.col(c) for c in ("n", "total", "squares")})
    both = both.select("combo", "trial", _sharpe("n", "total", "squares").alias("is_sharpe"), _sharpe("o_n", "o_total", "o_squares").alias("oos_sharpe"))
    low = F.coalesce("oos_sharpe", F.lit(float("-inf")))
    ranked = both.withColumn("_low", low).withColumn("oos_rank", wn.average_rank(F.col("_low"), "combo"))
    n = ranked.groupBy("combo").agg(
        F.max_by(F.struct("trial", "is_sharpe", "oos_sharpe", "oos_rank"), F.struct(F.coalesce("is_sharpe", F.lit(float("-inf"))), -F.col("trial"))).alias("b"), F.count(F.lit(1)).alias("_n")
    )
    w = F.col("b.oos_rank") / (F.col("_n") + 1)
    return n.select("combo", F.col("b.trial").alias("winner"), F.col("b.is_sharpe").alias("is_sharpe"), F.col("b.oos_sharpe").alias("oos_sharpe"), F.col("b.oos_rank").alias("oos_rank"), w.alias("w"), F.log(w / (1 - w)).alias("logit"))


def pbo(table: DataFrame) -> DataFrame:
    """One row: n_combos, pbo (share of logits of 0 or less), slope and intercept of out-of-sample on in-sample Sharpe, probability of loss, median logit."""
    return table.agg(
        F.count(F.lit(1)).alias("n_combos"), F.avg((F.col("logit") <= 0).cast("double")).alias("pbo"), F.regr_slope("oos_sharpe", "is_sharpe").alias("slope"),
        F.regr_intercept("oos_sharpe", "is_sharpe").alias("intercept"), F.avg((F.col("oos_sharpe") < 0).cast("double")).alias("p_loss"), F.expr("percentile(logit, 0.5)").alias("median_logit"),
    )


def pbo_reading(value: float) -> str:
    return "low" if value <= 0.1 else "elevated" if value < 0.5 else "high"


def _placed(trials: DataFrame, *keys: str) -> DataFrame:
    """trials with pos: the place of each row in its trial's time."""
    return trials.withColumn("pos", (F.row_number().over(Window.partitionBy(*keys).orderBy("timestamp")) - 1).cast("long"))


def _ratio(role: str) -> Column:
    x = F.when(F.col("_role") == role, F.col("ret"))
    return F.try_divide(F.avg(x), F.stddev_samp(x))


def _winners(rows: DataFrame, key: str) -> DataFrame:
    """rows (key, trial, ret, _role): per key the trial of best train Sharpe (least id on ties), its train and test Sharpe ratios per period."""
    s = rows.groupBy(key, "trial").agg(_ratio("train").alias("train"), _ratio("test").alias("test"))
    best = s.groupBy(key).agg(F.max_by(F.struct("trial", "train", "test"), F.struct(F.coalesce("train", F.lit(float("-inf"))), -F.col("trial"))).alias("b"))
    return best.select(key, F.col("b.trial").alias("trial"), F.col("b.train").alias("train_sharpe"), F.col("b.test").alias("test_sharpe"))


Folds = list[tuple[int, int, int, int, int]]


def _in_folds(rows: DataFrame, folds: Folds) -> DataFrame:
    table = F.broadcast(rows.sparkSession.createDataFrame(folds, "fold int, a long, b long, c long, d long"))  # some folds
    p = F.col("pos")
    rows = rows.join(table, ((p >= F.col("a")) & (p < F.col("b"))) | ((p >= F.col("c")) & (p < F.col("d"))))
    return rows.withColumn("_role", F.when(p < F.col("b"), "train").otherwise("test")).drop("a", "b", "c", "d")


def walk_forward_selection(trials: DataFrame, folds: Folds) -> DataFrame:
    """Per fold: the trial of best train Sharpe, its train and test Sharpe ratios per period."""
    return _winners(_in_folds(_placed(trials, "trial"), folds), "fold")


def walk_forward_returns(trials: DataFrame, folds: Folds) -> DataFrame:
    """(fold, timestamp, ret): the test returns of each fold's winner, which together are the out-of-sample series."""
    rows = _in_folds(_placed(trials, "trial"), folds)
    best = small(_winners(rows, "fold").select("fold", "trial"))
    return rows.where("_role = 'test'").join(best, ["fold", "trial"]).select("fold", "timestamp", "ret")


def walk_forward_single(returns: DataFrame, folds: Folds) -> DataFrame:
    """Per fold of one series without a choice: n and the Sharpe ratio per period of its test rows."""
    rows = _in_folds(_placed(returns), folds).where("_role = 'test'")
    return rows.groupBy("fold").agg(F.count("ret").alias("n"), _ratio("test").alias("test_sharpe"))


#: Out-of-sample evidence is weak below this share of the mean in-sample Sharpe ratio.
LEAST_KEPT = 0.5


def oos_evidence(fold_sharpes: list[float | None], oos_sharpe: float | None, n: int, is_mean: float | None = None, least: int = 60) -> dict:
    """What speaks against the out-of-sample result: four criteria, and no score."""
    finite = [x for x in fold_sharpes if x is not None]
    up, kept = sum(x > 0 for x in finite), oos_sharpe / is_mean if oos_sharpe is not None and is_mean is not None and is_mean > 0 else None
    weak = []
    if oos_sharpe is None or oos_sharpe <= 0:
        weak.append("the out-of-sample Sharpe ratio is not positive")
    if fold_sharpes and 2 * up < len(fold_sharpes):
        weak.append(f"{up} of {len(fold_sharpes)} folds are positive")
    if kept is not None and 0 < kept < LEAST_KEPT:
        weak.append(f"{kept:.0%} of the in-sample Sharpe ratio is left")
    if n < least:
        weak.append(f"{n} out-of-sample returns are fewer than {least}")
    return {
        "n": n, "oos_sharpe": oos_sharpe, "folds": len(fold_sharpes), "positive_folds": up, "median": float(np.median(finite)) if finite else None,
        "deviation": float(np.std(finite, ddof=1)) if len(finite) > 1 else None, "is_sharpe": is_mean, "kept": kept, "weak": weak,
    }


def combinatorial_selection(trials: DataFrame, splits: DataFrame) -> DataFrame:
    """Per split of (split, pos, role): winner on training rows, its train and test Sharpe ratios."""
    rows = _placed(trials, "trial").join(splits.where("role in ('train', 'test')").withColumnRenamed("role", "_role"), "pos")
    return _winners(rows, "split")


def path_returns(trials: DataFrame, splits: DataFrame, n: int, groups: int, k: int) -> DataFrame:
    """(path, pos, value): the test returns of the splits' winners put together along the combinatorial paths."""
    rows = _placed(trials, "trial").join(splits.where("role in ('train', 'test')").withColumnRenamed("role", "_role"), "pos")
    best = small(_winners(rows, "split").select("split", "trial"))
    found = rows.where("_role = 'test'").join(best, ["split", "trial"]).select("split", plan.group_of(n, groups).alias("grp"), "pos", F.col("ret").alias("value"))
    return plan.assemble(plan.paths(trials.sparkSession, groups, k), found)


def path_sharpes(paths: DataFrame) -> DataFrame:
    """(path, n, sharpe) per period; null without variance."""
    return paths.groupBy("path").agg(F.count("value").alias("n"), F.try_divide(F.avg("value"), F.stddev_samp("value")).alias("sharpe"))


def column_sharpes(trials: DataFrame) -> DataFrame:
    """(trial, sharpe) per period of a matrix's columns; none for a column with a hole or without variance."""
    n = trials.select("timestamp").distinct().count()
    return trials.groupBy("trial").agg(F.when(F.count("ret") == n, F.try_divide(F.avg("ret"), F.stddev_samp("ret"))).alias("sharpe"))


def correlation_pairs(trials: DataFrame) -> DataFrame:
    """(a, b, corr) of all trials with a variance, over the times at which each of them has a return: N^2 rows of N series, by definition.

    Each task sums the products of its own rows as one matrix; only these sums meet, however many times there are.
    """
    whole = finite_matrix(trials)
    stats = [tuple(r) for r in whole.groupBy("trial").agg(F.avg("ret").alias("m"), F.stddev_pop("ret").alias("s")).where("s > 0").orderBy("trial").collect()]  # a row a trial
    ids, centre = [t for t, _, _ in stats], np.array([m for _, m, _ in stats])
    kind = dict(trials.dtypes)["trial"]
    schema = f"a {kind}, b {kind}, s double"
    if not ids:
        return trials.sparkSession.createDataFrame([], schema.replace("s double", "corr double"))
    rows = whole.where(F.col("trial").isin(ids)).groupBy("timestamp").agg(F.sort_array(F.collect_list(F.struct("trial", "ret"))).alias("x")).select(F.col("x.ret").alias("x"))

    def products(frames):
        total = np.zeros((len(ids), len(ids)))
        for f in frames:
            if len(f):
                m = np.stack(f["x"].to_numpy()) - centre
                total += m.T @ m
        i, j = np.indices(total.shape)
        yield pd.DataFrame({"a": np.array(ids)[i.ravel()], "b": np.array(ids)[j.ravel()], "s": total.ravel()})

    sums = materialize(rows.mapInPandas(products, schema).groupBy("a", "b").agg(F.sum("s").alias("s")), "products")
    own = sums.where("a = b").select("a", F.sqrt("s").alias("_d"))
    both = sums.join(small(own), "a").join(small(own.toDF("b", "_e")), "b")
    return both.select("a", "b", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("s") / (F.col("_d") * F.col("_e")))).alias("corr"))


def effective_trials(trials: DataFrame) -> float:
    """Eigenvalue count of the correlation matrix after Li and Ji: each eigenvalue gives [x >= 1] + its fraction."""
    n, rows = trials.select("trial").distinct().count(), trials.select("timestamp").distinct().count()
    if n <= 1 or rows < 3:
        return float(n)
    got = correlation_pairs(trials).collect()  # trials squared: a matrix for the driver
    ids = {t: i for i, t in enumerate(sorted({r["a"] for r in got}))}
    m = np.eye(len(ids))
    for r in got:
        m[ids[r["a"]], ids[r["b"]]] = r["corr"]
    eig = np.round(np.abs(np.linalg.eigvalsh(m)), 8)
    return float(((eig >= 1) + (eig - np.floor(eig))).sum())


# ---- parameter surfaces


def grid_points(results: DataFrame, params: list[str]) -> DataFrame:
    """results with _i<k>: the ordinal of each parameter's value. A grid has as many rows as trials."""
    return results.withColumns({f"_i{k}": F.dense_rank().over(Window.orderBy(p)) for k, p in enumerate(params)})


def neighbours(results: DataFrame, params: list[str], metric: str) -> DataFrame:
    """Per trial: metric, mean, median and greatest metric of the points one step away in any parameters, and their number."""
    g = grid_points(results, params).select("trial", metric, *[f"_i{k}" for k in range(len(params))])
    o = g.select(F.col("trial").alias("_t"), F.col(metric).alias("_m"), *[F.col(f"_i{k}").alias(f"_j{k}") for k in range(len(params))])
    steps = [F.abs(F.col(f"_i{k}") - F.col(f"_j{k}")) for k in range(len(params))]
    near = F.greatest(*steps, F.lit(0)) == 1
    # Equal ordinals within one step on the first parameter: an equi-join on three shifted values instead of all pairs.
    keyed = o.withColumn("_key", F.explode(F.array(*[F.col("_j0") + d for d in (-1, 0, 1)])))
    pairs = g.join(keyed, (F.col("_i0") == F.col("_key")) & near, "left")
    return pairs.groupBy("trial", metric).agg(F.count("_t").alias("n_near"), F.avg("_m").alias("near_mean"), F.expr("percentile(_m, 0.5)").alias("near_median"), F.max("_m").alias("near_max"))


def local_maxima(near: DataFrame, metric: str, k: int = 10) -> DataFrame:
    return near.where((F.col("n_near") > 0) & (F.col(metric) >= F.col("near_max"))).orderBy(F.desc(metric), "trial").limit(k)


def surface_reading(best: float, near_median: float, robust: float = 0.7, fragile: float = 0.4) -> tuple[float, str]:
    ratio = near_median / best if best > 0 else math.nan
    return ratio, "undetermined" if math.isnan(ratio) else "robust" if ratio >= robust else "fragile" if ratio < fragile else "moderate"


#: Rows up to which ranks of a whole column are taken by one window.
ONE_WINDOW = 100_000


def spearman(df: DataFrame, a: str, b: str, most: int = ONE_WINDOW) -> DataFrame:
    """One row: n and rank correlation of two columns, ties averaged; null for fewer than three pairs or a constant."""
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("a"), F.col(b).alias("b"))
    if rows.limit(most + 1).count() <= most:
        ranked = rows.select(wn.average_rank(F.col("a")).alias("_a"), wn.average_rank(F.col("b")).alias("_b"))
    else:
        rows = materialize(rows, "pairs")
        found = {c: materialize(plan.ranks(rows, c).withColumnRenamed("rank", f"_{c}"), "ranks") for c in "ab"}
        ranked = rows.join(small(found["a"]), "a").join(small(found["b"]), "b")
    return ranked.agg(F.count(F.lit(1)).alias("n"), wn.correlation(F.col("_a"), F.col("_b"), 3).alias("spearman"))


def surface(results: DataFrame, params: list[str], metric: str, oos: str | None = None, robust: float = 0.7, fragile: float = 0.4) -> dict:
    """The shape of a parameter surface: its best point, that point's neighbours, plateau ratio, spike z, share above half of the best, local maxima, and how ranks carry over to `oos`.

    results: trial, params, metric, one row a trial. Rows without a metric are left out.
    """
    rows = results.where(F.col(metric).isNotNull() & ~F.isnan(metric))
    near = neighbours(rows, params, metric)
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop(metric).alias("sd"), F.max(metric).alias("best")).first()
    if total["n"] < 2:
        raise DataError("a surface needs two points")
    best = near.orderBy(F.desc(metric), "trial").first()
    tops = [r.asDict() for r in local_maxima(near, metric).select("trial", metric).collect()]
    ratio, reading = surface_reading(best[metric], best["near_median"], robust, fragile) if best["n_near"] else (math.nan, "undetermined")
    spike = (best[metric] - best["near_mean"]) / total["sd"] if best["n_near"] and total["sd"] else math.nan
    above = rows.agg(F.avg((F.col(metric) >= 0.5 * total["best"]).cast("double"))).first()[0] if total["best"] > 0 else math.nan
    at = rows.where(F.col("trial") == best["trial"]).first()
    out = {
        "n": total["n"], "best_trial": best["trial"], "best": {p: at[p] for p in params}, "value": best[metric], "n_near": best["n_near"], "near_median": best["near_median"], "near_mean": best["near_mean"],
        "plateau": ratio, "spike": spike, "reading": reading, "share_above_half": above, "maxima": tops,
    }
    if oos:
        rank = spearman(rows, metric, oos).first()["spearman"]
        late = rows.agg(F.expr(f"percentile({oos}, 0.5)").alias("m"), F.max_by("trial", F.struct(oos, -F.col("trial"))).alias("t")).first()
        out |= {"spearman": rank, "oos_at_best": at[oos], "oos_median": late["m"], "oos_best_is_best": late["t"] == best["trial"]}
    return out


def surface_slice(results: DataFrame, x: str, y: str, metric: str, fixed: dict[str, float]) -> DataFrame:
    rows = results
    for name, value in fixed.items():
        rows = rows.where(F.col(name) == value)
    return rows.groupBy(y).pivot(x).agg(F.avg(metric)).orderBy(y)


def heat_map(rows: list[dict], x: str, y: str, metric: str, digits: int = 2) -> str:
    """Text grid with a star on the maximum."""
    xs, ys = sorted({r[x] for r in rows}), sorted({r[y] for r in rows})
    cell = {(r[x], r[y]): r[metric] for r in rows}
    top = max(cell, key=lambda k: (cell[k] is not None, cell[k]))
    head = f"{y}\\{x}".rjust(10) + "".join(f"{v:>10}" for v in xs)
    lines = [f"{v:>10}" + "".join(("-" if cell.get((u, v)) is None else f"{cell[u, v]:.{digits}f}" + ("*" if (u, v) == top else "")).rjust(10) for u in xs) for v in ys]
    return "\n".join([head, *lines])
