"""The audit: a strategy and data, or another tool's results, to findings and a verdict."""

from __future__ import annotations

import hashlib
import importlib.util
import inspect
import math
import platform
from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import product
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import DataError, StrategyError
from ..functions import moments
from ..operators import causality, execution, leakage, prepare, quality, regimes, resample, selection
from ..operators import windows as wn
from ..plans import folds
from ..shared import materialize
from ..sources.tables import Artifacts, load_raw, load_returns, raw_times
from . import code
from .config import Config
from .findings import Finding, Result, Severity, canonical_hash
from .lineage import Lineage, fingerprint

S = Severity


@dataclass
class Strategy:
    """generate_signals(bars, **params) -> DataFrame of the bars' keys, timestamp and weight."""

    generate: Callable[..., DataFrame]
    params: dict = field(default_factory=dict)
    grid_values: dict[str, list] = field(default_factory=dict)
    execution: dict = field(default_factory=dict)
    source: str | None = None
    file: str = "<callable>"

    def __call__(self, bars: causality.Bars, **params) -> DataFrame:
        return self.generate(bars, **(self.params | params))

    def grid(self, most: int, seed: int) -> list[dict]:
        names = sorted(self.grid_values)
        every = [dict(zip(names, v, strict=True)) for v in product(*(self.grid_values[n] for n in names))] if names else []
        if len(every) > most:
            every = [every[i] for i in sorted(np.random.default_rng(seed).choice(len(every), most, replace=False))]
        return every


def load_strategy(source: str | Callable | Strategy) -> Strategy:
    """A path is imported in this process: only audit code that you would run."""
    if isinstance(source, Strategy):
        return source
    if callable(source):
        return Strategy(source)
    path = Path(source)
    if not path.is_file():
        raise StrategyError(f"{source} is no file")
    spec = importlib.util.spec_from_file_location(f"strategy_{canonical_hash(str(path.resolve()))[:12]}", path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    if not callable(getattr(module, "generate_signals", None)):
        raise StrategyError(f"{source} does not define generate_signals(bars, **params)")
    declared = dict(getattr(module, "EXECUTION", {}))
    if unknown := set(declared) - {"fill", "signal_lag", "commission_bps", "spread_bps", "slippage_bps"}:
        raise StrategyError(f"unknown EXECUTION keys {sorted(unknown)}")
    return Strategy(module.generate_signals, dict(getattr(module, "PARAMS", {})), dict(getattr(module, "GRID", {})), declared, path.read_text(), str(path))


def validate_data(bars: DataFrame, cfg: Config, log: list[str] | None = None, times: dict | None = None, prepared: DataFrame | None = None) -> list[Finding]:
    """All data rules over raw or prepared bars (timestamp, symbol, OHLC): one finding per rule, the worst symbols named.

    times: raw_times of the source; without it the rules on raw timestamps (001, 002, 010) are not judged. prepared: bars
    without repeated times, for the rules that need them. With _seq (the order of input) findings carry first examples.
    """
    d, out = cfg.data, []
    if not d.enabled:
        return []
    on = lambda rule: rule not in d.disabled
    if times is not None:
        out.append(Finding("DATA-001", S.WARN if times["n_bad"] else S.PASS, f"{times['n_bad']} timestamps do not parse", {"examples": times.get("examples", [])}))
        out.append(Finding("DATA-002", S.WARN if times["n_backward"] else S.PASS, f"{times['n_backward']} steps back in time", {"first": times.get("first_backward")}))
        mixed = times["n_aware"] and times["n_naive"]
        out.append(Finding("DATA-010", S.WARN if mixed else S.INFO if len(times["offsets"]) > 1 else S.PASS, f"{times['n_aware']} timestamps with a time zone, {times['n_naive']} without", {"offsets": times["offsets"]}))
    if bars.isEmpty():
        return [f for f in [*out, Finding("DATA-014", S.FAIL, "there are no rows")] if on(f.rule)]
    missing = [c for c in quality.PRICES if c not in bars.columns]
    close = prepare.price_column(bars)
    if close is None:
        return [f for f in [*out, Finding("DATA-003", S.FAIL, f"no price column among {bars.columns}")] if on(f.rule)]
    out.append(Finding("DATA-003", (S.FAIL if d.require_ohlc else S.INFO) if missing else S.PASS, f"missing {missing}" if missing else "OHLC is complete"))
    full = bars.withColumns({c: F.col(close) for c in missing})
    single = full if prepared is None else prepared.withColumns({c: F.col(close) for c in missing})
    keys, ordered = ["symbol"], "_seq" in bars.columns

    def merge(rule: str, rows: list, value: Callable, bad: Severity, what: str, **evidence) -> None:
        """One finding for all symbols: the worst severity, the first five of them."""
        hit = [(r["symbol"], value(r)) for r in rows if value(r)]
        out.append(Finding(rule, bad if hit else S.PASS, f"{sum(v for _, v in hit)} {what}" if hit else f"no {what}", {"symbols": [s for s, _ in hit][:5], "counts": dict(hit[:5])} | {k: f() for k, f in evidence.items() if hit}))

    first = lambda condition: {"examples": lambda: quality.examples(full, F.expr(condition))} if ordered else {}
    o, h, lo, c = quality.PRICES
    counts = sorted(quality.row_counters(full, keys).collect(), key=lambda r: r["symbol"] or "")  # a row per symbol
    if on("DATA-004"):
        merge("DATA-004", counts, lambda r: r["n_duplicate_times"], S.INFO if d.allow_duplicates else S.WARN, "duplicate timestamps", **({"examples": lambda: quality.repeated(full, keys)} if ordered else {}))
    if on("DATA-006"):
        merge("DATA-006", counts, lambda r: r["n_impossible"], S.FAIL, "impossible bars", **first(f"{h} < greatest({o}, {c}, {lo}) - 1e-12 or {lo} > least({o}, {c}, {h}) + 1e-12"))
    if on("DATA-007"):
        merge("DATA-007", counts, lambda r: r["n_nonpositive"], S.FAIL, "non-positive prices", **first(f"least({o}, {h}, {lo}, {c}) <= 0"))
    if on("DATA-008"):
        lost = {k: v for k, v in quality.missing_values(bars, ("timestamp", "symbol", "_seq")).first().asDict().items() if v}
        out.append(Finding("DATA-008", S.WARN if lost else S.PASS, f"{sum(lost.values())} missing values" if lost else "no missing values", {"columns": lost}))
    if on("DATA-012"):
        merge("DATA-012", counts, lambda r: r["n_infinite"], S.FAIL, "infinite values", **first(f"greatest(abs({o}), abs({h}), abs({lo}), abs({c})) = double('Infinity')"))
    if on("DATA-009"):
        merge("DATA-009", quality.gaps(full.where("timestamp is not null"), d.gap_multiple, keys).orderBy("symbol").collect(), lambda r: r["n_gaps"], S.WARN, "gaps")
    if on("DATA-011"):
        merge("DATA-011", quality.stale_runs(full, close, d.stale_runs, keys).orderBy("symbol").collect(), lambda r: r["n_runs"], S.WARN, "stale runs")
    if on("DATA-013"):
        extreme = quality.extreme_returns(single, close, d.extreme_return, keys).orderBy("symbol").collect()
        worst = max((r for r in extreme if r["n_extreme"]), key=lambda r: abs(r["worst"]), default=None)
        merge("DATA-013", extreme, lambda r: r["n_extreme"], S.WARN, "extreme returns", worst=lambda: {"return": worst["worst"], "time": str(worst["worst_time"]), "symbol": worst["symbol"]})
    if on("DATA-005"):
        copies = quality.duplicate_rows(bars.drop("_seq")).first()[0]
        out.append(Finding("DATA-005", S.WARN if copies else S.PASS, f"{copies} duplicate rows"))
    if len(counts) > 1 and on("DATA-015"):
        rows = quality.synchrony(full.where("timestamp is not null")).collect()
        inside, uneven = sum(r["n_missing_inside"] for r in rows), any(r["coverage"] < 1 for r in rows)
        out.append(Finding("DATA-015", S.WARN if inside else S.INFO if uneven else S.PASS, f"{inside} timestamps missing inside the common span"))
    if log:
        out.append(Finding("DATA-000", S.INFO, "; ".join(log)))
    return [f for f in out if on(f.rule)]


def costs_of(cfg: Config) -> execution.CostModel:
    e = cfg.execution
    parts = [execution.bps(e.commission_bps), execution.half_spread(e.spread_bps), execution.slippage(e.slippage_bps)]
    parts += [execution.tax(e.tax_bps)] if e.tax_bps else []
    return execution.CostModel((*parts, execution.square_root_impact(e.impact)) if e.impact else tuple(parts))


def one_way(e) -> float:
    """Linear costs of one trade in bps, of settings or of what a strategy declares."""
    get = e.get if isinstance(e, dict) else lambda k, default: getattr(e, k, default)
    return get("commission_bps", 0.0) + get("spread_bps", 0.0) / 2 + get("slippage_bps", 0.0) + get("tax_bps", 0.0)


def _number(x: float | None, form: str = ".2f") -> str:
    return "undefined" if x is None or x != x else format(x, form)


def judge_statistics(returns: DataFrame, cfg: Config, n_trials: int, declared: bool, trials: DataFrame | None = None, scenarios: dict[str, float | None] | None = None) -> tuple[list[Finding], dict]:
    """Sharpe ratio and what it is worth. trials: the returns of all settings (timestamp, trial, ret), for their number and spread."""
    spark, st, out = returns.sparkSession, cfg.statistics, []
    root = math.sqrt(st.periods)
    m = moments.moments_by(returns, "ret", [], st.risk_free, st.periods).first()
    m = m.asDict() if m else {"n": 0}
    n = m.get("n") or 0
    out.append(Finding("STAT-001", S.WARN if n < st.least else S.PASS, f"{n} returns; {st.least} are asked for", {"n": n}))
    if n < 2 or m.get("sharpe") is None:
        return out, {"moments": m}
    section: dict = {"moments": m, "sharpe": m["sharpe"] * root, "headline": execution.headline(returns, periods=st.periods).first().asDict()}
    benchmark = st.benchmark_sharpe / root
    p, z = moments.psr(m["sharpe"], n, m["skew"], m["kurt"], benchmark)
    need = moments.least_track_record(m["sharpe"], m["skew"], m["kurt"], benchmark, st.confidence)
    out.append(Finding("STAT-002", S.PASS if p >= st.confidence else S.WARN, f"probability {_number(p, '.3f')} that the Sharpe ratio is above {st.benchmark_sharpe:.2f}; a track record of {_number(need, '.0f')} returns would show it", {"psr": p, "z": z, "needed": need}))
    effective = variance = None
    if trials is not None and n_trials >= 2:
        effective = selection.effective_trials(trials)
        variance = moments.sharpe_by(trials, "ret", ["trial"], 1.0).agg(F.var_samp("sharpe")).first()[0]
    d = moments.deflated_sharpe(m, max(1, n_trials), variance or None, exact=True) | {"trials": n_trials, "effective": effective}
    if effective is not None:
        d["dsr_effective"] = moments.deflated_sharpe(m, max(1.0, effective), variance or None)["dsr"]
    out.append(Finding("STAT-003", S.PASS if d["dsr"] >= st.confidence else S.WARN, f"deflated Sharpe ratio {_number(d['dsr'], '.3f')} over {n_trials} trials" + (f", about {effective:.1f} of them independent" if effective is not None else ""), d))
    candidates = {"audited": m["sharpe"] * root} | {k: v for k, v in (scenarios or {}).items() if v is not None and v == v}
    strong = {k: v for k, v in candidates.items() if v > st.plausible_sharpe}
    out.append(Finding("STAT-004", S.WARN if strong else S.PASS, "; ".join(f"{k}: {v:.2f}" for k, v in (strong or candidates).items()) + (f", above {st.plausible_sharpe:.1f}" if strong else " a year"), {"sharpe": candidates}))
    if not declared:
        out.append(Finding("STAT-005", S.WARN if st.require_trials else S.INFO, "the number of trials is not declared; one is assumed"))
    odd = m["skew"] is not None and (abs(m["skew"]) > 1 or m["kurt"] - 3 > 3)
    if odd:
        out.append(Finding("STAT-006", S.INFO, f"skewness {m['skew']:.2f}, excess kurtosis {m['kurt'] - 3:.2f}", {"skew": m["skew"], "kurt": m["kurt"]}))
    rho = [r["rho"] for r in wn.autocorrelations(returns, "ret", "timestamp", 10).orderBy("lag").collect()] if n > 20 else []
    adjusted = moments.adjusted_sharpe(m["sharpe"], rho, round(st.periods)) if rho else None
    if rho and abs(rho[0]) > 2 / math.sqrt(n):
        out.append(Finding("STAT-007", S.INFO, f"first autocorrelation {rho[0]:.3f}; adjusted Sharpe ratio {_number(adjusted)} a year", {"rho": rho, "adjusted": adjusted}))
    section |= {"psr": p, "dsr": d, "needed": need, "rho": rho, "adjusted": adjusted}
    if n >= 10:
        x = np.array([r[0] for r in returns.where("ret is not null").orderBy("timestamp").select("ret").collect()])  # one portfolio series
        values = resample.bootstrap(spark, x, resample.sharpe_rows, st.replicates, st.bootstrap, st.block, cfg.seed)
        section["interval"] = {k: v * root if k in ("low", "high", "se") and v is not None else v for k, v in resample.interval(values, st.confidence).first().asDict().items()}
    return out, section


def judge_causality(s: causality.Strategy, bars: DataFrame, cfg: Config) -> tuple[list[Finding], list]:
    """Two baselines, the perturbed futures, and a control run; weights that differ between the baselines leave the rest open."""
    c = cfg.causality
    if not c.enabled:
        return [Finding("META-RUNTIME", S.INFO, "perturbed futures are switched off")], []
    seed = cfg.seed if c.seed is None else c.seed
    unstable = causality.n_unstable(s, bars, c.rtol, c.atol)
    if unstable:
        return [Finding("CAUSAL-002", S.WARN, f"{unstable} weights differ between two runs on the same bars; perturbed futures say nothing")], []
    moved, errors = causality.run_all(s, bars, c.first, c.cutoffs, tuple(c.schemes), c.magnitude, seed)
    bad, out = [r for r in moved if r["n_changed"]], [Finding("CAUSAL-002", S.PASS, "two runs on the same bars agree")]
    if moved:
        first = min(bad, key=lambda r: r["first_changed"], default=None)
        evidence = {"schemes": sorted({r["scheme"] for r in bad}), "first": str(first["first_changed"]) if first else None}
        if first:
            evidence |= {"symbol": first["first_symbol"], "original": first["original"], "perturbed": first["perturbed"], "largest": max(r["largest"] for r in bad)}
        out.append(Finding("CAUSAL-001", S.FAIL if bad else S.PASS, f"{len(bad)} of {len(moved)} perturbed futures moved earlier weights", evidence))
    else:
        out.append(Finding("CAUSAL-001", S.INFO, "no perturbed future could be run"))
    out.append(Finding("CAUSAL-003", S.INFO if errors else S.PASS, f"{len(errors)} perturbed futures made the strategy fail", {"errors": errors[:5]}))
    control = causality.control_changes(s, bars, c.magnitude, seed)
    if control is None:
        out.append(Finding("CAUSAL-004", S.INFO, "the strategy fails on the control run"))
    else:
        out.append(Finding("CAUSAL-004", S.PASS if control else S.INFO, f"{control} weights move with all of the data"))
    return out, moved


def _windows(rows: int, cfg: Config) -> list[tuple[int, int, int, int, int]]:
    v = cfg.validation
    return folds.walk_forward(rows, v.train_fraction, v.folds, v.gap, v.expanding)


def _oos_finding(evidence: dict, choice: bool) -> Finding:
    what = "the best training setting of each fold" if choice else "the test windows of the one strategy"
    text = f"{what}: {evidence['positive_folds']} of {evidence['folds']} folds positive, Sharpe ratio {_number(evidence['oos_sharpe'])}"
    return Finding("VAL-001", S.WARN if evidence["weak"] else S.PASS, "; ".join([text, *evidence["weak"]]), evidence)


def judge_single(returns: DataFrame, cfg: Config) -> tuple[list[Finding], dict]:
    """Out-of-sample evidence of one series without a choice of settings."""
    root = math.sqrt(cfg.statistics.periods)
    rows = returns.where("ret is not null")
    try:
        table = _windows(rows.count(), cfg)
    except DataError as e:
        return [Finding("VAL-001", S.INFO, f"not computed: {e}")], {}
    each = selection.walk_forward_single(rows, table).orderBy("fold").collect()
    tests = moments.sharpe_by(selection.walk_forward_returns(rows.withColumn("trial", F.lit(0)), table).withColumn("_all", F.lit(0)), "ret", ["_all"], cfg.statistics.periods).first()
    evidence = selection.oos_evidence([None if r["test_sharpe"] is None else r["test_sharpe"] * root for r in each], tests["sharpe"] if tests else None, sum(r["n"] for r in each), None, cfg.statistics.least)
    return [_oos_finding(evidence, False)], {"evidence": evidence, "diagram": folds.diagram(table, rows.count())}


def judge_selection(trials: DataFrame, cfg: Config) -> tuple[list[Finding], dict]:
    """What the choice among trials (timestamp, trial, ret) is worth: out-of-sample folds, overfitting, combinatorial paths, data snooping."""
    v, out, section = cfg.validation, [], {}
    root = math.sqrt(cfg.statistics.periods)
    whole = selection.finite_matrix(trials)
    n_trials, rows = trials.select("trial").distinct().count(), whole.select("timestamp").distinct().count()
    section |= {"trials": n_trials, "rows": rows}

    def part(rule: str, name: str, work: Callable[[], Finding]) -> None:
        try:
            if n_trials < 2:
                raise DataError(f"{n_trials} trial leaves no choice")
            out.append(work())
        except DataError as e:
            out.append(Finding(rule, S.INFO, f"{name} was not computed: {e}"))

    def forward() -> Finding:
        table = _windows(rows, cfg)
        each = selection.walk_forward_selection(whole, table).orderBy("fold").collect()
        tests = moments.sharpe_by(selection.walk_forward_returns(whole, table).withColumn("_all", F.lit(0)), "ret", ["_all"], cfg.statistics.periods).first()
        trained = [r["train_sharpe"] for r in each if r["train_sharpe"] is not None]
        evidence = selection.oos_evidence([None if r["test_sharpe"] is None else r["test_sharpe"] * root for r in each], tests["sharpe"], tests["n"], float(np.mean(trained)) * root if trained else None, cfg.statistics.least)
        section["walk_forward"] = {"folds": [r.asDict() for r in each], "evidence": evidence, "diagram": folds.diagram(table, rows)}
        return _oos_finding(evidence, True)

    def overfitting() -> Finding:
        if rows < 2 * v.blocks:
            raise DataError(f"{rows} rows are too few for {v.blocks} blocks")
        p = section["pbo"] = selection.pbo(selection.cscv(whole, v.blocks, v.most_combinations, cfg.seed)).first().asDict()
        return Finding("VAL-002", S.WARN if p["pbo"] >= 0.5 else S.PASS, f"probability of overfitting {p['pbo']:.2f} ({selection.pbo_reading(p['pbo'])})", p)

    def paths() -> Finding:
        spark = trials.sparkSession
        if rows < v.groups:
            raise DataError(f"{rows} rows are too few for {v.groups} groups")
        splits = folds.require_training(materialize(folds.combinatorial(spark, folds.intervals(spark, rows), rows, v.groups, v.test_groups, v.embargo), "splits"))
        found = [None if r["sharpe"] is None else r["sharpe"] * root for r in selection.path_sharpes(selection.path_returns(whole, splits, rows, v.groups, v.test_groups)).orderBy("path").collect()]
        finite = [x for x in found if x is not None]
        middle = float(np.median(finite)) if finite else None
        section["paths"] = {"sharpes": found, "median": middle, "least": min(finite, default=None), "most": max(finite, default=None)}
        return Finding("VAL-003", S.WARN if middle is None or middle <= 0 else S.PASS, f"median Sharpe ratio {_number(middle)} of {len(found)} combinatorial paths", section["paths"])

    def snooping() -> Finding:
        wide = whole.groupBy("timestamp").pivot("trial").agg(F.first("ret")).orderBy("timestamp").drop("timestamp").collect()  # one trial matrix, which every replicate draws from
        if len(wide) < 10:
            raise DataError("ten rows are needed")
        rc = section["reality_check"] = resample.reality_check(trials.sparkSession, np.array([list(r) for r in wide], float), max(200, cfg.statistics.replicates // 2), seed=cfg.seed)
        undefined = rc["spa_p"] != rc["spa_p"]
        return Finding("VAL-004", S.INFO if undefined else S.WARN if rc["spa_p"] > 1 - cfg.statistics.confidence else S.PASS, f"p-value {_number(rc['spa_p'], '.3f')} of the best trial against zero", rc)

    for enabled, rule, name, work in ((v.walk_forward, "VAL-001", "walk-forward", forward), (v.pbo, "VAL-002", "overfitting", overfitting), (v.cpcv, "VAL-003", "combinatorial paths", paths), (v.reality_check, "VAL-004", "data snooping", snooping)):
        if enabled:
            part(rule, name, work)
    return out, section


def judge_sensitivity(trials: DataFrame, params: DataFrame | None, names: list[str], cfg: Config) -> tuple[list[Finding], dict]:
    """The shape of the parameter surface (params: trial and a column for each name), and whether the ranks of the first half of time hold in the second."""
    v, out, section = cfg.sensitivity, [], {}
    if not v.enabled:
        return out, section
    whole = selection.finite_matrix(trials)
    times = whole.select("timestamp").distinct()
    n = times.count()
    cut = times.orderBy("timestamp").limit(max(1, n // 2)).agg(F.max("timestamp")).first()[0]
    scale = math.sqrt(cfg.statistics.periods)
    ratio = lambda x: F.try_divide(F.avg(x), F.stddev_samp(x)) * scale
    early, late = F.when(F.col("timestamp") <= F.lit(cut), F.col("ret")), F.when(F.col("timestamp") > F.lit(cut), F.col("ret"))
    table = whole.groupBy("trial").agg(ratio(F.col("ret")).alias("sharpe"), ratio(early).alias("is_sharpe"), ratio(late).alias("oos_sharpe"))
    found = selection.spearman(table, "is_sharpe", "oos_sharpe").first()["spearman"]
    middle = table.agg(F.expr("percentile(oos_sharpe, 0.5)").alias("m"), F.max_by("oos_sharpe", F.struct(F.coalesce("is_sharpe", F.lit(float("-inf"))), -F.col("trial"))).alias("b")).first()
    section["halves"] = {"spearman": found, "oos_at_best": middle["b"], "oos_median": middle["m"]}
    out.append(Finding("SENS-002", S.INFO if found is None else S.WARN if found < 0 else S.PASS, "too few trials to rank" if found is None else f"rank correlation {found:.2f} between the trials of both halves; the first half's best reaches {_number(middle['b'])} in the second, the median {_number(middle['m'])}", section["halves"]))
    if params is None or not names:
        return out, section | {"note": "a surface needs numeric parameters of two values or more"}
    rows = materialize(params.select("trial", *names).join(table, "trial"), "surface")
    try:
        got = section["surface"] = selection.surface(rows, names, "sharpe", "oos_sharpe", v.robust, v.fragile)
    except DataError as e:
        return [*out, Finding("SENS-001", S.INFO, str(e))], section
    grade = {"robust": S.PASS, "fragile": S.WARN}.get(got["reading"], S.INFO)
    out.append(Finding("SENS-001", grade, f"the best setting is {got['reading']}: its {got['n_near']} neighbours reach {_number(got['plateau'])} of it", got))
    if len(names) >= 2:
        x, y, *others = names
        cells = selection.surface_slice(rows, x, y, "sharpe", {o: got["best"][o] for o in others})
        grid = [r.asDict() for r in cells.collect()]
        flat = [{x: float(k), y: r[y], "sharpe": value} for r in grid for k, value in r.items() if k != y]
        section["heatmap"] = {"x": x, "y": y, "cells": flat}
        section["map"] = selection.heat_map(flat, x, y, "sharpe")
    return out, section


def judge_regimes(returns: DataFrame, reference: DataFrame, cfg: Config, benchmark: bool = False) -> tuple[list[Finding], dict]:
    """Performance by regime of the reference: volatility, drawdown and trend; a benchmark's trend counts for the verdict too."""
    g, periods = cfg.regimes, cfg.statistics.periods
    if not g.enabled:
        return [], {}
    ref = prepare.aligned(returns, reference, "ret")
    labelled = {
        "volatility": regimes.volatility_regimes(ref, "ret", g.volatility_rows, tuple(g.volatility_quantiles), tuple(g.volatility_labels), periods),
        "drawdown": regimes.drawdown_regimes(ref, "ret", tuple(g.drawdown_cuts)), "trend": regimes.trend_regimes(ref, "ret", g.trend_rows),
    }
    sections = {n: [r.asDict() for r in regimes.performance(returns.join(x.select("timestamp", "regime"), "timestamp", "left"), "ret", periods, g.least).orderBy("first").collect()] for n, x in labelled.items()}
    one = moments.sharpe_by(returns.withColumn("_all", F.lit(0)), "ret", ["_all"], periods).first()
    overall = one["sharpe"] if one else None
    judged = [n for n in sections if n != "trend" or benchmark]
    bad = [f"{n} {r['regime']} ({r['sharpe']:.2f})" for n in judged for r in sections[n] if r["sharpe"] is not None and r["sharpe"] < 0]
    good = overall is not None and overall > 0
    return [Finding("REGIME-001", S.WARN if bad and good else S.PASS if good else S.INFO, f"Sharpe ratio {_number(overall)}, but losses in {', '.join(bad)}" if bad and good else "no regime with losses beside an overall gain", {"overall": overall, "regimes": bad})], sections


def judge_execution(weighted: DataFrame, declared: dict, cfg: Config, since) -> tuple[list[Finding], dict, DataFrame]:
    """Scenarios, costs and what is left of the edge; the net series of the audit's own assumptions (timestamp, ret)."""
    e, periods, out = cfg.execution, cfg.statistics.periods, []
    fill, lag = declared.get("fill", "close"), declared.get("signal_lag", 1)
    untestable = fill in execution.UNTESTABLE
    if fill not in execution.FILLS and not untestable:
        raise StrategyError(f"unknown fill {fill!r}; known: {sorted(execution.FILLS)} and {list(execution.UNTESTABLE)}")
    out.append(Finding("EXEC-006", S.WARN if untestable else S.PASS, f"a {fill} fill cannot be tested on bars; {e.fill} is used" if untestable else f"{fill} fills can be tested on bars"))
    own = execution.CostModel((execution.bps(declared.get("commission_bps", 0.0)), execution.half_spread(declared.get("spread_bps", 0.0)), execution.slippage(declared.get("slippage_bps", 0.0))))
    scenarios = {"naive": {"lag": 0}, "audit": {"costs": costs_of(cfg), "fill": e.fill, "lag": e.lag, "capital": e.capital}}
    if declared and not untestable:
        scenarios["declared"] = {"costs": own, "fill": fill, "lag": lag}
    lags = {f"lag_{k}": {"lag": k} for k in (0, 1, 2, 5)} | ({"next_open": {"fill": "next_open"}} if "open" in weighted.columns else {})
    found = {r["scenario"]: r.asDict() for r in execution.scenario_table(weighted, scenarios | lags, periods, since).collect()}
    sharpe = {k: v["sharpe"] for k, v in found.items()}

    sim = execution.simulate(weighted, ["symbol"], costs_of(cfg), e.fill, e.lag, e.capital)
    sim = materialize(sim.where(F.col("timestamp") >= F.lit(since)) if since is not None else sim, "simulation")
    port = materialize(execution.portfolio(sim), "portfolio")
    m = port.agg(F.avg("gross").alias("g"), F.avg("turnover").alias("t"), F.avg("cost").alias("c"), F.sum("gross").alias("sg"), F.sum("cost").alias("sc")).first()
    be = execution.break_even(m["g"] or 0.0, m["t"] or 0.0, m["c"] or 0.0)
    scaled = {x: port.select("timestamp", (F.col("gross") - x * F.col("cost")).alias("ret")) for x in e.cost_multipliers}
    stacked = None
    for x, one in scaled.items():
        one = one.withColumn("multiplier", F.lit(float(x)))
        stacked = one if stacked is None else stacked.unionByName(one)
    by_cost = {r["multiplier"]: r["sharpe"] for r in moments.sharpe_by(stacked, "ret", ["multiplier"], periods).collect()} if stacked is not None else {}
    gross = moments.sharpe_by(port.withColumn("_all", F.lit(0)), "gross", ["_all"], periods).first()["sharpe"]
    turnover = execution.turnover_statistics(sim).first().asDict()

    head = "declared" if "declared" in sharpe else "naive"
    top, real, cost = sharpe.get(head), sharpe.get("audit"), one_way(declared)
    kept = real / top if top is not None and top > 0 and real is not None else None
    reasons = ([] if declared else ["nothing is declared"]) + (["fills at the signal's own bar"] if declared.get("signal_lag") == 0 else []) + (["no costs"] if declared and cost == 0 else [])
    lost = top is not None and top >= 0.5 and (kept is None or kept < 0.25)
    grade = S.FAIL if reasons and lost else S.WARN if declared.get("signal_lag") == 0 else S.PASS
    out.append(Finding("EXEC-001", grade, f"Sharpe ratio {_number(top)} ({head}" + (f": {', '.join(reasons)}" if reasons else "") + f"), {_number(real)} under the audit's assumptions", {"headline": head, "kept": kept, "sharpe": sharpe}))
    out.append(Finding("EXEC-002", S.WARN if not declared or cost == 0 else S.INFO if cost < one_way(e) else S.PASS, f"declared costs of {cost:.1f} bps a trade; the audit takes {one_way(e):.1f}"))
    thin = gross is not None and gross > 0 and (real is None or real <= 0 or be.multiplier is None or be.multiplier < 2)
    out.append(Finding("EXEC-003", S.WARN if thin else S.PASS if real is not None and real > 0 else S.INFO, f"costs could grow {_number(be.multiplier)} times, to {_number(be.bps, '.1f')} bps a trade" if be.multiplier is not None else "there is no gross profit to lose", {"bps": be.bps, "multiplier": be.multiplier}))
    drag = m["sc"] / m["sg"] if m["sg"] and m["sg"] > 0 else None
    out.append(Finding("EXEC-004", S.WARN if drag is not None and drag >= 0.5 else S.INFO, f"turnover of {_number(turnover['annual_turnover'], '.1f')} a year; costs take {_number(drag, '.0%')} of gross profit", {"drag": drag, **turnover}))
    attribution = [r.asDict() for r in execution.attribution(port, sim, periods).collect()]
    yearly = [r.asDict() for r in execution.turnover_by_year(sim).orderBy("year").collect()]
    section = {"scenarios": found, "cost_sensitivity": by_cost, "attribution": attribution, "turnover": turnover | {"years": yearly}, "break_even": {"bps": be.bps, "multiplier": be.multiplier}, "declared": declared}
    return out, section, port.select("timestamp", F.col("net").alias("ret"))


def audit(spark: SparkSession, strategy=None, data=None, config: Config | None = None, artifacts: Artifacts | None = None, benchmark=None, timestamp_column: str | None = None, symbol_column: str | None = None) -> Result:
    """Strategy mode with a strategy, results mode with artifacts; a strategy without data gets the code checks alone. benchmark: a table or path of returns."""
    cfg = (config or Config()).effective()
    found = load_returns(spark, benchmark) if benchmark is not None else None
    if strategy is not None:
        return _audit_strategy(spark, load_strategy(strategy), data, cfg, found, timestamp_column, symbol_column)
    if artifacts is not None:
        return _audit_results(spark, artifacts.validate(), cfg, found, data)
    raise DataError("give a strategy, or artifacts")


def _manifest(cfg: Config, lineage: Lineage, strategy: dict, data: dict, parameters: dict | None = None) -> dict:
    """What the audit ran on. The content hash leaves out the time; one fingerprint each for code, data, settings, parameters and environment."""
    import datetime as dt

    import pyspark

    environment = {"python": platform.python_version(), "spark": pyspark.__version__, "platform": platform.platform(terse=True)}
    body = {"strategy": strategy, "data": data, "parameters": parameters or {}, "config": cfg.model_dump(), "seed": cfg.seed, "environment": environment, "lineage": lineage.to_list()}
    body["fingerprints"] = {k: canonical_hash(body[p]) for k, p in (("code", "strategy"), ("data", "data"), ("config", "config"), ("parameters", "parameters"), ("environment", "environment"))}
    return body | {"content": canonical_hash(body), "created": dt.datetime.now(dt.UTC).isoformat()}


def _strategy_info(s: Strategy) -> dict:
    text = s.source
    if text is None:
        try:
            text = inspect.getsource(s.generate)
        except (TypeError, OSError):
            text = None
    return {"file": s.file, "sha256": hashlib.sha256(text.encode()).hexdigest() if text else None, "execution": s.execution}


def _prices(spark: SparkSession, data, cfg: Config, lineage: Lineage, timestamp_column: str | None = None, symbol_column: str | None = None) -> tuple[DataFrame, list[Finding], dict]:
    """Prepared bars, written; the findings on the raw ones; and what the manifest says of them."""
    raw = materialize(load_raw(spark, data, timestamp_column, symbol_column), "raw")
    rows, log = prepare.prepare(raw, "_seq", ("symbol",))
    bars = materialize(rows.drop("_seq"), "bars")
    close = prepare.price_column(bars)
    bars = bars.withColumns({c: F.col(close) for c in quality.PRICES if c not in bars.columns} | ({} if "volume" in bars.columns else {"volume": F.lit(None).cast("double")}))
    found = validate_data(raw, cfg, log, raw_times(spark, data, timestamp_column, symbol_column), bars)
    info = {"source": data if isinstance(data, str) else type(data).__name__, "sha256": fingerprint(raw), "schema": raw.dtypes}
    lineage.record("prepare", inputs={"raw": info["sha256"]}, outputs={"bars": fingerprint(bars)}, notes=log)
    return bars, found, info


def _reference(bars: DataFrame) -> DataFrame:
    """(timestamp, ret): mean over symbols of the returns on the whole calendar."""
    w = Window.partitionBy("symbol").orderBy("timestamp")
    grid = prepare.completed(bars, "close")
    return grid.withColumn("ret", wn.pct_change(F.col("close"), w)).groupBy("timestamp").agg(F.avg("ret").alias("ret"))


def _foresight(weighted: DataFrame) -> Finding:
    w = Window.partitionBy("symbol").orderBy("timestamp")
    hits = leakage.foresight(weighted.withColumn("ret", wn.pct_change(F.col("close"), w)), ["symbol"]).first()
    rate, p, leak = leakage.foresight_reading(hits["n"], hits["hits"])
    return Finding("LEAK-003", S.FAIL if leak else S.PASS, f"signs hit {rate:.2f} of next returns" if rate is not None else "too few signs to judge", {"n": hits["n"], "p": p})


#: Settings of a grid that share one plan; each lot is written before the next.
GRID_LOT = 20


def _grid(s: Strategy, bars: DataFrame, cfg: Config) -> tuple[DataFrame | None, list[dict], list[str], list]:
    """(trial, timestamp, ret) of all settings, the settings, the errors of those that fail, and the first decisions."""
    e, trials, sets, errors, starts = cfg.execution, None, [], [], []
    every = s.grid(cfg.validation.most_trials, cfg.seed)
    for at in range(0, len(every), GRID_LOT):
        lot = None
        for params in every[at : at + GRID_LOT]:
            try:
                weights = materialize(s(causality.Bars(bars), **params).select("symbol", "timestamp", "weight"), "weights")
            except Exception as x:  # a strategy is foreign code
                errors.append(f"{params}: {type(x).__name__}: {str(x).splitlines()[0] if str(x) else ''}")
                continue
            starts.append(weights.where("weight is not null").agg(F.min("timestamp")).first()[0])
            one = bars.join(weights, ["symbol", "timestamp"], "left")
            one = execution.portfolio(execution.simulate(one, ["symbol"], costs_of(cfg), e.fill, e.lag, e.capital)).select(F.lit(len(sets)).alias("trial"), "timestamp", F.col("net").alias("ret"))
            lot = one if lot is None else lot.unionByName(one)
            sets.append(params)
        if lot is not None:
            lot = materialize(lot, "grid")
            trials = lot if trials is None else trials.unionByName(lot)
    return trials, sets, errors, [x for x in starts if x is not None]


def _audit_strategy(spark: SparkSession, s: Strategy, data, cfg: Config, benchmark: DataFrame | None, timestamp_column: str | None, symbol_column: str | None) -> Result:
    lineage = Lineage()
    settings = cfg.code
    out = code.analyse(s.source, s.file, tuple(settings.disabled), most=settings.most_settings) if s.source and settings.enabled else [Finding("META-STATIC", S.INFO, "no source to read")]
    if data is None:
        return Result([*out, Finding("META-RUNTIME", S.INFO, "no data were given, so the strategy was not run")], {}, _manifest(cfg, lineage, _strategy_info(s), {}))
    bars, found, info = _prices(spark, data, cfg, lineage, timestamp_column, symbol_column)
    out += found
    signals = s(causality.Bars(bars))
    out += code.inspect_plan(signals)
    signals = materialize(prepare.panel_signals(signals, bars), "signals")
    lineage.record("signals", inputs={"bars": lineage.steps[-1].outputs["bars"]}, outputs={"signals": fingerprint(signals)}, parameters=s.params)
    found, moved = judge_causality(s, bars, cfg)
    out += found
    weighted = materialize(bars.join(signals, ["symbol", "timestamp"], "left"), "weighted")
    out.append(_foresight(weighted))
    start = signals.where("weight is not null").agg(F.min("timestamp")).first()[0]
    trials, sets, errors, starts = _grid(s, bars, cfg)
    since = max([x for x in [start, *starts] if x is not None], default=None)
    found, executed, net = judge_execution(weighted, s.execution, cfg, since)
    out += found
    lineage.record("simulate", inputs={"signals": lineage.steps[-1].outputs["signals"]}, outputs={"net": fingerprint(net)})
    if trials is not None and since is not None:
        trials = trials.where(F.col("timestamp") >= F.lit(since))
    n_trials = cfg.statistics.trials or max(1, len(sets))
    sharpe = {k: executed["scenarios"][k]["sharpe"] for k in ("naive", "declared") if k in executed["scenarios"]}
    found, stats = judge_statistics(net, cfg, n_trials, bool(sets) or cfg.statistics.trials is not None, trials if len(sets) > 1 else None, sharpe)
    out += found
    sections: dict = {"statistics": stats, "execution": executed, "causality": [r.asDict() for r in moved], "grid": {"settings": len(sets), "errors": errors}}
    if len(sets) > 1:
        found, sections["validation"] = judge_selection(trials, cfg)
        out += found
        names = [n for n in sorted(s.grid_values) if len({p[n] for p in sets}) > 1]
        numeric = all(isinstance(p[n], int | float) and not isinstance(p[n], bool) for n in names for p in sets)
        table = spark.createDataFrame([(k, *[float(p[n]) for n in names]) for k, p in enumerate(sets)], f"trial int, {', '.join(f'`{n}` double' for n in names)}") if names and numeric else None
        found, sections["sensitivity"] = judge_sensitivity(trials, table, names if numeric else [], cfg)
        out += found
    else:
        found, sections["validation"] = judge_single(net, cfg)
        out += found
    found, sections["regimes"] = judge_regimes(net, benchmark if benchmark is not None else _reference(bars), cfg, benchmark is not None)
    out += found
    sections["charts"] = {"equity": _equity(net)}
    return Result(out, sections, _manifest(cfg, lineage, _strategy_info(s), info, {"defaults": s.params, "grid": s.grid_values, "settings": len(sets)}))


def _equity(returns: DataFrame) -> list[list]:
    """At most 400 points of the equity curve of one series."""
    rows = returns.select("timestamp", wn.equity(F.col("ret"), Window.orderBy("timestamp")).alias("equity"))
    return [[str(r["timestamp"]), r["equity"]] for r in prepare.downsampled(rows).orderBy("timestamp").collect()]


def _audit_results(spark: SparkSession, a: Artifacts, cfg: Config, benchmark: DataFrame | None, data=None) -> Result:
    lineage, sections, info = Lineage(), {}, {}
    out = [Finding("META-STATIC", S.INFO, "no code was given"), Finding("CAUSAL-001", S.INFO, "no strategy was given, so none was run")]
    prices = asset = None
    if data is not None or a.prices is not None:
        prices, found, info = _prices(spark, data if data is not None else a.prices, cfg, lineage)
        out += found
        asset = materialize(_reference(prices), "reference")
    returns, trials = a.returns, a.trial_returns
    if returns is None and trials is not None:
        best = moments.sharpe_by(selection.finite_matrix(trials), "ret", ["trial"]).orderBy(F.desc_nulls_last("sharpe"), "trial").first()["trial"]
        returns, sections["note"] = trials.where(F.col("trial") == best).select("timestamp", "ret"), f"no returns were given; trial {best} has the best Sharpe ratio"
    if returns is not None:
        returns = prepare.clean_returns(returns.select("timestamp", "ret"), "ret")
        lineage.record("returns", outputs={"returns": fingerprint(returns)})
    if a.trades is not None and {"signal_time", "execution_time"} <= set(a.trades.columns):
        kinds = {dict(a.trades.dtypes)[c] for c in ("signal_time", "execution_time")}
        if kinds == {"timestamp", "timestamp_ntz"}:
            raise DataError("one of the ledger's times has a time zone and the other has none")
        t = execution.timing(a.trades).first().asDict()
        n = t["n_trades"] or 1
        latency = {k: folds.format_seconds(t[f"{k}_seconds"]) for k in ("min", "median", "max")}
        out.append(Finding("EXEC-005", S.FAIL if t["n_before_signal"] else S.WARN if t["n_instant"] > n / 2 else S.PASS, f"{t['n_before_signal']} of {t['n_trades']} trades before their signal; median latency {latency['median']}", t | {"latency": latency}))
        sections.setdefault("execution", {})["timing"] = t
    if a.positions is not None:
        held = a.positions if "symbol" in a.positions.columns else a.positions.withColumn("symbol", F.lit("_"))
        value = prepare.one_column(held, "positions", ("timestamp", "symbol"))
        trades = held.withColumn("trade", wn.diff_from_zero(F.col(value), Window.partitionBy("symbol").orderBy("timestamp")))
        sections.setdefault("execution", {})["turnover"] = execution.turnover_statistics(trades, cfg.statistics.periods).first().asDict()
    if a.features is not None and (returns is not None or asset is not None or a.target is not None):
        names, table, target = [c for c, k in a.features.dtypes if k in prepare.NUMERIC], a.features, None
        ahead = asset if asset is not None else returns
        table = table.join(ahead.select("timestamp", F.col("ret").alias("_ret")), "timestamp", "left") if ahead is not None else table.withColumn("_ret", F.lit(None).cast("double"))
        if a.target is not None:
            value = prepare.one_column(a.target, "the target")
            table, target = table.join(a.target.select("timestamp", F.col(value).cast("double").alias("_target")), "timestamp", "left"), "_target"
        corrs = leakage.feature_correlations(table, names, "_ret", target)
        if target:
            copies = leakage.leaking(corrs.where("lead = 0")).collect()
            out.append(Finding("LEAK-001", S.FAIL if copies else S.PASS, f"{[r['feature'] for r in copies]} equal the target" if copies else "no feature equals the target"))
        if ahead is not None:
            leaks = leakage.leaking(corrs.where("lead > 0")).collect()
            out.append(Finding("LEAK-002", S.FAIL if leaks else S.PASS, f"{[r['feature'] for r in leaks]} equal later returns" if leaks else "no feature equals later returns"))
    if a.signals is not None and prices is not None:
        raw = a.signals
        if prices.select("symbol").distinct().count() == 1 and "symbol" not in raw.columns:
            raw = prepare.single_signal(raw, prices).crossJoin(F.broadcast(prices.select("symbol").limit(1)))
        weighted = prices.join(prepare.panel_signals(raw, prices), ["symbol", "timestamp"], "left")
        out.append(_foresight(weighted))
    if returns is not None:
        n_trials = cfg.statistics.trials or (trials.select("trial").distinct().count() if trials is not None else 1)
        found, sections["statistics"] = judge_statistics(returns, cfg, n_trials, trials is not None or cfg.statistics.trials is not None, trials)
        out += found
        bench = benchmark if benchmark is not None else a.benchmark
        if bench is not None and "ret" not in bench.columns:
            bench = bench.select("timestamp", F.col(prepare.one_column(bench, "the benchmark")).alias("ret"))
        reference = bench if bench is not None else asset if asset is not None else returns
        found, sections["regimes"] = judge_regimes(returns, reference, cfg, bench is not None)
        out += found
        sections["charts"] = {"equity": _equity(returns)}
    if trials is not None:
        found, sections["validation"] = judge_selection(trials, cfg)
        out += found
        params, names = a.trial_params, []
        if params is not None:
            if "trial" not in params.columns:
                ids = sorted(r[0] for r in trials.select("trial").distinct().collect())  # a row a trial, in the order of the parameters' rows
                params = folds.positions(params.withColumn("_row", F.monotonically_increasing_id()), "_row").drop("_row")
                params = params.join(F.broadcast(spark.createDataFrame(list(enumerate(ids)), f"pos long, trial {dict(trials.dtypes)['trial']}")), "pos").drop("pos")
            kinds = {c: k for c, k in params.dtypes if c != "trial" and k in prepare.NUMERIC}
            several = params.agg(*[F.count_distinct(c).alias(c) for c in kinds]).first().asDict() if kinds else {}
            names = [c for c, n in several.items() if n > 1]
        found, sections["sensitivity"] = judge_sensitivity(trials, params if names else None, names, cfg)
        out += found
    elif returns is not None:
        found, sections["validation"] = judge_single(returns, cfg)
        out += found
    return Result(out, sections | ({"notes": a.notes} if a.notes else {}), _manifest(cfg, lineage, {"metadata": a.metadata}, info))
