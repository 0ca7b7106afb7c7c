"""Code rules, plan inspection, causality, settings, reports, sources, streams and the audit end to end."""

import json
import os
import shutil
from datetime import datetime

import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidelock import __main__ as cli
from tidelock.audit import code, config, engine, reports
from tidelock.audit.findings import RULES, Finding, Result, Severity
from tidelock.errors import ConfigError, DataError
from tidelock.operators import causality, prepare
from tidelock.operators import windows as wn
from tidelock.sources import tables
from tidelock.streaming import monitor

BROKEN = {
    "CODE-001": "signal = df.close.shift(-1)",
    "CODE-002": "signal = x.rolling(5, center=True).mean()",
    "CODE-003": "for i in range(9):\n    signal = p[i + 1]",
    "CODE-004": "a, b = train_test_split(df)",
    "CODE-005": "cv = KFold(5, shuffle=True)",
    "CODE-006": "x = scaler.fit_transform(df)\ntrain_test_split(x, shuffle=False)",
    "CODE-007": "z = (x - x.mean()) / x.std()",
    "CODE-008": "X = df[['a', 'target']]",
    "CODE-009": "EXECUTION = {'signal_lag': 0}",
    "CODE-010": "signal = a > b\npnl = signal * returns",
    "CODE-011": "sharpe = returns.mean()",
    "CODE-012": "nxt = df.close.shift(-1)\nz = nxt * 2\nsignal = z > 0",
    "CODE-013": "grid = {'a': [1, 2, 3], 'b': [1, 2]}",
    "CODE-014": "m.fit(a, b)",
    "CODE-015": "signal = x.bfill()",
}


@pytest.mark.parametrize("rule", BROKEN)
def test_each_code_rule(rule):
    found = [f for f in code.analyse(BROKEN[rule]) if f.rule == rule]
    assert found and found[0].severity >= (Severity.INFO if rule == "CODE-013" else Severity.WARN)


# More ways to the same faults, each with the severity that it has.
MORE = [
    ("CODE-001", "K = -1\ndef f(d):\n    return d.close.shift(K)\nsignal = f(df)", Severity.FAIL),
    ("CODE-001", "move = df.close.shift\nsignal = move(-2)", Severity.FAIL),
    ("CODE-001", "def by(d, k):\n    return d.close.shift(k)\nsignal = by(df, -1)", Severity.FAIL),
    ("CODE-001", "a = df.close.shift(-1)\nb = a * 2\nsignal = b > 0", Severity.FAIL),
    ("CODE-001", "a = df.close.shift(-1)\ntarget = a > 0", Severity.INFO),
    ("CODE-002", "w = Window.orderBy('t').rowsBetween(-2, 2)", Severity.FAIL),
    ("CODE-002", "signal = x.rolling(5, center=flag).mean()", Severity.WARN),
    ("CODE-003", "import numpy as np\nsignal = np.roll(p, -1)", Severity.FAIL),
    ("CODE-003", "m.fit(df[['future_ret', 'b']], y)", Severity.WARN),
    ("CODE-005", "GridSearchCV(m, g, cv=5)", Severity.INFO),
    ("CODE-006", "z = scaler.fit_transform(other)\na, b = train_test_split(df, shuffle=False)", Severity.WARN),
    ("CODE-007", "mu = x.mean()\nsd = x.std()\nz = (x - mu) / sd", Severity.WARN),
    ("CODE-008", "df['copy'] = df['target']\nX = df[['a', 'copy']]", Severity.FAIL),
    ("CODE-008", "X = df\ny = df['target']\nm.fit(X, y)", Severity.FAIL),
    ("CODE-008", "m.fit(z, z)", Severity.FAIL),
    ("CODE-009", "sig = signal.shift(1)\npnl = sig_position.shift(1) * returns", Severity.WARN),
    ("CODE-009", "# we assume a same-bar close\npnl = position.shift(1) * returns", Severity.INFO),
    ("CODE-010", "df['signal'] = df['close'] > df['close'].rolling(5).mean()\npnl = df['signal'] * df['returns']", Severity.FAIL),
    ("CODE-010", "pnl = signal_of(x) * returns", Severity.WARN),
    ("CODE-011", "EXECUTION = {'commission_bps': 0, 'spread_bps': 0}", Severity.WARN),
    ("CODE-012", "def f(d):\n    d['z'] = d.close.shift(-1)\nf(df)\nm.fit(df[['z', 'b']], y)", Severity.FAIL),
    ("CODE-012", "def g(x):\n    return x * 2\na = df.close.shift(-1)\nif flag:\n    c = g(a)\nelse:\n    c = 0\nsignal = c > 0", Severity.FAIL),
    ("CODE-013", "from itertools import product\nfor a, b in product(range(20), range(10)):\n    pass", Severity.WARN),
    ("CODE-013", "for a in range(30):\n    for b in [1, 2, 3, 4, 5]:\n        run(a, b)", Severity.WARN),
    ("CODE-013", "grid = ParamGridBuilder().addGrid(m.a, [1, 2]).addGrid(m.b, [1, 2, 3]).build()", Severity.INFO),
    ("CODE-014", "s = GridSearchCV(m, g)\ns.fit_transform(a)", Severity.WARN),
    ("CODE-015", "signal = np.convolve(x, k, 'same')", Severity.FAIL),
]


@pytest.mark.parametrize(("rule", "source", "severity"), MORE)
def test_each_code_rule_in_other_words(rule, source, severity):
    assert severity in [f.severity for f in code.analyse(source) if f.rule == rule]


# What looks like a fault and is none.
FINE = [
    ("CODE-001", "x = df.close.shift(1)"), ("CODE-003", "for i in range(9):\n    signal = p[i - 1]"), ("CODE-005", "GridSearchCV(m, g, cv=TimeSeriesSplit(5))"),
    ("CODE-007", "z = (x - x.mean(axis=1)) / x.std(axis=1)"), ("CODE-008", "X = df.drop(columns=['target'])\ny = df['target']\nm.fit(X, y)"),
    ("CODE-010", "signal = df['open'] > df['open'].shift(1)\npnl = signal * returns"), ("CODE-010", "signal = (df['close'] > 1).shift(1)\npnl = signal * returns"),
    ("CODE-012", "a = df.close.shift(-1)\na = df.close.shift(1)\nsignal = a > 0"), ("CODE-012", "def f(d):\n    a = d.close.shift(-1)\n    return d.open\nsignal = f(df)"), ("CODE-014", "a, b = train_test_split(df)\nm.fit(a)"),
]


@pytest.mark.parametrize(("rule", "source"), FINE)
def test_what_is_no_fault(rule, source):
    assert not [f for f in code.analyse(source) if f.rule == rule and f.severity >= Severity.WARN]


def test_results_mode_with_prices_signals_and_positions(spark):
    m = tables.synthetic(130, 4)
    rng = [((13 * i * i + 5 * i) % 29 - 14) / 900 for i in range(130)]
    frame = lambda d: spark.createDataFrame(pd.DataFrame({"timestamp": m["timestamp"]} | d)).withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))
    peek = m["close"].pct_change().shift(-1).fillna(0.0)
    art = tables.Artifacts(returns=frame({"ret": rng}), prices=spark.createDataFrame(m), signals=frame({"weight": peek.map(lambda x: 1.0 if x > 0 else -1.0)}), positions=frame({"held": [float(i // 10 % 2) for i in range(130)]}), features=frame({"f": peek}))
    r = engine.audit(spark, artifacts=art, config=quick(), benchmark=frame({"returns": rng}))
    got = severities(r.findings)
    assert got["LEAK-003"] == Severity.FAIL and got["LEAK-002"] == Severity.FAIL and got["DATA-006"] == Severity.PASS and got["VAL-001"] in (Severity.PASS, Severity.WARN)
    assert r.sections["execution"]["turnover"]["gross_turnover"] == 12.0 and r.manifest["lineage"][0]["step"] == "prepare"
    assert {"code", "data", "config", "parameters", "environment"} == set(r.manifest["fingerprints"])
    with pytest.raises(DataError):
        tables.Artifacts(returns=frame({"ret": rng}).drop("timestamp")).validate()


def test_grid_audit(spark, market):
    def mean_cross(b, fast=3, slow=10):
        w = b.ts_window()
        if fast == 7:
            raise ValueError("no such setting")
        a, z = (wn.rolling_mean(F.col("close"), w, k, k, False) for k in (fast, slow))
        return b.df.select(*b.keys, "timestamp", F.when(z.isNotNull(), (a > z).cast("double")).alias("weight"))

    s = engine.Strategy(mean_cross, {}, {"fast": [2, 4, 7], "slow": [8, 12]}, {"signal_lag": 0})
    r = engine.audit(spark, s, market, quick(causality={"enabled": False}, statistics={"replicates": 30, "least": 20}))
    got = severities(r.findings)
    assert r.sections["grid"]["settings"] == 4 and len(r.sections["grid"]["errors"]) == 2
    assert {"VAL-001", "VAL-002", "VAL-003", "VAL-004", "SENS-001", "SENS-002", "STAT-003", "EXEC-001", "META-RUNTIME"} <= set(got) and got["EXEC-001"] >= Severity.WARN
    assert len(r.sections["validation"]["paths"]["sharpes"]) == 5 and r.sections["sensitivity"]["heatmap"]["x"] == "fast" and "*" in r.sections["sensitivity"]["map"]
    page = reports.to_html(r)
    assert page.count("<svg") >= 4 and "Parameter surface" in page and "Combinatorial paths" in reports.to_markdown(r) and "Walk-forward" in reports.to_text(r, True)


def test_data_rules_on_raw_rows(spark):
    rows = [("2024-01-01", "A", 10.0, 11.0, 9.0, 10.0), ("2024-01-01", "A", 10.0, 11.0, 9.0, 10.5), ("2024-01-02", "A", 10.0, 9.0, 9.5, 10.0), ("2024-01-03", "A", 10.0, 11.0, 9.0, 40.0), ("2024-01-01", "B", 5.0, 5.0, 5.0, -5.0), ("2024-01-02", "B", 5.0, float("inf"), 5.0, 5.0), ("2024-01-03", "B", None, 5.0, 5.0, 5.0), ("2024-01-03", "B", None, 5.0, 5.0, 5.0)]
    raw = tables.load_raw(spark, spark.createDataFrame(rows, "date string, ticker string, open double, high double, low double, close double").coalesce(1))
    prepared, _ = prepare.prepare(raw, "_seq", ("symbol",))
    found = {f.rule: f for f in engine.validate_data(raw, quick(), prepared=prepared)}
    levels = {r: f.severity for r, f in found.items()}
    assert levels["DATA-004"] == Severity.WARN and found["DATA-004"].evidence["examples"] == ["2024-01-01 00:00:00", "2024-01-03 00:00:00"] and levels["DATA-005"] == Severity.WARN
    assert levels["DATA-006"] == levels["DATA-007"] == levels["DATA-012"] == Severity.FAIL and found["DATA-006"].evidence["symbols"] == ["A", "B"]
    assert found["DATA-008"].evidence["columns"] == {"open": 2} and found["DATA-013"].evidence["worst"]["symbol"] == "A" and levels["DATA-015"] == Severity.PASS
    off = engine.validate_data(raw, config.from_dict({"data": {"disabled": ["DATA-004", "DATA-006"]}}))
    assert not {"DATA-004", "DATA-006"} & {f.rule for f in off} and engine.validate_data(raw, config.from_dict({"data": {"enabled": False}})) == []
    assert [f.rule for f in engine.validate_data(raw.limit(0), quick())] == ["DATA-014"]


def test_pandas_indexes_and_signals(spark):
    days = pd.bdate_range("2024-01-01", periods=3)
    index = pd.MultiIndex.from_product([["A", "B"], days])
    flat = tables.load(spark, pd.DataFrame({"Close": [1.0, 2, 3, 4, 5, 6]}, index=index))
    assert set(flat.columns) == {"symbol", "timestamp", "close"} and flat.count() == 6
    assert set(tables.load(spark, pd.Series([1.0, 2.0], index=days[:2], name="p")).columns) == {"timestamp", "p"}
    with pytest.raises(DataError):
        tables.flat(pd.DataFrame({"x": [1.0]}, index=pd.MultiIndex.from_tuples([("A", "B")])))
    prices = flat.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))
    wide = prices.groupBy("timestamp").pivot("symbol", ["A", "B"]).agg(F.first("close")).where(F.col("timestamp") > F.lit("2024-01-01"))
    got = prepare.panel_signals(wide, prices).orderBy("symbol", "timestamp").collect()
    assert [r.weight for r in got] == [None, 2.0, 3.0, None, 5.0, 6.0]
    for bad in (prices.withColumn("symbol", F.lit("C")), prices.withColumn("timestamp", F.expr("timestamp + interval 9 days"))):
        with pytest.raises(DataError):
            prepare.panel_signals(bad.withColumnRenamed("close", "weight"), prices)
    one = prepare.of_symbol(prices, "A")
    assert [r.weight for r in prepare.single_signal([1, None, 3], one).orderBy("timestamp").collect()] == [1.0, None, 3.0]
    with pytest.raises(DataError):
        prepare.single_signal([1.0], one)
    with pytest.raises(DataError):
        prepare.clean_returns(one.withColumn("close", F.lit(float("inf"))), "close")
    with pytest.raises(DataError):
        prepare.clean_returns(one.withColumn("close", F.lit(None).cast("double")), "close", missing="raise")


def test_tables_of_returns(spark, tmp_path):
    with pytest.raises(DataError):
        tables.time_indexed(spark.createDataFrame([("2024-01-01", 1.0), ("2024-01-01", 2.0)], "date string, x double"), None, "x")
    with pytest.raises(DataError):
        tables.ResultsAdapter(spark, "a", "b")
    path = tables.export_synthetic(f"{tmp_path}/m.csv", 30)
    assert tables.load_prices(spark, path)[0].count() == 30 and tables.load_prices(spark, tables.export_synthetic(f"{tmp_path}/m.parquet", 30))[0].count() == 30
    with pytest.raises(DataError):
        tables.export_synthetic(f"{tmp_path}/m.xls")
    pd.DataFrame({"date": ["2024-01-01", "2024-01-02"], "b": [0.1, 0.2], "a": [1.0, 2.0]}).to_csv(f"{tmp_path}/t.csv", index=False)
    assert sorted((r.trial, r.ret) for r in tables.load_trials(spark, tables.load(spark, f"{tmp_path}/t.csv").select("date", F.col("b").cast("double").alias("b"), F.col("a").cast("double").alias("a"))).collect()) == [(0, 0.1), (0, 0.2), (1, 1.0), (1, 2.0)]


@pytest.mark.parametrize("ok", ["signal = close.shift(1) > 0  # cost", "target = close.shift(-1)  # a label; cost", "z = (x - x.rolling(20).mean()) / x.rolling(20).std()  # cost", "w = Window.orderBy('t').rowsBetween(-5, 0)"])
def test_legitimate_code(ok):
    assert not [f for f in code.analyse(ok) if f.severity == Severity.FAIL]


def test_suppression_helpers_and_bad_source():
    assert code.analyse("signal = df.close.shift(-1)  # audit: ignore[CODE-001] cost")[0].severity == Severity.INFO
    helper = "def f(d):\n    return d.close.shift(-1)\nsignal = f(df)"
    assert any(f.rule == "CODE-012" for f in code.analyse(helper))
    assert code.analyse("def (")[0].rule == "CODE-000"
    assert all(r in RULES for r in code.RULES)


def test_plan_inspection(spark):
    df = spark.range(5).select(F.col("id").alias("t"), F.col("id").cast("double").alias("x"))
    w = Window.orderBy("t")
    assert code.inspect_plan(df.select(F.lead("x").over(w)))[0].rule == "CODE-001"
    assert code.inspect_plan(df.select(F.avg("x").over(w.rowsBetween(-1, 1))))[0].rule == "CODE-002"
    assert code.inspect_plan(df.select(F.avg("x").over(Window.partitionBy("t"))))[0].rule == "CODE-007"
    assert code.inspect_plan(df.select(F.lag("x").over(w), F.avg("x").over(w.rowsBetween(-3, 0)))) == []


def trailing(b):
    w = b.ts_window()
    return b.df.select(*b.keys, "timestamp", (F.col("close") > wn.rolling_mean(F.col("close"), w, 10, 1, False)).cast("double").alias("weight"))


def peeking(b):
    return b.df.select(*b.keys, "timestamp", (F.lead("close").over(b.ts_window()) > F.col("close")).cast("double").alias("weight"))


@pytest.fixture(scope="module")
def market(spark):
    return spark.createDataFrame(tables.synthetic(160, 3)).withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz")).withColumn("symbol", F.lit("_"))


def test_causality(market):
    good = causality.run(trailing, market, k=2).collect()
    bad = causality.run(peeking, market, k=2).collect()
    assert len(good) == len(bad) == 10 and all(r.n_changed == 0 for r in good)
    assert sum(r.n_changed > 0 for r in bad) >= 4


def test_perturbed_rows_keep_the_past_and_valid_bars(spark, market):
    cut = market.select(F.expr("percentile_approx(timestamp, 0.5)").alias("c")).first()[0]
    trials = spark.createDataFrame([(i, cut, s) for i, s in enumerate(causality.SCHEMES)], "trial int, cutoff timestamp_ntz, scheme string")
    p = causality.perturb(market, trials).join(market.select("timestamp", F.col("close").alias("c0")), "timestamp")
    stats = p.groupBy("scheme").agg(F.count_if((F.col("timestamp") <= F.col("cutoff")) & (F.col("close") != F.col("c0"))).alias("past"), F.count_if((F.col("timestamp") > F.col("cutoff")) & (F.col("close") != F.col("c0"))).alias("future"), F.count_if((F.col("low") > F.col("high")) | (F.col("low") <= 0)).alias("odd")).collect()
    assert len(stats) == 5 and all(r.past == 0 and r.future > 0 and r.odd == 0 for r in stats)


def test_audits_end_to_end(spark, market, tmp_path):
    cfg = config.from_dict({"profile": "quick", "causality": {"cutoffs": 2}, "statistics": {"replicates": 50}, "regimes": {"volatility_rows": 20}})
    bad = engine.audit(spark, engine.Strategy(peeking, source="def generate_signals(b):\n    signal = b.close.shift(-1)\n    return signal  # cost"), market, cfg)
    assert bad.status == "FAIL" and {"CAUSAL-001", "CODE-001"} <= {f.rule for f in bad.issues()}
    good = engine.audit(spark, engine.Strategy(trailing), market, cfg)
    assert not any(f.rule == "CAUSAL-001" for f in good.issues())
    for suffix in (".json", ".md", ".html", ".txt"):
        reports.write(bad, f"{tmp_path}/r{suffix}")
    again = reports.from_json(f"{tmp_path}/r.json")
    assert again.status == bad.status and reports.to_json(again) == reports.to_json(bad)


def quick(**parts):
    return config.from_dict({"profile": "quick", "causality": {"cutoffs": 2}, "statistics": {"replicates": 30}, "regimes": {"volatility_rows": 20}, "validation": {"blocks": 4}} | parts)


def severities(found):
    return {f.rule: f.severity for f in found}


def test_causality_findings(market):
    judge = lambda s: severities(engine.judge_causality(s, market, quick())[0])

    def drawn(b):
        return b.df.select(*b.keys, "timestamp", F.rand().alias("weight"))

    def failing(b):
        return trailing(b).withColumn("weight", F.when(F.col("trial") == 3, F.raise_error(F.lit("odd"))).otherwise(F.col("weight"))) if "trial" in b.keys else trailing(b)

    def deaf(b):
        return b.df.select(*b.keys, "timestamp", F.lit(1.0).alias("weight"))

    ok = judge(trailing)
    assert ok == dict.fromkeys(("CAUSAL-001", "CAUSAL-002", "CAUSAL-003", "CAUSAL-004"), Severity.PASS)
    assert judge(drawn) == {"CAUSAL-002": Severity.WARN}
    assert judge(failing) == ok | {"CAUSAL-003": Severity.INFO}
    assert judge(deaf) == ok | {"CAUSAL-004": Severity.INFO}


def test_raw_times_are_judged(spark):
    raw = spark.createDataFrame([("2024-01-02 00:00:00", 1.5), ("2024-01-01T00:00:00+02:00", 1.0), ("2024-01-03T00:00:00+01:00", 2.0), ("bad", 3.0)], "date string, close double").coalesce(1)
    bars, log = tables.load_prices(spark, raw)
    got = severities(engine.validate_data(bars, quick(), log, tables.raw_times(spark, raw)))
    assert {r: got[r] for r in ("DATA-001", "DATA-002", "DATA-010")} == dict.fromkeys(("DATA-001", "DATA-002", "DATA-010"), Severity.WARN)


def test_target_and_ranks(spark):
    days = pd.bdate_range("2020-01-01", periods=80)
    noise = [((7 * i * i + 3 * i) % 31 - 15) / 1000 for i in range(80)]
    frame = lambda d: spark.createDataFrame(pd.DataFrame({"timestamp": days} | d)).withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))
    trials = [(d, k, x + (k - 1) * (0.01 if i < 40 else -0.01)) for k in range(3) for i, (d, x) in enumerate(zip(days.to_pydatetime(), noise, strict=True))]
    art = tables.Artifacts(returns=frame({"ret": noise}), features=frame({"a": noise, "b": [i % 7 / 1.0 for i in range(80)]}), target=frame({"y": [2 * x for x in noise]}), trial_returns=spark.createDataFrame(trials, "timestamp timestamp_ntz, trial int, ret double"))
    found = engine.audit(spark, artifacts=art, config=quick())
    got = severities(found.findings)
    assert got["LEAK-001"] == Severity.FAIL and got["LEAK-002"] == Severity.PASS and got["SENS-002"] == Severity.WARN


def test_delay_and_every_rule_has_its_place(spark, market):
    import inspect

    result = engine.audit(spark, engine.Strategy(trailing), market, quick())
    assert "EXEC-006" in severities(result.findings) and set(result.sections["regimes"]) == {"volatility", "drawdown", "trend"}
    source = inspect.getsource(engine) + inspect.getsource(code)
    assert [r for r in RULES if f'"{r}"' not in source] == []


def test_results_mode(spark, tmp_path):
    rows = pd.DataFrame({"date": pd.bdate_range("2020-01-01", periods=120).astype(str), "equity": [100 * 1.001**i * (1 + 0.01 * (i % 3)) for i in range(120)]})
    ledger = pd.DataFrame({"signal_ts": pd.to_datetime(["2020-01-02", "2020-01-03"]), "exec_time": pd.to_datetime(["2020-01-01", "2020-01-04"])})
    art = tables.ResultsAdapter(spark).load(rows, ledger)
    r = engine.audit(spark, artifacts=art, config=config.from_dict({"statistics": {"replicates": 30}, "regimes": {"volatility_rows": 20}}))
    assert next(f for f in r.findings if f.rule == "EXEC-005").severity == Severity.FAIL
    with pytest.raises(DataError):
        tables.Artifacts().validate()
    with pytest.raises(DataError):
        tables.TableAdapter(spark).load({"nonsense": rows})


def test_preparation(spark):
    raw = spark.createDataFrame([("2024-01-02", "1.5"), ("2024-01-01", "1"), ("2024-01-02", "2"), ("bad", "3")], "Date string, `Adj Close` string")
    bars, log = tables.load_prices(spark, raw)
    assert [(str(r.timestamp)[:10], r.adj_close) for r in bars.orderBy("timestamp").collect()] == [("2024-01-01", 1.0), ("2024-01-02", 2.0)] and len(log) == 2
    assert prepare.normal_name(" Adj Close ") == "adj_close" and prepare.normal_name("Vol") == "volume"
    with pytest.raises(DataError):
        tables.load(spark, "x.xls")


def test_settings(tmp_path):
    with pytest.raises(ConfigError):
        config.from_dict({"nonsense": 1})
    (tmp_path / "c.toml").write_text("profile = 'quick'\n[statistics]\nreplicates = 900\n")
    assert config.from_file(str(tmp_path / "c.toml")).effective().statistics.replicates == 200
    assert config.Config(profile="strict").effective().validation.most_combinations == 12870


def test_reports_escape():
    r = Result([Finding("DATA-001", Severity.WARN, "<script>alert(1)</script> | x", {"v": float("nan")})])
    assert "<script>alert" not in reports.to_html(r) and json.loads(reports.to_json(r))["findings"][0]["evidence"]["v"] is None
    assert reports.line_chart([1, 2, None, 100], "t").startswith("<svg")


def test_command_line(tmp_path, capsys):
    (tmp_path / "s.py").write_text("signal = df.close.shift(-1)\n")
    assert cli.main(["scan", str(tmp_path)]) == 2 and cli.main(["rules"]) == 0 and cli.main(["init-config", f"{tmp_path}/c.yaml"]) == 0
    assert cli.main(["report", f"{tmp_path}/none.json", "x"]) == 3
    assert config.from_file(f"{tmp_path}/c.yaml") == config.Config()


def test_command_line_on_data(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "_session", lambda: spark)
    assert cli.main(["generate-data", f"{tmp_path}/m.csv", "--rows", "90"]) == 0
    assert cli.main(["validate", f"{tmp_path}/m.csv", "--fail-on", "fail"]) == 0
    m = pd.read_csv(f"{tmp_path}/m.csv")
    m.assign(returns=m["close"].pct_change()).dropna()[["timestamp", "returns"]].to_csv(f"{tmp_path}/r.csv", index=False)
    capsys.readouterr()
    assert cli.main(["statistics", f"{tmp_path}/r.csv", "--bootstrap", "20", "--json"]) == 0
    assert json.loads(capsys.readouterr().out)["moments"]["n"] == 89
    assert cli.main(["audit", "--returns", f"{tmp_path}/r.csv", "-p", "quick", "-o", f"{tmp_path}/r.json", "-q"]) in (0, 1, 2)
    assert cli.main(["report", f"{tmp_path}/r.json", f"{tmp_path}/r.md"]) == 0 and (tmp_path / "r.md").read_text().startswith("# Audit")
    assert cli.main(["audit"]) == 3 and cli.main(["init-config", f"{tmp_path}/m.csv"]) == 3 and cli.main(["rules", "DATA-001"]) == 0 and cli.main(["rules", "NONE"]) == 3 and cli.main(["version"]) == 0
    monkeypatch.setitem(cli.COMMANDS, "version", lambda a: 1 / 0)
    assert cli.main(["version"]) == 4


def test_stream_tracker_keeps_its_state(spark, tmp_path):
    at = lambda m: datetime.fromisoformat("2024-01-01 10:00") + pd.Timedelta(minutes=m).to_pytimedelta()
    rows = [("A", at(m), p, 1) for m, p in ((0, 10.0), (10, 10.0), (20, 10.0), (25, 7.0), (30, 6.0), (100, 9.5), (110, 7.5))] + [("B", at(5), None, 1), ("B", at(6), 1.0, 1)]
    every = spark.createDataFrame(rows, "symbol string, ts timestamp, price double, size long")
    expected = [("A", "drawdown", -0.3), ("A", "drawdown", -0.25), ("A", "gap", 4200.0), ("A", "stale", 3.0)]
    assert sorted((r.symbol, r.kind, round(r.value, 9)) for r in monitor.track_batch(every, 3, 3600.0, 0.2).collect()) == sorted(expected)
    for k, (low, high) in enumerate(((0, 22), (22, 200))):  # two batches: the state goes from one to the next
        every.where(F.minute("ts") + 60 * (F.hour("ts") - 10) >= low).where(F.minute("ts") + 60 * (F.hour("ts") - 10) < high).coalesce(1).write.parquet(f"{tmp_path}/in{k}")
    (tmp_path / "in").mkdir()
    for k in (0, 1):
        shutil.copy(next((tmp_path / f"in{k}").glob("*.parquet")), tmp_path / "in" / f"{k}.parquet")
        os.utime(tmp_path / "in" / f"{k}.parquet", (1e9 + 100 * k, 1e9 + 100 * k))  # files are taken by age
    stream = spark.readStream.schema(every.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = monitor.track(stream, 3, 3600.0, 0.2, "1 day").writeStream.format("memory").queryName("track_out").outputMode("append").option("checkpointLocation", f"{tmp_path}/c2").trigger(availableNow=True).start()
    q.awaitTermination(90)
    assert sorted((r.symbol, r.kind, round(r.value, 9)) for r in spark.sql("select * from track_out").collect()) == sorted(expected)


def test_stream_of_bars(spark, tmp_path):
    ticks = spark.createDataFrame([("A", datetime.fromisoformat("2024-01-01 10:00"), 1.0, 2), ("A", datetime.fromisoformat("2024-01-01 10:30"), 3.0, 1), ("A", datetime.fromisoformat("2024-01-01 14:00"), 2.0, 5)], "symbol string, ts timestamp, price double, size long")
    ticks.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(ticks.schema).parquet(f"{tmp_path}/in")
    q = monitor.bars(stream).writeStream.format("memory").queryName("bars_out").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = spark.sql("select open, close, volume from bars_out").collect()
    assert [tuple(r) for r in got] == [(1.0, 3.0, 3)]
