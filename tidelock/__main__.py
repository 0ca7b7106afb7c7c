"""Command line: audit, validate, scan, report, rules, statistics, generate-data, init-config, version. Exit codes: 0 pass, 1 warn, 2 fail, 3 invalid input, 4 internal error."""

from __future__ import annotations

import argparse
import json
import os
import sys

from .audit import code, config, findings, reports
from .errors import AuditError

FORMATS = ("json", "markdown", "html", "text")
CODES = {"PASS": 0, "WARN": 1, "FAIL": 2}


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _exit(status: str, fail_on: str) -> int:
    least = {"warn": 1, "fail": 2, "never": 3}[fail_on]
    return CODES[status] if CODES[status] >= least else 0


def _finish(r: findings.Result, args, verbose: bool = False) -> int:
    output, fmt = getattr(args, "output", None), getattr(args, "format", None)
    if output:
        reports.write(r, output, fmt)
    if fmt and fmt != "text" and not output:
        print(reports.render(r, fmt))
    elif not getattr(args, "quiet", False):
        print(reports.to_text(r, verbose or getattr(args, "verbose", False), sys.stdout.isatty() and "NO_COLOR" not in os.environ))
    return _exit(r.status, getattr(args, "fail_on", "warn"))


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidelock")
    sub = p.add_subparsers(dest="command", required=True)
    c = {name: sub.add_parser(name) for name in ("audit", "validate", "scan", "report", "rules", "statistics", "generate-data", "init-config", "version")}
    for name in ("audit", "validate", "scan"):
        c[name].add_argument("--config", "-c")
        c[name].add_argument("--output", "-o")
        c[name].add_argument("--format", "-f", choices=FORMATS)
        c[name].add_argument("--fail-on", choices=["warn", "fail", "never"], default="warn")
        c[name].add_argument("--verbose", "-v", action="store_true")
        c[name].add_argument("--quiet", "-q", action="store_true")
        c[name].add_argument("--profile", "-p", choices=["quick", "standard", "strict"])
        c[name].add_argument("--seed", type=int)
    for name in ("audit", "validate"):
        c[name].add_argument("--timestamp-column")
        c[name].add_argument("--symbol-column")
    c["audit"].add_argument("--quick", action="store_true")
    for flag, short in (("strategy", "-s"), ("data", "-d"), ("benchmark", "-b")):
        c["audit"].add_argument(f"--{flag}", short)
    for flag in ("returns", "trials"):
        c["audit"].add_argument(f"--{flag}")
    c["validate"].add_argument("data")
    c["scan"].add_argument("path")
    c["scan"].add_argument("--show-passes", action="store_true")
    c["scan"].add_argument("--disable", action="append", default=[])
    c["report"].add_argument("result")
    c["report"].add_argument("output", nargs="?")
    c["report"].add_argument("--format", "-f", choices=FORMATS)
    c["rules"].add_argument("rule", nargs="?")
    c["rules"].add_argument("--category", choices=findings.CATEGORIES)
    c["rules"].add_argument("--json", action="store_true")
    s = c["statistics"]
    s.add_argument("returns")
    s.add_argument("--column")
    for flag, kind, value in (("periods", float, 252.0), ("trials", int, 1), ("benchmark-sharpe", float, 0.0), ("risk-free", float, 0.0), ("bootstrap", int, 1000), ("seed", int, 42)):
        s.add_argument(f"--{flag}", type=kind, default=value)
    s.add_argument("--json", action="store_true")
    c["generate-data"].add_argument("path")
    for flag, kind, value in (("rows", int, 1500), ("seed", int, 2026), ("ar1", float, -0.15)):
        c["generate-data"].add_argument(f"--{flag}", type=kind, default=value)
    c["init-config"].add_argument("path", nargs="?", default="tidelock.yaml")
    c["init-config"].add_argument("--force", action="store_true")
    return p


def _settings(args) -> config.Config:
    cfg = config.from_file(args.config) if getattr(args, "config", None) else config.Config()
    profile = "quick" if getattr(args, "quick", False) else getattr(args, "profile", None)
    if profile:
        cfg.profile = profile
    if args.command != "statistics" and getattr(args, "seed", None) is not None:
        cfg.seed = args.seed
    return cfg


def _audit(args) -> int:
    from .audit import engine
    from .sources.tables import Artifacts, load_returns, load_trials

    if not (args.strategy or args.returns or args.trials):
        raise AuditError("give --strategy (with --data), or --returns or --trials")
    spark, cfg = _session(), _settings(args)
    if args.strategy:
        return _finish(engine.audit(spark, args.strategy, args.data, cfg, benchmark=args.benchmark, timestamp_column=args.timestamp_column, symbol_column=args.symbol_column), args)
    art = Artifacts(returns=load_returns(spark, args.returns) if args.returns else None, trial_returns=load_trials(spark, args.trials) if args.trials else None)
    return _finish(engine.audit(spark, data=args.data, config=cfg, artifacts=art, benchmark=args.benchmark), args)


def _validate(args) -> int:
    from .audit import engine
    from .operators.prepare import prepare
    from .sources.tables import load_raw, raw_times

    spark, cfg = _session(), _settings(args)
    raw = load_raw(spark, args.data, args.timestamp_column, args.symbol_column)
    times = raw_times(spark, args.data, args.timestamp_column, args.symbol_column)
    rows, log = (raw, []) if raw.limit(2).count() < 2 else prepare(raw, "_seq", ("symbol",))
    return _finish(findings.Result(engine.validate_data(raw, cfg, log, times, rows)), args, True)


def _statistics(args) -> int:
    from .audit import engine
    from .sources.tables import load_returns

    cfg = config.from_dict({"seed": args.seed, "statistics": {"periods": args.periods, "benchmark_sharpe": args.benchmark_sharpe, "risk_free": args.risk_free, "replicates": args.bootstrap}})
    found, section = engine.judge_statistics(load_returns(_session(), args.returns, args.column), cfg, args.trials, True)
    if args.json:
        print(json.dumps(findings.plain(section), indent=2))
    else:
        print(reports.to_text(findings.Result(found, {"statistics": section}), True))
    return 0


def _rules(args) -> int:
    chosen = [r for r in findings.RULES.values() if (not args.rule or r.id == args.rule) and (not args.category or r.category == args.category)]
    if not chosen:
        raise AuditError(f"no rule {args.rule or args.category}")
    if args.json:
        print(json.dumps([vars(r) for r in chosen], indent=2))
    else:
        print("\n".join(f"{r.id:<12} {r.category:<11} {r.title}" + (f"\n  {r.fix}" if args.rule else "") for r in chosen))
    return 0


def _init(args) -> int:
    import yaml

    if os.path.exists(args.path) and not args.force:
        raise AuditError(f"{args.path} exists; --force writes over it")
    with open(args.path, "w") as f:
        yaml.safe_dump(config.Config().model_dump(), f, sort_keys=False)
    return 0


def _report(args) -> int:
    r = reports.from_json(args.result)
    if args.output:
        reports.write(r, args.output, args.format)
    else:
        print(reports.render(r, args.format or "html"))
    return 0


def _generate(args) -> int:
    from .sources.tables import export_synthetic

    print(export_synthetic(args.path, args.rows, args.seed, args.ar1))
    return 0


def _scan(args) -> int:
    cfg = _settings(args)
    found = code.scan(args.path, disabled=(*cfg.code.disabled, *args.disable), passes=args.show_passes, most=cfg.code.most_settings)
    return _finish(findings.Result(found), args, True)


def _version(args) -> int:
    print("tidelock 0.2")
    return 0


COMMANDS = {"audit": _audit, "validate": _validate, "scan": _scan, "report": _report, "rules": _rules, "statistics": _statistics, "generate-data": _generate, "init-config": _init, "version": _version}


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    try:
        return COMMANDS[args.command](args)
    except (AuditError, OSError, json.JSONDecodeError, KeyError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 3
    except Exception as e:
        print(f"internal error: {type(e).__name__}: {e}", file=sys.stderr)
        return 4


if __name__ == "__main__":
    sys.exit(main())
