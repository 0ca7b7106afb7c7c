"""Findings, verdicts and rules: three ordered rules over severities, never a score."""

from __future__ import annotations

import hashlib
import json
import math
from dataclasses import asdict, dataclass, field
from enum import IntEnum


class Severity(IntEnum):
    PASS = 0
    INFO = 1
    WARN = 2
    FAIL = 3


CATEGORIES = ("data", "static", "causality", "leakage", "execution", "statistics", "validation", "sensitivity", "regimes", "engine")


@dataclass(frozen=True)
class Rule:
    id: str
    category: str
    title: str
    fix: str = ""


def _rules(category: str, prefix: str, titles: dict[str, tuple[str, str]]) -> dict[str, Rule]:
    return {f"{prefix}-{n}": Rule(f"{prefix}-{n}", category, *t) for n, t in titles.items()}


# The checks that the engine knows, one id each, and what to do about an issue.
RULES: dict[str, Rule] = (
    _rules("data", "DATA", {
        "000": ("Preparation log", "Prepare the data before the audit if these steps are not what you want."),
        "001": ("Invalid timestamps", "Repair or drop the rows whose time does not parse."),
        "002": ("Non-monotonic timestamps", "Sort the data by time at its source."),
        "003": ("Missing price or OHLC fields", "Name the price columns open, high, low and close."),
        "004": ("Duplicate timestamps", "Keep one row for each time and symbol."),
        "005": ("Duplicated observations", "Drop the copies."),
        "006": ("Impossible OHLC relationships", "Check the vendor's adjustment of these bars."),
        "007": ("Non-positive prices", "Replace them by missing values or use another series."),
        "008": ("Missing values", "Decide on a rule for missing values that uses the past alone."),
        "009": ("Unexplained gaps", "Check these spans against the exchange's calendar."),
        "010": ("Timezone inconsistency", "Write all times with one zone."),
        "011": ("Stale prices", "Do not carry prices forward over days without trades."),
        "012": ("Infinite values", "Look for divisions by zero upstream."),
        "013": ("Extreme single-period returns", "Check splits, currencies and bad ticks on these days."),
        "014": ("Empty or insufficient data", "Give at least two rows with a time and a price."),
        "015": ("Unsynchronised symbols", "Complete the symbols within the span they share."),
    })
    | _rules("static", "CODE", {
        "000": ("Source cannot be parsed", "Repair the syntax."),
        "001": ("Negative temporal shift", "Shift forward only, or keep the value for labels."),
        "002": ("Centred window", "Use a trailing window."),
        "003": ("Future-oriented construction", "Index at or before the current row."),
        "004": ("Random split", "Split by time."),
        "005": ("Randomised cross-validation", "Use walk-forward or purged folds."),
        "006": ("Preprocessing fitted before the split", "Fit on the training rows alone."),
        "007": ("Full-sample normalisation", "Use trailing or expanding moments."),
        "008": ("Target leakage", "Take the target out of the features."),
        "009": ("Same-bar execution assumption", "Execute at least one bar after the signal."),
        "010": ("Missing execution lag", "Multiply the returns by the signal of the bar before."),
        "011": ("Missing transaction costs", "Subtract costs from the returns."),
        "012": ("Future-derived model features", "Build features from the past alone."),
        "013": ("Large parameter search", "Declare the number of settings tried."),
        "014": ("No out-of-sample evaluation", "Hold out the last part of the data."),
        "015": ("Non-causal transformation", "Use a transform that looks back only."),
    })
    | _rules("causality", "CAUSAL", {
        "001": ("Future perturbation changed past decisions", "Find the input that reads later rows."),
        "002": ("Non-deterministic strategy", "Seed every draw."),
        "003": ("Strategy errors on perturbed data", "Make the strategy total over valid bars."),
        "004": ("Output insensitive to data", "Check that the strategy reads its data."),
    })
    | _rules("leakage", "LEAK", {
        "001": ("Feature replicates the target", "Drop the feature."),
        "002": ("Feature replicates a future return", "Drop the feature or lag it."),
        "003": ("Implausible directional accuracy", "Look for look-ahead in the signal."),
    })
    | _rules("execution", "EXEC", {
        "001": ("Performance depends on unrealistic execution", "Report results with a lag of one bar and with costs."),
        "002": ("Transaction-cost model missing", "Declare costs and say where they come from."),
        "003": ("Edge fragile to transaction costs", "Trade less, or verify costs on real fills."),
        "004": ("Excessive turnover relative to edge", "Add a band without trades, or rebalance less often."),
        "005": ("Trades before or at their signal", "Record real execution times."),
        "006": ("Execution semantics not testable from bars", "Give data on which the declared fills can be tested."),
    })
    | _rules("statistics", "STAT", {
        "001": ("Small sample", "Extend the evaluation."),
        "002": ("Probabilistic Sharpe ratio", "Collect more out-of-sample data."),
        "003": ("Deflated Sharpe ratio", "Report all trials, and search less."),
        "004": ("Suspiciously strong statistics", "Treat the result as an error until it is explained."),
        "005": ("Number of trials not declared", "Set statistics.trials."),
        "006": ("Non-normal returns", "Do not use intervals that assume a normal distribution."),
        "007": ("Serially correlated returns", "Use the adjusted Sharpe ratio."),
    })
    | _rules("validation", "VAL", {
        "001": ("Out-of-sample evidence", "Confirm on data that the search has not seen."),
        "002": ("Probability of backtest overfitting", "Simplify the search."),
        "003": ("Combinatorial path performance", "Prefer settings whose paths are mostly positive."),
        "004": ("Data-snooping test", "Treat the best setting as unproven."),
    })
    | _rules("sensitivity", "SENS", {
        "001": ("Fragile parameter optimum", "Choose the middle of a plateau."),
        "002": ("Unstable parameter ranking", "Select on validation data."),
    })
    | _rules("regimes", "REGIME", {"001": ("Regime-dependent performance", "Size the strategy for its bad regimes.")})
    | _rules("engine", "META", {"STATIC": ("Static analysis not run", "Give the source."), "RUNTIME": ("Runtime checks not run", "Give the strategy and data.")})
)


@dataclass
class Finding:
    rule: str
    severity: Severity
    message: str
    evidence: dict = field(default_factory=dict)
    file: str | None = None
    line: int | None = None
    usage: str | None = None

    @property
    def category(self) -> str:
        return RULES[self.rule].category if self.rule in RULES else "engine"

    @property
    def fix(self) -> str:
        """What to do, for issues."""
        return RULES[self.rule].fix if self.rule in RULES and self.severity >= Severity.WARN else ""

    @property
    def title(self) -> str:
        return RULES[self.rule].title if self.rule in RULES else self.rule

    def key(self) -> tuple:
        return CATEGORIES.index(self.category), self.rule, self.file or "", self.line or 0


def verdict(findings: list[Finding]) -> str:
    top = max((f.severity for f in findings), default=Severity.PASS)
    return "FAIL" if top == Severity.FAIL else "WARN" if top == Severity.WARN else "PASS"


def plain(x):
    """Strict JSON values: no NaN or infinity, keys as text."""
    if isinstance(x, dict):
        return {str(k): plain(v) for k, v in x.items()}
    if isinstance(x, list | tuple | set):
        return [plain(v) for v in x]
    if isinstance(x, bool) or x is None or isinstance(x, str | int):
        return x
    if hasattr(x, "item"):
        return plain(x.item())
    if isinstance(x, float):
        return x if math.isfinite(x) else None
    return str(x)


def canonical_hash(x) -> str:
    return hashlib.sha256(json.dumps(plain(x), sort_keys=True, separators=(",", ":"), allow_nan=False).encode()).hexdigest()


@dataclass
class Result:
    findings: list[Finding]
    sections: dict = field(default_factory=dict)
    manifest: dict = field(default_factory=dict)

    def __post_init__(self):
        self.findings = sorted(self.findings, key=Finding.key)

    @property
    def status(self) -> str:
        return verdict(self.findings)

    def counts(self) -> dict[str, int]:
        return {s.name: sum(f.severity == s for f in self.findings) for s in Severity}

    def issues(self) -> list[Finding]:
        rank = {"live": 0, None: 1, "unknown": 1, "label": 2}
        return sorted((f for f in self.findings if f.severity >= Severity.WARN), key=lambda f: (-f.severity, rank.get(f.usage, 1), *f.key()))

    def narrative(self) -> list[str]:
        """The primary reason first, then up to five more."""
        return [f"{f.rule} {f.title}: {f.message}" for f in self.issues()[:6]] or ["No executed check found an issue."]

    def next_steps(self) -> list[str]:
        """What to do about the issues, the worst first, each once."""
        return list(dict.fromkeys(f.fix for f in self.issues() if f.fix))[:6]

    def to_dict(self) -> dict:
        items = [asdict(f) | {"severity": f.severity.name, "category": f.category, "title": f.title, "fix": f.fix} for f in self.findings]
        return plain({"status": self.status, "counts": self.counts(), "narrative": self.narrative(), "next_steps": self.next_steps(), "findings": items, "sections": self.sections, "manifest": self.manifest})

    @staticmethod
    def from_dict(d: dict) -> Result:
        keys = ("rule", "message", "evidence", "file", "line", "usage")
        return Result([Finding(severity=Severity[f["severity"]], **{k: f[k] for k in keys}) for f in d["findings"]], d.get("sections", {}), d.get("manifest", {}))
