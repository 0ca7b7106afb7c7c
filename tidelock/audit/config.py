"""Settings with strict keys, from YAML, TOML or JSON, and profiles."""

from __future__ import annotations

import json
import tomllib
from pathlib import Path
from typing import Literal

from pydantic import BaseModel, ConfigDict, Field, ValidationError, create_model, model_validator

from ..errors import ConfigError
from ..operators.causality import SCHEMES

Bootstrap = Literal["stationary", "circular", "moving", "iid"]

# The settings, their types, defaults and bounds.
SETTINGS: dict[str, dict[str, tuple]] = {
    "data": {
        "enabled": (bool, True), "gap_multiple": (float, 5.0, {"gt": 1}), "stale_runs": (int, 5, {"ge": 2}), "extreme_return": (float, 0.5, {"gt": 0}),
        "require_ohlc": (bool, False), "allow_duplicates": (bool, False), "disabled": (list[str], []),
    },
    "execution": {
        "fill": (str, "close"), "lag": (int, 1, {"ge": 0}), "commission_bps": (float, 1.0, {"ge": 0}), "spread_bps": (float, 2.0, {"ge": 0}), "slippage_bps": (float, 2.0, {"ge": 0}),
        "impact": (float, 0.0, {"ge": 0}), "tax_bps": (float, 0.0, {"ge": 0}), "capital": (float, 1e6, {"gt": 0}), "cost_multipliers": (list[float], [0.0, 0.5, 1.0, 1.5, 2.0, 3.0]),
    },
    "statistics": {
        "periods": (float, 252.0, {"gt": 0}), "risk_free": (float, 0.0, {"gt": -1}), "trials": (int | None, None), "benchmark_sharpe": (float, 0.0), "confidence": (float, 0.95, {"gt": 0.5, "lt": 1}),
        "replicates": (int, 1000, {"ge": 10}), "bootstrap": (Bootstrap, "stationary"), "block": (float | None, None), "plausible_sharpe": (float, 4.0, {"gt": 0}), "least": (int, 60, {"ge": 10}), "require_trials": (bool, False),
    },
    "validation": {
        "walk_forward": (bool, True), "train_fraction": (float, 0.5, {"gt": 0, "lt": 1}), "folds": (int, 5, {"ge": 2}), "expanding": (bool, True), "gap": (int, 0, {"ge": 0}),
        "pbo": (bool, True), "blocks": (int, 10, {"ge": 4}), "most_combinations": (int, 5000, {"ge": 10}),
        "cpcv": (bool, True), "groups": (int, 6, {"ge": 3}), "test_groups": (int, 2, {"ge": 1}), "embargo": (float, 0.01, {"ge": 0, "lt": 0.5}), "reality_check": (bool, True), "most_trials": (int, 200, {"ge": 2}),
    },
    "causality": {
        "enabled": (bool, True), "cutoffs": (int, 8, {"ge": 1}), "first": (float, 0.2, {"ge": 0, "lt": 1}), "schemes": (list[Literal[SCHEMES]], list(SCHEMES)),
        "magnitude": (float, 0.5, {"gt": 0}), "rtol": (float, 1e-9, {"ge": 0}), "atol": (float, 1e-12, {"ge": 0}), "seed": (int | None, None),
    },
    "regimes": {
        "enabled": (bool, True), "volatility_rows": (int, 63, {"ge": 5}), "volatility_quantiles": (list[float], [1 / 3, 2 / 3]), "volatility_labels": (list[str], ["low", "normal", "high"]),
        "drawdown_cuts": (list[float], [-0.1, -0.2]), "trend_rows": (int, 126, {"ge": 5}), "least": (int, 40, {"ge": 5}),
    },
    "sensitivity": {"enabled": (bool, True), "robust": (float, 0.7, {"gt": 0, "le": 1}), "fragile": (float, 0.4, {"gt": 0, "le": 1})},
    "code": {"enabled": (bool, True), "disabled": (list[str], []), "most_settings": (int, 100, {"ge": 2})},
}
#: What a profile does to settings: quick caps the work, strict sets floors to it.
QUICK = {"statistics.replicates": 200, "validation.most_combinations": 500, "validation.most_trials": 50, "causality.cutoffs": 4}
STRICT = {"statistics.replicates": 2000, "validation.most_combinations": 12870, "causality.cutoffs": 16}


class Strict(BaseModel):
    model_config = ConfigDict(extra="forbid")


def _section(name: str) -> type[Strict]:
    fields = {k: (kind, Field(default, **(bounds[0] if bounds else {}))) for k, (kind, default, *bounds) in SETTINGS[name].items()}
    return create_model(name.capitalize(), __base__=Strict, **fields)


_Sections = create_model("Sections", __base__=Strict, **{n: (m, Field(default_factory=m)) for n in SETTINGS for m in (_section(n),)})


class Config(_Sections):
    profile: Literal["quick", "standard", "strict"] = "standard"
    seed: int = 42

    @model_validator(mode="after")
    def _fits(self) -> Config:
        """What bounds of single settings cannot say."""
        r, v, s = self.regimes, self.validation, self.sensitivity
        tests = {
            "validation.blocks must be even": v.blocks % 2 == 0,
            "validation.test_groups must be below validation.groups": v.test_groups < v.groups,
            "regimes.volatility_quantiles must rise between 0 and 1": all(0 < q < 1 for q in r.volatility_quantiles) and sorted(set(r.volatility_quantiles)) == r.volatility_quantiles,
            "regimes.volatility_labels needs one more than there are quantiles": len(r.volatility_labels) == len(r.volatility_quantiles) + 1,
            "regimes.drawdown_cuts must be below 0": all(c < 0 for c in r.drawdown_cuts) and bool(r.drawdown_cuts),
            "sensitivity.fragile must be below sensitivity.robust": s.fragile < s.robust,
            "statistics.trials must be 1 or more": self.statistics.trials is None or self.statistics.trials >= 1,
        }
        if bad := [text for text, fine in tests.items() if not fine]:
            raise ValueError("; ".join(bad))
        return self

    def effective(self) -> Config:
        """With the profile applied."""
        c = self.model_copy(deep=True)
        for limits, bound in {"quick": ((QUICK, min),), "strict": ((STRICT, max),)}.get(c.profile, ()):
            for path, value in limits.items():
                section, key = path.split(".")
                part = getattr(c, section)
                setattr(part, key, bound(getattr(part, key), value))
        return c


def from_dict(d: dict) -> Config:
    try:
        return Config(**d)
    except (ValidationError, TypeError) as e:
        raise ConfigError(str(e)) from e


def from_file(path: str) -> Config:
    text, suffix = Path(path).read_text(), Path(path).suffix.lower()
    if suffix in (".yaml", ".yml"):
        import yaml

        got = yaml.safe_load(text)
    elif suffix == ".toml":
        got = tomllib.loads(text)
    elif suffix == ".json":
        got = json.loads(text)
    else:
        raise ConfigError(f"{suffix} is no format of settings; use .yaml, .toml or .json")
    if not isinstance(got, dict):
        raise ConfigError("settings are a mapping")
    return from_dict(got)
