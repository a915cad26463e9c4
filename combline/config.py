"""Thresholds: one TOML file, single values overridden by COMBLINE_<DOTTED_KEY>, the file by COMBLINE_THRESHOLDS."""

from __future__ import annotations

import os
import tomllib
from collections.abc import Mapping
from dataclasses import dataclass
from pathlib import Path
from typing import Any

DEFAULT = Path(__file__).with_name("thresholds.toml")
PREFIX = "COMBLINE_"


@dataclass(frozen=True)
class Metric:
    """A compared measure: which way is better, its weight, and the count that must be at least 1 for a colony to take part."""

    name: str
    label: str
    unit: str
    higher_is_better: bool
    weight: float
    gate: str | None = None


#: Name, label, unit, higher is better, gate
CATALOG = [
    ("latest_weight_kg", "current colony weight", "kg", True, None),
    ("weight_pct_change", "weight percent change", "%", True, None),
    ("weight_slope_pct_per_day", "weight percent trend", "%/day", True, None),
    ("favorable_weather_weight_slope_pct_per_day", "favorable-weather weight percent trend", "%/day", True, "favorable_weather_window_count"),
    ("poor_weather_weight_loss_pct", "poor-weather weight loss", "%", False, "poor_weather_window_count"),
]


def _coerced(raw: str, like: Any, name: str) -> Any:
    """raw as the kind of value that like is; a number may be written with or without a point."""
    if isinstance(like, bool):
        return raw.strip().lower() in ("1", "true", "yes", "on")
    if isinstance(like, str):
        return raw
    try:
        number = float(raw)
    except ValueError as x:
        raise ValueError(f"{name}={raw!r} is no number") from x
    return int(number) if isinstance(like, int) and number.is_integer() else number


class Thresholds:
    """cfg["section.key"]; what is not in the file raises, as nothing has a default in code."""

    def __init__(self, path: str | Path | None = None, env: Mapping[str, str] | None = None):
        self._env = dict(os.environ if env is None else env)
        self.path = Path(path or self._env.get(PREFIX + "THRESHOLDS") or DEFAULT)
        if not self.path.exists():
            raise FileNotFoundError(f"no thresholds file {self.path}")
        self._tree: dict[str, Any] = tomllib.loads(self.path.read_text())
        weights, known = set(self.section("metric_weights")), {c[0] for c in CATALOG}
        if weights != known:
            raise ValueError(f"metric_weights and the catalog differ in {sorted(weights ^ known)}")

    def __getitem__(self, dotted: str) -> Any:
        node: Any = self._tree
        for part in dotted.split("."):
            if not isinstance(node, dict) or part not in node:
                raise KeyError(f"{dotted} is not in {self.path}")
            node = node[part]
        name = PREFIX + dotted.upper().replace(".", "_")
        return _coerced(self._env[name], node, name) if name in self._env and not isinstance(node, dict) else node

    def section(self, dotted: str) -> dict[str, Any]:
        node = self[dotted]
        if not isinstance(node, dict):
            raise KeyError(f"{dotted} in {self.path} is a value, not a section")
        return {k: self[f"{dotted}.{k}"] for k in node}

    def metrics(self) -> list[Metric]:
        return [Metric(n, label, unit, up, float(self[f"metric_weights.{n}"]), gate) for n, label, unit, up, gate in CATALOG]
