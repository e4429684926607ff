"""Settings from ``.ctxcostrc``: a budget and cadence weights. What doesn't fit is warned about and ignored."""

from __future__ import annotations

import json
import math
import os
import warnings
from dataclasses import dataclass, field
from typing import Any

from ..schema import DEFAULT_BUDGET, DEFAULT_CADENCE

RC_NAME = ".ctxcostrc"


@dataclass(frozen=True)
class Config:
    budget: float = DEFAULT_BUDGET
    budget_explicit: bool = False
    cadence: dict[int, float] = field(default_factory=lambda: dict(DEFAULT_CADENCE))


def _warn(message: str) -> None:
    warnings.warn(f"{RC_NAME}: {message}", stacklevel=3)


def _number(x: Any, low: float, strict: bool) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool) and math.isfinite(x) and (x > low if strict else x >= low)


def parse(raw: Any) -> Config:
    if not isinstance(raw, dict):
        _warn("not an object; using the defaults")
        return Config()
    for key in raw.keys() - {"budget", "cadence"}:
        _warn(f"unknown key {key!r}")
    budget, explicit = DEFAULT_BUDGET, False
    if "budget" in raw:
        if _number(raw["budget"], 0, True):
            budget, explicit = raw["budget"], True
        else:
            _warn("budget must be a number above zero")
    cadence = dict(DEFAULT_CADENCE)
    if "cadence" in raw:
        given = raw["cadence"]
        if not isinstance(given, dict):
            _warn("cadence must map tiers to weights")
            given = {}
        for tier, weight in given.items():
            if tier not in ("0", "1", "2"):
                _warn(f"unknown tier {tier!r}")
            elif not _number(weight, 0, False):
                _warn(f"the weight of tier {tier} must be a number that isn't negative")
            else:
                cadence[int(tier)] = float(weight)
    return Config(budget, explicit, cadence)


def load(root: str) -> Config:
    try:
        with open(os.path.join(root, RC_NAME), encoding="utf-8") as f:
            text = f.read()
    except OSError:
        return Config()
    try:
        return parse(json.loads(text))
    except ValueError:
        _warn("not valid JSON; using the defaults")
        return Config()
