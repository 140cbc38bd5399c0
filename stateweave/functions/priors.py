"""Priors of parameters: kind, parameters and a starting value."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Prior:
    kind: str
    init: float
    params: tuple[float, ...]

    def log_density(self, x: float) -> float:
        a = self.params
        if self.kind == "uniform":
            return 0.0 if a[0] <= x <= a[1] else -math.inf
        if self.kind == "halfnormal":
            return -0.5 * (x / a[0]) ** 2 if x >= 0 else -math.inf
        if self.kind == "normal":
            return -0.5 * ((x - a[0]) / a[1]) ** 2
        if self.kind == "tnormal":
            return -0.5 * ((x - a[0]) / a[1]) ** 2 if a[2] <= x <= a[3] else -math.inf
        return (a[0] - 1) * math.log(x) - a[1] * x if x > 0 else -math.inf


    def log_densities(self, x: np.ndarray) -> np.ndarray:
        """``log_density`` of each value."""
        a, out = self.params, -np.inf
        with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
            if self.kind == "uniform":
                return np.where((a[0] <= x) & (x <= a[1]), 0.0, out)
            if self.kind == "halfnormal":
                return np.where(x >= 0, -0.5 * (x / a[0]) ** 2, out)
            if self.kind == "normal":
                return -0.5 * ((x - a[0]) / a[1]) ** 2
            if self.kind == "tnormal":
                return np.where((a[2] <= x) & (x <= a[3]), -0.5 * ((x - a[0]) / a[1]) ** 2, out)
            return np.where(x > 0, (a[0] - 1) * np.log(x) - a[1] * x, out)


def _checked(kind: str, init: float, params: tuple[float, ...], positive: tuple[float, ...], inside: bool = True) -> Prior:
    if not all(map(math.isfinite, (init, *positive))) or any(p <= 0 for p in positive) or not inside:
        raise ValueError(f"invalid {kind} prior: init {init}, parameters {params}")
    return Prior(kind, float(init), tuple(map(float, params)))


def uniform(init: float, min: float, max: float) -> Prior:  # noqa: A002
    return _checked("uniform", init, (min, max), (), min <= init <= max and min < max)


def halfnormal(init: float, sd: float) -> Prior:
    return _checked("halfnormal", init, (sd,), (sd,), init >= 0)


def normal(init: float, mean: float, sd: float) -> Prior:
    return _checked("normal", init, (mean, sd), (sd,), math.isfinite(mean))


def tnormal(init: float, mean: float, sd: float, min: float = -math.inf, max: float = math.inf) -> Prior:  # noqa: A002
    return _checked("tnormal", init, (mean, sd, min, max), (sd,), min <= init <= max and min < max)


def gamma(init: float, shape: float, rate: float) -> Prior:
    return _checked("gamma", init, (shape, rate), (shape, rate), init > 0)
