"""One step of the Kalman filter at a time, in constant memory: for table functions and streams."""

from __future__ import annotations

import json
import math

import numpy as np

from . import kernels, models
from .models import Matrices


class Stepper:
    """A linear Gaussian filter between two observations: the predicted state ``a``, its covariance ``P``, the log-likelihood and the number of steps."""

    def __init__(self, model: Matrices, a=None, P=None, loglik: float = 0.0, t: int = 0):
        m = len(model.a1)
        self.model, self.loglik, self.t = model, loglik, t
        self.a = np.array(model.a1 if a is None else a, float)
        self.P = np.array(model.P1 if P is None else P, float).reshape(m, m)

    def step(self, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Filtered mean and covariance after ``y`` (a value for each variable, NaN if missing); the state moves on to the next time."""
        model, t = self.model, self.t
        seen = np.isfinite(y)
        Z, H = model.at("Z", t)[seen], model.at("H", t)
        HH = (H @ H.T)[np.ix_(seen, seen)]
        F = Z @ self.P @ Z.T + HH
        if seen.any() and (np.diag(F) > kernels.TOLERANCE).all():
            v = y[seen] - model.at("D", t)[seen] - Z @ self.a
            L = np.linalg.cholesky(F)
            w = np.linalg.solve(L, v)
            self.loglik -= 0.5 * (len(v) * kernels.LOG_2PI + w @ w) + np.log(np.diag(L)).sum()
            K = self.P @ Z.T @ np.linalg.inv(F)
            J = np.eye(len(self.a)) - K @ Z
            self.a, self.P = self.a + K @ v, J @ self.P @ J.T + K @ HH @ K.T
        att, ptt = self.a, self.P
        T, R = model.at("T", t), model.at("R", t)
        self.a, P = model.at("C", t) + T @ att, T @ ptt @ T.T + R @ R.T
        self.P = (P + P.T) / 2
        self.t += 1
        return att, ptt

    def forecast(self, horizon: int):
        """Mean and covariance of the observations of the next ``horizon`` times."""
        a, P = self.a, self.P
        for t in range(self.t, self.t + horizon):
            Z, H, T, R = (self.model.at(k, t) for k in "ZHTR")
            yield self.model.at("D", t) + Z @ a, Z @ P @ Z.T + H @ H.T
            a, P = self.model.at("C", t) + T @ a, T @ P @ T.T + R @ R.T


def values(y, p: int) -> np.ndarray:
    """An observation (a number, an array, or null) as an array of ``p`` numbers."""
    if y is None:
        return np.full(p, math.nan)
    return np.array([math.nan if v is None else v for v in (y if isinstance(y, (list, tuple, np.ndarray)) else [y])], float)


def from_json(text: str) -> Matrices:
    """A Gaussian model from JSON: the arguments of ``models.structural`` or ``models.ar1`` (with rho), or the matrices Z, T, R, H, a1, P1 and, if any, D and C."""
    given = json.loads(text)
    array = lambda k: np.asarray(given[k], float)
    if "Z" in given:
        return Matrices(*(array(k) for k in ("Z", "T", "R", "a1", "P1", "H")), *(array(k) if k in given else None for k in ("D", "C")))
    spec = (models.ar1 if "rho" in given else models.structural)(**{k: np.asarray(v, float) if isinstance(v, list) else v for k, v in given.items()})
    if spec.dist:
        raise ValueError("steps are of Gaussian models")
    return spec.build(np.zeros(0))
