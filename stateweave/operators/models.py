"""Model specifications: matrices as functions of parameters, with priors. Checked when built."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field, replace

import numpy as np

from ..functions.densities import DISTRIBUTIONS
from ..functions.priors import Prior


@dataclass(frozen=True)
class Matrices:
    """y_t = D + Z alpha_t + H e_t, alpha_{t+1} = C + T alpha_t + R n_t, alpha_1 ~ N(a1, P1).

    Z is p x m, H p x p, T m x m, R m x k, D p, C m; each may have a leading time axis. ``dist``, ``phi`` and ``u`` (length
    p lists, n x p for u) replace H for other distributions.
    """

    Z: np.ndarray
    T: np.ndarray
    R: np.ndarray
    a1: np.ndarray
    P1: np.ndarray
    H: np.ndarray | None = None
    D: np.ndarray | None = None
    C: np.ndarray | None = None
    dist: tuple[str, ...] = ()
    phi: tuple[float, ...] = ()

    def at(self, name: str, t: int) -> np.ndarray:
        x = getattr(self, name)
        if x.ndim != {"Z": 3, "H": 3, "T": 3, "R": 3, "D": 2, "C": 2}[name]:
            return x
        if t >= len(x):
            raise ValueError(f"{name} has {len(x)} times, but time {t + 1} is needed")
        return x[t]

    def __post_init__(self):
        m, p = self.T.shape[-1], self.Z.shape[-2]
        checks = {
            "Z": self.Z.shape[-1] == m, "T": self.T.shape[-2] == m, "R": self.R.shape[-2] == m, "a1": self.a1.shape == (m,), "P1": self.P1.shape == (m, m),
            "H": self.H is None or self.H.shape[-2:] == (p, p), "dist": all(d in DISTRIBUTIONS for d in self.dist) and len(self.dist) in (0, p),
        }
        if bad := [k for k, ok in checks.items() if not ok]:
            raise ValueError(f"wrong shape or value: {', '.join(bad)}")
        for name, value in (("H", np.zeros((p, p))), ("D", np.zeros(p)), ("C", np.zeros(m)), ("phi", (1.0,) * p)):
            if getattr(self, name) is None or name == "phi" and not self.phi:
                object.__setattr__(self, name, value)


@dataclass(frozen=True)
class Spec:
    """A model: ``build(theta)`` on the internal scale gives Matrices; ``logs`` marks parameters kept as logarithms.

    With ``betas(theta)``, the coefficients of covariates, the series has them in a column ``x`` (array of doubles, one for
    each coefficient, at every t), or the model in ``xreg``. ``stack(thetas)`` builds many models at once, if given.
    """

    names: tuple[str, ...]
    priors: tuple[Prior, ...]
    logs: tuple[bool, ...]
    build: Callable[[np.ndarray], Matrices] = field(repr=False)
    betas: Callable[[np.ndarray], np.ndarray] | None = field(default=None, repr=False)
    xreg: np.ndarray | None = field(default=None, repr=False)
    stack: Callable[[np.ndarray], dict[str, np.ndarray]] | None = field(default=None, repr=False)

    def bind(self, x: np.ndarray | None) -> Spec:
        """The model of one series with its covariates (times x coefficients)."""
        x = self.xreg if self.xreg is not None else x
        if self.betas is None or x is None:
            if self.betas is not None:
                raise ValueError("the model has covariates: the series needs a column x, or the model xreg")
            return self
        build, betas, x = self.build, self.betas, np.asarray(x, float)
        if x.ndim != 2 or x.shape[1] != len(betas(self.start())) or not np.isfinite(x).all():
            raise ValueError("x needs a finite value for each coefficient at every time")
        return replace(self, build=lambda theta: replace(build(theta), D=(x @ betas(theta))[:, None]), xreg=x)

    def log_priors(self, thetas: np.ndarray) -> np.ndarray:
        """``log_prior`` of each row."""
        logs = np.array(self.logs, bool)
        with np.errstate(over="ignore"):
            x = np.where(logs, np.exp(thetas), thetas)
        return sum((p.log_densities(x[:, k]) for k, p in enumerate(self.priors)), np.zeros(len(thetas))) + thetas[:, logs].sum(1)

    @property
    def dist(self) -> tuple[str, ...]:
        """Distributions of the variables; none for Gaussian models."""
        return self.build(self.start()).dist

    def start(self) -> np.ndarray:
        return np.array([math.log(max(1e-3, p.init)) if lg else p.init for p, lg in zip(self.priors, self.logs, strict=True)])

    def natural(self, theta: np.ndarray) -> np.ndarray:
        return np.where(self.logs, np.exp(theta), theta)

    def log_prior(self, theta: np.ndarray) -> float:
        """With the log-Jacobian of parameters kept as logarithms."""
        x = self.natural(theta)
        return sum(p.log_density(float(v)) for p, v in zip(self.priors, x, strict=True)) + float(theta[list(self.logs)].sum() if len(theta) else 0.0)


class _Parameters:
    """Collects which arguments are priors, and reads values from theta."""

    def __init__(self):
        self.names, self.priors, self.logs, self.slots = [], [], [], {}

    def add(self, name: str, value, log: bool, low: float = -math.inf, high: float = math.inf):
        if isinstance(value, Prior):
            self.slots[name] = len(self.names)
            self.names.append(name), self.priors.append(value), self.logs.append(log)
        elif value is not None and not (math.isfinite(value) and low <= value <= high):
            raise ValueError(f"{name} must lie within [{low}, {high}]")
        else:
            self.slots[name] = value if value is None else float(value)

    def reader(self):
        slots, logs = self.slots, self.logs

        def read(theta, name):
            slot = slots[name]
            return slot if not isinstance(slot, int) else math.exp(theta[slot]) if logs[slot] else float(theta[slot])

        return read

    def spec(self, build, betas=None, xreg=None, stack=None) -> Spec:
        return Spec(tuple(self.names), tuple(self.priors), tuple(self.logs), build, betas, None if xreg is None else np.asarray(xreg, float), stack)

    def columns(self):
        """Like ``reader``, for rows of parameters: a value for each."""
        slots, logs = self.slots, self.logs

        def read(thetas: np.ndarray, name: str) -> np.ndarray:
            slot = slots[name]
            if not isinstance(slot, int):
                return np.full(len(thetas), np.nan if slot is None else slot)
            return np.exp(thetas[:, slot]) if logs[slot] else thetas[:, slot]

        return read


def structural(sd_level, sd_slope=None, sd_seasonal=None, period: int = 0, sd_y=None, beta=(), xreg: np.ndarray | None = None, a1=None, P1=None, dist: str = "", phi=1.0, sd_noise=None) -> Spec:
    """Level, and slope, dummy seasonal, regression and noise states as given; each argument is a number or a prior."""
    if sd_seasonal is not None and period < 3:
        raise ValueError("period must be 3 or more")
    ps = _Parameters()
    for name, value in (("sd_y", sd_y), ("sd_level", sd_level), ("sd_slope", sd_slope), ("sd_seasonal", sd_seasonal), ("sd_noise", sd_noise)):
        ps.add(name, value, True, 0.0)
    ps.add("phi", phi, True, 0.0)
    for k, b in enumerate(beta):
        ps.add(f"beta_{k + 1}", b, False)
    slope, season, noise = sd_slope is not None, period if sd_seasonal is not None else 0, sd_noise is not None
    m = 1 + slope + max(0, season - 1) + noise
    T, Z = np.zeros((m, m)), np.zeros((1, m))
    T[0, 0] = Z[0, 0] = 1
    if slope:
        T[0, 1] = T[1, 1] = 1
    at = 1 + slope
    if season:
        T[at, at : at + season - 1] = -1
        T[np.arange(at + 1, at + season - 1), np.arange(at, at + season - 2)] = 1
        Z[0, at] = 1
    if noise:
        Z[0, m - 1] = 1
    P = 100.0 * np.eye(m) if P1 is None else np.asarray(P1, float)
    a = np.zeros(m) if a1 is None else np.asarray(a1, float)
    read = ps.reader()

    def build(theta: np.ndarray) -> Matrices:
        sds = [(0, read(theta, "sd_level"))] + [(1, read(theta, "sd_slope"))] * slope + [(at, read(theta, "sd_seasonal"))] * bool(season) + [(m - 1, read(theta, "sd_noise"))] * noise
        R = np.zeros((m, len(sds)))
        for k, (row, sd) in enumerate(sds):
            R[row, k] = sd
        first = P.copy()
        if noise:
            first[m - 1, m - 1] = read(theta, "sd_noise") ** 2
        H = None if dist else np.array([[read(theta, "sd_y")]])
        return Matrices(Z, T, R, a, first, H, None, None, (dist,) if dist else (), (read(theta, "phi"),))

    column = ps.columns()

    def stack(thetas: np.ndarray) -> dict[str, np.ndarray]:
        B = len(thetas)
        RR, first = np.zeros((B, m, m)), np.tile(P, (B, 1, 1))
        for row, name, used in ((0, "sd_level", True), (1, "sd_slope", slope), (at, "sd_seasonal", bool(season)), (m - 1, "sd_noise", noise)):
            if used:
                RR[:, row, row] = column(thetas, name) ** 2
        if noise:
            first[:, m - 1, m - 1] = column(thetas, "sd_noise") ** 2
        return {"Z": Z[0], "T": T, "C": np.zeros((B, m)), "a1": np.tile(a, (B, 1)), "P1": first, "RR": RR, "h": column(thetas, "sd_y") ** 2, "phi": column(thetas, "phi")}

    betas = (lambda theta: np.array([read(theta, f"beta_{k + 1}") for k in range(len(beta))])) if beta else None
    return ps.spec(build, betas, xreg, stack)


def ar1(rho, sigma, mu=0.0, sd_y=None, beta=(), xreg: np.ndarray | None = None, dist: str = "", phi=1.0) -> Spec:
    """A stationary AR(1) state, observed with Gaussian noise or through ``dist``."""
    ps = _Parameters()
    ps.add("rho", rho, False, -0.9999999, 0.9999999), ps.add("sigma", sigma, True, 0.0), ps.add("mu", mu, False)
    ps.add("sd_y", sd_y, True, 0.0), ps.add("phi", phi, True, 0.0)
    for k, b in enumerate(beta):
        ps.add(f"beta_{k + 1}", b, False)
    read = ps.reader()

    def build(theta: np.ndarray) -> Matrices:
        r, s, mean = read(theta, "rho"), read(theta, "sigma"), read(theta, "mu")
        one = np.ones((1, 1))
        var = s * s / (1 - r * r) if abs(r) < 1 else np.inf
        return Matrices(one, r * one, s * one, np.array([mean]), var * one, None if dist else read(theta, "sd_y") * one, None, np.array([mean * (1 - r)]), (dist,) if dist else (), (read(theta, "phi"),))

    betas = (lambda theta: np.array([read(theta, f"beta_{k + 1}") for k in range(len(beta))])) if beta else None
    return ps.spec(build, betas, xreg)


def volatility(rho, sd_ar, sigma=None, mu=None) -> Spec:
    """Stochastic volatility: y ~ N(0, scale^2 exp(alpha)), with either a scale ``sigma`` or a mean ``mu`` of alpha."""
    if (sigma is None) == (mu is None):
        raise ValueError("give one of sigma and mu")
    ps = _Parameters()
    ps.add("rho", rho, False, -0.9999999, 0.9999999), ps.add("sd_ar", sd_ar, False, 0.0), ps.add("sigma", sigma, False, 0.0), ps.add("mu", mu, False)
    read = ps.reader()

    def build(theta: np.ndarray) -> Matrices:
        r, s = read(theta, "rho"), read(theta, "sd_ar")
        mean, scale = (0.0, read(theta, "sigma")) if mu is None else (read(theta, "mu"), 1.0)
        one = np.ones((1, 1))
        return Matrices(one, r * one, s * one, np.array([mean]), s * s / (1 - r * r) * one, None, None, np.array([mean * (1 - r)]), ("svm",), (scale,))

    return ps.spec(build)


def general(build: Callable[[np.ndarray], Matrices], priors: dict[str, Prior] | None = None, logs: tuple[str, ...] = ()) -> Spec:
    """Any linear state-space model: own matrices (univariate or multivariate) from own parameters."""
    priors = priors or {}
    return Spec(tuple(priors), tuple(priors.values()), tuple(n in logs for n in priors), build)


def from_covariances(Z, T, Q, H, a1, P1, R=None, P1inf=None, kappa: float = 100.0, dist: tuple[str, ...] = (), phi: tuple[float, ...] = ()) -> Matrices:
    """Matrices from state and observation covariances, factored; diffuse parts of P1 get variance ``kappa``.

    With ``dist`` (one for each series observed) H must be None: ``phi`` has the dispersions, for "gaussian" the standard
    deviation. Exposures or trials stay with the series, in its column u.
    """
    from .kernels import root

    if (H is None) != bool(dist):
        raise ValueError("give either H or dist")
    Q, P1 = (np.atleast_2d(np.asarray(x, float)) for x in (Q, P1))
    R = np.eye(len(Q)) if R is None else np.asarray(R, float)
    P1 = P1 if P1inf is None else P1 + kappa * np.asarray(P1inf, float)
    root_h = None if H is None else root(np.atleast_2d(np.asarray(H, float)))
    return Matrices(np.atleast_2d(np.asarray(Z, float)), np.asarray(T, float), R @ root(Q), np.asarray(a1, float), P1, root_h, dist=tuple(dist), phi=tuple(phi))


def with_constants(model: Matrices, **changes) -> Matrices:
    return replace(model, **changes)
