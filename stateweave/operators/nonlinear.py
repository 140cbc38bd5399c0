"""Non-linear Gaussian models and diffusions: extended and unscented Kalman filters, particle filters, example models."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import priors as pr
from ..functions.priors import Prior
from ..functions.random import generator, normal
from . import folds, kernels
from .inference import per_series, summarised
from .models import Matrices


@dataclass(frozen=True)
class NonLinear:
    """y = Z(x) + H e, x' = T(x) + R n. ``Z`` and ``T`` take states (k x m) and parameters; Jacobians take one state."""

    Z: Callable
    T: Callable
    Z_gradient: Callable
    T_gradient: Callable
    H: Callable
    R: Callable
    a1: Callable
    P1: Callable
    priors: tuple[Prior, ...]
    natural: Callable


def _update(model: NonLinear, th, a, P, y, iterations: int):
    """One extended update, relinearised up to ``iterations`` times; innovations' log density."""
    seen = np.isfinite(y)
    if not seen.any():
        return a, P, 0.0
    HH = (model.H(th) @ model.H(th).T)[np.ix_(seen, seen)]
    x = a
    for k in range(iterations + 1):
        G = np.atleast_2d(model.Z_gradient(x, th))[seen]
        S = G @ P @ G.T + HH
        K = P @ G.T @ np.linalg.inv(S)
        v = y[seen] - model.Z(x[None], th)[0][seen] - G @ (a - x)
        new = a + K @ v
        if k == 0:
            v0, S0 = v, S
        if np.mean((new - x) ** 2) < 1e-4 and k:
            x = new
            break
        x = new
    J = np.eye(len(a)) - K @ G
    ll = -0.5 * (len(v0) * kernels.LOG_2PI + np.linalg.slogdet(S0)[1] + v0 @ np.linalg.solve(S0, v0))
    return x, J @ P @ J.T + K @ HH @ K.T, float(ll)


def extended_filter(model: NonLinear, y: np.ndarray, th: np.ndarray, iterations: int = 0) -> dict:
    n = len(y)
    a, P = np.asarray(model.a1(th), float), np.asarray(model.P1(th), float)
    RR = model.R(th) @ model.R(th).T
    out = {k: [] for k in ("a", "P", "att", "Ptt", "G")}
    loglik = 0.0
    for t in range(n):
        out["a"].append(a), out["P"].append(P)
        att, Ptt, ll = _update(model, th, a, P, y[t], iterations)
        loglik += ll
        G = np.atleast_2d(model.T_gradient(att, th))
        out["att"].append(att), out["Ptt"].append(Ptt), out["G"].append(G)
        a, P = model.T(att[None], th)[0], G @ Ptt @ G.T + RR
    out["a"].append(a), out["P"].append(P)
    return {k: np.array(v) for k, v in out.items()} | {"loglik": loglik}


def extended_smoother(model: NonLinear, y: np.ndarray, th: np.ndarray, iterations: int = 0) -> tuple[np.ndarray, np.ndarray, float]:
    """Means and variances by the backward recursion over the same linearisations."""
    f = extended_filter(model, y, th, iterations)
    n = len(y)
    means, variances = f["a"].copy(), f["P"].copy()
    for t in range(n - 1, -1, -1):
        C = f["Ptt"][t] @ f["G"][t].T @ np.linalg.pinv(f["P"][t + 1], hermitian=True)
        means[t] = f["att"][t] + C @ (means[t + 1] - f["a"][t + 1])
        variances[t] = f["Ptt"][t] + C @ (variances[t + 1] - f["P"][t + 1]) @ C.T
    return means, variances, f["loglik"]


def unscented_filter(model: NonLinear, y: np.ndarray, th: np.ndarray, alpha: float = 1e-3, beta: float = 2.0, kappa: float = 0.0) -> dict:
    n = len(y)
    a, P = np.asarray(model.a1(th), float), np.asarray(model.P1(th), float)
    m = len(a)
    lam = alpha**2 * (m + kappa) - m
    wm = np.full(2 * m + 1, 0.5 / (m + lam))
    wc = wm.copy()
    wm[0], wc[0] = lam / (m + lam), lam / (m + lam) + 1 - alpha**2 + beta
    HH, RR = model.H(th) @ model.H(th).T, model.R(th) @ model.R(th).T
    spread = lambda a, P: (lambda L: np.vstack([a, a + L.T, a - L.T]))(kernels.root((m + lam) * (P + P.T) / 2))
    out = {k: [] for k in ("a", "P", "att", "Ptt")}
    loglik = 0.0
    for t in range(n):
        out["a"].append(a), out["P"].append(P)
        seen = np.isfinite(y[t])
        if seen.any():
            x = spread(a, P)
            z = model.Z(x, th)[:, seen]
            mean = wm @ z
            S = (wc[:, None] * (z - mean)).T @ (z - mean) + HH[np.ix_(seen, seen)]
            K = (wc[:, None] * (x - a)).T @ (z - mean) @ np.linalg.inv(S)
            v = y[t][seen] - mean
            loglik -= 0.5 * (len(v) * kernels.LOG_2PI + np.linalg.slogdet(S)[1] + v @ np.linalg.solve(S, v))
            a, P = a + K @ v, P - K @ S @ K.T
        out["att"].append(a), out["Ptt"].append(P)
        x = spread(a, P)
        fx = model.T(x, th)
        a = wm @ fx
        P = (wc[:, None] * (fx - a)).T @ (fx - a) + RR
    out["a"].append(a), out["P"].append(P)
    return {k: np.array(v) for k, v in out.items()} | {"loglik": float(loglik)}


def _log_normal(d: np.ndarray, cov: np.ndarray) -> np.ndarray:
    """Log density of rows of d under N(0, cov), over coordinates with variance."""
    keep = np.flatnonzero(np.diag(cov) > kernels.TOLERANCE)
    if not len(keep):
        return np.zeros(len(d))
    L = np.linalg.cholesky(cov[np.ix_(keep, keep)])
    z = np.linalg.solve(L, d[:, keep].T)
    return -0.5 * ((z * z).sum(0) + len(keep) * kernels.LOG_2PI) - np.log(np.diag(L)).sum()


def _observed(model: NonLinear, th, x, y) -> np.ndarray:
    seen = np.isfinite(y)
    HH = (model.H(th) @ model.H(th).T)[np.ix_(seen, seen)]
    return _log_normal(y[seen] - model.Z(x, th)[:, seen], HH) if seen.any() else np.zeros(len(x))


def bootstrap(model: NonLinear, y: np.ndarray, th: np.ndarray, count: int, rng: np.random.Generator) -> dict:
    a1, L1, R = np.asarray(model.a1(th), float), kernels.root(np.asarray(model.P1(th), float)), model.R(th)
    return kernels.particles(
        len(y), count, lambda: a1 + rng.standard_normal((count, len(a1))) @ L1.T,
        lambda t, x: model.T(x, th) + rng.standard_normal((count, R.shape[1])) @ R.T, lambda t, x, _: _observed(model, th, x, y[t]), rng,
    )


def extended_particles(model: NonLinear, y: np.ndarray, th: np.ndarray, count: int, rng: np.random.Generator) -> dict:
    """Each particle is proposed from the extended update of its own prediction."""
    a1, P1 = np.asarray(model.a1(th), float), np.asarray(model.P1(th), float)
    RR, n = model.R(th) @ model.R(th).T, len(y)
    shift = {}

    def propose(t, mean, cov):
        if t >= n:
            return mean + rng.standard_normal(mean.shape) @ kernels.root(cov).T
        x, q = np.empty_like(mean), np.empty(len(mean))
        for k, row in enumerate(mean):
            a, P, _ = _update(model, th, row, cov, y[t], 0)
            x[k] = a + kernels.root(P) @ rng.standard_normal(len(a))
            q[k] = _log_normal((x[k] - a)[None], P)[0]
        shift[t] = _log_normal(x - mean, cov) - q
        return x

    return kernels.particles(
        n, count, lambda: propose(0, np.broadcast_to(a1, (count, len(a1))), P1), lambda t, x: propose(t + 1, model.T(x, th), RR),
        lambda t, x, _: _observed(model, th, x, y[t]) + shift[t], rng,
    )


def linearised(model: NonLinear, th: np.ndarray, mode: np.ndarray) -> Matrices:
    """The Gaussian model that touches the non-linear one along a path of n + 1 states."""
    n, m = len(mode) - 1, mode.shape[1]
    Z = np.stack([np.atleast_2d(model.Z_gradient(x, th)) for x in mode[:n]])
    T = np.stack([np.atleast_2d(model.T_gradient(x, th)) for x in mode[:n]])
    D = model.Z(mode[:n], th) - np.einsum("tpm,tm->tp", Z, mode[:n])
    C = model.T(mode[:n], th) - np.einsum("tij,tj->ti", T, mode[:n])
    return Matrices(Z, T, model.R(th), np.asarray(model.a1(th), float), np.asarray(model.P1(th), float).reshape(m, m), model.H(th), D, C)


def log_joint(model: NonLinear, th: np.ndarray, x: np.ndarray, y: np.ndarray) -> float:
    """log p(states) + log p(y | states) of one path of n + 1 states."""
    total = _log_normal((x[0] - np.asarray(model.a1(th)))[None], np.asarray(model.P1(th), float))[0]
    total += _log_normal(x[1:] - model.T(x[:-1], th), model.R(th) @ model.R(th).T).sum()
    return float(total + sum(_observed(model, th, x[t : t + 1], y[t])[0] for t in range(len(y))))


def approximation(model: NonLinear, th: np.ndarray, y: np.ndarray, rounds: int = 100, tolerance: float = 1e-8, iterations: int = 0) -> tuple[Matrices, np.ndarray]:
    """The linearisation at the states' mode, found from the extended smoother by Taylor steps that are halved if they overshoot."""
    mode = extended_smoother(model, y, th, iterations)[0]
    value = log_joint(model, th, mode, y)
    for _ in range(rounds):
        approx = linearised(model, th, mode)
        step = kernels.fast_means(approx, y[None], kernels.kalman(approx, y))[0] - mode
        for _ in range(15):
            new = log_joint(model, th, mode + step, y)
            if new >= value - 1e-9:
                break
            step = step / 2
        mode, change, value = mode + step, float(np.mean(step**2)), new
        if change < tolerance or not math.isfinite(value):
            break
    return linearised(model, th, mode), mode


def guided(model: NonLinear, y: np.ndarray, th: np.ndarray, count: int, rng: np.random.Generator) -> dict:
    """Particle filter that proposes from the linearisation's smoothing distribution; weights correct both densities."""
    approx, _ = approximation(model, th, y)
    s = kernels.smoother(approx, y)
    gains, roots = kernels.smoothing_moves(s)
    m, a1, P1 = len(approx.a1), approx.a1, approx.P1
    RR, HH = model.R(th) @ model.R(th).T, model.H(th) @ model.H(th).T

    def weight(t, x, before):
        seen = np.isfinite(y[t])
        out = _observed(model, th, x, y[t])
        if seen.any():
            out = out - _log_normal((y[t] - approx.at("D", t) - x @ approx.at("Z", t).T)[:, seen], HH[np.ix_(seen, seen)])
        if before is not None:
            d = x - model.T(before, th)
            out = out + _log_normal(d, RR) - _log_normal(x - approx.at("C", t - 1) - before @ approx.at("T", t - 1).T, RR)
        return out

    def move(t, x):
        return s["means"][t + 1] + (x - s["means"][t]) @ gains[t].T + rng.standard_normal((count, m)) @ roots[t + 1].T

    out = kernels.particles(len(y), count, lambda: s["means"][0] + rng.standard_normal((count, m)) @ roots[0].T, move, weight, rng)
    return out | {"loglik": out["loglik"] + s["loglik"]}


@dataclass(frozen=True)
class Diffusion:
    """dx = drift dt + diffusion dB between unit times; y has log density ``log_obs(y, x, theta)``."""

    drift: Callable
    diffusion: Callable
    diffusion_gradient: Callable
    log_obs: Callable
    x0: float
    positive: bool
    priors: tuple[Prior, ...]
    natural: Callable


def milstein(model: Diffusion, x: np.ndarray, th: np.ndarray, level: int, rng: np.random.Generator) -> np.ndarray:
    """States one unit of time on, in 2^level steps."""
    dt = 2.0**-level
    for _ in range(2**level):
        db = math.sqrt(dt) * rng.standard_normal(len(x))
        s = model.diffusion(x, th)
        x = x + model.drift(x, th) * dt + s * db + 0.5 * s * model.diffusion_gradient(x, th) * (db * db - dt)
        if model.positive:
            x = np.abs(x)
    return x


def diffusion_particles(model: Diffusion, y: np.ndarray, th: np.ndarray, count: int, level: int, rng: np.random.Generator) -> dict:
    step = lambda t, x: milstein(model, x[:, 0], th, level, rng)[:, None]
    weight = lambda t, x, _: model.log_obs(y[t, 0], x[:, 0], th) if np.isfinite(y[t, 0]) else np.zeros(count)
    return kernels.particles(len(y), count, lambda: step(0, np.full((count, 1), model.x0)), step, weight, rng)


def log_posterior(model: NonLinear | Diffusion, theta: np.ndarray, loglik: float) -> float:
    """Priors on the natural scale; ``natural`` also gives the log-Jacobian."""
    x, jacobian = model.natural(theta)
    return sum(p.log_density(float(v)) for p, v in zip(model.priors, x, strict=True)) + jacobian + loglik


def filter_series(series: DataFrame, model: NonLinear | Diffusion, theta, method: str = "ekf", count: int = 100, level: int = 4, iterations: int = 0, smoothed: bool = False, seed: int = 1) -> DataFrame:
    """t, mean, cov (flattened) and loglik of each series by ``ekf``, ``ukf``, ``bsf``, ``ekpf``, ``psi`` or, for a diffusion, ``sde``."""
    th = np.asarray(theta, float)

    def work(sid, y, u, x):
        rng = generator(seed, sid)
        if method in ("ekf", "ukf"):
            if smoothed:
                mean, cov, ll = extended_smoother(model, y, th, iterations)
            else:
                f = extended_filter(model, y, th, iterations) if method == "ekf" else unscented_filter(model, y, th)
                mean, cov, ll = f["att"], f["Ptt"], f["loglik"]
            n = len(y)
            return pd.DataFrame({"t": range(1, n + 1), "mean": mean[:n].tolist(), "cov": [c.ravel().tolist() for c in cov[:n]], "loglik": ll})
        pf = {"bsf": bootstrap, "ekpf": extended_particles, "psi": guided}[method](model, y, th, count, rng) if method != "sde" else diffusion_particles(model, y, th, count, level, rng)
        return summarised(pf, len(y), smoothed)

    return per_series(series, work, "t int, mean array<double>, cov array<double>, loglik double")


PARTICLES = {"bsf": bootstrap, "ekpf": extended_particles, "psi": guided}


def run_mcmc(
    series: DataFrame, model: NonLinear | Diffusion, start, iterations: int, burnin: int | None = None, method: str = "ekf", count: int = 50, coarse: int = 2, fine: int = 4, chains: int = 1, seed: int = 1,
    target: float = 0.234, gamma: float = 2 / 3, adapt_after: bool = True, thin: int = 1, S: np.ndarray | None = None, sampling: str = "bsf", extended: int = 0,
) -> DataFrame:
    """Jump chains: ``ekf`` likelihood (``extended`` iterations of each update), ``pm`` (particles by ``sampling``: bsf, ekpf or psi, or fine
    Milstein), or ``da``: ekf or coarse level, then pm. Every ``thin``-th iteration counts, ``S`` is the first proposal's factor, adaptation
    aims at ``target`` with exponent ``gamma`` and goes on after the burn-in unless ``adapt_after`` is off.

    A series with infinite values, times that aren't 1 to n, or no finite posterior at the start gives no rows.
    """
    from .inference import CHAIN, FAILURES, _arrays, dealt, _fault, _no_rows
    from .scan import written

    burn = iterations // 2 if burnin is None else burnin

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        sid, chain = frame["series_id"].iloc[0], int(frame["chain_id"].iloc[0])
        if _fault(frame, None):
            return _no_rows(c.split()[0] for c in CHAIN.split(", "))
        y, _, _ = _arrays(frame)
        rng = generator(seed, sid, chain)
        sde = isinstance(model, Diffusion)

        def exact(th):
            return (diffusion_particles(model, y, th, count, fine, rng) if sde else PARTICLES[sampling](model, y, th, count, rng))["loglik"]

        def cheap(th):
            return diffusion_particles(model, y, th, count, coarse, rng)["loglik"] if sde else extended_filter(model, y, th, extended)["loglik"]

        def second(th, approx):
            try:
                return exact(th) - approx
            except FAILURES:
                return -math.inf

        def density(th):
            base = log_posterior(model, th, 0.0)
            if not math.isfinite(base):
                return -math.inf, 0.0
            try:
                value = exact(th) if method == "pm" else cheap(th)
            except FAILURES:
                return -math.inf, 0.0
            return (base + value, value) if math.isfinite(value) else (-math.inf, 0.0)

        try:
            blocks = kernels.metropolis(np.asarray(start, float), density, iterations, burn, rng, S, target, gamma, adapt_after, second if method == "da" else None, thin)
        except kernels.NotFinite:
            blocks = []
        return _no_rows(c.split()[0] for c in CHAIN.split(", ")) if not blocks else pd.DataFrame({
            "series_id": sid, "chain_id": chain, "block": range(1, len(blocks) + 1), "count": [b[1] for b in blocks], "weight": 1.0, "log_posterior": [b[2] for b in blocks],
            "approx": [b[3] for b in blocks], "theta": [b[0].tolist() for b in blocks], "names": [[f"theta_{k + 1}" for k in range(len(start))]] * len(blocks),
        })

    keyed = series.withColumn("chain_id", F.explode(F.array(*(F.lit(k) for k in range(1, chains + 1)))))
    return written(dealt(keyed, "series_id", "chain_id").groupBy("series_id", "chain_id").applyInPandas(run, CHAIN), "chain")


def correct(chain: DataFrame, series: DataFrame, model: NonLinear | Diffusion, count: int = 50, sampling: str = "bsf", level: int = 4, seed: int = 1) -> DataFrame:
    """Importance weights exp(unbiased - cheap log-likelihood) for each block of an ``ekf`` (or coarse) chain; 0 for blocks that fail."""
    from .inference import FAILURES, _per_block

    def work(block, y, u, x):
        th, rng = np.array(block.theta), generator(seed, block.series_id, block.chain_id, block.block, "is")
        try:
            if isinstance(model, Diffusion):
                value = diffusion_particles(model, y, th, count, level, rng)["loglik"]
            else:
                value = PARTICLES[sampling](model, y, th, count, rng)["loglik"]
        except FAILURES:
            value = -math.inf
        gap = value - block.approx if math.isfinite(value) else -math.inf
        return {"log_weight": gap, "log_posterior": block.log_posterior + gap}

    keep = ["series_id", "chain_id", "block", "count", "log_posterior", "approx", "theta", "names"]
    rows = _per_block(chain, series, work, "log_weight double", keep)
    return rows.withColumn("weight", F.exp("log_weight")).select("series_id", "chain_id", "block", "count", "weight", "log_posterior", "approx", "theta", "names")


def _path(model: NonLinear | Diffusion, block, y, count: int, sampling: str, level: int, seed: int) -> np.ndarray | None:
    """A path of n + 1 states from the particles by which ``correct``, with the same arguments, weighted the block; ``ekf``: of the
    linearisation at the mode. None for a block of weight 0 or whose particles all vanished."""
    if not block.weight > 0:
        return None
    th, rng = np.array(block.theta), generator(seed, block.series_id, block.chain_id, block.block, "is")
    if isinstance(model, Diffusion):
        pf = diffusion_particles(model, y, th, count, level, rng)
    elif sampling == "ekf":
        approx, _ = approximation(model, th, y)
        return kernels.simulation_smoother(approx, y, 1, rng)[0]
    else:
        pf = PARTICLES[sampling](model, y, th, count, rng)
    if not math.isfinite(pf["loglik"]):
        return None
    paths = kernels.trace(pf)
    return paths[rng.integers(len(paths))]


BLOCK = ["series_id", "chain_id", "block", "count", "weight"]


def state_draws(chain: DataFrame, series: DataFrame, model: NonLinear | Diffusion, count: int = 50, sampling: str = "bsf", level: int = 4, seed: int = 1) -> DataFrame:
    """t (1 to n + 1), variable, value and weight: a posterior state path of each block, of non-linear models and diffusions."""
    from .inference import _long_path, _per_block

    def work(block, y, u, x):
        path = _path(model, block, y, count, sampling, level, seed)
        return None if path is None else {"first": 1, "path": path.tolist()}

    return _long_path(_per_block(chain, series, work, "first int, path array<array<double>>", BLOCK))


def state_summary(chain: DataFrame, series: DataFrame, model: NonLinear, iterations: int = 0) -> DataFrame:
    """Posterior mean and variance of each state of an ``ekf`` chain, by the extended smoother at every block."""
    from .inference import _variances

    return _variances(state_covariances(chain, series, model, iterations))


def state_covariances(chain: DataFrame, series: DataFrame, model: NonLinear, iterations: int = 0) -> DataFrame:
    """Posterior means and covariances of all pairs of states at each time, by the extended smoother at every block."""
    from .inference import STATE_BLOCK, _mixed_moments, _per_block

    def work(block, y, u, x):
        means, variances, _ = extended_smoother(model, y, np.array(block.theta), iterations)
        return {"mean": np.asarray(means).tolist(), "cov": np.asarray(variances).tolist()}

    return _mixed_moments(_per_block(chain, series, work, STATE_BLOCK, BLOCK))


def _responds(model, what: str) -> None:
    if isinstance(model, Diffusion):
        raise TypeError(f"{what} of a diffusion: it has a density of the observations, but nothing to draw them from; see state_draws, and predict with kind='state'")


def fitted(chain: DataFrame, series: DataFrame, model: NonLinear, kind: str = "mean", count: int = 50, sampling: str = "bsf", seed: int = 1) -> DataFrame:
    """t (1 to n), variable, value and weight from each block: the mean Z(state), or a response, at the observed times."""
    from .inference import _long_path, _per_block

    _responds(model, "fitted values")

    def work(block, y, u, x):
        th, rng = np.array(block.theta), generator(seed, block.series_id, block.chain_id, block.block, "fitted")
        path = _path(model, block, y, count, sampling, 0, seed)
        if path is None:
            return None
        z = model.Z(path[: len(y)], th)
        return {"first": 1, "path": (z if kind == "mean" else z + rng.standard_normal(z.shape) @ model.H(th).T).tolist()}

    return _long_path(_per_block(chain, series, work, "first int, path array<array<double>>", BLOCK))


def approximate(series: DataFrame, model: NonLinear, theta, iterations: int = 0) -> DataFrame:
    """t, the states' mode and the linearisation's Z, T, D and C (flattened) of each series; n + 1 modes, n matrices."""
    th = np.asarray(theta, float)

    def work(sid, y, u, x):
        approx, mode = approximation(model, th, y, iterations=iterations)
        flat = lambda a: [*(v.ravel().tolist() for v in a), None]
        return pd.DataFrame({"t": range(1, len(y) + 2), "mode": mode.tolist(), "z": flat(approx.Z), "transition": flat(approx.T), "d": flat(approx.D), "c": flat(approx.C)})

    return per_series(series, work, "t int, mode array<double>, z array<double>, transition array<double>, d array<double>, c array<double>")


def suggest_count(series: DataFrame, model: NonLinear, theta, candidates: tuple[int, ...] = (10, 20, 40, 80), replications: int = 100, sampling: str = "psi", seed: int = 1) -> DataFrame:
    """Standard deviation of the log-likelihood estimate by number of particles, for the candidates a series has tried; ``suggested`` is its first under 1."""
    from .inference import in_rounds

    th = np.asarray(theta, float)

    def work(block, y, u, x):
        run = PARTICLES[sampling]
        return {"loglik": run(model, y, th, int(block.chain_id), generator(seed, block.series_id, block.chain_id, block.block))["loglik"]}

    return in_rounds(series, work, candidates, replications)


def predict(chain: DataFrame, series: DataFrame, model: NonLinear | Diffusion, horizon: int, count: int = 50, seed: int = 1, kind: str = "response", sampling: str = "bsf", level: int = 4) -> DataFrame:
    """t, variable, value and weight of ``horizon`` future steps from each block, as ``response``, ``mean`` or ``state``.

    They start from state n + 1 of the path by which ``correct``, with the same count, sampling, level and seed, weighted the
    block. Diffusions have states only.
    """
    from .inference import _long_path, _per_block

    sde = isinstance(model, Diffusion)
    if kind != "state":
        _responds(model, "responses and means")

    def work(block, y, u, x):
        th, rng = np.array(block.theta), generator(seed, block.series_id, block.chain_id, block.block, "predict")
        path, out = _path(model, block, y, count, sampling, level, seed), []
        if path is None:
            return None
        x = path[-1][None]
        for _ in range(horizon):
            if sde:
                out.append(x[0].tolist())
                x = milstein(model, x[:, 0], th, level, rng)[:, None]
                continue
            z, H, R = model.Z(x, th), model.H(th), model.R(th)
            out.append((x if kind == "state" else z if kind == "mean" else z + rng.standard_normal((1, H.shape[1])) @ H.T)[0].tolist())
            x = model.T(x, th) + rng.standard_normal((1, R.shape[1])) @ R.T
        return {"first": len(y) + 1, "path": out}

    return _long_path(_per_block(chain, series, work, "first int, path array<array<double>>", BLOCK))


def milstein_column(x0: float, drift, diffusion, gradient, steps: Column, dt: float, seed: Column) -> Column:
    """A Milstein path as a column fold: the state after each of ``steps`` steps, with hash random numbers.

    The increments are drawn before the fold: within it every mention of one would draw it again.
    """

    def move(x: Column, db: Column) -> Column:
        s = diffusion(x)
        return x + drift(x) * dt + s * db + 0.5 * s * gradient(x) * (db * db - dt)

    increments = F.transform(F.sequence(F.lit(1), steps), lambda k: math.sqrt(dt) * normal(seed, k))
    return folds.walk(F.lit(float(x0)), increments, move)


def example(name: str):
    """Six ready models: sde_poisson_ou, sde_gbm, nlg_linear_gaussian, nlg_sin_exp, nlg_growth, nlg_ar_exp."""
    one = np.ones((1, 1))
    ex = lambda th: (np.exp(th), float(np.sum(th)))
    if name == "sde_poisson_ou":  # theta: log rho, nu, log sigma
        return Diffusion(
            lambda x, th: math.exp(th[0]) * (th[1] - x), lambda x, th: math.exp(th[2]) + 0 * x, lambda x, th: 0 * x,
            lambda y, x, th: y * x - np.exp(x) - math.lgamma(y + 1), 0.0, False, (pr.gamma(1, 2, 2), pr.normal(0, 0, 4), pr.halfnormal(1, 1)),
            lambda th: ((math.exp(th[0]), th[1], math.exp(th[2])), th[0] + th[2]),
        )
    if name == "sde_gbm":  # theta: mu, sigma_x, sigma_y
        return Diffusion(
            lambda x, th: th[0] * x, lambda x, th: np.maximum(0, th[1] * x), lambda x, th: th[1] + 0 * x,
            lambda y, x, th: -0.5 * ((y - np.log(np.maximum(x, 1e-300))) / th[2]) ** 2 - math.log(th[2]) - 0.5 * kernels.LOG_2PI, 1.0, True,
            (pr.tnormal(0.1, 0, 0.1, 0), pr.tnormal(0.5, 0, 0.5, 0), pr.tnormal(1.5, 1.5, 0.5, 0.5)), lambda th: (th, 0.0),
        )
    if name == "nlg_linear_gaussian":  # theta: log H
        return NonLinear(
            lambda x, th: x, lambda x, th: x, lambda x, th: one, lambda x, th: one, lambda th: math.exp(th[0]) * one, lambda th: one,
            lambda th: [0.0], lambda th: one, (pr.halfnormal(1, 1),), ex,
        )
    if name == "nlg_sin_exp":  # theta: log H, log R
        return NonLinear(
            lambda x, th: np.exp(x), lambda x, th: np.sin(x), lambda x, th: np.exp(x)[None], lambda x, th: np.cos(x)[None],
            lambda th: math.exp(th[0]) * one, lambda th: math.exp(th[1]) * one, lambda th: [0.0], lambda th: one, (pr.halfnormal(1, 1), pr.halfnormal(1, 1)), ex,
        )
    if name == "nlg_ar_exp":  # theta: mu, rho, log sigma_x, log sigma_y
        return NonLinear(
            lambda x, th: np.exp(x), lambda x, th: th[0] * (1 - th[1]) + th[1] * x, lambda x, th: np.exp(x)[None], lambda x, th: th[1] * one,
            lambda th: math.exp(th[3]) * one, lambda th: math.exp(th[2]) * one, lambda th: [th[0]], lambda th: math.exp(2 * th[2]) / max(1e-9, 1 - th[1] ** 2) * one,
            (pr.normal(0, 0, 10), pr.uniform(0.5, 0, 1), pr.halfnormal(1, 1), pr.halfnormal(1, 1)), lambda th: ((th[0], th[1], math.exp(th[2]), math.exp(th[3])), th[2] + th[3] + _beta22(th[1])),
        )
    if name == "nlg_growth":  # state: logit r, p; theta: log H, log R1, log R2
        dt, cap = 0.1, 500.0

        def grow(x, th):
            r = 1 / (1 + np.exp(-x[:, 0]))
            g = np.exp(r * dt)
            return np.column_stack([x[:, 0], cap * x[:, 1] * g / (cap + x[:, 1] * (g - 1))])

        def gradient(x, th):
            r = 1 / (1 + math.exp(-x[0]))
            g, p = math.exp(r * dt), x[1]
            den = cap + p * (g - 1)
            return np.array([[1.0, 0.0], [cap * p * (cap - p) * g * dt * r * (1 - r) / den**2, cap**2 * g / den**2]])

        return NonLinear(
            lambda x, th: x[:, 1:], grow, lambda x, th: np.array([[0.0, 1.0]]), gradient, lambda th: math.exp(th[0]) * one, lambda th: np.diag(np.exp(th[1:3])),
            lambda th: [0.0, 50.0], lambda th: np.diag([1.0, 100.0]), (pr.halfnormal(1, 2),) * 3, ex,
        )
    raise ValueError(f"no example {name}")


def _beta22(x: float) -> float:
    """Log kernel of Beta(2, 2)."""
    return math.log(x * (1 - x)) if 0 < x < 1 else -math.inf
