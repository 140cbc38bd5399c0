"""Numpy recursions for one series, called inside tasks; the Spark operators group, ship and reshape around them.

Series are n x p arrays with NaN for missing values. n + 1 predictions go with n observations; filter comes before predict.
"""

from __future__ import annotations

import math

import numpy as np

from .models import Matrices

TOLERANCE = 1e-12
LOG_2PI = math.log(2 * math.pi)
lgamma = np.frompyfunc(math.lgamma, 1, 1)


def root(cov: np.ndarray) -> np.ndarray:
    """A lower Cholesky factor that leaves out coordinates of no variance."""
    out = np.zeros_like(cov)
    keep = np.flatnonzero(np.diag(cov) > TOLERANCE)
    if len(keep):
        out[np.ix_(keep, keep)] = np.linalg.cholesky(cov[np.ix_(keep, keep)])
    return out


def kalman(model: Matrices, y: np.ndarray) -> dict[str, np.ndarray | float]:
    """Predictions, filtered moments and the log-likelihood; steps keep what the smoothers need."""
    n, m = len(y), len(model.a1)
    a, P = model.a1.astype(float), model.P1.astype(float)
    out = {"a": np.empty((n + 1, m)), "P": np.empty((n + 1, m, m)), "att": np.empty((n, m)), "Ptt": np.empty((n, m, m))}
    loglik, steps, eye = 0.0, [], np.eye(m)
    for t in range(n):
        out["a"][t], out["P"][t] = a, P
        seen = np.isfinite(y[t])
        Z, H = model.at("Z", t)[seen], model.at("H", t)
        HH = (H @ H.T)[np.ix_(seen, seen)]
        F = Z @ P @ Z.T + HH
        T, R = model.at("T", t), model.at("R", t)
        ok = seen.any() and (np.diag(F) > TOLERANCE).all()
        if ok:
            v = y[t][seen] - model.at("D", t)[seen] - Z @ a
            try:
                L = np.linalg.cholesky(F)
            except np.linalg.LinAlgError:
                return out | {"loglik": -math.inf, "steps": steps}
            w = np.linalg.solve(L, v)
            loglik -= 0.5 * (len(v) * LOG_2PI + w @ w) + np.log(np.diag(L)).sum()
            Fi = np.linalg.inv(F)
            K = P @ Z.T @ Fi
            J = eye - K @ Z
            a, P = a + K @ v, J @ P @ J.T + K @ HH @ K.T
            steps.append((Z, Fi, v, K))
        else:
            steps.append(None)
        out["att"][t], out["Ptt"][t] = a, P
        a = model.at("C", t) + T @ a
        P = T @ P @ T.T + R @ R.T
        P = (P + P.T) / 2
    out["a"][n], out["P"][n] = a, P
    return out | {"loglik": loglik, "steps": steps}


def smoother(model: Matrices, y: np.ndarray) -> dict[str, np.ndarray | float]:
    """Smoothed means and variances for n + 1 times, and covariances of states one step apart."""
    f = kalman(model, y)
    n, m = len(y), len(model.a1)
    means, variances, lag = f["a"].copy(), f["P"].copy(), np.zeros((n, m, m))
    r, N = np.zeros(m), np.zeros((m, m))
    for t in range(n - 1, -1, -1):
        T, P = model.at("T", t), f["P"][t]
        step = f["steps"][t]
        L = T if step is None else T @ (np.eye(m) - step[3] @ step[0])
        lag[t] = P @ L.T @ (np.eye(m) - N @ f["P"][t + 1])
        r, N = L.T @ r, L.T @ N @ L
        if step is not None:
            Z, Fi, v, _ = step
            r, N = r + Z.T @ Fi @ v, N + Z.T @ Fi @ Z
        means[t] = f["a"][t] + P @ r
        variances[t] = P - P @ N @ P
    return {"means": means, "variances": variances, "lag": lag, "loglik": f["loglik"]}


def simulate(model: Matrices, n: int, draws: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """States (draws x (n + 1) x m) and observations (draws x n x p) from the model."""
    m, p = len(model.a1), model.Z.shape[-2]
    states, ys = np.empty((draws, n + 1, m)), np.empty((draws, n, p))
    x = model.a1 + rng.standard_normal((draws, m)) @ root(model.P1).T
    for t in range(n):
        states[:, t] = x
        ys[:, t] = model.at("D", t) + x @ model.at("Z", t).T + rng.standard_normal((draws, p)) @ model.at("H", t).T
        R = model.at("R", t)
        x = model.at("C", t) + x @ model.at("T", t).T + rng.standard_normal((draws, R.shape[1])) @ R.T
    states[:, n] = x
    return states, ys


def fast_means(model: Matrices, ys: np.ndarray, f: dict) -> np.ndarray:
    """Smoothed means of many series (draws x n x p) with the same missing pattern, by one set of gains."""
    draws, n, m = len(ys), ys.shape[1], len(model.a1)
    a = np.broadcast_to(model.a1, (draws, m))
    kept = []
    for t in range(n):
        step = f["steps"][t]
        v = None
        kept.append((a, v))
        if step is not None:
            Z, Fi, v0, K = step
            seen = np.isfinite(ys[0, t])
            v = ys[:, t, seen] - model.at("D", t)[seen] - a @ Z.T
            kept[-1] = (a, v)
            a = a + v @ K.T
        a = model.at("C", t) + a @ model.at("T", t).T
    out = np.empty((draws, n + 1, m))
    out[:, n] = a
    r = np.zeros((draws, m))
    for t in range(n - 1, -1, -1):
        step, T = f["steps"][t], model.at("T", t)
        L = T if step is None else T @ (np.eye(m) - step[3] @ step[0])
        r = r @ L
        a, v = kept[t]
        if step is not None:
            r = r + v @ (step[1].T @ step[0])
        out[:, t] = a + r @ f["P"][t].T
    return out


def simulation_smoother(model: Matrices, y: np.ndarray, draws: int, rng: np.random.Generator, antithetic: bool = True) -> np.ndarray:
    """States given y (draws x (n + 1) x m): simulated paths corrected by the smoothed difference; antithetic pairs mirror."""
    f = kalman(model, y)
    mean = fast_means(model, y[None], f)[0]
    half = (draws + 1) // 2 if antithetic and draws > 1 else draws
    states, ys = simulate(model, len(y), half, rng)
    ys = np.where(np.isfinite(y), ys, np.nan)
    noise = states - fast_means(model, ys, f)
    return (mean + np.concatenate([noise, -noise]))[:draws] if half < draws else mean + noise


def obs_kernel(dist: str, y, s, u, phi):
    with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
        return {
            "svm": lambda: -0.5 * (s + (y / phi) ** 2 * np.exp(-s)), "poisson": lambda: y * s - u * np.exp(s),
            "binomial": lambda: y * s - u * np.logaddexp(0, s), "negative binomial": lambda: y * s - (y + phi) * np.log(phi + u * np.exp(s)),
            "gamma": lambda: -phi * (s + y * np.exp(-s) / u), "gaussian": lambda: -0.5 * ((y - s) / phi) ** 2,
        }[dist]()


def obs_const(dist: str, y: np.ndarray, u, phi) -> np.ndarray:
    g = lambda x: lgamma(x).astype(float)
    y = np.asarray(y, float)
    return {
        "svm": lambda: -0.5 * LOG_2PI - math.log(phi) + 0 * y, "poisson": lambda: y * np.log(u) - g(y + 1),
        "binomial": lambda: g(u + 1) - g(y + 1) - g(u - y + 1),
        "negative binomial": lambda: g(y + phi) - g(y + 1) - math.lgamma(phi) + phi * math.log(phi) + y * np.log(u),
        "gamma": lambda: phi * math.log(phi) - math.lgamma(phi) + (phi - 1) * np.log(y) - phi * np.log(u), "gaussian": lambda: -0.5 * LOG_2PI - math.log(phi) + 0 * y,
    }[dist]()


def laplace_step(dist: str, y, s, u, phi):
    """Pseudo-observation and pseudo-variance at signal s."""
    e = np.exp(s)
    if dist == "svm":
        h = 2 * e / (np.maximum(np.abs(y), 1e-4) / phi) ** 2
        return s + 1 - h / 2, h
    if dist == "poisson":
        return y / (u * e) + s - 1, 1 / (u * e)
    if dist == "binomial":
        h = (1 + e) ** 2 / (u * e)
        return y * h + s - 1 - e, h
    if dist == "negative binomial":
        m = u * e
        return s + (phi + m) * (y - m) / ((y + phi) * m), (phi + m) ** 2 / (phi * m * (y + phi))
    if dist == "gamma":
        return s - u * e / y + 1, u * e / (y * phi)
    return y, phi * phi + 0 * y


def start_signal(dist: str, y: np.ndarray, u: np.ndarray) -> np.ndarray:
    z = np.nan_to_num(y, nan=0.0)
    if dist == "svm":
        return np.log(np.maximum(1e-4, z * z))
    if dist == "binomial":
        p = np.where(np.isfinite(y), (z + 0.5) / (u + 1), 0.5)
        return np.log(p / (1 - p))
    return z if dist == "gaussian" else np.log(np.maximum(z / u, {"poisson": 0.1, "gamma": 1.0}.get(dist, 1 / 6)))


def signals(model: Matrices, states: np.ndarray) -> np.ndarray:
    """D + Z alpha for states with times on the last axis but one; the last time (n + 1) is left out."""
    n = states.shape[-2] - 1
    Z = model.Z if model.Z.ndim == 3 else np.broadcast_to(model.Z, (n, *model.Z.shape))
    return (model.D[:n] if model.D.ndim == 2 else model.D) + np.einsum("tpm,...tm->...tp", Z[:n], states[..., :n, :])


class Approximation:
    """The Gaussian model whose posterior has the same mode: pseudo-observations ``y`` and ``model``; ``loglik`` is its
    approximate log-likelihood of the data."""

    def __init__(self, model: Matrices, y: np.ndarray, u: np.ndarray, rounds: int = 100, tolerance: float = 1e-8, mode: np.ndarray | None = None):
        n, p = y.shape
        self.source, self.data, self.u = model, y, u
        s = np.column_stack([start_signal(d, y[:, j], u[:, j]) for j, d in enumerate(model.dist)]) if mode is None else mode
        if mode is None and rounds > 1 and batchable(model):
            s = find_modes(stacked([model]), model.dist[0], y.T, u.T, offsets([model], n), rounds, tolerance)[0].T
            rounds = 0
        for _ in range(rounds):
            self.step(s)
            new = signals(self.model, fast_means(self.model, self.y[None], kalman(self.model, self.y))[0])
            change = float(np.mean((new - s) ** 2))
            s = new
            if not math.isfinite(change) or change < tolerance:
                break
        self.mode = s
        if mode is None or rounds == 0:
            self.step(s)
        if rounds == 0 and batchable(model):
            models = stacked([model])
            g = float(forward(models, self.y.T - offsets([model], n), self.model.H[:, 0, 0][None] ** 2)[0][0])
        else:
            g = kalman(self.model, self.y)["loglik"]
        seen = np.isfinite(y)
        const = sum(float(obs_const(d, y[seen[:, j], j], u[seen[:, j], j], model.phi[j]).sum()) for j, d in enumerate(model.dist))
        var = np.stack([np.diag(h) ** 2 for h in self.model.H])
        self.gauss_const = float((-0.5 * (LOG_2PI + np.log(var[seen]))).sum())
        self.const = const
        self.scales = np.where(seen, self.ratio(s[None])[0], 0.0)
        self.loglik = g + const - self.gauss_const + float(self.scales.sum()) if math.isfinite(g) else -math.inf

    def step(self, s: np.ndarray) -> None:
        pairs = [laplace_step(d, self.data[:, j], s[:, j], self.u[:, j], self.source.phi[j]) for j, d in enumerate(self.source.dist)]
        y = np.column_stack([p[0] for p in pairs])
        h = np.column_stack([p[1] for p in pairs])
        h = np.where(np.isfinite(h), h, 1.0)
        src = self.source
        self.y = np.where(np.isfinite(self.data), y, np.nan)
        self.model = Matrices(src.Z, src.T, src.R, src.a1, src.P1, np.stack([np.diag(np.sqrt(x)) for x in h]), src.D, src.C)

    def ratio(self, s: np.ndarray) -> np.ndarray:
        """log g - log of the Gaussian's kernel for signals (draws x n x p); 0 where y is missing."""
        var = np.stack([np.diag(h) ** 2 for h in self.model.H])
        g = np.stack([obs_kernel(d, self.data[:, j], s[..., j], self.u[:, j], self.source.phi[j]) for j, d in enumerate(self.source.dist)], -1)
        return np.where(np.isfinite(self.data), g + 0.5 * (self.y - s) ** 2 / var, 0.0)

    def importance(self, draws: int, rng: np.random.Generator, antithetic: bool = True) -> tuple[np.ndarray, np.ndarray, float]:
        """States, log weights (over the mode's) and an unbiased log-likelihood, by simulated smoothing."""
        states = simulation_smoother(self.model, self.y, draws, rng, antithetic)
        w = (self.ratio(signals(self.model, states)) - self.scales).sum((1, 2))
        top = w.max()
        return states, w, self.loglik + top + math.log(np.exp(w - top).mean())


def resample(w: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Stratified ancestors of normalised weights."""
    upto = np.cumsum(w)
    upto[-1] = 1.0
    return np.searchsorted(upto, (rng.random(len(w)) + np.arange(len(w))) / len(w))


def particles(n: int, count: int, first, move, log_weight, rng: np.random.Generator) -> dict:
    """A particle filter: ``first()`` draws count states, ``move(t, x)`` the next ones, ``log_weight(t, x, previous)``.

    Resamples every step and moves on to n + 1 with even weights. Returns states ((n + 1) x count x m), weights, ancestors, loglik.
    If all weights vanish, the log-likelihood is minus infinity and all later states are NaN.
    """
    x = first()
    states, weights, ancestors = np.full((n + 1, count, x.shape[1]), np.nan), np.ones((n + 1, count)) / count, np.zeros((n, count), int)
    loglik, before = 0.0, None
    for t in range(n):
        states[t] = x
        lw = log_weight(t, x, before)
        top = lw.max()
        if not math.isfinite(top):
            return {"states": states, "weights": weights, "ancestors": ancestors, "loglik": -math.inf}
        w = np.exp(lw - top)
        loglik += top + math.log(w.mean())
        weights[t] = w / w.sum()
        ancestors[t] = resample(weights[t], rng)
        before = x[ancestors[t]]
        x = move(t, before)
    states[n] = x
    return {"states": states, "weights": weights, "ancestors": ancestors, "loglik": loglik}


def trace(pf: dict) -> np.ndarray:
    """Paths (count x (n + 1) x m) along the ancestors of the last particles."""
    states, anc = pf["states"], pf["ancestors"]
    at = np.arange(states.shape[1])
    out = np.empty((states.shape[1], len(states), states.shape[2]))
    out[:, -1] = states[-1]
    for t in range(len(anc) - 1, -1, -1):
        at = anc[t][at]
        out[:, t] = states[t, at]
    return out


def bootstrap(model: Matrices, y: np.ndarray, u: np.ndarray, count: int, rng: np.random.Generator) -> dict:
    """Bootstrap filter of a linear state with Gaussian (H) or other (``dist``) observations."""
    n, m = len(y), len(model.a1)
    const = 0.0
    if model.dist:
        seen = np.isfinite(y)
        const = sum(float(obs_const(d, y[seen[:, j], j], u[seen[:, j], j], model.phi[j]).sum()) for j, d in enumerate(model.dist))

    def weight(t, x, _):
        seen = np.flatnonzero(np.isfinite(y[t]))
        s = model.at("D", t) + x @ model.at("Z", t).T
        if not len(seen):
            return np.zeros(count)
        if model.dist:
            return sum(obs_kernel(model.dist[j], y[t, j], s[:, j], u[t, j], model.phi[j]) for j in seen)
        H = model.at("H", t)
        L = np.linalg.cholesky((H @ H.T)[np.ix_(seen, seen)])
        z = np.linalg.solve(L, (y[t] - s)[:, seen].T)
        return -0.5 * ((z * z).sum(0) + len(seen) * LOG_2PI) - np.log(np.diag(L)).sum()

    def move(t, x):
        R = model.at("R", t)
        return model.at("C", t) + x @ model.at("T", t).T + rng.standard_normal((count, R.shape[1])) @ R.T

    out = particles(n, count, lambda: model.a1 + rng.standard_normal((count, m)) @ root(model.P1).T, move, weight, rng)
    return out | {"loglik": out["loglik"] + const}


def smoothing_moves(s: dict) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Regressions of each smoothed state on the one before, and factors of what they leave; first the first state's own."""
    V, lag = s["variances"], s["lag"]
    gains = lag.transpose(0, 2, 1) @ np.linalg.pinv(V[:-1], hermitian=True)
    C = V[1:] - gains @ lag
    vals, vecs = np.linalg.eigh((C + C.transpose(0, 2, 1)) / 2)
    return list(gains), [root(V[0]), *(vecs * np.sqrt(np.maximum(vals, 0))[:, None, :])]


def guided(approx: Approximation, count: int, rng: np.random.Generator) -> dict:
    """Particle filter that proposes from the approximating model's smoothing distribution (exact if that is the model)."""
    s = smoother(approx.model, approx.y)
    gains, roots = smoothing_moves(s)
    m = len(approx.model.a1)

    def weight(t, x, _):
        sig = approx.model.at("D", t) + x @ approx.model.at("Z", t).T
        h = np.diag(approx.model.at("H", t)) ** 2
        out = np.zeros(count)
        for j, d in enumerate(approx.source.dist):
            if np.isfinite(approx.data[t, j]):
                out += obs_kernel(d, approx.data[t, j], sig[:, j], approx.u[t, j], approx.source.phi[j]) + 0.5 * (approx.y[t, j] - sig[:, j]) ** 2 / h[j] - approx.scales[t, j]
        return out

    def move(t, x):
        return s["means"][t + 1] + (x - s["means"][t]) @ gains[t].T + rng.standard_normal((count, m)) @ roots[t + 1].T

    out = particles(len(approx.y), count, lambda: s["means"][0] + rng.standard_normal((count, m)) @ roots[0].T, move, weight, rng)
    return out | {"loglik": approx.loglik + out["loglik"]}


class NotFinite(ValueError):
    """The posterior is not finite at the starting values."""


def adapt(S: np.ndarray, z: np.ndarray, accept: float, target: float, step: int, gamma: float) -> np.ndarray:
    """Robust adaptive Metropolis: the proposal's factor after step ``step`` with acceptance probability ``accept``."""
    eta = min(1.0, len(z) * step**-gamma)
    norm = z @ z
    if norm == 0:
        return S
    inner = np.eye(len(z)) + eta * (accept - target) * np.outer(z, z) / norm
    return np.linalg.cholesky(S @ inner @ S.T)


def metropolis(start: np.ndarray, log_target, iterations: int, burnin: int, rng: np.random.Generator, S: np.ndarray | None = None, target: float = 0.234, gamma: float = 2 / 3, adapt_after: bool = True, second_stage=None, thin: int = 1) -> list[tuple]:
    """A jump chain [theta, count, log target, extra] of every ``thin``-th iteration after burn-in.

    ``log_target(theta)`` gives (log density, extra). With ``second_stage(theta, extra)`` (a log correction) acceptance is
    delayed: the correction is computed only for proposals that pass the first test.
    """
    theta = start.copy()
    d = len(theta)
    S = np.diag(0.1 * np.maximum(0.1, np.abs(theta))) if S is None else S.copy()
    current, extra = log_target(theta)
    if not math.isfinite(current):
        raise NotFinite("the posterior is not finite at the starting values")
    fix = second_stage(theta, extra) if second_stage else 0.0
    chain: list[list] = []
    moved = True
    for i in range(1, iterations + 1):
        z = rng.standard_normal(d)
        proposal = theta + S @ z
        value, info = log_target(proposal)
        accept = math.exp(min(0.0, value - current)) if math.isfinite(value) else 0.0
        if rng.random() < accept:
            new = second_stage(proposal, info) if second_stage else 0.0
            if not second_stage or (math.isfinite(new) and rng.random() < math.exp(min(0.0, new - fix))):
                theta, current, extra, fix, moved = proposal, value, info, new, True
        if i > burnin and (i - burnin) % thin == 0:
            if moved or not chain:
                chain.append([theta, 0, current + fix, extra])
                moved = False
            chain[-1][1] += 1
        if i <= burnin or adapt_after:
            S = adapt(S, z, accept, target, i, gamma)
    return [tuple(c) for c in chain]


def batchable(model: Matrices) -> bool:
    """Whether the batched recursions can take it: one variable and no matrix but D over time."""
    return len(model.dist) < 2 and model.Z.shape == (1, len(model.a1)) and model.T.ndim == model.R.ndim == 2 and (model.H.ndim == 2 or bool(model.dist)) and model.C.ndim == 1


def stacked(built: list[Matrices]) -> dict[str, np.ndarray]:
    """Many models of one shape as arrays with a row for each; Z and T stay single if all share them."""
    stack = lambda f: np.stack([f(x) for x in built])
    same = all(np.array_equal(x.Z, built[0].Z) and np.array_equal(x.T, built[0].T) for x in built)
    Z, T = (built[0].Z[0], built[0].T) if same else (stack(lambda x: x.Z[0]), stack(lambda x: x.T))
    return {
        "Z": Z, "T": T, "C": stack(lambda x: x.C), "a1": stack(lambda x: x.a1), "P1": stack(lambda x: x.P1), "RR": stack(lambda x: x.R @ x.R.T),
        "h": np.array([x.H[..., 0, 0].max() ** 2 for x in built]), "phi": np.array([x.phi[0] for x in built]),
    }


def batchable_many(model: Matrices) -> bool:
    """Whether ``forward_many`` can take it: several Gaussian variables and no matrix but D over time."""
    return not model.dist and model.Z.ndim == model.H.ndim == model.T.ndim == model.R.ndim == 2 and model.C.ndim == 1


def forward_many(built: list[Matrices], data: np.ndarray) -> np.ndarray:
    """Log-likelihoods of many series of several variables (rows x times x variables; NaN if missing or past their end), each under its own model."""
    stack = lambda f: np.stack([f(x) for x in built])
    Z, T, C, HH, RR = (stack(f) for f in (lambda x: x.Z, lambda x: x.T, lambda x: x.C, lambda x: x.H @ x.H.T, lambda x: x.R @ x.R.T))
    a, P = stack(lambda x: x.a1), stack(lambda x: x.P1)
    B, n, p = data.shape
    D = np.zeros((B, n, p))
    for k, x in enumerate(built):
        D[k, : min(n, len(x.D)) if x.D.ndim == 2 else n] = x.D[:n] if x.D.ndim == 2 else x.D
    seen = np.isfinite(data)
    resid, eye = np.where(seen, data - D, 0.0), np.eye(p)
    Tt, loglik = T.transpose(0, 2, 1), np.zeros(B)
    for t in range(n):
        whole = seen[:, t].all()
        Zt = Z if whole else Z * seen[:, t, :, None]
        F = Zt @ P @ Zt.transpose(0, 2, 1) + (HH if whole else np.where(seen[:, t, :, None] & seen[:, t, None, :], HH, eye))
        fine = (np.diagonal(F, axis1=1, axis2=2) > TOLERANCE).all(1) & seen[:, t].any(1)
        F = np.where(fine[:, None, None], F, eye)
        v = np.where(fine[:, None], resid[:, t] - (Zt @ a[:, :, None])[:, :, 0], 0.0)
        Fi = np.linalg.inv(F)
        w = (Fi @ v[:, :, None])[:, :, 0]
        loglik -= 0.5 * np.where(fine, seen[:, t].sum(1) * LOG_2PI + np.log(np.linalg.det(F)) + (v * w).sum(1), 0.0)
        ZP = np.where(fine[:, None, None], Zt @ P, 0.0)
        a = a + (ZP.transpose(0, 2, 1) @ w[:, :, None])[:, :, 0]
        P = P - ZP.transpose(0, 2, 1) @ Fi @ ZP
        a, P = C + (T @ a[:, :, None])[:, :, 0], T @ P @ Tt + RR
        P = (P + P.transpose(0, 2, 1)) / 2
    return loglik


def offsets(built: list[Matrices], n: int) -> np.ndarray:
    """D of many models at n times; past the end of a shorter series it is 0."""
    out = np.zeros((len(built), n))
    for k, x in enumerate(built):
        if x.D.ndim == 2:
            out[k, : min(n, len(x.D))] = x.D[:n, 0]
        else:
            out[k] = x.D[0]
    return out


def some(models: dict[str, np.ndarray], rows: np.ndarray) -> dict[str, np.ndarray]:
    shared = {"Z": 1, "T": 2}
    return {k: v if v.ndim == shared.get(k) else v[rows] for k, v in models.items()}


def forward(models: dict[str, np.ndarray], data: np.ndarray, h: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
    """Log-likelihoods of many series (rows of data, NaN if missing or past their end), each under its own model; ``h`` are
    observation variances (rows x times, or x 1). With ``keep``, also (a Z, P Z, P Z / f, v / f) of each time."""
    Z, T, C, RR = models["Z"], models["T"], models["C"], models["RR"]
    B, m = models["a1"].shape
    shared = T.ndim == 2
    a, P, n = models["a1"], models["P1"].reshape(B, m * m), data.shape[1]
    RR = RR.reshape(B, m * m)
    seen = np.isfinite(data)
    weight, y = seen.astype(float), np.where(seen, data, 0.0)
    every = seen.all(0)
    h = np.broadcast_to(h, data.shape)
    if shared:
        both, Tt = np.kron(T, T).T.copy(), T.T.copy()
        pick = np.kron(np.eye(m), Z[:, None])  # vec(P) to P Z
    loglik, steps = np.zeros(B), []
    for t in range(n):
        if shared:
            pz, mean = P @ pick, a @ Z
            f = pz @ Z + h[:, t]
        else:
            pz, mean = (P.reshape(B, m, m) @ Z[:, :, None])[:, :, 0], (a * Z).sum(1)
            f = (pz * Z).sum(1) + h[:, t]
        ok = f > TOLERANCE
        g = (1.0 / f) * weight[:, t] if ok.all() else np.where(ok, weight[:, t] / np.where(ok, f, 1.0), 0.0)
        v = y[:, t] - mean
        w = v * g
        bits = LOG_2PI + np.log(np.where(ok, f, 1.0)) + v * w
        loglik -= 0.5 * (bits if every[t] and ok.all() else np.where(g > 0, bits, 0.0))
        gain = pz * g[:, None]
        if keep:
            steps.append((mean, pz, gain, w, a))
        a = a + pz * w[:, None]
        P = P - (pz[:, :, None] * gain[:, None, :]).reshape(B, m * m)
        if shared:
            a, P = C + a @ Tt, P @ both + RR
        else:
            a, P = C + (T @ a[:, :, None])[:, :, 0], (T @ P.reshape(B, m, m) @ T.transpose(0, 2, 1)).reshape(B, m * m) + RR
    return loglik, steps


def batched_loglik(built: list[Matrices], y: np.ndarray) -> np.ndarray:
    """Log-likelihoods of many Gaussian series (rows of y, NaN if missing or past their end), each under its own model."""
    models = stacked(built)
    return forward(models, y - offsets(built, y.shape[1]), models["h"][:, None])[0]


def signal_means(models: dict[str, np.ndarray], steps: list) -> np.ndarray:
    """Smoothed means of Z alpha (rows x times) from the steps of ``forward``."""
    Z, T = models["Z"], models["T"]
    r = np.zeros(models["a1"].shape)
    out = np.empty((len(r), len(steps)))
    for t in range(len(steps) - 1, -1, -1):
        mean, pz, gain, w, _ = steps[t]
        r = r @ T if T.ndim == 2 else (T.transpose(0, 2, 1) @ r[:, :, None])[:, :, 0]
        r = r + Z * (w - (gain * r).sum(1))[:, None]
        out[:, t] = mean + (pz * r).sum(1)
    return out


def find_modes(models: dict[str, np.ndarray], dist: str, y: np.ndarray, u: np.ndarray, D: np.ndarray, rounds: int = 100, tolerance: float = 1e-8, near: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signals at the posterior modes of many series of one distribution (rows), with the pseudo-observations and variances there.

    Rows of ``near`` that are finite are where the search starts, if it ends there in a finite mode; a near start spares most rounds.
    """
    s, phi = start_signal(dist, y, u), models["phi"][:, None]
    if near is not None and (known := np.isfinite(near).all(1)).any():
        s = np.where(known[:, None], near, s)
        out, going = find_modes_from(models, dist, y, u, D, s, rounds, tolerance)
        lost = np.flatnonzero(known & (going | ~np.isfinite(out[0]).all(1)))
        if len(lost):
            for x, z in zip(out, find_modes(some(models, lost), dist, y[lost], u[lost], D[lost], rounds, tolerance), strict=True):
                x[lost] = z
        return out
    return find_modes_from(models, dist, y, u, D, s, rounds, tolerance)[0]


def find_modes_from(models: dict[str, np.ndarray], dist: str, y: np.ndarray, u: np.ndarray, D: np.ndarray, s: np.ndarray, rounds: int, tolerance: float) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
    """The same from signals ``s``, and which rows hadn't ended after all rounds."""
    phi = models["phi"][:, None]
    todo = np.arange(len(y))
    for _ in range(rounds):
        m = some(models, todo)
        py, h = laplace_step(dist, y[todo], s[todo], u[todo], phi[todo])
        h = np.where(np.isfinite(h), h, 1.0)
        data = np.where(np.isfinite(y[todo]), py, np.nan) - D[todo]
        new = signal_means(m, forward(m, data, h, True)[1]) + D[todo]
        change = np.where(np.isnan(y[todo]).all(1), 0.0, ((new - s[todo]) ** 2).mean(1))
        s[todo] = new
        todo = todo[np.isfinite(change) & (change >= tolerance)]
        if not len(todo):
            break
    going = np.zeros(len(y), bool)
    going[todo] = True
    py, h = laplace_step(dist, y, s, u, phi)
    return (s, np.where(np.isfinite(y), py, np.nan), np.where(np.isfinite(h), h, 1.0)), going


def fixed_modes(dist: str, s: np.ndarray, y: np.ndarray, u: np.ndarray, phi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``find_modes`` for signals that are taken as the modes, without a search."""
    py, h = laplace_step(dist, y, s, u, phi)
    return s, np.where(np.isfinite(y), py, np.nan), np.where(np.isfinite(h), h, 1.0)


#: Mean squared change at which batched searches end: small enough that a mode doesn't depend on where its search began.
MODE_TOLERANCE = 1e-14


def batched_approximate_loglik(models: dict[str, np.ndarray], dist: str, y: np.ndarray, u: np.ndarray, D: np.ndarray, modes: np.ndarray | None = None, near: np.ndarray | None = None) -> tuple[np.ndarray, tuple]:
    """``Approximation(...).loglik`` of many series, at their modes (searched from ``near``) or at given ones; and modes, pseudo-observations, variances and log ratios at the modes."""
    phi, seen = models["phi"][:, None], np.isfinite(y)
    s, py, h = find_modes(models, dist, y, u, D, tolerance=MODE_TOLERANCE, near=near) if modes is None else fixed_modes(dist, modes, y, u, phi)
    g = forward(models, py - D, h)[0]
    full = np.where(seen, y, 1.0)
    const = np.stack([obs_const(dist, row, e, float(p)) for row, e, p in zip(full, u, models["phi"], strict=True)])
    scales = np.where(seen, obs_kernel(dist, full, s, u, phi) + 0.5 * (np.where(seen, py, 0.0) - s) ** 2 / h, 0.0)
    rest = np.where(seen, const + 0.5 * (LOG_2PI + np.log(h)), 0.0)
    return g + (scales + rest).sum(1), (s, py, h, scales)


def batched_smoother(models: dict[str, np.ndarray], data: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Smoothed means (times x rows x m), variances and covariances with the next state of many series at once."""
    B, m = models["a1"].shape
    n = data.shape[1]
    Z, T = np.broadcast_to(models["Z"], (B, m)), np.broadcast_to(models["T"], (B, m, m))
    a, P = np.empty((n + 1, B, m)), np.empty((n + 1, B, m, m))
    a[0], P[0] = models["a1"], models["P1"]
    L, score, info = np.empty((n, B, m, m)), np.empty((n, B, m)), np.empty((n, B))
    seen = np.isfinite(data)
    y = np.where(seen, data, 0.0)
    for t in range(n):
        pz = (P[t] @ Z[:, :, None])[:, :, 0]
        f = (pz * Z).sum(1) + h[:, t]
        info[t] = np.where(seen[:, t] & (f > TOLERANCE), 1 / np.maximum(f, TOLERANCE), 0.0)
        v = (y[:, t] - (a[t] * Z).sum(1)) * info[t]
        K = (T @ pz[:, :, None])[:, :, 0] * info[t][:, None]
        L[t] = T - K[:, :, None] * Z[:, None, :]
        score[t] = Z * v[:, None]
        a[t + 1] = models["C"] + (T @ a[t][:, :, None])[:, :, 0] + (T @ pz[:, :, None])[:, :, 0] * v[:, None]
        P[t + 1] = T @ P[t] @ L[t].transpose(0, 2, 1) + models["RR"]
        P[t + 1] = (P[t + 1] + P[t + 1].transpose(0, 2, 1)) / 2
    means, V, lag = a.copy(), P.copy(), np.empty((n, B, m, m))
    r, N = np.zeros((B, m)), np.zeros((B, m, m))
    for t in range(n - 1, -1, -1):
        Lt = L[t].transpose(0, 2, 1)
        lag[t] = P[t] @ Lt @ (np.eye(m) - N @ P[t + 1])
        r = score[t] + (Lt @ r[:, :, None])[:, :, 0]
        N = Z[:, :, None] * Z[:, None, :] * info[t][:, None, None] + Lt @ N @ L[t]
        means[t] = a[t] + (P[t] @ r[:, :, None])[:, :, 0]
        V[t] = P[t] - P[t] @ N @ P[t]
    return means, V, lag


def batched_roots(V: np.ndarray) -> np.ndarray:
    """Symmetric square roots: unlike factors of eigenvectors they change little if V does, so draws from them do too."""
    vals, vecs = np.linalg.eigh((V + V.swapaxes(-1, -2)) / 2)
    return (vecs * np.sqrt(np.maximum(vals, 0))[..., None, :]) @ vecs.swapaxes(-1, -2)


def batched_guided(models: dict[str, np.ndarray], dist: str, y: np.ndarray, u: np.ndarray, D: np.ndarray, count: int, rngs: list[np.random.Generator], modes: np.ndarray | None = None, paths: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """``guided`` for many parameters (rows) of one series (y and u over time) that step together.

    Log-likelihoods and, if asked, one of the particles' paths of each row ((n + 1) x m; NaN if its weights vanished). Each row
    draws from its own generator, so what else is in the batch doesn't matter.
    """
    B, m = models["a1"].shape
    n = len(y)
    data, e = np.broadcast_to(y, (B, n)), np.broadcast_to(u, (B, n))
    with np.errstate(all="ignore"):
        base, (_, py, h, scales) = batched_approximate_loglik(models, dist, data, e, D, modes)
        fine = np.isfinite(base)
        if not fine.all():  # rows without an approximation stay out
            value, found = np.full(B, -np.inf), np.full((B, n + 1, m), np.nan) if paths else None
            if fine.any():
                rows = np.flatnonzero(fine)
                got = batched_guided(some(models, rows), dist, y, u, D[rows], count, [rngs[k] for k in rows], None if modes is None else modes[rows], paths)
                value[rows] = got[0]
                if paths:
                    found[rows] = got[1]
            return value, found
        means, V, lag = batched_smoother(models, py - D, h)
        gains = lag.swapaxes(-1, -2) @ np.linalg.pinv(V[:-1], hermitian=True)
        roots = np.concatenate([batched_roots(V[:1]), batched_roots(V[1:] - gains @ lag)])
    z = np.stack([r.standard_normal((n + 1, count, m)) for r in rngs], 1)
    points = (np.stack([r.random((n, count)) for r in rngs], 1) + np.arange(count)) / count
    Z, phi = np.broadcast_to(models["Z"], (B, m)), models["phi"][:, None]
    states, ancestors, loglik = np.empty((n + 1, B, count, m)) if paths else None, np.zeros((n, B, count), int), base.copy()
    x = means[0][:, None] + z[0] @ roots[0].swapaxes(-1, -2)
    for t in range(n):
        if paths:
            states[t] = x
        if np.isfinite(y[t]):
            s = D[:, t][:, None] + (x @ Z[:, :, None])[:, :, 0]
            lw = obs_kernel(dist, y[t], s, u[t], phi) + 0.5 * (py[:, t][:, None] - s) ** 2 / h[:, t][:, None] - scales[:, t][:, None]
            top = lw.max(1)
            top = np.where(np.isnan(top), -np.inf, top)
            w = np.exp(lw - np.where(np.isfinite(top), top, 0.0)[:, None])
            total = w.sum(1)
            dead = ~(np.isfinite(top) & (total > 0))
            loglik = np.where(dead, -np.inf, loglik + top + np.log(np.where(dead, 1.0, total) / count))
            w = np.where(dead[:, None], 1.0, w)
        else:
            w = np.ones((B, count))
        upto = np.cumsum(w / w.sum(1, keepdims=True), 1)
        upto[:, -1] = 1.0
        ancestors[t] = np.stack([np.searchsorted(upto[b], points[t, b]) for b in range(B)]) if count > 64 else (upto[:, None, :] < points[t][:, :, None]).sum(2)
        x = np.take_along_axis(x, ancestors[t][:, :, None], 1)
        x = means[t + 1][:, None] + (x - means[t][:, None]) @ gains[t].swapaxes(-1, -2) + z[t + 1] @ roots[t + 1].swapaxes(-1, -2)
    if not paths:
        return loglik, None
    states[n] = x
    at = np.array([r.integers(count) for r in rngs])
    out = np.empty((B, n + 1, m))
    rows = np.arange(B)
    out[:, n] = states[n, rows, at]
    for t in range(n - 1, -1, -1):
        at = ancestors[t, rows, at]
        out[:, t] = states[t, rows, at]
    out[~np.isfinite(loglik)] = np.nan
    return loglik, out


def batched_metropolis(start: np.ndarray, log_target, iterations: int, burnin: int, rngs: list[np.random.Generator], target: float = 0.234, gamma: float = 2 / 3, adapt_after: bool = True, thin: int = 1, S: np.ndarray | None = None) -> list[list[list]]:
    """Jump chains [theta, count, log target, extra] of many chains that step together; each draws from its own generator.

    ``log_target(thetas)`` gives log densities and, for each row, what is kept with its state. A chain whose start isn't
    finite has no states.
    """
    B, d = len(rngs), len(start)
    theta = np.tile(start, (B, 1))
    S = np.tile(np.diag(0.1 * np.maximum(0.1, np.abs(start))) if S is None else S, (B, 1, 1))
    current, extra = log_target(theta)
    alive = np.isfinite(current)
    chains: list[list[list]] = [[] for _ in rngs]
    moved, count = alive.copy(), np.zeros(B, int)
    block = 512
    for i in range(1, iterations + 1 if alive.any() else 1):
        if (i - 1) % block == 0:
            z_all = np.stack([r.standard_normal((block, d)) for r in rngs])
            u_all = np.stack([r.random(block) for r in rngs])
        z, u = z_all[:, (i - 1) % block], u_all[:, (i - 1) % block]
        proposal = theta + (S @ z[:, :, None])[:, :, 0]
        value, info = log_target(proposal)
        accept = np.zeros(B)
        fine = alive & np.isfinite(value)
        accept[fine] = np.exp(np.minimum(0.0, value[fine] - current[fine]))
        yes = u < accept
        theta, current, extra, moved = np.where(yes[:, None], proposal, theta), np.where(yes, value, current), np.where(yes[:, None], info, extra), moved | yes
        if i > burnin and (i - burnin) % thin == 0:
            count += 1
            for b in np.flatnonzero(alive & (moved | (count == 1))):
                if chains[b]:
                    chains[b][-1][1] = int(count[b]) - 1
                chains[b].append([theta[b].copy(), 0, float(current[b]), extra[b].copy()])
                count[b] = 1
            moved[:] = False
        if i <= burnin or adapt_after:
            eta = min(1.0, d * i**-gamma)
            inner = np.eye(d) + (eta * (accept - target) / (z * z).sum(1))[:, None, None] * z[:, :, None] * z[:, None, :]
            S = np.linalg.cholesky(S @ inner @ S.transpose(0, 2, 1))
    for b, chain in enumerate(chains):
        if chain:
            chain[-1][1] = int(count[b])
    return chains


def fault(t: np.ndarray, y: np.ndarray, u: np.ndarray, dist: tuple[str, ...]) -> str:
    """Why a model of these distributions can't take a series (times in order, y and u as times x variables); empty if it can."""
    seen = np.isfinite(y)
    if not np.array_equal(np.asarray(t), np.arange(1, len(y) + 1)):
        return "times"
    if np.isinf(y).any():
        return "infinite"
    if dist and not (np.isfinite(u).all() and (u > 0).all()):
        return "exposure"
    for j, d in enumerate(dist):
        v = y[seen[:, j], j]
        if d not in ("svm", "gaussian") and (v < 0).any():
            return "negative"
        if d == "gamma" and (v == 0).any():
            return "zero"
        if d not in ("svm", "gaussian", "gamma") and (v != np.floor(v)).any():
            return "fractional"
        if d == "binomial" and (v > u[seen[:, j], j]).any():
            return "over trials"
    return ""
