"""Filters, smoothers, approximations, particle filters, MCMC and prediction over many series, chains and draws.

``series`` has series_id, t (from 1), y (double, or array of doubles for several variables; null if missing) and, if
needed, u (exposure or trials, default 1) and x (array of the model's covariates). A recursion over time needs its series in one task: series are grouped by id,
work spreads over series x chains, and what follows a chain (importance corrections, states, predictions) spreads over slices
of its blocks: each slice meets its series once, and its blocks step together where the model allows. Random numbers depend
on (seed, series, chain, block) alone, not on the partitioning.

A series that the model can't take (``kernels.fault``: values out of range, times that aren't 1 to n, unusable covariates), or
whose posterior isn't finite at the start, gives no rows and doesn't disturb the others; ``left_out`` names it with the reason.
A block whose correction fails has weight 0, and no path, forecast or fitted values.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.random import generator
from . import kernels
from .models import Matrices, Spec
from .posterior import matrix_moments
from .scan import written

#: Chains that step together in one task.
BATCH = 256
FULL = 32
#: Blocks of one series that a task takes at a time, and numbers (times, particles and states) of those that step together.
SLICE = 256
STEP_NUMBERS = 4_000_000
CHAIN = "series_id string, chain_id int, block int, count int, weight double, log_posterior double, approx double, theta array<double>, names array<string>"
#: What a block may fail of: it then has weight 0.
FAILURES = (np.linalg.LinAlgError, OverflowError, FloatingPointError, ZeroDivisionError)


def _matrix(values) -> np.ndarray:
    rows = [v if isinstance(v, (list, np.ndarray)) else [v] for v in values]
    return np.array([[np.nan if x is None else x for x in r] for r in rows], float)


def _arrays(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """y, u and covariates (None without), in the order of t."""
    frame = frame.sort_values("t")
    y = _matrix(frame["y"].tolist())
    u = _matrix(frame["u"].tolist()) if "u" in frame else np.ones((len(y), 1))
    return y, np.broadcast_to(u, y.shape), _matrix(frame["x"].tolist()) if "x" in frame else None


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` over all tasks by ``keys``: the work on a row is long and its bytes few, so partitions mustn't be merged by size."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *keys)


def _no_rows(names) -> pd.DataFrame:
    return pd.DataFrame({c: [] for c in names}, dtype=object)


def _fault(frame: pd.DataFrame, spec: Spec | None) -> str:
    """Why the model can't take the series; empty if it can."""
    frame = frame.sort_values("t")
    try:
        y, u, x = _arrays(frame)
    except (TypeError, ValueError):
        return "shape"
    found = kernels.fault(frame["t"].to_numpy(), y, u, spec.dist if spec is not None else ())
    if not found and spec is not None and spec.betas is not None and spec.xreg is None:
        try:
            if len(spec.bind(x).xreg) < len(y):
                found = "covariates"
        except (TypeError, ValueError):
            found = "covariates"
    return found


def _needs_covariates(series: DataFrame, spec: Spec | None) -> None:
    if spec is not None and spec.betas is not None and spec.xreg is None and "x" not in series.columns:
        raise ValueError("the model has covariates: the series needs a column x, or the model xreg")


def per_series(series: DataFrame, work: Callable[..., pd.DataFrame], schema: str, spec: Spec | None = None) -> DataFrame:
    """``work(series_id, y, u, x)`` gives rows without series_id; series that ``spec`` can't take give none."""
    names = [x.strip().split(" ")[0] for x in schema.split(", ")]
    _needs_covariates(series, spec)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        sid = frame["series_id"].iloc[0]
        if _fault(frame, spec):
            return _no_rows(("series_id", *names))
        out = work(sid, *_arrays(frame))
        out.insert(0, "series_id", sid)
        return out[["series_id", *names]]

    return dealt(series, "series_id").groupBy("series_id").applyInPandas(run, f"series_id string, {schema}")


def left_out(series: DataFrame, spec: Spec, theta=None) -> DataFrame:
    """series_id and problem of the series that give no rows: what ``kernels.fault`` finds, ``covariates``, or ``start``: no finite posterior at theta."""
    th = spec.start() if theta is None else np.asarray(theta)
    _needs_covariates(series, spec)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        found = _fault(frame, spec)
        if not found:
            y, u, x = _arrays(frame)
            try:
                found = "" if math.isfinite(spec.log_prior(th) + _estimate(spec.bind(x), th, y, u, "psi", 0, None)) else "start"
            except FAILURES:
                found = "start"
        return pd.DataFrame({"series_id": [frame["series_id"].iloc[0]], "problem": [found]}) if found else _no_rows(("series_id", "problem"))

    return dealt(series, "series_id").groupBy("series_id").applyInPandas(run, "series_id string, problem string")


def _gaussian(spec: Spec, theta: np.ndarray, y: np.ndarray, u: np.ndarray) -> tuple[Matrices, np.ndarray]:
    """The model and data at theta, or their Gaussian approximation."""
    model = spec.build(theta)
    if model.dist:
        a = kernels.Approximation(model, y, u)
        return a.model, a.y
    return model, y


def kalman_filter(series: DataFrame, spec: Spec, theta=None) -> DataFrame:
    """t, a, p (flattened), att, ptt, loglik; row n + 1 has only predictions. Other distributions: of the approximation."""

    def work(sid, y, u, x, spec=spec):
        spec = spec.bind(x)
        f = kernels.kalman(*_gaussian(spec, spec.start() if theta is None else np.asarray(theta), y, u))
        n = len(y)
        flat = lambda x, k: [x[t].ravel().tolist() if t < k else None for t in range(n + 1)]
        return pd.DataFrame({"t": range(1, n + 2), "a": flat(f["a"], n + 1), "p": flat(f["P"], n + 1), "att": flat(f["att"], n), "ptt": flat(f["Ptt"], n), "loglik": f["loglik"]})

    return per_series(series, work, "t int, a array<double>, p array<double>, att array<double>, ptt array<double>, loglik double", spec)


def smooth(series: DataFrame, spec: Spec, theta=None) -> DataFrame:
    """t, alphahat and vt (flattened) of the n observed times."""

    def work(sid, y, u, x, spec=spec):
        spec = spec.bind(x)
        s = kernels.smoother(*_gaussian(spec, spec.start() if theta is None else np.asarray(theta), y, u))
        n = len(y)
        return pd.DataFrame({"t": range(1, n + 1), "alphahat": [x.tolist() for x in s["means"][:n]], "vt": [x.ravel().tolist() for x in s["variances"][:n]]})

    return per_series(series, work, "t int, alphahat array<double>, vt array<double>", spec)


def fast_smooth(series: DataFrame, spec: Spec, theta=None) -> DataFrame:
    """Smoothed means only."""

    def work(sid, y, u, x, spec=spec):
        spec = spec.bind(x)
        model, data = _gaussian(spec, spec.start() if theta is None else np.asarray(theta), y, u)
        means = kernels.fast_means(model, data[None], kernels.kalman(model, data))[0][: len(y)]
        return pd.DataFrame({"t": range(1, len(y) + 1), "alphahat": [x.tolist() for x in means]})

    return per_series(series, work, "t int, alphahat array<double>", spec)


def approximate(series: DataFrame, spec: Spec, theta=None, rounds: int = 100, tolerance: float = 1e-8) -> DataFrame:
    """Pseudo-observations, pseudo-variances and signal modes of the approximating Gaussian model."""

    def work(sid, y, u, x, spec=spec):
        spec = spec.bind(x)
        a = kernels.Approximation(spec.build(spec.start() if theta is None else np.asarray(theta)), y, u, rounds, tolerance)
        h = [(np.diag(x) ** 2).tolist() for x in a.model.H]
        return pd.DataFrame({"t": range(1, len(y) + 1), "pseudo_y": a.y.tolist(), "pseudo_h": h, "mode": a.mode.tolist(), "loglik": a.loglik})

    return per_series(series, work, "t int, pseudo_y array<double>, pseudo_h array<double>, mode array<double>, loglik double", spec)


def _estimate(spec: Spec, theta, y, u, method: str, count: int, rng) -> float:
    model = spec.build(theta)
    if not model.dist:
        return kernels.bootstrap(model, y, u, count, rng)["loglik"] if method == "bsf" else kernels.kalman(model, y)["loglik"]
    if method == "bsf":
        return kernels.bootstrap(model, y, u, count, rng)["loglik"]
    a = kernels.Approximation(model, y, u)
    return a.loglik if count == 0 else a.importance(count, rng)[2] if method == "spdk" else kernels.guided(a, count, rng)["loglik"]


def loglik(series: DataFrame, spec: Spec, theta=None, method: str = "psi", count: int = 0, seed: int = 1) -> DataFrame:
    """Exact (Gaussian), approximate (count 0) or unbiased (psi, spdk, bsf) log-likelihood of each series."""

    def work(sid, y, u, x, spec=spec):
        spec = spec.bind(x)
        th = spec.start() if theta is None else np.asarray(theta)
        return pd.DataFrame({"loglik": [_estimate(spec, th, y, u, method, count, generator(seed, sid))]})

    return per_series(series, work, "loglik double", spec)


def simulate_states(series: DataFrame, spec: Spec, draws: int, theta=None, seed: int = 1, antithetic: bool = True) -> DataFrame:
    """draw, t, state: paths given the data (of the approximation for other distributions)."""

    def work(sid, y, u, x, spec=spec):
        spec = spec.bind(x)
        model, data = _gaussian(spec, spec.start() if theta is None else np.asarray(theta), y, u)
        x = kernels.simulation_smoother(model, data, draws, generator(seed, sid), antithetic)[:, : len(y)]
        return pd.DataFrame({"draw": np.repeat(np.arange(1, draws + 1), len(y)), "t": np.tile(np.arange(1, len(y) + 1), draws), "state": x.reshape(-1, x.shape[2]).tolist()})

    return per_series(series, work, "draw int, t int, state array<double>", spec)


def importance_sample(series: DataFrame, spec: Spec, draws: int, theta=None, seed: int = 1, antithetic: bool = True) -> DataFrame:
    """draw, weight (over the largest) and signal path of draws from the approximation."""

    def work(sid, y, u, x, spec=spec):
        spec = spec.bind(x)
        a = kernels.Approximation(spec.build(spec.start() if theta is None else np.asarray(theta)), y, u)
        x, w, _ = a.importance(draws, generator(seed, sid), antithetic)
        return pd.DataFrame({"draw": range(1, draws + 1), "weight": np.exp(w - w.max()), "states": x.reshape(draws, -1).tolist()})

    return per_series(series, work, "draw int, weight double, states array<double>", spec)


def particle_filter(series: DataFrame, spec: Spec, count: int, theta=None, method: str = "bsf", seed: int = 1, smoothed: bool = False) -> DataFrame:
    """Means and variances (flattened) of filtered particles, or of their ancestral paths if ``smoothed``; with the log-likelihood."""

    def work(sid, y, u, x, spec=spec):
        spec = spec.bind(x)
        model, rng = spec.build(spec.start() if theta is None else np.asarray(theta)), generator(seed, sid)
        if method == "bsf" or not model.dist:
            pf = kernels.bootstrap(model, y, u, count, rng)
        else:
            pf = kernels.guided(kernels.Approximation(model, y, u), count, rng)
        return summarised(pf, len(y), smoothed)

    return per_series(series, work, "t int, mean array<double>, cov array<double>, loglik double", spec)


def summarised(pf: dict, n: int, smoothed: bool) -> pd.DataFrame:
    if smoothed:
        x, w = kernels.trace(pf).transpose(1, 0, 2), np.full(pf["states"].shape[:2], 1 / pf["states"].shape[1])
    else:
        x, w = pf["states"], pf["weights"]
    mean = np.einsum("tk,tkm->tm", w, x)
    d = x - mean[:, None]
    cov = np.einsum("tk,tki,tkj->tij", w, d, d)
    return pd.DataFrame({"t": range(1, n + 1), "mean": mean[:n].tolist(), "cov": [c.ravel().tolist() for c in cov[:n]], "loglik": pf["loglik"]})


def run_mcmc(series: DataFrame, spec: Spec, iterations: int, burnin: int | None = None, chains: int = 1, method: str = "is2", sampling: str = "psi", count: int = 10, seed: int = 1, target: float = 0.234, gamma: float = 2 / 3, adapt_after: bool = True, thin: int = 1, S: np.ndarray | None = None, local_approx: bool = True) -> DataFrame:
    """Jump chains (see ``posterior``) of adaptive Metropolis; every ``thin``-th iteration counts, ``S`` is the first proposal's factor.

    Chains of one variable, or of several Gaussian ones, step together, ``BATCH`` chains to a task, unless each step needs particles;
    others have a task per series and chain. Gaussian models use their likelihood. Others: ``approx`` (the approximation's), ``pm`` (pseudo-marginal),
    ``da`` (delayed acceptance), or ``is1``/``is2``/``is3`` (approximate chains whose blocks ``correct`` then weights in parallel).
    Blocks of the latter keep the signals' ``mode``, which everything after reads in place of a new search. Without ``local_approx``
    a series has one mode, that of the starting values. The chain is written to the shared folder once.
    """
    _needs_covariates(series, spec)
    burn = iterations // 2 if burnin is None else burnin
    corrected = method in ("is1", "is2", "is3")
    first = spec.build(spec.start())
    single = kernels.batchable(first) and dict(series.dtypes)["y"] == "double"
    if single and (not first.dist or corrected or method == "approx") or not single and spec.betas is None and kernels.batchable_many(first):
        chain = written(_together(series, spec, iterations, burn, chains, seed, target, gamma, adapt_after, thin, S, local_approx, bool(first.dist) and corrected), "chain")
        return correct(chain, series, spec, count, sampling, method, seed) if first.dist and corrected else chain

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        sid, chain = frame["series_id"].iloc[0], int(frame["chain_id"].iloc[0])
        if _fault(frame, spec):
            return _no_rows(c.split()[0] for c in CHAIN.split(", "))
        y, u, x = _arrays(frame)
        bound = spec.bind(x)
        rng = generator(seed, sid, chain)
        fixed: list[np.ndarray] = []

        def approximation(model):
            if local_approx:
                return kernels.Approximation(model, y, u)
            if not fixed:
                fixed.append(kernels.Approximation(bound.build(bound.start()), y, u).mode)
            return kernels.Approximation(model, y, u, 0, mode=fixed[0])

        def target_density(theta):
            prior = bound.log_prior(theta)
            if not math.isfinite(prior):
                return -math.inf, 0.0
            try:
                model = bound.build(theta)
                if not model.dist:
                    value = kernels.kalman(model, y)["loglik"]
                elif method == "pm":
                    value = _estimate(bound, theta, y, u, sampling, count, rng)
                else:
                    value = approximation(model).loglik
            except FAILURES:
                return -math.inf, 0.0
            return (prior + value, value) if not math.isnan(value) else (-math.inf, 0.0)

        def second(theta, approx):
            try:
                return _estimate(bound, theta, y, u, sampling, count, rng) - approx
            except FAILURES:
                return -math.inf

        try:
            blocks = kernels.metropolis(bound.start(), target_density, iterations, burn, rng, S, target, gamma, adapt_after, second if method == "da" else None, thin)
        except kernels.NotFinite:
            blocks = []
        return _no_rows(c.split()[0] for c in CHAIN.split(", ")) if not blocks else pd.DataFrame({
            "series_id": sid, "chain_id": chain, "block": range(1, len(blocks) + 1), "count": [b[1] for b in blocks], "weight": 1.0, "log_posterior": [b[2] for b in blocks],
            "approx": [b[3] for b in blocks], "theta": [b[0].tolist() for b in blocks], "names": [list(spec.names)] * len(blocks),
        })

    keyed = series.withColumn("chain_id", F.explode(F.array(*(F.lit(k) for k in range(1, chains + 1)))))
    chain = written(dealt(keyed, "series_id", "chain_id").groupBy("series_id", "chain_id").applyInPandas(run, CHAIN), "chain")
    return correct(chain, series, spec, count, sampling, method, seed) if corrected else chain


def _together(series: DataFrame, spec: Spec, iterations: int, burn: int, chains: int, seed: int, target: float, gamma: float, adapt_after: bool, thin: int, S: np.ndarray | None, local_approx: bool = True, modes: bool = False) -> DataFrame:
    """Chains that step together: priors, models and filters (and approximations) of a batch are array work."""
    dist = (spec.build(spec.start()).dist or ("",))[0]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        groups = [(sid, *_arrays(g)) for sid, g in frame.groupby("series_id", sort=True) if not _fault(g, spec)]
        if not groups:
            return _no_rows(c.split()[0] for c in schema.split(", "))
        keys = [(sid, c, k) for k, (sid, *_) in enumerate(groups) for c in range(1, chains + 1)]
        length = max(len(g[1]) for g in groups)
        several = groups[0][1].shape[1] > 1
        cut = (slice(None),) if several else (slice(None), 0)
        padded = lambda column, fill: np.stack([np.concatenate([v := g[column][cut], np.full((length - len(v), *v.shape[1:]), fill)]) for g in groups])
        of = np.array([k for _, _, k in keys])
        data, u = padded(1, np.nan)[of], padded(2, 1.0)[of]
        bound = [spec.bind(g[3]) for g in groups]
        x = None
        if spec.betas is not None:
            x = np.zeros((len(groups), length, bound[0].xreg.shape[1]))
            for k, (g, b) in enumerate(zip(groups, bound, strict=True)):
                if len(b.xreg) < len(g[1]):
                    raise ValueError(f"covariates of {g[0]} end before the series")
                x[k, : len(g[1])] = b.xreg[: len(g[1])]
            x = x[of]

        fixed: list[np.ndarray] = []
        near = np.full(data.shape, np.nan) if dist else None  # each chain's last mode, where its next search starts

        def log_target(theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            out = spec.log_priors(theta)
            kept = np.full((len(theta), length if modes else 0), np.nan)
            ok = np.flatnonzero(np.isfinite(out))
            if len(ok):
                with np.errstate(all="ignore"):
                    if several:
                        built = [bound[of[k]].build(theta[k]) for k in ok]
                        try:
                            out[ok] += kernels.forward_many(built, data[ok])
                        except np.linalg.LinAlgError:  # of one model of the batch
                            for k, b in zip(ok, built, strict=True):
                                out[k] += kernels.kalman(b, data[k])["loglik"]
                        return np.where(np.isnan(out), -np.inf, out), kept
                    if spec.stack is not None:
                        models = spec.stack(theta[ok])
                        D = np.zeros((len(ok), 1)) if x is None else (x[ok] @ np.array([spec.betas(theta[k]) for k in ok])[:, :, None])[:, :, 0]
                    else:
                        built = [bound[of[k]].build(theta[k]) for k in ok]
                        models, D = kernels.stacked(built), kernels.offsets(built, length)
                    if dist:
                        value, (mode, *_) = kernels.batched_approximate_loglik(models, dist, data[ok], u[ok], np.broadcast_to(D, data[ok].shape), None if local_approx or not fixed else fixed[0][ok], near[ok])
                        if not fixed and len(ok) == len(theta):
                            fixed.append(mode)
                        out[ok] += value
                        near[ok] = mode
                        if modes:
                            kept[ok] = mode
                    else:
                        out[ok] += kernels.forward(models, data[ok] - D, models["h"][:, None])[0]
            return np.where(np.isnan(out), -np.inf, out), kept

        found = kernels.batched_metropolis(spec.start(), log_target, iterations, burn, [generator(seed, sid, c) for sid, c, _ in keys], target, gamma, adapt_after, thin, S)
        flat = [(sid, c, k, n, lp, th, mode[: len(groups[g][1])].tolist()) for (sid, c, g), blocks in zip(keys, found, strict=True) for k, (th, n, lp, mode) in enumerate(blocks, 1)]
        if not flat:
            return _no_rows(c.split()[0] for c in schema.split(", "))
        sid, c, k, n, lp, th, mode = zip(*flat, strict=True)
        prior = spec.log_priors(np.array(th).reshape(len(flat), -1))
        return pd.DataFrame({"series_id": sid, "chain_id": c, "block": k, "count": n, "weight": 1.0, "log_posterior": lp, "approx": np.array(lp) - prior, "theta": [t.tolist() for t in th], "names": [list(spec.names)] * len(flat)} | ({"mode": list(mode)} if modes else {}))

    schema = CHAIN + (", mode array<double>" if modes else "")
    number = series.select("series_id").distinct().count()
    cores = series.sparkSession.sparkContext.defaultParallelism
    # a step costs about the same for up to FULL chains, so tasks fill up before all cores have one
    buckets = max(1, min(number, max(min(cores, -(-number * chains // FULL)), -(-number * chains // BATCH))))
    bucketed = series.withColumn("bucket", F.pmod(F.xxhash64("series_id"), F.lit(buckets)))
    return bucketed.repartitionByRange(buckets, "bucket").groupBy("bucket").applyInPandas(run, schema)


def _per_slice(chain: DataFrame, series: DataFrame, work: Callable[..., list[dict | None]], columns: str, keep: list[str]) -> DataFrame:
    """``work(blocks, y, u, x)`` of slices of each series' blocks: a value for each block, whose items follow the columns ``keep``; None gives no row.

    The chain is written, as it is read twice; a series is copied once for each slice of its blocks, so a series with most
    blocks is dealt over many tasks and bytes are series x slices.
    """
    chain = written(chain, "blocks")
    spark = chain.sparkSession
    counts = written(chain.groupBy("series_id").agg(F.count("*").alias("n")), "block-counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    slices = F.ceil(F.col("n") / max(1, min(SLICE, -(-total // (2 * tasks))))).cast("int").alias("slices")
    slices = counts.select("series_id", slices)
    blocks = chain.join(slices, "series_id").withColumn("slice", F.pmod(F.xxhash64("chain_id", "block"), "slices").cast("int")).drop("slices")
    fields = ["t", "y", *(c for c in ("u", "x") if c in series.columns)]
    copies = series.select("series_id", *fields).join(slices, "series_id").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).drop("slices")
    names = [c.strip().split(" ")[0] for c in columns.split(", ")]
    types = dict(chain.dtypes)

    def run(rows: pd.DataFrame, steps: pd.DataFrame) -> pd.DataFrame:
        out = {k: [] for k in (*keep, *names)}
        if len(rows) and len(steps):
            todo = list(rows.itertuples(index=False))
            for row, got in zip(todo, work(todo, *_arrays(steps)), strict=True):
                if got is not None:
                    for k in keep:
                        out[k].append(got[k] if k in got else getattr(row, k))
                    for k in names:
                        out[k].append(got[k])
        return pd.DataFrame(out, dtype=None if out[keep[0]] else object)

    schema = ", ".join([f"{k} {types[k]}" for k in keep] + [columns])
    left, right = (dealt(df, "series_id", "slice").groupBy("series_id", "slice") for df in (blocks, copies))
    return left.cogroup(right).applyInPandas(run, schema)


def _per_block(chain: DataFrame, series: DataFrame, work: Callable[..., dict | None], columns: str, keep: list[str]) -> DataFrame:
    """``work(block, y, u, x)`` for every block of a chain; a block that fails, or gives None, has no row."""

    def each(block, *data):
        try:
            return work(block, *data)
        except FAILURES:
            return None

    return _per_slice(chain, series, lambda blocks, *data: [each(b, *data) for b in blocks], columns, keep)


def _runs(spec: Spec, blocks: list, y: np.ndarray, u: np.ndarray, count: int, method: str, seed: int, paths: bool) -> list[tuple[float, np.ndarray | None]]:
    """Unbiased log-likelihoods by the guided filter, and one path each if asked, of a series' blocks that step together.

    A block with a ``mode`` is approximated there; others have theirs searched, all at once.
    """
    out: list[tuple[float, np.ndarray | None]] = [(-math.inf, None)] * len(blocks)
    every = [_built(spec, b) for b in blocks]
    sizes = np.array([count * b.count if method == "is1" else count for b in blocks])
    states = len(spec.build(spec.start()).a1)
    for size in np.unique(sizes).tolist():
        at = np.array([k for k in np.flatnonzero(sizes == size) if every[k] is not None], int)
        if not len(at):
            continue
        step = max(1, STEP_NUMBERS // ((len(y) + 1) * size * states))
        for some in np.split(at, range(step, len(at), step)):
            built = [every[k] for k in some]
            modes = [getattr(blocks[k], "mode", None) for k in some]
            known = all(m is not None and len(m) == len(y) for m in modes)
            rngs = [generator(seed, b.series_id, b.chain_id, b.block, "is") for b in (blocks[k] for k in some)]
            value, path = kernels.batched_guided(
                kernels.stacked(built), built[0].dist[0], y[:, 0], u[:, 0], kernels.offsets(built, len(y)), size, rngs, np.array(modes, float) if known else None, paths
            )
            for k, j in enumerate(some):
                out[j] = (float(value[k]), path[k] if paths else None)
    return out


def _built(spec: Spec, block) -> Matrices | None:
    try:
        return spec.build(np.array(block.theta))
    except FAILURES:
        return None


def _steps_together(spec: Spec, sampling: str) -> bool:
    first = spec.build(spec.start())
    return sampling == "psi" and bool(first.dist) and kernels.batchable(first)


def correct(chain: DataFrame, series: DataFrame, spec: Spec, count: int = 10, sampling: str = "psi", method: str = "is2", seed: int = 1) -> DataFrame:
    """Importance weights exp(unbiased - approximate log-likelihood) for each block of an approximate chain; 0 for blocks that fail.

    ``is1`` uses count x block count particles, ``is3`` first repeats blocks so that each has count 1. A chain's ``mode`` is read and kept.
    """
    if method == "is3":
        order = Window.partitionBy("series_id", "chain_id").orderBy("block", "k")
        again = chain.withColumn("k", F.explode(F.sequence(F.lit(1), "count"))).withColumn("count", F.lit(1)).withColumn("block", F.row_number().over(order))
        chain = again.drop("k").select(*chain.columns)
    together = _steps_together(spec, sampling)

    def work(blocks, y, u, x, spec=spec):
        spec = spec.bind(x)
        if together:
            values = [v for v, _ in _runs(spec, blocks, y, u, count, method, seed, False)]
        else:
            values = [_unbiased(spec, b, y, u, count * b.count if method == "is1" else count, sampling, seed) for b in blocks]
        gaps = [v - b.approx if math.isfinite(v) else -math.inf for v, b in zip(values, blocks, strict=True)]
        return [{"log_weight": g, "log_posterior": b.log_posterior + g} for g, b in zip(gaps, blocks, strict=True)]

    kept = ["approx", "theta", "names", *(["mode"] if "mode" in chain.columns else [])]
    rows = _per_slice(chain, series, work, "log_weight double", ["series_id", "chain_id", "block", "count", "log_posterior", *kept])
    return rows.select("series_id", "chain_id", "block", "count", F.exp("log_weight").alias("weight"), "log_posterior", *kept)


def _unbiased(spec: Spec, block, y: np.ndarray, u: np.ndarray, count: int, sampling: str, seed: int) -> float:
    try:
        return _estimate(spec, np.array(block.theta), y, u, sampling, count, generator(seed, block.series_id, block.chain_id, block.block, "is"))
    except FAILURES:
        return -math.inf


def suggest_count(series: DataFrame, spec: Spec, theta=None, candidates: tuple[int, ...] = tuple(range(10, 101, 10)), replications: int = 100, seed: int = 1) -> DataFrame:
    """Standard deviation of the psi estimate by number of particles, for the candidates a series has tried; ``suggested`` is its first under 1 (null: none)."""
    th = spec.start() if theta is None else np.asarray(theta)

    def work(block, y, u, x, spec=spec):
        return {"loglik": _estimate(spec.bind(x), th, y, u, "psi", int(block.chain_id), generator(seed, block.series_id, block.chain_id, block.block))}

    return in_rounds(series, work, candidates, replications)


def in_rounds(series: DataFrame, work: Callable[..., dict], candidates: tuple[int, ...], replications: int) -> DataFrame:
    """A round for each candidate, in which only series that no earlier candidate satisfied are evaluated."""
    left, rounds = series.select("series_id").distinct(), []
    for n in candidates:
        trials = left.join(F.broadcast(series.sparkSession.range(replications).select(F.col("id").cast("int").alias("block"))))  # few numbers
        trials = trials.select("series_id", F.lit(n).alias("chain_id"), "block", F.lit(0.0).alias("x0"))
        rows = _per_block(trials, series, work, "loglik double", ["series_id", "chain_id", "block"])
        rounds.append(written(rows.groupBy("series_id", F.col("chain_id").alias("particles")).agg(F.stddev_samp("loglik").alias("sd")), "round"))
        left = written(left.join(rounds[-1].where("sd < 1").select("series_id"), "series_id", "left_anti"), "left")
        if left.isEmpty():
            break
    sds = rounds[0]
    for r in rounds[1:]:
        sds = sds.unionByName(r)
    return _suggested(sds)


def _suggested(sds: DataFrame) -> DataFrame:
    first = sds.groupBy("series_id").agg(F.min(F.when(F.col("sd") < 1, F.col("particles"))).alias("suggested"))
    return sds.join(first, "series_id")


def _paths(spec: Spec, blocks: list, y, u, count: int, sampling: str, method: str, seed: int) -> list[np.ndarray | None]:
    """``_path`` of each block; None where its run fails or its weight is 0."""
    if _steps_together(spec, sampling):
        found = [p for _, p in _runs(spec, blocks, y, u, count, method, seed, True)]
    else:
        found = []
        for b in blocks:
            try:
                found.append(_path(spec, b, y, u, count, sampling, method, seed))
            except FAILURES:
                found.append(None)
    return [p if p is not None and b.weight > 0 and np.isfinite(p).all() else None for p, b in zip(found, blocks, strict=True)]


def _path(spec: Spec, block, y, u, count: int, sampling: str, method: str, seed: int) -> np.ndarray:
    """A posterior path of n + 1 states at a block's parameters.

    Gaussian models: by the simulation smoother. Others: one of the particles' paths of the run that ``correct`` (with the same
    arguments) weighted the block by, so path and weight belong together; ``approx`` takes the approximation's instead.
    """
    theta = np.array(block.theta)
    model = spec.build(theta)
    if not model.dist:
        return kernels.simulation_smoother(model, y, 1, generator(seed, block.series_id, block.chain_id, block.block, "state"))[0]
    rng = generator(seed, block.series_id, block.chain_id, block.block, "is")
    n = count * block.count if method == "is1" else count
    if sampling == "bsf":
        paths = kernels.trace(kernels.bootstrap(model, y, u, n, rng))
    else:
        approx = kernels.Approximation(model, y, u)
        if sampling == "approx":
            return kernels.simulation_smoother(approx.model, approx.y, 1, rng)[0]
        if sampling == "spdk":
            states, w, _ = approx.importance(n, rng)
            w = np.exp(w - w.max())
            return states[rng.choice(n, p=w / w.sum())]
        paths = kernels.trace(kernels.guided(approx, n, rng))
    return paths[rng.integers(len(paths))]


def state_paths(chain: DataFrame, series: DataFrame, spec: Spec, seed: int = 1, count: int = 10, sampling: str = "psi", method: str = "is2") -> DataFrame:
    """The chain with ``alpha``, a posterior path (n + 1 times of arrays of states) of each block; see ``state_draws`` and ``posterior.wide_states``."""

    def work(blocks, y, u, x, spec=spec):
        return [p if p is None else {"alpha": p.tolist()} for p in _paths(spec.bind(x), blocks, y, u, count, sampling, method, seed)]

    return _per_slice(chain, series, work, "alpha array<array<double>>", ["series_id", "chain_id", "block", "count", "weight", "theta", "names"])


def state_draws(chain: DataFrame, series: DataFrame, spec: Spec, seed: int = 1, count: int = 10, sampling: str = "psi", method: str = "is2") -> DataFrame:
    """A posterior state path per block (t, state k, value, weight = count x weight), as long rows; t runs to n + 1.

    ``count``, ``sampling``, ``method`` and ``seed`` are those of ``run_mcmc`` or ``correct``; see ``_path``.
    """

    def work(blocks, y, u, x, spec=spec):
        return [p if p is None else {"path": p.tolist()} for p in _paths(spec.bind(x), blocks, y, u, count, sampling, method, seed)]

    rows = _per_slice(chain, series, work, "path array<array<double>>", ["series_id", "chain_id", "block", "count", "weight"])
    times = rows.select("series_id", "chain_id", F.col("block").alias("iter"), (F.col("count") * F.col("weight")).alias("weight"), F.posexplode("path").alias("t", "x"))
    return times.select("series_id", "chain_id", "iter", "weight", (F.col("t") + 1).alias("t"), F.posexplode("x").alias("state", "value"))


def _state_blocks(chain: DataFrame, series: DataFrame, spec: Spec) -> DataFrame:
    """Smoothed means and covariance matrices (n + 1 times) of each block."""

    def work(block, y, u, x, spec=spec):
        s = kernels.smoother(*_gaussian(spec.bind(x), np.array(block.theta), y, u))
        return {"mean": s["means"].tolist(), "cov": s["variances"].tolist()}

    return _per_block(chain, series, work, STATE_BLOCK, ["series_id", "chain_id", "block", "count", "weight"])


STATE_BLOCK = "mean array<array<double>>, cov array<array<array<double>>>"


def state_summary(chain: DataFrame, series: DataFrame, spec: Spec) -> DataFrame:
    """Posterior mean and variance of each state: mean of variances plus variance of means over blocks."""
    return _variances(state_covariances(chain, series, spec))


def state_covariances(chain: DataFrame, series: DataFrame, spec: Spec) -> DataFrame:
    """Posterior means and covariances of all pairs of states at each time (see ``posterior.matrix_moments``): the mean of the
    blocks' covariances plus the covariance of their means."""
    return _mixed_moments(_state_blocks(chain, series, spec))


def _mixed_moments(rows: DataFrame) -> DataFrame:
    times = rows.select("series_id", (F.col("count") * F.col("weight")).alias("weight"), F.posexplode(F.arrays_zip("mean", "cov")).alias("t", "x"))
    times = times.select("series_id", "weight", (F.col("t") + 1).alias("t"), F.col("x.mean").alias("values"), F.col("x.cov").alias("within"))
    return matrix_moments(times, ["series_id", "t"], "within")


def _variances(moments: DataFrame) -> DataFrame:
    return moments.where("i = j").select("series_id", "t", F.col("i").alias("state"), F.col("mean_i").alias("mean"), F.col("covariance").alias("variance"))


def _respond(model: Matrices, s: np.ndarray, kind: str, u: float, t: int, rng: np.random.Generator) -> np.ndarray:
    """Means (inverse links, without exposure) or responses for signals of one time (draws x p)."""
    if not model.dist:
        return s if kind == "mean" else s + rng.standard_normal(s.shape) @ model.at("H", t).T
    out = np.empty_like(s)
    for j, (d, phi) in enumerate(zip(model.dist, model.phi, strict=True)):
        e = np.exp(np.clip(s[:, j], -700, 700))
        mean = {"svm": 0 * e, "binomial": e / (1 + e), "gaussian": s[:, j]}.get(d, e)
        if kind == "mean":
            out[:, j] = mean
        elif d == "svm":
            out[:, j] = phi * np.sqrt(e) * rng.standard_normal(len(s))
        elif d == "poisson":
            out[:, j] = rng.poisson(np.minimum(u * e, 1e15))
        elif d == "binomial":
            out[:, j] = rng.binomial(int(u), mean)
        elif d == "negative binomial":
            out[:, j] = rng.poisson(np.minimum(rng.gamma(phi, u * e / phi), 1e15))
        elif d == "gamma":
            out[:, j] = rng.gamma(phi, u * e / phi)
        else:
            out[:, j] = s[:, j] + phi * rng.standard_normal(len(s))
    return out


def subsample(chain: DataFrame, draws: int, seed: int = 1) -> DataFrame:
    """``draws`` iterations of each series without replacement (all, if fewer): the chain with smaller counts."""
    each = chain.withColumn("k", F.explode(F.sequence(F.lit(1), "count")))
    order = Window.partitionBy("series_id").orderBy(F.xxhash64(F.lit(seed), "chain_id", "block", "k"), "chain_id", "block", "k")
    left = each.withColumn("r", F.row_number().over(order)).where(F.col("r") <= draws).groupBy("series_id", "chain_id", "block").agg(F.count("*").cast("int").alias("count"))
    return chain.drop("count").join(left, ["series_id", "chain_id", "block"]).select(*chain.columns)


def predict(chain: DataFrame, series: DataFrame, spec: Spec, horizon: int, kind: str = "response", seed: int = 1, exposure: float = 1.0, future: DataFrame | None = None, draws: int | None = None, count: int = 10, sampling: str = "psi", method: str = "is2") -> DataFrame:
    """t (n + 1 to n + horizon), variable, value and weight from each block: ``response``, ``mean`` or ``state``.

    ``future`` (series_id, t, x, and u if not ``exposure``) has the covariates of the times ahead; ``draws`` takes so many
    iterations of each series. Count, sampling and method as in ``state_draws``.
    """
    chain = chain if draws is None else subsample(chain, draws, seed)
    if future is not None:
        fields = [c for c in ("t", "x", "u") if c in future.columns]
        chain = chain.join(future.groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("ahead")), "series_id")

    known = future is not None

    def work(blocks, y, u, x, spec=spec):
        n, ahead = len(y), []
        if known:
            ahead = sorted((_plain(r) for r in blocks[0].ahead), key=lambda r: r["t"])
            if len(ahead) < horizon:
                raise ValueError(f"series {blocks[0].series_id} has {len(ahead)} of {horizon} future rows")
            if x is not None:
                x = np.vstack([x, _matrix([r["x"] for r in ahead])])
        e = [r["u"] if r.get("u") is not None else exposure for r in ahead] or [exposure] * horizon
        spec = spec.bind(x)

        def forecast(block, path):
            rng = generator(seed, block.series_id, block.chain_id, block.block, "predict")
            source, state, out = spec.build(np.array(block.theta)), path[n][None], []
            for h in range(horizon):
                s = source.at("D", n + h) + state @ source.at("Z", n + h).T
                out.append((state if kind == "state" else _respond(source, s, kind, e[h], n + h, rng))[0].tolist())
                R = source.at("R", n + h)
                state = source.at("C", n + h) + state @ source.at("T", n + h).T + rng.standard_normal((1, R.shape[1])) @ R.T
            return {"first": n + 1, "path": out}

        return [p if p is None else forecast(b, p) for b, p in zip(blocks, _paths(spec, blocks, y, u, count, sampling, method, seed), strict=True)]

    return _long_path(_per_slice(chain, series, work, "first int, path array<array<double>>", ["series_id", "chain_id", "block", "count", "weight"]))


def _plain(row) -> dict:
    return row if isinstance(row, dict) else row.asDict()


def fitted(chain: DataFrame, series: DataFrame, spec: Spec, seed: int = 1, kind: str = "mean", count: int = 10, sampling: str = "psi", method: str = "is2") -> DataFrame:
    """t (1 to n), variable, value and weight from each block: the mean (or a response) at the observed times."""

    def work(blocks, y, u, x, spec=spec):
        spec = spec.bind(x)

        def means(block, path):
            rng = generator(seed, block.series_id, block.chain_id, block.block, "fitted")
            source = spec.build(np.array(block.theta))
            s = kernels.signals(source, path[None])[0]
            return {"first": 1, "path": [_respond(source, s[t : t + 1], kind, float(u[t, 0]), t, rng)[0].tolist() for t in range(len(y))]}

        return [p if p is None else means(b, p) for b, p in zip(blocks, _paths(spec, blocks, y, u, count, sampling, method, seed), strict=True)]

    return _long_path(_per_slice(chain, series, work, "first int, path array<array<double>>", ["series_id", "chain_id", "block", "count", "weight"]))


def _long_path(rows: DataFrame) -> DataFrame:
    times = rows.select("series_id", "chain_id", F.col("block").alias("iter"), (F.col("count") * F.col("weight")).alias("weight"), "first", F.posexplode("path").alias("h", "x"))
    return times.select("series_id", "chain_id", "iter", "weight", (F.col("first") + F.col("h")).alias("t"), F.posexplode("x").alias("variable", "value"))
