"""Column expressions: observation kernels, constants, Laplace steps, starting modes and prior densities.

A signal ``s`` is the linear predictor; ``u`` is an exposure (Poisson, negative binomial, gamma) or a number of trials
(binomial); ``phi`` is a dispersion, shape or scale. A null observation gives null.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

DISTRIBUTIONS = ("svm", "poisson", "binomial", "negative binomial", "gamma", "gaussian")
HALF_LOG_2PI = 0.5 * math.log(2 * math.pi)


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def lgamma(x: Column) -> Column:
    """log Gamma for x > 0: seven steps of the recurrence, then Stirling's series; 1e-11 or better, inside codegen."""
    z = x + 7.0
    product = x * (x + 1.0) * (x + 2.0) * (x + 3.0) * (x + 4.0) * (x + 5.0) * (x + 6.0)
    series = 1.0 / (12.0 * z) - 1.0 / (360.0 * z * z * z) + 1.0 / (1260.0 * F.pow(z, F.lit(5.0))) - 1.0 / (1680.0 * F.pow(z, F.lit(7.0)))
    return (z - 0.5) * F.log(z) - z + HALF_LOG_2PI + series - F.log(product)


def lchoose(n: Column, k: Column) -> Column:
    return lgamma(n + 1.0) - lgamma(k + 1.0) - lgamma(n - k + 1.0)


def obs_kernel(dist: str, y: Column, s: Column, u=1.0, phi=1.0) -> Column:
    """Log density of y given the signal, without terms that don't hold it."""
    u, phi = _col(u), _col(phi)
    return {
        "svm": lambda: -0.5 * (s + F.pow(y / phi, F.lit(2.0)) * F.exp(-s)),
        "poisson": lambda: y * s - u * F.exp(s),
        "binomial": lambda: y * s - u * F.log1p(F.exp(s)),
        "negative binomial": lambda: y * s - (y + phi) * F.log(phi + u * F.exp(s)),
        "gamma": lambda: -phi * (s + y * F.exp(-s) / u),
        "gaussian": lambda: -0.5 * F.pow((y - s) / phi, F.lit(2.0)),
    }[dist]()


def obs_const(dist: str, y: Column, u=1.0, phi=1.0) -> Column:
    """The terms that ``obs_kernel`` leaves out."""
    u, phi = _col(u), _col(phi)
    return {
        "svm": lambda: -HALF_LOG_2PI - F.log(phi) + 0.0 * y,
        "poisson": lambda: y * F.log(u) - lgamma(y + 1.0),
        "binomial": lambda: lchoose(u, y),
        "negative binomial": lambda: lchoose(y + phi - 1.0, y) + phi * F.log(phi) + y * F.log(u),
        "gamma": lambda: phi * F.log(phi) - lgamma(phi) + (phi - 1.0) * F.log(y) - phi * F.log(u),
        "gaussian": lambda: -HALF_LOG_2PI - F.log(phi) + 0.0 * y,
    }[dist]()


def laplace_step(dist: str, y: Column, s: Column, u=1.0, phi=1.0) -> tuple[Column, Column]:
    """Pseudo-observation and pseudo-variance of the Gaussian that matches the log density's first two derivatives at s."""
    u, phi = _col(u), _col(phi)
    e = F.exp(s)
    if dist == "svm":
        h = 2.0 * e / F.pow(F.greatest(F.abs(y), F.lit(1e-4)) / phi, F.lit(2.0))
        return s + 1.0 - 0.5 * h, h
    if dist == "poisson":
        h = 1.0 / (u * e)
        return y * h + s - 1.0, h
    if dist == "binomial":
        h = F.pow(1.0 + e, F.lit(2.0)) / (u * e)
        return y * h + s - 1.0 - e, h
    if dist == "negative binomial":
        m = u * e
        return s + (phi + m) * (y - m) / ((y + phi) * m), F.pow(phi + m, F.lit(2.0)) / (phi * m * (y + phi))
    if dist == "gamma":
        m = u * e
        return s - m / y + 1.0, m / (y * phi)
    return y, phi * phi + 0.0 * y


def init_mode(dist: str, y: Column, u=1.0) -> Column:
    """Where the search for the signal's mode starts."""
    u = _col(u)
    y0 = F.coalesce(y, F.lit(0.0))
    return {
        "svm": lambda: F.log(F.greatest(F.lit(1e-4), y0 * y0)),
        "poisson": lambda: F.log(F.greatest(y0 / u, F.lit(0.1))),
        "binomial": lambda: (lambda p: F.log(p / (1.0 - p)))(F.coalesce((y + 0.5) / (u + 1.0), F.lit(0.5))),
        "negative binomial": lambda: F.log(F.greatest(y0 / u, F.lit(1.0 / 6.0))),
        "gamma": lambda: F.log(F.greatest(y0 / u, F.lit(1.0))),
        "gaussian": lambda: y0,
    }[dist]()


def log_prior(prior, x: Column) -> Column:
    """Unnormalised log density of a prior (see ``priors``); minus infinity outside its support."""
    kind, a = prior.kind, prior.params
    outside = F.lit(float("-inf"))
    if kind == "uniform":
        return F.when((x < a[0]) | (x > a[1]), outside).otherwise(0.0)
    if kind == "halfnormal":
        return F.when(x < 0, outside).otherwise(-0.5 * F.pow(x / a[0], F.lit(2.0)))
    if kind == "normal":
        return -0.5 * F.pow((x - a[0]) / a[1], F.lit(2.0))
    if kind == "tnormal":
        return F.when((x < a[2]) | (x > a[3]), outside).otherwise(-0.5 * F.pow((x - a[0]) / a[1], F.lit(2.0)))
    return F.when(x <= 0, outside).otherwise((a[0] - 1.0) * F.log(x) - a[1] * x)
