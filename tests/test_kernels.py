"""Kernels against one dense multivariate normal, known limits and each other."""

import math

import numpy as np
import pytest

from stateweave.functions import priors
from stateweave.operators import kernels, models, nonlinear

rng = np.random.default_rng(0)


def dense(model, y):
    """Log-likelihood, means and covariance of all states, from their joint normal distribution."""
    n, m, p = len(y), len(model.a1), model.Z.shape[-2]
    size = (n + 1) * m
    mean, cov = np.zeros(size), np.zeros((size, size))
    mean[:m], cov[:m, :m] = model.a1, model.P1
    for t in range(n):
        T, R, lo, hi = model.at("T", t), model.at("R", t), t * m, (t + 1) * m
        mean[hi : hi + m] = model.at("C", t) + T @ mean[lo:hi]
        cov[hi : hi + m, :hi] = T @ cov[lo:hi, :hi]
        cov[:hi, hi : hi + m] = cov[hi : hi + m, :hi].T
        cov[hi : hi + m, hi : hi + m] = T @ cov[lo:hi, lo:hi] @ T.T + R @ R.T
    Z, HH, D = np.zeros((n * p, size)), np.zeros((n * p, n * p)), np.zeros(n * p)
    for t in range(n):
        rows = slice(t * p, (t + 1) * p)
        Z[rows, t * m : (t + 1) * m], D[rows] = model.at("Z", t), model.at("D", t)
        HH[rows, rows] = model.at("H", t) @ model.at("H", t).T
    seen = np.isfinite(y.ravel())
    Z, HH, e = Z[seen], HH[np.ix_(seen, seen)], y.ravel()[seen] - D[seen] - Z[seen] @ mean
    V = Z @ cov @ Z.T + HH
    K = cov @ Z.T @ np.linalg.inv(V)
    ll = -0.5 * (len(e) * math.log(2 * math.pi) + np.linalg.slogdet(V)[1] + e @ np.linalg.solve(V, e))
    return ll, (mean + K @ e).reshape(n + 1, m), cov - K @ Z @ cov


@pytest.fixture
def bivariate():
    H = np.linalg.cholesky(np.array([[1, 0.3], [0.3, 2.0]]))
    model = models.Matrices(rng.normal(size=(2, 3)), 0.5 * rng.normal(size=(3, 3)), rng.normal(size=(3, 2)), rng.normal(size=3), np.eye(3), H, rng.normal(size=2), rng.normal(size=3))
    y = rng.normal(size=(8, 2))
    y[2], y[4, 1] = np.nan, np.nan
    return model, y


def test_smoother_is_the_dense_posterior(bivariate):
    model, y = bivariate
    ll, mean, cov = dense(model, y)
    s = kernels.smoother(model, y)
    assert abs(ll - s["loglik"]) < 1e-9
    assert np.abs(mean - s["means"]).max() < 1e-9
    for t in range(9):
        assert np.abs(cov[3 * t : 3 * t + 3, 3 * t : 3 * t + 3] - s["variances"][t]).max() < 1e-9
        if t < 8:
            assert np.abs(cov[3 * t : 3 * t + 3, 3 * t + 3 : 3 * t + 6] - s["lag"][t]).max() < 1e-9
    assert np.abs(kernels.fast_means(model, y[None], kernels.kalman(model, y))[0] - s["means"]).max() < 1e-9


def test_antithetic_pairs_average_to_the_smoother(bivariate):
    model, y = bivariate
    draws = kernels.simulation_smoother(model, y, 10, np.random.default_rng(1))
    assert np.abs(draws.mean(0) - kernels.smoother(model, y)["means"]).max() < 1e-9


def test_all_missing_and_no_variance():
    model = models.structural(sd_level=0.0, sd_y=0.0, P1=[[0.0]]).build(np.zeros(0))
    assert kernels.kalman(model, np.full((5, 1), np.nan))["loglik"] == 0
    assert kernels.kalman(model, np.zeros((5, 1)))["loglik"] == 0


@pytest.mark.parametrize("dist", ["poisson", "binomial", "negative binomial", "gamma", "svm"])
def test_unbiased_estimates_agree(dist):
    r = np.random.default_rng(3)
    n = 25
    y = {"poisson": r.poisson(3, n), "binomial": r.binomial(10, 0.4, n), "negative binomial": r.poisson(4, n), "gamma": r.gamma(2, 1, n), "svm": r.normal(size=n)}[dist].astype(float)[:, None]
    y[4] = np.nan
    u = np.full_like(y, 10.0 if dist == "binomial" else 1.0)
    model = models.structural(sd_level=0.2, dist=dist, phi=2.0 if dist != "svm" else 1.0, P1=[[1.0]]).build(np.zeros(0))
    a = kernels.Approximation(model, y, u)
    spdk = a.importance(4000, r)[2]
    assert abs(a.loglik - spdk) < 0.5
    assert abs(kernels.guided(a, 1000, r)["loglik"] - spdk) < 0.1
    assert abs(kernels.bootstrap(model, y, u, 20000, r)["loglik"] - spdk) < 0.2


def test_laplace_finds_the_logistic_regression():
    """A binomial model without state noise and with diffuse coefficients is a logistic regression."""
    dead = np.array([1, 4, 9, 13, 18, 20, 0, 2, 6, 10, 12, 16.0])[:, None]
    dose, sex = np.tile(np.arange(6.0), 2), np.repeat([0.0, 1.0], 6)
    X = np.column_stack([np.ones(12), sex, dose, sex * dose])
    model = models.Matrices(X[:, None, :], np.eye(4), np.zeros((4, 1)), np.zeros(4), 1e5 * np.eye(4), dist=("binomial",))
    a = kernels.Approximation(model, dead, np.full_like(dead, 20.0))
    got = kernels.smoother(a.model, a.y)["means"][0]
    beta = np.zeros(4)
    for _ in range(30):
        p = 1 / (1 + np.exp(-X @ beta))
        beta += np.linalg.solve((X * (20 * p * (1 - p))[:, None]).T @ X, X.T @ (dead[:, 0] - 20 * p))
    assert np.abs(got - beta).max() < 1e-3


def test_metropolis_finds_the_prior_without_data():
    spec = models.ar1(rho=priors.uniform(0.2, 0, 1), sigma=priors.gamma(1, 2, 10), mu=priors.normal(0.1, 0.2, 0.5), sd_y=1.0)
    y = np.full((5, 1), np.nan)
    target = lambda th: ((lp := spec.log_prior(th)), 0.0) if not math.isfinite(spec.log_prior(th)) else (spec.log_prior(th) + kernels.kalman(spec.build(th), y)["loglik"], 0.0)
    chain = kernels.metropolis(spec.start(), target, 12000, 2000, np.random.default_rng(5))
    draws = np.repeat([spec.natural(c[0]) for c in chain], [c[1] for c in chain], axis=0)
    assert np.abs(draws.mean(0) - [0.5, 0.2, 0.2]).max() < 0.08
    assert np.abs(draws.std(0) - [0.289, 0.141, 0.5]).max() < 0.08


def test_batched_likelihood_and_padding():
    spec = models.structural(sd_level=0.3, sd_slope=0.1, sd_y=1.0)
    m = spec.build(np.zeros(0))
    y = rng.normal(size=12)
    both = np.full((2, 15), np.nan)
    both[0, :12], both[1, :10] = y, y[:10]
    got = kernels.batched_loglik([m, m], both)
    assert np.allclose(got, [kernels.kalman(m, y[:, None])["loglik"], kernels.kalman(m, y[:10, None])["loglik"]])


def test_extended_and_unscented_filters_are_kalman_for_a_linear_model():
    model, y = nonlinear.example("nlg_linear_gaussian"), rng.normal(size=(15, 1))
    y[3] = np.nan
    linear = models.structural(sd_level=1.0, sd_y=0.5, P1=[[1.0]]).build(np.zeros(0))
    th, k = np.array([math.log(0.5)]), kernels.kalman(linear, y)
    for f in (nonlinear.extended_filter(model, y, th), nonlinear.extended_filter(model, y, th, 3), nonlinear.unscented_filter(model, y, th)):
        assert abs(f["loglik"] - k["loglik"]) < 1e-5
        assert np.abs(f["att"] - k["att"]).max() < 1e-5
    mean, cov, _ = nonlinear.extended_smoother(model, y, th)
    s = kernels.smoother(linear, y)
    assert np.abs(mean - s["means"]).max() < 1e-9 and np.abs(cov - s["variances"]).max() < 1e-9
    r = np.random.default_rng(2)
    assert abs(nonlinear.bootstrap(model, y, th, 20000, r)["loglik"] - k["loglik"]) < 0.2
    assert abs(nonlinear.extended_particles(model, y, th, 500, r)["loglik"] - k["loglik"]) < 0.3


def test_guided_particles_of_nonlinear_models():
    linear, y, r = nonlinear.example("nlg_linear_gaussian"), rng.normal(size=(10, 1)), np.random.default_rng(7)
    th = np.array([math.log(0.5)])
    want = nonlinear.extended_filter(linear, y, th)["loglik"]
    assert abs(nonlinear.guided(linear, y, th, 20, r)["loglik"] - want) < 1e-6  # the proposal is exact
    model, th = nonlinear.example("nlg_ar_exp"), np.array([0.0, 0.6, -1.5, -1.0])
    y = np.exp(0.2 * rng.normal(size=(15, 1))) + 0.3 * rng.normal(size=(15, 1))
    y[6] = np.nan
    approx, mode = nonlinear.approximation(model, th, y)
    again = kernels.fast_means(approx, y[None], kernels.kalman(approx, y))[0]
    assert np.abs(again - mode).max() < 1e-3
    assert abs(nonlinear.guided(model, y, th, 2000, r)["loglik"] - nonlinear.bootstrap(model, y, th, 20000, r)["loglik"]) < 0.1


def test_gradients_of_the_growth_model():
    model, x, th = nonlinear.example("nlg_growth"), np.array([0.3, 80.0]), np.zeros(3)
    h = 1e-6
    numeric = np.column_stack([(model.T(x[None] + h * e, th)[0] - model.T(x[None] - h * e, th)[0]) / (2 * h) for e in np.eye(2)])
    assert np.abs(numeric - model.T_gradient(x, th)).max() < 1e-5


def test_diffusion_moments():
    """An Ornstein-Uhlenbeck process after one unit of time."""
    model, r = nonlinear.example("sde_poisson_ou"), np.random.default_rng(0)
    x = nonlinear.milstein(model, np.full(40000, 1.0), np.array([math.log(0.5), 2.0, math.log(0.3)]), 6, r)
    assert abs(x.mean() - (2 - math.exp(-0.5))) < 0.02
    assert abs(x.var() - 0.09 * (1 - math.exp(-1.0)) / 1.0) < 0.01


@pytest.mark.parametrize("call", [
    lambda: models.structural(sd_level=-1.0, sd_y=1.0), lambda: models.structural(sd_level=1.0, sd_seasonal=1.0, period=2, sd_y=1.0), lambda: models.ar1(rho=1.0, sigma=1.0, sd_y=1.0),
    lambda: models.volatility(0.5, 1.0), lambda: priors.uniform(2, 0, 1), lambda: priors.normal(0, 0, -1), lambda: priors.gamma(0, 1, 1), lambda: priors.halfnormal(-1, 1), lambda: nonlinear.example("none"),
    lambda: models.Matrices(np.ones((1, 2)), np.eye(3), np.eye(3), np.zeros(3), np.eye(3)),
])
def test_wrong_arguments(call):
    with pytest.raises(ValueError):
        call()


def test_stratified_counts():
    w = np.array([0.1, 0.2, 0.3, 0.4])
    picks = kernels.resample(np.repeat(w, 25) / 25, np.random.default_rng(0))
    assert len(picks) == 100 and (np.diff(picks) >= 0).all()
    assert np.abs(np.bincount(picks // 25, minlength=4) - 100 * w).max() <= 1


def test_from_covariances():
    m = models.from_covariances([[1.0, 0.0]], np.eye(2), [[1.0, 0.5], [0.5, 2.0]], [[4.0]], [0.0, 0.0], np.zeros((2, 2)), P1inf=np.eye(2), kappa=10.0)
    assert np.allclose(m.R @ m.R.T, [[1.0, 0.5], [0.5, 2.0]]) and m.H[0, 0] == 2 and np.allclose(m.P1, 10 * np.eye(2))
    counts = models.from_covariances([[1.0]], np.eye(1), [[0.09]], None, [0.5], [[2.0]], dist=("poisson",))
    want = models.structural(sd_level=0.3, dist="poisson", a1=[0.5], P1=[[2.0]]).build(np.zeros(0))
    y = np.array([[3.0], [np.nan], [1.0], [4.0]])
    u = np.ones((4, 1))
    got, other = (kernels.Approximation(x, y, u) for x in (counts, want))
    assert np.allclose(got.mode, other.mode)
    with pytest.raises(ValueError):
        models.from_covariances([[1.0]], np.eye(1), [[1.0]], [[1.0]], [0.0], [[1.0]], dist=("poisson",))


def test_batched_modes_equal_single_ones():
    """Laplace approximations of many series at once, also with offsets and missing values, against the step-by-step ones."""
    r = np.random.default_rng(8)
    for dist in ("poisson", "binomial", "negative binomial", "gamma", "svm"):
        built, ys, us = [], [], []
        for k in range(4):
            spec = models.structural(sd_level=0.1 + 0.1 * k, sd_slope=0.05 if k < 4 else None, dist=dist, phi=2.0, P1=np.diag([1.0, 0.1]))
            d = 0.1 * r.normal(size=(14, 1))
            built.append(models.with_constants(spec.build(np.zeros(0)), D=d))
            us.append(np.full(14, 9.0)), ys.append(r.integers(1, 8, 14).astype(float))
            ys[-1][[2, 9]] = np.nan
        y, u = np.array(ys), np.array(us)
        m = kernels.stacked(built)
        got, _ = kernels.batched_approximate_loglik(m, dist, y, u, kernels.offsets(built, 14))
        s = kernels.find_modes(m, dist, y, u, kernels.offsets(built, 14))[0]
        for k, b in enumerate(built):
            slow = kernels.Approximation(b, y[k][:, None], u[k][:, None], mode=kernels.start_signal(dist, y[k], u[k])[:, None])
            assert np.allclose(slow.mode[:, 0], s[k], atol=1e-4) and abs(slow.loglik - got[k]) < 1e-3, dist
            fast = kernels.Approximation(b, y[k][:, None], u[k][:, None])
            assert np.allclose(fast.mode[:, 0], s[k]) and abs(fast.loglik - got[k]) < 1e-8


def test_stacks_equal_single_models():
    spec = models.structural(sd_level=priors.halfnormal(1, 1), sd_slope=priors.halfnormal(1, 1), sd_seasonal=priors.gamma(1, 2, 2), period=4, sd_y=priors.halfnormal(1, 1), sd_noise=priors.uniform(0.5, 0, 2))
    thetas = np.random.default_rng(1).normal(size=(6, 5)) - 0.5
    a, b = spec.stack(thetas), kernels.stacked([spec.build(t) for t in thetas])
    assert all(np.allclose(a[k], b[k]) for k in b)
    want = np.array([spec.log_prior(t) for t in thetas])
    assert np.allclose(spec.log_priors(thetas), want)


def test_covariates_are_read_by_time():
    x = np.random.default_rng(3).normal(size=(25, 1))
    y = np.random.default_rng(4).poisson(3, (20, 1)).astype(float)
    spec = models.structural(sd_level=0.3, dist="poisson", beta=(0.5,), P1=[[1.0]])
    long, short = (spec.bind(v).build(np.zeros(0)) for v in (x, x[:20]))
    u = np.ones((20, 1))
    assert abs(kernels.Approximation(long, y, u).loglik - kernels.Approximation(short, y, u).loglik) < 1e-10
    for bad in (x[:19], None):
        with pytest.raises(ValueError):
            kernels.kalman(models.structural(sd_level=0.3, sd_y=1.0, beta=(0.5,), P1=[[1.0]]).bind(bad).build(np.zeros(0)), y)
