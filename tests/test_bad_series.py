"""Bad series and bad blocks give defined rows and don't disturb the others; forecasts start from the runs that weighted their blocks."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stateweave.functions import priors as pr
from stateweave.functions.random import generator
from stateweave.operators import inference, kernels, models, nonlinear

GOOD = {"poisson": [3, 4, None, 6, 5, 7], "binomial": [1, 2, 2, None, 3, 1], "negative binomial": [0, 4, 2, 6, None, 7], "gamma": [0.5, 1.2, None, 0.7, 2.0, 1.1], "svm": [0.1, -0.4, 0.3, None, 0.2, -0.1]}
BAD = {
    "poisson": {"negative": [1, -1, 2, 3], "fractional": [1, 1.5, 2], "infinite": [1, math.inf, 2]}, "binomial": {"over trials": [1, 9, 2], "negative": [1, -2]},
    "negative binomial": {"negative": [-1, 2], "fractional": [0.5, 2]}, "gamma": {"zero": [1.0, 0.0], "negative": [1.0, -2.0]}, "svm": {"infinite": [0.1, -math.inf]},
}


def spec_of(dist):
    if dist == "svm":
        return models.volatility(pr.uniform(0.5, -0.99, 0.99), pr.halfnormal(0.5, 1), sigma=pr.halfnormal(1, 2))
    return models.structural(sd_level=pr.halfnormal(0.3, 1), dist=dist, phi=2.0 if dist in ("negative binomial", "gamma") else 1.0, P1=[[1.0]])


def table_of(spark, dist, bad=True):
    rows = [(f"good{k}", t + 1, None if v is None else float(v), 5.0) for k in range(4) for t, v in enumerate(GOOD[dist])]
    for name, values in BAD[dist].items() if bad else ():
        rows += [(name, t + 1, float(v), 5.0) for t, v in enumerate(values)]
    if bad:
        rows += [("times", t, 1.0, 5.0) for t in (1, 3, 4)] + [("exposure", t, 1.0, 0.0) for t in (1, 2, 3)]
    return spark.createDataFrame(rows, "series_id string, t int, y double, u double")


@pytest.mark.parametrize("dist", sorted(GOOD))
def test_four_good_and_some_bad_series(spark, dist):
    spec, both, good = spec_of(dist), table_of(spark, dist), table_of(spark, dist, False)
    found = {r.series_id: r.problem for r in inference.left_out(both, spec).collect()}
    assert found == {k: k for k in (*BAD[dist], "times", "exposure")}
    rows = lambda f, s: sorted(map(tuple, f(s).select("series_id", "chain_id", "block", "count", F.round("weight", 9)).collect()))
    for method in ("is2", "pm"):
        run = lambda s, method=method: inference.run_mcmc(s, spec, 30, 10, method=method, count=5)
        assert rows(run, both) == rows(run, good) and len({r[0] for r in rows(run, both)}) == 4
    assert {r.series_id for r in inference.approximate(both, spec).select("series_id").distinct().collect()} == {f"good{k}" for k in range(4)}


def test_a_start_without_posterior(spark):
    """A series whose likelihood is no finite number, beside two good ones in the same batch."""
    spec = models.structural(sd_level=pr.halfnormal(0.3, 1), sd_y=1.0)
    s = table_of(spark, "svm", False).drop("u").where("series_id < 'good3'").withColumn("y", F.when(F.col("series_id") == "good1", 1e200).otherwise(F.col("y")))
    chain = inference.run_mcmc(s, spec, 30, 10)
    assert {r.series_id for r in chain.select("series_id").distinct().collect()} == {"good0", "good2"}
    assert [tuple(r) for r in inference.left_out(s, spec).collect()] == [("good1", "start")]
    alone = inference.run_mcmc(s.where("series_id <> 'good1'"), spec, 30, 10)
    rows = lambda f: sorted(map(tuple, f.select("series_id", "block", "count", F.round("log_posterior", 9)).collect()))
    assert rows(chain) == rows(alone)


def test_covariates_of_one_series_end_early(spark):
    spec = models.structural(sd_level=0.1, sd_y=pr.halfnormal(1, 1), beta=(pr.normal(0, 0, 1),))
    rows = [(i, t, float(t), [None if i == "bad" and t == 3 else 0.5 * t]) for i in ("a", "bad") for t in range(1, 6)]
    s = spark.createDataFrame(rows, "series_id string, t int, y double, x array<double>")
    assert {r.series_id for r in inference.run_mcmc(s, spec, 20).select("series_id").distinct().collect()} == {"a"}
    assert [tuple(r) for r in inference.left_out(s, spec).collect()] == [("bad", "covariates")]


def test_blocks_that_fail_weigh_nothing(spark):
    """A block whose model can't be built into an approximation has weight 0 and no path, and the others keep theirs."""
    spec, s = spec_of("poisson"), table_of(spark, "poisson", False).where("series_id = 'good0'")
    chain = inference.run_mcmc(s, spec, 40, 10, count=5)
    broken = chain.withColumn("theta", F.when(F.col("block") == 1, F.array(F.lit(800.0))).otherwise(F.col("theta")))
    got = {r.block: r.weight for r in inference.correct(broken, s, spec, 5).collect()}
    want = {r.block: r.weight for r in chain.collect()}
    assert got[1] == 0.0 and all(abs(got[b] - w) < 1e-9 for b, w in want.items() if b != 1)
    paths = inference.state_draws(inference.correct(broken, s, spec, 5), s, spec, count=5)
    assert {r.iter for r in paths.select("iter").distinct().collect()} == set(want) - {1}


def test_dead_clouds_are_not_numbers():
    pf = kernels.particles(4, 3, lambda: np.zeros((3, 1)), lambda t, x: x, lambda t, x, _: np.full(3, -np.inf if t == 2 else 0.0), np.random.default_rng(1))
    assert pf["loglik"] == -math.inf and np.isnan(pf["states"][2:]).sum() >= 6 and np.isfinite(pf["states"][:2]).all()


@pytest.fixture(scope="module")
def growth(spark):
    model = nonlinear.example("nlg_ar_exp")
    rng, x, rows = np.random.default_rng(3), 0.0, []
    for t in range(1, 18):
        x = 0.6 * x + 0.2 * rng.normal()
        rows.append(("a", t, None if t == 5 else math.exp(x) + 0.3 * rng.normal()))
    return model, spark.createDataFrame(rows, "series_id string, t int, y double"), [0.0, 0.6, -1.5, -1.0]


@pytest.mark.parametrize("sampling", ["bsf", "psi"])
def test_nonlinear_forecasts_start_from_the_weighted_run(growth, sampling):
    model, s, start = growth
    chain = nonlinear.correct(nonlinear.run_mcmc(s, model, start, 60), s, model, 20, sampling)
    paths = nonlinear.state_draws(chain, s, model, 20, sampling)
    last = {r.iter: r.value for r in paths.where("t = 18").collect()}
    ahead = {r.iter: r.value for r in nonlinear.predict(chain, s, model, 3, 20, kind="state", sampling=sampling).where("t = 18").collect()}
    assert last == ahead and len(last) > 3
    y = np.array([[np.nan if r.y is None else r.y] for r in s.orderBy("t").collect()])
    for r in chain.limit(3).collect():
        pf = nonlinear.PARTICLES[sampling](model, y, np.array(r.theta), 20, generator(1, "a", r.chain_id, r.block, "is"))
        assert abs(pf["loglik"] - r.approx - math.log(r.weight)) < 1e-9 and last[r.block] in pf["states"][-1]


def test_nonlinear_chain_options(growth):
    model, s, start = growth
    plain, thin = (nonlinear.run_mcmc(s, model, start, 90, 30, thin=k) for k in (1, 3))
    assert plain.agg(F.sum("count")).first()[0] == 60 and thin.agg(F.sum("count")).first()[0] == 20
    tight = nonlinear.run_mcmc(s, model, start, 90, 30, S=1e-9 * np.eye(4), adapt_after=False, target=0.9)
    assert max(abs(a - b) for a, b in zip(tight.orderBy("block").first().theta, start, strict=True)) < 1e-3
    for sampling in ("ekpf", "psi"):
        assert nonlinear.run_mcmc(s, model, start, 12, 2, method="pm", count=5, sampling=sampling).agg(F.sum("count")).first()[0] == 10
    assert nonlinear.run_mcmc(s, model, start, 12, 2, method="da", count=5, sampling="psi", extended=1).agg(F.sum("count")).first()[0] == 10


def test_diffusions_have_states_only(spark):
    model = nonlinear.example("sde_gbm")
    s = spark.createDataFrame([("a", t, 0.05 * t) for t in range(1, 8)], "series_id string, t int, y double")
    chain = nonlinear.run_mcmc(s, model, [0.0, 0.2, 0.6], 12, 2, count=20)
    chain = nonlinear.correct(chain, s, model, 20)
    assert nonlinear.predict(chain, s, model, 2, 20, kind="state").where("value > 0 and t in (8, 9)").count() == 2 * chain.where("weight > 0").count()
    for f in (lambda: nonlinear.fitted(chain, s, model), lambda: nonlinear.predict(chain, s, model, 2)):
        with pytest.raises(TypeError, match="diffusion"):
            f()
