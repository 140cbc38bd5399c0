"""Spark operators: the same result for any partitioning, corrections and predictions that agree with theory, streaming."""

from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stateweave.functions import priors
from stateweave.operators import folds, inference, kernels, models, posterior
from stateweave.streaming.online import online_filter

SPEC = models.structural(sd_level=priors.halfnormal(0.5, 2.0), sd_y=priors.halfnormal(1.0, 2.0), P1=[[10.0]])
COUNTS = models.structural(sd_level=priors.halfnormal(0.2, 1.0), dist="poisson", P1=[[2.0]])


@pytest.fixture(scope="module")
def series(spark):
    r = np.random.default_rng(4)
    rows = [(f"s{k}", t + 1, None if (t + k) % 6 == 5 else float(x)) for k in range(3) for t, x in enumerate(np.cumsum(r.normal(size=20)) + r.normal(size=20))]
    return spark.createDataFrame(rows, "series_id string, t int, y double").cache()


@pytest.fixture(scope="module")
def counts(spark):
    r = np.random.default_rng(6)
    return spark.createDataFrame([(f"c{k}", t + 1, float(r.poisson(4))) for k in range(2) for t in range(10)], "series_id string, t int, y double").cache()


def frame(df, *by):
    return df.toPandas().sort_values(list(by)).reset_index(drop=True)


def test_fold_equals_kernel(series):
    a = frame(folds.scalar_filter(series, p1=10.0, sd_state=0.5, sd_y=1.0).where("att is not null"), "series_id", "t")
    b = frame(inference.kalman_filter(series, models.structural(sd_level=0.5, sd_y=1.0, P1=[[10.0]])).where("att is not null"), "series_id", "t")
    assert np.allclose(a["att"], b["att"].str[0]) and np.allclose(a["p"], b["p"].str[0])
    s = frame(folds.scalar_smoother(series, p1=10.0, sd_state=0.5, sd_y=1.0), "series_id", "t")
    k = frame(inference.smooth(series, models.structural(sd_level=0.5, sd_y=1.0, P1=[[10.0]])), "series_id", "t")
    assert np.allclose(s["alphahat"], k["alphahat"].str[0]) and np.allclose(s["vt"], k["vt"].str[0])


def test_chains_do_not_depend_on_partitions(series):
    a = frame(inference.run_mcmc(series, SPEC, 200, chains=2), "series_id", "chain_id", "block")
    b = frame(inference.run_mcmc(series.repartition(7), SPEC, 200, chains=2), "series_id", "chain_id", "block")
    pd.testing.assert_frame_equal(a, b)
    assert (a.groupby(["series_id", "chain_id"])["count"].sum() == 100).all()


def test_importance_weights_and_methods_agree(counts):
    means = {}
    for method in ("is2", "da", "pm"):
        chain = inference.run_mcmc(counts, COUNTS, 400, 100, method=method, count=10)
        s = posterior.weighted_summary(posterior.long_draws(chain, expand=False), ["series_id", "variable"])
        means[method] = frame(s, "series_id")["mean"].to_numpy()
    assert np.abs(means["is2"] - means["da"]).max() < 1.2 and np.abs(means["pm"] - means["da"]).max() < 1.2


def test_is3_repeats_blocks(counts):
    chain = inference.run_mcmc(counts, COUNTS, 60, 20, method="approx").cache()
    a = inference.correct(chain, counts, COUNTS, 5, method="is3")
    assert a.agg(F.sum("count")).first()[0] == chain.agg(F.sum("count")).first()[0] and a.agg(F.max("count")).first()[0] == 1


def test_states_and_predictions(series):
    chain = inference.run_mcmc(series, SPEC, 1200, 200).cache()
    draws = inference.state_draws(chain, series, SPEC)
    by_draws = frame(posterior.weighted_summary(draws, ["series_id", "t"]), "series_id", "t")
    exact = frame(inference.state_summary(chain, series, SPEC), "series_id", "t")
    assert np.abs(by_draws["mean"] - exact["mean"]).max() < 0.5
    future = inference.predict(chain, series, SPEC, 3)
    assert future.select("t").distinct().count() == 3
    means = frame(posterior.weighted_summary(inference.predict(chain, series, SPEC, 1, "state"), ["series_id"]), "series_id")["mean"]
    assert np.abs(means - exact[exact["t"] == 21]["mean"].to_numpy()).max() < 0.6
    assert inference.fitted(chain, series, SPEC).select("t").distinct().count() == 20


def test_expanded_and_weighted_frames_agree(series):
    chain = inference.run_mcmc(series, SPEC, 300)
    a = frame(posterior.summary(posterior.long_draws(chain), ["series_id", "variable"]), "series_id", "variable")
    b = frame(posterior.weighted_summary(posterior.long_draws(chain, expand=False), ["series_id", "variable"]), "series_id", "variable")
    assert np.allclose(a["mean"], b["mean"])


def test_multivariate_is_two_univariate(spark, series):
    one = models.structural(sd_level=0.5, sd_y=1.0, P1=[[10.0]]).build(np.zeros(0))
    two = models.Matrices(np.eye(2), np.eye(2), 0.5 * np.eye(2), np.zeros(2), 10 * np.eye(2), np.eye(2))
    wide = series.where("series_id in ('s0', 's1')").groupBy("t").agg(F.array(F.max(F.when(F.col("series_id") == "s0", F.col("y"))), F.max(F.when(F.col("series_id") == "s1", F.col("y")))).alias("y"))
    got = inference.loglik(wide.withColumn("series_id", F.lit("pair")), models.general(lambda th: two)).first().loglik
    want = inference.loglik(series.where("series_id in ('s0', 's1')"), models.general(lambda th: one)).agg(F.sum("loglik")).first()[0]
    assert abs(got - want) < 1e-9


def test_online_filter_equals_batch(spark, tmp_path):
    """Rows out of order by less than the delay are placed rightly; those behind the watermark and without ts are left out."""
    r = np.random.default_rng(9)
    rows = [("a", datetime(2024, 1, 1, t), None if t == 5 else float(x)) for t, x in enumerate(np.cumsum(r.normal(size=12)))]
    rows += [("b", datetime(2024, 1, 1, 6), 1.0), ("b", datetime(2024, 1, 1, 6), 4.0)]
    parts = [[rows[k] for k in (1, 0, 3, 2)], [rows[k] for k in (6, 4, 8, 12, 13)] + [("a", None, 7.0)], [rows[k] for k in (5, 7, 10)], [rows[k] for k in (9, 11)] + [("a", datetime(2024, 1, 1, 2, 30), 50.0)]]
    for part in parts:
        spark.createDataFrame(part, "series_id string, ts timestamp, y double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("series_id string, ts timestamp, y double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = online_filter(stream, 1.0, 2.0, 10.0, "4 hours").writeStream.format("memory").queryName("online").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("online").where("series_id = 'a'").orderBy("ts").toPandas()
    y = np.array([[np.nan if x[2] is None else x[2]] for x in rows[:12]])
    batch = kernels.kalman(models.structural(sd_level=1.0, sd_y=2.0, P1=[[10.0]]).build(np.zeros(0)), y[:8])
    assert list(got["ts"].dt.hour) == list(range(8)) and np.allclose(got["att"], batch["att"][:, 0]) and abs(got["loglik"].iloc[-1] - batch["loglik"]) < 1e-9
    assert np.allclose([x.att for x in spark.table("online").where("series_id = 'b'").collect()], [10 / 14])


def test_slow_chains_need_all_lags(spark):
    """Autocorrelation times up to the stopping rule, and Geyer's, of chains up to AR(1) of 0.99 (time 199)."""
    rng, n = np.random.default_rng(5), 20_000
    rows, want = [], {}
    for chain, phi in enumerate((0.0, 0.9, 0.99)):
        x = [0.0]
        for e in rng.normal(size=n - 1):
            x.append(phi * x[-1] + e)
        d = np.array(x) - np.mean(x)
        tau = 1.0
        for lag in range(1, n):
            tau += 2 * (d[lag:] @ d[:-lag]) / (n - lag) / (d @ d / (n - 1))
            if lag > max(5, np.log10(n)) * tau:
                break
        want[chain] = tau
        rows += [("a", chain, k + 1, float(v), 1.0) for k, v in enumerate(x)]
    draws = spark.createDataFrame(pd.DataFrame(rows, columns=["series_id", "chain_id", "iter", "value", "weight"]))
    by = ["series_id", "chain_id"]
    got = {r.chain_id: r.iact for r in posterior.iact(draws, by).collect()}
    assert want[2] > 120 and all(abs(got[k] - want[k]) < 1e-6 * want[k] for k in want)
    geyer = {r.chain_id: r.iact for r in posterior.iact(draws, by, "geyer").collect()}
    assert all(abs(geyer[k] / t - 1) < 0.35 for k, t in enumerate((1, 19, 199)))
    full = {r.chain_id: r for r in posterior.full_summary(draws, by).collect()}
    assert abs(full[1].ess - n / want[1]) < 1 and abs(full[1].ess_is - n) < 1e-6 and abs(full[0].se - full[0].sd / np.sqrt(full[0].ess)) < 1e-4
    broken = spark.createDataFrame([("a", 1, k, v, 1.0) for k, v in enumerate([1.0, 1.0, float("nan"), 1.0])], draws.schema)
    assert [r.iact for r in posterior.iact(broken, by).collect()] == [None]


def test_normal_scores(spark):
    from statistics import NormalDist

    p = [1e-9, 0.001, 0.02424, 0.02426, 0.3, 0.5, 0.9, 0.99999]
    got = spark.createDataFrame([(x,) for x in p], "p double").select(posterior.normal_quantile(F.col("p")).alias("z")).collect()
    assert all(abs(g.z - NormalDist().inv_cdf(x)) < 1e-7 for g, x in zip(got, p, strict=True))


def test_folds_of_any_length(spark):
    """Series around the length of a chunk, and an empty fold, as the kernels have them."""
    r = np.random.default_rng(2)
    rows = [(f"n{n}", t + 1, None if t % 9 == 4 else float(v)) for n in (1, 63, 64, 65, 200) for t, v in enumerate(np.cumsum(r.normal(size=n)))]
    s = spark.createDataFrame(rows, "series_id string, t int, y double").cache()
    spec = models.structural(sd_level=0.5, sd_y=1.0, P1=[[10.0]])
    a = frame(folds.scalar_filter(s, p1=10.0, sd_state=0.5, sd_y=1.0), "series_id", "t")
    b = frame(inference.kalman_filter(s, spec), "series_id", "t")
    assert a["t"].tolist() == b["t"].tolist() and np.allclose(a["a"], b["a"].str[0]) and np.allclose(a["loglik"][a["t"] == 201], b["loglik"][b["t"] == 201])
    ll = {x.series_id: x.loglik for x in folds.scalar_loglik(s, p1=10.0, sd_state=0.5, sd_y=1.0).collect()}
    assert all(abs(ll[x.series_id] - x.loglik) < 1e-8 for x in inference.loglik(s, spec).collect())
    assert np.allclose(frame(folds.scalar_smoother(s, p1=10.0, sd_state=0.5, sd_y=1.0), "series_id", "t")["vt"], frame(inference.smooth(s, spec), "series_id", "t")["vt"].str[0])
    assert spark.range(1).select(folds.walk(F.lit(1.0), F.array().cast("array<int>"), lambda x, k: x + 1).alias("w")).first().w == [1.0]


def test_stratified_resampling_joins_by_stratum(spark):
    """One cloud of 30,000 particles: as numpy, without all pairs of a cloud."""
    from pyspark.sql import functions as F
    from stateweave.operators import posterior

    n = 30_000
    p = spark.range(1, n + 1).select(F.lit(1).alias("cloud"), F.col("id").alias("particle"), (1.0 + F.col("id") % 7).alias("weight"))
    out = posterior.stratified(p, ["cloud"], F.lit(0.37))
    joins = [x for x in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in x]
    assert joins and all("stratum" in x for x in joins)
    share = np.cumsum(1.0 + np.arange(1, n + 1) % 7)
    want = np.searchsorted(share / share[-1], (np.arange(n) + 0.37) / n) + 1
    got = out.toPandas().sort_values("stratum")
    assert got.stratum.tolist() == list(range(1, n + 1)) and (got.ancestor.to_numpy() == want).all()


def test_states_are_those_of_the_posterior(spark):
    """12 low Poisson counts at a wide level: paths of the weighted particles against a long bootstrap smoother, where the
    approximation's paths are too high."""
    y = [0, 0, 1, 0, 0, 2, 0, 0, 0, 1, 0, 0]
    s = spark.createDataFrame([("a", t + 1, float(v)) for t, v in enumerate(y)], "series_id string, t int, y double")
    spec = models.structural(sd_level=0.7, dist="poisson", P1=[[1.0]])
    chain = spark.range(1, 801).selectExpr("'a' as series_id", "1 as chain_id", "cast(id as int) as block", "1 as count", "1.0D as weight", "0.0D as log_posterior", "0.0D as approx", "cast(array() as array<double>) as theta", "cast(array() as array<string>) as names")
    approx = inference.loglik(s, spec).first().loglik
    chain = chain.withColumn("approx", F.lit(approx))
    weighted = inference.correct(chain, s, spec, 10).cache()
    got = frame(posterior.weighted_summary(inference.state_draws(weighted, s, spec), ["series_id", "t"]), "t")["mean"].to_numpy()[:12]
    pf = kernels.bootstrap(spec.build(np.zeros(0)), np.array(y, float)[:, None], np.ones((12, 1)), 40_000, np.random.default_rng(1))
    want = kernels.trace(pf)[:, :12, 0].mean(0)
    assert np.abs(got - want).max() < 0.17 and abs(got.mean() - want.mean()) < 0.06
    rates = frame(posterior.weighted_summary(inference.fitted(weighted, s, spec), ["series_id", "t"]), "t")["mean"].mean()
    assert abs(rates - np.exp(kernels.trace(pf)[:, :12, 0]).mean()) < 0.03


def test_covariates_of_each_series(spark):
    """A known coefficient with covariates per series: likelihood, chain and forecasts follow x; too few future rows are an error."""
    r = np.random.default_rng(7)
    rows, ahead = [], []
    for k in range(2):
        x = r.normal(size=33)
        y = 3.0 * x + 0.1 * r.normal(size=33)
        rows += [(f"s{k}", t + 1, float(y[t]), [float(x[t])]) for t in range(30)]
        ahead += [(f"s{k}", t + 1, [float(x[t])]) for t in range(30, 33)]
    s = spark.createDataFrame(rows, "series_id string, t int, y double, x array<double>").cache()
    future = spark.createDataFrame(ahead, "series_id string, t int, x array<double>")
    known = models.structural(sd_level=0.01, sd_y=0.2, beta=(3.0,), P1=[[1.0]])
    plain = s.select("series_id", "t", (F.col("y") - 3.0 * F.col("x")[0]).alias("y"))
    a, b = (frame(inference.loglik(d, m), "series_id")["loglik"] for d, m in ((s, known), (plain, models.structural(sd_level=0.01, sd_y=0.2, P1=[[1.0]]))))
    assert np.allclose(a, b)
    spec = models.structural(sd_level=0.01, sd_y=priors.halfnormal(0.5, 1), beta=(priors.normal(0, 0, 10),), P1=[[1.0]])
    chain = inference.run_mcmc(s, spec, 1500, 500).cache()
    got = frame(posterior.summary(posterior.long_draws(chain), ["series_id", "variable"]), "series_id", "variable")
    assert np.abs(got[got.variable == "beta_1"]["mean"] - 3.0).max() < 0.1
    paths = frame(posterior.weighted_summary(inference.predict(chain, s, spec, 3, future=future, draws=200), ["series_id", "t"]), "series_id", "t")
    assert np.abs(paths["mean"].to_numpy() - [3.0 * x[0] for _, _, x in ahead]).max() < 0.35
    with pytest.raises(Exception, match="future rows|times"):
        inference.predict(chain, s, spec, 4, future=future).count()
    with pytest.raises(Exception, match="times"):
        inference.predict(chain, s, spec, 1).count()


def test_thinning_subsamples_and_long_block_numbers(counts):
    chain = inference.run_mcmc(counts, COUNTS, 300, 100, method="approx", thin=4).cache()
    assert [r[0] for r in chain.groupBy("series_id").agg(F.sum("count")).select("sum(count)").collect()] == [50, 50]
    few = inference.subsample(chain, 20)
    assert few.columns == chain.columns and [r[0] for r in few.groupBy("series_id").agg(F.sum("count")).select("sum(count)").collect()] == [20, 20]
    far = chain.withColumn("block", F.col("block") + 2_000_000_000)
    out = inference.correct(far, counts, COUNTS, 3, method="is3")
    assert out.select("series_id", "chain_id", "block").distinct().count() == 100


def test_nonlinear_states_agree_with_the_linear_model(spark):
    """The linear example: extended states, particle paths, fitted means and the mode equal the Kalman smoother's."""
    from stateweave.operators import nonlinear

    r = np.random.default_rng(3)
    y = np.cumsum(r.normal(size=15)) + r.normal(size=15)
    s = spark.createDataFrame([("a", t + 1, None if t == 4 else float(v)) for t, v in enumerate(y)], "series_id string, t int, y double")
    model, th = nonlinear.example("nlg_linear_gaussian"), [0.0]
    exact = kernels.smoother(models.structural(sd_level=1.0, sd_y=1.0, P1=[[1.0]]).build(np.zeros(0)), np.where(np.arange(15) == 4, np.nan, y)[:, None])
    chain = spark.range(1, 401).selectExpr("'a' as series_id", "1 as chain_id", "cast(id as int) as block", "1 as count", "1.0D as weight", "0.0D as log_posterior", "0.0D as approx", "array(0.0D) as theta", "array('h') as names")
    got = frame(nonlinear.state_summary(chain, s, model), "t")
    assert np.allclose(got["mean"], exact["means"][:, 0]) and np.allclose(got["variance"], exact["variances"][:, 0, 0])
    for sampling in ("bsf", "psi", "ekf"):
        paths = frame(posterior.weighted_summary(nonlinear.state_draws(chain, s, model, 30, sampling), ["series_id", "t"]), "t")
        assert len(paths) == 16 and np.abs(paths["mean"] - exact["means"][:, 0]).max() < 0.35, sampling
    fit = frame(posterior.weighted_summary(nonlinear.fitted(chain, s, model, sampling="psi"), ["series_id", "t"]), "t")
    assert np.abs(fit["mean"] - exact["means"][:15, 0]).max() < 0.3
    mode = frame(nonlinear.approximate(s, model, th), "t")
    assert np.allclose(mode["mode"].str[0], exact["means"][:, 0], atol=1e-6)
    tried = nonlinear.suggest_count(s, model, th, (5, 10), 20).collect()
    assert [(r.particles, r.suggested) for r in tried] == [(5, 5)] and tried[0].sd < 1


def test_problems_of_series(spark):
    from stateweave.sources import series as src

    inf = float("inf")
    rows = [("good", 1, 2.0, 3.0), ("good", 2, None, 3.0), ("bad", 1, -1.5, 1.0), ("bad", 1, inf, 1.0), ("bad", 4, 5.0, 2.0), ("one", 1, None, 0.0)]
    got = {(r.series_id, r.problem): r.rows for r in src.problems(spark.createDataFrame(rows, "series_id string, t int, y double, u double"), "binomial").collect()}
    assert got == {
        ("bad", "infinite"): 1, ("bad", "negative"): 1, ("bad", "fractional"): 1, ("bad", "over trials"): 1, ("bad", "repeated"): 1, ("bad", "missing"): 2,
        ("one", "bad exposure"): 1, ("one", "short"): 1, ("one", "no value"): 1,
    }
