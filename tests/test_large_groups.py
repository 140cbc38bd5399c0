"""Operators whose groups may be larger than a task: equal to whole-group results when ranges and chunks are small."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stateweave.functions import priors as pr
from stateweave.functions.random import generator
from stateweave.operators import inference, kernels, models, posterior


@pytest.fixture(autouse=True)
def many_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def chain_of(rho, n, seed):
    rng, x = np.random.default_rng(seed), np.zeros(n)
    for k in range(1, n):
        x[k] = rho * x[k - 1] + rng.normal()
    return x


def test_autocovariances_merge(spark):
    """Chunks far shorter than the chain, and rounds of lags up to all, at rho of 0.99 and others."""
    chains = {"slow": chain_of(0.99, 6000, 1), "fast": chain_of(0.1, 5000, 2), "short": chain_of(0.5, 40, 3), "flat": np.full(900, 0.1), "trend": np.arange(700.0), "two": np.array([1.0, 2.0])}
    broken = chain_of(0.3, 300, 4)
    broken[7] = np.inf
    chains["broken"] = broken
    frame = pd.DataFrame([(k, 3 * i + 5, float(v)) for k, x in chains.items() for i, v in enumerate(x)], columns=["variable", "iter", "value"]).sample(frac=1, random_state=0)
    draws = spark.createDataFrame(frame).repartition(5)
    got = {r.variable: r for r in posterior.merged_iact(draws, ["variable"], chunk=256, lags=16).collect()}
    assert {k: r.n for k, r in got.items()} == {k: len(x) for k, x in chains.items()}
    for k, x in chains.items():
        want = posterior.sokal_time(x)
        assert got[k].iact is None if np.isnan(want) else abs(got[k].iact - want) < 1e-6 * max(1, want), k
    assert posterior.merged_iact(draws.where("iter < 0"), ["variable"]).count() == 0


def test_weighted_quantiles_over_ranges(spark):
    rng = np.random.default_rng(3)
    frame = pd.DataFrame({"variable": np.where(rng.random(8000) < 0.9, "hot", "other"), "value": np.round(rng.normal(size=8000), 2), "weight": rng.random(8000)})
    got = {r.variable: r for r in posterior.weighted_summary(spark.createDataFrame(frame).repartition(4), ["variable"], (0.1, 0.5)).collect()}
    for name, g in frame.groupby("variable"):
        g = g.sort_values("value")
        share = g.groupby("value")["weight"].sum().cumsum() / g.weight.sum()
        mean = np.average(g.value, weights=g.weight)
        assert abs(got[name]["mean"] - mean) < 1e-9 and abs(got[name].sd - np.sqrt(np.average((g.value - mean) ** 2, weights=g.weight))) < 1e-9
        assert [got[name].q10, got[name].q50] == [share.index[np.argmax(share.to_numpy() >= p - 1e-12)] for p in (0.1, 0.5)]


def test_one_long_chain_and_one_large_cloud(spark):
    chain = spark.range(20_000).select(
        F.lit("a").alias("series_id"), F.lit(1).alias("chain_id"), F.col("id").cast("int").alias("block"), (1 + F.col("id") % 3).cast("int").alias("count"), F.lit(1.0).alias("weight"),
        F.array(F.col("id").cast("double")).alias("theta"), F.array(F.lit("x")).alias("names"),
    ).repartition(5)
    draws = posterior.long_draws(chain).select("iter", "value").toPandas().sort_values("iter")
    assert draws["iter"].tolist() == list(range(1, len(draws) + 1)) and (draws.value.diff().dropna() >= 0).all() and len(draws) == sum(1 + k % 3 for k in range(20_000))
    weights = np.random.default_rng(5).integers(0, 9, 20_000).astype(float)
    points = np.random.default_rng(6).random(20_000)
    cloud = spark.createDataFrame(pd.DataFrame({"c": 1, "particle": np.arange(1, 20_001), "weight": weights, "u": points})).repartition(5)
    got = posterior.stratified(cloud, ["c"], F.col("u")).toPandas().sort_values("stratum")
    upto = np.cumsum(weights) / weights.sum()
    upto[-1] = 1.0
    assert got.ancestor.tolist() == (np.searchsorted(upto, (np.arange(20_000) + points) / 20_000) + 1).tolist()


def test_matrix_moments(spark):
    rng = np.random.default_rng(7)
    rows = []
    for g in ("a", "b"):
        for _ in range(200):
            L = rng.normal(size=(3, 3))
            rows.append((g, float(rng.random()), (1e7 + rng.normal(size=3)).tolist(), (L @ L.T).tolist()))
    odd = [("a", 0.0, [9.0, 9.0, 9.0], None), ("a", 1.0, None, None), ("a", None, [1.0, 1.0, 1.0], None), ("a", 1.0, [None, 1.0, 1.0], None), ("gone", 0.0, [1.0, 1.0, 1.0], None)]
    frame = spark.createDataFrame(rows + odd, "g string, weight double, values array<double>, within array<array<double>>").repartition(6)
    for within in (None, "within"):
        got = posterior.matrix_moments(frame.where("within is not null") if within else frame, ["g"], within).collect()
        assert {r.g for r in got} == {"a", "b"} and len(got) == 12
        for g in ("a", "b"):
            w, x = np.array([r[1] for r in rows if r[0] == g]), np.array([r[2] for r in rows if r[0] == g])
            cov = np.cov(x.T, aweights=w, ddof=0) + (np.average([r[3] for r in rows if r[0] == g], axis=0, weights=w) if within else 0)
            for r in got:
                if r.g == g:
                    assert abs(r.covariance - cov[r.i, r.j]) < 1e-6 and abs(r.mean_i - np.average(x[:, r.i], weights=w)) < 1e-6


SPEC = models.structural(sd_level=pr.halfnormal(0.3, 1.0), sd_slope=0.05, dist="poisson", P1=np.diag([2.0, 0.1]))


@pytest.fixture(scope="module")
def counts(spark):
    rng = np.random.default_rng(8)
    rows = [(f"s{k}", t, None if t == 4 else float(rng.poisson(5 + k))) for k in range(2) for t in range(1, 16)]
    return spark.createDataFrame(rows, "series_id string, t int, y double")


def test_modes_of_the_chain_spare_the_search(counts):
    """The chain has each block's mode; weights are the same with it, without it, and by the filter of one block."""
    chain = inference.run_mcmc(counts, SPEC, 60, 20, count=20)
    assert "mode" in chain.columns and chain.where("size(mode) = 15").count() == chain.count()
    again = {(r.series_id, r.block): r for r in inference.correct(chain.drop("mode"), counts, SPEC, 20).collect()}
    for r in chain.collect():
        assert abs(again[r.series_id, r.block].weight - r.weight) < 1e-6 * r.weight
    y = {s: np.array([[np.nan if r.y is None else r.y] for r in counts.where(f"series_id = '{s}'").orderBy("t").collect()]) for s in ("s0", "s1")}
    for r in chain.limit(5).collect():
        model, data = SPEC.build(np.array(r.theta)), y[r.series_id]
        mode = kernels.Approximation(model, data, np.ones_like(data)).mode[:, 0]
        assert np.allclose(mode, r["mode"], atol=1e-4)


def test_blocks_step_together_like_single_filters(counts):
    """The batched guided filter's likelihoods are unbiased: their mean over seeds is that of the filter of one series, and exact moments agree."""
    y = np.array([[np.nan if r.y is None else r.y] for r in counts.where("series_id = 's0'").orderBy("t").collect()])
    thetas = [np.array([v]) for v in (-2.0, -1.0, -0.3)]
    built = [SPEC.build(t) for t in thetas]
    m, u = kernels.stacked(built), np.ones(len(y))
    value = np.array([kernels.batched_guided(m, "poisson", y[:, 0], u, kernels.offsets(built, len(y)), 30, [generator(k, "x", j) for j in range(3)])[0] for k in range(150)])
    single = np.array([[kernels.guided(kernels.Approximation(b, y, u[:, None]), 30, generator(k, "y", j))["loglik"] for j, b in enumerate(built)] for k in range(150)])
    assert np.allclose(np.log(np.exp(value - value.mean(0)).mean(0)) + value.mean(0), np.log(np.exp(single - single.mean(0)).mean(0)) + single.mean(0), atol=0.05)
    assert (value.std(0) < 2 * single.std(0) + 0.02).all()
    alone = kernels.batched_guided(kernels.stacked(built[1:2]), "poisson", y[:, 0], u, kernels.offsets(built[1:2], len(y)), 30, [generator(0, "x", 1)], paths=True)
    both = kernels.batched_guided(m, "poisson", y[:, 0], u, kernels.offsets(built, len(y)), 30, [generator(0, "x", j) for j in range(3)], paths=True)
    assert np.allclose(alone[0][0], both[0][1]) and np.allclose(alone[1][0], both[1][1])
    smooth = kernels.smoother(kernels.Approximation(built[1], y, u[:, None]).model, kernels.Approximation(built[1], y, u[:, None]).y)
    got = kernels.batched_smoother(kernels.stacked(built[1:2]), *(lambda a: (a.y.T, np.stack([np.diag(h) ** 2 for h in a.model.H]).T))(kernels.Approximation(built[1], y, u[:, None])))
    assert all(np.allclose(g[:, 0], smooth[k]) for g, k in zip(got, ("means", "variances", "lag"), strict=True))


def test_one_mode_for_a_series(counts):
    """Without local_approx every block has the mode of the starting values, and importance weights undo the rougher approximation."""
    rough = inference.run_mcmc(counts, SPEC, 400, 100, count=30, local_approx=False)
    assert rough.select("series_id", F.col("mode").cast("string")).distinct().count() == 2
    fine = inference.run_mcmc(counts, SPEC, 400, 100, count=30)
    means = [{r.series_id: r["mean"] for r in posterior.weighted_summary(posterior.long_draws(c, expand=False), ["series_id"]).collect()} for c in (rough, fine)]
    assert all(abs(means[0][s] - means[1][s]) < 0.5 for s in means[1])


def test_covariances_of_states(counts):
    """Full covariances over a chain, against the smoother at each block by hand."""
    spec = models.structural(sd_level=pr.halfnormal(0.5, 1.0), sd_slope=0.1, sd_y=pr.halfnormal(1.0, 2.0), P1=np.diag([9.0, 1.0]))
    chain = inference.run_mcmc(counts, spec, 40, 10)
    got = {(r.t, r.i, r.j): r for r in inference.state_covariances(chain, counts, spec).where("series_id = 's1'").collect()}
    y = np.array([[np.nan if r.y is None else r.y] for r in counts.where("series_id = 's1'").orderBy("t").collect()])
    blocks = chain.where("series_id = 's1'").collect()
    w = np.array([b["count"] for b in blocks], float)
    s = [kernels.smoother(spec.build(np.array(b.theta)), y) for b in blocks]
    for t in (1, 9, 16):
        m, v = np.array([x["means"][t - 1] for x in s]), np.array([x["variances"][t - 1] for x in s])
        want = np.average(v, axis=0, weights=w) + np.cov(m.T, aweights=w, ddof=0)
        assert all(abs(got[t, i, j].covariance - want[i, j]) < 1e-8 for i in range(2) for j in range(i, 2))
    plain = {(r.t, r.state): r.variance for r in inference.state_summary(chain, counts, spec).where("series_id = 's1'").collect()}
    assert all(abs(plain[t, k] - got[t, k, k].covariance) < 1e-12 for t in (1, 16) for k in range(2))


def test_counts_are_tried_in_rounds(counts):
    got = inference.suggest_count(counts, SPEC, candidates=(5, 40, 80), replications=15).collect()
    first = {r.series_id: r.suggested for r in got}
    tried = {s: sorted(r.particles for r in got if r.series_id == s) for s in first}
    assert all(f is not None and tried[s] == [c for c in (5, 40, 80) if c <= f] for s, f in first.items())


def test_wide_states_of_a_chain(counts):
    chain = inference.run_mcmc(counts, SPEC, 40, 10, count=5)
    wide = posterior.wide_states(inference.state_paths(chain, counts, SPEC, count=5), {"level": 0, "slope": 1}, [1, 16])
    long = {(r.series_id, r.iter, r.t, r.state): r.value for r in inference.state_draws(chain, counts, SPEC, count=5).collect()}
    firsts = {}
    for r in sorted(chain.collect(), key=lambda r: (r.series_id, r.block)):
        firsts.setdefault(r.series_id, [1]).append(firsts[r.series_id][-1] + r["count"])
    for r in wide.collect():
        block = firsts[r.series_id].index(r.iter) + 1
        assert all(abs(r[f"{n}[{t}]"] - long[r.series_id, block, t, k]) < 1e-12 for k, n in enumerate(("level", "slope")) for t in (1, 16))


def test_several_variables_step_together(spark):
    """Batched likelihoods of bivariate series with partly missing rows and different lengths, against the filter of one; and chains of them."""
    rng = np.random.default_rng(12)
    built, data = [], []
    for k in range(5):
        Z, T = rng.normal(size=(2, 3)), 0.5 * rng.normal(size=(3, 3))
        built.append(models.Matrices(Z, T, rng.normal(size=(3, 2)), rng.normal(size=3), np.eye(3), rng.normal(size=(2, 2)) if k else np.zeros((2, 2)), rng.normal(size=(20, 2)) if k % 2 else None))
        y = rng.normal(size=(20, 2))
        y[3, 0] = y[7] = np.nan
        y[15 + k :] = np.nan
        data.append(y)
    assert np.allclose(kernels.forward_many(built, np.array(data)), [kernels.kalman(b, y)["loglik"] for b, y in zip(built, data, strict=True)])
    sds = {"level": pr.halfnormal(1, 5), "noise": pr.halfnormal(1, 5)}
    spec = models.general(lambda th: models.Matrices(np.eye(2), np.eye(2), np.exp(th[0]) * np.eye(2), np.zeros(2), 9 * np.eye(2), np.exp(th[1]) * np.eye(2)), sds, tuple(sds))
    y = np.cumsum(rng.normal(size=(25, 2)), 0)
    rows = [(s, t + 1, [None if t == 4 else float(a), float(b)]) for s in "ab" for t, (a, b) in enumerate(y[: 25 if s == "a" else 18])]
    series = spark.createDataFrame(rows, "series_id string, t int, y array<double>")
    chain = inference.run_mcmc(series, spec, 60, 20, chains=2)
    assert chain.groupBy("series_id", "chain_id").agg(F.sum("count")).count() == 4
    for r in chain.limit(6).collect():
        own = y[: 25 if r.series_id == "a" else 18].copy()
        own[4, 0] = np.nan
        theta = np.array(r.theta)
        assert abs(r.approx - kernels.kalman(spec.build(theta), own)["loglik"]) < 1e-8


def test_a_near_start_finds_the_same_modes():
    rng = np.random.default_rng(13)
    y, u = rng.poisson(4, (6, 30)).astype(float), np.ones((6, 30))
    y[2, 5:9] = np.nan
    m = kernels.stacked([SPEC.build(np.array([v])) for v in np.linspace(-3, 0, 6)])
    D = np.zeros_like(y)
    far = kernels.find_modes(m, "poisson", y, u, D)
    near = np.where(np.arange(6)[:, None] == 4, np.nan, far[0] + 0.3)
    near[1] = 1e6  # a start from which the search is lost
    for a, b in zip(far, kernels.find_modes(m, "poisson", y, u, D, near=near), strict=True):
        assert np.allclose(a, b, atol=1e-3, equal_nan=True)


def test_no_window_holds_a_chain(spark):
    """Blocks were numbered, and halves found, by a window over each of a few chains."""
    from stateweave.plans import queries

    for name in ("draws_expand", "draws_long", "draws_wide_states"):
        assert "row_number" not in queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString(), name
    assert "ntile" not in queries.QUERIES["split_rhat"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()


def test_equal_values_are_added_up(spark, monkeypatch):
    """No percentile gathers a group's values, and quantiles, moments and counts are those of numpy."""
    rng = np.random.default_rng(3)
    frame = pd.DataFrame({"variable": rng.choice(["a", "b"], 4000), "value": np.round(rng.normal(size=4000), 1)})
    draws = spark.createDataFrame(frame)
    found = posterior.summary(draws, ["variable"], (0.0, 0.1, 0.5, 1.0))
    assert "percentile" not in found._jdf.queryExecution().toString()
    for r in found.collect():
        x = frame.value[frame.variable == r.variable].to_numpy()
        assert np.allclose([r["mean"], r.sd, r.q0, r.q10, r.q50, r.q100], [x.mean(), x.std(ddof=1), *np.quantile(x, (0, 0.1, 0.5, 1))])
    odd = spark.sql("select * from values ('one', 2.0D), ('none', null), ('mixed', null), ('mixed', 1.0D), ('mixed', 3.0D) t(variable, value)")
    got = {r.variable: (r["mean"], r.sd, r.q50) for r in posterior.summary(odd, ["variable"], (0.5,)).collect()}
    assert got == {"one": (2.0, None, 2.0), "none": (None, None, None), "mixed": (2.0, 2**0.5, 2.0)}


def test_halves_of_ranges(spark, monkeypatch):
    """Split R-hat from ranges of 64 iterations, with gaps, against whole chains."""
    monkeypatch.setattr(posterior, "RANGE", 64)
    rng = np.random.default_rng(4)
    chains = {c: rng.normal(c, 1, n) for c, n in enumerate((1000, 777, 129))}
    rows = [("v", c, 3 * i + 5, float(x)) for c, xs in chains.items() for i, x in enumerate(xs)]
    got = posterior.rhat(spark.createDataFrame(rows, "variable string, chain_id int, iter long, value double").repartition(5), ["variable"]).first().rhat
    halves = [h for x in chains.values() for h in (x[: -(len(x) // 2)], x[-(len(x) // 2) :])]
    n, w, b = np.mean([len(h) for h in halves]), np.mean([h.var(ddof=1) for h in halves]), np.var([h.mean() for h in halves], ddof=1)
    assert np.isclose(got, np.sqrt(((n - 1) / n * w + b) / w))


def test_iterations_with_gaps_or_repeats(spark):
    """Dense iterations are positions; others, also as many as their range with one there twice, are ranked."""
    x = np.cumsum(np.random.default_rng(5).normal(size=3000)) * 0.05 + np.random.default_rng(6).normal(size=3000)
    want = posterior.sokal_time(x)
    dense, gaps, repeats = np.arange(7, 3007), 2 * np.arange(3000), np.arange(3000)
    repeats[10] = 9
    for places in (dense, gaps, repeats):
        draws = spark.createDataFrame(pd.DataFrame({"variable": "v", "iter": places, "value": x})).repartition(7)
        got = posterior.merged_iact(draws, ["variable"], chunk=256, lags=64).first()
        assert got.n == 3000 and np.isclose(got.iact, want, rtol=0.05 if places is repeats else 1e-9)


def test_increments_are_drawn_once(spark):
    """The fold of a path mentions each increment several times; it drew it again each time."""
    from stateweave.plans import queries

    plan = queries.QUERIES["milstein_path"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5") == 2
    assert "RepartitionByExpression" in plan
