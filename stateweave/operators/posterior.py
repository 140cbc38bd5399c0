"""Posterior draws: jump chains, long and wide frames, summaries and diagnostics, as grouping, windows and joins.

A jump chain has a row per accepted state: series_id, chain_id, block, count (how long it stayed), weight (importance
weight, 1 without), log_posterior, theta (array of doubles) and names (array of strings, one order for all rows).
Weighted moments are sums of w x / sums of w; a weighted quantile is the least value whose cumulative weight reaches it.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scan import running_sums, written

KEYS = ["series_id", "chain_id"]


def _counted(chain: DataFrame) -> DataFrame:
    """``chain`` with ``upto``, the iterations up to and with each block: its own column, else a running sum over all tasks."""
    return chain if "upto" in chain.columns else running_sums(chain, KEYS, [F.col("block")], {"upto": F.col("count").cast("long")})


def long_draws(chain: DataFrame, expand: bool = True, extra: tuple[str, ...] = ()) -> DataFrame:
    """series_id, chain_id, iter, variable, value, weight.

    With ``expand`` a state of count c gives c iterations; else one row whose weight is count x importance weight. The iterations
    before a block are a running sum over all tasks, so a chain may be longer than a task; a chain that knows them has a column
    ``upto``: the iterations up to and with each block.
    """
    rows = _counted(chain).withColumn("first", F.col("upto") - F.col("count") + 1)
    rows = rows.select(*KEYS, "first", "count", "weight", *extra, F.posexplode(F.arrays_zip("names", "theta")).alias("k", "p"))
    rows = rows.select(*KEYS, "first", "count", "weight", *extra, F.col("p.names").alias("variable"), F.col("p.theta").alias("value"))
    if not expand:
        return rows.select(*KEYS, F.col("first").alias("iter"), "variable", *extra, "value", (F.col("count") * F.col("weight")).alias("weight"))
    rows = rows.withColumn("iter", F.explode(F.sequence("first", F.col("first") + F.col("count") - 1)))
    return rows.select(*KEYS, "iter", "variable", *extra, "value", "weight")


def wide_draws(draws: DataFrame, variables: list[str]) -> DataFrame:
    """A column per variable; the list is given, so that no job has to find it."""
    return draws.groupBy(*KEYS, "iter").agg(*(F.first(F.when(F.col("variable") == v, F.col("value")), ignorenulls=True).alias(v) for v in variables))


def summary(draws: DataFrame, by: list[str], probs: tuple[float, ...] = (0.025, 0.975)) -> DataFrame:
    """Mean, sd and interpolated quantiles of unweighted draws."""
    return _summarised(_tallied(draws.withColumn("_n", F.lit(1).cast("long")), by, F.sum("_n").alias("_n")), by, probs).drop("n")


def _tallied(draws: DataFrame, by: list[str], *sums: Column) -> DataFrame:
    """A row for each distinct value of each of ``by``, written: values that repeat are added up before they meet in a task."""
    return written(draws.groupBy(*by, "value").agg(*sums), "tally")


def _summarised(tally: DataFrame, by: list[str], probs: tuple[float, ...]) -> DataFrame:
    """by, n, mean, sd and interpolated quantiles of values that occur ``_n`` times.

    The values' ranks are running sums over ranges, so no task holds the values of one of ``by``. Nulls count in n only; NaN is largest.
    """
    x, n = F.col("value").cast("double"), F.col("_n")
    there = tally.where("value is not null")
    means = tally.groupBy(*by).agg(F.sum("_n").alias("n"), F.sum(F.when(x.isNotNull(), n)).alias("_m"), (F.sum(n * x) / F.sum(F.when(x.isNotNull(), n))).alias("mean"))
    found = _beside(there, means, by)
    gap = F.col("value") - F.col("mean")
    spread = found.groupBy(*by).agg(F.sqrt(F.try_divide(F.sum(n * gap * gap), F.first("_m") - 1)).alias("sd"))
    placed = _beside(running_sums(there, by, [F.col("value")], {"_upto": n}), means, by)
    # the value at each place (from 0) below and above p (m - 1), where the first one's rank passes it
    at = {p: F.lit(p) * (F.col("_m") - 1) for p in probs}
    ends = {(p, k): f(v) for p, v in at.items() for k, f in (("lo", F.floor), ("hi", F.ceil))}
    lies = lambda place: (F.col("_upto") > place) & (F.col("_upto") - n <= place)
    picks = [F.first(F.when(lies(v), x), ignorenulls=True).alias(f"_{k}{i}") for i, p in enumerate(probs) for k, v in (("lo", ends[p, "lo"]), ("hi", ends[p, "hi"]))]
    picked = placed.groupBy(*by).agg(F.first("_m").alias("_k"), *picks)
    share = lambda p: F.lit(p) * (F.col("_k") - 1) - F.floor(F.lit(p) * (F.col("_k") - 1))
    mixed = [F.when(F.col(f"_lo{i}") == F.col(f"_hi{i}"), F.col(f"_lo{i}")).otherwise((1 - share(p)) * F.col(f"_lo{i}") + share(p) * F.col(f"_hi{i}")).alias(_name(p)) for i, p in enumerate(probs)]
    out = _beside(_beside(means, spread, by, "left"), picked.select(*by, *mixed), by, "left")
    return out.select(*by, "n", "mean", "sd", *(_name(p) for p in probs))


def _beside(left: DataFrame, right: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """``left`` with the other columns of ``right``, which has a row for each of ``by``; nulls of ``by`` meet."""
    other = right.select(*(F.col(c).alias(f"_by_{c}") for c in by), *(c for c in right.columns if c not in by))
    same = reduce(lambda a, b: a & b, (left[c].eqNullSafe(other[f"_by_{c}"]) for c in by), F.lit(True))
    return left.join(other, same, how).drop(*(f"_by_{c}" for c in by))


def weighted_summary(draws: DataFrame, by: list[str], probs: tuple[float, ...] = (0.025, 0.975)) -> DataFrame:
    """Mean, sd and quantiles of weighted draws.

    The weights of equal values are added up; values are sorted over all tasks and shares of weight are running sums over ranges,
    so no task holds all draws of one of ``by`` or all of a common value.
    """
    w, x = F.col("weight"), F.col("value")
    ranked = running_sums(draws.groupBy(*by, "value").agg(F.sum("weight").alias("weight")), by, [x], {"_upto": w, "_wx": w * x}, totals=True)
    ranked = ranked.withColumns({"mean": F.col("_wx_total") / F.col("_upto_total"), "share": F.col("_upto") / F.col("_upto_total")})
    quantiles = [F.min(F.when(F.col("share") >= p - 1e-12, x)).alias(_name(p)) for p in probs]
    spread = F.sqrt(F.sum(w * (x - F.col("mean")) * (x - F.col("mean"))) / F.sum(w)).alias("sd")
    return ranked.groupBy(*by).agg(F.first("mean").alias("mean"), spread, *quantiles)


def summary_both(draws: DataFrame, probs: tuple[float, ...] = (0.025, 0.975)) -> DataFrame:
    """Parameters and states in one pass: series_id, variable, time, n, mean, sd and quantiles of unweighted draws.

    ``draws`` has series_id, variable, time (null for parameters) and value. Grouping sets give a row for each variable (time
    null: all its draws, for a state those of all times) and one for each time of a state. Equal draws are added up first.
    """
    keys = ["series_id", "variable", "time", "value"]
    tally = _tallied(draws, keys[:3], F.count("*").alias("_n"))
    sets = tally.groupingSets([[F.col(c) for c in ("series_id", "variable", "value")], [F.col(c) for c in keys]], *(F.col(c) for c in keys)).agg(F.grouping("time").alias("_all"), F.sum("_n").alias("_n"))
    both = written(sets.where("_all = 1 or time is not null").drop("_all"), "tally")
    return _summarised(both, keys[:3], probs)


def wide_states(chain: DataFrame, states: dict[str, int], times: list[int], parameters: bool = True) -> DataFrame:
    """A row per block, with iter (its first iteration), weight (count x weight), the parameters if asked, and a column ``state[time]`` for each chosen state and time.

    ``chain`` has ``alpha``, each block's path (array over times of arrays over states, as of ``inference.state_paths``);
    ``states`` are names and places from 0, ``times`` count from 1. Columns are picked from the nested array, so nothing is exploded; a
    time or state that a path lacks is null.
    """
    names = [r[0] for r in chain.select(F.explode("names").alias("n")).distinct().orderBy("n").limit(10_000).collect()] if parameters else []
    rows = _counted(chain)
    theta = [F.try_element_at("theta", F.array_position("names", n).cast("int")).alias(n) for n in names]
    picked = [F.get(F.get("alpha", F.lit(t - 1)), F.lit(k)).alias(f"{name}[{t}]") for name, k in states.items() for t in times]
    return rows.select(*KEYS, (F.col("upto") - F.col("count") + 1).alias("iter"), (F.col("count") * F.col("weight")).alias("weight"), *theta, *picked)


def _name(p: float) -> str:
    return f"q{p * 100:g}".replace(".", "_")


def matrix_moments(draws: DataFrame, by: list[str], within: str | None = None) -> DataFrame:
    """i, j (from 0, i <= j), mean_i, mean_j and covariance of weighted vectors ``values`` (weight: ``weight``), for each of ``by``.

    The state of the aggregate is sum w, sum w x and sum w x x', all plain sums, so tasks hold partial ones that add up whatever
    the partitioning. Vectors are shifted by a vector of their group first, so that large means cost no digits. With ``within`` (a matrix of each vector)
    its mean is added. Rows of weight 0 or null, and vectors that are null or hold a null, take no part; a group without others gives no row.
    """
    fine = draws.where((F.col("weight") > 0) & F.col("values").isNotNull() & ~F.exists("values", lambda v: v.isNull()))
    shift = fine.groupBy(*by).agg(F.min("values").alias("_shift"))
    pairs = fine.join(shift, by).select(*by, "weight", *([within] if within else []), "_shift", F.zip_with("values", "_shift", lambda a, b: a - b).alias("d"))
    pairs = pairs.select("*", F.posexplode("d").alias("i", "di"))
    extra = F.expr(f"{within}[i][j]") if within else F.lit(0.0)
    pairs = pairs.select(*by, "weight", "i", "di", "_shift", *([within] if within else []), F.posexplode("d").alias("j", "dj")).where("i <= j")
    w, a, b = F.col("weight"), F.col("di"), F.col("dj")
    state = pairs.groupBy(*by, "i", "j").agg(
        F.sum(w).alias("w"), F.sum(w * a).alias("wa"), F.sum(w * b).alias("wb"), F.sum(w * a * b + w * extra).alias("wab"),
        F.first(F.expr("_shift[i]")).alias("si"), F.first(F.expr("_shift[j]")).alias("sj"),
    )
    ma, mb = F.col("wa") / F.col("w"), F.col("wb") / F.col("w")
    return state.select(*by, "i", "j", (ma + F.col("si")).alias("mean_i"), (mb + F.col("sj")).alias("mean_j"), (F.col("wab") / F.col("w") - ma * mb).alias("covariance"))


def best(chain: DataFrame) -> DataFrame:
    """The state of largest log posterior of each series."""
    return chain.groupBy("series_id").agg(F.max_by("theta", "log_posterior").alias("theta"), F.max("log_posterior").alias("log_posterior"))


def acceptance(chain: DataFrame) -> DataFrame:
    """Share of iterations that moved, for each chain."""
    return chain.groupBy(*KEYS).agg(((F.count("*") - 1) / F.greatest(F.sum("count") - 1, F.lit(1))).alias("acceptance"), F.sum("count").alias("iterations"))


def per_chain(draws: DataFrame, by: list[str], work, schema: str) -> DataFrame:
    """``work(values)`` of the values of each of ``by``, in the order of ``iter``; a chain's draws (8 bytes each) fit a task."""

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        found = work(frame.sort_values("iter")["value"].to_numpy(float))
        return pd.DataFrame([(*key, *found)], columns=names)

    types = dict(draws.dtypes)
    names = [*by, *(c.split()[0] for c in schema.split(", "))]
    return draws.select(*by, "iter", "value").groupBy(*by).applyInPandas(run, ", ".join(f"{c} {types[c]}" for c in by) + ", " + schema)


def lag_products(x: np.ndarray) -> np.ndarray:
    """Sums of x[i] x[i + k] of the centred values for k from 0 to n - 1, by a fast Fourier transform."""
    d, n = x - x.mean(), len(x)
    f = np.fft.rfft(d, 1 << (2 * n - 1).bit_length())
    return np.fft.irfft(f * f.conj())[:n]


def sokal_time(x: np.ndarray) -> float:
    """1 + 2 sum of autocorrelations up to the first lag over max(5, log10 n) times the sum so far; all lags if need be."""
    n = len(x)
    if n < 2 or not np.isfinite(x).all() or np.ptp(x) == 0:
        return math.nan
    c = lag_products(x)
    var = c[0] / (n - 1)
    tau = 1 + 2 * np.cumsum(c[1:] / (n - np.arange(1, n)) / var)
    over = np.flatnonzero(np.arange(1, n) > max(5.0, math.log10(n)) * tau)
    return max(0.0, float(tau[over[0] if len(over) else -1]))


def geyer_time(x: np.ndarray) -> float:
    """By Geyer's initial monotone sequence over both halves of the chain, as for the effective size of a mean."""
    n = len(x) // 2
    if n < 3 or not np.isfinite(x).all() or np.ptp(x) == 0:
        return math.nan
    halves = np.stack([x[:n], x[-n:]])
    acov = np.mean([lag_products(h) for h in halves], 0) / n
    within = acov[0] * n / (n - 1)
    pooled = acov[0] + halves.mean(1).var(ddof=1)
    rho = 1 - (within - acov) / pooled
    rho[0] = 1.0
    pairs = rho[: n // 2 * 2].reshape(-1, 2).sum(1)
    stop = int(np.argmax(pairs <= 0)) if (pairs <= 0).any() else len(pairs) - 1
    last = max(0.0, float(rho[2 * stop])) if stop else 0.0
    tau = -1 + 2 * np.minimum.accumulate(pairs[: max(1, stop)]).sum() + last
    return max(float(tau), 1 / math.log10(2 * n))


#: Draws of a chunk, and lags of the first round of chains of several chunks; each round has ``MORE_LAGS`` times as many.
CHUNK = 65_536
LAGS = 1024
MORE_LAGS = 8


def lag_sums(draws: DataFrame, by: list[str], lags: int, chunk: int) -> DataFrame:
    """by, ``c``: the sums of d[i] d[i + k] for k from 0 to ``lags``, and ``whole``, of rows with pos (from 0) and the centred values ``d``.

    A chain is cut into chunks; each also gets the first ``lags`` values of what follows, so its products with them are its
    own, and the chunks' sums add up. A chain needs no task of its own. ``chunk`` is at least ``lags``. Values that follow each other
    are packed before they are dealt out. ``whole`` is false if a position is missing or there twice; the sums don't count then.
    """
    types = dict(draws.dtypes)
    keys = ", ".join(f"{c} {types[c]}" for c in by)

    def pack(batches):
        for batch in batches:
            codes = np.zeros(batch.num_rows, np.int64)
            for c in by:  # numbers of the keys' combinations in the batch
                k = batch.column(c).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                codes = np.unique(codes * (int(k.max(initial=0)) + 1) + k, return_inverse=True)[1]
            pos, d = batch.column("pos").to_numpy(zero_copy_only=False), batch.column("d").to_numpy(zero_copy_only=False)
            order = np.lexsort((pos, codes))
            codes, pos, d = codes[order], pos[order], d[order].astype("<f8")
            breaks = (np.diff(codes) != 0) | (np.diff(pos) != 1) | (pos[1:] % chunk == 0)
            first = np.concatenate([[0], np.flatnonzero(breaks) + 1]) if len(pos) else np.zeros(0, np.int64)
            last = np.append(first[1:], len(pos))
            rows = []  # (place of a key in the batch, chunk, first position, values)
            for i, j in zip(first.tolist(), last.tolist(), strict=True):
                at, p = divmod(int(pos[i]), chunk)
                rows.append((i, at, int(pos[i]), d[i:j].tobytes()))
                if at and p < lags:
                    rows.append((i, at - 1, int(pos[i]), d[i : min(j, i + lags - p)].tobytes()))
            if rows:
                places, chunks, starts, values = zip(*rows, strict=True)
                picked = [batch.column(c).take(pa.array(order[list(places)])) for c in by]
                yield pa.RecordBatch.from_arrays([*picked, pa.array(chunks, pa.int64()), pa.array(starts, pa.int64()), pa.array(values, pa.binary())], [*by, "chunk", "start", "values"])

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("start")
        base = int(key[-1]) * chunk
        ends = frame["start"].to_numpy() + [len(v) // 8 for v in frame["values"]]
        whole = frame["start"].iloc[0] == base and (frame["start"].to_numpy()[1:] == ends[:-1]).all()
        if not whole:
            return pd.DataFrame([(*key[:-1], [], False)], columns=[*by, "c", "whole"])
        x = np.frombuffer(b"".join(frame["values"]), "<f8")
        size = 1 << (len(x) + lags).bit_length()
        mine = np.concatenate([x[:chunk], np.zeros(max(0, len(x) - chunk))])
        c = np.fft.irfft(np.fft.rfft(mine, size).conj() * np.fft.rfft(x, size), size)[: lags + 1]
        return pd.DataFrame([(*key[:-1], c[: min(lags + 1, size)].tolist(), True)], columns=[*by, "c", "whole"])

    pieces = draws.select(*by, "pos", F.col("d").cast("double").alias("d")).mapInArrow(pack, f"{keys}, chunk long, start long, values binary")
    parts = written(pieces.groupBy(*by, "chunk").applyInPandas(run, f"{keys}, c array<double>, whole boolean"), "lags")
    sums = parts.select(*by, "whole", F.posexplode_outer("c").alias("k", "v")).groupBy(*by, "k").agg(F.sum("v").alias("v"), F.min("whole").alias("whole"))
    listed = F.transform(F.array_sort(F.collect_list(F.when(F.col("k").isNotNull(), F.struct("k", "v")))), lambda p: p["v"]).alias("c")  # one number a lag
    return sums.groupBy(*by).agg(listed, F.min("whole").alias("whole"))


def _stopped(c: np.ndarray, n: int) -> float | None:
    """Sokal's time from lag sums; None if its rule needs more lags. At most n - 1 lags are read."""
    c = np.asarray(c, float)[:n]
    if n < 2 or not np.isfinite(c).all() or c[0] <= 0:
        return math.nan
    k = np.arange(1, len(c))
    tau = 1 + 2 * np.cumsum(c[1:] / (n - k) / (c[0] / (n - 1)))
    over = np.flatnonzero(k > max(5.0, math.log10(n)) * tau)
    return max(0.0, float(tau[over[0]])) if len(over) else max(0.0, float(tau[-1])) if len(c) == n else None


def merged_iact(draws: DataFrame, by: list[str], chunk: int = CHUNK, lags: int = LAGS) -> DataFrame:
    """by, n and Sokal's autocorrelation time of ``value`` in the order of ``iter``, in rounds of more and more lags.

    Autocovariances add up over chunks (``lag_sums``), and each round goes on with the chains whose stopping rule isn't met. A chain
    whose rule needs more lags than a chunk has draws gets larger chunks. Iterations that follow each other without gaps or repeats are
    positions; others get theirs by running sums over all tasks.
    """
    value = F.col("value").cast("double")
    bad = value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))
    sizes = written(draws.groupBy(*by).agg(
        F.count("*").alias("n"), F.min("iter").alias("_from"), F.max("iter").alias("_to"), F.avg(value).alias("_mean"), F.max(bad).alias("_bad"), F.min(value).alias("least"), F.max(value).alias("most"),
    ), "sizes")
    never = F.col("_bad") | (F.col("least") == F.col("most"))
    found = [sizes.where(never).select(*by, "n", F.lit(None).cast("double").alias("iact"))]
    # chains meet under a number: a key of several texts would be moved with each draw
    todo = written(sizes.where(~never).select(F.monotonically_increasing_id().alias("_chain"), *by, "n", "_from", "_to", "_mean"), "chains")
    largest = todo.agg(F.max("n")).first()[0] or 0
    if not largest:
        return found[0]
    types = dict(draws.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in by) + ", n long, iact double, open boolean, whole boolean"

    def centred(dense: bool) -> DataFrame:
        if dense:
            return _beside(draws.select(*by, "iter", "value"), todo, by).select("_chain", (F.col("iter") - F.col("_from")).cast("long").alias("pos"), (value - F.col("_mean")).alias("d"))
        placed = running_sums(draws.select(*by, "iter", "value"), by, [F.col("iter")], {"pos": F.lit(1).cast("long")})
        return written(_beside(placed, todo, by).select("_chain", (F.col("pos") - 1).alias("pos"), (value - F.col("_mean")).alias("d")), "centred")

    def judge(frames):
        for frame in frames:
            out = [_stopped(c, int(n)) if w else None for c, n, w in zip(frame["c"], frame["n"], frame["whole"], strict=True)]
            frame["iact"], frame["open"] = [x for x in out], [x is None for x in out]
            yield frame[[*by, "n", "iact", "open", "whole"]]

    whole_number = types["iter"] in ("tinyint", "smallint", "int", "bigint")
    dense = whole_number and todo.where("_from is null or _to - _from + 1 <> n").isEmpty()
    left = centred(dense)
    while True:
        # short chains are one chunk and have all their lags at once
        lags = min(lags, max(1, largest - 1)) if largest > chunk else max(1, largest - 1)
        chunk = max(chunk, lags)
        sums = lag_sums(left, ["_chain"], lags, chunk).join(todo.select("_chain", *by, "n"), "_chain")
        judged = written(sums.mapInPandas(judge, schema), "judged")
        if dense and not judged.where("not whole").isEmpty():  # an iteration is there twice
            dense, left = False, centred(False)
            continue
        found.append(judged.where("not open").select(*by, "n", "iact"))
        again = judged.where("open")
        if again.isEmpty():
            break
        todo = _beside(todo, again.select(*by), by)
        left = left.join(todo.select("_chain"), "_chain")
        lags *= MORE_LAGS
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.withColumn("iact", F.nanvl("iact", F.lit(None).cast("double")))


def iact(draws: DataFrame, by: list[str], method: str = "sokal") -> DataFrame:
    """by, n and the integrated autocorrelation time of ``value``: ``sokal`` (merged over chunks) or ``geyer`` (a chain in a task); null for constant or non-finite draws."""
    if method == "sokal":
        return merged_iact(draws, by)
    found = per_chain(draws, by, lambda x: (len(x), geyer_time(x)), "n long, iact double")
    return found.withColumn("iact", F.nanvl("iact", F.lit(None).cast("double")))


def effective_size(draws: DataFrame, by: list[str], method: str = "sokal") -> DataFrame:
    """asymptotic variance and effective size of the weighted mean: z = w (x - mean), var(z) iact(z) / mean(w)^2 / n."""
    means = written(draws.groupBy(*by).agg((F.sum(F.col("weight") * F.col("value")) / F.sum("weight")).alias("_centre")), "means")
    z = _beside(draws, means, by).withColumn("d", F.col("value") - F.col("_centre")).withColumn("z", F.col("weight") * F.col("d"))
    spread = F.sum(F.col("weight") * F.col("d") * F.col("d")) / F.sum("weight")
    moments = z.groupBy(*by).agg(F.var_samp("z").alias("vz"), F.avg("weight").alias("w"), spread.alias("v"))
    times = iact(z.select(*by, "iter", F.col("z").alias("value")), by, method)
    joined = moments.join(times, by)
    var = F.col("vz") * F.col("iact") / (F.col("w") * F.col("w")) / F.col("n")
    return joined.select(*by, var.alias("asymptotic_var"), F.try_divide(F.col("v"), var).alias("ess"))


def full_summary(draws: DataFrame, by: list[str], probs: tuple[float, ...] = (0.025, 0.975), method: str = "sokal") -> DataFrame:
    """Weighted mean, sd and quantiles with the standard error and effective size of the mean (``se``, ``ess``), and those of the
    weights alone (``se_is``, ``ess_is``). The draws of one of ``by`` are one chain."""
    w, x = F.col("weight"), F.col("value")
    sizes = effective_size(draws, by, method).select(*by, F.sqrt("asymptotic_var").alias("se"), "ess")
    weighted = weighted_summary(draws, by, probs)
    gap = x - F.col("mean")
    alone = draws.join(weighted.select(*by, "mean"), by).groupBy(*by).agg(
        (F.sqrt(F.sum(w * w * gap * gap)) / F.sum(w)).alias("se_is"), (F.sum(w) * F.sum(w) / F.sum(w * w)).alias("ess_is")
    )
    return weighted.join(sizes, by).join(alone, by)


#: Iterations of a range when the middle of a chain is looked for.
RANGE = 65_536


def rhat(draws: DataFrame, by: list[str]) -> DataFrame:
    """Split R-hat over chains: each chain is halved; between-half and within-half variances of ``value``.

    Moments of ranges of iterations add up; only the range with a chain's middle is split by rank, so no task holds a chain.
    ``iter`` counts draws of a chain: it doesn't repeat within one.
    """
    keys = [*by, "chain_id"]
    ranged = draws.withColumn("_range", F.floor(F.col("iter") / RANGE))
    moments = [F.count("*").alias("_rows"), F.count("value").alias("_n"), F.avg("value").alias("_m"), (F.var_pop("value") * F.count("value")).alias("_q")]
    parts = written(ranged.groupBy(*keys, "_range").agg(*moments), "ranges")
    along = Window.partitionBy(*keys)  # a row for each range
    parts = parts.withColumns({"_upto": F.sum("_rows").over(along.orderBy("_range")), "_first": F.ceil(F.sum("_rows").over(along) / 2)})
    cut = (F.col("_upto") > F.col("_first")) & (F.col("_upto") - F.col("_rows") < F.col("_first"))
    whole = parts.where(~cut).withColumn("half", F.when(F.col("_upto") <= F.col("_first"), 1).otherwise(2))
    middle = _beside(ranged, parts.where(cut).select(*keys, F.col("_range"), (F.col("_first") - F.col("_upto") + F.col("_rows")).alias("_own")), [*keys, "_range"])
    ranked = middle.withColumn("half", F.when(F.row_number().over(Window.partitionBy(*keys, "_range").orderBy("iter")) <= F.col("_own"), 1).otherwise(2))
    names = [*keys, "half", "_rows", "_n", "_m", "_q"]
    pieces = written(whole.select(*names).unionByName(ranked.groupBy(*keys, "half").agg(*moments).select(*names)), "halves")
    means = pieces.groupBy(*keys, "half").agg((F.sum(F.col("_n") * F.col("_m")) / F.sum(F.when(F.col("_n") > 0, F.col("_n")))).alias("m"), F.sum("_rows").alias("n"), F.sum("_n").alias("_k"))
    gap = F.col("_m") - F.col("m")
    halves = _beside(pieces, means, [*keys, "half"]).groupBy(*keys, "half").agg(
        F.first("m").alias("m"), F.first("n").alias("n"), F.when(F.first("_k") > 1, F.sum(F.col("_q") + F.col("_n") * gap * gap) / (F.first("_k") - 1)).alias("v")
    )
    pooled = halves.groupBy(*by).agg(F.avg("v").alias("w"), F.var_samp("m").alias("b"), F.avg("n").alias("n"))
    return pooled.select(*by, F.sqrt(F.try_divide((F.col("n") - 1) / F.col("n") * F.col("w") + F.col("b"), F.col("w"))).alias("rhat"))


def rank_normal(draws: DataFrame, by: list[str]) -> DataFrame:
    """``value`` replaced by normal scores of its ranks over all chains: (r - 3/8) / (n + 1/4)."""
    every = Window.partitionBy(*by)
    r = F.rank().over(every.orderBy("value")) + (F.count("*").over(Window.partitionBy(*by, "value")) - 1) / 2
    return draws.withColumn("p", (r - 0.375) / (F.count("*").over(every) + 0.25)).withColumn("value", normal_quantile(F.col("p"))).drop("p")


# Acklam's rational approximation of the inverse normal distribution (relative error under 1.2e-9).
CENTRE = ((-3.969683028665376e1, 2.209460984245205e2, -2.759285104469687e2, 1.383577518672690e2, -3.066479806614716e1, 2.506628277459239),
          (-5.447609879822406e1, 1.615858368580409e2, -1.556989798598866e2, 6.680131188771972e1, -1.328068155288572e1, 1.0))
TAIL = ((-7.784894002430293e-3, -3.223964580411365e-1, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783),
        (7.784695709041462e-3, 3.224671290700398e-1, 2.445134137142996, 3.754408661907416, 1.0))
TAIL_BELOW = 0.02425


def _horner(coefficients: tuple[float, ...], x: Column) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out


def normal_quantile(p: Column) -> Column:
    """Inverse normal distribution."""
    q = p - 0.5
    t = F.sqrt(-2.0 * F.log(F.least(p, 1 - p)))
    centre, tail = (_horner(num, v) / _horner(den, v) for (num, den), v in ((CENTRE, q * q), (TAIL, t)))
    return F.when(F.least(p, 1 - p) >= TAIL_BELOW, q * centre).otherwise(F.when(p < 0.5, tail).otherwise(-tail))


def diagnostics(draws: DataFrame, by: list[str]) -> DataFrame:
    """For each of ``by``: draws that aren't finite, R-hat of ranks, bulk size (of normal scores) and tail size (the lesser of
    both 5 % tails'), summed over chains."""
    broken = draws.groupBy(*by).agg(F.sum((F.col("value").isNull() | F.isnan("value") | (F.abs("value") == float("inf"))).cast("long")).alias("not_finite"))
    scores = rank_normal(draws, by)
    keys = [*by, "chain_id"]
    every = Window.partitionBy(*by)
    tails = draws.withColumns({"low": F.percentile("value", F.lit(0.05)).over(every), "high": F.percentile("value", F.lit(0.95)).over(every)})

    def size(d: DataFrame, name: str) -> DataFrame:
        return iact(d.select(*keys, "iter", "value"), keys).groupBy(*by).agg(F.sum(F.col("n") / F.greatest("iact", F.lit(1e-9))).alias(name))

    low = size(tails.withColumn("value", (F.col("value") <= F.col("low")).cast("double")), "low_size")
    high = size(tails.withColumn("value", (F.col("value") >= F.col("high")).cast("double")), "high_size")
    out = broken.join(rhat(scores, by), by, "left").join(size(scores, "bulk_size"), by, "left").join(low, by, "left").join(high, by, "left")
    return out.select(*by, "not_finite", "rhat", "bulk_size", F.least("low_size", "high_size").alias("tail_size"))


def diagnostics_worst(found: DataFrame, chain: DataFrame) -> DataFrame:
    """One row per series: acceptance (least and most of its chains), draws that aren't finite, the largest R-hat and the smallest sizes, with their variables."""
    rates = acceptance(chain).groupBy("series_id").agg(F.min("acceptance").alias("least_acceptance"), F.max("acceptance").alias("most_acceptance"))
    worst = found.groupBy("series_id").agg(
        F.sum("not_finite").alias("not_finite"), F.max("rhat").alias("worst_rhat"), F.max_by("variable", "rhat").alias("rhat_variable"),
        F.min("bulk_size").alias("least_bulk"), F.min_by("variable", "bulk_size").alias("bulk_variable"),
        F.min("tail_size").alias("least_tail"), F.min_by("variable", "tail_size").alias("tail_variable"),
    )
    return rates.join(worst, "series_id")


def stratified(particles: DataFrame, by: list[str], uniform: Column) -> DataFrame:
    """Stratified resampling: stratum j of N takes the first particle whose cumulative share reaches (j - 1 + u) / N.

    ``particles`` has by, particle (from 1) and weight; ``uniform`` is a column of by and particle in (0, 1). Shares are running
    sums over all tasks, so a cloud may be larger than a task.
    """
    sums = {"upto": F.col("weight").cast("double"), "n": F.lit(1).cast("long")}
    shares = written(running_sums(particles, by, [F.col("particle")], sums, totals=True).withColumn("point", (F.col("particle") - 1 + uniform) / F.col("n_total")), "shares")
    total, n = F.col("upto_total"), F.col("n_total")
    high = F.when(F.col("particle") == n, 1.0).otherwise(F.col("upto") / total)
    # sums of neighbours in two ranges may differ by rounding: spans overlap a little, and the first that reaches a point takes it
    spans = shares.select(*by, "particle", n.alias("n"), ((F.col("upto") - F.col("weight")) / total - 1e-9).alias("low"), high.alias("high"))
    strata = shares.select(*by, F.col("particle").cast("long").alias("stratum"), "point")
    first, last = F.greatest(F.lit(1), F.floor(F.col("low") * F.col("n"))), F.least(F.col("n"), F.floor(F.col("high") * F.col("n")) + 2)
    spans = spans.where(first <= last).withColumn("stratum", F.explode(F.sequence(first.cast("long"), last.cast("long")))).drop("n")
    inside = (F.col("point") > F.col("low")) & (F.col("point") <= F.col("high"))
    return strata.join(spans, [*by, "stratum"]).where(inside).groupBy(*by, "stratum").agg(F.min("particle").alias("ancestor"))
