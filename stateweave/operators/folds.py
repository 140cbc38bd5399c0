"""Kalman filters and smoothers with one or two states as column folds over packed series: no Python in the plan.

The time order is filter, then predict: a, P at t are predictions from before t, and a series of n steps gives n + 1 of
them. A null y, or an innovation variance of 1e-12 or less, skips the update.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.series import packed

LOG_2PI = math.log(2 * math.pi)
TOLERANCE = 1e-12


def _lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


#: Steps of an inner fold. An array that grows is copied each step, so a series is folded in chunks: time is linear in its length.
CHUNK = 64


def fold_rows(steps: Column, start: dict[str, Column], kind: str, move, last=None) -> Column:
    """The rows that ``move(state, step)`` gives, as (new state, row), over an array ``steps``; ``last(state)`` may add one.

    ``start`` is the state, a struct by name; ``kind`` is the type of a row.
    """
    names = list(start)
    state = lambda x, out: F.struct(*(x[n].alias(n) for n in names), out.alias("out"))

    def inner(acc: Column, x: Column) -> Column:
        new, row = move(acc, x)
        return state(new, F.concat(acc["out"], F.array(row)))

    def outer(acc: Column, k: Column) -> Column:
        part = F.slice(steps, k * CHUNK + 1, CHUNK)
        return F.aggregate(part, state(acc, F.array().cast(f"array<{kind}>")), inner, lambda done: state(done, F.concat(acc["out"], F.array(done["out"]))))

    def end(acc: Column) -> Column:
        rows = F.flatten(acc["out"])
        return rows if last is None else F.concat(rows, F.array(last(acc)))

    chunks = F.when(F.size(steps) > 0, F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / CHUNK).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(chunks, state(start, F.array().cast(f"array<array<{kind}>>")), outer, end)


def walk(start: Column, steps: Column, move) -> Column:
    """start, and ``move(x, step)`` after each of ``steps``, as an array of doubles."""

    def step(acc: Column, k: Column) -> tuple[dict[str, Column], Column]:
        x = move(acc["x"], k)
        return {"x": x}, x

    # bound once: the fold mentions its steps and start several times
    rows = lambda b: F.concat(F.array(b["start"]), fold_rows(b["steps"], {"x": b["start"]}, "double", step))
    return F.transform(F.array(F.struct(start.alias("start"), steps.alias("steps"))), rows)[0]


def scalar_filter(series: DataFrame, a1=0.0, p1=1.0, transition=1.0, sd_state=1.0, sd_y=1.0, constant=0.0) -> DataFrame:
    """One-state filter: y = alpha + noise, alpha' = constant + transition * alpha + noise.

    Returns series_id, t, y, a, p, att, ptt, v, f and loglik (up to t). Row n + 1 has only the prediction.
    """
    tr, q, h, c = _lit(transition), _lit(sd_state) * _lit(sd_state), _lit(sd_y) * _lit(sd_y), _lit(constant)
    step = "struct<t:int,y:double,a:double,p:double,att:double,ptt:double,v:double,f:double,loglik:double>"
    start = {"a": _lit(a1), "p": _lit(p1), "loglik": F.lit(0.0), "t": F.lit(0)}

    def move(acc: Column, x: Column) -> tuple[dict[str, Column], Column]:
        f = acc["p"] + h
        used = x["y"].isNotNull() & (f > TOLERANCE)
        v = F.when(used, x["y"] - acc["a"])
        k = F.when(used, acc["p"] / f).otherwise(0.0)
        att = acc["a"] + k * F.coalesce(v, F.lit(0.0))
        ptt = (1.0 - k) * acc["p"] * (1.0 - k) + k * h * k
        loglik = acc["loglik"] - F.when(used, 0.5 * (LOG_2PI + F.log(f) + v * v / f)).otherwise(0.0)
        row = F.struct(
            x["t"].alias("t"), x["y"].alias("y"), acc["a"].alias("a"), acc["p"].alias("p"), att.alias("att"), ptt.alias("ptt"), v.alias("v"),
            F.when(used, f).alias("f"), loglik.alias("loglik"),
        )
        return {"a": c + tr * att, "p": tr * ptt * tr + q, "loglik": loglik, "t": acc["t"] + 1}, row

    last = lambda acc: F.struct(
        (acc["t"] + 1).alias("t"), F.lit(None).cast("double").alias("y"), acc["a"].alias("a"), acc["p"].alias("p"), *(F.lit(None).cast("double").alias(x) for x in ("att", "ptt", "v", "f")),
        acc["loglik"].alias("loglik"),
    )
    return packed(series).select("series_id", fold_rows(F.col("steps"), start, step, move, last).alias("rows")).select("series_id", F.inline("rows"))


def scalar_loglik(series: DataFrame, a1=0.0, p1=1.0, transition=1.0, sd_state=1.0, sd_y=1.0, constant=0.0) -> DataFrame:
    """series_id and loglik: a fold that keeps three numbers."""
    tr, q, h, c = _lit(transition), _lit(sd_state) * _lit(sd_state), _lit(sd_y) * _lit(sd_y), _lit(constant)

    def move(acc: Column, x: Column) -> Column:
        f = acc["p"] + h
        used = x["y"].isNotNull() & (f > TOLERANCE)
        v = F.when(used, x["y"] - acc["a"]).otherwise(0.0)
        k = F.when(used, acc["p"] / f).otherwise(0.0)
        ptt = (1.0 - k) * acc["p"] * (1.0 - k) + k * h * k
        loglik = acc["loglik"] - F.when(used, 0.5 * (LOG_2PI + F.log(f) + v * v / f)).otherwise(0.0)
        return F.struct((c + tr * (acc["a"] + k * v)).alias("a"), (tr * ptt * tr + q).alias("p"), loglik.alias("loglik"))

    start = F.struct(_lit(a1).alias("a"), _lit(p1).alias("p"), F.lit(0.0).alias("loglik"))
    return packed(series).select("series_id", F.aggregate("steps", start, move, lambda acc: acc["loglik"]).alias("loglik"))


def scalar_smoother(series: DataFrame, transition=1.0, **model) -> DataFrame:
    """Smoothed means and variances of the one-state model: a second fold, backwards over the filter's rows."""
    tr = _lit(transition)
    rows = scalar_filter(series, transition=transition, **model)
    back = rows.where("att is not null").groupBy("series_id").agg(F.reverse(F.array_sort(F.collect_list(F.struct("t", "a", "p", "v", "f")))).alias("steps"))
    step = "struct<t:int,alphahat:double,vt:double>"
    start = {"r": F.lit(0.0), "n": F.lit(0.0)}

    def move(acc: Column, x: Column) -> tuple[dict[str, Column], Column]:
        used = x["f"].isNotNull()
        k = F.when(used, x["p"] / x["f"]).otherwise(0.0)
        carry = tr * (1.0 - k)
        r = F.when(used, x["v"] / x["f"]).otherwise(0.0) + carry * acc["r"]
        n = F.when(used, 1.0 / x["f"]).otherwise(0.0) + carry * acc["n"] * carry
        row = F.struct(x["t"].alias("t"), (x["a"] + x["p"] * r).alias("alphahat"), (x["p"] - x["p"] * n * x["p"]).alias("vt"))
        return {"r": r, "n": n}, row

    return back.select("series_id", fold_rows(F.col("steps"), start, step, move).alias("rows")).select("series_id", F.inline("rows"))


def trend_filter(series: DataFrame, p1=100.0, sd_level=1.0, sd_slope=1.0, sd_y=1.0) -> DataFrame:
    """Local linear trend: level and slope predictions (a1, a2, p11, p12, p22) and loglik for t from 1 to n + 1."""
    ql, qs, h = (_lit(x) * _lit(x) for x in (sd_level, sd_slope, sd_y))
    step = "struct<t:int,a1:double,a2:double,p11:double,p12:double,p22:double,loglik:double>"
    names = ("a1", "a2", "p11", "p12", "p22", "loglik")
    zero = {"a1": 0.0, "a2": 0.0, "p11": p1, "p12": 0.0, "p22": p1, "loglik": 0.0}
    start = {x: _lit(zero[x]) for x in names} | {"t": F.lit(0)}

    def move(acc: Column, x: Column) -> tuple[dict[str, Column], Column]:
        f = acc["p11"] + h
        used = x["y"].isNotNull() & (f > TOLERANCE)
        v = F.when(used, x["y"] - acc["a1"]).otherwise(0.0)
        k1, k2 = (F.when(used, acc[p] / f).otherwise(0.0) for p in ("p11", "p12"))
        m1, m2 = acc["a1"] + k1 * v, acc["a2"] + k2 * v
        # (I - KZ') P (I - KZ')' + K h K'
        g = 1.0 - k1
        c11 = g * acc["p11"] * g + k1 * h * k1
        c12 = g * (acc["p12"] - k2 * acc["p11"]) + k1 * h * k2
        c22 = acc["p22"] - 2.0 * k2 * acc["p12"] + k2 * acc["p11"] * k2 + k2 * h * k2
        row = F.struct(x["t"].alias("t"), *(acc[n].alias(n) for n in names[:-1]), acc["loglik"].alias("loglik"))
        new = {
            "a1": m1 + m2, "a2": m2, "p11": c11 + 2.0 * c12 + c22 + ql, "p12": c12 + c22, "p22": c22 + qs,
            "loglik": acc["loglik"] - F.when(used, 0.5 * (LOG_2PI + F.log(f) + v * v / f)).otherwise(0.0), "t": acc["t"] + 1,
        }
        return new, row

    last = lambda acc: F.struct((acc["t"] + 1).alias("t"), *(acc[n].alias(n) for n in names))
    return packed(series).select("series_id", fold_rows(F.col("steps"), start, step, move, last).alias("rows")).select("series_id", F.inline("rows"))
