"""The engine's queries over the given tables, and the SQL that gives the same rows.

Doubles are rounded on both sides; a query without SQL draws random numbers or iterates.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import densities, priors, random, tables
from ..operators import folds, inference, models, nonlinear, posterior, scan
from ..sources import series as src

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, without negative zeros."""
    return df.select(*((F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


# --- series ---

DAILY = """
    calendar as (select t::int as t, (a + (t - 1) * interval 1 day)::timestamp as ts
        from (select min(date_trunc('day', ts)) a, max(date_trunc('day', ts)) b from events), unnest(generate_series(1, date_diff('day', a, b) + 1)) g(t)),
    counted as (select event_type as series_id, date_trunc('day', ts)::timestamp as ts, count(*)::double as y from events group by 1, 2),
    daily as (select s.series_id, c.t, c.ts, d.y from (select distinct series_id from counted) s cross join calendar c left join counted d on d.series_id = s.series_id and d.ts = c.ts)
"""
MONTHLY = """
    bounds as (select date_trunc('month', min(o_orderdate)) a, date_trunc('month', max(o_orderdate)) b from orders),
    calendar as (select t::int as t, (a + (t - 1) * interval 1 month)::timestamp as ts from bounds, unnest(generate_series(1, date_diff('month', a, b) + 1)) g(t)),
    summed as (select o_orderpriority as series_id, date_trunc('month', o_orderdate)::timestamp as ts, sum(o_totalprice) / 1e5 as y from orders group by 1, 2),
    monthly as (select s.series_id, c.t, d.y from (select distinct series_id from summed) s cross join calendar c left join summed d on d.series_id = s.series_id and d.ts = c.ts)
"""


@query(f"with {DAILY} select series_id, t, strftime(ts, '%Y-%m-%d') as day, y from daily")
def series_daily(spark, sf_dir):
    return src.daily_counts(spark, sf_dir).select("series_id", "t", F.date_format("ts", "yyyy-MM-dd").alias("day"), "y")


@query("""
    with calendar as (select t::int as t, (a + (t - 1) * interval 1 day)::timestamp as ts
        from (select min(date_trunc('day', ts)) a, max(date_trunc('day', ts)) b from events), unnest(generate_series(1, date_diff('day', a, b) + 1)) g(t)),
    m as (select user_id::varchar as series_id, date_trunc('day', ts)::timestamp as ts, avg(value) as y from events group by 1, 2)
    select s.series_id, c.t, strftime(c.ts, '%Y-%m-%d') as day, round(m.y, 6) + 0.0 as y from (select distinct series_id from m) s cross join calendar c left join m on m.series_id = s.series_id and m.ts = c.ts
""")
def series_densify(spark, sf_dir):
    return rounded(src.daily_user_means(spark, sf_dir).select("series_id", "t", F.date_format("ts", "yyyy-MM-dd").alias("day"), "y"))


@query(f"with {MONTHLY} select series_id, t, round(y, 6) + 0.0 as y from monthly")
def series_monthly(spark, sf_dir):
    return rounded(src.monthly_orders(spark, sf_dir).drop("ts"))


@query("""
    with m as (select user_id::varchar as series_id, day(ts)::int as t, value as y from events),
    c as (select series_id, t, count(*) as n, count(*) filter (where y < 0) as negative, count(*) filter (where y <> floor(y)) as fractional from m group by 1, 2),
    f as (select series_id, sum(negative) as negative, sum(fractional) as fractional, sum(n - 1) as repeated, max(t) - count(*) as missing, (count(*) < 2)::int as short from c group by 1)
    select series_id, problem, rows::bigint as rows from (unpivot f on negative, fractional, repeated, missing, short into name problem value rows) where rows > 0
""")
def series_problems(spark, sf_dir):
    events = src.table(spark, sf_dir, "events")
    return src.problems(events.select(F.col("user_id").cast("string").alias("series_id"), F.dayofmonth("ts").alias("t"), F.col("value").alias("y")), "poisson")


# --- densities: y is a daily count, u its trials or exposure, s a signal near its logarithm ---

CELLS = f"{DAILY}, cells as (select series_id, t, y, y + 5 + t % 7 as u, ln(y + 1) - 0.3 + 0.01 * t as s from daily)"


def _cells(spark, sf_dir) -> DataFrame:
    d = src.daily_counts(spark, sf_dir)
    return d.select("series_id", "t", "y", (F.col("y") + 5 + F.col("t") % 7).alias("u"), (F.log(F.col("y") + 1) - 0.3 + 0.01 * F.col("t")).alias("s"))


# name: (argument scale: SQL for the exposure and signal), kernel, constant, pseudo-observation, pseudo-variance, starting mode
FORMULAS = {
    "svm": ("1.0", "ln(2.0) + 0.01 * t", "-0.5 * (s + pow(y / 2.0, 2) * exp(-s))", "-0.5 * ln(2 * pi()) - ln(2.0)", "s + 1 - 0.5 * h", "2 * exp(s) / pow(greatest(abs(y), 1e-4) / 2.0, 2)", "ln(greatest(1e-4, y * y))"),
    "poisson": ("1.5", "s", "y * s - u * exp(s)", "y * ln(u) - lgamma(y + 1)", "y * h + s - 1", "1 / (u * exp(s))", "ln(greatest(y / u, 0.1))"),
    "binomial": ("u", "s - ln(u)", "y * s - u * ln(1 + exp(s))", "lgamma(u + 1) - lgamma(y + 1) - lgamma(u - y + 1)", "y * h + s - 1 - exp(s)", "pow(1 + exp(s), 2) / (u * exp(s))", "ln(((y + 0.5) / (u + 1)) / (1 - (y + 0.5) / (u + 1)))"),
    "negative binomial": ("1.5", "s", "y * s - (y + 2.0) * ln(2.0 + u * exp(s))", "lgamma(y + 2.0) - lgamma(y + 1) - lgamma(2.0) + 2.0 * ln(2.0) + y * ln(u)", "s + (2.0 + u * exp(s)) * (y - u * exp(s)) / ((y + 2.0) * u * exp(s))", "pow(2.0 + u * exp(s), 2) / (2.0 * u * exp(s) * (y + 2.0))", "ln(greatest(y / u, 1.0 / 6.0))"),
    "gamma": ("1.5", "s", "-2.0 * (s + y * exp(-s) / u)", "2.0 * ln(2.0) - lgamma(2.0) + (2.0 - 1) * ln(y) - 2.0 * ln(u)", "s - u * exp(s) / y + 1", "u * exp(s) / (y * 2.0)", "ln(greatest(y / u, 1))"),
    "gaussian": ("1.0", "y - 0.5", "-0.5 * pow((y - s) / 2.0, 2)", "-0.5 * ln(2 * pi()) - ln(2.0)", "y", "4.0", "y"),
}
SIGNALS = {"svm": lambda c: F.log(F.lit(2.0)) + 0.01 * F.col("t"), "binomial": lambda c: F.col("s") - F.log("u"), "gaussian": lambda c: F.col("y") - 0.5}


def _density_query(dist: str):
    exposure, signal, kernel, const, pseudo, variance, mode = FORMULAS[dist]

    def run(spark, sf_dir):
        cells = _cells(spark, sf_dir).where("y > 0")
        cells = cells.withColumn("u", F.col("u") if exposure == "u" else F.lit(float(exposure))).withColumn("s", SIGNALS.get(dist, lambda c: F.col("s"))(None))
        y, s, u = F.col("y"), F.col("s"), F.col("u")
        py, ph = densities.laplace_step(dist, y, s, u, 2.0)
        return rounded(cells.select(
            "series_id", "t", densities.obs_kernel(dist, y, s, u, 2.0).alias("kernel"), densities.obs_const(dist, y, u, 2.0).alias("const"),
            py.alias("pseudo_y"), ph.alias("pseudo_h"), densities.init_mode(dist, y, u).alias("mode"),
        ))

    run.__name__ = "density_" + dist.replace(" ", "_")
    r = lambda x, name: f"round({x}, 6) + 0.0 as {name}"
    return query(f"""
        with {CELLS}, args as (select series_id, t, y, {signal} as s, ({exposure})::double as u from cells where y > 0), pseudo as (select *, {variance} as h from args)
        select series_id, t, {r(kernel, 'kernel')}, {r(const, 'const')}, {r(pseudo, 'pseudo_y')}, {r('h::double', 'pseudo_h')}, {r(mode, 'mode')} from pseudo
    """)(run)


for _dist in FORMULAS:
    _density_query(_dist)

PRIORS = {
    "uniform": (priors.uniform(0.05, 0.02, 0.08), "case when x < 0.02 or x > 0.08 then null else 0.0 end"),
    "halfnormal": (priors.halfnormal(0.1, 0.5), "-0.5 * pow(x / 0.5, 2)"),
    "normal": (priors.normal(0.1, 0.03, 0.1), "-0.5 * pow((x - 0.03) / 0.1, 2)"),
    "tnormal": (priors.tnormal(0.05, 0.03, 0.1, 0.01, 0.07), "case when x < 0.01 or x > 0.07 then null else -0.5 * pow((x - 0.03) / 0.1, 2) end"),
    "gamma": (priors.gamma(0.1, 2.0, 3.0), "case when x <= 0 then null else (2.0 - 1) * ln(x) - 3.0 * x end"),
}


@query("with p as (select l_discount as x, count(*) as n from lineitem group by 1) select round(x, 6) + 0.0 as x, n, " + ", ".join(f"round({s}, 6) + 0.0 as {k}" for k, (_, s) in PRIORS.items()) + " from p")
def log_priors(spark, sf_dir):
    p = src.table(spark, sf_dir, "lineitem").groupBy(F.col("l_discount").alias("x")).agg(F.count("*").alias("n"))
    finite = lambda c: F.when(c > float("-inf"), c)
    return rounded(p.select("x", "n", *(finite(densities.log_prior(prior, F.col("x"))).alias(k) for k, (prior, _) in PRIORS.items())))


# --- filters and smoothers as folds ---

LEVEL = {"a1": 50.0, "p1": 400.0, "sd_state": 3.0, "sd_y": 8.0}
LEVEL_SQL = """
    {source},
    f as (
        select series_id, t, y, 50.0::double as a, 400.0::double as p, 0.0::double as ll from {name} where t = 1
        union all
        select n.series_id, n.t, n.y,
            case when f.y is null then f.a else f.a + f.p / (f.p + 64.0) * (f.y - f.a) end,
            case when f.y is null then f.p else f.p * 64.0 / (f.p + 64.0) end + 9.0,
            case when f.y is null then f.ll else f.ll - 0.5 * (ln(2 * pi()) + ln(f.p + 64.0) + pow(f.y - f.a, 2) / (f.p + 64.0)) end
        from f join {name} n on n.series_id = f.series_id and n.t = f.t + 1
    )
"""
LEVEL_DAILY = LEVEL_SQL.format(source=DAILY, name="daily")


@query(f"""
    with recursive {LEVEL_DAILY} select series_id, t, round(a, 6) + 0.0 as a, round(p, 6) + 0.0 as p,
        round(case when y is null then a else a + p / (p + 64.0) * (y - a) end, 6) + 0.0 as att, round(case when y is null then p else p * 64.0 / (p + 64.0) end, 6) + 0.0 as ptt from f
""")
def kalman_local_level(spark, sf_dir):
    rows = folds.scalar_filter(src.daily_counts(spark, sf_dir), **LEVEL).where("att is not null")
    return rounded(rows.select("series_id", "t", "a", "p", "att", "ptt"))


GAPS = DAILY.replace("d.y from", "case when c.t % 5 = 0 then null else d.y end as y from")


@query(f"""
    with recursive {LEVEL_SQL.format(source=GAPS, name="daily")}
    select series_id, round(case when y is null then ll else ll - 0.5 * (ln(2 * pi()) + ln(p + 64.0) + pow(y - a, 2) / (p + 64.0)) end, 6) + 0.0 as loglik
    from f where t = (select max(t) from daily)
""")
def kalman_loglik_missing(spark, sf_dir):
    series = src.daily_counts(spark, sf_dir).withColumn("y", F.when(F.col("t") % 5 != 0, F.col("y")))
    return rounded(folds.scalar_loglik(series, **LEVEL))


@query(f"""
    with recursive {LEVEL_DAILY},
    b as (
        select series_id, t, case when y is null then 0.0 else (y - a) / (p + 64.0) end as r, case when y is null then 0.0 else 1 / (p + 64.0) end as n, a, p from f where t = (select max(t) from daily)
        union all
        select f.series_id, f.t,
            case when f.y is null then b.r else (f.y - f.a) / (f.p + 64.0) + 64.0 / (f.p + 64.0) * b.r end,
            case when f.y is null then b.n else 1 / (f.p + 64.0) + pow(64.0 / (f.p + 64.0), 2) * b.n end, f.a, f.p
        from b join f on f.series_id = b.series_id and f.t = b.t - 1
    )
    select series_id, t, round(a + p * r, 6) + 0.0 as alphahat, round(p - p * n * p, 6) + 0.0 as vt from b
""")
def smoother_local_level(spark, sf_dir):
    return rounded(folds.scalar_smoother(src.daily_counts(spark, sf_dir), **LEVEL))


@query(f"""
    with recursive {MONTHLY},
    f as (
        select series_id, t, y, 10.0::double as a, 100.0::double as p, 0.0::double as ll from monthly where t = 1
        union all
        select n.series_id, n.t, n.y,
            2.0 + 0.8 * (case when f.y is null then f.a else f.a + f.p / (f.p + 4.0) * (f.y - f.a) end),
            0.64 * (case when f.y is null then f.p else f.p * 4.0 / (f.p + 4.0) end) + 1.0,
            case when f.y is null then f.ll else f.ll - 0.5 * (ln(2 * pi()) + ln(f.p + 4.0) + pow(f.y - f.a, 2) / (f.p + 4.0)) end
        from f join monthly n on n.series_id = f.series_id and n.t = f.t + 1
    )
    select series_id, t, round(a, 6) + 0.0 as a, round(p, 6) + 0.0 as p from f
""")
def kalman_ar1(spark, sf_dir):
    rows = folds.scalar_filter(src.monthly_orders(spark, sf_dir), a1=10.0, p1=100.0, transition=0.8, sd_state=1.0, sd_y=2.0, constant=2.0)
    n = Window.partitionBy("series_id")
    return rounded(rows.withColumn("last", F.max("t").over(n)).where("t < last").select("series_id", "t", "a", "p"))


@query(f"""
    with recursive {DAILY},
    f as (
        select series_id, t, y, 0.0::double a1, 0.0::double a2, 1000.0::double p11, 0.0::double p12, 1000.0::double p22, 0.0::double ll from daily where t = 1
        union all
        select series_id, t, y, m1 + m2, m2, c11 + 2 * c12 + c22 + 1.0, c12 + c22, c22 + 0.01, ll from (
            select n.series_id, n.t, n.y, f.a1 + f.p11 / (f.p11 + 64) * (f.y - f.a1) as m1, f.a2 + f.p12 / (f.p11 + 64) * (f.y - f.a1) as m2,
                f.p11 * 64 / (f.p11 + 64) as c11, f.p12 * 64 / (f.p11 + 64) as c12, f.p22 - f.p12 * f.p12 / (f.p11 + 64) as c22,
                f.ll - 0.5 * (ln(2 * pi()) + ln(f.p11 + 64) + pow(f.y - f.a1, 2) / (f.p11 + 64)) as ll
            from f join daily n on n.series_id = f.series_id and n.t = f.t + 1) x
    )
    select series_id, t, round(a1, 5) + 0.0 as a1, round(a2, 5) + 0.0 as a2, round(p11, 5) + 0.0 as p11, round(p12, 5) + 0.0 as p12, round(p22, 5) + 0.0 as p22, round(ll, 5) + 0.0 as loglik from f
""")
def kalman_trend(spark, sf_dir):
    rows = folds.trend_filter(src.daily_counts(spark, sf_dir), p1=1000.0, sd_level=1.0, sd_slope=0.1, sd_y=8.0)
    last = F.max("t").over(Window.partitionBy("series_id"))
    return rounded(rows.withColumn("last", last).where("t < last").drop("last"), 5)


# --- simulated paths by hash random numbers ---

NORMAL = "sqrt(-2 * ln((('0x' || substr(md5({key} || ':a'), 1, 13))::bigint + 0.5) / 4503599627370496.0)) * cos(2 * pi() * ((('0x' || substr(md5({key} || ':b'), 1, 13))::bigint + 0.5) / 4503599627370496.0))"


@query(f"""
    with recursive w as (
        select c_custkey as path, 0 as k, 1.0::double as x from customer
        union all
        select path, k + 1, x + 0.5 * (2.0 - x) * 0.0625 + 0.3 * x * db + 0.5 * 0.3 * x * 0.3 * (db * db - 0.0625)
        from (select path, k, x, sqrt(0.0625) * {NORMAL.format(key="(path::varchar || ':' || (k + 1)::varchar)")} as db from w where k < 16) z
    ) select path, k, round(x, 6) + 0.0 as x from w
""")
def milstein_path(spark, sf_dir):
    paths = inference.dealt(src.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("path")), "path")
    x = nonlinear.milstein_column(1.0, lambda x: 0.5 * (2.0 - x), lambda x: 0.3 * x, lambda x: F.lit(0.3), F.lit(16), 0.0625, F.col("path"))
    return rounded(paths.select("path", F.posexplode(x).alias("k", "x")))


@query(f"""
    with recursive w as (
        select c_custkey as path, 1 as t, 10 + 2.0 * {NORMAL.format(key="(c_custkey::varchar || ':first')")} as level from customer
        union all
        select path, t + 1, level + 0.5 * {NORMAL.format(key="(path::varchar || ':' || t::varchar)")} from w where t < 20
    ) select path, t, round(level, 6) + 0.0 as level from w
""")
def simulate_local_level(spark, sf_dir):
    paths = inference.dealt(src.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("path")), "path")
    start = F.array(10 + 2.0 * random.normal(F.col("path"), F.lit("first")))
    noise = F.transform(F.sequence(F.lit(1), F.lit(19)), lambda t: random.normal(F.col("path"), t))
    walk = folds.walk(start[0], noise, lambda x, e: x + 0.5 * e)
    return rounded(paths.select("path", F.posexplode(walk).alias("k", "level")).select("path", (F.col("k") + 1).alias("t"), "level"))


# --- posterior draws: orders as chains, their lines as blocks ---

#: Every column: lines that are alike in all may take any order.
LINE = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
LINE_ORDER = ", ".join(LINE)
CHAINS = f"""
    blocks as (select (l_suppkey % 7)::varchar as series_id, (l_suppkey % 3)::int as chain_id, row_number() over (partition by l_suppkey % 7, l_suppkey % 3 order by {LINE_ORDER}) as block,
        (1 + l_quantity::int % 4)::int as count, 1 - l_discount as weight, l_extendedprice as log_posterior, l_tax as theta_1, l_extendedprice / 1e4 as theta_2 from lineitem),
    firsts as (select *, 1 + coalesce(sum(count) over (partition by series_id, chain_id order by block rows between unbounded preceding and 1 preceding), 0) as first from blocks),
    pairs as (select series_id, chain_id, block, first, count, weight, 'theta_1' as variable, theta_1 as value from firsts union all select series_id, chain_id, block, first, count, weight, 'theta_2', theta_2 from firsts),
    draws as (select series_id, chain_id, (first + k)::bigint as iter, variable, value, weight from pairs, unnest(generate_series(0, count - 1)) g(k))
"""


def _lines(spark, sf_dir) -> DataFrame:
    line = src.table(spark, sf_dir, "lineitem").select(*LINE)
    return line.withColumns({"series_id": (F.col("l_suppkey") % 7).cast("string"), "chain_id": (F.col("l_suppkey") % 3).cast("int"), "count": 1 + F.col("l_quantity").cast("int") % 4})


def _blocks(lines: DataFrame, *more) -> DataFrame:
    return lines.select(
        "series_id", "chain_id", *more, "count", (1 - F.col("l_discount")).alias("weight"), F.col("l_extendedprice").alias("log_posterior"),
        F.array("l_tax", F.col("l_extendedprice") / 1e4).alias("theta"), F.array(F.lit("theta_1"), F.lit("theta_2")).alias("names"),
    )


def _ordered(spark, sf_dir) -> DataFrame:
    """Lines with their block and the iterations up to it. There are few chains, so both are running sums over all tasks and no window over a chain."""
    return scan.running_sums(_lines(spark, sf_dir), posterior.KEYS, [F.col(c) for c in LINE], {"block": F.lit(1).cast("long"), "upto": F.col("count").cast("long")})


def _chains(spark, sf_dir, reread: bool = False) -> DataFrame:
    """``reread``: written first, for work that reads the chains several times."""
    chains = _ordered(spark, sf_dir)
    return _blocks(scan.written(chains, "chains") if reread else chains, "block", "upto")


@query(f"with {CHAINS} select series_id, chain_id, iter, variable, round(value, 6) + 0.0 as value, round(weight, 6) + 0.0 as weight from draws")
def draws_expand(spark, sf_dir):
    return rounded(posterior.long_draws(_chains(spark, sf_dir)))


@query(f"with {CHAINS} select series_id, chain_id, first::bigint as iter, variable, round(value, 6) + 0.0 as value, round(count * weight, 6) + 0.0 as weight from pairs")
def draws_long(spark, sf_dir):
    return rounded(posterior.long_draws(_chains(spark, sf_dir), expand=False))


@query(f"with {CHAINS} select series_id, chain_id, first::bigint as iter, round(theta_1, 6) + 0.0 as theta_1, round(theta_2, 6) + 0.0 as theta_2 from firsts")
def draws_wide(spark, sf_dir):
    return rounded(posterior.wide_draws(posterior.long_draws(_chains(spark, sf_dir), expand=False), ["theta_1", "theta_2"]))


@query(f"with {CHAINS} select series_id, round(max(log_posterior), 6) + 0.0 as log_posterior from blocks group by 1")
def draws_best(spark, sf_dir):
    return rounded(posterior.best(_blocks(_lines(spark, sf_dir))).select("series_id", "log_posterior"))


@query(f"with {CHAINS} select series_id, chain_id, round((count(*) - 1) / greatest(sum(count) - 1, 1)::double, 6) + 0.0 as acceptance, sum(count)::bigint as iterations from blocks group by 1, 2")
def draws_acceptance(spark, sf_dir):
    return rounded(posterior.acceptance(_blocks(_lines(spark, sf_dir))))


@query(f"""
    with {CHAINS} select series_id, variable, round(avg(value), 6) + 0.0 as mean, round(stddev_samp(value), 6) + 0.0 as sd,
        round(quantile_cont(value, 0.025), 6) + 0.0 as q2_5, round(quantile_cont(value, 0.975), 6) + 0.0 as q97_5 from draws group by 1, 2
""")
def summary_theta(spark, sf_dir):
    return rounded(posterior.summary(posterior.long_draws(_chains(spark, sf_dir)), ["series_id", "variable"]))


@query(f"""
    with {CHAINS}, w as (select series_id, variable, value, count * weight as weight from pairs),
    m as (select series_id, variable, sum(weight) sw, sum(weight * value) / sum(weight) as mean from w group by 1, 2),
    c as (select w.*, m.mean, m.sw, sum(w.weight) over (partition by w.series_id, w.variable order by w.value range between unbounded preceding and current row) / m.sw as share from w join m using (series_id, variable))
    select series_id, variable, round(any_value(mean), 6) + 0.0 as mean, round(sqrt(sum(weight * pow(value - mean, 2)) / any_value(sw)), 6) + 0.0 as sd,
        round(min(case when share >= 0.025 - 1e-12 then value end), 6) + 0.0 as q2_5, round(min(case when share >= 0.975 - 1e-12 then value end), 6) + 0.0 as q97_5 from c group by 1, 2
""")
def summary_weighted(spark, sf_dir):
    return rounded(posterior.weighted_summary(posterior.long_draws(_chains(spark, sf_dir), expand=False), ["series_id", "variable"]))


#: Lags in the SQL; every chain of these meets its stopping rule before, else the SQL has null.
LAGS = 150
IACT = f"""
    {CHAINS}, v as (select series_id, chain_id, variable, iter, {{value}} as value from draws),
    d as (select *, value - avg(value) over (partition by series_id, chain_id, variable) as d, count(*) over (partition by series_id, chain_id, variable) as n from v),
    z as (select series_id, chain_id, variable, sum(d * d) / (count(*) - 1) as var from d group by 1, 2, 3),
    l as (select series_id, chain_id, variable, list(d order by iter) as x, count(*)::bigint as n from d group by 1, 2, 3),
    c as (select series_id, chain_id, variable, k, n, list_inner_product(x[1:n - k], x[1 + k:n]) / (n - k) as c from l, unnest(generate_series(1, {LAGS})) g(k) where k < n),
    s as (select series_id, chain_id, variable, k, n, 1 + 2 * sum(c / var) over (partition by series_id, chain_id, variable order by k rows between unbounded preceding and current row) as tau
        from c join z using (series_id, chain_id, variable)),
    i as (select series_id, chain_id, variable, any_value(n)::bigint as n, greatest(arg_min(tau, k) filter (where k > greatest(5.0, log10(n)) * tau), 0.0) as iact from s group by 1, 2, 3)
"""


@query(f"with {IACT.format(value='value')} select series_id, chain_id, variable, n, round(iact, 5) + 0.0 as iact from i")
def iact(spark, sf_dir):
    return rounded(posterior.iact(posterior.long_draws(_chains(spark, sf_dir, reread=True)), ["series_id", "chain_id", "variable"]), 5)


@query(f"""
    with {IACT.format(value='weight * (value - sum(weight * value) over (partition by series_id, chain_id, variable) / sum(weight) over (partition by series_id, chain_id, variable))')},
    e as (select draws.*, value - sum(weight * value) over w / sum(weight) over w as d from draws window w as (partition by series_id, chain_id, variable)),
    m as (select series_id, chain_id, variable, var_samp(weight * d) as vz, avg(weight) as w, sum(weight * d * d) / sum(weight) as v from e group by 1, 2, 3)
    select series_id, chain_id, variable, round(1e6 * vz * iact / (w * w) / n, 4) + 0.0 as asymptotic_var_ppm, round(v / (vz * iact / (w * w) / n), 4) + 0.0 as ess from m join i using (series_id, chain_id, variable)
""")
def effective_size(spark, sf_dir):
    e = posterior.effective_size(posterior.long_draws(_chains(spark, sf_dir, reread=True)), ["series_id", "chain_id", "variable"])
    return rounded(e.select("series_id", "chain_id", "variable", (1e6 * F.col("asymptotic_var")).alias("asymptotic_var_ppm"), "ess"), 4)


@query(f"""
    with {CHAINS}, h as (select *, ntile(2) over (partition by series_id, variable, chain_id order by iter) as half from draws),
    p as (select series_id, variable, chain_id, half, avg(value) m, var_samp(value) v, count(*) n from h group by 1, 2, 3, 4)
    select series_id, variable, round(sqrt(((avg(n) - 1) / avg(n) * avg(v) + var_samp(m)) / avg(v)), 6) + 0.0 as rhat from p group by 1, 2
""")
def split_rhat(spark, sf_dir):
    return rounded(posterior.rhat(posterior.long_draws(_chains(spark, sf_dir, reread=True)), ["series_id", "variable"]))


@query(f"""
    with recursive {LEVEL_DAILY} select series_id, t, round(case when y is null then a else a + p / (p + 64.0) * (y - a) end, 6) + 0.0 as att, round(case when y is null then p else p * 64.0 / (p + 64.0) end, 6) + 0.0 as ptt,
        round(case when y is null then ll else ll - 0.5 * (ln(2 * pi()) + ln(p + 64.0) + pow(y - a, 2) / (p + 64.0)) end, 6) + 0.0 as loglik from f
""")
def table_function_filter(spark, sf_dir):
    """The level filter as a table function in SQL, row by row."""
    tables.register(spark)
    src.daily_counts(spark, sf_dir).createOrReplaceTempView("sw_daily_counts")
    model = '{"sd_level": 3, "sd_y": 8, "a1": [50], "P1": [[400]]}'
    found = spark.sql(f"select series_id, t, att[0] as att, ptt[0] as ptt, loglik from state_filter(table(sw_daily_counts) partition by series_id order by t, model => '{model}')")
    return rounded(found)


STATES = f"select (l_suppkey % 7)::varchar as series_id, l_linenumber::int as t, 1 - l_discount as weight, l_tax as x0, l_quantity as x1, l_extendedprice / 1e4 as x2 from lineitem"


@query(f"""
    with v as ({STATES}), p as (select series_id, t, weight, unnest([{{'i': 0, 'j': 0, 'a': x0, 'b': x0}}, {{'i': 0, 'j': 1, 'a': x0, 'b': x1}}, {{'i': 0, 'j': 2, 'a': x0, 'b': x2}}, {{'i': 1, 'j': 1, 'a': x1, 'b': x1}},
        {{'i': 1, 'j': 2, 'a': x1, 'b': x2}}, {{'i': 2, 'j': 2, 'a': x2, 'b': x2}}]) as e from v),
    m as (select series_id, t, e.i as i, e.j as j, sum(weight) as w, sum(weight * e.a) / sum(weight) as ma, sum(weight * e.b) / sum(weight) as mb from p group by all)
    select series_id, t, i, j, round(any_value(ma), 6) + 0.0 as mean_i, round(any_value(mb), 6) + 0.0 as mean_j, round(sum(weight * (e.a - ma) * (e.b - mb)) / any_value(w), 5) + 0.0 as covariance
    from p join m on m.series_id = p.series_id and m.t = p.t and m.i = p.e.i and m.j = p.e.j group by 1, 2, 3, 4 order by 1, 2, 3, 4
""".replace("select series_id, t, i, j, round", "select p.series_id, p.t, m.i, m.j, round"))
def state_covariance(spark, sf_dir):
    """Weighted means and covariances of vectors of states at each time."""
    line = src.table(spark, sf_dir, "lineitem")
    rows = line.select((F.col("l_suppkey") % 7).cast("string").alias("series_id"), F.col("l_linenumber").cast("int").alias("t"), (1 - F.col("l_discount")).alias("weight"), F.array("l_tax", "l_quantity", F.col("l_extendedprice") / 1e4).alias("values"))
    found = posterior.matrix_moments(rows, ["series_id", "t"])
    return found.withColumns({"mean_i": F.round("mean_i", 6) + 0.0, "mean_j": F.round("mean_j", 6) + 0.0, "covariance": F.round("covariance", 5) + 0.0})


@query(f"""
    with {CHAINS}, b as (select series_id, variable, null::int as time, value from draws union all select (l_suppkey % 7)::varchar, 'level', l_linenumber::int, l_quantity from lineitem),
    g as (select series_id, variable, time, grouping(time) as level, count(*) as n, avg(value) as mean, stddev_samp(value) as sd, quantile_cont(value, 0.025) as lo, quantile_cont(value, 0.975) as hi
        from b group by grouping sets ((series_id, variable), (series_id, variable, time)))
    select series_id, variable, coalesce(time, 0) as time, n::bigint as n, round(mean, 6) + 0.0 as mean, round(sd, 6) + 0.0 as sd, round(lo, 6) + 0.0 as q2_5, round(hi, 6) + 0.0 as q97_5 from g where level > 0 or time is not null
""")
def summary_both(spark, sf_dir):
    """Parameters, and states at each and over all times (time 0), by grouping sets."""
    theta = posterior.long_draws(_chains(spark, sf_dir)).select("series_id", "variable", F.lit(None).cast("int").alias("time"), "value")
    line = src.table(spark, sf_dir, "lineitem")
    states = line.select((F.col("l_suppkey") % 7).cast("string").alias("series_id"), F.lit("level").alias("variable"), F.col("l_linenumber").cast("int").alias("time"), F.col("l_quantity").cast("double").alias("value"))
    return rounded(posterior.summary_both(theta.unionByName(states)).withColumn("time", F.coalesce("time", F.lit(0))))


@query(f"""
    with {CHAINS}, l as (select (l_suppkey % 7)::varchar as series_id, (l_suppkey % 3)::int as chain_id, row_number() over (partition by l_suppkey % 7, l_suppkey % 3 order by {LINE_ORDER}) as block, l_tax, l_discount, l_quantity, l_extendedprice from lineitem)
    select f.series_id, f.chain_id, f.first::bigint as iter, round(f.count * f.weight, 6) + 0.0 as weight, round(theta_1, 6) + 0.0 as theta_1, round(theta_2, 6) + 0.0 as theta_2,
        round(l_tax, 6) + 0.0 as "level[1]", round(l_quantity, 6) + 0.0 as "level[2]", null::double as "level[3]", round(l_discount, 6) + 0.0 as "slope[1]", round(l_extendedprice / 1e4, 6) + 0.0 as "slope[2]", null::double as "slope[3]"
    from firsts f join l using (series_id, chain_id, block)
""")
def draws_wide_states(spark, sf_dir):
    """Chosen states at chosen times as columns, picked from nested paths."""
    alpha = F.array(F.array("l_tax", "l_discount"), F.array("l_quantity", F.col("l_extendedprice") / 1e4)).alias("alpha")
    chain = _blocks(_ordered(spark, sf_dir), "block", "upto", alpha)
    return rounded(posterior.wide_states(chain, {"level": 0, "slope": 1}, [1, 2, 3]))


UNIFORM = "((('0x' || substr(md5({key}), 1, 13))::bigint + 0.5) / 4503599627370496.0)"


@query(f"""
    with p as (select (l_suppkey % 50) as cloud, row_number() over (partition by l_suppkey % 50 order by {LINE_ORDER}) as particle, l_quantity as weight from lineitem),
    s as (select cloud, particle, count(*) over (partition by cloud) as n, sum(weight) over (partition by cloud order by particle) / sum(weight) over (partition by cloud) as high from p),
    l as (select cloud, particle, n, coalesce(lag(high) over (partition by cloud order by particle), 0.0) as low, case when particle = n then 1.0 else high end as high from s),
    q as (select cloud, particle as stratum, (particle - 1 + {UNIFORM.format(key="(cloud::varchar || ':' || particle::varchar)")}) / n as point from s)
    select q.cloud, q.stratum::int as stratum, l.particle::int as ancestor from q join l on l.cloud = q.cloud and q.point > l.low and q.point <= l.high
""")
def stratified_resample(spark, sf_dir):
    order = Window.partitionBy("cloud").orderBy(*LINE)
    p = src.table(spark, sf_dir, "lineitem").withColumn("cloud", F.col("l_suppkey") % 50)
    p = p.select("cloud", F.row_number().over(order).alias("particle"), F.col("l_quantity").alias("weight"))
    return posterior.stratified(p, ["cloud"], random.uniform(F.col("cloud"), F.col("particle"))).select("cloud", "stratum", "ancestor")


# --- kernels over many series: compared with the folds' SQL where one exists ---

LEVEL_SPEC = models.structural(sd_level=3.0, sd_y=8.0, a1=[50.0], P1=[[400.0]])
COUNT_SPEC = models.structural(sd_level=priors.halfnormal(0.1, 1.0), dist="poisson", a1=[3.0], P1=[[4.0]])
TREND_SPEC = models.structural(sd_level=priors.halfnormal(1.0, 10.0), sd_slope=0.1, sd_y=priors.halfnormal(5.0, 20.0), P1=[[1000.0, 0.0], [0.0, 10.0]])


@query(f"with recursive {LEVEL_DAILY} select series_id, t, round(a, 6) + 0.0 as a, round(p, 6) + 0.0 as p from f")
def kalman_general(spark, sf_dir):
    rows = inference.kalman_filter(src.daily_counts(spark, sf_dir), LEVEL_SPEC).where("att is not null")
    return rounded(rows.select("series_id", "t", F.col("a")[0].alias("a"), F.col("p")[0].alias("p")))


@query("with recursive " + LEVEL_SQL.format(source=DAILY.replace("d.y from", "d.y - 2.0 * (c.t % 5) + 0.5 * (c.t % 3) as y from"), name="daily") + """
    select series_id, round(case when y is null then ll else ll - 0.5 * (ln(2 * pi()) + ln(p + 64.0) + pow(y - a, 2) / (p + 64.0)) end, 6) + 0.0 as loglik from f where t = (select max(t) from daily)
""")
def loglik_regression(spark, sf_dir):
    series = src.daily_counts(spark, sf_dir).withColumn("x", F.array((F.col("t") % 5).cast("double"), (F.col("t") % 3).cast("double")))
    return rounded(inference.loglik(series, models.structural(sd_level=3.0, sd_y=8.0, beta=(2.0, -0.5), a1=[50.0], P1=[[400.0]])))


@query(SQL["smoother_local_level"])
def smoother_general(spark, sf_dir):
    rows = inference.smooth(src.daily_counts(spark, sf_dir), LEVEL_SPEC)
    return rounded(rows.select("series_id", "t", F.col("alphahat")[0].alias("alphahat"), F.col("vt")[0].alias("vt")))


@query(SQL["smoother_local_level"].replace(", round(p - p * n * p, 6) + 0.0 as vt", ""))
def smoother_fast(spark, sf_dir):
    rows = inference.fast_smooth(src.daily_counts(spark, sf_dir), LEVEL_SPEC)
    return rounded(rows.select("series_id", "t", F.col("alphahat")[0].alias("alphahat")))


@query()
def smoother_simulated(spark, sf_dir):
    return inference.simulate_states(src.daily_counts(spark, sf_dir), LEVEL_SPEC, 20).select("series_id", "draw", "t", F.col("state")[0].alias("level"))


@query()
def laplace_poisson(spark, sf_dir):
    return inference.approximate(src.daily_counts(spark, sf_dir), COUNT_SPEC)


@query()
def loglik_poisson(spark, sf_dir):
    s = src.daily_counts(spark, sf_dir)
    parts = [inference.loglik(s, COUNT_SPEC, method=m, count=n).select("series_id", F.lit(m).alias("method"), "loglik") for m, n in (("psi", 0), ("psi", 50), ("spdk", 50), ("bsf", 500))]
    out = parts[0].withColumn("method", F.lit("laplace"))
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query()
def importance_poisson(spark, sf_dir):
    return inference.importance_sample(src.daily_counts(spark, sf_dir), COUNT_SPEC, 50).select("series_id", "draw", "weight")


@query()
def particle_bootstrap(spark, sf_dir):
    return inference.particle_filter(src.daily_counts(spark, sf_dir), COUNT_SPEC, 500)


@query()
def particle_psi_smoother(spark, sf_dir):
    return inference.particle_filter(src.daily_counts(spark, sf_dir), COUNT_SPEC, 100, method="psi", smoothed=True)


@query()
def mcmc_trend(spark, sf_dir):
    chain = inference.run_mcmc(src.daily_counts(spark, sf_dir), TREND_SPEC, 1000, chains=2)
    return posterior.summary(posterior.long_draws(chain), ["series_id", "variable"])


@query()
def mcmc_importance(spark, sf_dir):
    chain = inference.run_mcmc(src.daily_counts(spark, sf_dir), COUNT_SPEC, 200, method="is2", count=10)
    return posterior.weighted_summary(posterior.long_draws(chain, expand=False), ["series_id", "variable"])


@query()
def mcmc_delayed(spark, sf_dir):
    chain = inference.run_mcmc(src.daily_counts(spark, sf_dir), COUNT_SPEC, 100, method="da", count=10)
    return posterior.acceptance(chain)


@query()
def mcmc_states(spark, sf_dir):
    s = src.daily_counts(spark, sf_dir)
    return inference.state_summary(inference.run_mcmc(s, TREND_SPEC, 300), s, TREND_SPEC)


@query()
def forecast(spark, sf_dir):
    s = src.daily_counts(spark, sf_dir)
    draws = inference.predict(inference.run_mcmc(s, TREND_SPEC, 300), s, TREND_SPEC, 7)
    return posterior.weighted_summary(draws, ["series_id", "t", "variable"], (0.1, 0.5, 0.9))


@query()
def fitted_means(spark, sf_dir):
    s = src.daily_counts(spark, sf_dir)
    draws = inference.fitted(inference.run_mcmc(s, TREND_SPEC, 300), s, TREND_SPEC)
    return posterior.weighted_summary(draws, ["series_id", "t", "variable"])


@query()
def suggest_particles(spark, sf_dir):
    return inference.suggest_count(src.daily_counts(spark, sf_dir), COUNT_SPEC, candidates=(10, 20, 40), replications=20)


def _scaled(spark, sf_dir) -> DataFrame:
    """Monthly orders over their mean: values near 1."""
    s = src.monthly_orders(spark, sf_dir)
    return s.withColumn("y", F.col("y") / F.avg("y").over(Window.partitionBy("series_id")))


#: The extended filter of y ~ N(exp(x), s2), x' = 0.6 x + N(0, q2) by recursion: predictions (a, p), updates (att, ptt), log density of each time.
EXTENDED = f"""
    {MONTHLY}, scaled as (select series_id, t, y / avg(y) over (partition by series_id) as y from monthly),
    f as (
        select series_id, t, y, a, p, case when y is null then a else a + k * (y - exp(a)) end as att, case when y is null then p else pow(1 - k * exp(a), 2) * p + k * k * exp(-2.0) end as ptt
            from (select *, p * exp(a) / (exp(2 * a) * p + exp(-2.0)) as k from (select *, 0.0::double as a, exp(-3.0) / 0.64 as p from scaled where t = 1))
        union all
        select series_id, t, y, a, p, case when y is null then a else a + k * (y - exp(a)) end as att, case when y is null then p else pow(1 - k * exp(a), 2) * p + k * k * exp(-2.0) end as ptt
            from (select *, p * exp(a) / (exp(2 * a) * p + exp(-2.0)) as k from (select n.series_id, n.t, n.y, 0.6 * f.att as a, 0.36 * f.ptt + exp(-3.0) as p from f join scaled n on n.series_id = f.series_id and n.t = f.t + 1))
    ),
    ll as (select series_id, sum(case when y is null then 0.0 else -0.5 * (ln(2 * pi()) + ln(exp(2 * a) * p + exp(-2.0)) + pow(y - exp(a), 2) / (exp(2 * a) * p + exp(-2.0))) end) as loglik from f group by 1)
"""
#: The unscented one: three points, a million times their weights' sum, so a few digits cancel.
UNSCENTED = f"""
    {MONTHLY}, scaled as (select series_id, t, y / avg(y) over (partition by series_id) as y from monthly),
    f as (
        select series_id, t, y, s, e, case when y is null then a else a + c / s * e end as att, case when y is null then p else p - c * c / s end as ptt
            from (select *, -999996.000001 * pow(exp(a) - z, 2) + 5e5 * pow(exp(a + d) - z, 2) + 5e5 * pow(exp(a - d) - z, 2) + exp(-2.0) as s, 5e5 * d * (exp(a + d) - exp(a - d)) as c, y - z as e
                from (select *, -999999 * exp(a) + 5e5 * exp(a + d) + 5e5 * exp(a - d) as z from (select *, 0.001 * sqrt(p) as d from (select *, 0.0::double as a, exp(-3.0) / 0.64 as p from scaled where t = 1))))
        union all
        select series_id, t, y, s, e, case when y is null then a else a + c / s * e end as att, case when y is null then p else p - c * c / s end as ptt
            from (select *, -999996.000001 * pow(exp(a) - z, 2) + 5e5 * pow(exp(a + d) - z, 2) + 5e5 * pow(exp(a - d) - z, 2) + exp(-2.0) as s, 5e5 * d * (exp(a + d) - exp(a - d)) as c, y - z as e
                from (select *, -999999 * exp(a) + 5e5 * exp(a + d) + 5e5 * exp(a - d) as z from (select *, 0.001 * sqrt(p) as d
                    from (select n.series_id, n.t, n.y, 0.6 * f.att as a, 0.36 * f.ptt + exp(-3.0) as p from f join scaled n on n.series_id = f.series_id and n.t = f.t + 1))))
    ),
    ll as (select series_id, sum(case when y is null then 0.0 else -0.5 * (ln(2 * pi()) + ln(s) + e * e / s) end) as loglik from f group by 1)
"""
AR_EXP = [0.0, 0.6, -1.5, -1.0]


def _first_state(rows: DataFrame, digits: int = 6, loglik: int = 6) -> DataFrame:
    """Each double is rounded once: rounding to four and then to three digits isn't rounding to three."""
    rows = rows.select("series_id", "t", F.col("mean")[0].alias("mean"), F.col("cov")[0].alias("cov"), "loglik")
    return rows.withColumns({"mean": F.round("mean", digits) + 0.0, "cov": F.round("cov", digits) + 0.0, "loglik": F.round("loglik", loglik) + 0.0})


@query(f"with recursive {EXTENDED} select series_id, t, round(att, 6) + 0.0 as mean, round(ptt, 6) + 0.0 as cov, round(loglik, 6) + 0.0 as loglik from f join ll using (series_id)")
def extended_filter(spark, sf_dir):
    return _first_state(nonlinear.filter_series(_scaled(spark, sf_dir), nonlinear.example("nlg_ar_exp"), AR_EXP, "ekf"))


@query(f"""
    with recursive {EXTENDED},
    b as (
        select series_id, t, a, p, att as m, ptt as v from f where t = (select max(t) from f)
        union all
        select f.series_id, f.t, f.a, f.p, f.att + f.ptt * 0.6 / b.p * (b.m - b.a), f.ptt + pow(f.ptt * 0.6 / b.p, 2) * (b.v - b.p) from b join f on f.series_id = b.series_id and f.t = b.t - 1
    )
    select series_id, t, round(m, 6) + 0.0 as mean, round(v, 6) + 0.0 as cov, round(loglik, 6) + 0.0 as loglik from b join ll using (series_id)
""")
def extended_smoother(spark, sf_dir):
    return _first_state(nonlinear.filter_series(_scaled(spark, sf_dir), nonlinear.example("nlg_ar_exp"), AR_EXP, "ekf", smoothed=True))


@query(f"with recursive {UNSCENTED} select series_id, t, round(att, 4) + 0.0 as mean, round(ptt, 4) + 0.0 as cov, round(loglik, 3) + 0.0 as loglik from f join ll using (series_id)")
def unscented_filter(spark, sf_dir):
    return _first_state(nonlinear.filter_series(_scaled(spark, sf_dir), nonlinear.example("nlg_ar_exp"), AR_EXP, "ukf"), 4, loglik=3)


@query()
def extended_particles(spark, sf_dir):
    return nonlinear.filter_series(_scaled(spark, sf_dir), nonlinear.example("nlg_ar_exp"), [0.0, 0.6, -1.5, -1.0], "ekpf", count=50)


@query()
def nonlinear_guided(spark, sf_dir):
    return nonlinear.filter_series(_scaled(spark, sf_dir), nonlinear.example("nlg_ar_exp"), [0.0, 0.6, -1.5, -1.0], "psi", count=50)


@query()
def nonlinear_importance(spark, sf_dir):
    s, model = _scaled(spark, sf_dir), nonlinear.example("nlg_ar_exp")
    chain = nonlinear.run_mcmc(s, model, [0.0, 0.6, -1.5, -1.0], 60)
    return posterior.weighted_summary(posterior.long_draws(nonlinear.correct(chain, s, model), expand=False), ["series_id", "variable"])


@query()
def mcmc_diagnostics(spark, sf_dir):
    return posterior.diagnostics(posterior.long_draws(inference.run_mcmc(src.daily_counts(spark, sf_dir), TREND_SPEC, 400, chains=2)), ["series_id", "variable"])


@query()
def diffusion_filter(spark, sf_dir):
    logs = _scaled(spark, sf_dir).withColumn("y", F.log("y"))
    return nonlinear.filter_series(logs, nonlinear.example("sde_gbm"), [0.0, 0.2, 0.6], "sde", count=200)


FLAGSHIP = kalman_local_level
