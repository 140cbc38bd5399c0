"""Every query with SQL against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from stateweave.plans import queries
from stateweave.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def rows(frame):
    """In an order that puts missing values last and isn't upset by the last digits of doubles."""
    cols = sorted(frame.columns)
    found = [tuple(None if x != x else x for x in r) for r in frame[cols].itertuples(index=False)]
    return sorted(found, key=lambda r: tuple((x is None, 0 if x is None else x) for x in sorted(r, key=lambda x: isinstance(x, float))))


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, db, name):
    got, want = QUERIES[name](spark, SF).toPandas(), db.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    for a, b in zip(rows(got), rows(want), strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == y or x is not None and y is not None and isinstance(x, float) and abs(x - y) <= 2e-6 * max(1, abs(x))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["laplace_poisson", "loglik_poisson", "particle_psi_smoother", "unscented_filter", "diffusion_filter", "importance_poisson"])
def test_others_run(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_chains_read_every_line(spark, tmp_path):
    rows = [(k, 1, k, s, 1.0, 100.0 + k, 0.1, 0.02) for k, s in enumerate((1, 59, 60, 61, 500, 100_000))]
    kinds = ", ".join(f"{c} {'long' if k < 4 else 'double'}" for k, c in enumerate(("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")))
    spark.createDataFrame(rows, kinds).write.parquet(f"{tmp_path}/lineitem.parquet")
    assert sum(r.iterations for r in QUERIES["draws_acceptance"](spark, str(tmp_path)).collect()) == 2 * len(rows)
    assert QUERIES["draws_long"](spark, str(tmp_path)).count() == 2 * len(rows)


def test_doubles_are_rounded_once(spark):
    """-18.137454 is -18.137; by way of four digits it was -18.138."""
    rows = spark.sql("select 'a' series_id, 1 t, array(0.12345D) mean, array(2.00005D) cov, -18.137454D loglik")
    r = queries._first_state(rows, 4, loglik=3).first()
    assert (r["mean"], r["cov"], r["loglik"]) == (0.1235, 2.0001, -18.137)
    rows = QUERIES["unscented_filter"](spark, "/root/testdata/sf0.01").where("series_id = '2-HIGH'")
    assert [x.loglik for x in rows.select("loglik").distinct().collect()] == [-18.137]
