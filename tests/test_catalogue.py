"""Every query of the catalogue against its SQL in DuckDB."""

import os

import duckdb
import pytest

from crashlens.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are missing")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    return float(f"{v:.9g}") if isinstance(v, float) else v


def test_each_query_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLES)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    ours = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    found = duck.execute(catalogue.ORACLES[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == columns
    theirs = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=repr)
    assert ours == theirs


def test_plans_have_no_python(spark):
    for name in ("km_median_by_type", "matcher_scored", "verdict_tiers", "fp_cluster_strict", "asof_next_else_prev"):
        plan = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan
        assert "CartesianProduct" not in plan


def test_matches_reach_all_logs(spark):
    n = catalogue.QUERIES["suffix_path_match"](spark, SF).select("event_id").distinct().count()
    assert n == spark.read.parquet(f"{SF}/events.parquet").count()
