"""Every query with SQL gives the same rows as DuckDB, and some rows; the others give what they promise."""

import pytest

import __spark_entry__
from tests.oracle import SF, connect, rows
from tidemark.plans.bindings import QUERIES, SQL

LARGER = SF.replace("sf0.001", "sf0.01")


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.fixture(scope="module")
def larger():
    return connect(LARGER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, con, larger, name):
    got, want = QUERIES[name](spark, SF).toPandas(), con.execute(SQL[name]).df()
    if not len(want):  # nothing to compare at the smallest size
        got, want = QUERIES[name](spark, LARGER).toPandas(), larger.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(want)
    assert rows(got) == rows(want)


#: Iterative or random queries, each with what has to hold for its rows; their operators have planted tests of their own.
OTHERS = {
    "au02_anomaly": lambda d: len(d) == 150 and d["anomaly_score"].between(0, 1).all() and d["anomaly_rank"].max() == 1,
    "cl04_baseline": lambda d: len(d) > 10 and set(d["prediction"]) <= {0.0, 1.0},
    "co05_curveball": lambda d: len(d) > 50 and d["p_value"].between(1 / 25, 1).all() and d["p_value"].nunique() > 5,
    "co06_shuffled_times": lambda d: len(d) > 0 and d["p_value"].between(1 / 11, 1).all(),
    "co10_communities": lambda d: d["author_id"].is_unique and d.groupby("cluster_id").size().min() >= 2,
    "co11_resolution_sweep": lambda d: len(d) == 3 and d.sort_values("resolution")["n_accounts"].is_monotonic_decreasing,
    "co12_clusters": lambda d: len(d) > 0 and (d["size"] >= 3).all() and d["density"].between(0, 1).all(),
    "co19_recovery": lambda d: d[["precision", "recall", "f1"]].iloc[0].tolist() == [1.0, 1.0, 1.0],
    "co20_null_baseline": lambda d: d["edges"].iloc[0] > 0 and d["bonferroni"].iloc[0] == 0,
    "fx04_random_subsets": lambda d: len(d) == 9 and d["p_value"].between(1 / 21, 1).all(),
    "lb06_candidates": lambda d: len(d) > 20 and d["platform_post_id"].is_unique and d["author_handle"].value_counts().max() <= 5 and d["stratum"].nunique() >= 4,
    "st07_minhash_clusters": lambda d: d["doc_id"].is_unique and (d["cluster"] <= d["doc_id"]).all() and d["cluster"].nunique() < len(d),
}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_others_give_what_they_promise(spark, name):
    got = QUERIES[name](spark, SF).toPandas()
    if not len(got):
        got = QUERIES[name](spark, LARGER).toPandas()
    assert OTHERS[name](got)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_names_agree():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
