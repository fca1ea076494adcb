"""Counting in blocks against brute force, and that crowded actions are counted so."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.oracle import SF
from tidemark.operators import coactions as C
from tidemark.operators import graphs, network
from tidemark.plans.tables import Tables


def crowd(rng, n=120, who=7, objects=3, span=500):
    return rng.integers(0, who, n), rng.integers(0, objects, n), np.round(rng.random(n) * span, 3)


@pytest.mark.parametrize("held", [3, 50, 10**6])
@pytest.mark.parametrize("delta", [None, 40])
def test_counted_like_brute_force(held, delta):
    who, obj, at = crowd(np.random.default_rng(held))
    block = who % 2
    want = {}
    for i in range(len(who)):
        for j in range(len(who)):
            gap = abs(at[i] - at[j])
            if who[i] < who[j] and obj[i] == obj[j] and (delta is None or gap <= delta):
                w = want.setdefault(int(who[i] * 7 + who[j]), [0, set(), np.inf])
                w[0] += 1
                w[1].add(obj[i])
                w[2] = min(w[2], gap)
    got = {}
    for x, y in ((0, 0), (0, 1), (1, 1)):
        a, b = (C._Side(who[block == k], obj[block == k], at[block == k]) for k in (x, y))
        for detail in (True, False):
            for key, n, objects, gap in C.counted(a, b, x == y, delta, detail, 7, held):
                for i, k in enumerate(key.tolist()):
                    if detail:
                        assert k not in got
                        got[k] = [n[i], objects[i], gap[i]]
                    else:
                        assert n[i] == got[k][0]
    assert got == {k: [v[0], len(v[1]), v[2]] for k, v in want.items()}


def test_crowded_projection_is_counted_in_blocks(spark):
    base = spark.range(3000).select(F.concat(F.lit("u"), (F.col("id") % 60).cast("string")).alias("author_id"), F.concat(F.lit("o"), (F.col("id") * 7 % 3).cast("string")).alias("action_object"), F.timestamp_micros(F.col("id") * 1_234_567).alias("created_at"))
    for delta in (900, None):
        made = network.project(base, delta)
        assert "MapInArrow" in made._jdf.queryExecution().toString()
        plain = network._meetings(base, ["action_object"], delta).groupBy("src", "dst").agg(F.countDistinct("action_object").alias("n_objects_shared"), F.count(F.lit(1)).alias("n_coactions"), F.min("gap").alias("min_gap"))
        plain = plain.withColumn("weight", F.col("n_coactions" if delta else "n_objects_shared")).where("weight >= 2")
        assert sorted(made.collect()) == sorted(plain.select(made.columns).collect())


@pytest.mark.parametrize("blocks", [1, 3])
def test_blocks_make_no_difference(spark, blocks):
    t = Tables(spark, SF).timed
    own = t.select(F.col("author_id").alias("a"), F.col("action_object").alias("b"), network._seconds().alias("at"))
    plain = network._meetings(t, ["action_object"], 40000).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n_coactions")).where("n_coactions >= 2")
    got = C.pairs(own, blocks, 40000, 2, detail=False)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))


@pytest.mark.parametrize("most", [4, 10**6])
def test_forest_keeps_components(spark, most):
    rng = np.random.default_rng(3)
    links = [(f"n{a}", f"n{b}") for a, b in rng.integers(0, 60, (45, 2)).tolist()] + [("loop", "loop")] + [("x", "y")] * 50
    edges = spark.createDataFrame(links, "src string, dst string").repartition(3)
    few = graphs.forest(edges, most).collect()
    assert most < 10**6 or len(few) <= 3 * 63
    names = sorted({n for l in links for n in l})
    at = {n: i for i, n in enumerate(names)}
    want = graphs.least_of_trees(len(names), *(np.array([at[l[k]] for l in links]) for k in (0, 1)))
    kept = graphs.least_of_trees(len(names), *(np.array([at[r[k]] for r in few]) for k in (0, 1)))
    assert np.array_equal(want, kept) and {n for r in few for n in r} == set(names)
    got = {r["node"]: r["component"] for r in graphs.connected_components(edges).collect()}
    assert got == {n: names[want[i]] for n, i in at.items()}


def test_untimed_pairs_are_dealt_before_they_are_summed(spark):
    """No sum in part over pairs that seldom repeat: it filled memory and disk (F8, F15)."""
    t = Tables(spark, SF).trace.where("action_object < 'o12'")
    made = network.project(t)
    assert "REPARTITION" in made._jdf.queryExecution().executedPlan().toString()
    plain = t.select(F.col("author_id").alias("src"), "action_object").join(t.select(F.col("author_id").alias("dst"), "action_object"), "action_object").where("src < dst")
    plain = plain.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    assert sorted((r["src"], r["dst"], r["weight"], r["n_coactions"], r["min_gap"]) for r in made.collect()) == sorted((r["src"], r["dst"], r["n"], r["n"], None) for r in plain.collect())


def test_tails_are_summed_in_batches(spark):
    """The sums ran element by element in interpreted expressions."""
    from math import comb, exp, factorial

    from tidemark.functions import stats as S

    rows = [(x, m) for x in range(0, 40, 3) for m in (0.0, 0.3, 4.0, 25.0)]
    made = spark.createDataFrame(rows, "x long, m double").select("x", "m", S.poisson_tail(F.col("x"), F.col("m")).alias("p"))
    assert "ArrowEvalPython" in made._jdf.queryExecution().toString()
    for r in made.collect():
        want = 1 - sum(exp(-r["m"]) * r["m"] ** k / factorial(k) for k in range(r["x"]))
        assert abs(r["p"] - want) < 1e-12
    rows = [(x, n, g, d) for n in (20, 60) for g in (0, 5, 18) for d in (3, 17) for x in range(0, 8)]
    made = spark.createDataFrame(rows, "x long, n long, g long, d long").withColumn("p", S.hypergeometric_tail(*map(F.col, "xngd")))
    for r in made.collect():
        want = sum(comb(r["g"], k) * comb(r["n"] - r["g"], r["d"] - k) for k in range(r["x"], r["d"] + 1)) / comb(r["n"], r["d"])
        assert abs(r["p"] - want) < 1e-9


@pytest.mark.parametrize("blocks", [1, 3])
def test_exceedances_like_the_join(spark, blocks):
    """Replicates' pairs are counted where their edges are, and not joined to them as rows (F3, F9)."""
    t = Tables(spark, SF).timed.where("author_id < 'u13'").select("author_id", "action_object").distinct().limit(150).toPandas()
    rng = np.random.default_rng(2)
    rows = [(r, a, o) for r in range(4) for a, o in zip(t["author_id"], rng.permutation(t["action_object"]))]
    acts = spark.createDataFrame(sorted(set(rows)), "rep int, a string, b string").withColumn("at", F.lit(None).cast("double"))
    acts = acts.localCheckpoint()
    edges = acts.where("rep = 0").select(F.col("a").alias("src")).distinct().crossJoin(acts.select(F.col("a").alias("dst")).distinct()).where("src < dst").withColumn("weight", F.lit(2))
    met = acts.select("rep", "b", F.col("a").alias("src")).join(acts.select("rep", "b", F.col("a").alias("dst")), ["rep", "b"]).where("src < dst")
    plain = met.groupBy("rep", "src", "dst").count().where("count >= 2").groupBy("src", "dst").count()
    got = C.exceedances(acts, edges, blocks, None)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect())) and plain.count()
