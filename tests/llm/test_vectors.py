"""Operators on embeddings against brute force, and odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import ann, capfilters

VEC = "vec_id long, embedding array<float>, label int, score double, kept string"


def table(spark, v, labels, more=()):
    rows = [(i, [float(x) for x in r], int(c), 0.0, "k") for i, (r, c) in enumerate(zip(v, labels))]
    return spark.createDataFrame([*rows, *more], VEC)


def odd(at, dim):
    bad = [None, [0.0] * dim, [float("nan")] + [1.0] * (dim - 1), [None] + [1.0] * (dim - 1), [float("inf")] + [1.0] * (dim - 1), []]
    return [(at + i, b, 1, None, None) for i, b in enumerate(bad)] + [(None, [1.0] * dim, 1, None, None)]


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(0)
    v = rng.standard_normal((700, 24))
    v[100:160] = v[100] + 0.02 * rng.standard_normal((60, 24))  # near copies
    v[200:260] = v[200]  # copies
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    labels = rng.integers(0, 3, 700)
    labels[100:260] = 1
    return v.astype(np.float32), labels


def test_search(spark, vectors):
    v, labels = vectors
    df = table(spark, v, labels, odd(700, 24))
    got = ann.search(df, "vec_id", "embedding", F.col("vec_id") % 20 == 0, 20, k=32, sample=16, trees=4, bucket=128).toPandas()
    x = v.astype(float)
    hits = total = 0
    for q in range(0, 700, 20):
        s = x @ x[q]
        s[q] = -9
        want = np.lexsort((np.arange(700), -s))[:20]
        own = got[got["query_id"] == q].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 21)) and q not in set(own["vec_id"])
        assert np.allclose(own["score"], s[own["vec_id"]], atol=1e-12)
        order = list(zip(-own["score"], own["vec_id"]))
        assert order == sorted(order)
        hits += len(set(want) & set(own["vec_id"]))
        total += 20
    assert hits >= 0.9 * total and set(got["query_id"]) == set(range(0, 700, 20))
    twins = got[got["query_id"] == 220].sort_values("rank")["vec_id"].tolist()
    assert twins == list(range(200, 220))  # equal scores: smaller ids first
    few = ann.search(df.where("vec_id < 5"), "vec_id", "embedding", F.col("vec_id") % 20 == 0)
    assert few.count() == 4 and ann.search(df.limit(0), "vec_id", "embedding", F.col("vec_id") % 20 == 0).count() == 0


def test_search_within_a_hot_group_of_near_vectors(spark):
    rng = np.random.default_rng(5)
    v = rng.standard_normal((1500, 64))
    v[:500] = v[0] + rng.standard_normal((500, 64)) * 0.02  # a third of the rows are near, not equal
    v = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32).astype(float)
    got = ann.search(table(spark, v, [0] * len(v)), "vec_id", "embedding", F.col("vec_id") % 20 == 0, 20).toPandas()
    hits = []
    for q, g in got[got["query_id"] < 500].groupby("query_id"):
        s = v @ v[q]
        s[q] = -1
        hits.append(len(set(np.argsort(-s)[:20]) & set(g["vec_id"])) / 20)
    print("recall", len(hits), np.mean(hits))
    assert len(hits) == 25 and np.mean(hits) >= 0.9


def test_links(spark, vectors):
    v, labels = vectors
    more = [*odd(700, 24), (800, [1.0] * 24, None, None, None), (801, [1.0] * 24, None, None, None), (802, [2.0] * 24, 2, None, None), (803, [1.0] * 24, 2, None, None)]
    got = capfilters.link(table(spark, v, labels, more), "vec_id", "embedding", "label", tile=32).toPandas()
    assert len(got) == 700 + len(more)
    ids = [*range(700), 802, 803]
    x = np.vstack([v.astype(float), np.full((1, 24), 2.0), np.ones((1, 24))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    lab = np.array([*labels, 2, 2])
    link = (x @ x.T >= 0.93) & (lab[:, None] == lab[None])
    np.fill_diagonal(link, False)
    own = got.set_index("vec_id")
    comp = np.arange(len(ids))
    for _ in range(20):
        comp = np.array([min(comp[i], comp[link[i]].min(initial=comp[i])) for i in range(len(ids))])
    for i, k in enumerate(ids):
        assert own.loc[k, "n_links"] == link[i].sum() and own.loc[k, "component_id"] == ids[comp[i]] and own.loc[k, "kept"] == (ids[comp[i]] == k)
    for k in [*range(700, 706), 800, 801]:
        assert own.loc[k, "n_links"] == 0 and own.loc[k, "component_id"] == k
    assert capfilters.link(table(spark, v[:1], [0]).limit(0), "vec_id", "embedding", "label").count() == 0


def test_one_id_with_two_vectors(spark):
    rng = np.random.default_rng(9)
    v = rng.standard_normal((120, 16))
    v[1] = v[0] + 0.01 * rng.standard_normal(16)  # near one another, and both under id 0
    v[60:90] = v[60] + 0.01 * rng.standard_normal((30, 16))
    ids = [0, 0, *range(2, 120)]
    rows = [(i, [float(x) for x in r], 1, 0.0, "k") for i, r in zip(ids, v)]
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in capfilters.link(spark.createDataFrame(rows, VEC), "vec_id", "embedding", "label").collect())
    x = np.asarray(v, np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    link = x @ x.T >= 0.93
    np.fill_diagonal(link, False)
    least = [min([ids[i], *(ids[j] for j in np.flatnonzero(link[i]))]) for i in range(120)]
    assert got == sorted((ids[i], int(link[i].sum()), least[i]) for i in range(120)) and got[0][1] == 1
    found = ann.search(spark.createDataFrame(rows, VEC), "vec_id", "embedding", F.col("vec_id") % 20 == 0, 20).toPandas()
    # Both rows of id 0 ask; neither is a candidate of that id, and each other row is found once.
    mine = found[found["query_id"] == 0]
    assert 0 not in set(mine["vec_id"]) and sorted(mine["rank"]) == list(range(1, 21)) and mine["vec_id"].is_unique
    best = np.sort(np.unique(np.round(np.maximum(v[0].astype(np.float32).astype(float) @ v[2:].astype(np.float32).astype(float).T, v[1].astype(np.float32).astype(float) @ v[2:].astype(np.float32).astype(float).T), 9)))[::-1][:20]
    assert mine.sort_values("rank")["score"].to_numpy() == pytest.approx(best, abs=1e-6)
