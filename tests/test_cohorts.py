"""Profiles near one another, against all pairs."""

import numpy as np

from tidemark.operators import forensics


def test_close_profiles_have_the_components_of_all_pairs(spark, monkeypatch):
    """In blocks and tiles, near the threshold too (F21)."""
    rng = np.random.default_rng(5)
    p = rng.dirichlet(np.full(24, 0.8), 12)
    p = np.repeat(p, 10, axis=0) + rng.random((120, 24)) * 0.03
    p /= p.sum(axis=1, keepdims=True)
    monkeypatch.setattr(forensics, "TILE", 16)
    within = 0.02

    def jsd(x, y):
        m = (x + y) / 2
        return (x * np.log2(x / m) + y * np.log2(y / m)).sum() / 2

    want = list(range(len(p)))
    for _ in range(10):
        for i in range(len(p)):
            for j in range(i):
                if jsd(p[i], p[j]) <= within:
                    want[i] = want[j] = min(want[i], want[j])
    alone = {i for i in range(len(p)) if want.count(want[i]) == 1}
    own = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(p)], "id long, p array<double>")
    for blocks in (1, 3):
        got = forensics.graphs.connected_components(forensics.close_profiles(own, within, blocks)).toPandas()
        assert dict(zip(got["node"], got["component"])) == {i: c for i, c in enumerate(want) if i not in alone}
    assert 1 < len(set(want)) < len(p)
