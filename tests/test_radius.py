import numpy as np
import pytest

from tidemark.operators import vectors


@pytest.mark.parametrize("blocks", [1, 2, 5])
def test_radius_links_like_brute_force_tile_by_tile(spark, monkeypatch, blocks):
    v = np.random.default_rng(1).normal(size=(90, 6)).astype(np.float32)
    v[7] = v[3]
    v[11] = 0
    rows = [(i, x) for i, x in enumerate(v.tolist())] + [(900, None), (901, [1.0, None, 0.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, vec array<float>")
    u = v.astype(float) / np.maximum(np.linalg.norm(v.astype(float), axis=1, keepdims=True), 1e-300)
    s = u @ u.T
    want = {(i, j): round(s[i, j], 9) for i in range(90) for j in range(i + 1, 90) if s[i, j] >= 0.4}
    got = [(r["src"], r["dst"], round(r["sim"], 9)) for r in vectors.radius_links(df, 0.4, blocks).collect()]
    assert len(got) == len(want) and {(a, b): c for a, b, c in got} == want


def test_radius_links_deal_more_rows_into_more_blocks(spark, monkeypatch):
    """A block's rows, and so a task's memory, do not grow with the table (they grew with its root)."""
    monkeypatch.setattr(vectors, "RADIUS_BLOCK", 10, raising=False)
    df = spark.range(100).selectExpr("id", "array(1.0, id * 1.0) AS vec")
    made = vectors.radius_links(df, 0.5)
    assert made.rdd.getNumPartitions() == 55 and made.count() == vectors.radius_links(df, 0.5, 1).count()
