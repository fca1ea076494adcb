"""Nearest rows, against all pairs."""

import numpy as np
import pandas as pd

from tidemark.operators import vectors


def test_nearest_rows_are_kept_tile_by_tile(spark, monkeypatch):
    """Ties across tiles and blocks go to the smaller id (F35)."""
    v = np.random.default_rng(1).integers(-2, 3, (300, 3)).astype(float)
    v[v.any(axis=1) == 0] = 1
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(300), "vec": v.tolist()}))
    monkeypatch.setattr(vectors, "TOP_TILE", 32)
    got = vectors.nearest(df.where("id % 7 = 0"), df, 9, block=20, rows_block=110).toPandas()
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = np.round(u @ u.T, 6)
    want = {(q, i) for q in range(0, 300, 7) for i in sorted((i for i in range(300) if i != q), key=lambda i: (-s[q, i], i))[:9]}
    assert set(zip(got["query_id"], got["id"])) == want and len(got) == len(want)
