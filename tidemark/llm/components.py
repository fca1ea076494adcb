"""Connected components of a table of links, by alternating large-star and small-star rounds."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common
from tidemark.operators.graphs import star_components


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links (a[i], b[i]): as (node, smallest node reached), nodes that are their own left out.

    Vectorised hooking with pointer jumping, so a group of links costs memory in proportion to it.
    """
    if not len(a):
        return a, b
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while True:
        rx, ry = root[x], root[y]
        live = rx != ry
        if not live.any():
            break
        x, y, rx, ry = x[live], y[live], rx[live], ry[live]
        np.minimum.at(root, np.maximum(rx, ry), np.minimum(rx, ry))
        while (root[root] != root).any():
            root = root[root]
    far = root != np.arange(len(nodes))
    return nodes[far], nodes[root[far]]


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node in links (src long, dst long): the smallest node reachable.

    Links are thinned to a forest per task first, and every round ends in a table in the shared folder.
    """
    pairs = links.select(F.greatest("src", "dst").alias("hi"), F.least("src", "dst").alias("lo")).where("hi <> lo")
    pairs = star_components(_thin(pairs), lambda df: common.cut(df, "links"), common.drop, max_rounds)
    heads = pairs.select(F.col("lo").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return pairs.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(heads)


def _thin(pairs: DataFrame) -> DataFrame:
    """The same components in a forest per batch, then distinct."""

    def run(batches):
        for pdf in batches:
            hi, lo = forest(pdf["hi"].to_numpy(np.int64), pdf["lo"].to_numpy(np.int64))
            yield pd.DataFrame({"hi": hi, "lo": lo})

    return pairs.mapInPandas(run, "hi long, lo long").distinct()
