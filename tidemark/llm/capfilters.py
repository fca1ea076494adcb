"""Embedding near-duplicates by spherical-cap filters with structured random product codes.

A filter is a direction; a vector passes it if their inner product exceeds a threshold. Directions
are all pairs (c, d) of a random code for the first half of the dimensions and one for the second,
so a vector's filters are list-decoded from two short lists of inner products, sorted, without
trying every direction. Vectors that pass one filter and have one label are compared exactly.

The threshold follows the number of rows, so that a filter of the largest label holds some `load`
of its vectors; the number of filters is then such that two vectors with cosine just `least` share
`shared` of them on average, so a link is missed with a chance of about exp(-shared).

The comparison has two steps. Vectors first meet as codes of eight bits a component, with the exact
norm of their rounding error, so no pair that links can be screened out; only those that may link
with another in the filter meet once more in full. A pair that several filters hold counts in the first of them alone. A task returns link counts and a
spanning forest, never its pairs. A filter with many vectors is dealt out in tiles of `tile` rows a side.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, rows
without a label and rows without an id link with nothing; such a row is its own component and kept
(a null id has no component). Vectors link only with those of equal length. Equal vectors of a label
link with each other. Rows that share an id are rows of their own, each with its vector's links. Other
columns give way. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common
from tidemark.llm.ann import usable
from tidemark.llm.components import components, forest


def pass_both(t: float, rho: float) -> float:
    """P(Y > t | X > t) of standard normals with correlation rho."""
    n = NormalDist()
    x = np.linspace(t, t + 8, 4001)
    weight = np.exp(-(x**2) / 2)
    y = np.array([1 - n.cdf((t - rho * a) / math.sqrt(1 - rho * rho)) for a in x[::20]])
    return float((np.interp(x, x[::20], y) * weight).sum() / weight.sum())


class Filters:
    """Product codes for `dim` dimensions and labels of up to n vectors, one in each of some random rotations.

    A vector that passes fewer than `shared` / 2 filters, because chance spread its length unevenly
    over the halves, has its threshold lowered until it passes as many.
    """

    def __init__(self, dim: int, n: int, least: float, load: float, shared: float, seed: int, rotations: int = 4):
        p = min(0.02, load / max(n, 1))
        t = -NormalDist().inv_cdf(p)
        each = shared / pass_both(t, least)
        self.half = -(-dim // 2)
        self.size = max(2, math.ceil(math.sqrt(each / p / rotations)))
        self.bar, self.fewest = t / math.sqrt(2 * self.half), math.ceil(shared / 2)
        rng = np.random.default_rng(seed)
        self.turns = [np.linalg.qr(rng.standard_normal((2 * self.half, 2 * self.half)))[0] for _ in range(rotations)]
        codes = rng.standard_normal((2, self.size, self.half))
        self.codes = codes / np.linalg.norm(codes, axis=2, keepdims=True) / math.sqrt(2)

    def decode(self, unit: np.ndarray) -> list[np.ndarray]:
        """The filters that each unit vector passes, ascending."""
        v = np.zeros((len(unit), 2 * self.half))
        v[:, : unit.shape[1]] = unit
        sides = []
        for turn in self.turns:
            w = v @ turn
            left, right = w[:, : self.half] @ self.codes[0].T, w[:, self.half :] @ self.codes[1].T
            order = np.argsort(-right, axis=1)
            sides.append((left, -np.take_along_axis(right, order, axis=1), order))
        out = []
        for k in range(len(v)):
            bar = self.bar
            while True:
                parts = [self._list(left[k], falling[k], order[k], bar) + r * self.size**2 for r, (left, falling, order) in enumerate(sides)]
                if sum(map(len, parts)) >= min(self.fewest, len(sides) * self.size**2):
                    break
                bar -= 0.03 * abs(self.bar) + 1e-3
            out.append(np.sort(np.concatenate(parts)))
        return out

    def _list(self, a: np.ndarray, b: np.ndarray, o: np.ndarray, bar: float) -> np.ndarray:
        """Filters (i, j) with a[i] + b's j-th over bar; b falls (it is negated) and o has its places."""
        i = np.flatnonzero(a >= bar + b[0])
        n = np.searchsorted(b, a[i] - bar, "right")
        j = o[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        return (np.repeat(i, n) * self.size + j).astype(np.int64)


def _unit(column: pd.Series) -> np.ndarray:
    v = np.stack([np.frombuffer(x, "<f8") for x in column]) if len(column) else np.zeros((0, 1))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _runs(pdf: pd.DataFrame, keys: list[str]) -> Iterator[tuple[int, int]]:
    """Bounds of the runs of two rows or more that agree in keys, in a sorted frame."""
    change = np.ones(len(pdf) + 1, bool)
    if len(pdf):
        change[1:-1] = np.any([pdf[k].to_numpy()[1:] != pdf[k].to_numpy()[:-1] for k in keys], axis=0)
    starts = np.flatnonzero(change)
    for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist()):
        if hi - lo > 1:
            yield lo, hi


def link(vectors: DataFrame, id_column: str, vector_column: str, label_column: str, least: float = 0.93, load: float = 8.0, shared: float = 16.0, tile: int = 1024, seed: int = 42) -> DataFrame:
    """id_column, n_links, component_id and kept of every row."""
    rows = vectors.select(F.col(id_column).alias("id"), F.col(vector_column).alias("vec"), F.col(label_column).alias("label"))
    rows = rows.withColumn("vec", F.when(F.col("id").isNotNull() & F.col("label").isNotNull() & usable("vec"), F.transform("vec", lambda x: x.cast("double") + F.lit(0.0))))
    rows = common.cut(rows.withColumn("dim", F.size("vec")), "vectors")
    live = rows.where("vec is not null")
    # A class is known by its row in a stored table: an id may come with several vectors.
    classes = common.cut(live.groupBy("label", "dim", "vec").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("m")), "classes")
    classes = common.cut(classes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    # One row per label and length: the largest count sets the filters.
    sizes = classes.groupBy("label", "dim").count().agg(F.max("count"), F.max("dim")).first()
    n, dim = (sizes[0] or 1), (sizes[1] or 2)
    filters = Filters(dim, n, least, load, shared, seed)
    shared_filters = rows.sparkSession.sparkContext.broadcast(filters)
    label_type = common.schema_with(rows, "label").fields[0].dataType.simpleString()

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            vecs = [np.asarray(x, "<f8") for x in pdf["vec"]]
            passed: list[np.ndarray] = [np.zeros(0, np.int64)] * len(vecs)
            for d in set(pdf["dim"]):
                at = np.flatnonzero(pdf["dim"].to_numpy() == d)
                v = np.stack([vecs[i] for i in at])
                for i, f in zip(at, shared_filters.value.decode(v / np.linalg.norm(v, axis=1, keepdims=True))):
                    passed[i] = f
            code, scale, error = [], [], []
            for x in vecs:
                u = x / np.linalg.norm(x)
                top = np.abs(u).max() / 127
                q = np.rint(u / top).astype(np.int8)
                code.append(np.concatenate([q, np.zeros(dim - len(q), np.int8)]).tobytes())
                scale.append(top)
                error.append(np.linalg.norm(u - q * top))
            yield pd.DataFrame({"label": pdf["label"], "dim": pdf["dim"], "node": pdf["node"], "m": pdf["m"], "raw": [x.tobytes() for x in vecs], "passed": [x.tobytes() for x in passed], "filter": passed, "code": code, "scale": np.float32(scale), "error": np.float32(error)})

    decoded = common.cut(classes.mapInPandas(decode, f"label {label_type}, dim int, node long, m long, raw binary, passed binary, filter array<long>, code binary, scale float, error float"), "decoded")
    held = decoded.select("label", "dim", "node", F.explode("filter").alias("filter"))
    loads = held.groupBy("label", "dim", "filter").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    tiles = F.ceil(F.col("n") / tile).cast("int")
    held = held.join(loads, ["label", "dim", "filter"]).withColumn("tiles", tiles).withColumn("own", F.pmod(F.xxhash64("node"), "tiles").cast("int"))
    held = held.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    held = held.select("node", "label", "dim", "filter", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    per_task = 4096
    tasks = max(1, -(-int(classes.count() * 2 * shared) // per_task))
    place = ["label", "dim", "filter", "i", "j"]
    task = F.pmod(F.xxhash64(*place), F.lit(tasks)).cast("int")

    def screen(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([*place, "own", "node"], ignore_index=True)
        q = np.frombuffer(b"".join(pdf["code"]), np.int8).reshape(len(pdf), -1).astype(np.float32) * pdf["scale"].to_numpy()[:, None]
        error, own, cross = pdf["error"].to_numpy(), pdf["own"].to_numpy(), (pdf["i"] != pdf["j"]).to_numpy()
        may = np.zeros(len(pdf), bool)
        for lo, hi in _runs(pdf, place):
            e = error[lo:hi]
            ok = q[lo:hi] @ q[lo:hi].T >= least - 1e-4 - (e[:, None] + e[None] + e[:, None] * e[None])
            np.fill_diagonal(ok, False)
            if cross[lo]:
                ok &= own[lo:hi, None] != own[None, lo:hi]
            may[lo:hi] = ok.any(axis=1)
        return pdf.loc[may, [*place, "own", "node"]]

    coded = held.join(decoded.select("node", "code", "scale", "error"), "node").withColumn("task", task)
    met = coded.groupBy("task").applyInPandas(screen, f"label {label_type}, dim int, filter long, i int, j int, own int, node long")
    spread = met.join(decoded.select("node", "m", "raw", "passed"), "node").withColumn("task", task)

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([*place, "own", "node"], ignore_index=True)
        nodes, m = pdf["node"].to_numpy(), pdf["m"].to_numpy()
        own, cross = pdf["own"].to_numpy(), pdf["i"].to_numpy() != pdf["j"].to_numpy()
        filter_of = pdf["filter"].to_numpy()
        counts = np.zeros(len(pdf), np.int64)
        src, dst = [], []
        for lo, hi in _runs(pdf, place):
            v = _unit(pdf["raw"].iloc[lo:hi])
            ok = np.triu(v @ v.T >= least, 1)
            if cross[lo]:
                ok &= own[lo:hi, None] != own[None, lo:hi]
            if not ok.any():
                continue
            # Filters before this one that two of the rows share: the pair counts there.
            lists = [np.frombuffer(x, np.int64) for x in pdf["passed"].iloc[lo:hi]]
            lists = [x[x < filter_of[lo]] for x in lists]
            who = np.repeat(np.arange(hi - lo), [len(x) for x in lists])
            names, which = np.unique(np.concatenate(lists), return_inverse=True)
            often = np.bincount(which, minlength=len(names)) > 1
            to = np.cumsum(often) - 1
            keep = often[which]
            has = np.zeros((hi - lo, int(often.sum())), np.float32)
            has[who[keep], to[which[keep]]] = 1
            ok &= has @ has.T == 0
            a, b = np.nonzero(ok)
            if len(a):
                np.add.at(counts, lo + a, m[lo + b])
                np.add.at(counts, lo + b, m[lo + a])
                x, y = forest(nodes[lo + a], nodes[lo + b])
                src.append(x)
                dst.append(y)
        some = counts > 0
        x, y = forest(np.concatenate([*src, np.zeros(0, np.int64)]), np.concatenate([*dst, np.zeros(0, np.int64)]))
        totals = pd.DataFrame({"node": nodes[some], "n": counts[some]}).groupby("node", as_index=False)["n"].sum()
        return pd.concat([totals.assign(to=totals["node"]), pd.DataFrame({"node": x, "n": 0, "to": y})])[["node", "to", "n"]].astype("int64")

    found = common.cut(spread.groupBy("task").applyInPandas(compare, "node long, to long, n long"), "found")
    links = found.where("node <> to").select(F.col("node").alias("src"), F.col("to").alias("dst"))
    of_node = classes.join(found.groupBy("node").agg(F.sum("n").alias("n")), "node", "left").join(components(links), "node", "left")
    of_node = common.cut(of_node.withColumn("component", F.coalesce("component", "node")), "linked")
    smallest = of_node.groupBy("component").agg(F.min("least").alias("component_id"))
    of_node = of_node.join(smallest, "component").select("label", "dim", "vec", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).cast("long").alias("n_links"), "component_id")
    linked = live.join(of_node, ["label", "dim", "vec"]).select("id", "n_links", "component_id")
    alone = rows.where("vec is null").select("id", F.lit(0).cast("long"), F.col("id").alias("component_id"))
    out = linked.unionAll(alone)
    return out.select(F.col("id").alias(id_column), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
