"""Graph steps: connected components by Spark rounds, constant-Potts communities and trades in numpy."""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.order import checkpointed


#: Links of one node up to which they meet in one task.
HUB = 256


def spread_join(rows: DataFrame, key: str, values: DataFrame, total: int, hub: int = HUB) -> DataFrame:
    """rows inner-joined on key to values, which has one row a key and its count of rows in column `n`.

    No key's rows meet in one task: those of keys with over max(hub, total / 10,000) of the total rows, so
    at most 10,000 keys, are joined where they are, by broadcast; the others by shuffle.
    """
    bar = max(hub, total // 10_000)
    hot = F.broadcast(values.where(F.col("n") > bar).drop("n"))
    cold = values.where(F.col("n") <= bar).drop("n")
    rest = rows.join(F.broadcast(values.where(F.col("n") > bar).select(key)), key, "left_anti")
    return rows.join(hot, key).unionByName(rest.join(cold, key))


def star_components(pairs: DataFrame, store: Callable[[DataFrame], DataFrame], free: Callable[[DataFrame], None] = lambda _: None, rounds: int = 60) -> DataFrame:
    """pairs (hi, lo), hi > lo, as (hi, lo) with lo the smallest node reachable from hi.

    Alternating large-star and small-star rounds. Each round's pairs are stored, so a lost executor
    costs one round. A node's links never meet in one task: minima are taken in part before each
    shuffle, and a hub's minimum goes to its links and not they to it.
    """
    pairs = store(pairs)
    for _ in range(rounds):
        total = pairs.count()
        # Large star: every higher neighbour of a node links to the node's smallest neighbour.
        ends = pairs.select(F.col("lo").alias("node"), F.col("lo").alias("m"), F.lit(1).alias("one")).union(pairs.select("hi", "lo", F.lit(0)))
        least = ends.groupBy("node").agg(F.min("m").alias("m"), F.sum("one").alias("n")).where("n > 0").withColumnRenamed("node", "lo")
        large = spread_join(pairs, "lo", least, total).select("hi", F.col("m").alias("lo")).distinct()
        # Small star: a node and its lower neighbours link to the smallest of them.
        large = store(large)
        smallest = large.groupBy("hi").agg(F.min("lo").alias("m"), F.count(F.lit(1)).alias("n"))
        lower = spread_join(large, "hi", smallest, total).select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        after = store(lower.union(smallest.select("hi", F.col("m").alias("lo"))).where("hi <> lo").distinct())
        free(large)
        # Pairs are distinct and never more than before, so equal counts and no new pair mean no change.
        settled = after.count() == total and after.join(pairs, ["hi", "lo"], "left_anti").isEmpty()
        free(pairs)
        pairs = after
        if settled:
            return pairs
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def forest(edges: DataFrame, most: int = 1_000_000) -> DataFrame:
    """edges (src, dst) as (hi, lo) with the same components and nodes: in each task every node and the least of its tree.

    A task holds at most about `most` nodes and edges: beyond that it hands out its trees and starts anew.
    """
    kind = dict(edges.dtypes)["src"]

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def grown() -> tuple[pa.Array, np.ndarray]:
            coded = pa.chunked_array([b.column(s) for s in ("src", "dst") for b in held]).dictionary_encode().combine_chunks()
            coded = coded.chunk(0) if isinstance(coded, pa.ChunkedArray) else coded
            order = pc.array_sort_indices(coded.dictionary)
            rank = np.empty(len(order), np.int64)
            rank[order.to_numpy()] = np.arange(len(order))
            codes = rank[coded.indices.to_numpy()]
            return coded.dictionary.take(order), least_of_trees(len(order), *np.split(codes, 2))

        def batch(names: pa.Array, root: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([names, names.take(pa.array(root))], names=["src", "dst"])

        def out(names: pa.Array, root: np.ndarray) -> Iterator[pa.RecordBatch]:
            whole = batch(names, root).rename_columns(["hi", "lo"])
            for at in range(0, whole.num_rows, 100_000):
                yield whole.slice(at, 100_000)

        for b in batches:
            ok = b.filter(pc.and_(pc.is_valid(b.column("src")), pc.is_valid(b.column("dst"))))
            held.append(ok)
            rows += ok.num_rows
            if rows >= most:
                tree = grown()
                if len(tree[0]) > most // 2:
                    yield from out(*tree)
                    held, rows = [], 0
                else:  # the trees go on as edges
                    held, rows = [batch(*tree)], len(tree[0])
        if rows:
            yield from out(*grown())

    return edges.mapInArrow(trees, f"hi {kind}, lo {kind}")


def least_of_trees(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Per node of 0..n-1 the least node that it reaches by the links (a, b)."""
    root = np.arange(n)
    while len(a):
        a, b = root[a], root[b]
        apart = a != b
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(root[root], root):
            root = root[root]
    return root


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every end of edges (src, dst): the smallest node reachable.

    Edges are read once, and each task keeps a forest of its own: what the rounds store grows with the nodes.
    """
    return components_of(forest(edges.select("src", "dst")).distinct(), rounds)


def components_of(trees: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of links (hi, lo), hi >= lo, of which every node has one at least, be it with itself."""
    links = checkpointed(trees)
    nodes = checkpointed(links.select(F.col("hi").alias("node")).union(links.select("lo")).distinct())
    stars = star_components(links.where("hi <> lo"), checkpointed, rounds=rounds)
    return nodes.join(stars.withColumnRenamed("hi", "node"), "node", "left").select("node", F.coalesce("lo", "node").alias("component"))


def potts(n: int, a: np.ndarray, b: np.ndarray, weight: np.ndarray, resolution: float, size: np.ndarray | None = None) -> np.ndarray:
    """Communities of n nodes that raise sum(internal weight) - resolution * sum(pairs): moves, refinement, merging.

    A node counts once in pairs, or size times.

    As in the Leiden method a level moves single nodes until none gains, then splits each community into
    parts grown from single nodes along links that gain, and goes on with the parts as nodes that start in
    their community. So a community is never held together by a node that has left it.
    """
    near: list[dict[int, float]] = [defaultdict(float) for _ in range(n)]
    for i, j, w in zip(a.tolist(), b.tolist(), weight.tolist()):
        near[i][j] += w
        near[j][i] += w
    label = np.arange(n)
    while True:  # each pass starts from the last one's communities and never lowers the score
        after = _pass(near, label, resolution, np.ones(n) if size is None else size)
        # Named by first member, so that equal partitions are equal arrays.
        after = np.unique(after, return_index=True)[1][np.unique(after, return_inverse=True)[1]]
        if np.array_equal(after, label):
            return label
        label = after


def _pass(near: list[dict[int, float]], label: np.ndarray, resolution: float, size: np.ndarray) -> np.ndarray:
    """Levels of moves, refinement and merging, from label on, until every community is one node."""
    of = np.arange(len(near))
    while True:
        m = len(near)
        label = np.unique(_moved(near, size, label, resolution), return_inverse=True)[1]
        if label.max(initial=-1) + 1 == m:
            return label[of]
        parts = np.unique(_refined(near, size, label, resolution), return_inverse=True)[1]
        if parts.max() + 1 == m:
            parts = label
        k = int(parts.max()) + 1
        merged: list[dict[int, float]] = [defaultdict(float) for _ in range(k)]
        for v in range(m):
            for u, w in near[v].items():
                merged[parts[v]][parts[u]] += w
        start = np.zeros(k, np.int64)
        start[parts] = label
        near, size, of, label = merged, np.bincount(parts, weights=size, minlength=k), parts[of], start


def _pull(near: dict[int, float], v: int, label: np.ndarray) -> dict[int, float]:
    """Weight of the links from v to each community."""
    out: dict[int, float] = defaultdict(float)
    for u, w in near.items():
        if u != v:
            out[int(label[u])] += w
    return out


def _moved(near: list[dict[int, float]], size: np.ndarray, label: np.ndarray, resolution: float) -> np.ndarray:
    """label after single moves, each to the community that gains most, until none gains; ties to the lowest."""
    m, label = len(near), label.copy()
    mass = np.bincount(label, weights=size, minlength=m + 1)
    free = [c for c in range(m, -1, -1) if mass[c] == 0]
    queue, waiting = deque(range(m)), np.ones(m, bool)
    while queue:
        v = queue.popleft()
        waiting[v] = False
        own = int(label[v])
        pull = _pull(near[v], v, label)
        mass[own] -= size[v]
        best, gain = own, pull.get(own, 0.0) - resolution * size[v] * mass[own]
        for c in sorted(pull):
            g = pull[c] - resolution * size[v] * mass[c]
            if g > gain + 1e-12:
                best, gain = c, g
        if gain < -1e-12:  # alone is better
            best = free.pop()
        mass[best] += size[v]
        if best != own:
            if mass[own] == 0:
                free.append(own)
            label[v] = best
            for u in near[v]:
                if label[u] != best and not waiting[u]:
                    waiting[u] = True
                    queue.append(u)
    return label


def _refined(near: list[dict[int, float]], size: np.ndarray, label: np.ndarray, resolution: float) -> np.ndarray:
    """Parts of the communities: nodes that are still alone join the part of their community that gains most."""
    m = len(near)
    part, mass, alone = np.arange(m), size.astype(float), np.ones(m, bool)
    for v in range(m):
        if not alone[v]:
            continue
        pull: dict[int, float] = defaultdict(float)
        for u, w in near[v].items():
            if u != v and label[u] == label[v]:
                pull[int(part[u])] += w
        best, gain = v, 1e-12
        for c in sorted(pull):
            g = pull[c] - resolution * size[v] * mass[c]
            if g > gain:
                best, gain = c, g
        if best != v:
            part[v], alone[v], alone[best] = best, False, False
            mass[best] += size[v]
            mass[v] -= size[v]
    return part


def curveball(n: int, a: np.ndarray, o: np.ndarray, rng: np.random.Generator, per_node: int = 5) -> list[set[int]]:
    """Objects of each of n accounts after per_node * n trades, which keep every account's and object's degree."""
    sets: list[set[int]] = [set() for _ in range(n)]
    for i, x in zip(a.tolist(), o.tolist()):
        sets[i].add(x)
    if n < 2:
        return sets
    for _ in range(per_node * n):
        i, j = rng.choice(n, 2, replace=False).tolist()
        both = sets[i] & sets[j]
        pool = np.array(sorted((sets[i] | sets[j]) - both))
        keep = len(sets[i]) - len(both)
        rng.shuffle(pool)
        sets[i] = both | set(pool[:keep].tolist())
        sets[j] = both | set(pool[keep:].tolist())
    return sets
