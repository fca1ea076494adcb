"""Approximate nearest neighbours by largest inner product: NN-descent builds a graph, greedy search reads it.

Vectors that are equal are one node. The graph starts from exact neighbours within random-hyperplane
buckets. Each round of NN-descent is a pair of Spark joins: sampled edges fetch their ends' codes,
every node compares its neighbours (and those it is a neighbour of) with each other, and what beats
a node's worst neighbour goes to that node. Only pairs with an edge that is new since the last round
are compared. Rounds end when few edges change. A search starts at the query's own node and keeps a
beam: each round expands its best unexpanded nodes by a join with the graph.

Graph and beam compare vectors in single precision, packed as bytes: four a component on an edge's
way; the beam that is left is compared exactly, in double precision, on the original vectors. Work per node depends on `k`, `sample` and `beam` alone.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no
part, nor do those of another length than most; null ids neither; rows that share a query's id are no
candidates of it, and an id with several vectors asks with, and is found by, the nearest of them; fewer
candidates than `top` give fewer rows; an empty table gives none; other columns give way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm import common
from tidemark.operators.graphs import spread_join

#: Nodes that one group of a task holds: small, so that groups spread evenly over tasks.
BLOCK = 256
#: Pairs that ask for one node's code, from which on that code is broadcast.
HOT = 4096


def usable(vector: str) -> Column:
    """Whether a vector takes part in comparisons."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _decode(codes: pd.Series, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(codes), np.float32).reshape(len(codes), dim)


def nodes_of(vectors: DataFrame, dim: int) -> DataFrame:
    """node and its code, the vector in single precision, of (node, vec)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            codes = [np.asarray(v, np.float32).tobytes() for v in pdf["vec"]]
            yield pd.DataFrame({"node": pdf["node"].to_numpy(), "code": pd.Series(codes, dtype=object)})

    return vectors.mapInPandas(run, "node long, code binary")


def best(owner: np.ndarray, other: np.ndarray, score: np.ndarray, k: int, old: np.ndarray | None = None) -> np.ndarray:
    """Indices of each owner's k best distinct others, sorted by owner and falling score (ties: smaller other).

    Of entries for one pair, one marked old comes first.
    """
    keys = (~old if old is not None else np.zeros(len(owner), bool), other, owner)
    o = np.lexsort(keys)
    a, b = owner[o], other[o]
    o = o[np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]] if len(o) else o
    o = o[np.lexsort((other[o], -score[o], owner[o]))]
    a = owner[o]
    first = np.searchsorted(a, a)
    return o[np.arange(len(a)) - first < k]


def _mixed(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    """A hash of id pairs, the same on every run."""
    with np.errstate(over="ignore"):
        x = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ (b.astype(np.uint64) + np.uint64(salt)) * np.uint64(0xC2B2AE3D27D4EB4F)
        x ^= x >> np.uint64(31)
        x *= np.uint64(0x94D049BB133111EB)
        return x ^ x >> np.uint64(29)


def _sampled(owner: np.ndarray, other: np.ndarray, new: np.ndarray, sample: int, salt: int) -> np.ndarray:
    """Per edge 1 if it is among its owner's sampled new edges, 2 among the old ones, else 0."""
    pick = np.zeros(len(owner), np.int8)
    h = _mixed(owner, other, salt)
    for mark, part in ((1, np.flatnonzero(new)), (2, np.flatnonzero(~new))):
        o = part[np.lexsort((h[part], owner[part]))]
        rank = np.arange(len(o)) - np.searchsorted(owner[o], owner[o])
        pick[o[rank < sample]] = mark
    return pick


def _edges(owner, other, score, new, k: int, sample: int, salt: int) -> pd.DataFrame:
    """A node's k best edges, with what the next round samples. Sampled new edges are new no more."""
    o = best(owner, other, score, k, ~new)
    owner, other, score, new = owner[o], other[o], score[o], new[o]
    pick = _sampled(owner, other, new, sample, salt)
    size = np.searchsorted(owner, owner, "right") - np.searchsorted(owner, owner)
    last = np.searchsorted(owner, owner, "right") - 1
    worst = np.where(size >= k, score[last], -np.inf).astype(np.float32)
    return pd.DataFrame({"v": owner, "u": other, "score": score.astype(np.float32), "new": new & (pick != 1), "pick": pick, "worst": worst})


_EDGE = "v long, u long, score float, new boolean, pick byte, worst float"


def _block(column: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(blocks)).cast("int")


def first_graph(nodes: DataFrame, n: int, dim: int, k: int, sample: int, trees: int, bucket: int, seed: int) -> DataFrame:
    """Edges to the best others within random-hyperplane buckets of about `bucket` nodes."""
    depth = max(0, int(np.ceil(np.log2(max(1, n / bucket)))))
    planes = np.random.default_rng(seed).standard_normal((trees, depth, dim)).astype(np.float32)
    names = ["node", "code"]

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            v = _decode(pdf["code"], dim)
            for t in range(trees):
                signs = (v @ planes[t].T > 0) @ (1 << np.arange(depth, dtype=np.int64))
                yield pdf.assign(tree=t, bucket=signs)[["tree", "bucket", *names]]

    dealt = nodes.mapInPandas(hashed, "tree int, bucket long, node long, code binary")
    sizes = dealt.groupBy("tree", "bucket").agg(F.count(F.lit(1)).alias("n"))
    # A bucket that many nodes share is dealt out by a hash: rounds of descent join its parts.
    dealt = dealt.join(sizes, ["tree", "bucket"]).withColumn("part", F.pmod(F.xxhash64("node", "tree"), F.ceil(F.col("n") / (2 * bucket))))

    def within(pdf: pd.DataFrame) -> pd.DataFrame:
        v, ids = _decode(pdf["code"], dim), pdf["node"].to_numpy()
        m = min(k, len(ids) - 1)
        if m < 1:
            return pd.DataFrame({"v": ids[:0], "u": ids[:0], "score": np.zeros(0, np.float32)})
        out = []
        for at in range(0, len(ids), 1024):
            s = v[at : at + 1024] @ v.T
            s[np.arange(len(s)), np.arange(at, at + len(s))] = -np.inf
            j = np.argpartition(-s, m - 1, axis=1)[:, :m]
            out.append(pd.DataFrame({"v": np.repeat(ids[at : at + 1024], m), "u": ids[j].ravel(), "score": np.take_along_axis(s, j, 1).ravel()}))
        return pd.concat(out)

    found = dealt.groupBy("tree", "bucket", "part").applyInPandas(within, "v long, u long, score float")
    blocks = max(1, -(-n // BLOCK))

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        return _edges(*(pdf[c].to_numpy() for c in ("v", "u", "score")), np.ones(len(pdf), bool), k, sample, seed)

    return found.withColumn("block", _block("v", blocks)).groupBy("block").applyInPandas(merge, _EDGE)


def descend(edges: DataFrame, nodes: DataFrame, n: int, dim: int, k: int, sample: int, salt: int) -> DataFrame:
    """One round of NN-descent: the edges after neighbours of neighbours have met."""
    blocks = max(1, -(-n // BLOCK))
    known = nodes.join(edges.groupBy("v").agg(F.max("worst").alias("worst")).withColumnRenamed("v", "node"), "node", "left").na.fill(float("-inf"), ["worst"])
    picked = edges.where("pick > 0").select("v", "u", "pick")
    # A node meets those it points at and `sample` of those that point at it: of a node that all point at,
    # each task hands on no more than that many.
    w = Window.partitionBy("u", "pick").orderBy(F.xxhash64("v", F.lit(salt)), "v")
    back = picked.withColumn("r", F.row_number().over(w)).where(F.col("r") <= sample)
    pairs = picked.select(F.col("v").alias("at"), F.col("u").alias("node"), "pick", F.lit(False).alias("back")).union(back.select("u", "v", "pick", F.lit(True)))
    # Codes of nodes that very many pairs ask for go to the pairs.
    asked = known.join(pairs.groupBy("node").agg(F.count(F.lit(1)).alias("n")), "node")
    met = spread_join(pairs, "node", asked, 2 * k * n, HOT).withColumn("block", _block("at", blocks))

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        at, node, pick, back = (pdf[c].to_numpy() for c in ("at", "node", "pick", "back"))
        v, worst = _decode(pdf["code"], dim), pdf["worst"].to_numpy()
        owners, group = np.unique(at, return_inverse=True)
        h = _mixed(at, node, salt)
        slots = []
        for mark in (1, 2):
            table = np.full((len(owners), 2 * sample), -1, np.int64)
            for side in (False, True):
                part = np.flatnonzero((pick == mark) & (back == side))
                o = part[np.lexsort((h[part], group[part]))]
                rank = np.arange(len(o)) - np.searchsorted(group[o], group[o])
                ok = rank < sample
                table[group[o[ok]], rank[ok] + sample * side] = o[ok]
            slots.append(table)
        held: list[tuple] = []
        waiting = 0

        def squeeze() -> None:
            nonlocal held, waiting
            a, b, s = (np.concatenate(x) for x in zip(*held))
            o = best(a, b, s, k)
            held, waiting = [(a[o], b[o], s[o])], 0

        for lo in range(0, len(owners), 256):
            new = slots[0][lo : lo + 256]
            all_ = np.concatenate([new, slots[1][lo : lo + 256]], axis=1)
            x, y = v[new], v[all_]
            s = x @ y.transpose(0, 2, 1)
            ok = (new >= 0)[:, :, None] & (all_ >= 0)[:, None, :] & (node[new][:, :, None] != node[all_][:, None, :])
            for to_new in (True, False):
                bar = worst[new][:, :, None] if to_new else worst[all_][:, None, :]
                i, a, b = np.nonzero(ok & (s > bar))
                one, two = node[new[i, a]], node[all_[i, b]]
                held.append((one, two, s[i, a, b]) if to_new else (two, one, s[i, a, b]))
                waiting += len(i)
            if waiting > 2_000_000:
                squeeze()
        if not held:
            return pd.DataFrame({"v": node[:0], "u": node[:0], "score": np.zeros(0, np.float32)})
        squeeze()
        a, b, s = held[0]
        return pd.DataFrame({"v": a, "u": b, "score": s.astype(np.float32)})

    found = met.groupBy("block").applyInPandas(meet, "v long, u long, score float")
    every = edges.select("v", "u", "score", "new", F.lit(False).alias("found")).union(found.select("v", "u", "score", F.lit(True), F.lit(True)))

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        v, u, s, new, found = (pdf[c].to_numpy() for c in ("v", "u", "score", "new", "found"))
        # A pair that is known keeps its mark; one that was dropped and is found again is new.
        return _edges(v, u, s, np.where(found, True, new), k, sample, salt)

    return every.withColumn("block", _block("v", blocks)).groupBy("block").applyInPandas(merge, _EDGE)


def graph(nodes: DataFrame, n: int, dim: int, k: int = 56, sample: int = 24, trees: int = 8, bucket: int = 1024, rounds: int = 8, settled: float = 0.06, seed: int = 42) -> DataFrame:
    """Edges (v, u, score) to each node's k approximate best. Ends when under `settled` of the edges are new."""
    edges = common.cut(first_graph(nodes, n, dim, k, sample, trees, bucket, seed), "graph")
    for r in range(rounds):
        total, fresh = edges.agg(F.count(F.lit(1)), F.sum((F.col("new") | (F.col("pick") == 1)).cast("long"))).first()
        if not total or fresh <= settled * total:
            break
        after = common.cut(descend(edges, nodes, n, dim, k, sample, seed + r + 1), "graph")
        common.drop(edges)
        edges = after
    return edges.select("v", "u", "score")


def greedy(edges: DataFrame, nodes: DataFrame, starts: DataFrame, n: int, dim: int, beam: int = 96, expand: int = 24, rounds: int = 3) -> DataFrame:
    """(q, node, score): the beam of each query node in starts (q) after `rounds` expansions over the graph."""
    blocks = max(1, -(-n // BLOCK))

    def kept(q, node, s, done) -> pd.DataFrame:
        o = best(q, node, s, beam, done)
        q, node, s, done = q[o], node[o], s[o], done[o]
        wait = np.flatnonzero(~done)
        rank = np.arange(len(wait)) - np.searchsorted(q[wait], q[wait])
        front = np.zeros(len(q), bool)
        front[wait[rank < expand]] = True
        return pd.DataFrame({"q": q, "node": node, "score": s, "done": done | front, "front": front})

    schema = "q long, node long, score float, done boolean, front boolean"
    own = starts.join(edges, starts["q"] == edges["v"]).select("q", F.col("u").alias("node"), "score").withColumn("block", _block("q", blocks))

    def begin(pdf: pd.DataFrame) -> pd.DataFrame:
        return kept(pdf["q"].to_numpy(), pdf["node"].to_numpy(), pdf["score"].to_numpy(), np.zeros(len(pdf), bool))

    state = common.cut(own.groupBy("block").applyInPandas(begin, schema), "beam")
    asks = starts.join(nodes.withColumnRenamed("node", "q"), "q").withColumn("block", _block("q", blocks))
    for _ in range(rounds):
        front = state.where("front").select("q", F.col("node").alias("v"))
        near = front.join(edges.select("v", F.col("u").alias("node")), "v").select("q", "node").where("q <> node").distinct()
        near = near.join(state.select("q", "node"), ["q", "node"], "left_anti").join(nodes, "node")
        # One group holds a block's queries (code 0), its beams (1) and what was reached (2).
        three = (
            asks.select(F.lit(0).alias("part"), "q", F.col("q").alias("node"), F.lit(0.0).cast("float").alias("score"), F.lit(False).alias("done"), "code")
            .union(state.select(F.lit(1), "q", "node", "score", "done", F.lit(None).cast("binary")))
            .union(near.select(F.lit(2), "q", "node", F.lit(0.0).cast("float"), F.lit(False), "code"))
        )

        def step(pdf: pd.DataFrame) -> pd.DataFrame:
            part = pdf["part"].to_numpy()
            asked, beams, got = (pdf[part == i] for i in range(3))
            ids, place = np.unique(asked["q"].to_numpy(), return_index=True)
            q = _decode(asked["code"], dim)[place]
            at = np.searchsorted(ids, got["q"].to_numpy())
            score = np.zeros(len(got), np.float32)
            for lo in range(0, len(got), 100_000):
                s = slice(lo, lo + 100_000)
                score[s] = np.einsum("ij,ij->i", q[at[s]], _decode(got["code"].iloc[s], dim))
            both = [np.concatenate([beams[c].to_numpy(), x]) for c, x in (("q", got["q"].to_numpy()), ("node", got["node"].to_numpy()), ("score", score), ("done", np.zeros(len(got), bool)))]
            return kept(both[0], both[1], both[2].astype(np.float32), both[3].astype(bool))

        after = common.cut(three.withColumn("block", _block("q", blocks)).groupBy("block").applyInPandas(step, schema), "beam")
        common.drop(state)
        state = after
    return state.select("q", "node", "score")


def search(vectors: DataFrame, id_column: str, vector_column: str, is_query: Column, top: int = 20, **options) -> DataFrame:
    """query_id, rank, vec_id, score: the `top` nearest of each query row among all other rows.

    is_query is a condition on the id column. options: k, sample, trees, bucket, rounds, settled, seed
    of graph() and beam, expand, search_rounds of greedy().
    """
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).alias("vec"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.where(F.col("id").isNotNull() & usable("vec")).withColumn("vec", F.transform("vec", lambda x: x.cast("double")))
    sizes = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    dim = sizes[0]["d"] if sizes else 1
    # -0.0 equals 0.0 in comparisons, so it is one and the same component.
    rows = common.cut(rows.where(F.size("vec") == dim).withColumn("vec", F.transform("vec", lambda x: x + F.lit(0.0))), "vectors")
    # Distinct vectors are the nodes. A query needs no more than top + 1 members of any of them.
    # Such a node is known by its row in a stored table: an id may come with several vectors.
    classes = common.cut(rows.groupBy("vec").agg(F.min("id").alias("least")), "classes")
    classes = common.cut(classes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    member = rows.join(classes, "vec").select("id", "node", "asks").distinct()
    member = common.cut(member, "members")
    n = classes.count()
    nodes = common.cut(nodes_of(classes.select("node", "vec"), dim), "codes")
    own = {x: options[x] for x in ("k", "sample", "trees", "bucket", "rounds", "settled", "seed") if x in options}
    edges = graph(nodes, n, dim, **own)
    starts = member.where("asks").select(F.col("node").alias("q")).distinct()
    walk = {"beam": options.get("beam", 96), "expand": options.get("expand", 24), "rounds": options.get("search_rounds", 3)}
    beam = greedy(edges, nodes, starts, n, dim, **walk).select("q", "node").union(starts.select("q", F.col("q").alias("node")))
    # The beam on the original vectors, in double precision.
    exact = beam.join(classes.withColumnRenamed("vec", "b"), "node").join(classes.select(F.col("node").alias("q"), F.col("vec").alias("a")), "q")
    dot = F.aggregate(F.zip_with("a", "b", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    exact = exact.select("q", "node", "least", dot.alias("score"))
    asked = member.where("asks").select(F.col("node").alias("q"), F.col("id").alias("query_id")).distinct()
    # Vectors of the id that has most: so many entries of a list may be one row's.
    most = member.groupBy("id").count().agg(F.max("count")).first()[0] or 1
    # First the nodes that can hold a query's top: then their members, then the top of these.
    by_node = Window.partitionBy("q").orderBy(F.desc("score"), "least", "node")
    exact = exact.withColumn("r", F.row_number().over(by_node)).where(F.col("r") <= (top + 1) * most).drop("r", "least")
    few = Window.partitionBy("node").orderBy("id")
    listed = member.select("node", "id").distinct().withColumn("r", F.row_number().over(few)).where(F.col("r") <= top + 1).drop("r")
    # Queries of one node share its list; each leaves itself out.
    lists = exact.join(listed, "node").groupBy("q", "id").agg(F.max("score").alias("score"))
    lists = lists.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))).where(F.col("r") <= top + 1).drop("r")
    out = asked.join(lists, "q").where("query_id <> id").groupBy("query_id", "id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select("query_id", "rank", F.col("id").alias("vec_id"), "score")
