"""Vectors: cosine, centroids, nearest rows, radius links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def normalised(a: Column) -> Column:
    n = norm(a)
    return F.transform(a, lambda x: F.try_divide(x.cast("double"), n))


def centroids(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Per key the mean vector, its length (the cohesion of unit members) and the number of members.

    Sums by component, so a large group is pre-aggregated and never gathered.
    """
    parts = df.select(key, F.posexplode(vector).alias("i", "x")).groupBy(key, "i").agg(F.avg("x").alias("x"), F.count(F.lit(1)).alias("n"))
    out = parts.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("c"), F.max("n").alias("n"))
    mean = F.transform("c", lambda s: s["x"])
    return out.select(key, "n", mean.alias("centroid")).withColumn("cohesion", norm(F.col("centroid")))


def mean_pairwise(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Mean cosine over all pairs of a group, from sums alone: (|sum|^2 - n) / (n (n - 1)) of unit vectors."""
    unit = df.select(key, normalised(F.col(vector)).alias("v"))
    own = centroids(unit, key, "v")
    n = F.col("n").cast("double")
    return own.where("n > 1").select(key, "n", ((F.col("cohesion") * n) ** 2 - n).alias("_s")).select(key, "n", (F.col("_s") / (F.col("n") * (F.col("n") - 1.0))).alias("mean_cosine"))


def nearest(queries: DataFrame, rows: DataFrame, k: int, decimals: int = 6, block: int = 4096, rows_block: int = 32_768) -> DataFrame:
    """query_id, id, sim: the k rows nearest by cosine to each query, itself apart; ties by id.

    A stated set of queries against all rows, in blocks: a task compares one block of each and keeps k a
    query, a tile of the rows at a time, and these are merged. A task's memory is fixed by the blocks and does
    not grow with the tables; neither side is ever on the driver.
    """
    asks, all_rows = queries.select("id", "vec"), rows.select("id", "vec")
    nq, nr = max(1, -(-asks.count() // block)), max(1, -(-all_rows.count() // rows_block))
    part = lambda df, n: df.withColumn("_p", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = part(asks, nq).withColumnRenamed("_p", "i").withColumn("j", each(nr))
    r = part(all_rows, nr).withColumnRenamed("_p", "j").withColumn("i", each(nq))

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        ids, own = (x.column("id").to_numpy() for x in (a, b))
        if not len(ids) or not len(own):
            return _found(*(np.zeros(0, t) for t in (np.int64, np.int64, float)))
        v, w = (_unit(_matrix(x.column("vec").combine_chunks())) for x in (a, b))
        out = []
        for at in range(0, len(ids), 256):
            asked = ids[at : at + 256]
            best = tuple(np.zeros(0, t) for t in (np.int64, np.int64, float))  # place of the query, id, sim
            for to in range(0, len(own), TOP_TILE):
                there = own[to : to + TOP_TILE]
                s = np.round(v[at : at + 256] @ w[to : to + TOP_TILE].T, decimals)
                s[asked[:, None] == there[None]] = -np.inf
                s[np.isnan(s)] = -np.inf
                m = min(k, len(there))
                bar = np.partition(s, len(there) - m, axis=1)[:, len(there) - m]
                i, j = np.nonzero((s >= bar[:, None]) & (s > -np.inf))  # ties at the bar are in
                best = _top(*(np.concatenate(c) for c in zip(best, (i, there[j], s[i, j]))), k)
            out.append((asked[best[0]], *best[1:]))
        return _found(*(np.concatenate(c) for c in zip(*out)))

    w = Window.partitionBy("query_id").orderBy(F.desc("sim"), "id")
    found = q.groupBy("i", "j").cogroup(r.groupBy("i", "j")).applyInArrow(meet, "query_id long, id long, sim double")
    return found.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


#: Rows that nearest compares with at a time.
TOP_TILE = 4096


def _unit(v: np.ndarray) -> np.ndarray:
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
    return v


def _found(query: np.ndarray, ids: np.ndarray, sim: np.ndarray) -> pa.Table:
    return pa.table({"query_id": pa.array(query, pa.int64()), "id": pa.array(ids, pa.int64()), "sim": pa.array(sim, pa.float64())})


def _top(query: np.ndarray, ids: np.ndarray, sim: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k of each query with the largest sim, ties to the smaller id."""
    order = np.lexsort((ids, -sim, query))
    query = query[order]
    start = np.searchsorted(query, query)
    order = order[np.arange(len(order)) - start < k]
    return query[np.arange(len(query)) - start < k], ids[order], sim[order]


#: Rows of a block of radius_links, and rows to a side of the tiles in which two blocks are compared.
RADIUS_BLOCK, TILE = 16_384, 1024


def radius_links(df: DataFrame, least: float, blocks: int | None = None) -> DataFrame:
    """(src, dst, sim) of all pairs of (id, vec) with cosine >= least: every two blocks of rows meet in a task.

    Exact, and the work is that of all pairs, as the radius graph's is, done in matrix products. Blocks have
    a fixed size and links are handed out tile by tile, so a task's memory does not grow with the table. Rows
    without a vector link with nothing. For large tables prefer the filter join of near-duplicate search.
    """
    rows = df.count()
    n = blocks or max(1, -(-rows // RADIUS_BLOCK), min(8, rows // 2048))
    own = df.where("id is not null and vec is not null").select("id", "vec", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("b"))
    i, j = F.least("b", "o"), F.greatest("b", "o")
    spread = own.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select((j * (j + 1) / 2 + i).cast("int").alias("p"), (i == j).alias("one"), "id", "vec", "b")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column("b").to_numpy(), b.column("id").to_numpy(), _matrix(b.column("vec")), b.column("one")[0].as_py()) for b in batches if b.num_rows]
        if not held:
            return
        block, ids, v = (np.concatenate([h[k] for h in held]) for k in range(3))
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
        first, one = block == block.min(), held[0][3]
        del held
        if one:
            (x, y), (w, u) = (ids, ids), (v, v)
        else:
            (x, y), (w, u) = (ids[first], ids[~first]), (v[first], v[~first])
        for s in range(0, len(x), TILE):
            for t in range(0, len(y), TILE):
                sim = w[s : s + TILE] @ u[t : t + TILE].T
                a, b = np.nonzero(sim >= least)
                src, dst, sim = x[s + a], y[t + b], sim[a, b]
                if one:
                    ok = src < dst
                    src, dst, sim = src[ok], dst[ok], sim[ok]
                for at in range(0, len(src), 100_000):
                    c = slice(at, at + 100_000)
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(src[c], dst[c])), pa.array(np.maximum(src[c], dst[c])), pa.array(sim[c])], names=["src", "dst", "sim"])

    return spread.repartitionById(n * (n + 1) // 2, F.col("p")).mapInArrow(meet, "src long, dst long, sim double")


def _matrix(vectors: pa.ListArray) -> np.ndarray:
    """Vectors of one length as rows of doubles; null components are nan."""
    size = pc.list_value_length(vectors)
    if pc.min(size).as_py() != pc.max(size).as_py():
        raise ValueError("vectors differ in length")
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(vectors), -1)
