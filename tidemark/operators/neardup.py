"""Near-duplicate texts by MinHash over character shingles, verified by Jaccard similarity."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.order import checkpointed
from tidemark.operators import graphs


def shingles(text: str, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's runs of `width` characters, lower case, white space squeezed.

    A shorter text is one shingle.
    """
    points = np.frombuffer(" ".join(text.lower().split()).encode("utf-32-le"), "<u4").astype(np.uint64)
    n = max(1, len(points) - width + 1)
    with np.errstate(over="ignore"):
        h = np.full(n, min(len(points), width), np.uint64)
        for i in range(min(width, len(points))):
            h = (h ^ points[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return np.unique(h)


@cache
def _hashes(permutations: int, seed: int) -> list[tuple[np.uint64, np.uint64]]:
    mul, add = np.random.default_rng(seed).integers(0, 1 << 63, (2, permutations), dtype=np.uint64)
    return list(zip(mul | np.uint64(1), add))


def minhash(sh: np.ndarray, permutations: int, seed: int = 1) -> np.ndarray:
    """The smallest of each of so many hashes of the shingles."""
    x, y, half, out = np.empty_like(sh), np.empty_like(sh), np.uint64(31), np.empty(permutations, np.uint64)
    with np.errstate(over="ignore"):
        for i, (a, b) in enumerate(_hashes(permutations, seed)):
            np.bitwise_xor(sh, b, out=x)
            np.multiply(x, a, out=x)
            np.right_shift(x, half, out=y)
            np.bitwise_xor(x, y, out=x)
            out[i] = x.min()
    return out


def agreements(n: int, least: float, miss: float = 1e-12) -> int:
    """The most a of n such that sets with Jaccard >= least agree in under a of n hashes at most with probability `miss`."""
    tail = 0.0
    for a in range(n + 1):
        tail += math.exp(math.lgamma(n + 1) - math.lgamma(a + 1) - math.lgamma(n - a + 1) + a * math.log(least) + (n - a) * math.log1p(-least)) if least < 1 else float(a == n)
        if tail > miss:
            return a
    return n


#: Rows of a task in which texts meet, and pairs compared at a time.
MEET, PAIRS = 250_000, 200_000


def _runs_of_pairs(starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of places within runs (start, size) of a sorted array, PAIRS or so at a time."""
    place = np.concatenate([np.arange(s, s + n) for s, n in zip(starts.tolist(), sizes.tolist())]) if len(starts) else np.zeros(0, np.int64)
    later = np.repeat(starts + sizes, sizes) - place - 1  # members after each place in its run
    done = np.append(0, np.cumsum(later))
    at = 0
    while at < len(place):
        to = max(at + 1, int(np.searchsorted(done, done[at] + PAIRS, "right")) - 1)
        k = later[at:to]
        i = np.repeat(place[at:to], k)
        yield i, i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(k) - k, k)
        at = to


def clusters(docs: DataFrame, key: str, text: str, least: float = 0.85, bands: int = 20, rows: int = 7, width: int = 5) -> DataFrame:
    """(key, cluster): the smallest key reachable by pairs of texts with Jaccard >= least of their shingles.

    Candidates agree in all rows of some band: at 0.85 a pair is missed four times in 10,000, and at
    0.35, as unrelated texts of a language often are, one pair in a hundred is compared. These are too many
    to be joined to their texts: a text goes to its bands' tasks with a byte of each of its hashes, and only
    pairs that agree in as many as such texts do but once in 1e12 are rows, whose texts are then compared.
    Texts themselves are shuffled only for such pairs. Equal texts are one, so groups of copies cost nothing
    there; a text without words is its own cluster.
    """
    names = F.when(F.length(F.trim(text)) > 0, F.md5(text))  # null where there are no words
    own = docs.select(F.col(key), names.alias("t"))
    classes = checkpointed(own.where("t is not null").groupBy("t").agg(F.min(key).alias("node")))
    worded = docs.select(names.alias("t"), F.col(text).alias("text")).where("t is not null")
    n, enough = bands * rows, agreements(bands * rows, least)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        for batch in batches:
            out: list[tuple] = []
            for t, own in zip(batch.column(0).to_pylist(), batch.column(1)):
                if t in seen:
                    continue
                if len(seen) < 500_000:
                    seen.add(t)
                sig = minhash(shingles(own.as_py(), width), n)
                # Python's hash of a tuple of integers is the same in every process.
                out.append((t, [hash((b, *sig[b * rows : (b + 1) * rows].tolist())) for b in range(bands)], sig.astype(np.uint8).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.list_(pa.int64())), pa.array([o[2] for o in out], pa.binary())], names=["t", "ks", "sketch"])

    signed = checkpointed(worded.mapInArrow(sign, "t string, ks array<long>, sketch binary").dropDuplicates(["t"]))
    parts = max(1, -(-signed.count() * bands // MEET))
    held = signed.select("t", "sketch", F.explode("ks").alias("k"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tabs = [b for b in batches if b.num_rows]
        if not tabs:
            return
        tab = pa.Table.from_batches(tabs)
        k = tab.column("k").to_numpy()
        order = np.argsort(k, kind="stable")
        k = k[order]
        starts = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
        sizes = np.diff(np.append(starts, len(k)))
        crowd = sizes > 1
        sketch = np.frombuffer(b"".join(tab.column("sketch").to_pylist()), np.uint8).reshape(len(k), n)[order]
        t = tab.column("t").combine_chunks()
        t = t.chunk(0) if isinstance(t, pa.ChunkedArray) else t
        del tab, tabs
        for i, j in _runs_of_pairs(starts[crowd], sizes[crowd]):
            ok = (sketch[i] == sketch[j]).sum(axis=1) >= enough
            a, b = t.take(pa.array(order[i[ok]])).to_pylist(), t.take(pa.array(order[j[ok]])).to_pylist()
            if a:
                yield pa.RecordBatch.from_arrays([pa.array([min(x) for x in zip(a, b)]), pa.array([max(x) for x in zip(a, b)])], names=["src", "dst"])

    pairs = checkpointed(held.repartition(parts, "k").mapInArrow(meet, "src string, dst string").where("src < dst").distinct())
    some = pairs.select(F.explode(F.array("src", "dst")).alias("t")).distinct()
    full = checkpointed(worded.join(some, "t", "left_semi").dropDuplicates(["t"]))
    a, b = (full.select(F.col("t").alias(c), F.col("text").alias(f"{c}_text")) for c in ("src", "dst"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("src_text"), batch.column("dst_text")):
                x, y = shingles(x.as_py(), width), shingles(y.as_py(), width)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(both / (len(x) + len(y) - both) >= least)
            yield batch.select(["src", "dst"]).filter(pa.array(ok, pa.bool_()))

    near = pairs.join(a, "src").join(b, "dst").select("src", "dst", "src_text", "dst_text").mapInArrow(verify, "src string, dst string")
    found = graphs.connected_components(near)
    grouped = checkpointed(classes.join(found.withColumnRenamed("node", "t"), "t", "left").select("t", "node", F.coalesce("component", "t").alias("component")))
    smallest = grouped.groupBy("component").agg(F.min("node").alias("cluster"))
    of_text = grouped.join(smallest, "component").select("t", "cluster")
    return own.join(of_text, "t", "left").select(key, F.coalesce("cluster", F.col(key)).alias("cluster"))
