"""SimHash near-duplicates, joined by walking a binary trie of fingerprints against itself.

Two fingerprints within `budget` = 3 bits of each other differ in at most one bit of one of their
halves. So there are two tries: over the fingerprint, with at most one bit spent in its first half,
and over the fingerprint with its halves swapped, likewise. A pair of nodes is walked together, the
bits in which their paths differ add up, and it is dropped as soon as they exceed what the depth
allows. The top of the walk runs on the driver over counts of prefixes, whose length grows with
the table; what is left of it becomes tasks of a pair of nodes each, and these go on with numpy.

Equal fingerprints are one entry of the trie, and a task returns a spanning forest of the links that
it found, never all pairs: no link between different texts is lost, and a large group of copies or
near copies costs rows in proportion to its size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common
from tidemark.llm.components import components, forest

BUDGET = 3
#: Least and largest depth to which the driver walks: it holds at most 2**20 counts.
TOP, DEEPEST = 14, 20
#: Fingerprints of a node below which a pair of nodes becomes one task, as far as the walk is deep enough.
LEAF = 4096
#: Node pairs of this many fingerprint pairs or fewer are compared at once.
SMALL = 64


def fingerprint(text: bytes, width: int = 3) -> int:
    """The unsigned 64-bit fingerprint of a UTF-8 text: majority of XXH64 (seed 42) over word shingles."""
    import xxhash

    words = text.lower().split()  # bytes: lowers A-Z only, splits at ASCII white space only
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    stops = ends[-n:].tolist() if len(words) >= width else [len(joined)]
    digest = xxhash.xxh64_intdigest
    h = np.fromiter([digest(joined[a:b], 42) for a, b in zip(starts, stops)], np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 8192):
        ones += np.unpackbits(h[at : at + 8192].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint (as a signed long) of every row; null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(1).cast(pa.large_binary())
            got = np.array([fingerprint(t.as_py() or b"") for t in text], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got)], names=["doc_id", "fp"])
        common.tidy()

    return common.text_batches(docs.select("doc_id", "text")).mapInArrow(run, common.schema_with(docs, "doc_id", fp="long"))


def allowed(depth: int) -> int:
    """Bits that two paths of `depth` may differ in."""
    return 1 if depth <= 32 else BUDGET


def depth_for(n: int, leaf: int) -> int:
    """Depth of the driver's walk for n fingerprints: even ones would be some sixteen leaves a node."""
    return min(DEEPEST, max(TOP, (n // (16 * leaf)).bit_length()))


def plan(counts: np.ndarray, leaf: int) -> tuple[np.ndarray, list[list[int]], int]:
    """Walk the top of a trie, of which counts has the fingerprints under each prefix of so many bits.

    Returns the node of each prefix, each node's tasks, and the number of tasks. A node is (depth,
    path); nodes where the walk stops form a cut through the trie: the first below which there are
    at most `leaf` fingerprints.
    """
    sums, top = [counts], len(counts).bit_length() - 1
    while len(sums[-1]) > 1:
        sums.append(sums[-1].reshape(-1, 2).sum(axis=1))
    sums.reverse()  # sums[d][path]
    node_of, nodes = np.full(len(counts), -1, np.int64), {}
    stack = [(0, 0)]
    while stack:
        d, p = stack.pop()
        if not sums[d][p]:
            continue
        if sums[d][p] <= leaf or d == top:
            nodes[d, p] = len(nodes)
            node_of[p << (top - d) : (p + 1) << (top - d)] = nodes[d, p]
        else:
            stack += [(d + 1, 2 * p), (d + 1, 2 * p + 1)]
    tasks: list[list[int]] = [[] for _ in nodes]
    made = 0
    walk = [((0, 0), (0, 0), 0)]
    while walk:
        a, b, spent = walk.pop()
        if not sums[a[0]][a[1]] or not sums[b[0]][b[1]]:
            continue
        if a in nodes and b in nodes:
            tasks[nodes[a]].append(made)
            if a != b:
                tasks[nodes[b]].append(made)
            made += 1
            continue
        # One step down for the node that is not at the cut; a node at the cut waits.
        ca = [a] if a in nodes else [(a[0] + 1, 2 * a[1]), (a[0] + 1, 2 * a[1] + 1)]
        cb = [b] if b in nodes else [(b[0] + 1, 2 * b[1]), (b[0] + 1, 2 * b[1] + 1)]
        for i, x in enumerate(ca):
            for j, y in enumerate(cb):
                if a == b and j < i:
                    continue
                d = min(x[0], y[0])
                differ = (x[1] >> (x[0] - d) ^ y[1] >> (y[0] - d)).bit_count()
                if differ <= allowed(d):
                    walk.append((x, y, differ))
    return node_of, tasks, made


def close_pairs(keys: np.ndarray, swapped: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs i < j of sorted distinct uint64 keys that this trie is answerable for, in batches.

    Walks node pairs level by level; a node is a range of keys. Of a swapped trie those pairs count
    that differ in over one bit of the fingerprint's first half (the key's second): others belong to
    the first trie.
    """
    lo_a = np.array([0])
    hi_a = np.array([len(keys)])
    lo_b, hi_b, spent = lo_a.copy(), hi_a.copy(), np.array([0])
    for depth in range(65):
        size = (hi_a - lo_a) * (hi_b - lo_b)
        ready = (size <= SMALL) if depth < 64 else np.ones(len(size), bool)
        if ready.any():
            yield from _compare(keys, lo_a[ready], hi_a[ready], lo_b[ready], hi_b[ready], swapped)
        go = ~ready
        if not go.any():
            return
        lo_a, hi_a, lo_b, hi_b, spent = lo_a[go], hi_a[go], lo_b[go], hi_b[go], spent[go]
        bit = np.uint64(63 - depth)
        # prefix[i]: keys among the first i whose bit is 0; a node's ones follow its zeros.
        zeros = np.concatenate([[0], np.cumsum((keys >> bit & np.uint64(1)) == 0)])
        mid_a, mid_b = lo_a + zeros[hi_a] - zeros[lo_a], lo_b + zeros[hi_b] - zeros[lo_b]
        same = (lo_a == lo_b) & (hi_a == hi_b)
        parts = []
        for a0, a1, b0, b1, cost, keep in (
            (lo_a, mid_a, lo_b, mid_b, 0, None),
            (mid_a, hi_a, mid_b, hi_b, 0, None),
            (lo_a, mid_a, mid_b, hi_b, 1, None),
            (mid_a, hi_a, lo_b, mid_b, 1, ~same),
        ):
            ok = (a1 > a0) & (b1 > b0) & (spent + cost <= allowed(depth + 1))
            if keep is not None:
                ok &= keep
            parts.append((a0[ok], a1[ok], b0[ok], b1[ok], spent[ok] + cost))
        lo_a, hi_a, lo_b, hi_b, spent = (np.concatenate(x) for x in zip(*parts))


def _compare(keys, lo_a, hi_a, lo_b, hi_b, swapped: bool, batch: int = 1 << 21) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    size = (hi_a - lo_a) * (hi_b - lo_b)
    done = np.cumsum(size)
    at = 0
    while at < len(size):
        stop = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + batch, "right")))
        if size[at] > batch:  # one node of equal paths, too large for a batch: row by row of it
            for i in range(lo_a[at], hi_a[at]):
                first = i + 1 if lo_a[at] == lo_b[at] else lo_b[at]
                yield from _close(keys, np.full(hi_b[at] - first, i), np.arange(first, hi_b[at]), swapped)
            at += 1
            continue
        s = size[at:stop]
        k = np.arange(s.sum()) - np.repeat(np.cumsum(s) - s, s)
        width = np.repeat((hi_b - lo_b)[at:stop], s)
        i, j = np.repeat(lo_a[at:stop], s) + k // width, np.repeat(lo_b[at:stop], s) + k % width
        once = np.repeat(lo_a[at:stop] != lo_b[at:stop], s) | (i < j)  # a node with itself: each pair once
        yield from _close(keys, i[once], j[once], swapped)
        at = stop


def _close(keys, i, j, swapped: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    i, j = np.minimum(i, j), np.maximum(i, j)
    x = keys[i] ^ keys[j]
    ok = (i < j) & (np.bitwise_count(x) <= BUDGET) & (np.bitwise_count(x >> np.uint64(32)) <= 1)
    if swapped:
        ok &= np.bitwise_count(x & np.uint64(0xFFFFFFFF)) > 1
    yield i[ok], j[ok]


def swap(fp: np.ndarray) -> np.ndarray:
    return fp << np.uint64(32) | fp >> np.uint64(32)


def links(prints: DataFrame, leaf: int = LEAF) -> DataFrame:
    """A spanning forest (src, dst) of the links between distinct fingerprints `fp` (signed longs).

    Node pairs of both tries are the unit of work: a fingerprint goes to the tasks of its node.
    """
    spark = prints.sparkSession
    rotated = F.shiftleft("fp", 32).bitwiseOR(F.shiftrightunsigned("fp", 32))
    keys = prints.select(F.lit(0).alias("trie"), F.col("fp").alias("key")).union(prints.select(F.lit(1), rotated))
    top = depth_for(prints.count(), leaf)
    prefix = F.shiftrightunsigned("key", 64 - top).cast("int")
    counted = keys.groupBy("trie", prefix.alias("prefix")).count().toPandas()
    plans, first = {}, 0
    for trie in (0, 1):
        own = counted[counted["trie"] == trie]
        counts = np.zeros(1 << top, np.int64)
        counts[own["prefix"].to_numpy()] = own["count"].to_numpy()
        node_of, tasks, made = plan(counts, leaf)
        plans[trie] = node_of, [[t + first for t in x] for x in tasks]
        first += made
    shared = spark.sparkContext.broadcast(plans)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for trie, own in pdf.groupby("trie"):
                node_of, tasks = shared.value[trie]
                key = own["key"].to_numpy(np.int64)
                node = node_of[key.view(np.uint64) >> np.uint64(64 - top)]
                width = np.array([len(x) for x in tasks])
                n = width[node]
                flat = np.array([t for x in tasks for t in x], np.int64)
                start = (np.cumsum(width) - width)[node]
                k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                yield pd.DataFrame({"task": flat[np.repeat(start, n) + k], "node": np.repeat(node, n).astype(np.int32), "key": np.repeat(key, n), "trie": trie})

    def walk(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        swapped = bool(pdf["trie"].iat[0])
        fp = np.sort(pdf["key"].to_numpy(np.int64).view(np.uint64))
        node = shared.value[int(swapped)][0][fp >> np.uint64(64 - top)]
        between = node[0] != node[-1]
        src, dst = [], []
        for i, j in close_pairs(fp, swapped):
            if between:  # pairs within a node are another task's
                cross = node[i] != node[j]
                i, j = i[cross], j[cross]
            a, b = forest(i, j)
            src.append(a)
            dst.append(b)
        a, b = forest(np.concatenate([*src, np.zeros(0, np.int64)]), np.concatenate([*dst, np.zeros(0, np.int64)]))
        back = swap(fp) if swapped else fp
        return pd.DataFrame({"src": back[a].view(np.int64), "dst": back[b].view(np.int64)})

    dealt = keys.mapInPandas(deal, "task long, node int, key long, trie int")
    return dealt.groupBy("task").applyInPandas(walk, "src long, dst long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id: the smallest doc_id reachable by links.

    Defined results: null text has fingerprint 0, as has a text without words; a null doc_id keeps
    its row and counts for no component's smallest id (a component of null ids alone has a null id);
    repeated rows are rows of one component; an empty table gives no rows.
    """
    prints = common.cut(fingerprints(docs), "fingerprints")
    own = common.cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    groups = components(links(own.select("fp")))
    labelled = own.join(groups.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    smallest = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    ids = labelled.join(smallest, "component").select("fp", "component_id")
    return prints.join(ids, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame) -> DataFrame:
    """docs with one row of each component: the one with the smallest doc_id.

    Of rows that share that id one stays; a null id counts as the smallest.
    """
    docs = common.cut(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    found = near_duplicates(docs.select(F.struct("doc_id", "_row").alias("doc_id"), "text"))
    keep = found.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id._row").alias("_row"))
    return docs.join(keep, "_row", "left_semi").drop("_row")
