"""Pairs of accounts counted in blocks: the co-actions themselves are never shuffled, spilled or stored.

Accounts are dealt into blocks and every two blocks meet in one task, which has all actions of both. So a
pair's count is final where it is made, and what is shuffled is each action once a block. For actions that
meet few others the join of network.project is cheaper; see network.project for the choice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Co-actions of a task, actions of a block, and co-actions held at a time.
TASK, BLOCK, HELD = 128_000_000, 2_000_000, 4_000_000


def blocks_for(actions: int, coactions: int, known: int = 0) -> int:
    """Blocks so that a task has bounded co-actions, actions and known pairs, and small jobs still have some tasks."""
    spread = min(8, (2 * coactions / HELD) ** 0.5)
    return max(1, *(-int(-x // 1) for x in ((2 * coactions / TASK) ** 0.5, actions / BLOCK, spread, (2 * known / BLOCK) ** 0.5)))


def _spread(rows: DataFrame, b: int, *columns: str) -> DataFrame:
    """Each row of an account (column a) to the tasks of its block with every block, as p = place of (i, j), i <= j."""
    own = F.pmod(F.xxhash64("a"), F.lit(b)).cast("int")
    other = rows.withColumn("_o", own).withColumn("_x", F.explode(F.sequence(F.lit(0), F.lit(b - 1))))
    return other.select(_place(F.col("_o"), F.col("_x")).alias("p"), *columns)


def _place(x, y):
    return (F.greatest(x, y) * (F.greatest(x, y) + 1) / 2 + F.least(x, y)).cast("int")


def _whole(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    held = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(held) if held else None


def _coded(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """Codes of a column's values in their ascending order (strings by UTF-8 bytes), and the values."""
    d = column.dictionary_encode().combine_chunks()
    d = d.chunk(0) if isinstance(d, pa.ChunkedArray) else d
    order = pc.array_sort_indices(d.dictionary)
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    return rank[d.indices.to_numpy()], d.dictionary.take(order)


class _Side:
    """Actions sorted by object and time, to find those within reach of another side's."""

    def __init__(self, who: np.ndarray, obj: np.ndarray, at: np.ndarray):
        order = np.lexsort((at, obj))
        self.who, self.obj, self.at = who[order], obj[order], at[order]


def _reach(a: _Side, b: _Side, delta: float | None) -> tuple[np.ndarray, np.ndarray]:
    """Per action of a the range of b's actions on its object that may be within delta; the gap decides later."""
    if delta is None:
        return np.searchsorted(b.obj, a.obj, "left"), np.searchsorted(b.obj, a.obj, "right")
    start = min(a.at.min(), b.at.min())
    span = max(a.at.max(), b.at.max()) - start + 4 * delta + 8
    unit = max(1e-3, span * (int(max(a.obj.max(), b.obj.max())) + 2) / 2**61)
    width = int(span / unit) + 8
    tick = lambda obj, at: obj * width + np.floor((at - start + 2 * delta + 4) / unit).astype(np.int64)
    keys = tick(b.obj, b.at)
    return np.searchsorted(keys, tick(a.obj, a.at - delta) - 1, "left"), np.searchsorted(keys, tick(a.obj, a.at + delta) + 1, "right")


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys start."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _per_object(key: np.ndarray, obj: np.ndarray, n: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.lexsort((obj, key))
    key, obj, n, gap = key[order], obj[order], n[order], gap[order]
    at = _runs(key, obj)
    return key[at], obj[at], np.add.reduceat(n, at), np.fmin.reduceat(gap, at)


def counted(a: _Side, b: _Side, same: bool, delta: float | None, detail: bool, m: int, held: int = HELD) -> Iterator[tuple[np.ndarray, ...]]:
    """(key, coactions, objects, gap) of the pairs of one account of a and one of b, in chunks of whole accounts of a.

    key is src * m + dst of the m accounts' codes, src < dst. objects and gap are None without detail. same: a
    and b are one block. A chunk that one account overfills is counted in pieces, per object, and then merged.
    """
    if not len(a.who) or not len(b.who):
        return
    lo, hi = _reach(a, b, delta)
    order = np.argsort(a.who, kind="stable")  # by account, then object and time
    order = order[hi[order] > lo[order]]
    if not len(order):
        return
    who, lo, n = a.who[order], lo[order], (hi - lo)[order]
    done = np.cumsum(n)

    def piece(s: slice) -> tuple[np.ndarray, ...]:
        k, e = n[s], order[s]
        total = int(k.sum())
        other = np.arange(total) + np.repeat(lo[s] - (np.cumsum(k) - k), k)
        x, y = np.repeat(who[s], k), b.who[other]
        ok = x < y if same else np.ones(total, bool)
        gap = None
        if delta is not None or detail:
            gap = np.abs(np.repeat(a.at[e], k) - b.at[other])
            if delta is not None:
                ok &= gap <= delta
        x, y = x[ok], y[ok]
        key = np.minimum(x, y) * m + np.maximum(x, y)
        return key, (np.repeat(a.obj[e], k)[ok] if detail else None), (gap[ok] if detail else None)

    starts = np.append(_runs(who), len(who))  # chunks end at accounts
    before = np.append(0, done)
    at = 0
    while at < len(starts) - 1:
        to = int(np.searchsorted(before[starts], before[starts[at]] + held, "right")) - 1
        to = max(to, at + 1)
        first, last = int(starts[at]), int(starts[to])
        at = to
        if before[last] - before[first] <= held:
            key, obj, gap = piece(slice(first, last))
            if not len(key):
                continue
            if not detail:
                key.sort()
                s = _runs(key)
                yield key[s], np.diff(np.append(s, len(key))), None, None
                continue
            key, obj, k, gap = _per_object(key, obj, np.ones(len(key), np.int64), gap)
        else:
            parts, i = [], first
            while i < last:
                j = max(i + 1, int(np.searchsorted(before, before[i] + held, "right")) - 1)
                j = min(j, last)
                key, obj, gap = piece(slice(i, j))
                if len(key):
                    none = np.zeros(len(key))
                    parts.append(_per_object(key, none if obj is None else obj, np.ones(len(key), np.int64), none if gap is None else gap))
                i = j
            if not parts:
                continue
            key, obj, k, gap = _per_object(*(np.concatenate(c) for c in zip(*parts)))
        s = _runs(key)
        yield key[s], np.add.reduceat(k, s), np.diff(np.append(s, len(key))), np.fmin.reduceat(gap, s)


def _sides(who: np.ndarray, obj: np.ndarray, at: np.ndarray, blocks: np.ndarray, timed: bool) -> tuple[_Side, _Side, bool]:
    """The two blocks' actions, and whether they are one block; actions without a time meet none where times count."""
    if timed:
        own = ~np.isnan(at)
        who, obj, at, blocks = who[own], obj[own], at[own], blocks[own]
    first = blocks == blocks.min(initial=2**31 - 1)
    if first.all():
        side = _Side(who, obj, at)
        return side, side, True
    return _Side(who[first], obj[first], at[first]), _Side(who[~first], obj[~first], at[~first]), False


def _diagonal(p: int) -> bool:
    """Whether task p is of one block with itself."""
    j = int(((8 * p + 1) ** 0.5 - 1) / 2)
    while j * (j + 1) // 2 > p:
        j -= 1
    while (j + 1) * (j + 2) // 2 <= p:
        j += 1
    return p == j * (j + 1) // 2 + j


#: A step on a task's batches, and the schema of what it gives.
Step = tuple[Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], str]


def pairs(actions: DataFrame, blocks: int, delta: float | None, least: int, detail: bool = True, then: Step | None = None) -> DataFrame:
    """(src, dst, n_objects_shared, n_coactions, min_gap) of actions (a, b, at: account, object, seconds); src < dst.

    Pairs have at least `least` co-actions, or with no delta as many shared objects. Without detail, which
    needs a delta, only src, dst and n_coactions. With `then`, what that makes of each task's pairs.
    """
    b = blocks
    kind = dict(actions.dtypes)["a"]
    dealt = _spread(actions.withColumn("k", F.pmod(F.xxhash64("a"), F.lit(b)).cast("int")), b, "a", "b", "at", "k")
    detail = detail or delta is None
    fields = ["src", "dst", "n_coactions"] + (["n_objects_shared", "min_gap"] if detail else [])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tab = _whole(batches)
        if tab is None:
            return
        diagonal = _diagonal(tab.column("p")[0].as_py())
        who, names = _coded(tab.column("a"))
        obj = _coded(tab.column("b"))[0]
        at, k = (tab.column(c).to_numpy() for c in ("at", "k"))
        del tab
        x, y, same = _sides(who, obj, at, k, delta is not None)
        if same and not diagonal:
            return  # the other block has no actions: its own task has these pairs
        m = len(names)
        del who, obj, at, k
        for key, n, objects, gap in counted(x, y, same, delta, detail, m):
            ok = np.flatnonzero((n if delta is not None else objects) >= least)
            for s in range(0, len(ok), 100_000):
                i = ok[s : s + 100_000]
                cols = [names.take(pa.array(key[i] // m)), names.take(pa.array(key[i] % m)), pa.array(n[i].astype(np.int64))]
                if detail:
                    cols += [pa.array(objects[i].astype(np.int64)), pa.array(gap[i], from_pandas=True)]
                yield pa.RecordBatch.from_arrays(cols, names=fields)

    more = ", n_objects_shared long, min_gap double" if detail else ""
    tasks = b * (b + 1) // 2
    if then:
        return dealt.repartitionById(tasks, F.col("p")).mapInArrow(lambda batches: then[0](meet(batches)), then[1])
    return dealt.repartitionById(tasks, F.col("p")).mapInArrow(meet, f"src {kind}, dst {kind}, n_coactions long{more}")


#: Pairs of a task of tallied_by_object.
COUNTED = 4_000_000


def tallied_by_object(actions: DataFrame, accounts: int, coactions: float, least: int, then: Step) -> DataFrame:
    """What `then` makes of the pairs (src, dst, n_objects_shared) of distinct actions (a, b), a a number below accounts.

    For actions that meet few others: an object's pairs are made in its task and handed on as packed numbers,
    8 bytes a co-action, in a few rows a task; so they cost neither rows nor strings.
    """
    tasks = max(8, int(coactions // COUNTED) + 1)
    if accounts >= 2**31:
        raise ValueError("too many accounts for packed pairs")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tab = _whole(batches)
        if tab is None:
            return
        obj, who = _coded(tab.column("b"))[0], tab.column("a").to_numpy()
        del tab
        order = np.lexsort((who, obj))
        obj, who = obj[order], who[order]
        starts = _runs(obj)
        later = np.repeat(np.append(starts[1:], len(obj)), np.diff(np.append(starts, len(obj)))) - np.arange(len(obj)) - 1
        done = np.append(0, np.cumsum(later))
        at = 0
        while at < len(who):
            to = max(at + 1, int(np.searchsorted(done, done[at] + HELD, "right")) - 1)
            k = later[at:to]
            i = np.repeat(np.arange(at, to), k)
            at = to
            if not len(i):
                continue
            key = who[i] * accounts + who[i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(k) - k, k)]
            key.sort()
            s = _runs(key)
            n = np.diff(np.append(s, len(key))).astype(np.int32)
            key = key[s]
            home = (_mixed(key, 1) % np.uint64(tasks)).astype(np.int64)
            order = np.argsort(home, kind="stable")
            key, n, home = key[order], n[order], home[order]
            cut = np.append(_runs(home), len(home))
            once = bool((n == 1).all())  # no count is sent where all are one
            spans = [slice(a, b) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
            for a in range(0, len(spans), 64):
                own = spans[a : a + 64]
                yield pa.RecordBatch.from_arrays([pa.array(home[[c.start for c in own]].astype(np.int32)), pa.array([key[c].tobytes() for c in own], pa.binary()), pa.array([b"" if once else n[c].tobytes() for c in own], pa.binary())], names=["p", "keys", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = [], []
        for batch in batches:
            for k, n in zip(batch.column("keys"), batch.column("n")):
                keys.append(np.frombuffer(k.as_py(), np.int64))
                counts.append(np.frombuffer(n.as_py(), np.int32) if len(n.as_py()) else np.ones(len(keys[-1]), np.int32))
        if not keys:
            return
        key, n = np.concatenate(keys), np.concatenate(counts)
        del keys, counts
        order = np.argsort(key)
        key, n = key[order], n[order].astype(np.int64)
        s = _runs(key)
        key, n = key[s], np.add.reduceat(n, s)
        ok = n >= least
        key, n = key[ok], n[ok]
        for at in range(0, len(key), 1_000_000):
            k = key[at : at + 1_000_000]
            yield pa.RecordBatch.from_arrays([pa.array(k // accounts), pa.array(k % accounts), pa.array(n[at : at + 1_000_000])], names=["src", "dst", "n_objects_shared"])

    by_object = max(8, int(coactions // (4 * COUNTED)) + 1)
    made = actions.select("a", "b").repartition(by_object, "b").mapInArrow(make, "p int, keys binary, n binary")
    return made.repartitionById(tasks, F.col("p")).mapInArrow(lambda batches: then[0](count(batches)), then[1])


def _mixed(h: np.ndarray, rep: int) -> np.ndarray:
    """64-bit hashes mixed with a replicate's number."""
    with np.errstate(over="ignore"):
        x = h.astype(np.uint64) ^ np.uint64((rep * 0x9E3779B97F4A7C15) & (2**64 - 1))
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        return x ^ x >> np.uint64(31)


def _dense(a: _Side, b: _Side, same: bool, src: np.ndarray, dst: np.ndarray, m: int) -> np.ndarray:
    """Shared objects of the pairs (src, dst) by products of account-object tables, a stripe of accounts at a time."""
    names = np.unique(np.concatenate([a.obj, b.obj]))
    wa, wb = np.unique(a.who), np.unique(b.who)
    right = np.zeros((len(wb), len(names)), np.float32)
    right[np.searchsorted(wb, b.who), np.searchsorted(names, b.obj)] = 1
    # Of a pair one account is of a; in one block either may be, and src is taken.
    flip = np.zeros(len(src), bool) if same else ~np.isin(src, wa)
    x, y = np.where(flip, dst, src), np.where(flip, src, dst)
    fit = np.isin(x, wa) & np.isin(y, wb)
    out = np.zeros(len(src), np.int64)
    order = np.flatnonzero(fit)
    order = order[np.argsort(x[order], kind="stable")]
    xi, yi = np.searchsorted(wa, x[order]), np.searchsorted(wb, y[order])
    at, on = np.searchsorted(wa, a.who), np.searchsorted(names, a.obj)
    by = np.argsort(at, kind="stable")
    at, on = at[by], on[by]
    step = max(1, HELD // max(1, len(wb)))
    for s in range(0, len(wa), step):
        lo, hi = np.searchsorted(at, (s, s + step))
        e, f = np.searchsorted(xi, (s, s + step))
        if e == f:
            continue
        left = np.zeros((min(step, len(wa) - s), len(names)), np.float32)
        left[at[lo:hi] - s, on[lo:hi]] = 1
        out[order[e:f]] = np.rint((left @ right.T)[xi[e:f] - s, yi[e:f]])
    return out


def exceedances(actions: DataFrame, edges: DataFrame, blocks: int, delta: float | None, redealt: int = 0) -> DataFrame:
    """(src, dst, exceed): in how many replicates an edge (src, dst, weight) has at least its weight; zeros left out.

    actions are (a, b, at) with rep, the replicate. With redealt, they are the real ones without rep but with a
    random long h each, and in each of so many replicates an account's times are dealt anew among its actions,
    in the order of h mixed with the replicate's number: alike in every task that has the account.
    """
    b = blocks
    kind = dict(actions.dtypes)["a"]
    number = "h" if redealt else "rep"
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(b)).cast("int")
    acts = _spread(actions.withColumn("k", block("a")), b, "a", F.col("b").cast("string").alias("b"), "at", "k", F.col(number).cast("long").alias("h"))
    known = edges.select(_place(block("src"), block("dst")).alias("p"), F.col("src").alias("a"), F.col("dst").cast("string").alias("b"), F.col("weight").cast("double").alias("at"), F.lit(-1).alias("k"), F.lit(0).cast("long").alias("h"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tab = _whole(batches)
        if tab is None:
            return
        k = tab.column("k").to_numpy()
        ends = np.flatnonzero(k < 0)
        if not len(ends) or len(ends) == len(k):
            return
        rest = np.flatnonzero(k >= 0)
        some = tab.take(pa.array(ends))
        both = pa.chunked_array([*tab.column("a").take(pa.array(rest)).chunks, *some.column("a").chunks, *some.column("b").chunks])
        who, names = _coded(both)
        m = len(names)
        src, dst = who[len(rest) : len(rest) + len(ends)], who[len(rest) + len(ends) :]
        who = who[: len(rest)]
        weight = some.column("at").to_numpy()
        acts = tab.take(pa.array(rest))
        obj = _coded(acts.column("b"))[0]
        at, h, k = acts.column("at").to_numpy(), acts.column("h").to_numpy(), k[rest]
        diagonal = _diagonal(tab.column("p")[0].as_py())
        del tab, acts, some, both
        wanted = src * m + dst
        by = np.argsort(wanted)
        src, dst, weight, wanted = src[by], dst[by], weight[by], wanted[by]
        exceed = np.zeros(len(wanted), np.int64)
        if redealt:
            by = np.lexsort((at, obj, who))
            who, obj, at, h, k = who[by], obj[by], at[by], h[by], k[by]
            reps = range(redealt)
        else:
            by = np.argsort(h, kind="stable")
            who, obj, at, h, k = who[by], obj[by], at[by], h[by], k[by]
            cuts = np.append(_runs(h), len(h))
            reps = range(len(cuts) - 1)
        for r in reps:
            if redealt:
                x, y, same = _sides(who, obj, at[np.lexsort((_mixed(h, r), who))], k, delta is not None)
            else:
                s = slice(cuts[r], cuts[r + 1])
                x, y, same = _sides(who[s], obj[s], at[s], k[s], delta is not None)
            if same and not diagonal:
                continue
            if delta is None and _is_dense(x, y):
                exceed += _dense(x, y, same, src, dst, m) >= weight
                continue
            for key, n, objects, _ in counted(x, y, same, delta, False, m):
                i = np.searchsorted(wanted, key)
                ok = (i < len(wanted)) & (wanted[np.minimum(i, len(wanted) - 1)] == key)
                i = i[ok]
                exceed[i] += n[ok] >= weight[i]
        ok = np.flatnonzero(exceed)
        for s in range(0, len(ok), 100_000):
            i = ok[s : s + 100_000]
            yield pa.RecordBatch.from_arrays([names.take(pa.array(src[i])), names.take(pa.array(dst[i])), pa.array(exceed[i])], names=["src", "dst", "exceed"])

    tasks = b * (b + 1) // 2
    return acts.unionByName(known).repartitionById(tasks, F.col("p")).mapInArrow(meet, f"src {kind}, dst {kind}, exceed long")


def _is_dense(a: _Side, b: _Side) -> bool:
    """Whether products of whole tables cost less than meeting action by action, and both tables are small."""
    objects = len(np.unique(np.concatenate([a.obj, b.obj])))
    accounts = len(np.unique(b.who))
    return accounts * objects <= 32_000_000 and accounts * objects <= 100 * len(b.who)
