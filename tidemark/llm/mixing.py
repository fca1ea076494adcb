"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source is cut into blocks of about `block_words` words by a hash of the row. A source's draws are
whole passes over its permuted blocks, then a part of a pass whose last block is cut at a document; its
quota is the number of these draws. A tree over the output shards splits the vector of quotas: at each
node the left half's share is one multivariate-hypergeometric draw, so quotas are met exactly and every
shard is a random sample of the mix. A leaf owns, of each source, a run of its permuted draws: disjoint
blocks, whose documents the shard orders locally by a hash. What a document gives to the mix is what the
leaves' draws of its block take.

The tree grows level by level in Spark, a node of LEVEL halvings a task and only sources that a node
draws from; nothing is held on the driver but one row of sums per round of the targets.

Defined results: null text has size 0; null sources are one source, ordered last; repeated rows that
agree in id, source and text are taken alike; a null id is an id like any other; an empty table gives no
rows; columns of docs whose names clash with added ones give way.
"""

from __future__ import annotations

from math import lgamma

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm import common

WEIGHTS = (5.0, 2.0, 1.0)
#: A source has no more blocks than this: they are larger where it has more words.
MAX_BLOCKS = 65_536
#: Halvings of a tree node that one task does.
LEVEL = 3
#: Sources up to which their table is broadcast; over it, it is dealt out with SALTS copies of a row.
BROADCAST_SOURCES, SALTS = 100_000, 64


def hypergeometric(good: int, bad: int, n: int, rng: np.random.Generator) -> int:
    """Good ones among n drawn of good + bad, of any size: numpy's sampler stops at a billion."""
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, n))
    low, high = max(0, n - bad), min(n, good)
    total = good + bad
    mode = min(max((n + 1) * (good + 1) // (total + 2), low), high)
    spread = int(40 * (n * (good / total) * (bad / total) * ((total - n) / max(1, total - 1))) ** 0.5) + 40
    k = np.arange(max(low, mode - spread), min(high, mode + spread) + 1, dtype=float)
    # Chances relative to one another, by the ratio of neighbours.
    step = np.log((good - k[:-1]) * (n - k[:-1])) - np.log((k[:-1] + 1) * (bad - n + k[:-1] + 1))
    log = np.concatenate([[0.0], np.cumsum(step)])
    chance = np.cumsum(np.exp(log - log.max()))
    return int(k[np.searchsorted(chance, rng.random() * chance[-1], "right")])


def multivariate(own: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """How many of each colour are among n drawn, own[i] being of colour i."""
    total = int(own.sum())
    if total < 10**9:
        return rng.multivariate_hypergeometric(own, n, method="marginals")
    if len(own) == 1:
        return np.array([n], np.int64)
    mid = len(own) // 2
    left = hypergeometric(int(own[:mid].sum()), int(own[mid:].sum()), n, rng)
    return np.concatenate([multivariate(own[:mid], left, rng), multivariate(own[mid:], n - left, rng)])


def split_node(lo: int, hi: int, source: np.ndarray, first: np.ndarray, quota: np.ndarray, levels: int, seed: int) -> pd.DataFrame:
    """The nodes `levels` halvings below the node of shards lo <= s < hi: lo, hi, source_no, first, quota.

    A node draws `quota` of each source's draws, from number `first` on. Its share of all draws is its
    share of the shards, so leaves' sizes differ by one at most.
    """
    out, stack = [], [(lo, hi, source, first, quota, levels)]
    while stack:
        a, b, s, f, q, left = stack.pop()
        if b - a == 1 or not left:
            out.append(pd.DataFrame({"lo": a, "hi": b, "source_no": s, "first": f, "quota": q}))
            continue
        mid = (a + b) // 2
        part = multivariate(q, int(q.sum()) * (mid - a) // (b - a), np.random.default_rng([seed, a, b]))
        rest = q - part
        for x, y, start, own in ((a, mid, f, part), (mid, b, f + part, rest)):
            some = own > 0
            stack.append((x, y, s[some], start[some], own[some], left - 1))
    return pd.concat(out)


_NODE = "lo long, hi long, source_no long, first long, quota long"


class Mix:
    """A mix of docs. The plan is made when the object is; documents() and rows() apply it."""

    def __init__(self, docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0, block_words: int = 100_000, shard_words: int = 8_000_000, seed: int = 42):
        if not weights or min(weights) <= 0:
            raise ValueError("weights have to be positive")
        self.seed, self.docs = seed, docs
        sized = docs.select("doc_id", "source", self.size().alias("size"), self.key().alias("_key"))
        self.sized = common.cut(sized, "sized")
        self._targets(weights, share, cap, block_words)
        self._blocks()
        total = self.sources.agg(F.sum("target")).first()[0] or 0.0
        self.shards = max(1, round(float(total) / shard_words))
        self._tree()

    @staticmethod
    def size() -> Column:
        return F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")

    def key(self, *more: Column) -> Column:
        return F.xxhash64(F.lit(self.seed), F.col("doc_id"), F.xxhash64("text"), *more)

    def _targets(self, weights: tuple[float, ...], share: float, cap: float, block_words: int) -> None:
        """self.sources: source_no, source, source_size, target, passes, rest, n_blocks.

        share of all sizes is dealt out by weight to the sources in order; no target exceeds cap times
        its source's size, and the excess is dealt anew until none does.
        """
        own = common.cut(self.sized.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
        # Nulls last, and a source per row: numbered by range partitions and their counts.
        last = F.col("source").isNull().cast("int")
        ordered = common.cut(common.in_order(own.withColumn("_last", last), "_last", "source"), "sources")
        first = common.before(ordered.groupBy("shard").agg(F.count(F.lit(1)).alias("n")), "n")
        numbered = ordered.join(F.broadcast(first), "shard").withColumn("source_no", F.col("base") + F.row_number().over(Window.partitionBy("shard").orderBy("at")) - 1)
        weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("source_no", F.lit(len(weights))) + 1).cast("int"))
        own = common.cut(numbered.select("source_no", "source", "source_size", weight.alias("w"), (F.lit(float(cap)) * F.col("source_size")).alias("most")), "sources")
        self.n_sources, words, all_w = own.agg(F.count(F.lit(1)), F.sum("source_size"), F.sum("w")).first()
        words, all_w = float(words or 0), all_w or 0.0
        # The level of a weight of one only rises, so what it fills once stays full.
        full, left, w = 0, share * words, all_w
        while w > 0:
            n, filled, gone = own.where(F.lit(left) * F.col("w") / F.lit(w) > F.col("most")).agg(F.count(F.lit(1)), F.sum("most"), F.sum("w")).first()
            if n == full:
                break
            full, left, w = n, share * words - filled, all_w - gone
        level = F.lit(left) * F.col("w") / F.lit(w) if w > 0 else F.col("most")
        target = F.least(level, "most")
        passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + F.lit(1e-12))).otherwise(0).cast("long")
        made = own.withColumn("target", target).withColumn("passes", passes).withColumn("rest", F.greatest(F.col("target") - F.col("passes") * F.col("source_size"), F.lit(0.0)))
        blocks = F.least(F.greatest(F.ceil(F.col("source_size") / block_words), F.lit(1)), F.lit(MAX_BLOCKS)).cast("long")
        self.sources = common.cut(made.withColumn("n_blocks", blocks).drop("w", "most"), "targets")

    def _placed(self, rows: DataFrame) -> DataFrame:
        """rows with their source's columns and their block."""
        of = self.sources.withColumnRenamed("source", "_source")
        if self.n_sources <= BROADCAST_SOURCES:
            out = rows.join(F.broadcast(of), F.col("source").eqNullSafe(F.col("_source")))
        else:  # one source may hold a third of the rows
            salted = of.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            out = rows.withColumn("_part", F.pmod("_key", F.lit(SALTS)).cast("int")).join(salted, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_part") == F.col("_salt"))).drop("_part", "_salt")
        return out.drop("_source").withColumn("block", F.pmod("_key", "n_blocks"))

    def _blocks(self) -> None:
        """self.blocks: per block its draws' passes, and the highest key that the last, partial draw takes (null: none)."""
        placed = self._placed(self.sized)
        made = placed.groupBy("source_no", "block").agg(F.sum("size").alias("words"), F.first("passes").alias("passes"), F.first("rest").alias("rest"))
        order = self._permuted(F.col("passes"))
        made = made.withColumn("_before", F.coalesce(F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        made = common.cut(made.withColumn("_left", F.col("rest") - F.col("_before")), "blocks")
        # One block at most of each source is cut within.
        edge = made.where((F.col("_left") > 0) & (F.col("_left") < F.col("words"))).select("source_no", "block", "_left")
        edge = F.broadcast(edge) if self.n_sources <= BROADCAST_SOURCES else edge
        inside = placed.select("source_no", "block", "_key", "size").join(edge, ["source_no", "block"])
        inside = inside.groupBy("source_no", "block", "_key", "_left").agg(F.sum("size").alias("size"))
        up_to = Window.partitionBy("source_no").orderBy("_key").rowsBetween(Window.unboundedPreceding, 0)
        # A document is in if its middle lies within what is left.
        last = inside.withColumn("_end", F.sum("size").over(up_to)).where(F.col("_end") - F.col("size") / 2 <= F.col("_left"))
        last = last.groupBy("source_no", "block").agg(F.max("_key").alias("_cut"))
        whole = F.when(F.col("_left") >= F.col("words"), F.lit((1 << 63) - 1))
        out = made.join(last, ["source_no", "block"], "left").withColumn("_cut", F.when(F.col("_left") > 0, F.coalesce(whole, "_cut")))
        self.blocks = common.cut(out.select("source_no", "block", "passes", "_cut"), "draws")
        common.drop(made)

    def _permuted(self, number: Column) -> Window:
        return Window.partitionBy("source_no").orderBy(F.xxhash64(F.lit(self.seed), "source_no", number.cast("long"), "block"), "block")

    def _tree(self) -> None:
        """self.leaves: (shard, source_no, first, quota), the tree's leaves."""
        begun = F.col("passes") + F.col("_cut").isNotNull().cast("long")
        quotas = self.blocks.groupBy("source_no").agg(F.sum(begun).alias("quota")).where("quota > 0")
        nodes = common.cut(quotas.select(F.lit(0).cast("long").alias("lo"), F.lit(self.shards).cast("long").alias("hi"), "source_no", F.lit(0).cast("long").alias("first"), "quota"), "tree")
        seed, width = self.seed, self.shards

        def split(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("source_no")
            return split_node(int(pdf["lo"].iat[0]), int(pdf["hi"].iat[0]), *(pdf[c].to_numpy(np.int64) for c in ("source_no", "first", "quota")), LEVEL, seed)

        while width > 1:
            below = common.cut(nodes.groupBy("lo", "hi").applyInPandas(split, _NODE), "tree")
            common.drop(nodes)
            nodes, width = below, -(-width // 2**LEVEL)
        self.leaves = nodes.select(F.col("lo").alias("shard"), "source_no", "first", "quota")

    def draws(self) -> DataFrame:
        """(source_no, block, pass, shard) of every block draw that a leaf of the tree owns."""
        owned = self.leaves.select("source_no", "shard", F.explode(F.sequence("first", F.col("first") + F.col("quota") - 1)).alias("rank"))
        every = self.blocks.withColumn("_draws", F.col("passes") + F.col("_cut").isNotNull().cast("long")).where("_draws > 0")
        every = every.select("source_no", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_draws") - 1)).alias("pass"))
        # Numbered pass by pass; a pass's blocks are at most MAX_BLOCKS rows.
        per_pass = every.groupBy("source_no", "pass").agg(F.count(F.lit(1)).alias("_n"))
        earlier = Window.partitionBy("source_no").orderBy("pass").rowsBetween(Window.unboundedPreceding, -1)
        per_pass = per_pass.select("source_no", "pass", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_first"))
        order = Window.partitionBy("source_no", "pass").orderBy(F.xxhash64(F.lit(self.seed), "source_no", "pass", "block"), "block")
        ranked = every.withColumn("_at", F.row_number().over(order) - 1).join(per_pass, ["source_no", "pass"])
        return ranked.withColumn("rank", (F.col("_first") + F.col("_at")).cast("long")).join(owned, ["source_no", "rank"]).select("source_no", "block", "pass", "shard")

    def _taken(self) -> DataFrame:
        """Per block: whole draws, and the highest key that its partial draw takes (null: none), of those the leaves own."""
        drawn = self.draws().join(self.blocks, ["source_no", "block"])
        whole = F.col("pass") < F.col("passes")
        return drawn.groupBy("source_no", "block").agg(F.count(F.when(whole, 1)).alias("_whole"), F.max(F.when(~whole, F.col("_cut"))).alias("_last"))

    def rows(self) -> DataFrame:
        """Per row of docs: doc_id, size, source_size, target, taken, copies."""
        placed = self._placed(self.sized).drop("passes")
        out = placed.join(self._taken(), ["source_no", "block"], "left")
        copies = F.coalesce("_whole", F.lit(0)) + F.coalesce((F.col("_key") <= F.col("_last")).cast("long"), F.lit(0))
        out = out.withColumn("copies", copies).withColumn("taken", F.col("size") * F.col("copies"))
        return out.select("doc_id", "size", "source_size", "target", "taken", "copies")

    def documents(self) -> DataFrame:
        """docs with one row per copy that the mix takes, with its shard, in shards and locally shuffled."""
        names = [c for c in self.docs.columns if c not in ("shard", "_key", "source_no", "block", "copies", "pass", "source_size", "target", "passes", "rest", "n_blocks", "_cut")]
        placed = self._placed(self.docs.select(*names, self.key().alias("_key"))).select(*names, "_key", "source_no", "block")
        drawn = self.draws().join(self.blocks, ["source_no", "block"])
        out = placed.join(drawn, ["source_no", "block"]).where((F.col("pass") < F.col("passes")) | (F.col("_key") <= F.col("_cut")))
        n = max(self.shards, common.partitions(self.docs.sparkSession))
        # A shard may be spread over several partitions: none holds more than its part of the words.
        local = F.xxhash64(F.lit(self.seed + 1), "_key", "pass")
        out = out.repartition(n, "shard", F.pmod(local, F.lit(-(-n // self.shards))))
        return out.sortWithinPartitions("shard", local).select(*names, "shard")
