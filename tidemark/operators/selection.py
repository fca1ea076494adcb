"""Selections: references to fetch, top shares, reproducible samples, quotas, splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import order as O


def unresolved(posts: DataFrame, reference: str, known: DataFrame) -> DataFrame:
    """References (ref) of posts to posts that known does not hold."""
    refs = posts.where(F.col(reference).isNotNull()).select(F.col(reference).alias("ref"))
    return refs.join(known.select(F.col("platform_post_id").alias("ref")), "ref", "left_anti")


def top_share(df: DataFrame, column: str, q: float) -> DataFrame:
    """Rows at or over the q-quantile (linear) of column."""
    cut = df.agg(F.percentile(column, F.lit(q)).alias("_cut"))
    return df.crossJoin(F.broadcast(cut)).where(F.col(column) >= F.col("_cut")).drop("_cut")


def hash_order(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows in an order that looks random and is the same on every run."""
    return df.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)


def stratified(df: DataFrame, stratum: str, key: str, n: int, seed: int) -> DataFrame:
    """About n rows in proportion to strata, one of each at least."""
    sizes = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("_n"))
    total = df.agg(F.count(F.lit(1)).alias("_all"))
    quota = sizes.crossJoin(F.broadcast(total)).select(stratum, F.greatest(F.lit(1), F.bround(n * F.col("_n") / F.col("_all"), 0).cast("int")).alias("_q"))
    own = placed(df, stratum, key, seed).join(F.broadcast(quota.withColumnRenamed(stratum, "_s")), F.col(stratum).eqNullSafe(F.col("_s")))
    return own.where("_r < _q").select(*df.columns)


def placed(df: DataFrame, stratum: str, key: str, seed: int) -> DataFrame:
    """df with _r, a row's place (from 0) in its stratum in hash order, and _n, the stratum's rows."""
    placed = O.numbered(df, F.col(stratum), F.xxhash64(F.lit(seed), F.col(key)), F.col(key), out="_p")
    own = placed.groupBy(F.col(stratum).alias("_t")).agg(F.min("_p").alias("_first"), F.count(F.lit(1)).alias("_n"))
    return placed.join(F.broadcast(own), F.col(stratum).eqNullSafe(F.col("_t"))).withColumn("_r", F.col("_p") - F.col("_first")).drop("_p", "_first", "_t")


def quotas(sizes: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """total dealt out in proportion to size, remainders to the largest fractions (ties by key): key, quota."""
    share = F.col(size) * F.lit(float(total)) / F.sum(size).over(Window.partitionBy(F.lit(1)))  # one row per stratum
    x = sizes.withColumn("x", share).withColumn("lo", F.floor("x"))
    w = Window.orderBy(F.desc(F.col("x") - F.col("lo")), key)
    left = F.lit(total) - F.sum("lo").over(Window.partitionBy(F.lit(1)))
    return x.select(key, (F.col("lo") + (F.row_number().over(w) <= left).cast("int")).cast("long").alias("quota"))


def split(df: DataFrame, key: str, stratum: str, shares: dict[str, float], seed: int) -> DataFrame:
    """df with a column split: within each stratum, rows in hash order fill the named shares in turn."""
    out, edge = None, 0.0
    for name, s in shares.items():
        edge += s
        out = F.when(F.col("_p") <= edge, name) if out is None else out.when(F.col("_p") <= edge, name)
    own = placed(df, stratum, key, seed).withColumn("_p", (F.col("_r") + 0.5) / F.col("_n"))
    return own.withColumn("split", out.otherwise(list(shares)[-1])).select(*df.columns, "split")


def by_priority(pools: Sequence[DataFrame], key: str, limits: Sequence[int], order: Sequence) -> DataFrame:
    """Rows of pools in turn, up to each one's limit, no key twice; column pool tells the first that had it."""
    every = None
    for i, (pool, limit) in enumerate(zip(pools, limits)):
        fresh = pool if every is None else pool.join(every.select(key), key, "left_anti")
        own = fresh.orderBy(*order).limit(limit).withColumn("pool", F.lit(i))
        every = own if every is None else every.unionByName(own)
    return every


def capped(df: DataFrame, key: str, n: int, *order) -> DataFrame:
    """The first n rows of each key."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def reservoir(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows, each set of n as likely as any other and the same on every run: those of the smallest hashes."""
    return hash_order(df, key, n, seed)


def high_on_both(df: DataFrame, one: str, two: str, q: float = 0.9, rank: float = 0.9) -> DataFrame:
    """Rows over the q-quantile of one whose two is over rank."""
    cut = df.agg(F.percentile(one, F.lit(q)).alias("_cut"))
    return df.crossJoin(F.broadcast(cut)).where((F.col(one) > F.col("_cut")) & (F.col(two) > rank)).drop("_cut")


def first_per(df: DataFrame, key: str, *order) -> DataFrame:
    """The first row of each key in the order."""
    return capped(df, key, 1, *order)


def distinct_terms(*columns: DataFrame) -> DataFrame:
    """Distinct terms of frames with one array column each, exploded and in lower case."""
    every = None
    for d in columns:
        own = d.select(F.explode(d.columns[0]).alias("term")).select(F.lower("term").alias("term"))
        every = own if every is None else every.union(own)
    return every.where("term is not null and term <> ''").distinct()
