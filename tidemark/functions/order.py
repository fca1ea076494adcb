"""Order over whole tables without one task that sees them all: numbering, running sums, ranks.

Window functions without a partition key send every row to one task. These deal rows by ranges of the
order and add up the ranges' sizes, of which there are as many as partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_folder(spark: SparkSession) -> str:
    """The folder for what is stored on the way, which driver and executors share: the one spark.checkpoint.dir names.

    Only a local master may do without that setting: elsewhere a folder of our own would be each machine's own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile

        base = tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """df after a checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        base = shared_folder(df.sparkSession)
        if not context.getCheckpointDir():
            context.setCheckpointDir(base)
    return df.checkpoint()


def numbered(df: DataFrame, *order: Column | str, out: str = "_n") -> DataFrame:
    """df with each row's place (from 0) in the order. Rows equal in all of order stay in one range."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    dealt = dealt.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    dealt = checkpointed(dealt)  # ranges come from a sample: they are fixed before sizes are taken
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    base = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_s")).select("_part", F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_base"))
    return dealt.join(F.broadcast(base), "_part").withColumn(out, (F.col("_base") + F.col("_at")).cast("long")).drop("_part", "_at", "_base")


def running(df: DataFrame, column: str, value: str, out: str, by: Sequence[str] = (), ranges: int = 64) -> DataFrame:
    """df (stored, one row per by and column) with the sum of value over column's values up to its own, within by.

    column is a number; df is read twice, for bounds of ranges and for the sums.
    """
    bounds = df.agg(F.percentile_approx(F.col(column).cast("double"), [i / ranges for i in range(1, ranges)], 1000).alias("b")).first()["b"] or []
    bounds = F.array(*map(F.lit, sorted(set(bounds)))) if bounds else F.array().cast("array<double>")
    own = df.withColumn("_b", F.size(F.filter(bounds, lambda b: b < F.col(column))))
    upto = Window.partitionBy(*by, "_b").orderBy(column).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    base = own.groupBy(*by, "_b").agg(F.sum(value).alias("_s")).withColumn("_base", F.coalesce(F.sum("_s").over(earlier), F.lit(0)))
    base = base.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("_b").alias("_bb"), "_base")
    same = F.col("_b") == F.col("_bb")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return own.withColumn("_u", F.sum(value).over(upto)).join(base, same).withColumn(out, F.col("_base") + F.col("_u")).drop("_b", "_bb", "_base", "_u", *[f"_{c}" for c in by])


def value_counts(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Per by and non-null value: _n rows, _upto rows up to it, _total rows of by."""
    counts = checkpointed(df.where(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count(F.lit(1)).alias("_n")))
    total = counts.groupBy(*[F.col(c).alias(f"_{c}") for c in by]).agg(F.sum("_n").alias("_total"))
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    ranked = running(counts, column, "_n", "_upto", by)
    ranked = ranked.join(F.broadcast(total) if not by else total, same) if by else ranked.crossJoin(F.broadcast(total))
    return ranked.drop(*[f"_{c}" for c in by])


def with_rank(df: DataFrame, column: str, rank: Column, out: str, by: Sequence[str] = ()) -> DataFrame:
    """df with out, an expression of _n, _upto and _total of the row's value; null for a null value."""
    ranked = value_counts(df, column, by).select(*[F.col(c).alias(f"_r_{c}") for c in by], F.col(column).alias("_r_v"), rank.alias(out))
    same = F.col(column) == F.col("_r_v")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    return df.join(ranked, same, "left").drop("_r_v", *[f"_r_{c}" for c in by])


def with_percent_rank(df: DataFrame, column: str, out: str, by: Sequence[str] = ()) -> DataFrame:
    """As percent_rank() over by ordered by column: rows below over all other rows (0 for a row alone)."""
    return with_rank(df, column, F.coalesce(F.try_divide(F.col("_upto") - F.col("_n"), F.col("_total") - 1), F.lit(0.0)), out, by)
