"""What the operators of this subpackage share: tables in the shared folder and global positions."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_OWN: dict[str, str] = {}
_WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share.

    Only where that is unset and the master is local (tests, a single machine) a folder of our own is made.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        base = _OWN[app]
    return f"{base.rstrip('/')}/tidemark-llm"


def cut(df: DataFrame, tag: str) -> DataFrame:
    """df written as a Parquet table in the shared folder and read again.

    Cuts the lineage so that a lost executor costs a reread and not a recomputation, and fixes the
    row order within files, on which later ids may be based.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _WRITTEN.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tidemark_path = path
    return out


def drop(table: DataFrame | None) -> None:
    """Delete a table that cut() wrote and that nothing reads any more."""
    path = getattr(table, "_tidemark_path", None)
    if path:
        _delete(table.sparkSession, path)
        _WRITTEN.remove(path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def sweep(spark: SparkSession) -> None:
    """Delete every table that cut() wrote in this process. Call it when the results are stored."""
    while _WRITTEN:
        _delete(spark, _WRITTEN.pop())


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a batch that Arrow hands to Python: whole texts are long, and both sides hold a batch or two.
TEXT_ROWS = 2000


def text_batches(df: DataFrame) -> DataFrame:
    """df, after its session was told to hand texts to Python in batches of at most TEXT_ROWS rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(df.sparkSession.conf.get(key))
    if now <= 0 or now > TEXT_ROWS:
        df.sparkSession.conf.set(key, str(TEXT_ROWS))
    return df


def tidy() -> None:
    """Give back what a finished task freed: Python workers live on, and their memory counts."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def in_order(df: DataFrame, *keys: str, parts: int | None = None) -> DataFrame:
    """df range-partitioned and sorted by keys (nulls first), with columns `shard` and `at`.

    Rows in order of (shard, at) are in order of keys. A key that many rows share is split among
    partitions: df has to be a table from cut(), whose row ids do not change from run to run. Bounds
    come from a sample that differs from plan to plan: read the result once, or cut() it.
    """
    n = parts or partitions(df.sparkSession)
    dealt = df.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(n, *[F.col(k) for k in keys], F.col("_row"))
    return (
        dealt.sortWithinPartitions(*keys, "_row")
        .withColumn("shard", F.spark_partition_id())
        .withColumn("at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_row")
    )


def before(totals: DataFrame, value: str) -> DataFrame:
    """totals (one row per shard) with `base`, the sum of value over all earlier shards.

    One row per shard, thus few: a single task adds them up.
    """
    from pyspark.sql.window import Window

    w = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("shard", F.coalesce(F.sum(value).over(w), F.lit(0)).cast("long").alias("base"))


def schema_with(df: DataFrame, *names: str, **more: str) -> T.StructType:
    """The fields called names of df, then those in more (name=DDL type)."""
    own = [T.StructField(n, df.schema[n].dataType) for n in names]
    return T.StructType(own + T._parse_datatype_string(", ".join(f"`{k}` {v}" for k, v in more.items())).fields)
