"""Tables of append-only runs in a shared store: scans, latest states, typed sinks, ledgers."""

from __future__ import annotations

import time
import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.latest import latest, newest_run
from tidemark.sources.schemas import TABLES


def full_schema(name: str) -> T.StructType:
    """Declared columns and partition columns of a table."""
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}, expected one of {sorted(TABLES)}")
    own = T._parse_datatype_string(TABLES[name][0])
    return T.StructType(own.fields + [T.StructField(c, T.DateType() if c == "dt" else T.StringType()) for c in TABLES[name][1]])


class Catalog:
    """base holds one folder per table, Hive-partitioned, to which every run appends.

    Reads take the declared superset schema, so a column that came later is null in older files and
    types never drift. A table that nobody wrote yet reads as empty. Filters on partition columns
    prune folders.
    """

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def exists(self, name: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def table(self, name: str, **where: str) -> DataFrame:
        """All rows of a table; where gives values of partition columns (platform="x", type="search")."""
        schema = full_schema(name)
        unknown = set(where) - set(TABLES[name][1])
        if unknown:
            raise ValueError(f"{name} is not partitioned by {sorted(unknown)}")
        try:
            df = self.spark.read.schema(schema).parquet(self.path(name)) if self.exists(name) else self.spark.createDataFrame([], schema)
        except AnalysisException:
            df = self.spark.createDataFrame([], schema)
        for column, value in where.items():
            df = df.where(F.col(column) == value)
        return df

    def latest(self, name: str, **where: str) -> DataFrame:
        """The latest state: newest row per key; for stories the newest run; series as they are, in order."""
        _, _, key, order = TABLES[name]
        df = self.table(name, **where)
        if name == "stories":
            return newest_run(df, order)
        return latest(df, key, order) if key else df.orderBy(order)

    def append(self, name: str, df: DataFrame, even_if_empty: bool = False) -> int:
        """Add a run, cast to the declared schema; missing columns are null. Returns its rows.

        An empty run writes nothing unless even_if_empty, for audit tables where a zero is a signal.
        Rows are brought together by partition first, large ones split by their size, so that a run adds
        a file per partition and not one per task and partition.
        """
        schema, (_, parts, _, order) = full_schema(name), TABLES[name]
        have = set(df.columns)
        needed = [c for c in parts if c != "dt" and c not in have]
        if needed:
            raise ValueError(f"{name} needs the partition columns {needed}")
        day = F.to_date("dt") if "dt" in have else F.to_date(F.coalesce(F.col(order), F.current_timestamp()) if order in have else F.current_timestamp())
        out = df.select(*[(day if f.name == "dt" else F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])
        seen = out.persist()
        try:
            n = seen.count()
            if n or even_if_empty:
                seen.hint("rebalance", *parts).write.mode("append").option("compression", "zstd").partitionBy(*parts).parquet(self.path(name))
            return n
        finally:
            seen.unpersist()

    def write_manifest(self, rows: DataFrame, platform: str = "x") -> int:
        """Append the queries of one collection pass as a run of its own; nothing for none. Missing columns are null, counts 0."""
        rows = rows.withColumn("n_posts", F.coalesce("n_posts", F.lit(0))) if "n_posts" in rows.columns else rows.withColumn("n_posts", F.lit(0))
        own = rows.withColumn("run_id", F.lit(uuid.uuid4().hex)).withColumn("platform", F.lit(platform)).withColumn("collected_at", F.current_timestamp())
        return self.append("collection_runs", own)

    def write_census_run(self, stats: dict, platform: str = "x") -> int:
        """Append a pass's counters, a row of zeros too: that nothing was found is a finding."""
        row = {"pass": str(stats.get("pass", "census")), "n_items": int(stats.get("n_items", 0)), "n_rows": int(stats.get("n_rows", 0)), "error": stats.get("error")}
        own = self.spark.createDataFrame([tuple(row.values())], "pass string, n_items long, n_rows long, error string")
        now = F.current_timestamp()
        return self.append("census_runs", own.withColumn("platform", F.lit(platform)).withColumn("started_at", now).withColumn("ended_at", now), even_if_empty=True)

    def replace_state(self, name: str, df: DataFrame) -> DataFrame:
        """Write a small state table as a new version and return it; readers take the newest whole version.

        A version counts once its _SUCCESS mark is there, which is written last: a write that broke off
        is never seen.
        """
        version = f"{self.path('state/' + name)}/version={time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(version)
        return self.spark.read.parquet(version)

    def state(self, name: str) -> DataFrame | None:
        if not self.exists(f"state/{name}"):
            return None
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(f"state/{name}"))
        fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        versions = sorted(str(s.getPath()) for s in fs.listStatus(folder) if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")))
        return self.spark.read.parquet(versions[-1]) if versions else None

    def columns(self, name: str) -> list[str]:
        """The columns that a table's files have now, which may be fewer than declared; none if nobody wrote it."""
        return self.spark.read.option("mergeSchema", "true").parquet(self.path(name)).columns if self.exists(name) else []

    def register(self, name: str, rows) -> DataFrame:
        """A view over rows in memory: pandas, Arrow, or a list of dicts."""
        df = self.spark.createDataFrame(rows)
        df.createOrReplaceTempView(name)
        return df

    def query(self, sql: str) -> DataFrame:
        """Ad-hoc SQL over views of all tables; a slash in a name becomes an underscore."""
        for name in TABLES:
            self.table(name).createOrReplaceTempView(name.replace("/", "_"))
        return self.spark.sql(sql)

    def healthy(self) -> bool:
        """Write one row, read it, count it."""
        probe = f"{self.base}/_probe/{uuid.uuid4().hex}"
        self.spark.range(1).write.parquet(probe)
        ok = self.spark.read.parquet(probe).count() == 1
        p = self.spark._jvm.org.apache.hadoop.fs.Path(probe)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
        return ok


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_artifact(df: DataFrame, path: str, kind: str = "csv") -> None:
    """A finding as one folder of CSV or Parquet."""
    if kind not in ("csv", "parquet"):
        raise ValueError(f"unknown kind {kind!r}")
    write_csv(df, path) if kind == "csv" else df.write.mode("overwrite").parquet(path)


def read_jsonl(spark: SparkSession, path: str, schema: str, key: str, strict: bool = False) -> DataFrame:
    """JSON lines with one row per key: the last file's, or an error on repeats if strict."""
    df = spark.read.schema(schema).json(path)
    if strict:
        twice = df.groupBy(key).count().where("count > 1").limit(1).collect()
        if twice:
            raise ValueError(f"{key} {twice[0][0]!r} occurs more than once")
        return df
    return latest(df.withColumn("_file", F.input_file_name()), (key,), "_file").drop("_file")


def read_yaml(path: str) -> dict:
    """A small register. Only the subset in use: nested mappings and lists of plain values by indentation."""
    try:
        import yaml
    except ImportError:
        return _plain_yaml(open(path, encoding="utf-8").read())
    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f) or {}


def _plain_yaml(text: str) -> dict:
    root: dict = {}
    stack: list[tuple[int, object, object, object]] = [(-1, root, None, None)]
    for raw in text.splitlines():
        line = raw.split(" #")[0].rstrip()
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        depth, body = len(line) - len(line.lstrip()), line.strip()
        while stack[-1][0] >= depth and not (body.startswith("- ") and stack[-1][0] == depth and isinstance(stack[-1][1], dict) and stack[-1][1] == {}):
            stack.pop()
        _, holder, parent, key = stack[-1]
        if body.startswith("- "):
            if isinstance(holder, dict) and parent is not None:
                holder = parent[key] = [] if not isinstance(parent[key], list) else parent[key]
                stack[-1] = (stack[-1][0], holder, parent, key)
            holder.append(body[2:].strip().strip("\"'"))
            continue
        name, _, value = body.partition(":")
        if value.strip():
            holder[name.strip()] = value.strip().strip("\"'")
        else:
            holder[name.strip()] = {}
            stack.append((depth, holder[name.strip()], holder, name.strip()))
    return root


def view_names(tables: Sequence[str] = tuple(TABLES)) -> list[str]:
    return [t.replace("/", "_") for t in tables]
