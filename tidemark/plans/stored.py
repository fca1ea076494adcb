"""Queries that go through storage and streams: rows are written by a sink and read back by a source.

Each query writes to a new folder of its own below the shared folder, so that runs never see each other.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.order import shared_folder
from tidemark.operators import latest as L
from tidemark.operators import runs
from tidemark.plans.core import FS, LP
from tidemark.plans.registry import query
from tidemark.plans.tables import AS_OF, Tables
from tidemark.sources.catalog import Catalog, read_csv, read_jsonl, write_artifact, write_csv
from tidemark.streaming import passes


def _n():
    return F.count(F.lit(1)).alias("n")


def _folder(t: Tables) -> str:
    return f"{shared_folder(t.spark)}/stored/{uuid.uuid4().hex}"


def _catalog(t: Tables) -> Catalog:
    return Catalog(t.spark, _folder(t))


def _posts(t: Tables) -> Catalog:
    """A catalog with the post snapshots, as two runs."""
    c = _catalog(t)
    early = F.col("repost_count") % 2 == 0
    for run in (early, ~early):
        c.append("posts", t.posts_raw.where(run))
    return c


def _edges(t: Tables, c: Catalog) -> None:
    """Two runs of one channel's edges, the second with half of the pairs and larger weights."""
    acts = t.acts.groupBy(F.concat(F.lit("u"), F.col("u").cast("string")).alias("src"), F.concat(F.lit("v"), F.col("kind")).alias("dst")).agg(F.count(F.lit(1)).cast("double").alias("weight"), F.max("u").alias("u"))
    own = acts.withColumn("platform", F.lit("x")).withColumn("channel", F.lit("co_url")).withColumn("method", F.lit("bonferroni"))
    c.append("coordination/edges", own.withColumn("computed_at", F.lit("2024-01-30 00:00:00").cast("timestamp")))
    later = own.where("u % 2 = 0").withColumn("weight", F.col("weight") + 100)
    c.append("coordination/edges", later.withColumn("computed_at", F.lit("2024-01-31 00:00:00").cast("timestamp")))


EDGE = "ed AS (SELECT concat('u', CAST(u AS VARCHAR)) AS src, concat('v', kind) AS dst, u, CAST(count(*) AS DOUBLE) AS weight FROM acts GROUP BY u, kind)"


@query("sc01_posts_scan", "posts_raw", "SELECT platform_post_id, epoch_us(collected_at) AS seen_us, like_count, len(hashtags) AS tags FROM posts_raw WHERE type = 'search'")
def _(t: Tables):
    rows = _posts(t).table("posts", platform="x", type="search")
    return rows.select("platform_post_id", F.unix_micros("collected_at").alias("seen_us"), "like_count", F.size("hashtags").alias("tags")).withColumn("tags", F.when(F.col("tags") >= 0, F.col("tags")))


@query("sc02_scores_scan", "scores", "SELECT platform_post_id, label, p_hate, hate_flag, epoch_us(scored_at) AS at_us, CAST(NULL AS VARCHAR) AS domain FROM scores")
def _(t: Tables):
    c = _catalog(t)
    c.append("hatespeech", t.scores.withColumn("platform", F.lit("x")))
    return c.table("hatespeech").select("platform_post_id", "label", "p_hate", "hate_flag", F.unix_micros("scored_at").alias("at_us"), "domain")


@query("sc03_edges_scan", "acts", f"{EDGE} SELECT src, dst, weight FROM ed UNION ALL SELECT src, dst, weight + 100 FROM ed WHERE u % 2 = 0")
def _(t: Tables):
    c = _catalog(t)
    _edges(t, c)
    return c.table("coordination/edges", platform="x", channel="co_url", method="bonferroni").select("src", "dst", "weight")


@query("sc05_views", "posts_raw", "SELECT type, count(*) AS n, (SELECT 0) AS followed FROM posts_raw GROUP BY type")
def _(t: Tables):
    return _posts(t).query("SELECT type, count(*) AS n, (SELECT count(*) FROM follows) AS followed FROM posts GROUP BY type")


@query("sc06_missing_table", "", "SELECT 0 AS n, 0 AS latest_n")
def _(t: Tables):
    c = _catalog(t)
    return c.table("incitement").agg(_n()).crossJoin(c.latest("authors").agg(F.count(F.lit(1)).alias("latest_n")))


@query("sc07_columns", "", "SELECT unnest(['platform_post_id', 'platform_user_id', 'kind', 'collected_at', 'platform', 'dt']) AS name")
def _(t: Tables):
    c = _catalog(t)
    c.append("engagements", t.engagements_raw)
    return t.spark.createDataFrame([(x,) for x in c.columns("engagements")], "name string")


@query("sc08_in_memory", "", "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1")
def _(t: Tables):
    c = _catalog(t)
    c.register("tidemark_in_memory", t.nation.toPandas())
    return c.query("SELECT n_regionkey, count(*) AS n FROM tidemark_in_memory GROUP BY 1")


@query("sc09_csv", "", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def _(t: Tables):
    path = _folder(t)
    write_csv(t.customer.select("c_custkey", "c_name", "c_acctbal"), path)
    return read_csv(t.spark, path, "c_custkey long, c_name string, c_acctbal double")


@query("sc10_json_lines", "", "SELECT CAST(c_custkey AS VARCHAR) AS id, CASE WHEN c_custkey % 3 = 0 THEN 'changed' ELSE c_mktsegment END AS label FROM customer")
def _(t: Tables):
    """Two chunks; of an id that both hold the later one counts."""
    path = _folder(t)
    own = t.customer.select(F.col("c_custkey").cast("string").alias("id"), F.col("c_mktsegment").alias("label"))
    own.write.json(f"{path}/1")
    own.where(F.col("id").cast("long") % 3 == 0).withColumn("label", F.lit("changed")).write.json(f"{path}/2")
    return read_jsonl(t.spark, f"{path}/*", "id string, label string", "id")


@query("sk01_run_sink", "posts_raw", f"{LP} SELECT platform_post_id, type, like_count, strftime(created_at, '%Y-%m-%d') AS day FROM lp")
def _(t: Tables):
    rows = _posts(t).latest("posts", platform="x")
    return rows.select("platform_post_id", "type", "like_count", F.date_format("created_at", "yyyy-MM-dd").alias("day"))


@query("sk03_manifest", "", "SELECT n_name AS term, CAST(CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey ELSE 0 END AS BIGINT) AS n_posts, 1 AS runs FROM nation")
def _(t: Tables):
    c = _catalog(t)
    c.write_manifest(t.nation.select(F.col("n_name").alias("term"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_nationkey")).cast("long").alias("n_posts")))
    rows = c.table("collection_runs", platform="x")
    return rows.select("term", "n_posts").crossJoin(rows.agg(F.countDistinct("run_id").cast("int").alias("runs")))


@query("sk04_census_run", "", "SELECT * FROM (VALUES ('census', 0, NULL), ('frontier', 7, 'timeout')) AS r (pass, n_rows, error)")
def _(t: Tables):
    c = _catalog(t)
    c.write_census_run({})
    c.write_census_run({"pass": "frontier", "n_rows": 7, "error": "timeout"})
    return c.table("census_runs").select("pass", "n_rows", "error")


@query("sk05_persist_metrics", "acts", "SELECT kind AS channel, 'edges' AS metric, CAST(count(*) AS DOUBLE) AS value FROM acts GROUP BY kind UNION ALL SELECT 'all', 'accounts', 3.0")
def _(t: Tables):
    c = _catalog(t)
    runs.persist_run_metrics(c, t.acts.groupBy(F.col("kind").alias("channel")).agg(F.count(F.lit(1)).cast("double").alias("edges")), {"accounts": 3})
    return c.table("coordination/run_metrics", platform="x").select("channel", "metric", "value")


@query("sk08_artifact", "", "SELECT p_brand, count(*) AS n FROM part GROUP BY 1")
def _(t: Tables):
    path = _folder(t)
    write_artifact(t.part.groupBy("p_brand").agg(_n()), path, "parquet")
    return t.spark.read.parquet(path)


@query("sk09_replace_state", "", "SELECT s_suppkey AS id, s_acctbal AS value FROM supplier")
def _(t: Tables):
    """Two versions; readers see the second."""
    c = _catalog(t)
    own = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("value"))
    c.replace_state("balances", own.withColumn("value", F.lit(0.0)))
    c.replace_state("balances", own)
    return c.state("balances")


@query("sk10_healthcheck", "", "SELECT true AS healthy")
def _(t: Tables):
    return t.spark.createDataFrame([(_catalog(t).healthy(),)], "healthy boolean")


@query("ls03_latest_edges", "acts", f"{EDGE} SELECT src, dst, CASE WHEN u % 2 = 0 THEN weight + 100 ELSE weight END AS weight FROM ed")
def _(t: Tables):
    c = _catalog(t)
    _edges(t, c)
    return c.latest("coordination/edges", channel="co_url").select("src", "dst", "weight")


@query("ls05_series", "posts_raw", "SELECT platform_post_id, epoch_us(collected_at) AS seen_us, like_count FROM posts_raw")
def _(t: Tables):
    c = _catalog(t)
    c.append("metrics", t.posts_raw)
    return c.latest("metrics", platform="x").select("platform_post_id", F.unix_micros("collected_at").alias("seen_us"), "like_count")


@query("ls12_null_texts", "posts", "SELECT author_id, platform_post_id FROM (SELECT * REPLACE (CASE WHEN like_count % 4 = 0 THEN NULL ELSE text END AS text) FROM posts) WHERE NOT coalesce(is_repost, false) AND NOT regexp_matches(coalesce(text, ''), '^\\s*RT\\s+@', 'i') QUALIFY row_number() OVER (PARTITION BY author_id, coalesce(lower(trim(text, ' ')), '') ORDER BY created_at, platform_post_id) = 1")
def _(t: Tables):
    """Posts without a text are eligible, one of each author's."""
    return L.independent_voices(t.posts.withColumn("text", F.when(F.col("like_count") % 4 != 0, F.col("text")))).select("author_id", "platform_post_id")


@query("ls13_originals", "posts", "SELECT type, count(*) AS n FROM posts WHERE NOT coalesce(is_repost, false) AND NOT regexp_matches(coalesce(text, ''), '^\\s*RT\\s+@', 'i') GROUP BY 1")
def _(t: Tables):
    return L.original(t.posts).groupBy("type").agg(_n())


@query("ls17_leak_corrected", "posts_raw", f"{FS}, k AS (SELECT p.*, CASE WHEN first_type = 'timeline' AND lower(author_handle) NOT IN ('user1', 'user2', 'user3') THEN 'cib_timeline' ELSE first_type END AS kind FROM posts_raw p JOIN fs USING (platform, platform_post_id)) SELECT platform_post_id, max_by(like_count, collected_at) AS like_count FROM k WHERE kind IN ('search', 'timeline', 'replies', 'hydrated') GROUP BY 1")
def _(t: Tables):
    return L.latest_posts(t.posts_raw, "baseline", {"user1", "user2", "user3"}).select("platform_post_id", "like_count")


#: Rows of a file of a stream, in the mean: a task writes or reads one.
FILE_ROWS = 200_000


def _streamed(t: Tables, rows: DataFrame, parts: int = 2) -> DataFrame:
    """rows as a stream of files: `parts` batches, dealt by the post's id. A batch's files have a bounded number of rows each."""
    path = _folder(t)
    each = max(1, -(-rows.count() // (parts * FILE_ROWS)))
    rows.repartition(parts * each, "platform_post_id").write.parquet(path)
    return t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", each).parquet(path)


def _drained(t: Tables, stream: DataFrame, mode: str = "append") -> DataFrame:
    """What a stream has given once its input is used up; in complete mode its last table."""
    path, state = _folder(t), _folder(t)

    def keep(df: DataFrame, batch: int) -> None:
        df.withColumn("_batch", F.lit(batch)).write.mode("overwrite").parquet(f"{path}/b={batch}")

    q = stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()
    out = t.spark.read.parquet(path).drop("b")
    if mode == "complete":
        out = out.join(F.broadcast(out.agg(F.max("_batch").alias("_batch"))), "_batch", "left_semi")
    return out.drop("_batch")


@query("sm01_incremental_pass", "posts scores", "SELECT DISTINCT platform_post_id, CASE WHEN platform_post_id IN (SELECT platform_post_id FROM scores WHERE p_hate < 0.3) THEN 'before' ELSE 'now' END AS label FROM posts WHERE length(trim(text)) > 0 OR platform_post_id IN (SELECT platform_post_id FROM scores WHERE p_hate < 0.3)")
def _(t: Tables):
    """A pass over a stream of posts, some of which an earlier pass has scored."""
    c = _catalog(t)
    day = F.lit(AS_OF).cast("timestamp")
    c.append("hatespeech", t.scores.where("p_hate < 0.3").select("platform_post_id", F.lit("before").alias("label"), F.lit("x").alias("platform"), day.alias("scored_at")))

    def score(df: DataFrame) -> DataFrame:
        return df.select("platform_post_id", F.lit("now").alias("label"), F.lit("x").alias("platform"), day.alias("scored_at"))

    own = t.posts.select("platform_post_id", "text")
    passes.score_new(_streamed(t, own), lambda: c.table("hatespeech"), score, lambda df: c.append("hatespeech", df), _folder(t)).awaitTermination()
    return c.table("hatespeech").select("platform_post_id", "label")


@query("sm03_latest_by_arrival", "posts_raw", "SELECT platform_post_id, epoch_us(max(collected_at)) AS seen_us FROM posts_raw GROUP BY 1")
def _(t: Tables):
    """Snapshots in no order of time; the newest that the stream gave of each post."""
    stream = passes.newest_snapshots(_streamed(t, t.posts_raw.select("platform_post_id", "type", "collected_at")))
    return _drained(t, stream, "update").groupBy("platform_post_id").agg(F.max("collected_us").alias("seen_us"))


@query("sm06_late_hours", "posts", "SELECT epoch_us(date_trunc('hour', created_at)) AS hr_us, count(*) AS n FROM posts GROUP BY 1")
def _(t: Tables):
    """Hourly counts of a stream whose second half is as old as its first."""
    stream = passes.hourly_counts(_streamed(t, t.posts.select("platform_post_id", "created_at")), "60 days")
    return _drained(t, stream, "complete").select(F.unix_micros("hr").alias("hr_us"), "n")


@query("sm07_due_by_ttl", "acts", "SELECT c.id, c.lane FROM (SELECT DISTINCT CAST(u AS VARCHAR) AS id, CASE u % 3 WHEN 0 THEN 'hot' WHEN 1 THEN 'warm' ELSE 'cold' END AS lane FROM acts) c LEFT JOIN (SELECT CAST(u AS VARCHAR) AS id, max(ts) AS last FROM acts WHERE u % 4 <> 1 GROUP BY u) v USING (id) WHERE last IS NULL OR (epoch_us(TIMESTAMP '2024-02-01') - epoch_us(last)) / 3.6e9 >= CASE lane WHEN 'hot' THEN 12 WHEN 'warm' THEN 72 ELSE 720 END")
def _(t: Tables):
    """Visits from a stream's ledger against lanes of 12 hours, 3 days and 30 days."""
    own = t.acts.where("u % 4 <> 1").select(F.col("u").cast("string").alias("platform_post_id"), F.col("ts").alias("visited_at"))
    visits = _drained(t, passes.visit_ledger(_streamed(t, own), "platform_post_id"), "complete").withColumnRenamed("platform_post_id", "id")
    u = F.col("u")
    items = t.acts.select("u").distinct().select(u.cast("string").alias("id"), F.when(u % 3 == 0, "hot").when(u % 3 == 1, "warm").otherwise("cold").alias("lane"))
    return passes.due_by_ttl(visits, items, "id", AS_OF, {"hot": 12, "warm": 72, "cold": 720})
