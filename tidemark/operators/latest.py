"""Latest state of snapshot tables, collection scope, eligibility and selection against ledgers."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import text as T

POST_KEY = ("platform", "platform_post_id")
#: The kinds of collection that sample the discourse, and those that chase a target.
BASELINE = ("search", "timeline", "replies", "hydrated")
TARGETED = ("hate_search", "hate_target_search", "hate_timeline", "hate_replies", "hate_hydrated", "cib_timeline", "census_timeline")
SCOPES = ("all", "baseline", "targeted")


def latest(df: DataFrame, keys: Sequence[str], order: str, *ties: str) -> DataFrame:
    """The newest row of each key by `order`; ties go to the largest of `ties`. Null orders come last."""
    w = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(order), *[F.desc_nulls_last(t) for t in ties])
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") == 1).drop("_rank")


def newest_run(df: DataFrame, order: str) -> DataFrame:
    """All rows of the newest run."""
    return df.join(F.broadcast(df.agg(F.max(order).alias(order))), order, "left_semi")


def first_seen(posts: DataFrame) -> DataFrame:
    """Per post the kind of collection that found it first, and when."""
    return posts.groupBy(*POST_KEY).agg(F.min_by("type", "collected_at").alias("first_type"), F.min("collected_at").alias("first_collected_at"))


def effective_type(kind: Column, handle: Column, curated: Iterable[str]) -> Column:
    """Timelines of accounts that are not on the curated list count as targeted collection."""
    handles = sorted(curated)
    if not handles:
        return kind
    return F.when((kind == "timeline") & ~F.lower(handle).isin(handles), F.lit("cib_timeline")).otherwise(kind)


def in_scope(kind: Column, scope: str) -> Column:
    """Whether a kind of collection belongs to scope. A kind nobody knows is an error, never a bucket."""
    if scope not in SCOPES:
        raise ValueError(f"unknown scope {scope!r}, expected one of {SCOPES}")
    if scope == "all":
        return F.lit(True)
    stray = F.raise_error(F.concat(F.lit("unknown kind of collection: "), F.coalesce(kind, F.lit("null"))))
    return F.when(kind.isin(*BASELINE), F.lit(scope == "baseline")).when(kind.isin(*TARGETED), F.lit(scope == "targeted")).otherwise(stray.cast("boolean"))


def check_kinds(posts: DataFrame) -> None:
    """Raise for a kind of collection that no scope knows, before any plan depends on it."""
    stray = posts.where(~F.coalesce(F.col("type"), F.lit("")).isin(*BASELINE, *TARGETED)).select("type").limit(1).collect()
    if stray:
        raise ValueError(f"unknown kind of collection: {stray[0][0]}")


def latest_posts(posts: DataFrame, scope: str = "all", curated: Iterable[str] = ()) -> DataFrame:
    """The newest snapshot of each post whose first collection lies in scope. Rows keep their first_type."""
    if scope == "all":
        return latest(posts, POST_KEY, "collected_at")
    origin = first_seen(posts).select(*POST_KEY, "first_type")
    kind = effective_type(F.col("first_type"), F.col("author_handle"), curated)
    return latest(posts.join(origin, [*POST_KEY]).where(in_scope(kind, scope)), POST_KEY, "collected_at")


def recent_posts(posts: DataFrame, as_of: str, days: int) -> DataFrame:
    """The newest snapshot of posts made in the `days` before as_of; 0 days: of all posts."""
    if days:
        posts = posts.where(F.col("created_at") > F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {int(days)} DAYS"))
    return latest(posts, POST_KEY, "collected_at")


def original(posts: DataFrame) -> DataFrame:
    """Posts that are no reposts, native or manual."""
    return posts.where(~F.coalesce(F.col("is_repost"), F.lit(False)) & ~T.is_manual_repost(F.col("text")))


def independent_voices(posts: DataFrame) -> DataFrame:
    """Original posts, the first of each author's with the same text."""
    w = Window.partitionBy("author_id", T.text_key(F.col("text"))).orderBy("created_at", "platform_post_id")
    return original(posts).withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") == 1).drop("_rank")


def coverage(posts: DataFrame, columns: Sequence[str] = ("hashtags", "urls", "mentions")) -> DataFrame:
    """Share of posts in which each array column has something."""
    return posts.agg(*[F.avg(F.when(F.size(F.coalesce(F.col(c), F.array().cast("array<string>"))) > 0, 1.0).otherwise(0.0)).alias(c) for c in columns])


def pending(posts: DataFrame, done: DataFrame, limit: int | None = None, first: Column | None = None) -> DataFrame:
    """Posts with text that are not in done, the preferred and newest first."""
    waiting = posts.where(F.length(F.trim("text")) > 0).join(done.select("platform_post_id"), "platform_post_id", "left_anti")
    if limit is None:
        return waiting
    order = ([F.desc(first)] if first is not None else []) + [F.desc_nulls_last("created_at"), F.col("platform_post_id")]
    return waiting.orderBy(*order).limit(limit)


def informative(posts: DataFrame, least: int = 5) -> DataFrame:
    return posts.where(T.content_words(F.col("text")) >= least)


def due(items: DataFrame, ledger: DataFrame, key: str, as_of: str, hours: int) -> DataFrame:
    """Items never visited, or last visited `hours` or more before as_of. Null keys are never due."""
    seen = ledger.groupBy(key).agg(F.max("visited_at").alias("_seen"))
    cut = F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {int(hours)} HOURS")
    fresh = seen.where(F.col("_seen") > cut)
    return items.where(F.col(key).isNotNull()).join(fresh, key, "left_anti")
