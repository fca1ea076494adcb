"""Search queries and the windows of time that they are sent for, as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The longest query that the platform takes, and the days that it looks back.
MAX_QUERY, MAX_DAYS = 512, 30


def or_group(keyword: Column) -> Column:
    """keyword in brackets if it has alternatives: what is appended would else bind to the last of them alone."""
    bare = keyword.contains(" OR ") & ~(keyword.startswith("(") & keyword.endswith(")"))
    return F.when(bare, F.concat(F.lit("("), keyword, F.lit(")"))).otherwise(keyword)


def search_query(keyword: Column, anchors: Sequence[str] = (), exclude: Sequence[str] = (), least_likes: int | None = None, since: Column | None = None, until: Column | None = None, reposts: bool = False) -> Column:
    """keyword, one of the anchors, none of the excluded words, and the filters; over MAX_QUERY characters is an error."""
    parts = [or_group(keyword)]
    if anchors:
        parts.append(F.lit("(" + " OR ".join(anchors) + ")"))
    parts += [F.lit(f"-{w}") for w in exclude]
    if least_likes:
        parts.append(F.lit(f"min_faves:{least_likes}"))
    parts += [F.concat(F.lit(f"{n}:"), c) for n, c in (("since", since), ("until", until)) if c is not None]
    if reposts:
        parts.append(F.lit("include:nativeretweets"))
    out = F.concat_ws(" ", *parts)
    long = F.raise_error(F.concat(F.lit("query is over the limit: "), out)).cast("string")
    return F.when(F.length(out) <= MAX_QUERY, out).otherwise(long)


def _days(spark: SparkSession, as_of: str, first: int, last: int, step: int) -> DataFrame:
    today = F.to_date(F.lit(as_of))
    return spark.range(1).select(today.alias("today"), F.explode(F.sequence(F.lit(first), F.lit(last), F.lit(step))).alias("d"))


def recent_windows(spark: SparkSession, as_of: str, days: int) -> DataFrame:
    """(since, until), one a day, of the last `days` days, today among them."""
    since = F.date_sub("today", F.col("d"))
    return _days(spark, as_of, 0, days - 1, 1).select(since.cast("string").alias("since"), F.date_add(since, 1).cast("string").alias("until"))


def backfill_windows(spark: SparkSession, as_of: str, recent: int, chunk: int, most: int = MAX_DAYS) -> DataFrame:
    """(since, until) of `chunk` days each, from `recent` days back to `most`; the last may be shorter."""
    if recent >= most:
        return spark.createDataFrame([], "since string, until string")
    until = F.date_sub("today", F.col("d"))
    since = F.greatest(F.date_sub(until, chunk), F.date_sub("today", most))
    return _days(spark, as_of, recent, most - 1, chunk).select(since.cast("string").alias("since"), until.cast("string").alias("until"))


def full_window(spark: SparkSession, as_of: str, most: int = MAX_DAYS) -> DataFrame:
    """One window of all the days that the platform looks back, today among them."""
    return _days(spark, as_of, 0, 0, 1).select(F.date_sub("today", most).cast("string").alias("since"), F.date_add("today", 1).cast("string").alias("until"))
