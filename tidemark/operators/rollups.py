"""Rollups over posts and actions: slices, timelines, bursts, gaps, histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import stats as S
from tidemark.functions import text as T
from tidemark.operators.places import COMMUNITY_RULES, DISCLAIMER, REGION_RULES


def sentiment_value(c: str = "sentiment") -> Column:
    return F.when(F.col(c) == "positive", 1).when(F.col(c) == "negative", -1).otherwise(0)


def reply_pairs(posts: DataFrame) -> DataFrame:
    """(replier, target, parent, lag_s) of replies to posts that we hold, replies to oneself apart."""
    parent = posts.select(F.col("platform_post_id").alias("in_reply_to_id"), F.col("author_id").alias("target"), F.col("created_at").alias("asked"))
    reply = posts.where("in_reply_to_id is not null").select(F.col("author_id").alias("replier"), "in_reply_to_id", "created_at")
    lag = (F.unix_micros("created_at") - F.unix_micros("asked")) / 1e6
    return reply.join(parent, "in_reply_to_id").where("replier <> target").select("replier", "target", F.col("in_reply_to_id").alias("parent"), lag.alias("lag_s"))


def _rules(by: str):
    if by == "region":
        return REGION_RULES
    if by == "community":
        return COMMUNITY_RULES
    raise ValueError(f"unknown slice {by!r}")


def slice_sentiment(posts: DataFrame, authors: DataFrame, labels: DataFrame, by: str, least: int = 20) -> DataFrame:
    """Mean sentiment of posts by region, community or language, for slices with `least` posts or more."""
    who = authors.select(F.col("platform_user_id").alias("author_id"), "location")
    joined = posts.join(who, "author_id").join(labels.select("platform_post_id", "sentiment"), "platform_post_id")
    label = F.col("lang") if by == "lang" else T.first_match(F.col("location"), _rules(by))
    out = joined.groupBy(label.alias("slice")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(sentiment_value()), 3).alias("mean_sentiment"))
    return out.where((F.col("n") >= least) & F.col("slice").isNotNull())


def slice_claim(members: DataFrame, authors: DataFrame, by: str, gate: float = 0.1) -> DataFrame:
    """A claim's posts and authors by slice, with the share of posts that have a slice at all.

    Below the gate's coverage shown is false. Aggregates only; community slices carry the disclaimer.
    """
    who = authors.select(F.col("platform_user_id").alias("author_id"), "location")
    sliced = members.join(who, "author_id", "left").withColumn("slice", T.first_match(F.col("location"), _rules(by)))
    known = sliced.agg(S.share(F.col("slice").isNotNull()).alias("coverage"))
    out = sliced.where("slice is not null").groupBy("slice").agg(F.count(F.lit(1)).alias("n_posts"), F.countDistinct("author_id").alias("n_authors"))
    return out.crossJoin(F.broadcast(known)).withColumn("shown", F.col("coverage") >= gate).withColumn("disclaimer", F.lit(DISCLAIMER if by == "community" else None))


def collection_stats(posts_raw: DataFrame, as_of: str, days: int) -> DataFrame:
    recent = F.col("collected_at") > F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {int(days)} DAYS")
    return posts_raw.groupBy("type").agg(F.count(F.lit(1)).alias("n_raw"), F.countDistinct("platform_post_id").alias("n_unique"), F.countDistinct("author_id").alias("n_authors"), S.count_if(recent).alias("n_recent"))


def bursting_hashtags(posts: DataFrame, as_of: str, least: int = 20, ratio: float = 5.0) -> DataFrame:
    """Hashtags whose last day has `least` posts and `ratio` times their daily mean of the week before."""
    now = F.lit(as_of).cast("timestamp")
    day = now - F.expr("INTERVAL 1 DAY")
    tags = posts.where((F.col("created_at") > now - F.expr("INTERVAL 8 DAYS")) & (F.col("created_at") <= now)).select(F.explode(F.transform("hashtags", F.lower)).alias("tag"), "created_at")
    out = tags.groupBy("tag").agg(S.count_if(F.col("created_at") > day).alias("n24"), (S.count_if(F.col("created_at") <= day) / 7).alias("daily_mean"))
    return out.where((F.col("n24") >= least) & (F.col("n24") >= ratio * F.col("daily_mean")))


def hourly_burst(posts: DataFrame, as_of: str, hours: int = 48, z_least: float = 3.0, least: int = 100) -> DataFrame:
    """The last complete hour against the hours before it: z by the sample deviation, and whether it bursts.

    Under 12 hours of history there is no burst; a flat history gives infinity above it and 0 else.
    """
    end = F.date_trunc("hour", F.lit(as_of).cast("timestamp"))
    last = end - F.expr("INTERVAL 1 HOUR")
    span = posts.where((F.col("created_at") >= end - F.expr(f"INTERVAL {hours + 1} HOURS")) & (F.col("created_at") < end))
    hour = span.groupBy(F.date_trunc("hour", "created_at").alias("hr")).agg(F.count(F.lit(1)).alias("n"))
    past = F.when(F.col("hr") < last, F.col("n"))
    out = hour.agg(F.coalesce(F.max(F.when(F.col("hr") == last, F.col("n"))), F.lit(0)).alias("last_hour"), F.count(past).alias("hours"), F.avg(past).alias("mean"), F.stddev_samp(past).alias("sd"))
    over = F.col("last_hour") - F.col("mean")
    z = F.when(F.col("hours") < 11, F.lit(0.0)).when(F.coalesce("sd", F.lit(0.0)) == 0, F.when(over > 0, F.lit(float("inf"))).otherwise(0.0)).otherwise(over / F.col("sd"))
    return out.withColumn("z", z).withColumn("burst", (F.col("z") >= z_least) & (F.col("last_hour") >= least))


def timeline(posts: DataFrame, unit: str) -> DataFrame:
    return posts.groupBy(F.date_trunc(unit, "created_at").alias("at")).agg(F.count(F.lit(1)).alias("n"), F.avg(sentiment_value()).alias("mean_sentiment"))


def daily_prevalence(scored: DataFrame, least: int = 20, rows: int = 7, least_rows: int = 3) -> DataFrame:
    """Share of toxic posts in scope by day, for days with enough of them, and its rolling mean."""
    toxic = (F.col("label") != "neither") | F.coalesce(F.col("hate_flag"), F.lit(False))
    day = scored.where("in_scope").groupBy(F.date_trunc("day", "created_at").alias("day")).agg(F.count(F.lit(1)).alias("n"), S.share(toxic).alias("rate")).where(F.col("n") >= least)
    w = Window.orderBy("day").rowsBetween(1 - rows, 0)  # one row per day
    return day.withColumn("rolling", F.when(F.count(F.lit(1)).over(w) >= least_rows, F.avg("rate").over(w)))


def cadence(posts: DataFrame, zone: str) -> DataFrame:
    """Posts by local hour, all 24 hours."""
    own = posts.groupBy(F.hour(F.from_utc_timestamp("created_at", zone)).alias("hr")).agg(F.count(F.lit(1)).alias("n"))
    hours = posts.sparkSession.range(24).select(F.col("id").cast("int").alias("hr"))
    return hours.join(own, "hr", "left").na.fill(0, ["n"])


def log_histogram(df: DataFrame, column: str, per_decade: int) -> DataFrame:
    return df.groupBy(F.floor(F.log10(F.col(column) + 1) * per_decade).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def nearest_rank(column: str, q: float) -> Column:
    """Aggregate: the value at rank round(q (n - 1)), halves to even."""
    values = F.sort_array(F.collect_list(column))
    return F.element_at(values, (F.bround(q * (F.size(values) - 1), 0) + 1).cast("int"))


def gaps(acts: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """Seconds between an account's neighbouring actions: n, mean_gap, coefficient of variation, median."""
    s = F.unix_micros(at) / 1e6
    g = acts.withColumn("g", s - F.lag(s).over(Window.partitionBy(key).orderBy(at, tie))).where("g is not null")
    return g.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.avg("g").alias("mean_gap"), F.try_divide(F.stddev_samp("g"), F.avg("g")).alias("cv"), F.median("g").alias("median_gap")).where("mean_gap > 0")


def tightest_half(acts: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """The shortest span of seconds that holds half of a group's times (two at least)."""
    s = F.unix_micros(at) / 1e6
    own = Window.partitionBy(key)
    order = own.orderBy(at, tie)
    x = acts.select(key, s.alias("s"), F.row_number().over(order).alias("r"), F.count(F.lit(1)).over(own).alias("n"))
    k = F.greatest(F.ceil(F.col("n") / 2), F.lit(2)) - 1
    ends = x.select(key, F.col("r").alias("end"), F.col("s").alias("s_end"))
    return x.withColumn("end", F.col("r") + k).join(ends, [key, "end"]).groupBy(key).agg(F.min(F.col("s_end") - F.col("s")).alias("span"))


def busiest_window(acts: DataFrame, key: str, at: str, days: int) -> DataFrame:
    """The largest share of a group's actions that falls on `days` + 1 neighbouring days."""
    day = F.unix_date(F.to_date(at))
    w = Window.partitionBy(key).orderBy("day").rangeBetween(-days, 0)
    daily = acts.groupBy(key, day.alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return daily.withColumn("c", F.sum("n").over(w)).groupBy(key).agg((F.max("c") / F.sum("n")).alias("share"))


def topic_mix(posts: DataFrame, key: str) -> DataFrame:
    """Entropy of a group's topics (nats) and the commonest one (ties: smallest)."""
    n = posts.groupBy(key, "topic").agg(F.count(F.lit(1)).alias("n"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy(key))
    return n.withColumn("p", p).groupBy(key).agg((-F.sum(F.col("p") * F.log("p"))).alias("entropy"), F.max_by("topic", F.struct("n", -F.col("topic"))).alias("dominant"))


def enriched(posts: DataFrame, toxicity: DataFrame, authors: DataFrame, incitement: DataFrame, labels: DataFrame) -> DataFrame:
    """Posts with a toxicity score, and, where there are any, their author's region and community, lexicon hits and sentiment.

    Five tables in one frame: the score is required, the others are not.
    """
    who = authors.select(F.col("platform_user_id").alias("author_id"), T.first_match(F.col("location"), REGION_RULES).alias("region"), T.first_match(F.col("location"), COMMUNITY_RULES).alias("community"))
    own = posts.withColumn("engagement", F.col("like_count") + F.col("reply_count") + F.col("repost_count") + F.col("quote_count"))
    return own.join(toxicity, "platform_post_id").join(who, "author_id", "left").join(incitement, "platform_post_id", "left").join(labels, "platform_post_id", "left")


def regional_rate(frame: DataFrame, by: str, least: int = 200) -> DataFrame:
    """Share of toxic posts in scope by region or community, for those with enough posts. Aggregates only."""
    toxic = F.col("label") != "neither"
    out = frame.where(F.col("in_scope") & F.col(by).isNotNull()).groupBy(F.col(by).alias("slice")).agg(F.count(F.lit(1)).alias("n"), S.share(toxic).alias("rate"))
    return out.where(F.col("n") >= least)


def reach_and_engagement(posts: DataFrame, authors: DataFrame) -> DataFrame:
    """Per author the followers, posts, and engagement a post."""
    who = authors.select(F.col("platform_user_id").alias("author_id"), "followers_count")
    total = F.col("like_count") + F.col("repost_count") + F.col("reply_count") + F.col("quote_count")
    return posts.join(who, "author_id").groupBy("author_id").agg(F.max("followers_count").alias("followers"), F.count(F.lit(1)).alias("n_posts"), F.avg(total).alias("mean_engagement"))
