"""Ledgers of what to visit next: banded objects, promoted targets, frontiers, term rotation, crawls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.order import checkpointed
from tidemark.operators import latest as L


def banded(recent: DataFrame, key: str, degree: str, worked: DataFrame, band: tuple[int, int], n: int) -> DataFrame:
    """The n keys with the largest degree within a band, those not worked yet first: object_id, degree, n_rows, worked, in_band, open.

    Ranking the largest of all would pick the crowds that a hub cap throws away later. in_band and open
    count the whole band before the limit; worked rows come last and not never, so a band that is all
    worked still reports its size. recent are latest posts of the window, worked holds keys (object_id).
    """
    own = recent.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("object_id")).agg(F.max(degree).alias("degree"), F.count(F.lit(1)).alias("n_rows")).where(F.col("degree").between(*band))
    marked = own.join(worked.select("object_id").distinct().withColumn("_w", F.lit(True)), "object_id", "left").withColumn("worked", F.coalesce("_w", F.lit(False))).drop("_w")
    counts = marked.agg(F.count(F.lit(1)).alias("in_band"), F.count_if(~F.col("worked")).alias("open"))
    return marked.crossJoin(F.broadcast(counts)).orderBy("worked", F.desc("degree"), F.desc("n_rows"), "object_id").limit(n)


def visited_since(visits: DataFrame, key: str, at: str, as_of: str, hours: int) -> DataFrame:
    """Keys (object_id) visited in the `hours` before as_of."""
    return visits.where(F.col(at) > F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {int(hours)} HOURS")).select(F.col(key).alias("object_id")).distinct()


def hot_reposts(posts: DataFrame, engagements: DataFrame, as_of: str, days: int, band: tuple[int, int], hours: int, n: int) -> DataFrame:
    """Reposted objects to take a census of: within the band by repost count, none taken lately first."""
    taken = visited_since(engagements.where("kind = 'retweet'"), "platform_post_id", "collected_at", as_of, hours)
    return banded(L.recent_posts(posts, as_of, days), "repost_of_id", "repost_count", taken, band, n)


def hot_conversations(posts: DataFrame, replies: DataFrame, as_of: str, days: int, band: tuple[int, int], hours: int, n: int) -> DataFrame:
    """Conversations whose replies to fetch: within the band by reply count, none fetched lately first."""
    done = visited_since(replies, "conversation_id", "collected_at", as_of, hours)
    return banded(L.recent_posts(posts, as_of, days), "conversation_id", "reply_count", done, band, n)


def to_hydrate(posts: DataFrame, engagements: DataFrame, as_of: str, days: int, n: int) -> DataFrame:
    """References to posts that nobody holds (ref, engagement, censused), those with a census first, then the most engaged.

    A census without its post has no time, so all it found is unusable until the post is fetched.
    """
    recent = L.recent_posts(posts, as_of, days)
    kinds = (("repost_of_id", "repost_count"), ("quoted_post_id", "quote_count"), ("in_reply_to_id", "reply_count"))
    refs = [recent.where(F.col(k).isNotNull()).groupBy(F.col(k).alias("ref")).agg(F.max(c).alias("eng")) for k, c in kinds]
    every = refs[0].unionByName(refs[1]).unionByName(refs[2])
    missing = every.join(posts.select(F.col("platform_post_id").alias("ref")), "ref", "left_anti")
    known = engagements.where("kind = 'retweet'").select(F.col("platform_post_id").alias("ref")).distinct().withColumn("_c", F.lit(True))
    out = missing.join(known, "ref", "left").groupBy("ref").agg(F.max("eng").alias("engagement"), F.bool_or(F.col("_c").isNotNull()).alias("censused"))
    return out.orderBy(F.desc("censused"), F.desc("engagement"), "ref").limit(n)


def census_pool(engagements: DataFrame, authors: DataFrame, size: int, seed: int = 0) -> DataFrame:
    """(author_id, handle) of size accounts known by their reposts alone, in an order by hash.

    The draw has nothing to do with what is measured of them, so collecting them biases nothing.
    """
    seen = engagements.where("kind = 'retweet'").select(F.col("platform_user_id").alias("author_id")).distinct()
    key = F.xxhash64(F.lit(seed), "author_id")
    drawn = seen.orderBy(key, "author_id").limit(2 * size)
    who = L.latest(authors, ("platform", "platform_user_id"), "collected_at").where("handle is not null").select(F.col("platform_user_id").alias("author_id"), "handle")
    return drawn.join(who, "author_id").orderBy(key, "author_id").limit(size)


def discovered(pool: DataFrame, attempted: DataFrame, as_of: str, retry_days: int, n: int, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """The next n accounts of a pool not attempted lately, and attempted (author_id, attempted_at) after that; old entries go."""
    now = F.lit(as_of).cast("timestamp")
    live = attempted.where(F.col("attempted_at") >= now - F.expr(f"INTERVAL {int(retry_days)} DAYS"))
    picked = pool.join(live, "author_id", "left_anti").orderBy(F.xxhash64(F.lit(seed), "author_id"), "author_id").limit(n)
    after = live.select("author_id", "attempted_at").unionByName(picked.select("author_id", now.alias("attempted_at")))
    return picked, after.groupBy("author_id").agg(F.max("attempted_at").alias("attempted_at"))


def frontier(candidates: DataFrame, ledger: DataFrame, as_of: str, n: int, refresh_days: int, attempts: int) -> DataFrame:
    """The n best candidates (author_id, rank) that are due: never expanded, or not for refresh_days and not given up.

    ledger holds author_id, expanded_at, status (ok or failed) and attempts; an account is given up after so many failures.
    """
    cut = F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {int(refresh_days)} DAYS")
    given_up = (F.col("status") == "failed") & (F.col("attempts") >= attempts)
    waiting = ledger.where(given_up | (F.col("expanded_at") >= cut)).select("author_id")
    return candidates.where("author_id is not null and author_id <> ''").join(waiting, "author_id", "left_anti").orderBy("rank", "author_id").limit(n)


def pruned(ledger: DataFrame, as_of: str, keep_days: int) -> DataFrame:
    """Entries no older than keep_days."""
    return ledger.where(F.col("expanded_at") >= F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {int(keep_days)} DAYS"))


def recorded(ledger: DataFrame, results: DataFrame, as_of: str) -> DataFrame:
    """ledger after results (author_id, handle, n_posts, status): failures in a row add up, a success starts anew."""
    old = ledger.select("author_id", F.col("handle").alias("_h"), "expanded_at", F.col("n_posts").alias("_n"), F.col("status").alias("_s"), "attempts")
    both = old.join(results, "author_id", "full_outer")
    new = F.col("status").isNotNull()
    failed = F.when(F.col("status") == "failed", F.coalesce("attempts", F.lit(0)) + 1).otherwise(0)
    return both.select(
        "author_id",
        F.when(new & (F.coalesce("handle", F.lit("")) != ""), F.col("handle")).otherwise(F.coalesce("_h", F.lit(""))).alias("handle"),
        F.when(new, F.lit(as_of).cast("timestamp")).otherwise(F.col("expanded_at")).alias("expanded_at"),
        F.when(new, F.coalesce("n_posts", F.lit(0))).otherwise(F.col("_n")).cast("long").alias("n_posts"),
        F.when(new, F.col("status")).otherwise(F.col("_s")).alias("status"),
        F.when(new, failed).otherwise(F.col("attempts")).cast("int").alias("attempts"),
    )


def frontier_summary(ledger: DataFrame, attempts: int) -> DataFrame:
    failed = F.col("status") == "failed"
    return ledger.agg(F.count(F.lit(1)).alias("tracked"), F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(failed).alias("failed"), F.count_if(failed & (F.col("attempts") >= attempts)).alias("exhausted"))


def crawl(follows: DataFrame, seeds: DataFrame, levels: int) -> DataFrame:
    """(id, level) of all that `levels` steps along follows reach from seeds (id), each at its first level."""
    seen = checkpointed(seeds.select("id").distinct().withColumn("level", F.lit(0)))
    for k in range(1, levels + 1):
        new = next_level(follows, seen.where(F.col("level") == k - 1).select("id"), seen).withColumn("level", F.lit(k))
        seen = checkpointed(seen.unionByName(new))
    return seen


def crawl_summary(crawled: DataFrame) -> DataFrame:
    return crawled.groupBy("level").agg(F.count(F.lit(1)).alias("n"))


def with_toxic_first(baseline: DataFrame, toxic: DataFrame, key: str = "object_id") -> DataFrame:
    """Baseline objects, then toxic ones that are not among them."""
    return baseline.select(key, F.lit("baseline").alias("lane")).unionByName(toxic.join(baseline, key, "left_anti").select(key, F.lit("toxic").alias("lane")))


def merge_targets(known: DataFrame, found: DataFrame, as_of: str, ttl_days: int, cap: int) -> DataFrame:
    """Ledger (handle, last_seen) after a pass that found (handle, strength): confirmed, expired, capped."""
    now = F.lit(as_of).cast("timestamp")
    both = known.join(found, "handle", "full_outer")
    both = both.select("handle", F.when(F.col("strength").isNotNull(), now).otherwise(F.col("last_seen")).alias("last_seen"), F.coalesce("strength", F.lit(0)).alias("strength"))
    return both.where(F.col("last_seen") > now - F.expr(f"INTERVAL {int(ttl_days)} DAYS")).orderBy(F.desc("strength"), "handle").limit(cap)


def rotation(terms: DataFrame, n: int) -> DataFrame:
    """The n terms of each pool (term, pool, last_searched) that were searched longest ago, never first."""
    w = Window.partitionBy("pool").orderBy(F.asc_nulls_first("last_searched"), "term")
    return terms.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def directory(follows: DataFrame, authors: DataFrame) -> DataFrame:
    """(id, handle) of every end of a follow that we have a profile of."""
    ends = follows.select(F.col("follower_id").alias("id")).union(follows.select("followed_id")).distinct()
    who = L.latest(authors, ("platform", "platform_user_id"), "collected_at").select(F.col("platform_user_id").alias("id"), "handle")
    return ends.join(who, "id")


def next_level(follows: DataFrame, frontier: DataFrame, visited: DataFrame) -> DataFrame:
    """One level of a breadth-first crawl: who the frontier (id) follows and nobody visited."""
    out = follows.join(frontier.select(F.col("id").alias("follower_id")), "follower_id").select(F.col("followed_id").alias("id")).distinct()
    return out.join(visited.select("id"), "id", "left_anti")


def over_band(degrees: DataFrame, top: int, warn: float = 0.15) -> DataFrame:
    """Share of objects above a band (n), and whether it is time to look at the band."""
    s = F.avg(F.when(F.col("n") > top, 1.0).otherwise(0.0))
    return degrees.agg(s.alias("share"), (s > warn).alias("drifting"))
