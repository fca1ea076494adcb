"""Seed accounts of toxic networks, term mining, and objects worth another look."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import order as O
from tidemark.functions import stats as S
from tidemark.functions import text as T
from tidemark.operators import accounts
from tidemark.operators import latest as L

#: Weights and gates of the seed ranking.
WEIGHTS = {"co_amplify": 0.25, "toxic_rate_lb": 0.25, "brigade": 0.20, "persistence": 0.15, "suspicion": 0.15}
MIN_POSTS, MIN_TOXIC, MIN_PEERS, MIN_BRIGADES, BRIGADE_AUTHORS, REPEATS, STRATA, COHORT = 10, 3, 2, 2, 3, 2, 4, 8


def toxic(columns: Iterable[str]) -> Column:
    """Toxic by label or flag or coded suspicion, within scope, as far as the columns are there."""
    cols = set(columns)
    out = (F.col("label") != "neither") | F.coalesce(F.col("hate_flag"), F.lit(False))
    if "coded_suspect" in cols:
        out = out | F.coalesce(F.col("coded_suspect"), F.lit(False))
    return out & F.coalesce(F.col("in_scope"), F.lit(True)) if "in_scope" in cols else out


def _latest_scores(scores: DataFrame) -> DataFrame:
    return L.latest(scores, ("platform_post_id",), "scored_at").select("platform_post_id", F.coalesce(toxic(scores.columns), F.lit(False)).alias("toxic"), "p_hate")


def co_amplifiers(amplified: DataFrame) -> DataFrame:
    """Per account its partners on shared toxic objects, repeated and any. Objects of a crowd are left out."""
    size = amplified.agg(F.greatest(F.lit(50), F.least((F.countDistinct("author_id") * 0.05).cast("long"), F.lit(100))).alias("cap"))
    crowd = amplified.groupBy("obj").agg(F.countDistinct("author_id").alias("deg")).crossJoin(F.broadcast(size))
    kept = amplified.distinct().join(crowd.where("deg <= cap").select("obj"), "obj")
    a, b = kept.select("obj", "author_id"), kept.select("obj", F.col("author_id").alias("peer"))
    pairs = a.join(b, "obj").where("author_id <> peer").groupBy("author_id", "peer").agg(F.count(F.lit(1)).alias("shared"))
    return pairs.groupBy("author_id").agg(S.count_if(F.col("shared") >= REPEATS).alias("n_repeat_peers"), F.count(F.lit(1)).alias("n_any_peers"))


def brigades(recent: DataFrame) -> DataFrame:
    """Per account the number of threads it joined in which several accounts replied toxically."""
    replies = recent.where("toxic and in_reply_to_id is not null and conversation_id is not null").select("conversation_id", "author_id").distinct()
    piles = replies.groupBy("conversation_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= BRIGADE_AUTHORS).select("conversation_id")
    return replies.join(piles, "conversation_id", "left_semi").groupBy("author_id").agg(F.count(F.lit(1)).alias("n_brigade_convs"))


def seed_accounts(scores: DataFrame, posts: DataFrame, authors: DataFrame, engagements: DataFrame | None, as_of: str, days: int = 14) -> DataFrame:
    """Qualified accounts with their evidence and hate_seed_score (null for a cohort under eight).

    Every component is computed for all accounts; qualification by volume, by partners or by brigades
    comes after that, and ranking last: counts rank within strata of volume. Triage, not a verdict.
    """
    lp = L.latest(posts, L.POST_KEY, "collected_at")
    flag = _latest_scores(scores)
    recent = lp.where(F.col("created_at") > F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {int(days)} DAYS")).join(flag.select("platform_post_id", "toxic"), "platform_post_id", "left").na.fill(False, ["toxic"])
    day = F.to_date("created_at")
    volume = recent.groupBy("author_id").agg(F.count(F.lit(1)).alias("n_posts"), S.count_if(F.col("toxic")).alias("n_toxic"), F.countDistinct(F.when(F.col("toxic"), day)).alias("toxic_days"), F.countDistinct(day).alias("active_days"))
    amplified = lp.where("repost_of_id is not null").select("author_id", F.col("repost_of_id").alias("obj"))
    if engagements is not None:
        amplified = amplified.union(engagements.where("kind = 'retweet'").select("platform_user_id", "platform_post_id"))
    amplified = amplified.distinct().join(flag.where("toxic").select(F.col("platform_post_id").alias("obj")), "obj", "left_semi").select("author_id", "obj")
    susp = accounts.suspicion(accounts.author_features(authors, posts, as_of)).where("handle is not null and trim(handle) <> ''").select(F.col("platform_user_id").alias("author_id"), "handle", "suspicion")
    m = volume.join(susp, "author_id").join(co_amplifiers(amplified), "author_id", "left").join(brigades(recent), "author_id", "left")
    m = m.na.fill(0, ["n_repeat_peers", "n_any_peers", "n_brigade_convs"]).na.fill(0.0, ["suspicion"])
    m = m.withColumn("toxic_rate_lb", S.wilson_lower(F.col("n_toxic"), F.col("n_posts"))).withColumn("persistence", F.col("toxic_days") / F.greatest("active_days", F.lit(1)))
    m = m.where(((F.col("n_posts") >= MIN_POSTS) & (F.col("n_toxic") >= MIN_TOXIC)) | (F.col("n_repeat_peers") >= MIN_PEERS) | (F.col("n_brigade_convs") >= MIN_BRIGADES))
    m = O.numbered(m, "n_posts", "author_id")
    size = m.agg(F.count(F.lit(1)).alias("_size"))
    m = m.crossJoin(F.broadcast(size))
    # As ntile: the first strata have one row more where rows do not divide evenly.
    each, more = F.floor(F.col("_size") / STRATA), F.col("_size") % STRATA
    late = more + F.floor((F.col("_n") - more * (each + 1)) / F.greatest(each, F.lit(1)))
    m = m.withColumn("volume_bucket", (F.when(F.col("_n") < more * (each + 1), F.floor(F.col("_n") / (each + 1))).otherwise(late) + 1).cast("int")).drop("_n")
    m = m.withColumn("_amplify", F.log1p("n_repeat_peers") + F.log1p("n_any_peers"))
    parts = {"co_amplify": ("_amplify", ("volume_bucket",)), "toxic_rate_lb": ("toxic_rate_lb", ()), "brigade": ("n_brigade_convs", ("volume_bucket",)), "persistence": ("persistence", ()), "suspicion": ("suspicion", ())}
    score = F.lit(0.0)
    for name, (column, by) in parts.items():
        m = O.with_percent_rank(m, column, f"_{name}", by)
        score = score + WEIGHTS[name] * F.col(f"_{name}")
    m = m.withColumn("hate_seed_score", F.when(F.col("_size") >= COHORT, score))
    return m.drop("_size", "_amplify", *[f"_{name}" for name in parts])


def mine_terms(posts: DataFrame, cohort: DataFrame, as_of: str, days: int = 14, new_days: int = 3, stop: Iterable[str] = (), min_count: int = 8, min_authors: int = 3, min_lift: float = 1.5) -> DataFrame:
    """Terms over-represented in the posts of a cohort (author_id): counts, lift, novelty. Candidates for review.

    Lift is a gate, novelty (the rise in the last days) the order. Both are smoothed by half a count.
    """
    now = F.lit(as_of).cast("timestamp")
    recent = posts.where(F.col("created_at") > now - F.expr(f"INTERVAL {int(days)} DAYS"))
    own = cohort.select("author_id").distinct().withColumn("inside", F.lit(True))
    words = recent.join(own, "author_id", "left").select("author_id", F.coalesce("inside", F.lit(False)).alias("inside"), (F.col("created_at") > now - F.expr(f"INTERVAL {int(new_days)} DAYS")).alias("fresh"), F.explode(T.mining_terms(F.col("text"))).alias("term"))
    stop = sorted(stop)
    words = words.where(~F.col("term").isin(stop)) if stop else words
    inside, fresh = F.col("inside"), F.col("fresh")
    counts = words.groupBy("term").agg(S.count_if(inside).alias("c_in"), F.countDistinct(F.when(inside, F.col("author_id"))).alias("a_in"), F.count(F.lit(1)).alias("c_all"), S.count_if(inside & fresh).alias("c_new"), S.count_if(inside & ~fresh).alias("c_old"))
    totals = counts.agg(*[F.sum(c).alias(f"t{c[1:]}") for c in ("c_in", "c_all", "c_new", "c_old")], F.count(F.lit(1)).alias("v"))

    def smooth(c: str) -> Column:
        return (F.col(f"c{c}") + 0.5) / (F.col(f"t{c}") + 0.5 * F.col("v"))

    out = counts.crossJoin(F.broadcast(totals)).withColumn("lift", smooth("_in") / smooth("_all")).withColumn("novelty", smooth("_new") / smooth("_old"))
    return out.where((F.col("c_in") >= min_count) & (F.col("a_in") >= min_authors) & (F.col("lift") >= min_lift)).select("term", "c_in", "a_in", "c_all", "lift", "novelty")


def hot_toxic_objects(scores: DataFrame, posts: DataFrame, as_of: str, days: int = 14, band: tuple[int, int] = (5, 500), ledger: DataFrame | None = None, n: int = 250) -> DataFrame:
    """Toxic original posts with a middling number of reposts, most first; those visited lately apart."""
    recent = L.recent_posts(posts, as_of, days).join(_latest_scores(scores), "platform_post_id")
    out = recent.where(F.col("toxic") & ~F.coalesce(F.col("is_repost"), F.lit(False)) & F.coalesce(F.col("repost_count"), F.lit(0)).between(*band))
    if ledger is not None:
        out = L.due(out, ledger, "platform_post_id", as_of, 12)
    return out.orderBy(F.desc_nulls_last("repost_count"), F.desc_nulls_last("p_hate"), "platform_post_id").limit(n).select("platform_post_id", "repost_count", "p_hate")


def hot_conversations(scores: DataFrame, posts: DataFrame, as_of: str, days: int = 14, n: int = 60) -> DataFrame:
    recent = L.recent_posts(posts, as_of, days).join(_latest_scores(scores), "platform_post_id", "left").where("conversation_id is not null")
    out = recent.groupBy("conversation_id").agg(S.count_if(F.coalesce("toxic", F.lit(False))).alias("n_toxic"), F.count(F.lit(1)).alias("n"))
    return out.where(F.col("n_toxic") >= BRIGADE_AUTHORS).orderBy(F.desc("n_toxic"), F.desc("n"), "conversation_id").limit(n)


def is_stale(table: DataFrame, column: str, as_of: str, hours: int = 24) -> bool:
    """Whether a table is empty or its newest row is older than hours at as_of."""
    cut = F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {int(hours)} HOURS")
    return not table.agg(F.coalesce(F.max(column) >= cut, F.lit(False)).alias("fresh")).first()["fresh"]


def term_examples(posts: DataFrame, term: str, n: int = 5) -> DataFrame:
    import re

    return posts.where(F.col("text").rlike(rf"(?iU)\b{re.escape(term)}\b")).orderBy(F.desc("created_at"), "platform_post_id").limit(n)


def merge_terms(known: DataFrame, found: DataFrame, as_of: str, ttl_days: int, cap: int) -> DataFrame:
    """Ledger of mined terms (term, approved, first_seen, last_seen, novelty) after a pass.

    Approval and first_seen survive; terms not found for ttl_days go unless approved; at most cap
    unapproved ones stay, the most novel first.
    """
    now = F.lit(as_of).cast("timestamp")
    new = found.select("term", F.col("novelty").alias("new_novelty"))
    both = known.join(new, "term", "full_outer")
    seen = F.col("new_novelty").isNotNull()
    both = both.select("term", F.coalesce("approved", F.lit(False)).alias("approved"), F.coalesce("first_seen", now).alias("first_seen"), F.when(seen, now).otherwise(F.col("last_seen")).alias("last_seen"), F.coalesce("new_novelty", "novelty").alias("novelty"))
    live = both.where(F.col("approved") | (F.col("last_seen") > now - F.expr(f"INTERVAL {int(ttl_days)} DAYS")))
    w = Window.partitionBy("approved").orderBy(F.desc("novelty"), "term")
    return live.withColumn("_r", F.row_number().over(w)).where(F.col("approved") | (F.col("_r") <= cap)).drop("_r")


def active_terms(terms: DataFrame, autopromote: bool = False, cap: int = 20) -> DataFrame:
    """Mined terms to search for: approved ones, and the most novel others if autopromote; at most cap, approved first."""
    usable = terms if autopromote else terms.where("approved")
    return usable.orderBy(F.desc("approved"), F.desc("novelty"), "term").limit(cap).select("term")
