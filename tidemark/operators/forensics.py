"""Forensic sweeps over accounts, texts, replies and growth curves."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import stats as S
from tidemark.functions import text as T
from tidemark.functions.order import checkpointed, numbered
from tidemark.operators import graphs, vectors
from tidemark.operators.rollups import reply_pairs


def circadian(posts: DataFrame, zone: str, least: int = 20) -> DataFrame:
    """Per author with enough posts: its share of each local hour, smoothed by half a post (hour, p)."""
    n = posts.groupBy("author_id", F.hour(F.from_utc_timestamp("created_at", zone)).alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    who = n.groupBy("author_id").agg(F.sum("n").alias("total")).where(F.col("total") >= least)
    grid = who.crossJoin(F.broadcast(posts.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))))
    return grid.join(n, ["author_id", "hour"], "left").select("author_id", "hour", ((F.coalesce("n", F.lit(0)) + 0.5) / (F.col("total") + 12)).alias("p"))


def _kl(p: Column, m: Column) -> Column:
    return p * F.log2(p / m)


def divergence_from_all(profiles: DataFrame) -> DataFrame:
    """Per author the Jensen-Shannon divergence (base 2) of its hours from the mean profile."""
    mean = profiles.groupBy("hour").agg(F.avg("p").alias("q"))
    m = (F.col("p") + F.col("q")) / 2
    return profiles.join(F.broadcast(mean), "hour").groupBy("author_id").agg(F.sum((_kl(F.col("p"), m) + _kl(F.col("q"), m)) / 2).alias("jsd"))


def shift_cohorts(profiles: DataFrame, quantile: float, within: float) -> DataFrame:
    """Components of the authors with unusual hours whose profiles are within a divergence of each other.

    All pairs, in blocks of authors, with most decided by one matrix product: for the Hellinger distance
    h2 = 1 - sum(sqrt(p q)) the divergence lies between h2 / (2 ln 2) and 2 h2, and logarithms are taken only
    in between. A task hands out its trees and no pairs.
    """
    profiles = checkpointed(profiles)
    odd = checkpointed(divergence_from_all(profiles))
    cut = odd.agg(F.percentile("jsd", F.lit(quantile)).alias("cut"))
    few = odd.crossJoin(F.broadcast(cut)).where("jsd >= cut").select("author_id")
    hours = F.transform(F.sort_array(F.collect_list(F.struct("hour", "p"))), lambda x: x["p"])
    own = checkpointed(profiles.join(few, "author_id", "left_semi").groupBy("author_id").agg(hours.alias("p")))
    trees = close_profiles(own.select(F.col("author_id").alias("id"), "p"), within)
    return graphs.connected_components(trees).select(F.col("node").alias("author_id"), "component")


#: Authors of a block of close_profiles, and to a side of the tiles in which two blocks are compared.
PROFILES, TILE = 8192, 512


def close_profiles(own: DataFrame, within: float, blocks: int | None = None) -> DataFrame:
    """(src, dst) with the components of the pairs of (id, p) whose profiles (shares, none zero) are within a divergence."""
    count = own.count()
    n = blocks or max(1, -(-count // PROFILES), min(5, count // 1024))
    kind = dict(own.dtypes)["id"]
    dealt = own.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    i, j = F.least("b", "o"), F.greatest("b", "o")
    dealt = dealt.select((j * (j + 1) / 2 + i).cast("int").alias("t"), (i == j).alias("one"), "id", "p", "b")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        tab = pa.Table.from_batches(held)
        ids, block, one = tab.column("id").combine_chunks(), tab.column("b").to_numpy(), held[0].column("one")[0].as_py()
        p = vectors._matrix(tab.column("p").combine_chunks())
        first = np.flatnonzero(block == block.min())
        rest = first if one else np.flatnonzero(block != block.min())
        root = np.arange(len(p))
        for s in range(0, len(first), TILE):
            for t in range(s if one else 0, len(rest), TILE):
                x, y = first[s : s + TILE], rest[t : t + TILE]
                r = root[np.concatenate([x, y])]
                if (r == r[0]).all():
                    continue  # what is in one tree needs no more links
                a, b = _close(p[x], p[y], within)
                a, b = x[a], y[b]
                apart = root[a] != root[b]
                if apart.any():
                    root = graphs.least_of_trees(len(root), np.concatenate([np.arange(len(root)), a[apart]]), np.concatenate([root, b[apart]]))
        inner = np.bincount(root, minlength=len(root))[root] > 1
        for s in range(0, int(inner.sum()), 100_000):
            own = np.flatnonzero(inner)[s : s + 100_000]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(root[own])), ids.take(pa.array(own))], names=["src", "dst"])

    return dealt.repartitionById(n * (n + 1) // 2, F.col("t")).mapInArrow(meet, f"src {kind}, dst {kind}")


def _close(p: np.ndarray, q: np.ndarray, within: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (in p, in q) of the pairs with a Jensen-Shannon divergence (base 2) of at most within."""
    h = 1 - np.sqrt(p) @ np.sqrt(q).T
    sure = 2 * h <= within - 1e-9
    a, b = np.nonzero(~sure & (h <= 2 * math.log(2) * within + 1e-9))
    ok = np.zeros(len(a), bool)
    for s in range(0, len(a), 100_000):
        x, y = p[a[s : s + 100_000]], q[b[s : s + 100_000]]
        m = (x + y) / 2
        ok[s : s + 100_000] = (x * np.log2(x / m) + y * np.log2(y / m)).sum(axis=1) / 2 <= within
    i, j = np.nonzero(sure)
    return np.concatenate([i, a[ok]]), np.concatenate([j, b[ok]])


def awakened(authors: DataFrame, posts: DataFrame, as_of: str, days: int = 14, age: int = 365, ratio: float = 20.0) -> DataFrame:
    """Old accounts whose recent daily rate is `ratio` times their lifetime rate."""
    recent = posts.where(F.col("created_at") > F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {int(days)} DAYS")).groupBy("author_id").agg((F.count(F.lit(1)) / days).alias("recent_rate"))
    life = authors.select(F.col("platform_user_id").alias("author_id"), F.datediff(F.lit(as_of).cast("timestamp"), "created_at").alias("age"), "tweet_count")
    out = life.join(recent, "author_id").withColumn("life_rate", F.col("tweet_count") / F.greatest("age", F.lit(1)))
    out = out.withColumn("ratio", F.col("recent_rate") / F.greatest("life_rate", F.lit(0.01)))
    return out.where((F.col("age") > age) & (F.col("ratio") > ratio))


def handle_families(authors: DataFrame, least: int = 3) -> DataFrame:
    """Handles that are alike but for their numbers."""
    return authors.groupBy(T.handle_skeleton(F.col("handle")).alias("skeleton")).agg(F.countDistinct("platform_user_id").alias("n")).where(F.col("n") >= least)


def hashtag_recency(posts: DataFrame, authors: DataFrame, as_of: str, young_days: int, least: int = 5) -> DataFrame:
    """Per hashtag the share of its accounts that are young, and its z against all accounts' share."""
    young = (F.datediff(F.lit(as_of).cast("timestamp"), "created_at") <= young_days).cast("int")
    who = authors.select(F.col("platform_user_id").alias("author_id"), young.alias("young"))
    base = who.agg(F.avg("young").alias("p"))
    pairs = posts.select("author_id", F.explode(F.transform("hashtags", F.lower)).alias("tag")).distinct().join(who, "author_id")
    out = pairs.groupBy("tag").agg(F.count(F.lit(1)).alias("n"), F.sum("young").alias("k")).where(F.col("n") >= least).crossJoin(F.broadcast(base))
    z = F.try_divide(F.col("k") - F.col("n") * F.col("p"), F.sqrt(F.col("n") * F.col("p") * (1 - F.col("p"))))
    return out.select("tag", "n", "k", z.alias("z"))


def copypasta(posts: DataFrame, clusters: DataFrame, authors: int = 3, minutes: float = 60.0) -> DataFrame:
    """Per near-duplicate cluster (platform_post_id, cluster_id): authors, span in minutes, first author, burst."""
    x = posts.join(clusters, "platform_post_id")
    at = F.unix_micros("created_at") / 6e7
    out = x.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n_posts"), F.countDistinct("author_id").alias("n_authors"), (F.max(at) - F.min(at)).alias("span_min"), F.min_by("author_id", F.struct("created_at", "platform_post_id")).alias("seeder"))
    return out.withColumn("burst", (F.col("n_authors") >= authors) & (F.col("span_min") <= minutes))


def seeders_and_echoers(posts: DataFrame, clusters: DataFrame) -> DataFrame:
    """Per account how often it was first in a shared cluster, and how often it followed."""
    w = Window.partitionBy("cluster_id").orderBy("created_at", "platform_post_id")
    shared = clusters.join(posts, "platform_post_id").withColumn("first", F.first("author_id").over(w))
    led = shared.where("author_id = first").groupBy("author_id").agg(F.countDistinct("cluster_id").alias("seeded"))
    followed = shared.where("author_id <> first").groupBy("author_id").agg(F.countDistinct("cluster_id").alias("echoed"))
    return led.join(followed, "author_id", "full_outer").na.fill(0, ["seeded", "echoed"])


def templates(posts: DataFrame, texts: int = 3, authors: int = 3, length: int = 40) -> DataFrame:
    """Skeletons of some length that several authors filled with several texts."""
    x = posts.select("author_id", "text", T.skeleton(F.col("text")).alias("skeleton")).where(F.length("skeleton") >= length)
    out = x.groupBy("skeleton").agg(F.countDistinct("text").alias("n_texts"), F.countDistinct("author_id").alias("n_authors"), F.count(F.lit(1)).alias("n_posts"))
    return out.where((F.col("n_texts") >= texts) & (F.col("n_authors") >= authors))


def reply_targets(posts: DataFrame) -> DataFrame:
    """Per target the replies, repliers and median lag in minutes."""
    return reply_pairs(posts).groupBy("target").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("replier").alias("n_repliers"), (F.median("lag_s") / 60).alias("median_lag_min"))


def fast_repliers(posts: DataFrame, thread: int = 3, least: int = 5) -> DataFrame:
    """Per replier its mean arrival rank (0 first, 1 last) over busy threads, and z against uniform arrival."""
    p = reply_pairs(posts)
    w = Window.partitionBy("parent")
    order = w.orderBy("lag_s", "replier")
    size = F.count(F.lit(1)).over(w)
    ranked = p.withColumn("n_thread", size).withColumn("rank", F.row_number().over(order) / size).where(F.col("n_thread") >= thread)
    out = ranked.groupBy("replier").agg(F.count(F.lit(1)).alias("n"), F.avg("rank").alias("mean_rank")).where(F.col("n") >= least)
    return out.withColumn("z", (F.col("mean_rank") - 0.5) * F.sqrt(12 * F.col("n")))


def dogpiles(posts: DataFrame, repliers: int = 10, minutes: float = 120.0) -> DataFrame:
    """Posts with many repliers, nine in ten of whose replies came within minutes."""
    out = reply_pairs(posts).groupBy("parent").agg(F.countDistinct("replier").alias("n_repliers"), (F.percentile("lag_s", F.lit(0.9)) / 60).alias("p90_lag_min"))
    return out.where((F.col("n_repliers") >= repliers) & (F.col("p90_lag_min") <= minutes))


def step_jumps(curve: DataFrame, key: str, at: str, value: str, tie: str, least: int = 3) -> DataFrame:
    """Per growing curve the largest step's share of all growth, and when it came."""
    w = Window.partitionBy(key).orderBy(at, tie)
    steps = curve.withColumn("step", F.col(value) - F.lag(value).over(w)).where("step is not null")
    out = steps.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum("step").alias("growth"), F.max("step").alias("largest"), F.max_by(at, F.struct("step", tie)).alias("at"))
    return out.where((F.col("n") >= least) & (F.col("growth") > 0)).withColumn("share", F.col("largest") / F.col("growth"))


def follower_residual(posts: DataFrame, authors: DataFrame) -> DataFrame:
    """Per post log10 of its likes less the median of posts by accounts of like reach (half-decade buckets).

    Buckets are closed at the right and begin above one follower; accounts with one have none.
    """
    who = authors.select(F.col("platform_user_id").alias("author_id"), F.greatest("followers_count", F.lit(1)).alias("followers"))
    edge = F.ceil(F.log10("followers") * 2) / 2
    x = posts.join(who, "author_id").where("like_count > 0").select("platform_post_id", F.when(F.col("followers") > 1, edge).alias("bucket"), F.log10("like_count").alias("dex"))
    usual = x.where("bucket is not null").groupBy("bucket").agg(F.median("dex").alias("usual"))
    return x.join(F.broadcast(usual), "bucket", "left").withColumn("residual", F.col("dex") - F.col("usual"))


def laundering(stories: DataFrame, authors: DataFrame, big: int) -> DataFrame:
    """Per story its first author, and hours until an account of `big` followers carried it."""
    who = authors.select(F.col("platform_user_id").alias("author_id"), "followers_count")
    x = stories.join(who, "author_id", "left")
    large = F.coalesce(F.col("followers_count") >= big, F.lit(False))
    out = x.groupBy("story_id").agg(F.min("created_at").alias("t0"), F.min(F.when(large, F.col("created_at"))).alias("t1"), F.min_by("author_id", F.struct("created_at", "platform_post_id")).alias("first_author"), F.min_by(large, F.struct("created_at", "platform_post_id")).alias("first_is_big"))
    return out.select("story_id", "first_author", "first_is_big", ((F.unix_micros("t1") - F.unix_micros("t0")) / 3.6e9).alias("lag_h"))


def language_mix(posts: DataFrame, key: str) -> DataFrame:
    """Per group its posts by language and its share outside the commonest one."""
    n = posts.groupBy(key, F.coalesce("lang", F.lit("?")).alias("lang")).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(key).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_langs"), F.max_by("lang", F.struct("n", "lang")).alias("main"), (1 - F.max("n") / F.sum("n")).alias("other_share"))


def mutual_follows(follows: DataFrame) -> DataFrame:
    """Pairs (a < b) that follow each other."""
    d = follows.select(F.col("follower_id").alias("a"), F.col("followed_id").alias("b")).distinct()
    return d.where("a < b").join(d.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"], "left_semi")


def follow_density(follows: DataFrame, members: DataFrame) -> DataFrame:
    """Per cluster the share of ordered member pairs that follow."""
    d = follows.select("follower_id", "followed_id").distinct()
    a, b = members.select(F.col("author_id").alias("follower_id"), F.col("cluster_id").alias("ca")), members.select(F.col("author_id").alias("followed_id"), F.col("cluster_id").alias("cb"))
    inside = d.join(a, "follower_id").join(b, "followed_id").where("ca = cb").groupBy(F.col("ca").alias("cluster_id")).agg(F.count(F.lit(1)).alias("n"))
    size = members.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"))
    pairs = F.col("size") * (F.col("size") - 1)
    return size.join(inside, "cluster_id", "left").select("cluster_id", "size", F.coalesce(F.try_divide(F.coalesce("n", F.lit(0)), pairs), F.lit(0.0)).alias("density"))


def convergence(findings: DataFrame, least: int = 2) -> DataFrame:
    """Accounts that `least` lenses or more found (author_id, lens), with the lenses."""
    return findings.distinct().groupBy("author_id").agg(F.countDistinct("lens").alias("n_lenses"), F.array_join(F.array_sort(F.collect_set("lens")), ",").alias("lenses")).where(F.col("n_lenses") >= least)


def incitement_sweep(posts: DataFrame, menace: float = 0.85) -> DataFrame:
    """Posts (with lexicon_hits and menace): joint hits with menace, and menace alone, by rule."""
    hit, high = F.size("lexicon_hits") > 0, F.coalesce(F.col("menace") >= menace, F.lit(False))
    rule = F.when(hit & high, "joint").when(high, "menace_only").when(hit, "lexicon_only")
    return posts.withColumn("rule", rule).where("rule is not null")


def drawn_groups(sizes: DataFrame, pool: DataFrame, draws: int, seed: int = 0) -> DataFrame:
    """(cluster_id, draw, author_id): per cluster of sizes (cluster_id, size) and draw, size distinct accounts of pool.

    A draw takes places b, b + a, b + 2a ... modulo a prime no smaller than the pool, in an order of the
    pool by hash: distinct accounts, and as many rows as are drawn.
    """
    placed = numbered(pool.select("author_id"), F.xxhash64(F.lit(seed), "author_id"), F.col("author_id"), out="place")
    n = placed.count()
    prime = next(p for p in range(max(n, 2), 2 * max(n, 2) + 2) if all(p % d for d in range(2, int(p**0.5) + 1)))
    drawn = sizes.select("cluster_id", "size", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw"))
    step = F.pmod(F.xxhash64(F.lit(seed + 1), "cluster_id", "draw"), F.lit(prime - 1)) + 1
    start = F.pmod(F.xxhash64(F.lit(seed + 2), "cluster_id", "draw"), F.lit(prime))
    # At most prime - n places are beyond the pool, so size places within it are among so many.
    picks = drawn.select("cluster_id", "draw", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") + (prime - n) - 1)).alias("i"), step.alias("a"), start.alias("b"))
    picks = picks.withColumn("place", F.pmod(F.col("b") + F.col("i") * F.col("a"), F.lit(prime))).where(F.col("place") < n)
    w = Window.partitionBy("cluster_id", "draw").orderBy("i")
    picks = picks.withColumn("_r", F.row_number().over(w)).where("_r <= size")
    return picks.join(placed, "place").select("cluster_id", "draw", "author_id")


def random_subsets(members: DataFrame, pool: DataFrame, value: str, draws: int, seed: int = 0) -> DataFrame:
    """Per cluster the mean of value, and its rank among means of as many accounts drawn at random.

    p_value = (1 + draws with a mean as large) / (1 + draws).
    """
    own = checkpointed(members.join(pool, "author_id").groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"), F.avg(value).alias("mean")))
    picks = drawn_groups(own.select("cluster_id", "size"), pool, draws, seed)
    means = picks.join(pool.select("author_id", F.col(value).alias("v")), "author_id").groupBy("cluster_id", "draw").agg(F.avg("v").alias("m"))
    hits = means.join(own, "cluster_id").groupBy("cluster_id").agg(S.count_if(F.col("m") >= F.col("mean")).alias("k"))
    return own.join(hits, "cluster_id").select("cluster_id", "size", "mean", ((1 + F.col("k")) / (1 + F.lit(draws))).alias("p_value"))


def language_gap(stories: DataFrame, one: str = "en", two: str = "sw", least: int = 3) -> DataFrame:
    """Per story told in both languages: posts in each, share of negative ones in each, and the gap between these."""
    def of(lang: str):
        own = F.col("lang") == lang
        bad = F.when(own & F.col("sentiment").isNotNull(), (F.col("sentiment") == "negative").cast("double"))
        return [S.count_if(own).alias(f"n_{lang}"), F.avg(bad).alias(f"neg_share_{lang}")]

    out = stories.groupBy("story_id").agg(*of(one), *of(two)).where((F.col(f"n_{one}") >= least) & (F.col(f"n_{two}") >= least))
    return out.withColumn("neg_gap", F.abs(F.coalesce(f"neg_share_{one}", F.lit(0.0)) - F.coalesce(f"neg_share_{two}", F.lit(0.0))))


def marker_calibration(posts: DataFrame, lang: str, markers: Sequence[str]) -> DataFrame:
    """One row: posts tagged lang, those of them with a word of another language, and the share."""
    hit = F.coalesce(F.lower("text").rlike(r"\b(" + "|".join(markers) + r")\b"), F.lit(False))
    out = posts.where(F.col("lang") == lang).agg(F.count(F.lit(1)).alias("n"), S.count_if(hit).alias("marked"))
    return out.withColumn("share", F.col("marked") / F.greatest("n", F.lit(1)))
