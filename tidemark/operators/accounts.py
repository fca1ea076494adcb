"""Account authenticity: profile and behaviour features, weighted suspicion, isolation forest."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import stats as S
from tidemark.functions import text as T
from tidemark.operators.latest import POST_KEY, latest

#: The weights of the suspicion score.
WEIGHTS = {"ratio": 0.30, "age": 0.25, "rate": 0.15, "dup": 0.15, "bio": 0.05, "img": 0.05, "handle": 0.05}


def behaviour(posts: DataFrame, text_key: Column | None = None) -> DataFrame:
    """Per author of latest posts: n_posts, reply, repost and quote ratios, and the share of repeated texts (by text_key)."""
    text_key = T.text_key(F.col("text")) if text_key is None else text_key
    quote = S.share(F.col("is_quote")) if "is_quote" in posts.columns else F.lit(0.0)
    return posts.groupBy("author_id").agg(
        F.count(F.lit(1)).alias("n_posts"),
        S.share(F.col("in_reply_to_id").isNotNull()).alias("reply_ratio"),
        F.avg(F.col("is_repost").cast("int")).alias("repost_ratio"),
        quote.alias("quote_ratio"),
        (1 - F.countDistinct(text_key) / F.count(F.lit(1))).alias("duplicate_text_ratio"),
    )


def author_features(authors: DataFrame, posts: DataFrame, as_of: str) -> DataFrame:
    """One row per author: the newest profile, ages and ratios at as_of, and behaviour (zeros without posts)."""
    profile = latest(authors, ("platform", "platform_user_id"), "collected_at")
    # Of a text only whether it repeats counts: a digest of its key goes through the shuffles, not the text.
    needed = [c for c in (*POST_KEY, "collected_at", "author_id", "in_reply_to_id", "is_repost", "is_quote") if c in posts.columns]
    slim = posts.select(*needed, F.md5(T.text_key(F.col("text"))).alias("_text"))
    own = behaviour(latest(slim, POST_KEY, "collected_at"), F.col("_text"))
    day = F.datediff(F.lit(as_of).cast("timestamp"), "created_at")
    out = profile.join(own.withColumnRenamed("author_id", "platform_user_id"), "platform_user_id", "left")
    out = out.na.fill(0, ["n_posts"]).na.fill(0.0, ["reply_ratio", "repost_ratio", "quote_ratio", "duplicate_text_ratio"])
    one = F.lit(1)
    return out.withColumns(
        {
            "account_age_days": F.greatest(day, F.lit(0)),
            "followers_following_ratio": F.col("followers_count") / F.greatest("following_count", one),
            "tweet_rate": F.col("tweet_count") / F.greatest(day, one),
            "listed_ratio": F.col("listed_count") / F.greatest("followers_count", one),
            "empty_bio": F.col("bio").isNull() | (F.col("bio") == ""),
            "default_profile_image": F.coalesce(F.lower("profile_image_url").contains("default_profile"), F.lit(False)),
            "handle_digit_ratio": T.digit_share(F.col("handle")),
        }
    )


def suspicion(features: DataFrame) -> DataFrame:
    """features with the sub-scores s_* and their weighted sum. A triage aid, never a verdict on an account."""
    parts = {
        "ratio": 1 / (1 + F.col("followers_following_ratio")),
        "age": F.greatest(F.lit(0.0), 1 - F.col("account_age_days") / 365),
        "rate": F.least(F.lit(1.0), F.col("tweet_rate") / 50),
        "dup": F.col("duplicate_text_ratio"),
        "bio": F.col("empty_bio").cast("int"),
        "img": F.col("default_profile_image").cast("int"),
        "handle": F.col("handle_digit_ratio"),
    }
    out = features.withColumns({f"s_{k}": v for k, v in parts.items()})
    return out.withColumn("suspicion", sum((WEIGHTS[k] * F.col(f"s_{k}") for k in parts), F.lit(0.0)))


LOGGED = ("followers_count", "following_count", "tweet_count", "listed_count", "tweet_rate", "followers_following_ratio")
ANOMALY = ("account_age_days", *LOGGED[:4], "followers_following_ratio", "tweet_rate", "listed_ratio", "duplicate_text_ratio", "reply_ratio", "repost_ratio", "quote_ratio", "handle_digit_ratio")


def _tree(x: np.ndarray, rng: np.random.Generator, depth: int = 0, limit: int = 8):
    n = len(x)
    spread = np.flatnonzero(x.max(axis=0) > x.min(axis=0)) if n > 1 else []
    if depth >= limit or not len(spread):
        return n
    f = int(rng.choice(spread))
    cut = rng.uniform(x[:, f].min(), x[:, f].max())
    left = x[:, f] < cut
    return f, float(cut), _tree(x[left], rng, depth + 1, limit), _tree(x[~left], rng, depth + 1, limit)


def _expected(n: float) -> float:
    return 0.0 if n <= 1 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def _depths(x: np.ndarray, node, depth: int, out: np.ndarray, rows: np.ndarray) -> None:
    if not isinstance(node, tuple):
        out[rows] += depth + _expected(node)
        return
    f, cut, left, right = node
    low = x[rows, f] < cut
    _depths(x, left, depth + 1, out, rows[low])
    _depths(x, right, depth + 1, out, rows[~low])


def anomaly(features: DataFrame, id_column: str, trees: int = 200, sample: int = 256, seed: int = 0) -> DataFrame:
    """id, anomaly_score (higher: more unusual) and anomaly_rank from an isolation forest.

    Fitted on the `sample` rows first by a hash of the id, as the method samples for each tree; every
    row is scored. Fewer than 51 rows have no score.
    """
    x = features.select(id_column, *[(F.log1p(F.greatest(F.col(c).cast("double"), F.lit(0.0))) if c in LOGGED else F.col(c).cast("double")).alias(c) for c in ANOMALY]).na.fill(0.0)
    if x.limit(51).count() < 51:
        return x.select(id_column, F.lit(None).cast("double").alias("anomaly_score"), F.lit(None).cast("double").alias("anomaly_rank"))
    pool = x.orderBy(F.xxhash64(F.lit(seed), id_column), id_column).limit(8 * sample).toPandas()[list(ANOMALY)].to_numpy()
    rng = np.random.default_rng(seed)
    grown = [_tree(pool[rng.choice(len(pool), min(sample, len(pool)), replace=False)], rng) for _ in range(trees)]
    shared = features.sparkSession.sparkContext.broadcast((grown, _expected(min(sample, len(pool)))))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forest, usual = shared.value
        for pdf in batches:
            v = pdf[list(ANOMALY)].to_numpy()
            total = np.zeros(len(v))
            for tree in forest:
                _depths(v, tree, 0, total, np.arange(len(v)))
            yield pd.DataFrame({id_column: pdf[id_column], "anomaly_score": 2.0 ** -(total / len(forest) / usual)})

    scored = x.mapInPandas(score, f"{id_column} {dict(features.dtypes)[id_column]}, anomaly_score double")
    return S.with_pct_rank(scored, "anomaly_score", "anomaly_rank")
