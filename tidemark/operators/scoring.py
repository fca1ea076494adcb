"""Incremental scoring passes: what is pending goes through a scorer, and the result to a sink."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import lexicon as X
from tidemark.operators import latest as L

#: Columns that a scorer of incitement gives.
MENACE = ("dehumanisation_score", "violence_call_score", "othering_score", "political_criticism_score")


def score_pending(posts: DataFrame, done: DataFrame, scorer: Callable[[DataFrame], DataFrame], limit: int = 500, hits_first: bool = False) -> DataFrame:
    """scorer's columns for at most `limit` latest posts with text that done does not hold; newest, or lexicon hits, first.

    scorer takes (platform_post_id, text) and gives platform_post_id and scores: a mapInPandas of a model, say.
    """
    latest = L.latest(posts, L.POST_KEY, "collected_at")
    todo = L.pending(latest, done, limit, F.size(X.hits(F.col("text"))) > 0 if hits_first else None)
    return scorer(todo.select("platform_post_id", "text"))


def incitement_pass(posts: DataFrame, done: DataFrame, scorer: Callable[[DataFrame], DataFrame], limit: int = 500) -> DataFrame:
    """Menace scores and lexicon columns of pending posts, those with lexicon hits first. A score that is missing is null."""
    def with_lexicon(todo: DataFrame) -> DataFrame:
        scored = scorer(todo)
        gone = [F.lit(None).cast("double").alias(c) for c in MENACE if c not in scored.columns]
        scored = scored.select("platform_post_id", *[c for c in MENACE if c in scored.columns], *gone)
        own = todo.select("platform_post_id", X.hits(F.col("text")).alias("lexicon_hits"))
        return own.withColumn("lexicon_categories", X.categories(F.col("lexicon_hits"))).join(scored, "platform_post_id", "left")

    return score_pending(posts, done, with_lexicon, limit, hits_first=True)


def stance(posts: DataFrame, target: str, scorer: Callable[[DataFrame], DataFrame], limit: int = 200) -> DataFrame:
    """scorer's columns for the newest `limit` latest posts that name target."""
    own = L.latest(posts, L.POST_KEY, "collected_at").where(F.col("text").ilike(f"%{target}%"))
    return scorer(own.orderBy(F.desc("created_at"), "platform_post_id").limit(limit).select("platform_post_id", "text"))


def labelled(scores: DataFrame, classes: Sequence[str] = ("neither", "offensive", "hate"), at: float = X.FLAG_AT) -> DataFrame:
    """scores (p_<class> each) with label, the likeliest class (the first of equals), and hate_flag, p_hate of `at` or more."""
    return scores.withColumn("label", X.label_of([(c, F.col(f"p_{c}")) for c in classes])).withColumn("hate_flag", F.col("p_hate") >= at)
