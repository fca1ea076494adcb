"""Ground-truth evaluation, baselines, encoders and names."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

STAGES = ("presence", "embedding", "clustering", "tier", "rank")


def resolve_posts(posts: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """Posts whose text has any of the patterns, ignoring case."""
    hit = F.lit(False)
    for p in patterns:
        hit = hit | F.col("text").ilike(p)
    return posts.where(hit)


def first_drop(truth: DataFrame, present: DataFrame, embedded: DataFrame, clustered: DataFrame, tiered: DataFrame, ranked: DataFrame) -> DataFrame:
    """Per case of truth (case_id, platform_post_id): how many posts reach each stage, and the first stage with none.

    The others hold the posts that passed a stage. dropped_at is null for a case that reaches the ranking.
    """
    out = truth
    for name, have in zip(STAGES, (present, embedded, clustered, tiered, ranked)):
        mark = have.select("platform_post_id").distinct().withColumn(f"in_{name}", F.lit(1))
        out = out.join(mark, "platform_post_id", "left")
    counts = out.groupBy("case_id").agg(*[F.sum(F.coalesce(f"in_{s}", F.lit(0))).alias(f"n_{s}") for s in STAGES])
    gone = None
    for s in STAGES:
        gone = F.when(F.col(f"n_{s}") == 0, s) if gone is None else gone.when(F.col(f"n_{s}") == 0, s)
    return counts.withColumn("dropped_at", gone)


def triage_cut(n: int) -> int:
    """Rows that a reviewer reads: 15 % of them, 20 at least."""
    return max(-(-15 * n // 100), 20)


def baseline(train: DataFrame, test: DataFrame, features: int = 1 << 16) -> DataFrame:
    """test with prediction from TF-IDF and logistic regression, fitted on train (text, label as double)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer

    steps = [RegexTokenizer(inputCol="text", outputCol="_w", pattern=r"\W+"), HashingTF(inputCol="_w", outputCol="_f", numFeatures=features), IDF(inputCol="_f", outputCol="_x", minDocFreq=2), LogisticRegression(featuresCol="_x", labelCol="label", maxIter=30, regParam=0.01)]
    return Pipeline(stages=steps).fit(train).transform(test).drop("_w", "_f", "_x", "rawPrediction")


def encode(posts: DataFrame, dim: int = 64) -> DataFrame:
    """(platform_post_id, embedding): unit vectors from hashed words and word pairs. Any encoder of batches can stand in."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = np.zeros((len(pdf), dim), np.float32)
            for i, text in enumerate(pdf["text"].fillna("")):
                words = text.lower().split()
                for f in [*words, *map(" ".join, zip(words, words[1:]))]:
                    h = zlib.crc32(f.encode())
                    out[i, h % dim] += 1 if h >> 16 & 1 else -1
            out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)
            yield pd.DataFrame({"platform_post_id": pdf["platform_post_id"], "embedding": list(out)})

    return posts.select("platform_post_id", "text").mapInPandas(run, "platform_post_id string, embedding array<float>")


def names(terms: DataFrame, sizes: DataFrame, key: str, n: int = 3) -> DataFrame:
    """Per group a name of its first terms and its size; groups that share a name get a number."""
    first = terms.where(F.col("rank") <= n).groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]), " / ").alias("base"))
    both = sizes.join(first, key, "left").withColumn("base", F.coalesce("base", F.lit("mixed")))
    w = Window.partitionBy("base").orderBy(F.desc("size"), key)
    again = F.row_number().over(w)
    return both.withColumn("name", F.concat("base", F.when(again > 1, F.concat(F.lit(" "), again.cast("string"))).otherwise(""), F.lit(" (n="), F.col("size").cast("string"), F.lit(")"))).drop("base")


def claim_coordination(story: DataFrame, edges: DataFrame) -> DataFrame:
    """One row on the accounts of a story: how many, the validated pairs among them, the accounts in such pairs, density."""
    who = story.select("author_id").distinct()
    a, b = who.withColumnRenamed("author_id", "src"), who.withColumnRenamed("author_id", "dst")
    inside = edges.join(a, "src", "left_semi").join(b, "dst", "left_semi")
    pairs = inside.agg(F.count(F.lit(1)).alias("n_edges"), F.coalesce(F.max("weight"), F.lit(0)).alias("max_weight"))
    linked = inside.select(F.explode(F.array("src", "dst")).alias("x")).agg(F.countDistinct("x").alias("n_linked"))
    size = who.agg(F.count(F.lit(1)).alias("n_accounts"))
    return size.crossJoin(pairs).crossJoin(linked).withColumn("density", F.coalesce(F.try_divide(2 * F.col("n_edges"), F.col("n_accounts") * (F.col("n_accounts") - 1)), F.lit(0.0)))


def trajectories(posts_raw: DataFrame, n: int = 100, snapshots: int = 3) -> DataFrame:
    """The n posts of most likes: snapshots, first and peak, and which of those with enough snapshots leads."""
    by = posts_raw.groupBy("platform_post_id").agg(F.count(F.lit(1)).alias("n_snapshots"), F.max("like_count").alias("peak"), F.min_by("like_count", "collected_at").alias("first"))
    top = by.orderBy(F.desc("peak"), "platform_post_id").limit(n)
    lead = top.where(F.col("n_snapshots") >= snapshots).agg(F.max_by("platform_post_id", F.struct("peak", "platform_post_id")).alias("_lead"))
    return top.crossJoin(F.broadcast(lead)).withColumn("leads", F.coalesce(F.col("platform_post_id") == F.col("_lead"), F.lit(False))).drop("_lead")


def language_mask(docs: DataFrame, expected: Sequence[str], markers: Sequence[str], least: int = 40) -> DataFrame:
    """docs with keep: short texts, texts with a marker word and texts of an expected language stay."""
    low = F.lower(F.coalesce("text", F.lit("")))
    marked = low.rlike(r"\b(" + "|".join(markers) + r")\b") if markers else F.lit(False)
    return docs.withColumn("keep", (F.length(low) < least) | marked | F.coalesce(F.col("lang").isin(*expected), F.lit(False)))


def gold_split(merged: DataFrame, challenge: Sequence[str]) -> DataFrame:
    """Adjudicated rows as gold, or challenge where their stratum is one of the hard ones; the rest has none."""
    return merged.withColumn("pool", F.when(F.col("final").isNull(), F.lit(None)).when(F.col("stratum").isin(*challenge), "challenge").otherwise("gold"))


def gates(metrics: DataFrame, least_recall: float, least_precision: float) -> DataFrame:
    return metrics.withColumn("passes", (F.col("recall") >= least_recall) & (F.col("precision") >= least_precision))
