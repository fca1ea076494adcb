"""Topics and stories: class-based TF-IDF, claim clusters, corroboration, scorecards, tiers, spread."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import stats as S
from tidemark.functions import text as T
from tidemark.functions.order import checkpointed, numbered
from tidemark.operators import graphs, vectors
from tidemark.operators import latest as L

#: Gates and weights of the method.
MIN_SIZE, THIN_SIZE, THIN_GAP, MIN_WORDS, MAX_AUTHORS, MIN_COHESION, MIN_SHARED = 3, 2, 0.95, 5, 150, 0.80, 3
STORY_WEIGHTS = {"corroboration_gap": 0.25, "amplifier_botness": 0.25, "coordination_overlap": 0.20, "reach": 0.20, "source_concentration": 0.10}
CLUSTER_WEIGHTS = {"bot_likeness": 0.30, "synchrony": 0.20, "homogeneity": 0.20, "concealment": 0.15, "corroboration": 0.15}


def class_terms(docs: DataFrame, key: str, text: str, top: int = 8, least_classes: int = 1, stop: Sequence[str] = ()) -> DataFrame:
    """The top terms of each class by tf / words of the class * ln(1 + mean words of a class / all uses of the term).

    Returns key, term, weight, rank; ties by term. least_classes drops terms of fewer classes.
    """
    words = docs.select(key, F.explode(T.topic_tokens(F.col(text))).alias("term"))
    words = words.where(~F.col("term").isin(list(stop))) if stop else words
    tf = words.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))
    size = tf.groupBy(key).agg(F.sum("tf").alias("words"))
    mean = size.agg(F.greatest(F.avg("words"), F.lit(1.0)).alias("mean"))
    use = tf.groupBy("term").agg(F.sum("tf").alias("total"), F.count(F.lit(1)).alias("classes")).where(F.col("classes") >= least_classes)
    w = F.col("tf") / F.greatest("words", F.lit(1)) * F.log(1 + F.col("mean") / F.greatest("total", F.lit(1)))
    scored = tf.join(use, "term").join(F.broadcast(size), key).crossJoin(F.broadcast(mean)).select(key, "term", w.alias("weight"))
    order = Window.partitionBy(key).orderBy(F.desc(F.round("weight", 10)), "term")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def components_within(posts: DataFrame, tau: float) -> DataFrame:
    """(id, component) of vectors linked by cosine >= tau; lone ones are their own component."""
    links = vectors.radius_links(posts.select("id", "vec"), tau)
    found = graphs.connected_components(links.select("src", "dst")).withColumnRenamed("node", "id")
    return posts.select("id").join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def chained(members: DataFrame, authors: int = MAX_AUTHORS, cohesion: float = MIN_COHESION) -> DataFrame:
    """Components (component) that are both large and dispersed: chains of unlike claims, not stories."""
    unit = members.select("component", vectors.normalised(F.col("vec")).alias("v"))
    tight = vectors.centroids(unit, "component", "v").select("component", "cohesion")
    size = members.groupBy("component").agg(F.countDistinct("author_id").alias("n"))
    return size.join(tight, "component").where((F.col("n") > authors) & (F.col("cohesion") < cohesion)).select("component")


def candidate_stories(posts: DataFrame, tau: float = 0.80, least: int = MIN_SIZE) -> DataFrame:
    """posts (id, platform_post_id, author_id, text, vec, ...) in stories, with story_id and stable_story_id.

    Informative independent posts, linked by likeness; chains are rejected and stories need `least`
    authors. Ids run from 0 by falling number of posts, ties by stable id.
    """
    kept = L.informative(L.independent_voices(posts), MIN_WORDS)
    members = kept.join(components_within(kept, tau), "id")
    members = members.join(chained(members), "component", "left_anti")
    size = members.groupBy("component").agg(F.countDistinct("author_id").alias("authors"), F.count(F.lit(1)).alias("n"), T.stable_id(F.collect_list("platform_post_id")).alias("stable_story_id")).where(F.col("authors") >= least)
    ranked = numbered(size, F.desc("n"), F.col("stable_story_id"), out="story_id")
    return members.join(ranked.select("component", "story_id", "stable_story_id"), "component").drop("component")


def corroboration(stories: DataFrame, trusted: DataFrame, stop: Sequence[str] = (), least: int = MIN_SHARED) -> DataFrame:
    """story_id, corrob_sim and the nearest trusted post that shares the claim's words and, if it names any, an entity.

    No such post: 0 and nulls. Pairs are formed on shared terms, so unrelated posts never meet.
    """
    unit = stories.withColumn("v", vectors.normalised(F.col("vec")))
    mean = vectors.centroids(unit, "story_id", "v").select("story_id", vectors.normalised(F.col("centroid")).alias("centroid"))
    terms = stories.select("story_id", F.explode(T.salient_terms(F.col("text"), stop)).alias("term")).distinct()
    names = stories.select("story_id", F.explode(T.entity_terms(F.col("text"), stop)).alias("term")).distinct()
    own = trusted.select("platform_post_id", F.explode(T.salient_terms(F.col("text"), stop)).alias("term"))
    shared = terms.join(own, "term").groupBy("story_id", "platform_post_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    named = trusted.select("platform_post_id", F.explode(T.entity_terms(F.col("text"), stop)).alias("term"))
    both = names.join(named, "term").select("story_id", "platform_post_id").distinct().withColumn("entity", F.lit(True))
    has_names = names.select("story_id").distinct().withColumn("names", F.lit(True))
    gated = shared.join(both, ["story_id", "platform_post_id"], "left").join(has_names, "story_id", "left").where(F.col("names").isNull() | F.col("entity"))
    sims = gated.join(mean, "story_id").join(trusted.select("platform_post_id", "author_handle", "text", vectors.normalised(F.col("vec")).alias("v")), "platform_post_id")
    sims = sims.withColumn("sim", vectors.dot(F.col("centroid"), F.col("v")))
    best = sims.groupBy("story_id").agg(F.max_by(F.struct("sim", "author_handle", "text", "platform_post_id"), F.struct(F.round("sim", 9), "platform_post_id")).alias("b"))
    every = stories.select("story_id").distinct().join(best, "story_id", "left")
    return every.select("story_id", F.coalesce("b.sim", F.lit(0.0)).alias("corrob_sim"), F.col("b.author_handle").alias("nearest_handle"), F.col("b.text").alias("nearest_text"), F.col("b.platform_post_id").alias("nearest_post_id"))


def representatives(stories: DataFrame) -> DataFrame:
    """Per story the post nearest its centroid (ties: smallest id)."""
    unit = stories.withColumn("v", vectors.normalised(F.col("vec")))
    mean = vectors.centroids(unit, "story_id", "v").select("story_id", "centroid")
    near = unit.join(mean, "story_id").withColumn("s", F.round(vectors.dot(F.col("centroid"), F.col("v")), 9))
    w = Window.partitionBy("story_id").orderBy(F.desc("s"), "platform_post_id")
    return near.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("story_id", F.col("platform_post_id").alias("representative_post_id"), F.col("text").alias("representative_text"))


def top_hashtags(stories: DataFrame, n: int = 5) -> DataFrame:
    tags = stories.select("story_id", F.explode(F.transform("hashtags", lambda h: F.concat(F.lit("#"), F.lower(h)))).alias("tag"))
    w = Window.partitionBy("story_id").orderBy(F.desc("n"), "tag")
    return tags.groupBy("story_id", "tag").agg(F.count(F.lit(1)).alias("n")).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def _weighted_ranks(df: DataFrame, columns: dict[str, tuple[str, bool]], weights: dict[str, float], out: str) -> DataFrame:
    """df with ix_<name> for each ranked column (name -> column, descending) and their weighted sum; null ranks count 0."""
    df = checkpointed(df)
    for name, (column, down) in columns.items():
        # Twelve places: values that are equal but for the order of a sum rank alike.
        df = df.withColumn("_v", F.round(F.col(column).cast("double"), 12))
        df = S.with_pct_rank(df, "_v", f"ix_{name}", descending=down).na.fill(0.0, [f"ix_{name}"]).drop("_v")
    return df.withColumn(out, sum((w * F.col(f"ix_{k}") for k, w in weights.items()), F.lit(0.0)))


def story_scorecard(stories: DataFrame, suspicion: DataFrame, cluster_members: DataFrame, corrob: DataFrame) -> DataFrame:
    """Per story its size, ranked components and story_suspicion_index. For human review, never a verdict."""
    pairs = stories.select("story_id", "author_id").distinct()
    flagged = cluster_members.select("author_id").distinct().withColumn("flag", F.lit(1))
    people = pairs.join(suspicion.select("author_id", "suspicion"), "author_id", "left").join(flagged, "author_id", "left")
    people = people.groupBy("story_id").agg(F.count(F.lit(1)).alias("size"), F.avg("suspicion").alias("amplifier_botness"), F.avg(F.coalesce("flag", F.lit(0))).alias("coordination_overlap"))
    card = people.join(stories.groupBy("story_id").agg(F.count(F.lit(1)).alias("n_posts"), F.first("stable_story_id").alias("stable_story_id")), "story_id")
    card = card.join(corrob.select("story_id", "corrob_sim"), "story_id", "left").withColumn("corroboration_gap", 1 - F.coalesce("corrob_sim", F.lit(0.0)))
    card = card.withColumn("source_concentration", F.col("n_posts") / F.greatest("size", F.lit(1)))
    ranked = {"corroboration_gap": ("corroboration_gap", False), "amplifier_botness": ("amplifier_botness", False), "coordination_overlap": ("coordination_overlap", False), "reach": ("size", False), "source_concentration": ("source_concentration", False)}
    return _weighted_ranks(card, ranked, STORY_WEIGHTS, "story_suspicion_index")


def assign_tiers(card: DataFrame, stories: DataFrame) -> DataFrame:
    """Main stories, and thin evidence: two authors, hardly corroborated, with a named entity. Others go.

    Thin stories are of high suspicion only with bot-like or coordinated amplifiers, main ones by index.
    """
    named = stories.where(F.size(T.entity_terms(F.col("text"), ())) > 0).select("story_id").distinct().withColumn("named", F.lit(True))
    size, gap = F.col("size"), F.coalesce("corroboration_gap", F.lit(0.0))
    tier = F.when(size >= MIN_SIZE, "main").when((size >= THIN_SIZE) & (gap >= THIN_GAP) & F.coalesce("named", F.lit(False)), "thin_evidence")
    amplified = (F.coalesce("amplifier_botness", F.lit(0.0)) >= 0.5) | (F.coalesce("coordination_overlap", F.lit(0.0)) > 0)
    high = F.when(F.col("tier") == "thin_evidence", amplified).otherwise(F.coalesce("story_suspicion_index", F.lit(0.0)) >= 0.5)
    return card.join(named, "story_id", "left").withColumn("tier", tier).where("tier is not null").withColumn("high_suspicion", high).drop("named")


def cluster_scorecard(members: DataFrame, features: DataFrame, posts: DataFrame, corroborated: DataFrame | None = None) -> DataFrame:
    """Per cluster its profile means, homogeneity of posts (with vec), channels, and inauthenticity_index."""
    mark = features.agg(F.percentile("suspicion", F.lit(0.9)).alias("p90"))
    who = members.join(features, "author_id").crossJoin(F.broadcast(mark))
    n = F.count(F.lit(1))
    card = who.groupBy("cluster_id").agg(
        n.alias("size"),
        F.avg("suspicion").alias("suspicion_mean"),
        F.avg((F.col("suspicion") > F.col("p90")).cast("int")).alias("share_suspicion_p90"),
        F.avg(F.col("default_profile_image").cast("int")).alias("share_default_image"),
        F.avg(F.col("empty_bio").cast("int")).alias("share_empty_bio"),
        F.avg("handle_digit_ratio").alias("handle_digit_ratio_mean"),
        (1 - F.countDistinct("profile_image_url") / F.greatest(n, F.lit(1))).alias("shared_profile_image"),
        F.sum("followers_count").alias("followers_sum"),
    )
    own = members.join(posts, "author_id")
    reach = own.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n_posts"), F.sum(F.coalesce("engagement", F.lit(0))).alias("engagement_sum"))
    like = vectors.mean_pairwise(own.where("vec is not null"), "cluster_id", "vec").select("cluster_id", F.col("mean_cosine").alias("near_dup_rate"))
    card = card.join(reach, "cluster_id", "left").join(like, "cluster_id", "left")
    if corroborated is not None:
        a, b = (members.select(F.col("author_id").alias(s), F.col("cluster_id").alias(f"{s}_c")) for s in ("src", "dst"))
        inside = corroborated.join(a, "src").join(b, "dst").where("src_c = dst_c").withColumnRenamed("src_c", "cluster_id")
        gaps = inside.groupBy("cluster_id").agg(F.median("min_gap").alias("median_min_gap_s"), F.size(F.array_distinct(F.flatten(F.collect_list("channels")))).alias("n_channels"))
        card = card.join(gaps, "cluster_id", "left")
    else:
        card = card.withColumn("median_min_gap_s", F.lit(None).cast("double")).withColumn("n_channels", F.lit(0))
    hidden = (F.col("share_default_image") + F.col("share_empty_bio") + F.col("handle_digit_ratio_mean") + F.col("shared_profile_image")) / 4
    card = card.withColumn("engagement_per_follower", F.col("engagement_sum") / F.greatest("followers_sum", F.lit(1))).withColumn("concealment", hidden)
    ranked = {"bot_likeness": ("suspicion_mean", False), "synchrony": ("median_min_gap_s", True), "homogeneity": ("near_dup_rate", False), "concealment": ("concealment", False), "corroboration": ("n_channels", False)}
    return _weighted_ranks(card, ranked, CLUSTER_WEIGHTS, "inauthenticity_index")


def cluster_hate(members: DataFrame, posts: DataFrame, toxic: DataFrame) -> DataFrame:
    """Per cluster the toxic and coded shares, the spread of toxic posts over accounts (Herfindahl), and hate_index."""
    flagged = members.join(posts, "author_id").join(toxic.select("platform_post_id", "toxic", "coded_suspect"), "platform_post_id", "left").na.fill(False, ["toxic", "coded_suspect"])
    per = flagged.groupBy("cluster_id", "author_id").agg(F.count(F.lit(1)).alias("n"), S.count_if(F.col("toxic")).alias("k"), S.count_if(F.col("coded_suspect")).alias("c"))
    total = F.sum("k").over(Window.partitionBy("cluster_id"))
    per = per.withColumn("s2", F.try_divide(F.col("k"), total) ** 2)
    out = per.groupBy("cluster_id").agg(F.sum("n").alias("n_posts"), (F.sum("k") / F.sum("n")).alias("toxic_share"), (F.sum("c") / F.sum("n")).alias("coded_share"), F.sum("s2").alias("hhi"))
    return out.withColumn("hate_index", 0.5 * F.col("toxic_share") + 0.2 * F.col("coded_share") + 0.3 * F.coalesce(1 - F.col("hhi"), F.lit(0.0)))


def origin(stories: DataFrame, suspicion: DataFrame, n: int = 15) -> DataFrame:
    w = Window.partitionBy("story_id").orderBy("created_at", "platform_post_id")
    first = stories.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    return first.join(suspicion.select("author_id", "suspicion"), "author_id", "left").select("story_id", "rank", "platform_post_id", "author_id", "created_at", "suspicion")


def spread(stories: DataFrame, posts: DataFrame) -> DataFrame:
    """Per story the distinct accounts that reposted or answered its posts, and in all."""
    ids = stories.select("story_id", F.col("platform_post_id").alias("ref")).distinct()
    shares = posts.select(F.col("repost_of_id").alias("ref"), "author_id", F.lit("retweeter").alias("role")).where("ref is not null")
    replies = posts.select(F.col("in_reply_to_id").alias("ref"), "author_id", F.lit("replier").alias("role")).where("ref is not null")
    both = ids.join(shares.unionByName(replies), "ref")
    return both.groupBy("story_id").agg(F.countDistinct(F.when(F.col("role") == "retweeter", F.col("author_id"))).alias("n_retweeters"), F.countDistinct(F.when(F.col("role") == "replier", F.col("author_id"))).alias("n_repliers"), F.countDistinct("author_id").alias("n_accounts"))


def story_topics(stories: DataFrame, topics: DataFrame, n: int = 3) -> DataFrame:
    """The commonest topics of each story's posts and their share; noise (-1) only where there is nothing else."""
    each = stories.select("story_id", "platform_post_id").join(topics.select("platform_post_id", "topic"), "platform_post_id")
    total = each.groupBy("story_id").agg(F.count(F.lit(1)).alias("all"), F.max((F.col("topic") >= 0).cast("int")).alias("real"))
    counts = each.groupBy("story_id", "topic").agg(F.count(F.lit(1)).alias("n")).join(total, "story_id").where((F.col("topic") >= 0) | (F.col("real") == 0))
    w = Window.partitionBy("story_id").orderBy(F.desc("n"), "topic")
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select("story_id", "rank", "topic", (F.col("n") / F.col("all")).alias("share"))


def content_clusters(rows: DataFrame, tau: float = 0.9, least: int = 2) -> DataFrame:
    """(id, cluster_id) of rows (id, vec) in likeness components of at least `least` rows: the smallest id names one.

    What the text_sim channel takes as content.
    """
    found = components_within(rows, tau)
    size = found.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return found.join(size.select("component"), "component", "left_semi").select("id", F.col("component").alias("cluster_id"))


def assign_topics(rows: DataFrame, tau: float = 0.35, least: int = 10, core: int = 5) -> DataFrame:
    """(id, topic) of rows (id, vec) by density: topics are numbered by falling size, -1 is noise.

    A row with `core` others or more within cosine tau is dense; linked dense rows are one topic, and
    another row belongs to the topic of its nearest dense neighbour (ties: smallest id). Topics of fewer
    than `least` rows are noise. Density clustering of the vectors themselves, at one level: there is no
    projection to fewer dimensions before it and no hierarchy of levels.
    """
    links = checkpointed(vectors.radius_links(rows.select("id", "vec"), tau))
    both = links.select(F.col("src").alias("id"), F.col("dst").alias("other"), "sim").unionByName(links.select(F.col("dst").alias("id"), F.col("src").alias("other"), "sim"))
    dense = checkpointed(both.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= core).select("id"))
    inner = links.join(dense.withColumnRenamed("id", "src"), "src", "left_semi").join(dense.withColumnRenamed("id", "dst"), "dst", "left_semi")
    found = graphs.connected_components(inner.select("src", "dst")).withColumnRenamed("node", "id")
    found = checkpointed(dense.join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component")))
    edge = both.join(dense, "id", "left_anti").join(found.withColumnRenamed("id", "other"), "other")
    edge = edge.groupBy("id").agg(F.max_by("component", F.struct(F.round("sim", 9), -F.col("other"))).alias("component"))
    member = found.unionByName(edge)
    size = member.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    named = numbered(size, F.desc("n"), F.col("component"), out="topic").select("component", F.col("topic").cast("int").alias("topic"))
    of = member.join(named, "component").select("id", "topic")
    return rows.select("id").join(of, "id", "left").select("id", F.coalesce("topic", F.lit(-1)).alias("topic"))


def sentiment_timeline(stories: DataFrame, labels: DataFrame, unit: str = "day") -> DataFrame:
    """Per story and unit of time: labelled posts, mean sentiment, shares of negative and positive ones."""
    value = F.when(F.col("sentiment") == "positive", 1).when(F.col("sentiment") == "negative", -1).otherwise(0)
    own = labels.groupBy("platform_post_id").agg(F.first("sentiment").alias("sentiment"))
    x = stories.select("story_id", "platform_post_id", "created_at").join(own, "platform_post_id").withColumn("v", value)
    return x.groupBy("story_id", F.date_trunc(unit, "created_at").alias("bucket")).agg(F.count(F.lit(1)).alias("n_posts"), F.avg("v").alias("mean_sentiment"), S.share(F.col("v") == -1).alias("neg_share"), S.share(F.col("v") == 1).alias("pos_share"))


def story_keywords(stories: DataFrame, top: int = 8) -> DataFrame:
    """(story_id, keywords): the terms that tell a story's posts from the other stories'."""
    terms = class_terms(stories, "story_id", "text", top)
    return terms.groupBy("story_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]).alias("keywords"))


def story_framing(stories: DataFrame, topics: DataFrame | None = None, labels: DataFrame | None = None) -> dict[str, DataFrame]:
    """How stories are told: topics, keywords and sentiment_timeline; a part without its input has no rows."""
    spark = stories.sparkSession
    key = dict(stories.dtypes)["story_id"]
    none = {"topics": f"story_id {key}, rank int, topic int, share double", "sentiment_timeline": f"story_id {key}, bucket timestamp, n_posts long, mean_sentiment double, neg_share double, pos_share double"}
    return {
        "topics": story_topics(stories, topics) if topics is not None else spark.createDataFrame([], none["topics"]),
        "keywords": story_keywords(stories),
        "sentiment_timeline": sentiment_timeline(stories, labels) if labels is not None else spark.createDataFrame([], none["sentiment_timeline"]),
    }


def persist_stories(catalog, card: DataFrame, platform: str = "x", least: float = 0.0) -> int:
    """Append scored stories with an index of `least` or more as one run; the rows written, 0 if none reach it.

    Only declared columns are stored; those that card lacks are null.
    """
    keep = card.where(F.col("story_suspicion_index") >= least).withColumn("platform", F.lit(platform)).withColumn("computed_at", F.current_timestamp())
    return catalog.append("stories", keep)


def attach_hate(card: DataFrame, hate: DataFrame) -> DataFrame:
    """A cluster scorecard with the columns of cluster_hate(); clusters without posts have nulls."""
    return card.join(hate.drop("n_posts"), "cluster_id", "left")
