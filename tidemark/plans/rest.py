"""Queries on runs, census arms, ledgers, labelling, framing, request windows and small selections."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import requests as R
from tidemark.functions import stats as S
from tidemark.functions import text as T
from tidemark.operators import accounts, forensics, ledgers, rollups, runs, scoring, seeds, selection
from tidemark.operators import labels as LB
from tidemark.operators import network as N
from tidemark.operators import stories as ST
from tidemark.plans.core import FEATURES, LP
from tidemark.plans.measures import SCAN
from tidemark.plans.networks import FLAGS
from tidemark.plans.registry import query
from tidemark.plans.stories import STORY, clusters_of, follows, pairs, story_rows
from tidemark.plans.tables import AS_OF, Tables

RECENT = f"{LP}, recent AS (SELECT * FROM lp WHERE created_at > TIMESTAMP '2024-02-01' - INTERVAL 14 DAYS)"


def _arm(key: str, degree: str, worked: str) -> str:
    return f"""{RECENT}, w AS ({worked}), c AS (SELECT {key} AS object_id, max({degree}) AS degree, count(*) AS n_rows, {key} IN (SELECT id FROM w) AS worked FROM recent WHERE {key} IS NOT NULL GROUP BY 1 HAVING max({degree}) BETWEEN 5 AND 600),
    r AS (SELECT *, count(*) OVER () AS in_band, count(*) FILTER (WHERE NOT worked) OVER () AS open FROM c) SELECT * FROM r ORDER BY worked, degree DESC, n_rows DESC, object_id LIMIT 40"""


@query("sl01_hot_objects", "posts_raw engagements_raw", _arm("repost_of_id", "repost_count", "SELECT DISTINCT platform_post_id AS id FROM engagements_raw WHERE kind = 'retweet' AND collected_at > TIMESTAMP '2024-02-01' - INTERVAL 48 HOURS"))
def _(t: Tables):
    return ledgers.hot_reposts(t.posts_raw, t.engagements_raw, AS_OF, 14, (5, 600), 48, 40)


@query("sl01_hot_conversations", "posts_raw", _arm("conversation_id", "reply_count", "SELECT DISTINCT conversation_id AS id FROM posts_raw WHERE type = 'replies' AND collected_at > TIMESTAMP '2024-02-01' - INTERVAL 12 HOURS"))
def _(t: Tables):
    return ledgers.hot_conversations(t.posts_raw, t.posts_raw.where("type = 'replies'"), AS_OF, 14, (5, 600), 12, 40)


#: Reposted, quoted and answered posts with odd numbers stand in for those that nobody holds.
HELD = "hd AS (SELECT * FROM posts_raw WHERE CAST(substr(platform_post_id, 2) AS BIGINT) % 2 = 0)"


@query("sl01_hydration", "posts_raw engagements_raw", f"{HELD}, lp AS (SELECT * FROM hd QUALIFY row_number() OVER (PARTITION BY platform, platform_post_id ORDER BY collected_at DESC) = 1), recent AS (SELECT * FROM lp WHERE created_at > TIMESTAMP '2024-02-01' - INTERVAL 14 DAYS), rf AS (SELECT repost_of_id AS ref, max(repost_count) AS eng FROM recent WHERE repost_of_id IS NOT NULL GROUP BY 1 UNION ALL SELECT quoted_post_id, max(quote_count) FROM recent WHERE quoted_post_id IS NOT NULL GROUP BY 1 UNION ALL SELECT in_reply_to_id, max(reply_count) FROM recent WHERE in_reply_to_id IS NOT NULL GROUP BY 1) SELECT ref, max(eng) AS engagement, bool_or(EXISTS (SELECT 1 FROM engagements_raw e WHERE e.platform_post_id = rf.ref AND kind = 'retweet')) AS censused FROM rf WHERE NOT EXISTS (SELECT 1 FROM hd WHERE hd.platform_post_id = rf.ref) GROUP BY 1 ORDER BY censused DESC, engagement DESC, ref LIMIT 50")
def _(t: Tables):
    held = t.posts_raw.where((F.substring("platform_post_id", 2, 20).cast("long") % 2) == 0)
    return ledgers.to_hydrate(held, t.engagements_raw, AS_OF, 14, 50)


@query("sl03_census_pool", "engagements_raw authors_raw", "SELECT least(200, count(*)) AS n, least(200, count(*)) AS known FROM (SELECT DISTINCT platform_user_id AS id FROM engagements_raw WHERE kind = 'retweet') JOIN authors_raw ON platform_user_id = id WHERE handle IS NOT NULL")
def _(t: Tables):
    """How many are drawn: which ones is by hash."""
    pool = ledgers.census_pool(t.engagements_raw, t.authors_raw, 200)
    return pool.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("author_id").alias("known"))


LEDGER = "le AS (SELECT concat('u', u) AS author_id, max(ts) AS expanded_at, CASE WHEN u % 3 = 0 THEN 'failed' ELSE 'ok' END AS status, CASE WHEN u % 3 = 0 THEN u % 5 ELSE 0 END AS attempts FROM acts WHERE u % 4 <> 1 GROUP BY u), ca AS (SELECT concat('u', u) AS author_id, count(*) AS n FROM acts GROUP BY u)"


def _ledger(t: Tables):
    u = F.col("u")
    own = t.acts.where("u % 4 <> 1").groupBy("u").agg(F.max("ts").alias("expanded_at"))
    bad = u % 3 == 0
    return own.select(F.concat(F.lit("u"), u.cast("string")).alias("author_id"), F.lit("h").alias("handle"), "expanded_at", F.lit(1).cast("long").alias("n_posts"), F.when(bad, "failed").otherwise("ok").alias("status"), F.when(bad, u % 5).otherwise(0).cast("int").alias("attempts"))


@query("sl09_frontier", "acts", f"{LEDGER} SELECT ca.author_id FROM ca LEFT JOIN le USING (author_id) WHERE le.author_id IS NULL OR (NOT (status = 'failed' AND attempts >= 3) AND expanded_at < TIMESTAMP '2024-01-31' - INTERVAL 1 DAYS) ORDER BY -n, ca.author_id LIMIT 25")
def _(t: Tables):
    ranked = t.acts.groupBy(F.concat(F.lit("u"), F.col("u").cast("string")).alias("author_id")).agg((-F.count(F.lit(1))).alias("rank"))
    return ledgers.frontier(ranked, _ledger(t), "2024-01-31 00:00:00", 25, 1, 3).select("author_id")


@query("sl09_summary", "acts", f"{LEDGER}, k AS (SELECT * FROM le WHERE expanded_at >= TIMESTAMP '2024-01-31' - INTERVAL 2 DAYS) SELECT count(*) AS tracked, count(*) FILTER (WHERE status = 'ok') AS ok, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'failed' AND attempts >= 3) AS exhausted FROM k")
def _(t: Tables):
    return ledgers.frontier_summary(ledgers.pruned(_ledger(t), "2024-01-31 00:00:00", 2), 3)


@query("sl09_record", "acts", f"{LEDGER}, re AS (SELECT concat('u', u) AS author_id, CASE WHEN u % 2 = 0 THEN 'failed' ELSE 'ok' END AS s FROM acts WHERE u % 5 < 2 GROUP BY u) SELECT coalesce(le.author_id, re.author_id) AS author_id, coalesce(s, status) AS status, CASE WHEN s = 'failed' THEN coalesce(attempts, 0) + 1 WHEN s = 'ok' THEN 0 ELSE attempts END::INT AS attempts FROM le FULL JOIN re ON le.author_id = re.author_id")
def _(t: Tables):
    u = F.col("u")
    results = t.acts.where("u % 5 < 2").select("u").distinct().select(F.concat(F.lit("u"), u.cast("string")).alias("author_id"), F.lit("h").alias("handle"), F.lit(2).cast("long").alias("n_posts"), F.when(u % 2 == 0, "failed").otherwise("ok").alias("status"))
    return ledgers.recorded(_ledger(t), results, AS_OF).select("author_id", "status", "attempts")


@query("sl08_active_terms", "acts", "SELECT concat('t', k) AS term FROM acts GROUP BY k ORDER BY k % 7 = 0 DESC, count(*) DESC, concat('t', k) LIMIT 20")
def _(t: Tables):
    terms = t.acts.groupBy("k").agg(F.count(F.lit(1)).cast("double").alias("novelty")).select(F.concat(F.lit("t"), F.col("k").cast("string")).alias("term"), (F.col("k") % 7 == 0).alias("approved"), "novelty")
    return seeds.active_terms(terms, autopromote=True)


@query("sl11_crawl", "acts", "RECURSIVE fo AS (SELECT DISTINCT concat('u', u) AS f, concat('u', (u * 3 + k) % 150) AS t FROM acts), b AS (SELECT 'u1' AS id, 0 AS level UNION SELECT fo.t, b.level + 1 FROM b JOIN fo ON fo.f = b.id WHERE b.level < 2), m AS (SELECT id, min(level) AS level FROM b GROUP BY 1) SELECT level, count(*) AS n FROM m GROUP BY 1")
def _(t: Tables):
    start = t.spark.createDataFrame([("u1",)], "id string")
    return ledgers.crawl_summary(ledgers.crawl(follows(t), start, 2))


@query("co09_build_layers", "trace", f"{FLAGS.replace('SELECT src, dst, x AS weight', ', fl AS (SELECT src, dst, x AS weight')}) SELECT 'co_retweet' AS channel, (SELECT count(DISTINCT author_id) FROM trace) AS accounts_all, (SELECT count(*) FROM trace) AS traces_all, count(*) AS edges_tested, count(*) FILTER (WHERE sig_bonferroni) AS edges_bonferroni, count(*) FILTER (WHERE sig_fdr) AS edges_fdr, count(*) FILTER (WHERE sig_percentile) AS edges_percentile FROM fl")
def _(t: Tables):
    return runs.build_layers({"co_retweet": t.trace})[1].select("channel", "accounts_all", "traces_all", "edges_tested", *[f"edges_{m}" for m in runs.METHODS])


def ringed(t: Tables):
    """Two channels over the trace, each with a planted ring of the same ten accounts."""
    other = N.inject(t.trace, 10, 6).withColumn("action_object", F.concat(F.lit("r"), "action_object"))
    return {"co_retweet": N.inject(t.trace, 10, 6), "co_reply": other}


@query("co23_run", "", "SELECT 1::BIGINT AS n_clusters, 10::BIGINT AS n_accounts, 1::BIGINT AS n_corroborated_clusters, 10::BIGINT AS n_corroborated_accounts FROM (SELECT count(*) FROM lineitem)")
def _(t: Tables):
    """Of chance overlaps and a planted ring in two channels the ring alone is a cluster, and both channels support it."""
    out = runs.run(ringed(t))
    return t.spark.createDataFrame([tuple(int(out[k]) for k in ("n_clusters", "n_accounts", "n_corroborated_clusters", "n_corroborated_accounts"))], "n_clusters long, n_accounts long, n_corroborated_clusters long, n_corroborated_accounts long")


@query("co21_internal_validation", "posts_raw authors_raw posts", f"{FEATURES}, m AS (SELECT DISTINCT author_id, CAST(substr(author_id, 2) AS BIGINT) % 5 AS c FROM posts), em AS (SELECT concat('p', vec_id) AS id, embedding::DOUBLE[] AS v FROM embeddings), u AS (SELECT m.c, p.platform_post_id, v FROM m JOIN posts p USING (author_id) JOIN em ON em.id = p.platform_post_id) SELECT m.c AS cluster_id, count(*) AS size, round(avg(suspicion), 6) AS suspicion_obs, (SELECT round(avg(list_cosine_similarity(a.v, b.v)), 6) FROM u a JOIN u b ON a.c = b.c AND a.platform_post_id < b.platform_post_id WHERE a.c = m.c) AS homogeneity_obs FROM m LEFT JOIN sus ON sus.id = m.author_id GROUP BY 1 HAVING count(*) >= 3")
def _(t: Tables):
    susp = accounts.suspicion(accounts.author_features(t.authors_raw, t.posts_raw, AS_OF)).select(F.col("platform_user_id").alias("author_id"), "suspicion")
    e = t.embeddings.select(F.concat(F.lit("p"), F.col("vec_id").cast("string")).alias("platform_post_id"), F.col("embedding").alias("vec"))
    members = t.posts.select("author_id").distinct().withColumn("cluster_id", F.substring("author_id", 2, 9).cast("long") % 5)
    out = runs.internal_validation(members, susp, t.posts.join(e, "platform_post_id").select("author_id", "vec"), draws=20)
    return out.select("cluster_id", "size", F.round("suspicion_obs", 6).alias("suspicion_obs"), F.round("homogeneity_obs", 6).alias("homogeneity_obs"))


@query("co20_dealt_times", "timed", "SELECT (SELECT count(DISTINCT (author_id, action_object)) FROM timed) AS pairs, (SELECT count(DISTINCT created_at) FROM timed) AS times, true AS moved FROM (SELECT 1)")
def _(t: Tables):
    """Pairs and times both stay, apart."""
    got = N.shuffled(t.timed, what="time")
    same = got.join(t.timed, ["author_id", "action_object", "created_at"], "left_semi").agg(F.count(F.lit(1)).alias("same"))
    out = got.agg(F.countDistinct("author_id", "action_object").alias("pairs"), F.countDistinct("created_at").alias("times"), F.count(F.lit(1)).alias("n"))
    return out.crossJoin(same).select("pairs", "times", (F.col("same") < F.col("n") / 2).alias("moved"))


@query("co01_traces_co_content", "posts", "c AS (SELECT platform_post_id, md5(text) AS k FROM posts QUALIFY count(*) OVER (PARTITION BY text) >= 2) SELECT DISTINCT author_id, concat('c', k) AS obj, epoch_us(created_at) AS at_us FROM posts JOIN c USING (platform_post_id)")
def _(t: Tables):
    """The channel of like texts, over clusters of equal ones."""
    from tidemark.plans.stories import same_text

    return N.traces(t.posts, "text_sim", content=same_text(t)).select("author_id", F.col("action_object").alias("obj"), F.unix_micros("created_at").alias("at_us"))


@query("co16_attach_hate", "posts scores", "m AS (SELECT DISTINCT author_id, CAST(substr(author_id, 2) AS BIGINT) % 9 AS c FROM posts), x AS (SELECT c, count(*) FILTER (WHERE label <> 'neither')::DOUBLE / count(*) AS share FROM m JOIN posts USING (author_id) JOIN scores USING (platform_post_id) GROUP BY 1) SELECT c AS cluster_id, count(*) AS size, round(any_value(share), 6) AS toxic_share FROM m JOIN x USING (c) GROUP BY 1")
def _(t: Tables):
    card = clusters_of(t).groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"))
    hate = ST.cluster_hate(clusters_of(t), t.posts, t.scores.withColumn("toxic", F.col("label") != "neither"))
    return ST.attach_hate(card, hate).select("cluster_id", "size", F.round("toxic_share", 6).alias("toxic_share"))


ENRICHED = "en AS (SELECT p.platform_post_id, like_count + reply_count + repost_count + quote_count AS engagement, s.label, in_scope, CASE WHEN lower(location) LIKE '%nairobi%' THEN 'Nairobi' WHEN lower(location) LIKE '%mombasa%' THEN 'Coast' WHEN lower(location) LIKE '%kisumu%' THEN 'Nyanza' WHEN lower(location) LIKE '%eldoret%' THEN 'Rift Valley' WHEN lower(location) LIKE '%nyeri%' THEN 'Central' WHEN lower(location) LIKE '%meru%' THEN 'Eastern' END AS region, violence_call_score, sentiment FROM posts p JOIN scores s USING (platform_post_id) LEFT JOIN authors_raw a ON a.platform_user_id = p.author_id LEFT JOIN sentiment l USING (platform_post_id))"


def _enriched(t: Tables):
    tox = t.scores.select("platform_post_id", "label", "in_scope", "p_hate")
    inc = t.scores.select("platform_post_id", "violence_call_score")
    return rollups.enriched(t.posts, tox, t.authors_raw, inc, t.sentiment.select("platform_post_id", "sentiment"))


@query("jn04_enriched", "posts scores authors_raw sentiment", f"{ENRICHED} SELECT platform_post_id, engagement, label, region, violence_call_score, sentiment FROM en")
def _(t: Tables):
    return _enriched(t).select("platform_post_id", "engagement", "label", "region", "violence_call_score", "sentiment")


@query("ag45_region_rules_rate", "posts scores authors_raw sentiment", f"{ENRICHED} SELECT region AS slice, count(*) AS n, round(avg((label <> 'neither')::INT), 6) AS rate FROM en WHERE in_scope AND region IS NOT NULL GROUP BY 1 HAVING count(*) >= 20")
def _(t: Tables):
    return rollups.regional_rate(_enriched(t), "region", 20).withColumn("rate", F.round("rate", 6))


@query("jn20_mapped", "posts", "SELECT platform_post_id, CASE type WHEN 'search' THEN 'found' WHEN 'timeline' THEN 'followed' END AS how FROM posts")
def _(t: Tables):
    names = t.spark.createDataFrame([("search", "found"), ("timeline", "followed")], "type string, how string")
    return t.posts.join(F.broadcast(names), "type", "left").select("platform_post_id", "how")


@query("jn21_one_to_one", "scores sentiment", "SELECT platform_post_id, label, sentiment FROM scores JOIN sentiment USING (platform_post_id)")
def _(t: Tables):
    return LB.one_to_one(t.scores.select("platform_post_id", "label"), t.sentiment.select("platform_post_id", "sentiment"), "platform_post_id")


@query("ag36_reach", "posts authors_raw", "SELECT author_id, max(followers_count) AS followers, count(*) AS n_posts, round(avg(like_count + repost_count + reply_count + quote_count), 6) AS mean_engagement FROM posts JOIN authors_raw ON platform_user_id = author_id GROUP BY 1")
def _(t: Tables):
    return rollups.reach_and_engagement(t.posts, t.authors_raw).withColumn("mean_engagement", F.round("mean_engagement", 6))


@query("ag49_high_on_both", "posts_raw authors_raw", f"{FEATURES}, r AS (SELECT id, suspicion, (rank() OVER (ORDER BY n_posts) + (count(*) OVER (PARTITION BY n_posts) - 1) / 2.0) / count(*) OVER () AS k FROM sus) SELECT id FROM r WHERE suspicion > (SELECT quantile_cont(suspicion, 0.5) FROM r) AND k > 0.5")
def _(t: Tables):
    out = accounts.suspicion(accounts.author_features(t.authors_raw, t.posts_raw, AS_OF)).select(F.col("platform_user_id").alias("id"), "suspicion", "n_posts")
    return selection.high_on_both(S.with_pct_rank(out, "n_posts", "k"), "suspicion", "k", 0.5, 0.5).select("id")


@query("tk04_reservoir", "acts", "SELECT 100::BIGINT AS n, 100::BIGINT AS known FROM (SELECT count(*) FROM acts)")
def _(t: Tables):
    got = selection.reservoir(t.acts.select("e"), "e", 100, 5)
    return got.join(t.acts.select("e"), "e", "left_semi").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("e").alias("known"))


@query("wn16_first_per_author", "posts", "SELECT author_id, arg_min(platform_post_id, (created_at, platform_post_id)) AS platform_post_id FROM posts GROUP BY 1")
def _(t: Tables):
    return selection.first_per(t.posts, "author_id", "created_at", "platform_post_id").select("author_id", "platform_post_id")


@query("st04_distinct_terms", "posts", "SELECT DISTINCT lower(x) AS term FROM (SELECT unnest(hashtags) AS x FROM posts UNION ALL SELECT unnest(mentions) FROM posts) WHERE x <> ''")
def _(t: Tables):
    return selection.distinct_terms(t.posts.select("hashtags"), t.posts.select("mentions"))


@query("st09_id_sets", "scores", "a AS (SELECT platform_post_id AS i FROM scores WHERE hate_flag), b AS (SELECT platform_post_id AS i FROM scores WHERE label = 'hate') SELECT (SELECT count(*) FROM a WHERE i IN (SELECT i FROM b)) AS both, (SELECT count(*) FROM a WHERE i NOT IN (SELECT i FROM b)) AS first_only, (SELECT count(*) FROM b WHERE i NOT IN (SELECT i FROM a)) AS second_only FROM (SELECT 1)")
def _(t: Tables):
    a, b = (t.scores.where(c).select("platform_post_id") for c in ("hate_flag", "label = 'hate'"))
    sizes = [x.agg(F.count(F.lit(1)).alias(n)) for x, n in ((a.join(b, "platform_post_id", "left_semi"), "both"), (a.join(b, "platform_post_id", "left_anti"), "first_only"), (b.join(a, "platform_post_id", "left_anti"), "second_only"))]
    return sizes[0].crossJoin(sizes[1]).crossJoin(sizes[2])


@query("sf14_clean", "acts", "SELECT e, trim(regexp_replace(CASE WHEN e % 2 = 0 THEN concat('one @user ', e, ' two') ELSE concat('say @user ', e) END, '\\s+', ' ', 'g')) AS text FROM acts")
def _(t: Tables):
    n = F.col("e").cast("string")
    listed = F.concat(F.lit("['one @Who"), F.lit("  "), n, F.lit("', 'two']"))
    return t.acts.select("e", T.clean(F.when(F.col("e") % 2 == 0, listed).otherwise(F.concat(F.lit(" say @you   "), n))).alias("text"))


P3 = "(e * 7 % 10) / 10.0E0 AS p_neither, (e * 3 % 10) / 10.0E0 AS p_offensive, (e * 13 % 100) / 100.0E0 AS p_hate"


@query("sf22_labels", "acts", f"x AS (SELECT e, {P3} FROM acts) SELECT e, CASE WHEN p_neither >= p_offensive AND p_neither >= p_hate THEN 'neither' WHEN p_offensive >= p_hate THEN 'offensive' ELSE 'hate' END AS label, p_hate >= 0.28::DOUBLE AS hate_flag FROM x")
def _(t: Tables):
    return scoring.labelled(t.acts.selectExpr("e", *P3.split(", "))).select("e", "label", "hate_flag")


@query("sf35_search_queries", "acts", "SELECT DISTINCT k, concat(CASE WHEN k % 2 = 0 THEN concat('(a', k, ' OR b)') ELSE concat('a', k) END, ' (x OR y) -z min_faves:5 since:2024-01-01 include:nativeretweets') AS q FROM acts")
def _(t: Tables):
    word = F.when(F.col("k") % 2 == 0, F.concat(F.lit("a"), F.col("k").cast("string"), F.lit(" OR b"))).otherwise(F.concat(F.lit("a"), F.col("k").cast("string")))
    return t.acts.select("k").distinct().select("k", R.search_query(word, ["x", "y"], ["z"], 5, F.lit("2024-01-01"), None, True).alias("q"))


@query("sf36_windows", "", "SELECT 'recent' AS kind, strftime(DATE '2024-02-01' - CAST(d AS INT), '%Y-%m-%d') AS since, strftime(DATE '2024-02-01' - CAST(d AS INT) + 1, '%Y-%m-%d') AS until FROM range(3) r(d) UNION ALL SELECT 'backfill', strftime(greatest(DATE '2024-02-01' - CAST(d AS INT) - 8, DATE '2024-02-01' - 30), '%Y-%m-%d'), strftime(DATE '2024-02-01' - CAST(d AS INT), '%Y-%m-%d') FROM range(3, 30, 8) r(d) UNION ALL SELECT 'full', '2024-01-02', '2024-02-02'")
def _(t: Tables):
    parts = (("recent", R.recent_windows(t.spark, AS_OF, 3)), ("backfill", R.backfill_windows(t.spark, AS_OF, 3, 8)), ("full", R.full_window(t.spark, AS_OF)))
    out = [d.select(F.lit(k).alias("kind"), "since", "until") for k, d in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("sf37_left", "posts", "SELECT platform_post_id, left(text, 100) AS head FROM posts")
def _(t: Tables):
    return t.posts.select("platform_post_id", F.left("text", F.lit(100)).alias("head"))


@query("cl02_incitement", "posts", f"d AS (SELECT platform_post_id, text, {SCAN} AS h FROM posts WHERE length(trim(text)) > 0 AND CAST(substr(platform_post_id, 2) AS BIGINT) % 3 <> 0), n AS (SELECT * FROM d JOIN posts USING (platform_post_id) ORDER BY len(h) > 0 DESC, created_at DESC, platform_post_id LIMIT 500) SELECT platform_post_id, array_to_string(h, ' ') AS hits, (CAST(substr(platform_post_id, 2) AS BIGINT) % 100) / 100.0E0 AS violence_call_score FROM n")
def _(t: Tables):
    number = F.substring("platform_post_id", 2, 20).cast("long")
    done = t.posts.where(number % 3 == 0)
    out = scoring.incitement_pass(t.posts, done, lambda d: d.select("platform_post_id", (number % 100 / 100.0).alias("violence_call_score")))
    return out.select("platform_post_id", F.array_join("lexicon_hits", " ").alias("hits"), "violence_call_score")


@query("sy10_keywords", "", f"""{STORY}, w AS (SELECT story_id, unnest(regexp_extract_all(regexp_replace(lower(text), 'https?://\\S+|@\\w+|#\\w+|[^\\w\\s]', ' ', 'g'), '[a-z]{{3,}}')) AS term FROM sr WHERE story_id IS NOT NULL), tf AS (SELECT story_id, term, count(*) AS tf FROM w GROUP BY 1, 2), sz AS (SELECT story_id, sum(tf) AS n FROM tf GROUP BY 1), us AS (SELECT term, sum(tf) AS n FROM tf GROUP BY 1),
sc AS (SELECT tf.story_id, term, row_number() OVER (PARTITION BY story_id ORDER BY round(tf::DOUBLE / sz.n * ln(1 + (SELECT avg(n) FROM sz) / us.n), 10) DESC, term) AS r FROM tf JOIN sz USING (story_id) JOIN us USING (term)) SELECT story_id, string_agg(term, ' ' ORDER BY r) AS keywords FROM sc WHERE r <= 8 GROUP BY 1""")
def _(t: Tables):
    framing = ST.story_framing(story_rows(t).where("story_id is not null"))
    return framing["keywords"].select("story_id", F.array_join("keywords", " ").alias("keywords"))


@query("sy10_sentiment_timeline", "sentiment", f"{STORY} SELECT story_id, strftime(date_trunc('day', TIMESTAMP '2024-01-01' + INTERVAL '1' SECOND * s), '%Y-%m-%d') AS bucket, count(*) AS n_posts, round(avg(CASE sentiment WHEN 'positive' THEN 1 WHEN 'negative' THEN -1 ELSE 0 END), 6) AS mean_sentiment, round(avg((sentiment = 'negative')::INT), 6) AS neg_share FROM sr JOIN sentiment ON platform_post_id = concat('p', id) GROUP BY 1, 2")
def _(t: Tables):
    rows = story_rows(t).withColumn("platform_post_id", F.concat(F.lit("p"), F.col("id").cast("string")))
    out = ST.story_framing(rows, labels=t.sentiment)["sentiment_timeline"]
    return out.select("story_id", F.date_format("bucket", "yyyy-MM-dd").alias("bucket"), "n_posts", F.round("mean_sentiment", 6).alias("mean_sentiment"), F.round("neg_share", 6).alias("neg_share"))


@query("fx16_language_gap", "posts sentiment", "x AS (SELECT CAST(substr(platform_post_id, 2) AS BIGINT) % 7 AS story_id, lang, sentiment FROM posts JOIN sentiment USING (platform_post_id)), g AS (SELECT story_id, count(*) FILTER (WHERE lang = 'en') AS n_en, avg((sentiment = 'negative')::INT) FILTER (WHERE lang = 'en') AS a, count(*) FILTER (WHERE lang = 'sw') AS n_sw, avg((sentiment = 'negative')::INT) FILTER (WHERE lang = 'sw') AS b FROM x GROUP BY 1) SELECT story_id, n_en, n_sw, round(abs(coalesce(a, 0) - coalesce(b, 0)), 6) AS neg_gap FROM g WHERE n_en >= 3 AND n_sw >= 3")
def _(t: Tables):
    x = t.posts.join(t.sentiment.select("platform_post_id", "sentiment"), "platform_post_id").withColumn("story_id", F.substring("platform_post_id", 2, 20).cast("long") % 7)
    return forensics.language_gap(x).select("story_id", "n_en", "n_sw", F.round("neg_gap", 6).alias("neg_gap"))


@query("fx16_marker_calibration", "posts", "SELECT count(*) AS n, count(*) FILTER (WHERE regexp_matches(lower(text), '\\b(kwao|doa)\\b')) AS marked, round(count(*) FILTER (WHERE regexp_matches(lower(text), '\\b(kwao|doa)\\b'))::DOUBLE / greatest(count(*), 1), 6) AS share FROM posts WHERE lang = 'en'")
def _(t: Tables):
    return forensics.marker_calibration(t.posts, "en", ("kwao", "doa")).withColumn("share", F.round("share", 6))


BLIND = "bl AS (SELECT doc_id AS post_id, CASE doc_id % 3 WHEN 0 THEN 'hate' WHEN 1 THEN 'offensive' ELSE 'neither' END AS a, CASE WHEN toxic = 1 THEN 'hate' WHEN quality = 0 THEN 'offensive' ELSE 'neither' END AS b, CASE WHEN doc_id % 4 = 0 THEN 'lexicon' ELSE 'random' END AS stratum FROM labels), po AS (SELECT *, CASE WHEN a <> 'hate' AND b = 'hate' THEN 'only_b' WHEN a = 'hate' AND b <> 'hate' THEN 'only_a' WHEN a = b AND a = 'hate' THEN 'agree_hate' WHEN a = b AND stratum = 'lexicon' THEN 'agree_coded' WHEN a = b THEN 'agree' END AS pool FROM bl)"


def _blind(t: Tables):
    p = pairs(t).withColumnRenamed("doc_id", "post_id")
    return p.withColumn("stratum", F.when(F.col("post_id") % 4 == 0, "lexicon").otherwise("random"))


@query("lb04_pools", "", f"{BLIND} SELECT pool, count(*) AS n, round(avg((b = a)::INT), 6) AS agreement FROM po WHERE pool IS NOT NULL GROUP BY 1")
def _(t: Tables):
    rows = LB.two_labeller_pools(_blind(t), "a", "b").withColumn("human_label", F.col("b")).withColumn("label", F.col("a"))
    return LB.pool_agreement(rows).withColumn("agreement", F.round("agreement", 6))


@query("lb04_axis_errors", "", f"{BLIND} SELECT post_id, CASE WHEN b = 'hate' THEN 'missed' ELSE 'over' END AS error FROM bl WHERE (b = 'hate') <> (a = 'hate')")
def _(t: Tables):
    return LB.axis_errors(_blind(t).select("post_id", F.col("b").alias("human_label"), F.col("a").alias("label"))).select("post_id", "error")


@query("lb04_labellers", "", f"{BLIND} SELECT 'a' AS labeller, round(avg((a = b)::INT), 6) AS exact, count(*) FILTER (WHERE b = 'hate' AND a = 'hate') AS hit, count(*) FILTER (WHERE b = 'hate' AND a <> 'hate') AS missed, count(*) FILTER (WHERE b <> 'hate' AND a = 'hate') AS over FROM bl")
def _(t: Tables):
    out = LB.labeller_axis(_blind(t).withColumn("human_label", F.col("b")), ["a"])
    return out.select("labeller", F.round("exact", 6).alias("exact"), "hit", "missed", "over")


@query("lb09_flag_metrics", "", "x AS (SELECT doc_id % 2 = 0 AS s, doc_id % 3 = 0 AS i, doc_id % 4 = 0 AS gs, doc_id % 3 = 1 AS gi FROM labels), y AS (SELECT 'slur' AS flag, s AS t, gs AS g FROM x UNION ALL SELECT 'irony', i, gi FROM x) SELECT flag, round(coalesce(count(*) FILTER (WHERE t AND g)::DOUBLE / nullif(count(*) FILTER (WHERE g), 0), 0), 6) AS precision, round(coalesce(count(*) FILTER (WHERE t AND g)::DOUBLE / nullif(count(*) FILTER (WHERE t), 0), 0), 6) AS recall, count(*) FILTER (WHERE t) AS support FROM y GROUP BY 1")
def _(t: Tables):
    return _calibration(t)["flags"].select("flag", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), "support")


@query("lb09_mismatches", "", f"{BLIND} SELECT post_id FROM bl WHERE a <> b OR (post_id % 2 = 0) <> (post_id % 4 = 0) OR (post_id % 3 = 0) <> (post_id % 3 = 1)")
def _(t: Tables):
    return _calibration(t)["mismatches"].select("post_id")


def _calibration(t: Tables):
    p = pairs(t).withColumnRenamed("doc_id", "post_id")
    i = F.col("post_id")
    flags = lambda a, b: F.array_compact(F.array(F.when(a, "slur"), F.when(b, "irony")))
    human = p.select("post_id", F.col("b").alias("human_label"), flags(i % 2 == 0, i % 3 == 0).alias("human_flags"))
    own = p.select("post_id", F.col("a").alias("label"), flags(i % 4 == 0, i % 3 == 1).alias("flags"))
    return LB.calibration(human, own, ("slur", "irony"))


@query("lb10_rebuilt_splits", "", f"{BLIND}, sp AS (SELECT a, CASE post_id % 5 WHEN 0 THEN 'challenge' WHEN 1 THEN 'gold' ELSE 'train' END AS s FROM bl), tr AS (SELECT a, count(*) AS n, count(*) * 20.0::DOUBLE / (SELECT count(*) FROM sp WHERE s = 'train') AS x FROM sp WHERE s = 'train' GROUP BY 1), q AS (SELECT a, n, (floor(x) + CASE WHEN row_number() OVER (ORDER BY x - floor(x) DESC, a) <= 20 - (SELECT sum(floor(x)) FROM tr) THEN 1 ELSE 0 END)::BIGINT AS q FROM tr) SELECT s AS split, a AS label, count(*) AS n FROM sp WHERE s <> 'train' GROUP BY 1, 2 UNION ALL SELECT 'train', a, n - q FROM q WHERE n > q UNION ALL SELECT 'val', a, q FROM q WHERE q > 0")
def _(t: Tables):
    """Rows of each part by label: which train rows become val is by hash."""
    i = F.col("post_id")
    rows = _blind(t).select("post_id", F.col("a").alias("label"), F.when(i % 5 == 0, "challenge").when(i % 5 == 1, "gold").otherwise("train").alias("split"))
    return LB.rebuilt_splits(rows, "post_id", 20).groupBy("split", "label").agg(F.count(F.lit(1)).alias("n"))


@query("lb06_candidates")
def _(t: Tables):
    x = t.posts.join(t.scores, "platform_post_id").withColumn("lexicon_hits", F.when(F.col("text").contains("mende"), F.array(F.lit("mende"))).otherwise(F.array().cast("array<string>")))
    pool = x.select("platform_post_id", "author_handle", "text", "p_hate", (1 - F.col("p_hate")).alias("p_offensive"), "lexicon_hits", F.greatest("violence_call_score", "othering_score").alias("menace"), F.col("political_criticism_score").alias("criticism"))
    return LB.mine_candidates(pool, {"nli_tail": 30, "p_hate_top": 40, "p_offensive_top": 40, "random_control": 40}, cap=5)


@query("sk06_story_columns", "", f"{STORY} SELECT story_id, count(DISTINCT author_id) AS size FROM sr WHERE story_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT author_id)::DOUBLE / 100 >= 0.1::DOUBLE")
def _(t: Tables):
    """Stories stored at an index of a tenth or more, read back from a store in the shared folder."""
    import uuid

    from tidemark.sources.catalog import Catalog

    card = story_rows(t).where("story_id is not null").groupBy("story_id").agg(F.countDistinct("author_id").alias("size")).withColumn("story_suspicion_index", F.col("size") / 100)
    base = t.spark.conf.get("spark.checkpoint.dir", None) or t.spark.sparkContext.getCheckpointDir()
    if not base:
        from tidemark.functions.order import checkpointed

        checkpointed(t.spark.range(1))
        base = t.spark.sparkContext.getCheckpointDir()
    store = Catalog(t.spark, f"{base.rstrip('/')}/store-{uuid.uuid4().hex}")
    ST.persist_stories(store, card, least=0.1)
    return store.latest("stories").select("story_id", "size")


@query("co17_counters_by_method", "trace timed", "SELECT 'a' AS channel, count(DISTINCT author_id) AS accounts_all FROM trace UNION ALL SELECT 'b', count(DISTINCT author_id) FROM timed")
def _(t: Tables):
    return runs.build_layers({"a": t.trace, "b": t.timed})[1].select("channel", "accounts_all")

