"""Queries on snapshots, scope, joins, aggregates, ranks and samples."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import stats as S
from tidemark.functions import text as T
from tidemark.operators import accounts, rollups, selection
from tidemark.operators import latest as L
from tidemark.plans.registry import query
from tidemark.plans.tables import AS_OF, Tables

LP = "lp AS (SELECT * FROM posts_raw QUALIFY row_number() OVER (PARTITION BY platform, platform_post_id ORDER BY collected_at DESC) = 1)"
LA = "la AS (SELECT * FROM authors_raw QUALIFY row_number() OVER (PARTITION BY platform, platform_user_id ORDER BY collected_at DESC) = 1)"
FS = "fs AS (SELECT platform, platform_post_id, min_by(type, collected_at) AS first_type, min(collected_at) AS seen FROM posts_raw GROUP BY ALL)"
BASELINE = "('search', 'timeline', 'replies', 'hydrated')"
DAY = "date_diff('day', la.created_at, TIMESTAMP '2024-02-01')"


def lp(t: Tables):
    return L.latest(t.posts_raw, L.POST_KEY, "collected_at")


@query("ls01_latest_posts", "posts_raw", f"{LP} SELECT platform_post_id, type, epoch_us(collected_at) AS seen_us, repost_count FROM lp")
def _(t: Tables):
    return L.latest_posts(t.posts_raw).select("platform_post_id", "type", F.unix_micros("collected_at").alias("seen_us"), "repost_count")


@query("ls02_latest_state", "acts", "SELECT u, kind, max_by(e, (ts, e)) AS e, epoch_us(max(ts)) AS at_us FROM acts GROUP BY u, kind")
def _(t: Tables):
    return L.latest(t.acts, ("u", "kind"), "ts", "e").select("u", "kind", "e", F.unix_micros("ts").alias("at_us"))


@query("ls02_latest_engagements", "engagements_raw", "SELECT platform_post_id, platform_user_id, kind, epoch_us(max(collected_at)) AS seen_us FROM engagements_raw GROUP BY ALL")
def _(t: Tables):
    out = L.latest(t.engagements_raw, ("platform", "platform_post_id", "platform_user_id", "kind"), "collected_at")
    return out.select("platform_post_id", "platform_user_id", "kind", F.unix_micros("collected_at").alias("seen_us"))


@query("ls04_newest_run", "acts", "SELECT e, u FROM acts WHERE date_trunc('day', ts) = (SELECT max(date_trunc('day', ts)) FROM acts)")
def _(t: Tables):
    return L.newest_run(t.acts.withColumn("day", F.date_trunc("day", "ts")), "day").select("e", "u")


@query("ls06_first_seen", "posts_raw", f"{FS} SELECT platform_post_id, first_type, epoch_us(seen) AS seen_us FROM fs")
def _(t: Tables):
    return L.first_seen(t.posts_raw).select("platform_post_id", "first_type", F.unix_micros("first_collected_at").alias("seen_us"))


@query("ls08_effective_type", "posts_raw", f"{FS} SELECT CASE WHEN first_type = 'timeline' AND lower(author_handle) NOT IN ('user1', 'user2', 'user3') THEN 'cib_timeline' ELSE first_type END AS kind, count(*) AS n FROM posts_raw JOIN fs USING (platform, platform_post_id) GROUP BY 1")
def _(t: Tables):
    seen = t.posts_raw.join(L.first_seen(t.posts_raw), [*L.POST_KEY])
    kind = L.effective_type(F.col("first_type"), F.col("author_handle"), {"user1", "user2", "user3"})
    return seen.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


for _scope, _not in (("baseline", ""), ("targeted", "NOT ")):

    @query(f"ls09_latest_{_scope}", "posts_raw", f"{FS}, own AS (SELECT p.*, fs.first_type FROM posts_raw p JOIN fs USING (platform, platform_post_id) WHERE first_type {_not}IN {BASELINE}) SELECT platform_post_id, first_type, max_by(type, collected_at) AS type, max_by(like_count, collected_at) AS like_count FROM own GROUP BY 1, 2")
    def _(t: Tables, scope=_scope):
        return L.latest_posts(t.posts_raw, scope).select("platform_post_id", "first_type", "type", "like_count")


@query("ls10_windowed_latest", "posts_raw", "SELECT platform_post_id, max_by(type, collected_at) AS type, epoch_us(max(collected_at)) AS seen_us FROM posts_raw WHERE created_at > TIMESTAMP '2024-02-01' - INTERVAL 14 DAYS GROUP BY 1")
def _(t: Tables):
    return L.recent_posts(t.posts_raw, AS_OF, 14).select("platform_post_id", "type", F.unix_micros("collected_at").alias("seen_us"))


@query("ls11_independent_voices", "posts_raw", f"{LP} SELECT author_id, platform_post_id FROM lp WHERE NOT coalesce(is_repost, false) AND NOT regexp_matches(coalesce(text, ''), '^\\s*RT\\s+@', 'i') QUALIFY row_number() OVER (PARTITION BY author_id, lower(trim(text, ' ')) ORDER BY created_at, platform_post_id) = 1")
def _(t: Tables):
    return L.independent_voices(lp(t)).select("author_id", "platform_post_id")


@query("ls14_coverage", "posts_raw", f"{LP} SELECT round(avg((coalesce(len(hashtags), 0) > 0)::INT), 6) AS hashtags, round(avg((coalesce(len(urls), 0) > 0)::INT), 6) AS urls, round(avg((coalesce(len(mentions), 0) > 0)::INT), 6) AS mentions FROM lp")
def _(t: Tables):
    return L.coverage(lp(t)).select(*[F.round(c, 6).alias(c) for c in ("hashtags", "urls", "mentions")])


@query("ls15_pending", "posts scores", "SELECT platform_post_id FROM posts WHERE length(trim(text)) > 0 AND platform_post_id NOT IN (SELECT platform_post_id FROM scores WHERE label = 'neither') ORDER BY created_at DESC, platform_post_id LIMIT 500")
def _(t: Tables):
    return L.pending(t.posts, t.scores.where("label = 'neither'"), 500).select("platform_post_id")


@query("ls16_pending_hits_first", "posts scores", "SELECT platform_post_id FROM posts WHERE length(trim(text)) > 0 AND platform_post_id NOT IN (SELECT platform_post_id FROM scores WHERE p_hate < 0.5) ORDER BY (text LIKE '%kwao%') DESC, created_at DESC, platform_post_id LIMIT 300")
def _(t: Tables):
    return L.pending(t.posts, t.scores.where("p_hate < 0.5"), 300, F.col("text").contains("kwao")).select("platform_post_id")


@query("ls18_informative", "posts", "SELECT count(*) AS n, sum(w) AS words FROM (SELECT len(regexp_extract_all(replace(regexp_replace(regexp_replace(text, 'https?://\\S+|www\\.\\S+', ' ', 'g'), '@\\w+', ' ', 'g'), '#', ' '), '\\p{L}{2,}')) AS w FROM posts) WHERE w >= 5")
def _(t: Tables):
    return L.informative(t.posts).agg(F.count(F.lit(1)).alias("n"), F.sum(T.content_words(F.col("text"))).alias("words"))


@query("ls19_corpus_mix", "posts_raw", f"{FS} SELECT first_type, count(*) AS n, epoch_us(min(seen)) AS since_us FROM fs GROUP BY 1")
def _(t: Tables):
    return L.first_seen(t.posts_raw).groupBy("first_type").agg(F.count(F.lit(1)).alias("n"), F.unix_micros(F.min("first_collected_at")).alias("since_us"))


@query("jn03_posts_authors_labels", "posts authors_raw sentiment", "SELECT a.location, s.sentiment, count(*) AS n FROM posts p JOIN authors_raw a ON a.platform_user_id = p.author_id JOIN sentiment s USING (platform_post_id) GROUP BY 1, 2")
def _(t: Tables):
    who = t.authors_raw.select(F.col("platform_user_id").alias("author_id"), "location")
    return t.posts.join(who, "author_id").join(t.sentiment, "platform_post_id").groupBy("location", "sentiment").agg(F.count(F.lit(1)).alias("n"))


@query("jn05_reply_pairs", "posts", "SELECT r.author_id AS replier, p.author_id AS target, count(*) AS n FROM posts r JOIN posts p ON r.in_reply_to_id = p.platform_post_id WHERE r.author_id <> p.author_id GROUP BY 1, 2")
def _(t: Tables):
    return rollups.reply_pairs(t.posts).groupBy("replier", "target").agg(F.count(F.lit(1)).alias("n"))


@query("jn09_semi_join", "posts engagements_raw", "SELECT platform_post_id FROM posts p WHERE EXISTS (SELECT 1 FROM engagements_raw e WHERE e.platform_post_id = p.platform_post_id)")
def _(t: Tables):
    return t.posts.join(t.engagements_raw, "platform_post_id", "left_semi").select("platform_post_id")


@query("jn11_unresolved_references", "posts", "SELECT repost_of_id AS ref, count(*) AS n FROM posts p WHERE repost_of_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM posts q WHERE q.platform_post_id = p.repost_of_id AND q.like_count > 100) GROUP BY 1")
def _(t: Tables):
    return selection.unresolved(t.posts, "repost_of_id", t.posts.where("like_count > 100")).groupBy("ref").agg(F.count(F.lit(1)).alias("n"))


@query("jn13_exists_flag", "posts engagements_raw", "SELECT (EXISTS (SELECT 1 FROM engagements_raw e WHERE e.platform_post_id = p.platform_post_id AND e.kind = 'like')) AS liked, count(*) AS n FROM posts p GROUP BY 1")
def _(t: Tables):
    likes = t.engagements_raw.where("kind = 'like'").select("platform_post_id").distinct().withColumn("hit", F.lit(True))
    return t.posts.join(likes, "platform_post_id", "left").groupBy(F.col("hit").isNotNull().alias("liked")).agg(F.count(F.lit(1)).alias("n"))


@query("jn18_nearest_vectors", "", "q AS (SELECT vec_id AS a, embedding AS ea FROM embeddings WHERE vec_id % 50 = 0) SELECT a AS query_id, vec_id, round(list_cosine_similarity(ea::DOUBLE[], embedding::DOUBLE[]), 6) AS sim FROM q, embeddings WHERE a <> vec_id QUALIFY row_number() OVER (PARTITION BY a ORDER BY round(list_cosine_similarity(ea::DOUBLE[], embedding::DOUBLE[]), 6) DESC, vec_id) <= 10")
def _(t: Tables):
    from tidemark.operators import vectors

    v = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return vectors.nearest(v.where("id % 50 = 0"), v, 10).select(F.col("query_id"), F.col("id").alias("vec_id"), F.col("sim"))


@query("ag01_behaviour", "posts_raw", f"{LP} SELECT author_id, count(*) AS n_posts, round(avg((in_reply_to_id IS NOT NULL)::INT), 6) AS reply_ratio, round(avg(is_repost::INT), 6) AS repost_ratio, round(avg(coalesce(is_quote, false)::INT), 6) AS quote_ratio, round(1.0 - count(DISTINCT lower(trim(text)))::DOUBLE / count(*), 6) AS duplicate_text_ratio FROM lp GROUP BY 1")
def _(t: Tables):
    out = accounts.behaviour(lp(t))
    return out.select("author_id", "n_posts", *[F.round(c, 6).alias(c) for c in ("reply_ratio", "repost_ratio", "quote_ratio", "duplicate_text_ratio")])


FEATURES = f"""{LP}, {LA}, beh AS (SELECT author_id, count(*) AS n_posts, avg((in_reply_to_id IS NOT NULL)::INT) AS rr, avg(is_repost::INT) AS rp, 1.0 - count(DISTINCT lower(trim(text)))::DOUBLE / count(*) AS dup FROM lp GROUP BY 1),
ft AS (SELECT la.platform_user_id AS id, la.handle AS handle, greatest({DAY}, 0) AS age, la.followers_count::DOUBLE / greatest(la.following_count, 1) AS ratio, la.tweet_count::DOUBLE / greatest({DAY}, 1) AS rate,
 (la.bio IS NULL OR la.bio = '')::INT AS nobio, (la.profile_image_url ILIKE '%default_profile%')::INT AS noimg, length(regexp_replace(la.handle, '[^0-9]', '', 'g'))::DOUBLE / greatest(length(la.handle), 1) AS dig, coalesce(n_posts, 0) AS n_posts, coalesce(dup, 0) AS dup
 FROM la LEFT JOIN beh ON beh.author_id = la.platform_user_id),
sus AS (SELECT *, 0.3::DOUBLE / (1 + ratio) + 0.25::DOUBLE * greatest(0, 1 - age / 365.0::DOUBLE) + 0.15::DOUBLE * least(1, rate / 50) + 0.15::DOUBLE * dup + 0.05::DOUBLE * nobio + 0.05::DOUBLE * noimg + 0.05::DOUBLE * dig AS suspicion FROM ft)"""


@query("au01_suspicion", "posts_raw authors_raw", f"{FEATURES} SELECT id, age::INT AS age, round(ratio, 6) AS ratio, round(rate, 6) AS rate, n_posts, round(suspicion, 6) AS suspicion FROM sus")
def _(t: Tables):
    out = accounts.suspicion(accounts.author_features(t.authors_raw, t.posts_raw, AS_OF))
    return out.select(F.col("platform_user_id").alias("id"), F.col("account_age_days").alias("age"), F.round("followers_following_ratio", 6).alias("ratio"), F.round("tweet_rate", 6).alias("rate"), "n_posts", F.round("suspicion", 6).alias("suspicion"))


@query("au02_anomaly")
def _(t: Tables):
    return accounts.anomaly(accounts.author_features(t.authors_raw, t.posts_raw, AS_OF), "platform_user_id")


@query("wn08_pct_rank", "posts_raw authors_raw", f"{FEATURES} SELECT id, round((rank() OVER (ORDER BY r) + (count(*) OVER (PARTITION BY r) - 1) / 2.0) / count(*) OVER (), 6) AS pct FROM (SELECT id, round(suspicion, 3) AS r FROM sus)")
def _(t: Tables):
    out = accounts.suspicion(accounts.author_features(t.authors_raw, t.posts_raw, AS_OF)).select(F.col("platform_user_id").alias("id"), F.round("suspicion", 3).alias("r"))
    return S.with_pct_rank(out, "r", "pct").select("id", F.round("pct", 6).alias("pct"))


@query("wn06_ntile_strata", "acts", "SELECT b, count(*) AS n, min(c) AS low, max(c) AS high FROM (SELECT c, ntile(4) OVER (ORDER BY c, u) AS b FROM (SELECT u, count(*) AS c FROM acts GROUP BY 1)) GROUP BY 1")
def _(t: Tables):
    n = t.acts.groupBy("u").agg(F.count(F.lit(1)).alias("c")).withColumn("b", F.ntile(4).over(Window.orderBy("c", "u")))
    return n.groupBy("b").agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("low"), F.max("c").alias("high"))


@query("wn11_interval_regularity", "acts", "SELECT u, count(*) AS n, round(avg(g), 4) AS mean_gap, round(stddev_samp(g) / avg(g), 6) AS cv, median(g) AS median_gap FROM (SELECT u, epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY u ORDER BY ts, e) AS g FROM acts) WHERE g IS NOT NULL GROUP BY 1 HAVING avg(g) > 0")
def _(t: Tables):
    out = rollups.gaps(t.acts, "u", "ts", "e")
    return out.select("u", "n", F.round("mean_gap", 4).alias("mean_gap"), F.round("cv", 6).alias("cv"), "median_gap")


@query("wn13_tightest_half", "acts", "o AS (SELECT u, epoch(ts) AS s, row_number() OVER (PARTITION BY u ORDER BY ts, e) AS r, count(*) OVER (PARTITION BY u) AS n FROM acts) SELECT a.u AS u, min(b.s - a.s) AS span FROM o a JOIN o b ON a.u = b.u AND b.r = a.r + greatest(CAST(ceil(a.n / 2.0) AS BIGINT), 2) - 1 GROUP BY 1")
def _(t: Tables):
    return rollups.tightest_half(t.acts, "u", "ts", "e")


@query("wn14_busiest_window", "acts", "SELECT u, round(max(c)::DOUBLE / max(n), 6) AS share FROM (SELECT u, count(*) OVER (PARTITION BY u ORDER BY date_trunc('day', ts) RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW) AS c, count(*) OVER (PARTITION BY u) AS n FROM acts) GROUP BY 1")
def _(t: Tables):
    return rollups.busiest_window(t.acts, "u", "ts", 6).select("u", F.round("share", 6).alias("share"))


@query("ag08_slice_sentiment", "posts_raw authors_raw sentiment", f"""{LP}, {LA}, j AS (SELECT CASE WHEN lower(location) LIKE '%nairobi%' OR lower(location) LIKE '%nbo%' OR lower(location) LIKE '%cbd%' THEN 'Nairobi' WHEN lower(location) LIKE '%mombasa%' OR lower(location) LIKE '%coast%' THEN 'Coast' WHEN lower(location) LIKE '%kisumu%' THEN 'Nyanza'
 WHEN lower(location) LIKE '%eldoret%' THEN 'Rift Valley' WHEN lower(location) LIKE '%nyeri%' OR lower(location) LIKE '%central%' THEN 'Central' WHEN lower(location) LIKE '%meru%' THEN 'Eastern' END AS slice, CASE s.sentiment WHEN 'positive' THEN 1 WHEN 'negative' THEN -1 ELSE 0 END AS v
 FROM lp JOIN la ON la.platform_user_id = lp.author_id JOIN sentiment s ON s.platform_post_id = lp.platform_post_id) SELECT slice, count(*) AS n, round(avg(v), 3) AS mean_sentiment FROM j WHERE slice IS NOT NULL GROUP BY 1 HAVING count(*) >= 5""")
def _(t: Tables):
    return rollups.slice_sentiment(lp(t), L.latest(t.authors_raw, ("platform", "platform_user_id"), "collected_at"), t.sentiment, "region", least=5)


@query("ag09_slice_claim", "posts authors_raw", "j AS (SELECT p.author_id, CASE WHEN lower(location) LIKE '%nyeri%' THEN 'Kikuyu' WHEN lower(location) LIKE '%kisumu%' THEN 'Luo' WHEN lower(location) LIKE '%eldoret%' THEN 'Kalenjin' WHEN lower(location) LIKE '%meru%' THEN 'Meru/Embu' WHEN lower(location) LIKE '%mombasa%' THEN 'Coastal' END AS slice FROM posts p LEFT JOIN authors_raw a ON a.platform_user_id = p.author_id WHERE p.conversation_id IN ('c1', 'c2', 'c3', 'c4')) SELECT slice, count(*) AS n_posts, count(DISTINCT author_id) AS n_authors, round((SELECT avg((slice IS NOT NULL)::INT) FROM j), 6) AS coverage FROM j WHERE slice IS NOT NULL GROUP BY 1")
def _(t: Tables):
    out = rollups.slice_claim(t.posts.where("conversation_id IN ('c1', 'c2', 'c3', 'c4')"), t.authors_raw, "community")
    return out.select("slice", "n_posts", "n_authors", F.round("coverage", 6).alias("coverage"))


@query("ag10_collection_stats", "posts_raw", "SELECT type, count(*) AS n_raw, count(DISTINCT platform_post_id) AS n_unique, count(DISTINCT author_id) AS n_authors, count(*) FILTER (WHERE collected_at > TIMESTAMP '2024-02-01' - INTERVAL 7 DAYS) AS n_recent FROM posts_raw GROUP BY 1")
def _(t: Tables):
    return rollups.collection_stats(t.posts_raw, AS_OF, 7)


@query("ag10_daily", "posts_raw", "SELECT strftime(date_trunc('day', collected_at), '%Y-%m-%d') AS day, count(*) AS n_raw, count(DISTINCT platform_post_id) AS n_unique FROM posts_raw GROUP BY 1")
def _(t: Tables):
    return t.posts_raw.groupBy(F.date_format("collected_at", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n_raw"), F.countDistinct("platform_post_id").alias("n_unique"))


@query("ag20_bursting_hashtags", "posts", "x AS (SELECT lower(unnest(hashtags)) AS tag, created_at FROM posts), c AS (SELECT tag, count(*) FILTER (WHERE created_at > TIMESTAMP '2024-01-20' - INTERVAL 1 DAY) AS n24, count(*) FILTER (WHERE created_at <= TIMESTAMP '2024-01-20' - INTERVAL 1 DAY) / 7.0 AS mean7 FROM x WHERE created_at > TIMESTAMP '2024-01-20' - INTERVAL 8 DAYS AND created_at <= TIMESTAMP '2024-01-20' GROUP BY 1) SELECT tag, n24, round(mean7, 6) AS daily_mean FROM c WHERE n24 >= 5 AND n24 >= 1.1 * mean7")
def _(t: Tables):
    return rollups.bursting_hashtags(t.posts, "2024-01-20 00:00:00", least=5, ratio=1.1).select("tag", "n24", F.round("daily_mean", 6).alias("daily_mean"))


@query("ag21_hourly_burst", "posts", "h AS (SELECT date_trunc('hour', created_at) AS hr, count(*) AS n FROM posts WHERE created_at >= TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 49 HOURS AND created_at < TIMESTAMP '2024-01-20 12:00:00' GROUP BY 1), b AS (SELECT * FROM h WHERE hr < TIMESTAMP '2024-01-20 11:00:00') SELECT (SELECT n FROM h WHERE hr = TIMESTAMP '2024-01-20 11:00:00') AS last_hour, round(avg(n), 6) AS mean, round(stddev_samp(n), 6) AS sd, round(((SELECT n FROM h WHERE hr = TIMESTAMP '2024-01-20 11:00:00') - avg(n)) / stddev_samp(n), 6) AS z FROM b")
def _(t: Tables):
    out = rollups.hourly_burst(t.posts, "2024-01-20 12:00:00")
    return out.select("last_hour", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), F.round("z", 6).alias("z"))


@query("ag23_daily_timeline", "posts sentiment", "SELECT strftime(date_trunc('day', created_at), '%Y-%m-%d') AS day, count(*) AS n, round(avg(CASE sentiment WHEN 'positive' THEN 1 WHEN 'negative' THEN -1 ELSE 0 END), 6) AS mean_sentiment FROM posts JOIN sentiment USING (platform_post_id) GROUP BY 1")
def _(t: Tables):
    return rollups.timeline(t.posts.join(t.sentiment, "platform_post_id"), "day").select(F.date_format("at", "yyyy-MM-dd").alias("day"), "n", F.round("mean_sentiment", 6).alias("mean_sentiment"))


@query("ag34_daily_prevalence", "posts scores", "d AS (SELECT date_trunc('day', created_at) AS dy, count(*) AS n, avg((label <> 'neither' OR hate_flag)::INT) AS r FROM posts JOIN scores USING (platform_post_id) WHERE in_scope GROUP BY 1 HAVING count(*) >= 20) SELECT strftime(dy, '%Y-%m-%d') AS day, n, round(r, 6) AS rate, round(CASE WHEN count(*) OVER w >= 3 THEN avg(r) OVER w END, 6) AS rolling FROM d WINDOW w AS (ORDER BY dy ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)")
def _(t: Tables):
    out = rollups.daily_prevalence(t.posts.join(t.scores, "platform_post_id"))
    return out.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "n", F.round("rate", 6).alias("rate"), F.round("rolling", 6).alias("rolling"))


@query("ag35_weekday_hours", "posts scores", "SELECT isodow(created_at)::INT AS weekday, hour(created_at)::INT AS hr, count(*) AS n, round(avg((label <> 'neither')::INT), 6) AS rate FROM posts JOIN scores USING (platform_post_id) GROUP BY 1, 2 HAVING count(*) >= 15")
def _(t: Tables):
    x = t.posts.join(t.scores, "platform_post_id")
    weekday = (F.dayofweek("created_at") + 5) % 7 + 1
    return x.groupBy(weekday.alias("weekday"), F.hour("created_at").alias("hr")).agg(F.count(F.lit(1)).alias("n"), F.round(S.share(F.col("label") != "neither"), 6).alias("rate")).where("n >= 15")


@query("ag36_cadence", "posts", "SELECT h::INT AS hr, coalesce(n, 0) AS n FROM range(24) r(h) LEFT JOIN (SELECT hour(created_at + INTERVAL 3 HOURS) AS hh, count(*) AS n FROM posts WHERE author_id = 'u5' GROUP BY 1) ON hh = h")
def _(t: Tables):
    return rollups.cadence(t.posts.where("author_id = 'u5'"), "Africa/Nairobi")


@query("ag36_top_authors", "posts", "SELECT author_id, count(*) AS n, sum(like_count)::BIGINT AS likes FROM posts GROUP BY 1 ORDER BY n DESC, author_id LIMIT 20")
def _(t: Tables):
    return t.posts.groupBy("author_id").agg(F.count(F.lit(1)).alias("n"), F.sum("like_count").alias("likes")).orderBy(F.desc("n"), "author_id").limit(20)


@query("ag37_log_histogram", "posts", "SELECT CAST(floor(log10(like_count + 1) * 2) AS INT) AS bin, count(*) AS n FROM posts GROUP BY 1")
def _(t: Tables):
    return rollups.log_histogram(t.posts, "like_count", 2)


@query("ag38_lag_quantiles", "acts", "SELECT kind, median(value) AS p50, quantile_cont(value, 0.9) AS p90 FROM acts GROUP BY 1")
def _(t: Tables):
    return t.acts.groupBy("kind").agg(F.median("value").alias("p50"), F.percentile("value", F.lit(0.9)).alias("p90"))


@query("ag39_top_share", "posts", "SELECT platform_post_id, repost_count + like_count AS engagement FROM posts WHERE repost_count + like_count >= (SELECT quantile_cont(repost_count + like_count, 0.95) FROM posts)")
def _(t: Tables):
    return selection.top_share(t.posts.withColumn("engagement", F.col("repost_count") + F.col("like_count")), "engagement", 0.95).select("platform_post_id", "engagement")


@query("ag40_nearest_rank", "acts", "o AS (SELECT u, value, row_number() OVER (PARTITION BY u ORDER BY value) - 1 AS r, count(*) OVER (PARTITION BY u) AS n FROM acts) SELECT u, value AS p90 FROM o WHERE r = CAST(round_even(0.9 * (n - 1), 0) AS BIGINT)")
def _(t: Tables):
    return t.acts.groupBy("u").agg(rollups.nearest_rank("value", 0.9).alias("p90"))


@query("ag28_topic_entropy", "posts sentiment", "c AS (SELECT author_id, topic, count(*) AS n FROM posts JOIN sentiment USING (platform_post_id) GROUP BY 1, 2), s AS (SELECT *, n::DOUBLE / sum(n) OVER (PARTITION BY author_id) AS p FROM c) SELECT author_id, round(-sum(p * ln(p)), 6) AS entropy, arg_max(topic, (n, -topic)) AS dominant FROM s GROUP BY 1")
def _(t: Tables):
    out = rollups.topic_mix(t.posts.join(t.sentiment, "platform_post_id"), "author_id")
    return out.select("author_id", F.round("entropy", 6).alias("entropy"), "dominant")


@query("tk03_random_order", "acts", "SELECT 50::BIGINT AS n, 50::BIGINT AS known, true AS mixed FROM (SELECT count(*) FROM acts)")
def _(t: Tables):
    """What can be said of a random order in SQL: 50 distinct known rows, and not the first by id."""
    got = selection.hash_order(t.acts.select("e"), "e", 50, seed=7)
    return got.join(t.acts.select("e").distinct(), "e").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("e").alias("known"), (F.max("e") > 200).alias("mixed"))


@query("tk05_stratified_sample", "acts", "SELECT kind, greatest(1, round_even(100.0 * count(*) / (SELECT count(*) FROM acts), 0))::BIGINT AS n, greatest(1, round_even(100.0 * count(*) / (SELECT count(*) FROM acts), 0))::BIGINT AS distinct_rows, true AS known FROM acts GROUP BY 1")
def _(t: Tables):
    """What was drawn of each stratum: the draw itself is by hash."""
    got = selection.stratified(t.acts.select("e", "kind"), "kind", "e", 100, seed=7)
    own = t.acts.select("e", F.col("kind").alias("k"))
    return got.join(own, "e", "left").groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("e").alias("distinct_rows"), F.bool_and(F.col("kind") == F.col("k")).alias("known"))


@query("tk07_largest_remainder", "acts", "c AS (SELECT kind, count(*) * 100.0 / (SELECT count(*) FROM acts) AS x FROM acts GROUP BY 1), f AS (SELECT kind, floor(x) AS lo, row_number() OVER (ORDER BY x - floor(x) DESC, kind) AS r FROM c) SELECT kind, (lo + CASE WHEN r <= 100 - (SELECT sum(lo) FROM f) THEN 1 ELSE 0 END)::BIGINT AS quota FROM f")
def _(t: Tables):
    return selection.quotas(t.acts.groupBy("kind").count(), "kind", "count", 100)


@query("tk08_split", "acts", "p AS (SELECT kind, (row_number() OVER (PARTITION BY kind) - 0.5) / count(*) OVER (PARTITION BY kind)::DOUBLE AS p FROM acts) SELECT kind, CASE WHEN p <= 0.8::DOUBLE THEN 'train' WHEN p <= 0.9::DOUBLE THEN 'val' ELSE 'test' END AS split, count(*) AS n, count(*) AS distinct_rows FROM p GROUP BY 1, 2")
def _(t: Tables):
    """Rows of each stratum in each part: which rows they are is by hash."""
    got = selection.split(t.acts.select("e", "kind"), "e", "kind", {"train": 0.8, "val": 0.1, "test": 0.1}, seed=3)
    return got.groupBy("kind", "split").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("e").alias("distinct_rows"))


@query("st01_union_traces", "posts engagements_raw", "SELECT author_id, repost_of_id AS obj FROM posts WHERE repost_of_id IS NOT NULL UNION SELECT platform_user_id, platform_post_id FROM engagements_raw WHERE kind = 'retweet'")
def _(t: Tables):
    own = t.posts.where("repost_of_id IS NOT NULL").select("author_id", F.col("repost_of_id").alias("obj"))
    return own.union(t.engagements_raw.where("kind = 'retweet'").select("platform_user_id", "platform_post_id")).distinct()


@query("st05_exact_dedup", "", "SELECT doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1")
def _(t: Tables):
    w = Window.partitionBy(F.xxhash64("text"), "text").orderBy("doc_id")
    return t.documents.withColumn("r", F.row_number().over(w)).where("r = 1").select("doc_id")


@query("st06_overlap_removal", "", "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM benchmark b WHERE lower(regexp_replace(trim(b.text), '\\s+', ' ', 'g')) = lower(regexp_replace(trim(d.text), '\\s+', ' ', 'g')))")
def _(t: Tables):
    key = F.lower(F.regexp_replace(F.trim("text"), r"\s+", " "))
    return t.documents.withColumn("k", key).join(t.benchmark.select(key.alias("k")), "k", "left_anti").select("doc_id")


@query("sl04_due", "posts engagements_raw", "SELECT DISTINCT conversation_id FROM posts WHERE conversation_id IS NOT NULL AND conversation_id NOT IN (SELECT 'c' || substr(platform_post_id, 2) FROM engagements_raw WHERE collected_at > TIMESTAMP '2024-01-31' - INTERVAL 12 HOURS)")
def _(t: Tables):
    ledger = t.engagements_raw.select(F.concat(F.lit("c"), F.substring("platform_post_id", 2, 20)).alias("conversation_id"), F.col("collected_at").alias("visited_at"))
    return L.due(t.posts.select("conversation_id").distinct(), ledger, "conversation_id", "2024-01-31 00:00:00", 12)
