"""Queries on text measures, toxicity, seeds and terms."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import lexicon as X
from tidemark.functions import stats as S
from tidemark.functions import text as T
from tidemark.operators import seeds
from tidemark.plans.core import FEATURES, LP
from tidemark.plans.registry import query
from tidemark.plans.tables import AS_OF, Tables

SCAN = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, '{p}', 'i') THEN '{t}' END" for t, p in X.TERMS) + "], lambda x: x IS NOT NULL)"
_RISK = " ".join(f"WHEN '{t}' THEN {['low', 'medium', 'high'].index(r)}" for t, r in X.RISK_OF.items())
MEASURE = f"""mz AS (SELECT p.platform_post_id, {SCAN} AS h, CASE WHEN regexp_matches(text, '{X.HOME_WORDS}', 'i') THEN 'home' WHEN regexp_matches(text, '{X.OTHER_WORDS}', 'i') THEN 'offdomain' ELSE 'ambiguous' END AS domain,
 greatest(dehumanisation_score, violence_call_score, othering_score) AS menace, coalesce(political_criticism_score, 0) AS pol, label, hate_flag FROM posts p JOIN scores s ON s.platform_post_id = p.platform_post_id),
mr AS (SELECT *, list_min(list_transform(h, lambda t: CASE t {_RISK} END)) AS risk FROM mz),
mm AS (SELECT *, coalesce(menace >= CASE risk WHEN 0 THEN 0.45::DOUBLE WHEN 1 THEN 0.55::DOUBLE WHEN 2 THEN 0.65::DOUBLE END AND menace >= pol + CASE risk WHEN 0 THEN -0.05::DOUBLE WHEN 1 THEN 0.0::DOUBLE WHEN 2 THEN 0.1::DOUBLE END, false) AS coded, ((label <> 'neither' OR hate_flag) AND domain <> 'offdomain') AS explicit FROM mr)"""


def measured(t: Tables):
    return X.with_measures(t.posts.join(t.scores.drop("in_scope", "coded_suspect"), "platform_post_id"))


@query("sf05_digit_share", "authors_raw", "SELECT platform_user_id AS id, round(length(regexp_replace(handle, '[^0-9]', '', 'g'))::DOUBLE / greatest(length(handle), 1), 6) AS share FROM authors_raw")
def _(t: Tables):
    return t.authors_raw.select(F.col("platform_user_id").alias("id"), F.round(T.digit_share(F.col("handle")), 6).alias("share"))


@query("sf06_url_key", "", "SELECT page_id, regexp_replace(regexp_replace(regexp_replace(lower(url), '[?&](utm_[^&#]*|fbclid=[^&#]*|gclid=[^&#]*)', '', 'g'), '\\?$', ''), '/+$', '') AS key FROM pages")
def _(t: Tables):
    return t.pages.select("page_id", T.url_key(F.col("url")).alias("key"))


@query("sf08_salient_terms", "posts", "SELECT platform_post_id, coalesce(array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(regexp_replace(lower(text), 'https?://\\S+|www\\.\\S+', ' ', 'g'), '[a-z]{3,}'), lambda x: x NOT IN ('the', 'and', 'for')))), ' '), '') AS terms FROM posts")
def _(t: Tables):
    return t.posts.select("platform_post_id", F.array_join(T.salient_terms(F.col("text"), ["the", "and", "for"]), " ").alias("terms"))


@query("sf09_entity_terms", "posts", "SELECT platform_post_id, coalesce(array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(text, '[A-Z][A-Za-z]{2,}'), lambda x: lower(x)), lambda x: x NOT IN ('the', 'and')))), ' '), '') AS terms FROM posts")
def _(t: Tables):
    return t.posts.select("platform_post_id", F.array_join(T.entity_terms(F.col("text"), ["the", "and"]), " ").alias("terms"))


@query("sf12_skeleton", "", "SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(text), 'https?://\\S+|www\\.\\S+', '<url>', 'g'), '@\\w+', '<user>', 'g'), '#\\w+', '<tag>', 'g'), '\\d+', '<num>', 'g'), '\\s+', ' ', 'g')) AS skeleton FROM documents")
def _(t: Tables):
    return t.documents.select("doc_id", T.skeleton(F.col("text")).alias("skeleton"))


@query("sf16_region_rules", "authors_raw", "SELECT platform_user_id AS id, CASE WHEN lower(location) LIKE '%nairobi%' THEN 'Nairobi' WHEN lower(location) LIKE '%mombasa%' THEN 'Coast' WHEN lower(location) LIKE '%kisumu%' THEN 'Nyanza' WHEN lower(location) LIKE '%eldoret%' THEN 'Rift Valley' WHEN lower(location) LIKE '%nyeri%' THEN 'Central' WHEN lower(location) LIKE '%meru%' THEN 'Eastern' END AS region FROM authors_raw")
def _(t: Tables):
    from tidemark.operators.places import REGION_RULES

    return t.authors_raw.select(F.col("platform_user_id").alias("id"), T.first_match(F.col("location"), REGION_RULES).alias("region"))


@query("sf17_lexicon_scan", "posts", f"SELECT platform_post_id, array_to_string({SCAN}, ' ') AS hits FROM posts WHERE len({SCAN}) > 0")
def _(t: Tables):
    out = t.posts.select("platform_post_id", X.hits(F.col("text")).alias("h")).where(F.size("h") > 0)
    return out.select("platform_post_id", F.array_join("h", " ").alias("hits"))


@query("sf21_measures", "posts scores", f"{MEASURE} SELECT platform_post_id, domain, coded AS coded_suspect, explicit AS explicit_toxic FROM mm")
def _(t: Tables):
    return measured(t).select("platform_post_id", "domain", "coded_suspect", "explicit_toxic")


@query("ag51_headline", "posts scores", f"{MEASURE} SELECT count(*) AS n, count(*) FILTER (WHERE domain = 'offdomain') AS offdomain, count(*) FILTER (WHERE explicit) AS explicit_toxic, count(*) FILTER (WHERE coded AND domain <> 'offdomain') AS coded, round(count(*) FILTER (WHERE explicit)::DOUBLE / greatest(count(*) FILTER (WHERE domain <> 'offdomain'), 1), 6) AS rate FROM mm")
def _(t: Tables):
    m, scope = measured(t), F.col("in_scope")
    rate = S.count_if(F.col("explicit_toxic")) / F.greatest(S.count_if(scope), F.lit(1))
    return m.agg(F.count(F.lit(1)).alias("n"), S.count_if(~scope).alias("offdomain"), S.count_if(F.col("explicit_toxic")).alias("explicit_toxic"), S.count_if(F.col("coded_suspect_in_scope")).alias("coded"), F.round(rate, 6).alias("rate"))


@query("ag46_categories", "posts scores", f"{MEASURE}, x AS (SELECT DISTINCT platform_post_id, label, CASE " + " ".join(f"WHEN t = '{k}' THEN '{v}'" for k, v in X.CATEGORY_OF.items()) + " END AS category FROM mm, unnest(h) u(t)) SELECT category, label, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY label), 6) AS share FROM x GROUP BY 1, 2")
def _(t: Tables):
    from pyspark.sql.window import Window

    n = measured(t).select(F.explode("lexicon_categories").alias("category"), "label").groupBy("category", "label").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("label")), 6))


@query("ag47_engagement_by_class", "posts scores", "SELECT label, count(*) AS n, round(avg(like_count), 6) AS likes, round(avg(repost_count), 6) AS reposts FROM posts JOIN scores USING (platform_post_id) GROUP BY 1")
def _(t: Tables):
    return t.posts.join(t.scores, "platform_post_id").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("like_count"), 6).alias("likes"), F.round(F.avg("repost_count"), 6).alias("reposts"))


@query("ag48_toxic_hashtags", "posts scores", "SELECT lower(h) AS tag, count(*) AS n FROM posts JOIN scores USING (platform_post_id), unnest(hashtags) u(h) WHERE label <> 'neither' GROUP BY 1 ORDER BY n DESC, tag LIMIT 10")
def _(t: Tables):
    tags = t.posts.join(t.scores.where("label <> 'neither'"), "platform_post_id").select(F.explode(F.transform("hashtags", F.lower)).alias("tag"))
    return tags.groupBy("tag").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "tag").limit(10)


@query("cl03_stale_measures", "scores", "SELECT platform_post_id FROM scores WHERE dehumanisation_score IS NULL OR political_criticism_score IS NULL")
def _(t: Tables):
    return X.stale(t.scores, ("dehumanisation_score", "political_criticism_score")).select("platform_post_id")


WILSON = "(p + 1.9208::DOUBLE / (2 * n) - 1.96::DOUBLE * sqrt((p * (1 - p) + 0.9604::DOUBLE / n) / n)) / (1 + 3.8416::DOUBLE / n)"


@query("ag42_wilson", "posts scores", f"SELECT author_id, n, k, round({WILSON}, 6) AS lower FROM (SELECT author_id, count(*) AS n, count(*) FILTER (WHERE label <> 'neither') AS k, count(*) FILTER (WHERE label <> 'neither')::DOUBLE / count(*) AS p FROM posts JOIN scores USING (platform_post_id) GROUP BY 1)")
def _(t: Tables):
    x = t.posts.join(t.scores, "platform_post_id").groupBy("author_id").agg(F.count(F.lit(1)).alias("n"), S.count_if(F.col("label") != "neither").alias("k"))
    return x.withColumn("lower", F.round(S.wilson_lower(F.col("k"), F.col("n")), 6))


SEEDS = f"""{FEATURES}, fl AS (SELECT platform_post_id, ((label <> 'neither' OR coalesce(hate_flag, false) OR coalesce(coded_suspect, false)) AND coalesce(in_scope, true)) AS tox, p_hate FROM scores),
re AS (SELECT lp.*, coalesce(tox, false) AS tox FROM lp LEFT JOIN fl USING (platform_post_id) WHERE lp.created_at > TIMESTAMP '2024-02-01' - INTERVAL 14 DAYS),
vol AS (SELECT author_id, count(*) AS n_posts, count(*) FILTER (WHERE tox) AS n_toxic, count(DISTINCT CASE WHEN tox THEN date_trunc('day', created_at) END) AS td, count(DISTINCT date_trunc('day', created_at)) AS ad FROM re GROUP BY 1),
am AS (SELECT DISTINCT author_id, obj FROM (SELECT author_id, repost_of_id AS obj FROM lp WHERE repost_of_id IS NOT NULL UNION SELECT platform_user_id, platform_post_id FROM engagements_raw WHERE kind = 'retweet') WHERE obj IN (SELECT platform_post_id FROM fl WHERE tox)),
od AS (SELECT obj, count(*) AS d FROM am GROUP BY 1), nh AS (SELECT am.* FROM am JOIN od USING (obj) WHERE d <= (SELECT greatest(50, least(CAST(floor(0.05::DOUBLE * count(DISTINCT author_id)) AS BIGINT), 100)) FROM am)),
pr AS (SELECT a.author_id, b.author_id AS peer, count(*) AS sh FROM nh a JOIN nh b USING (obj) WHERE a.author_id <> b.author_id GROUP BY 1, 2), amp AS (SELECT author_id, count(*) FILTER (WHERE sh >= 2) AS rp, count(*) AS ap FROM pr GROUP BY 1),
rr AS (SELECT DISTINCT conversation_id, author_id FROM re WHERE tox AND in_reply_to_id IS NOT NULL AND conversation_id IS NOT NULL), bg AS (SELECT author_id, count(*) AS nb FROM rr WHERE conversation_id IN (SELECT conversation_id FROM rr GROUP BY 1 HAVING count(*) >= 3) GROUP BY 1),
me AS (SELECT sus.id AS author_id, vol.n_posts AS n, n_toxic, td, ad, n_toxic::DOUBLE / vol.n_posts AS p, coalesce(rp, 0) AS rp, coalesce(ap, 0) AS ap, coalesce(nb, 0) AS nb, suspicion FROM vol JOIN sus ON sus.id = vol.author_id LEFT JOIN amp ON amp.author_id = vol.author_id LEFT JOIN bg ON bg.author_id = vol.author_id),
qu AS (SELECT *, {WILSON} AS lb, td::DOUBLE / greatest(ad, 1) AS pe FROM me WHERE (n >= 10 AND n_toxic >= 3) OR rp >= 2 OR nb >= 2), bu AS (SELECT *, ntile(4) OVER (ORDER BY n, author_id) AS vb FROM qu)
SELECT author_id, n AS n_posts, n_toxic, rp AS n_repeat_peers, nb AS n_brigade_convs, vb AS volume_bucket, round(0.25 * percent_rank() OVER (PARTITION BY vb ORDER BY ln(1 + rp) + ln(1 + ap)) + 0.25 * percent_rank() OVER (ORDER BY lb) + 0.2 * percent_rank() OVER (PARTITION BY vb ORDER BY ln(1 + nb)) + 0.15 * percent_rank() OVER (ORDER BY pe) + 0.15 * percent_rank() OVER (ORDER BY suspicion), 4) AS score FROM bu"""


@query("hs01_seed_accounts", "posts_raw authors_raw scores engagements_raw", SEEDS)
def _(t: Tables):
    out = seeds.seed_accounts(t.scores, t.posts_raw, t.authors_raw, t.engagements_raw, AS_OF)
    return out.select("author_id", "n_posts", "n_toxic", "n_repeat_peers", "n_brigade_convs", "volume_bucket", F.round("hate_seed_score", 4).alias("score"))


@query("hs03_mine_terms", "posts", """w AS (SELECT author_id, author_id IN ('u1', 'u2', 'u3', 'u4', 'u5', 'u6', 'u7', 'u8') AS i, created_at > TIMESTAMP '2024-02-01' - INTERVAL 5 DAYS AS f, unnest(regexp_extract_all(regexp_replace(regexp_replace(lower(text), 'https?://\\S+', ' ', 'g'), '[@#][\\w_]+', ' ', 'g'), '[\\p{L}][\\p{L}''-]{2,}')) AS term FROM posts WHERE created_at > TIMESTAMP '2024-02-01' - INTERVAL 20 DAYS),
c AS (SELECT term, count(*) FILTER (WHERE i) AS ci, count(DISTINCT author_id) FILTER (WHERE i) AS ai, count(*) AS ca, count(*) FILTER (WHERE i AND f) AS cn, count(*) FILTER (WHERE i AND NOT f) AS co FROM w WHERE term NOT IN ('the', 'and') GROUP BY 1), z AS (SELECT sum(ci)::DOUBLE AS ti, sum(ca)::DOUBLE AS ta, sum(cn)::DOUBLE AS tn, sum(co)::DOUBLE AS td, count(*)::DOUBLE AS v FROM c)
SELECT term, ci AS c_in, ai AS a_in, ca AS c_all, round(((ci + 0.5) / (ti + 0.5 * v)) / ((ca + 0.5) / (ta + 0.5 * v)), 6) AS lift, round(((cn + 0.5) / (tn + 0.5 * v)) / ((co + 0.5) / (td + 0.5 * v)), 6) AS novelty FROM c, z WHERE ci >= 4 AND ai >= 3 AND ((ci + 0.5) / (ti + 0.5 * v)) / ((ca + 0.5) / (ta + 0.5 * v)) >= 1.5""")
def _(t: Tables):
    cohort = t.posts.where("author_id IN ('u1', 'u2', 'u3', 'u4', 'u5', 'u6', 'u7', 'u8')").select("author_id")
    out = seeds.mine_terms(t.posts, cohort, AS_OF, days=20, new_days=5, stop=("the", "and"), min_count=4)
    return out.select("term", "c_in", "a_in", "c_all", F.round("lift", 6).alias("lift"), F.round("novelty", 6).alias("novelty"))


FLAGGED = "fl AS (SELECT platform_post_id, ((label <> 'neither' OR hate_flag OR coded_suspect) AND in_scope) AS tox, p_hate FROM scores)"


@query("hs05_hot_toxic_objects", "posts_raw scores", f"{LP}, {FLAGGED} SELECT platform_post_id, repost_count, round(p_hate, 6) AS p_hate FROM lp JOIN fl USING (platform_post_id) WHERE tox AND NOT is_repost AND repost_count BETWEEN 5 AND 500 AND created_at > TIMESTAMP '2024-02-01' - INTERVAL 14 DAYS ORDER BY repost_count DESC, p_hate DESC, platform_post_id LIMIT 250")
def _(t: Tables):
    return seeds.hot_toxic_objects(t.scores, t.posts_raw, AS_OF).select("platform_post_id", "repost_count", F.round("p_hate", 6).alias("p_hate"))


@query("hs05_hot_conversations", "posts_raw scores", f"{LP}, {FLAGGED} SELECT conversation_id, count(*) FILTER (WHERE tox) AS n_toxic, count(*) AS n FROM lp LEFT JOIN fl USING (platform_post_id) WHERE created_at > TIMESTAMP '2024-02-01' - INTERVAL 14 DAYS GROUP BY 1 HAVING count(*) FILTER (WHERE tox) >= 3 ORDER BY n_toxic DESC, n DESC, conversation_id LIMIT 60")
def _(t: Tables):
    return seeds.hot_conversations(t.scores, t.posts_raw, AS_OF)
