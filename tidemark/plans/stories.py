"""Queries on vectors, topics, stories, forensics, labels and ledgers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import lexicon as X
from tidemark.functions import stats as S
from tidemark.operators import accounts, ledgers, vectors
from tidemark.operators import forensics as X2
from tidemark.operators import labels as LB
from tidemark.operators import latest as L
from tidemark.operators import stories as ST
from tidemark.plans.core import FEATURES
from tidemark.plans.registry import query
from tidemark.plans.tables import AS_OF, Tables

EMB = "em AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings)"


def story_rows(t: Tables):
    """Documents with vectors as posts: eight stories by the vector's label."""
    d = t.documents.select("doc_id", "text", "source", "lang")
    e = t.embeddings.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec"), "label")
    out = d.join(e, "doc_id")
    return out.select(
        F.col("doc_id").alias("id"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("platform_post_id"), F.concat(F.lit("u"), (F.col("doc_id") % 40).cast("string")).alias("author_id"), "text", "vec", "lang", F.col("label").alias("story_id"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 600).alias("created_at"), F.col("source").alias("author_handle"), (F.col("doc_id") % 9 == 0).alias("is_repost"), F.array(F.concat(F.lit("H"), (F.col("doc_id") % 6).cast("string"))).alias("hashtags"),
    )


STORY = "sr AS (SELECT d.doc_id AS id, concat('d', d.doc_id) AS pid, concat('u', d.doc_id % 40) AS author_id, text, embedding::DOUBLE[] AS v, lang, e.label AS story_id, d.doc_id * 600 AS s, source, d.doc_id % 6 AS h FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id)"


@query("jn17_radius_links", "", f"{EMB} SELECT a.id AS src, b.id AS dst, round(list_cosine_similarity(a.v, b.v), 6) AS sim FROM em a JOIN em b ON a.id < b.id WHERE list_cosine_similarity(a.v, b.v) >= 0.4")
def _(t: Tables):
    return vectors.radius_links(t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")), 0.4).select("src", "dst", F.round("sim", 6).alias("sim"))


@query("sf26_centroid_cohesion", "", f"{EMB}, u AS (SELECT label, unnest(v) AS x, unnest(range(len(v))) AS i, sqrt(list_sum(list_transform(v, lambda y: y * y))) AS nr FROM em), c AS (SELECT label, i, avg(x / nr) AS x FROM u GROUP BY 1, 2) SELECT label, round(sqrt(sum(x * x)), 6) AS cohesion FROM c GROUP BY 1")
def _(t: Tables):
    unit = t.embeddings.select("label", vectors.normalised(F.col("embedding")).alias("v"))
    return vectors.centroids(unit, "label", "v").select("label", F.round("cohesion", 6).alias("cohesion"))


@query("co15_near_dup_rate", "", f"{EMB} SELECT a.label AS label, round(avg(list_cosine_similarity(a.v, b.v)), 6) AS mean_cosine FROM em a JOIN em b ON a.label = b.label AND a.id < b.id GROUP BY 1")
def _(t: Tables):
    return vectors.mean_pairwise(t.embeddings.where("label is not null"), "label", "embedding").select("label", F.round("mean_cosine", 6).alias("mean_cosine"))


@query("se06_class_terms", "", f"""{STORY}, w AS (SELECT story_id, unnest(regexp_extract_all(regexp_replace(lower(text), 'https?://\\S+|@\\w+|#\\w+|[^\\w\\s]', ' ', 'g'), '[a-z]{{3,}}')) AS term FROM sr), tf AS (SELECT story_id, term, count(*) AS tf FROM w GROUP BY 1, 2), sz AS (SELECT story_id, sum(tf) AS n FROM tf GROUP BY 1),
us AS (SELECT term, sum(tf) AS n FROM tf GROUP BY 1 HAVING count(*) >= 2), sc AS (SELECT tf.story_id, term, tf::DOUBLE / sz.n * ln(1 + (SELECT avg(n) FROM sz) / us.n) AS w FROM tf JOIN sz USING (story_id) JOIN us USING (term)) SELECT story_id, term, round(w, 8) AS weight, row_number() OVER (PARTITION BY story_id ORDER BY round(w, 10) DESC, term)::INT AS rank FROM sc QUALIFY rank <= 8""")
def _(t: Tables):
    return ST.class_terms(story_rows(t), "story_id", "text", 8, 2).select("story_id", "term", F.round("weight", 8).alias("weight"), "rank")


#: Links of a radius graph as `both` (id, other, sim), and what each id reaches over the links in `over`.
RADIUS = "both_ AS (SELECT a.id AS id, b.id AS other, list_cosine_similarity(a.v, b.v) AS sim FROM {rows} a JOIN {rows} b ON a.id <> b.id WHERE list_cosine_similarity(a.v, b.v) >= {tau})"
TOPICS = f"""RECURSIVE {EMB}, {RADIUS.format(rows="em", tau=0.35)}, core AS (SELECT id FROM both_ GROUP BY 1 HAVING count(*) >= 3), inn AS (SELECT id, other FROM both_ WHERE id IN (SELECT id FROM core) AND other IN (SELECT id FROM core)),
reach AS (SELECT id, id AS far FROM core UNION SELECT r.id, i.other FROM reach r JOIN inn i ON r.far = i.id), comp AS (SELECT id, min(far) AS c FROM reach GROUP BY 1),
mem AS (SELECT * FROM comp UNION ALL SELECT b.id, arg_max(c, (round(sim, 9), -other)) FROM both_ b JOIN comp ON comp.id = b.other WHERE b.id NOT IN (SELECT id FROM core) GROUP BY 1), big AS (SELECT c, (row_number() OVER (ORDER BY count(*) DESC, c) - 1)::INT AS topic FROM mem GROUP BY 1 HAVING count(*) >= 8)"""


@query("se05_topics", "", f"{TOPICS} SELECT em.id, coalesce(topic, -1)::INT AS topic FROM em LEFT JOIN mem USING (id) LEFT JOIN big USING (c)")
def _(t: Tables):
    return ST.assign_topics(t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")), 0.35, 8, 3)


@query("se03_content_clusters", "", f"RECURSIVE {EMB}, {RADIUS.format(rows='em', tau=0.4)}, reach AS (SELECT id, id AS far FROM both_ UNION SELECT r.id, b.other FROM reach r JOIN both_ b ON r.far = b.id) SELECT id, min(far) AS cluster_id FROM reach GROUP BY 1")
def _(t: Tables):
    return ST.content_clusters(t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")), 0.4)


#: No story here has the 150 authors from which on a dispersed component is rejected.
CANDIDATES = f"""RECURSIVE {STORY}, keep AS (SELECT sr.*, len(regexp_extract_all(replace(regexp_replace(regexp_replace(coalesce(text, ''), 'https?://\\S+|www\\.\\S+', ' ', 'g'), '@\\w+', ' ', 'g'), '#', ' '), '\\p{{L}}{{2,}}')) AS w FROM sr WHERE id % 9 <> 0 AND NOT regexp_matches(coalesce(text, ''), '^\\s*RT\\s+@', 'i')
 QUALIFY row_number() OVER (PARTITION BY author_id, lower(trim(text, ' ')) ORDER BY s, pid) = 1), inf AS (SELECT * FROM keep WHERE w >= 5), {RADIUS.format(rows="inf", tau=0.35)},
reach AS (SELECT id, id AS far FROM inf UNION SELECT r.id, b.other FROM reach r JOIN both_ b ON r.far = b.id), comp AS (SELECT id, min(far) AS c FROM reach GROUP BY 1),
big AS (SELECT c, count(*) AS n, substr(sha1(string_agg(pid, chr(10) ORDER BY pid)), 1, 16) AS stable FROM comp JOIN inf USING (id) GROUP BY 1 HAVING count(DISTINCT author_id) >= 3), num AS (SELECT *, row_number() OVER (ORDER BY n DESC, stable) - 1 AS story FROM big)"""


@query("sy01_candidate_stories", "", f"{CANDIDATES} SELECT id, story AS story_id, stable AS stable_story_id FROM comp JOIN num USING (c)")
def _(t: Tables):
    return ST.candidate_stories(story_rows(t).drop("story_id"), 0.35).select("id", "story_id", "stable_story_id")


@query("sf25_stable_ids", "", f"{STORY} SELECT story_id, substr(sha1(string_agg(pid, chr(10) ORDER BY pid)), 1, 16) AS stable_id FROM sr GROUP BY 1")
def _(t: Tables):
    from tidemark.functions import text as T

    return story_rows(t).groupBy("story_id").agg(T.stable_id(F.collect_list("platform_post_id")).alias("stable_id"))


def trusted(t: Tables):
    return story_rows(t).where("author_handle IN ('src1', 'src2', 'src3')").drop("story_id")


#: Per story the likeness of the nearest trusted post that shares three terms and, if it names any, an entity.
CORROB = f"""{STORY}, un AS (SELECT *, list_transform(v, lambda y: y / sqrt(list_sum(list_transform(v, lambda z: z * z)))) AS u FROM sr), ce AS (SELECT story_id, list(x ORDER BY i) AS c FROM (SELECT story_id, i, avg(x) AS x FROM (SELECT story_id, unnest(u) AS x, unnest(range(len(u))) AS i FROM un) GROUP BY 1, 2) GROUP BY 1),
st AS (SELECT DISTINCT story_id, unnest(regexp_extract_all(regexp_replace(lower(text), 'https?://\\S+|www\\.\\S+', ' ', 'g'), '[a-z]{{3,}}')) AS t FROM sr), se AS (SELECT DISTINCT story_id, lower(unnest(regexp_extract_all(text, '[A-Z][A-Za-z]{{2,}}'))) AS t FROM sr),
tt AS (SELECT DISTINCT pid, unnest(regexp_extract_all(regexp_replace(lower(text), 'https?://\\S+|www\\.\\S+', ' ', 'g'), '[a-z]{{3,}}')) AS t FROM sr WHERE source IN ('src1', 'src2', 'src3')), te AS (SELECT DISTINCT pid, lower(unnest(regexp_extract_all(text, '[A-Z][A-Za-z]{{2,}}'))) AS t FROM sr WHERE source IN ('src1', 'src2', 'src3')),
ga AS (SELECT story_id, pid FROM st JOIN tt USING (t) GROUP BY 1, 2 HAVING count(*) >= 3), gb AS (SELECT story_id, pid FROM ga WHERE story_id NOT IN (SELECT story_id FROM se) OR EXISTS (SELECT 1 FROM se JOIN te USING (t) WHERE se.story_id = ga.story_id AND te.pid = ga.pid)),
cu AS (SELECT story_id, list(x ORDER BY i) AS c FROM (SELECT story_id, i, avg(x) AS x FROM (SELECT story_id, unnest(u) AS x, unnest(range(len(u))) AS i FROM un) GROUP BY 1, 2) GROUP BY 1),
co AS (SELECT s.story_id, coalesce(max(list_cosine_similarity(c, un.u)), 0) AS corrob_sim FROM (SELECT DISTINCT story_id FROM sr) s LEFT JOIN gb USING (story_id) LEFT JOIN cu USING (story_id) LEFT JOIN un ON un.pid = gb.pid GROUP BY 1)"""


@query("sy04_corroboration", "", f"{CORROB} SELECT story_id, round(corrob_sim, 6) AS corrob_sim FROM co")
def _(t: Tables):
    return ST.corroboration(story_rows(t), trusted(t)).select("story_id", F.round("corrob_sim", 6).alias("corrob_sim"))


@query("sy09_representatives", "", f"{CORROB}, near AS (SELECT un.story_id, un.pid, round(list_inner_product(c, u), 9) AS s FROM un JOIN ce USING (story_id)) SELECT story_id, arg_min(pid, (-s, pid)) AS representative_post_id FROM near GROUP BY 1")
def _(t: Tables):
    return ST.representatives(story_rows(t)).select("story_id", "representative_post_id")


@query("ag27_top_hashtags", "", f"{STORY} SELECT story_id, tag, n FROM (SELECT story_id, concat('#h', h) AS tag, count(*) AS n FROM sr GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY story_id ORDER BY n DESC, tag) <= 5")
def _(t: Tables):
    return ST.top_hashtags(story_rows(t))


def _card(t: Tables):
    rows = story_rows(t)
    rows = rows.withColumn("stable_story_id", F.col("story_id").cast("string"))
    susp = accounts.suspicion(accounts.author_features(t.authors_raw, t.posts_raw, AS_OF)).select(F.col("platform_user_id").alias("author_id"), "suspicion")
    flagged = susp.where("suspicion > 0.4").select("author_id")
    return rows, ST.story_scorecard(rows, susp, flagged, ST.corroboration(rows, trusted(t)))


def pct(c: str, down: bool = False) -> str:
    """SQL of an average rank as a share of the non-null values; null ranks count 0."""
    c = f"round({c}::DOUBLE, 12)"
    own = f"(rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0) / nullif(count({c}) OVER (), 0)::DOUBLE"
    return f"CASE WHEN {c} IS NULL THEN 0 ELSE {'1 - ' if down else ''}{own} END"


CARD = f"""{FEATURES}, {CORROB}, pe AS (SELECT story_id, count(*) AS size, avg(suspicion) AS amplifier_botness, avg(coalesce((suspicion > 0.4::DOUBLE)::INT, 0)) AS coordination_overlap FROM (SELECT DISTINCT story_id, author_id FROM sr WHERE story_id IS NOT NULL) x LEFT JOIN sus ON sus.id = x.author_id GROUP BY 1),
np AS (SELECT story_id, count(*) AS n_posts FROM sr GROUP BY 1), ca AS (SELECT story_id, size, n_posts, 1 - coalesce(corrob_sim, 0) AS corroboration_gap, amplifier_botness, coordination_overlap, n_posts::DOUBLE / greatest(size, 1) AS source_concentration FROM pe JOIN np USING (story_id) LEFT JOIN co USING (story_id)),
rk AS (SELECT *, {pct("corroboration_gap")} AS i1, {pct("amplifier_botness")} AS i2, {pct("coordination_overlap")} AS i3, {pct("size")} AS i4, {pct("source_concentration")} AS i5 FROM ca), cd AS (SELECT *, 0.25::DOUBLE * i1 + 0.25::DOUBLE * i2 + 0.2::DOUBLE * i3 + 0.2::DOUBLE * i4 + 0.1::DOUBLE * i5 AS ix FROM rk)"""


@query("sy05_story_scorecard", "posts_raw authors_raw", f"{CARD} SELECT story_id, size, n_posts, round(corroboration_gap, 6) AS corroboration_gap, round(amplifier_botness, 6) AS amplifier_botness, round(coordination_overlap, 6) AS coordination_overlap, round(source_concentration, 6) AS source_concentration, round(ix, 6) AS story_suspicion_index FROM cd")
def _(t: Tables):
    return _card(t)[1].select("story_id", "size", "n_posts", *[F.round(c, 6).alias(c) for c in ("corroboration_gap", "amplifier_botness", "coordination_overlap", "source_concentration", "story_suspicion_index")])


TIER = "CASE WHEN size >= 3 THEN 'main' WHEN size >= 2 AND corroboration_gap >= 0.95::DOUBLE AND story_id IN (SELECT story_id FROM sr WHERE regexp_matches(text, '[A-Z][A-Za-z]{2,}')) THEN 'thin_evidence' END"


@query("sy06_tiers", "posts_raw authors_raw", f"{CARD}, ti AS (SELECT *, {TIER} AS tier FROM cd) SELECT story_id, size, tier, CASE WHEN tier = 'thin_evidence' THEN coalesce(amplifier_botness, 0) >= 0.5 OR coordination_overlap > 0 ELSE ix >= 0.5 END AS high_suspicion, round(ix, 6) AS story_suspicion_index FROM ti WHERE tier IS NOT NULL")
def _(t: Tables):
    rows, card = _card(t)
    return ST.assign_tiers(card, rows).select("story_id", "size", "tier", "high_suspicion", F.round("story_suspicion_index", 6).alias("story_suspicion_index"))


@query("ag25_story_features", "posts_raw authors_raw", f"{FEATURES}, {STORY}, pp AS (SELECT DISTINCT story_id, author_id FROM sr) SELECT story_id, count(*) AS size, round(avg(suspicion), 6) AS amplifier_botness, round(avg(coalesce((suspicion > 0.4::DOUBLE)::INT, 0)), 6) AS coordination_overlap, round((SELECT count(*) FROM sr WHERE sr.story_id IS NOT DISTINCT FROM pp.story_id)::DOUBLE / count(*), 6) AS source_concentration FROM pp LEFT JOIN sus ON sus.id = pp.author_id WHERE story_id IS NOT NULL GROUP BY story_id")
def _(t: Tables):
    out = _card(t)[1].where("story_id is not null")
    return out.select("story_id", "size", *[F.round(c, 6).alias(c) for c in ("amplifier_botness", "coordination_overlap", "source_concentration")])


@query("sy07_origin", "", f"{STORY} SELECT story_id, pid AS platform_post_id, row_number() OVER (PARTITION BY story_id ORDER BY s, pid)::INT AS rank FROM sr QUALIFY rank <= 15")
def _(t: Tables):
    susp = accounts.suspicion(accounts.author_features(t.authors_raw, t.posts_raw, AS_OF)).select(F.col("platform_user_id").alias("author_id"), "suspicion")
    return ST.origin(story_rows(t), susp).select("story_id", "platform_post_id", "rank")


@query("sy08_spread", "posts", "so AS (SELECT platform_post_id AS ref, CAST(substr(platform_post_id, 2) AS BIGINT) % 7 AS story_id FROM posts), x AS (SELECT story_id, author_id, 'r' AS k FROM so JOIN posts p ON p.repost_of_id = so.ref UNION ALL SELECT story_id, author_id, 'a' FROM so JOIN posts p ON p.in_reply_to_id = so.ref) SELECT story_id, count(DISTINCT author_id) FILTER (WHERE k = 'r') AS n_retweeters, count(DISTINCT author_id) FILTER (WHERE k = 'a') AS n_repliers, count(DISTINCT author_id) AS n_accounts FROM x GROUP BY 1")
def _(t: Tables):
    s = t.posts.select("platform_post_id", (F.substring("platform_post_id", 2, 20).cast("long") % 7).alias("story_id"))
    return ST.spread(s, t.posts)


@query("ag24_story_topics", "sentiment posts", "so AS (SELECT platform_post_id, CAST(substr(platform_post_id, 2) AS BIGINT) % 7 AS story_id FROM posts), e AS (SELECT story_id, topic FROM so JOIN sentiment USING (platform_post_id)), c AS (SELECT story_id, topic, count(*) AS n, sum(count(*)) OVER (PARTITION BY story_id) AS al FROM e GROUP BY 1, 2) SELECT story_id, row_number() OVER (PARTITION BY story_id ORDER BY n DESC, topic)::INT AS rank, topic, round(n::DOUBLE / al, 6) AS share FROM c WHERE topic >= 0 QUALIFY rank <= 3")
def _(t: Tables):
    s = t.posts.select("platform_post_id", (F.substring("platform_post_id", 2, 20).cast("long") % 7).alias("story_id"))
    return ST.story_topics(s, t.sentiment).select("story_id", "rank", "topic", F.round("share", 6).alias("share"))


def clusters_of(t: Tables):
    return t.posts.select("author_id").distinct().withColumn("cluster_id", F.substring("author_id", 2, 9).cast("long") % 9)


CLUSTER_CARD = f"""{FEATURES}, m AS (SELECT DISTINCT author_id, CAST(substr(author_id, 2) AS BIGINT) % 9 AS c FROM posts), w AS (SELECT m.c, sus.*, la.profile_image_url AS img, la.followers_count AS fo, (SELECT quantile_cont(suspicion, 0.9) FROM sus) AS p90 FROM m JOIN sus ON sus.id = m.author_id JOIN la ON la.platform_user_id = m.author_id),
k AS (SELECT c, count(*) AS size, avg(suspicion) AS sm, avg((suspicion > p90)::INT) AS sp, avg(noimg) AS si, avg(nobio) AS sb, avg(dig) AS hd, 1 - count(DISTINCT img)::DOUBLE / greatest(count(*), 1) AS sh, sum(fo)::BIGINT AS fs FROM w GROUP BY 1),
{EMB}, u AS (SELECT m.c, p.platform_post_id, like_count + repost_count AS eng, v FROM m JOIN posts p USING (author_id) LEFT JOIN em ON concat('p', em.id) = p.platform_post_id), r AS (SELECT c, count(*) AS np, sum(eng)::BIGINT AS es FROM u GROUP BY 1),
z AS (SELECT a.c, avg(list_cosine_similarity(a.v, b.v)) AS nd FROM u a JOIN u b ON a.c = b.c AND a.platform_post_id < b.platform_post_id GROUP BY 1), j AS (SELECT k.*, np, es, nd, (si + sb + hd + sh) / 4 AS cc, 0 AS ch FROM k LEFT JOIN r USING (c) LEFT JOIN z USING (c)),
x AS (SELECT *, 0.3::DOUBLE * {pct("sm")} + 0.2::DOUBLE * {pct("nd")} + 0.15::DOUBLE * {pct("cc")} + 0.15::DOUBLE * {pct("ch")} AS ix FROM j)"""


@query("co14_scorecards", "posts posts_raw authors_raw", f"{CLUSTER_CARD} SELECT c AS cluster_id, size, round(sm, 6) AS suspicion_mean, round(sp, 6) AS share_suspicion_p90, round(sh, 6) AS shared_profile_image, fs AS followers_sum, np AS n_posts, es AS engagement_sum, round(nd, 6) AS near_dup_rate, round(cc, 6) AS concealment, round(ix, 6) AS inauthenticity_index FROM x")
def _(t: Tables):
    out = _cluster_card(t)
    return out.select("cluster_id", "size", *[F.round(c, 6).alias(c) for c in ("suspicion_mean", "share_suspicion_p90", "shared_profile_image")], "followers_sum", "n_posts", "engagement_sum", *[F.round(c, 6).alias(c) for c in ("near_dup_rate", "concealment", "inauthenticity_index")])


def _cluster_card(t: Tables):
    f = accounts.suspicion(accounts.author_features(t.authors_raw, t.posts_raw, AS_OF)).withColumnRenamed("platform_user_id", "author_id")
    e = t.embeddings.select(F.concat(F.lit("p"), F.col("vec_id").cast("string")).alias("platform_post_id"), F.col("embedding").alias("vec"))
    posts = t.posts.join(e, "platform_post_id", "left").select("author_id", "platform_post_id", "vec", (F.col("like_count") + F.col("repost_count")).alias("engagement"))
    return ST.cluster_scorecard(clusters_of(t), f, posts)


@query("ag11_cluster_hate", "posts scores", "m AS (SELECT DISTINCT author_id, CAST(substr(author_id, 2) AS BIGINT) % 9 AS c FROM posts), x AS (SELECT c, p.author_id, count(*) AS n, count(*) FILTER (WHERE label <> 'neither') AS k, count(*) FILTER (WHERE coded_suspect) AS d FROM m JOIN posts p ON p.author_id = m.author_id JOIN scores USING (platform_post_id) GROUP BY 1, 2), y AS (SELECT *, sum(k) OVER (PARTITION BY c) AS tk FROM x) SELECT c AS cluster_id, sum(n)::BIGINT AS n_posts, round(sum(k)::DOUBLE / sum(n), 6) AS toxic_share, round(sum((k::DOUBLE / tk) ** 2), 6) AS hhi, round(0.5 * sum(k)::DOUBLE / sum(n) + 0.2 * sum(d)::DOUBLE / sum(n) + 0.3 * (1 - sum((k::DOUBLE / tk) ** 2)), 6) AS hate_index FROM y GROUP BY 1")
def _(t: Tables):
    out = ST.cluster_hate(clusters_of(t), t.posts, t.scores.withColumn("toxic", F.col("label") != "neither"))
    return out.select("cluster_id", "n_posts", *[F.round(c, 6).alias(c) for c in ("toxic_share", "hhi", "hate_index")])


@query("fx01_circadian", "posts", "n AS (SELECT author_id, hour(created_at + INTERVAL 3 HOURS)::INT AS h, count(*) AS n FROM posts GROUP BY 1, 2), w AS (SELECT author_id, sum(n) AS tot FROM n GROUP BY 1 HAVING sum(n) >= 20), p AS (SELECT w.author_id, r.h, (coalesce(n.n, 0) + 0.5) / (tot + 12)::DOUBLE AS p FROM w CROSS JOIN range(24) r(h) LEFT JOIN n ON n.author_id = w.author_id AND n.h = r.h), q AS (SELECT h, avg(p) AS q FROM p GROUP BY 1) SELECT author_id, round(sum(p * log2(p / ((p + q) / 2)) + q * log2(q / ((p + q) / 2))) / 2, 6) AS jsd FROM p JOIN q USING (h) GROUP BY 1")
def _(t: Tables):
    return X2.divergence_from_all(X2.circadian(t.posts, "Africa/Nairobi")).select("author_id", F.round("jsd", 6).alias("jsd"))


@query("fx01_shift_cohorts", "posts", "RECURSIVE n AS (SELECT author_id, hour(created_at + INTERVAL 3 HOURS)::INT AS h, count(*) AS n FROM posts GROUP BY 1, 2), w AS (SELECT author_id, sum(n) AS tot FROM n GROUP BY 1 HAVING sum(n) >= 20), p AS (SELECT w.author_id, r.h, (coalesce(n.n, 0) + 0.5) / (tot + 12)::DOUBLE AS p FROM w CROSS JOIN range(24) r(h) LEFT JOIN n ON n.author_id = w.author_id AND n.h = r.h), q AS (SELECT h, avg(p) AS q FROM p GROUP BY 1), d AS (SELECT author_id, sum(p * log2(p / ((p + q) / 2)) + q * log2(q / ((p + q) / 2))) / 2 AS jsd FROM p JOIN q USING (h) GROUP BY 1), few AS (SELECT author_id FROM d WHERE jsd >= (SELECT quantile_cont(jsd, 0.8) FROM d)), f AS (SELECT * FROM p WHERE author_id IN (SELECT author_id FROM few)), l AS (SELECT a.author_id AS src, b.author_id AS dst FROM f a JOIN f b ON a.h = b.h AND a.author_id <> b.author_id GROUP BY 1, 2 HAVING sum(a.p * log2(a.p / ((a.p + b.p) / 2)) + b.p * log2(b.p / ((a.p + b.p) / 2))) / 2 <= 0.075), re AS (SELECT src AS x, src AS far FROM l UNION SELECT re.x, l.dst FROM re JOIN l ON re.far = l.src) SELECT x AS author_id, min(far) AS component FROM re GROUP BY 1")
def _(t: Tables):
    return X2.shift_cohorts(X2.circadian(t.posts, "Africa/Nairobi"), 0.8, 0.075)


@query("fx03_awakened", "posts authors_raw", "r AS (SELECT author_id, count(*) / 14.0::DOUBLE AS rr FROM posts WHERE created_at > TIMESTAMP '2024-02-01' - INTERVAL 14 DAYS GROUP BY 1), a AS (SELECT platform_user_id AS author_id, date_diff('day', created_at, TIMESTAMP '2024-02-01') AS age, tweet_count FROM authors_raw) SELECT author_id, age::INT AS age, round(rr / greatest(tweet_count::DOUBLE / greatest(age, 1), 0.01), 4) AS ratio FROM a JOIN r USING (author_id) WHERE age > 200 AND rr / greatest(tweet_count::DOUBLE / greatest(age, 1), 0.01) > 2")
def _(t: Tables):
    return X2.awakened(t.authors_raw, t.posts, AS_OF, age=200, ratio=2.0).select("author_id", "age", F.round("ratio", 4).alias("ratio"))


@query("fx05_hashtag_recency", "posts authors_raw", "a AS (SELECT platform_user_id AS author_id, (date_diff('day', created_at, TIMESTAMP '2024-02-01') <= 365)::INT AS y FROM authors_raw), b AS (SELECT avg(y) AS p FROM a), d AS (SELECT DISTINCT author_id, lower(h) AS tag FROM posts, unnest(hashtags) u(h)) SELECT tag, count(*) AS n, sum(y)::BIGINT AS k, round((sum(y) - count(*) * any_value(p)) / sqrt(count(*) * any_value(p) * (1 - any_value(p))), 6) AS z FROM d JOIN a USING (author_id), b GROUP BY 1 HAVING count(*) >= 5")
def _(t: Tables):
    return X2.hashtag_recency(t.posts, t.authors_raw, AS_OF, 365).select("tag", "n", "k", F.round("z", 6).alias("z"))


@query("fx06_handle_families", "authors_raw", "SELECT regexp_replace(lower(handle), '[0-9]+', '#', 'g') AS skeleton, count(DISTINCT platform_user_id) AS n FROM authors_raw GROUP BY 1 HAVING count(DISTINCT platform_user_id) >= 3")
def _(t: Tables):
    return X2.handle_families(t.authors_raw)


CLUSTERED = "cl AS (SELECT platform_post_id, md5(text) AS cluster_id FROM posts QUALIFY count(*) OVER (PARTITION BY text) >= 2)"


def same_text(t: Tables):
    from pyspark.sql.window import Window

    c = F.count(F.lit(1)).over(Window.partitionBy("text"))
    return t.posts.select("platform_post_id", F.md5("text").alias("cluster_id"), c.alias("c")).where("c >= 2").drop("c")


@query("fx07_copypasta", "posts", f"{CLUSTERED} SELECT cluster_id, count(*) AS n_posts, count(DISTINCT author_id) AS n_authors, round((epoch_us(max(created_at)) - epoch_us(min(created_at))) / 6e7::DOUBLE, 4) AS span_min, arg_min(author_id, (created_at, platform_post_id)) AS seeder FROM cl JOIN posts USING (platform_post_id) GROUP BY 1")
def _(t: Tables):
    return X2.copypasta(t.posts, same_text(t)).select("cluster_id", "n_posts", "n_authors", F.round("span_min", 4).alias("span_min"), "seeder")


@query("fx08_seeders", "posts", f"{CLUSTERED}, x AS (SELECT cluster_id, author_id, first_value(author_id) OVER (PARTITION BY cluster_id ORDER BY created_at, platform_post_id) AS f FROM cl JOIN posts USING (platform_post_id)) SELECT author_id, count(DISTINCT cluster_id) FILTER (WHERE author_id = f) AS seeded, count(DISTINCT cluster_id) FILTER (WHERE author_id <> f) AS echoed FROM x GROUP BY 1")
def _(t: Tables):
    return X2.seeders_and_echoers(t.posts, same_text(t))


@query("fx09_templates", "posts", "s AS (SELECT author_id, text, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(text), 'https?://\\S+|www\\.\\S+', '<url>', 'g'), '@\\w+', '<user>', 'g'), '#\\w+', '<tag>', 'g'), '\\d+', '<num>', 'g'), '\\s+', ' ', 'g')) AS k FROM posts) SELECT md5(k) AS skeleton, count(DISTINCT text) AS n_texts, count(DISTINCT author_id) AS n_authors, count(*) AS n_posts FROM s WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT author_id) >= 3 AND count(DISTINCT text) >= 3")
def _(t: Tables):
    return X2.templates(t.posts).withColumn("skeleton", F.md5("skeleton"))


REPLIES = "rp AS (SELECT r.author_id AS replier, p.author_id AS target, p.platform_post_id AS parent, (epoch_us(r.created_at) - epoch_us(p.created_at)) / 1e6::DOUBLE AS lag_s FROM posts r JOIN posts p ON r.in_reply_to_id = p.platform_post_id WHERE r.author_id <> p.author_id)"


@query("fx10_reply_targets", "posts", f"{REPLIES} SELECT target, count(*) AS n, count(DISTINCT replier) AS n_repliers, round(median(lag_s) / 60, 4) AS median_lag_min FROM rp GROUP BY 1")
def _(t: Tables):
    return X2.reply_targets(t.posts).withColumn("median_lag_min", F.round("median_lag_min", 4))


@query("fx11_fast_repliers", "posts", f"{REPLIES}, k AS (SELECT replier, count(*) OVER (PARTITION BY parent) AS n, row_number() OVER (PARTITION BY parent ORDER BY lag_s, replier)::DOUBLE / count(*) OVER (PARTITION BY parent) AS r FROM rp) SELECT replier, count(*) AS n, round(avg(r), 6) AS mean_rank, round((avg(r) - 0.5) * sqrt(12 * count(*)), 6) AS z FROM k WHERE n >= 3 GROUP BY 1 HAVING count(*) >= 5")
def _(t: Tables):
    return X2.fast_repliers(t.posts).select("replier", "n", F.round("mean_rank", 6).alias("mean_rank"), F.round("z", 6).alias("z"))


@query("fx12_dogpiles", "posts", f"{REPLIES} SELECT parent, count(DISTINCT replier) AS n_repliers, round(quantile_cont(lag_s, 0.9) / 60, 4) AS p90_lag_min FROM rp GROUP BY 1 HAVING count(DISTINCT replier) >= 10 AND quantile_cont(lag_s, 0.9) / 60 <= 40000")
def _(t: Tables):
    return X2.dogpiles(t.posts, minutes=40000).withColumn("p90_lag_min", F.round("p90_lag_min", 4))


@query("fx13_step_jumps", "acts", "s AS (SELECT u, e, ts, value - lag(value) OVER (PARTITION BY u ORDER BY ts, e) AS st FROM acts) SELECT u, count(*) AS n, round(sum(st), 4) AS growth, round(max(st) / sum(st), 4) AS share FROM s WHERE st IS NOT NULL GROUP BY 1 HAVING count(*) >= 3 AND sum(st) > 0")
def _(t: Tables):
    return X2.step_jumps(t.acts, "u", "ts", "value", "e").select("u", "n", F.round("growth", 4).alias("growth"), F.round("share", 4).alias("share"))


@query("fx14_ratio_outliers", "posts authors_raw", "a AS (SELECT platform_user_id AS author_id, greatest(followers_count, 1) AS f FROM authors_raw), x AS (SELECT platform_post_id, CASE WHEN f > 1 THEN ceil(log10(f) * 2) / 2 END AS b, log10(like_count) AS d FROM posts JOIN a USING (author_id) WHERE like_count > 0), m AS (SELECT b, median(d) AS u FROM x WHERE b IS NOT NULL GROUP BY 1) SELECT platform_post_id, round(d - u, 6) AS residual FROM x LEFT JOIN m USING (b)")
def _(t: Tables):
    return X2.follower_residual(t.posts, t.authors_raw).select("platform_post_id", F.round("residual", 6).alias("residual"))


@query("fx15_laundering", "authors_raw", f"{STORY}, a AS (SELECT platform_user_id AS author_id, followers_count AS f FROM authors_raw) SELECT story_id, arg_min(sr.author_id, (s, pid)) AS first_author, round((min(s) FILTER (WHERE f >= 5000) - min(s)) / 3600.0, 4) AS lag_h FROM sr LEFT JOIN a ON a.author_id = sr.author_id GROUP BY 1")
def _(t: Tables):
    return X2.laundering(story_rows(t), t.authors_raw, 5000).select("story_id", "first_author", F.round("lag_h", 4).alias("lag_h"))


@query("fx16_language_mix", "", "c AS (SELECT source, coalesce(lang, '?') AS l, count(*) AS n FROM documents GROUP BY 1, 2) SELECT source, sum(n)::BIGINT AS n, count(*) AS n_langs, arg_max(l, (n, l)) AS main, round(1 - max(n)::DOUBLE / sum(n), 6) AS other_share FROM c GROUP BY 1")
def _(t: Tables):
    return X2.language_mix(t.documents, "source").withColumn("other_share", F.round("other_share", 6))


FOLLOWS = "fo AS (SELECT DISTINCT concat('u', u) AS f, concat('u', (u * 3 + k) % 150) AS t FROM acts)"


def follows(t: Tables):
    return t.acts.select(F.concat(F.lit("u"), F.col("u").cast("string")).alias("follower_id"), F.concat(F.lit("u"), ((F.col("u") * 3 + F.col("k")) % 150).cast("string")).alias("followed_id")).distinct()


@query("fx17_mutual_follows", "acts", f"{FOLLOWS} SELECT x.f AS a, x.t AS b FROM fo x JOIN fo y ON x.f = y.t AND x.t = y.f WHERE x.f < x.t")
def _(t: Tables):
    return X2.mutual_follows(follows(t))


@query("fx17_follow_density", "acts", f"{FOLLOWS}, m AS (SELECT DISTINCT concat('u', u) AS a, u % 9 AS c FROM acts), z AS (SELECT c, count(*) AS n FROM m GROUP BY 1), i AS (SELECT x.c, count(*) AS k FROM fo JOIN m x ON x.a = fo.f JOIN m y ON y.a = fo.t WHERE x.c = y.c GROUP BY 1) SELECT z.c AS cluster_id, n AS size, round(coalesce(coalesce(k, 0) / nullif(n * (n - 1), 0)::DOUBLE, 0), 6) AS density FROM z LEFT JOIN i USING (c)")
def _(t: Tables):
    return X2.follow_density(follows(t), clusters_of(t)).withColumn("density", F.round("density", 6))


@query("fx04_random_subsets")
def _(t: Tables):
    f = accounts.author_features(t.authors_raw, t.posts_raw, AS_OF).select(F.col("platform_user_id").alias("author_id"), "account_age_days")
    return X2.random_subsets(clusters_of(t), f, "account_age_days", 20)


@query("fx18_convergence", "posts scores", "l AS (SELECT author_id, 'tox' AS k FROM posts JOIN scores USING (platform_post_id) WHERE coded_suspect UNION SELECT author_id, 'burst' FROM posts GROUP BY author_id HAVING count(*) > 70 UNION SELECT author_id, 'reach' FROM posts WHERE like_count >= 898) SELECT author_id, count(*) AS n_lenses, string_agg(k, ',' ORDER BY k) AS lenses FROM l GROUP BY 1 HAVING count(*) >= 2")
def _(t: Tables):
    tox = t.posts.join(t.scores.where("coded_suspect"), "platform_post_id").select("author_id", F.lit("tox").alias("lens"))
    busy = t.posts.groupBy("author_id").agg(F.count(F.lit(1)).alias("n")).where("n > 70").select("author_id", F.lit("burst").alias("lens"))
    far = t.posts.where("like_count >= 898").select("author_id", F.lit("reach").alias("lens"))
    return X2.convergence(tox.unionByName(busy).unionByName(far))


@query("fx19_incitement_sweep", "posts scores", "h AS (SELECT (regexp_matches(text, 'madoa\\s?doa|\\bfumigat\\w+|\\bmende\\b|\\b41\\s*vs\\s*1\\b|\\bwarudi\\w*\\s+kwao\\b', 'i')) AS hit, coalesce(greatest(dehumanisation_score, violence_call_score, othering_score) >= 0.85::DOUBLE, false) AS hi FROM posts JOIN scores USING (platform_post_id)) SELECT CASE WHEN hit AND hi THEN 'joint' WHEN hi THEN 'menace_only' ELSE 'lexicon_only' END AS rule, count(*) AS n FROM h WHERE hit OR hi GROUP BY 1")
def _(t: Tables):
    x = t.posts.join(t.scores, "platform_post_id").withColumn("lexicon_hits", X.hits(F.col("text"))).withColumn("menace", F.greatest("dehumanisation_score", "violence_call_score", "othering_score"))
    return X2.incitement_sweep(x).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


PAIRS = "pa AS (SELECT CASE doc_id % 3 WHEN 0 THEN 'hate' WHEN 1 THEN 'offensive' ELSE 'neither' END AS a, CASE WHEN toxic = 1 THEN 'hate' WHEN quality = 0 THEN 'offensive' ELSE 'neither' END AS b, doc_id FROM labels)"


def pairs(t: Tables):
    a = F.when(F.col("doc_id") % 3 == 0, "hate").when(F.col("doc_id") % 3 == 1, "offensive").otherwise("neither")
    b = F.when(F.col("toxic") == 1, "hate").when(F.col("quality") == 0, "offensive").otherwise("neither")
    return t.labels.select("doc_id", a.alias("a"), b.alias("b"))


CLASSES = ("hate", "offensive", "neither")


@query("ag29_confusion", "", f"{PAIRS}, c(a) AS (VALUES ('hate'), ('offensive'), ('neither')) SELECT x.a, y.a AS b, (SELECT count(*) FROM pa WHERE pa.a = x.a AND pa.b = y.a) AS n FROM c x, c y")
def _(t: Tables):
    return LB.confusion(pairs(t), CLASSES)


@query("ag30_kappa", "", f"{PAIRS}, m AS (SELECT count(*) AS n, avg((a = b)::INT) AS po FROM pa), e AS (SELECT sum(x * y) AS pe FROM (SELECT a, count(*)::DOUBLE / (SELECT n FROM m) AS x FROM pa GROUP BY 1) JOIN (SELECT b AS a, count(*)::DOUBLE / (SELECT n FROM m) AS y FROM pa GROUP BY 1) USING (a)) SELECT n, round(po, 6) AS agree, round((po - pe) / (1 - pe), 6) AS kappa FROM m, e")
def _(t: Tables):
    return LB.agreement(pairs(t)).select("n", F.round("agree", 6).alias("agree"), F.round("kappa", 6).alias("kappa"))


@query("ag31_class_metrics", "", f"{PAIRS}, c(label) AS (VALUES ('hate'), ('offensive'), ('neither')) SELECT label, round(coalesce(count(*) FILTER (WHERE a = label AND b = label)::DOUBLE / nullif(count(*) FILTER (WHERE b = label), 0), 0), 6) AS precision, round(coalesce(count(*) FILTER (WHERE a = label AND b = label)::DOUBLE / nullif(count(*) FILTER (WHERE a = label), 0), 0), 6) AS recall, round(coalesce(2.0::DOUBLE * count(*) FILTER (WHERE a = label AND b = label) / nullif(count(*) FILTER (WHERE a = label) + count(*) FILTER (WHERE b = label), 0), 0), 6) AS f1, count(*) FILTER (WHERE a = label) AS support FROM pa, c GROUP BY 1")
def _(t: Tables):
    return LB.class_metrics(pairs(t)).select("label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


@query("ag32_threshold_sweep", "scores", "t AS (SELECT i / 20.0 AS th FROM range(1, 20) r(i)) SELECT round(th, 2)::DOUBLE AS threshold, count(*) FILTER (WHERE p_hate >= round(th, 2)::DOUBLE) AS flagged, round(coalesce(count(*) FILTER (WHERE p_hate >= round(th, 2)::DOUBLE AND label = 'hate')::DOUBLE / nullif(count(*) FILTER (WHERE p_hate >= round(th, 2)::DOUBLE), 0), 0), 6) AS precision, round(count(*) FILTER (WHERE p_hate >= round(th, 2)::DOUBLE AND label = 'hate')::DOUBLE / count(*) FILTER (WHERE label = 'hate'), 6) AS recall FROM scores, t GROUP BY th")
def _(t: Tables):
    out = LB.threshold_sweep(t.scores.withColumn("y", F.col("label") == "hate"), "p_hate", "y", [round(i / 20, 2) for i in range(1, 20)])
    return out.select("threshold", "flagged", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query("lb02_adjudication", "", f"{PAIRS} SELECT doc_id AS post_id, CASE WHEN a = b THEN a WHEN a = 'hate' AND b = 'offensive' OR a = 'offensive' AND b = 'hate' THEN CASE WHEN doc_id % 2 = 0 THEN 'hate' ELSE 'offensive' END WHEN doc_id % 2 = 0 THEN CASE WHEN a = 'hate' OR b = 'hate' THEN 'hate' ELSE 'offensive' END ELSE 'offensive' END AS final FROM pa")
def _(t: Tables):
    flags = F.array().cast("array<string>")
    p = pairs(t).withColumnRenamed("doc_id", "post_id")
    third = p.select("post_id", F.when(F.col("post_id") % 2 == 0, "hate").otherwise("offensive").alias("label"))
    one, two = (p.select("post_id", F.col(c).alias("label"), flags.alias("flags")) for c in ("a", "b"))
    return LB.adjudicate(LB.merge_labellers(p.select("post_id"), one, two), third, CLASSES).select("post_id", "final")


@query("lb07_precedence", "", f"{PAIRS} SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN a ELSE b END AS label, CASE WHEN doc_id % 4 = 0 THEN 'gold' ELSE 'pool' END AS source FROM pa")
def _(t: Tables):
    p = pairs(t)
    return LB.by_precedence([("gold", p.where("doc_id % 4 = 0").select("doc_id", F.col("a").alias("label"))), ("pool", p.select("doc_id", F.col("b").alias("label")))], "doc_id")


@query("ag33_stratum_rates", "", f"{PAIRS} SELECT doc_id % 5 AS stratum, count(*) AS n, round(avg((a = b)::INT), 6) AS agree FROM pa GROUP BY 1")
def _(t: Tables):
    return pairs(t).groupBy((F.col("doc_id") % 5).alias("stratum")).agg(F.count(F.lit(1)).alias("n"), F.round(S.share(F.col("a") == F.col("b")), 6).alias("agree"))


@query("sl07_merge_targets", "acts", "a AS (SELECT concat('h', u) AS handle, max(ts) AS seen, count(*) AS n FROM acts WHERE u < 60 GROUP BY 1), b AS (SELECT concat('h', u) AS handle, count(*) AS m FROM acts WHERE u >= 30 AND ts > TIMESTAMP '2024-01-25' GROUP BY 1) SELECT handle, coalesce(m, 0) AS strength FROM (SELECT coalesce(a.handle, b.handle) AS handle, m, CASE WHEN m IS NOT NULL THEN TIMESTAMP '2024-02-01' ELSE seen END AS seen FROM a FULL JOIN b ON a.handle = b.handle) WHERE seen > TIMESTAMP '2024-02-01' - INTERVAL 3 DAYS ORDER BY coalesce(m, 0) DESC, handle LIMIT 40")
def _(t: Tables):
    handle = F.concat(F.lit("h"), F.col("u").cast("string")).alias("handle")
    known = t.acts.where("u < 60").groupBy(handle).agg(F.max("ts").alias("last_seen"))
    found = t.acts.where("u >= 30 AND ts > TIMESTAMP '2024-01-25 00:00:00'").groupBy(handle).agg(F.count(F.lit(1)).alias("strength"))
    return ledgers.merge_targets(known, found, AS_OF, ttl_days=3, cap=40).select("handle", "strength")


@query("sl11_directory", "acts authors_raw", f"{FOLLOWS} SELECT DISTINCT a.platform_user_id AS id, a.handle FROM (SELECT f AS id FROM fo UNION SELECT t FROM fo) x JOIN authors_raw a ON a.platform_user_id = x.id")
def _(t: Tables):
    return ledgers.directory(follows(t), t.authors_raw)
