"""Further queries: counters, ledgers, evaluation, near-duplicates, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.functions import stats as S
from tidemark.functions import text as T
from tidemark.functions.order import checkpointed
from tidemark.operators import evaluation as E
from tidemark.operators import labels as LB
from tidemark.operators import latest as L
from tidemark.operators import ledgers, neardup, rollups, seeds, selection
from tidemark.operators import network as N
from tidemark.operators import stories as ST
from tidemark.plans.core import FEATURES, LP
from tidemark.plans.networks import STRONG, strong
from tidemark.plans.registry import query
from tidemark.plans.stories import CLASSES, PAIRS, STORY, pairs, story_rows
from tidemark.plans.tables import AS_OF, Tables
from tidemark.streaming import passes


@query("ag02_conditional_counts", "posts scores", "SELECT author_id, count(*) AS n, count(*) FILTER (WHERE label <> 'neither') AS n_toxic, count(DISTINCT CASE WHEN label <> 'neither' THEN date_trunc('day', created_at) END) AS toxic_days FROM posts JOIN scores USING (platform_post_id) GROUP BY 1")
def _(t: Tables):
    bad = F.col("label") != "neither"
    return t.posts.join(t.scores, "platform_post_id").groupBy("author_id").agg(F.count(F.lit(1)).alias("n"), S.count_if(bad).alias("n_toxic"), F.countDistinct(F.when(bad, F.to_date("created_at"))).alias("toxic_days"))


@query("ag41_flag_counts", "posts scores", "SELECT flag, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN hate_flag THEN 'hate' END, CASE WHEN coded_suspect THEN 'coded' END, CASE WHEN p_hate > 0.5 THEN 'likely' END], lambda x: x IS NOT NULL)) AS flag FROM scores) GROUP BY 1")
def _(t: Tables):
    flags = F.array_compact(F.array(F.when(F.col("hate_flag"), "hate"), F.when(F.col("coded_suspect"), "coded"), F.when(F.col("p_hate") > 0.5, "likely")))
    return t.scores.select(F.explode(flags).alias("flag")).groupBy("flag").agg(F.count(F.lit(1)).alias("n"))


@query("ag43_sample_sizes", "", "SELECT p, min(n) AS n FROM (SELECT p, n FROM (VALUES (0.05::DOUBLE), (0.2::DOUBLE), (0.5::DOUBLE)) v(p), range(1, 3000) r(n) WHERE 1.96::DOUBLE * sqrt(p * (1 - p) / n + 3.8416::DOUBLE / (4.0::DOUBLE * n * n)) / (1 + 3.8416::DOUBLE / n) <= 0.03::DOUBLE) GROUP BY 1")
def _(t: Tables):
    return t.spark.createDataFrame([(p, S.required_sample_size(p, 0.03)) for p in (0.05, 0.2, 0.5)], "p double, n long")


@query("ag44_annotator_agreement", "acts", "SELECT e, round(greatest(e % 3, e % 4, 1)::DOUBLE / (e % 3 + e % 4 + 1), 6) AS agreement FROM acts")
def _(t: Tables):
    v = t.acts.select("e", (F.col("e") % 3).alias("a"), (F.col("e") % 4).alias("b"), F.lit(1).cast("long").alias("c"))
    return LB.annotator_agreement(v, ("a", "b", "c")).select("e", F.round("agreement", 6).alias("agreement"))


@query("ag45_regional_rate", "posts authors_raw scores", "SELECT location, count(*) AS n, round(avg((label <> 'neither')::INT), 6) AS rate FROM posts JOIN scores USING (platform_post_id) JOIN authors_raw a ON a.platform_user_id = author_id WHERE in_scope GROUP BY 1 HAVING count(*) >= 200")
def _(t: Tables):
    who = t.authors_raw.select(F.col("platform_user_id").alias("author_id"), "location")
    x = t.posts.join(t.scores.where("in_scope"), "platform_post_id").join(who, "author_id")
    return x.groupBy("location").agg(F.count(F.lit(1)).alias("n"), F.round(S.share(F.col("label") != "neither"), 6).alias("rate")).where("n >= 200")


@query("ag50_fetch_counters", "posts", "d AS (SELECT repost_of_id, count(DISTINCT author_id) AS n FROM posts WHERE repost_of_id IS NOT NULL GROUP BY 1), o AS (SELECT n, row_number() OVER (ORDER BY n) - 1 AS r, count(*) OVER () AS c FROM d) SELECT max(n) FILTER (WHERE r = CAST(round_even(0.5 * (c - 1), 0) AS BIGINT)) AS p50, max(n) FILTER (WHERE r = CAST(round_even(0.9 * (c - 1), 0) AS BIGINT)) AS p90, max(n) AS top, count(*) FILTER (WHERE n > 18) AS over FROM o")
def _(t: Tables):
    d = t.posts.where("repost_of_id is not null").groupBy("repost_of_id").agg(F.countDistinct("author_id").alias("n"))
    return d.agg(rollups.nearest_rank("n", 0.5).alias("p50"), rollups.nearest_rank("n", 0.9).alias("p90"), F.max("n").alias("top"), S.count_if(F.col("n") > 18).alias("over"))


@query("ag52_trajectories", "posts_raw", "g AS (SELECT platform_post_id, count(*) AS n_snapshots, max(like_count) AS peak, min_by(like_count, collected_at) AS first FROM posts_raw GROUP BY 1 ORDER BY peak DESC, platform_post_id LIMIT 100) SELECT *, coalesce(platform_post_id = (SELECT arg_max(platform_post_id, (peak, platform_post_id)) FROM g WHERE n_snapshots >= 3), false) AS leads FROM g")
def _(t: Tables):
    return E.trajectories(t.posts_raw)


@query("wn18_author_cap", "posts", "SELECT author_id, platform_post_id FROM posts QUALIFY row_number() OVER (PARTITION BY author_id ORDER BY like_count DESC, platform_post_id) <= 3")
def _(t: Tables):
    return selection.capped(t.posts, "author_id", 3, F.desc("like_count"), "platform_post_id").select("author_id", "platform_post_id")


@query("tk01_top_suspicion", "posts_raw authors_raw", f"{FEATURES} SELECT id, round(suspicion, 6) AS suspicion FROM sus ORDER BY round(suspicion, 9) DESC NULLS LAST, id LIMIT 25")
def _(t: Tables):
    from tidemark.operators import accounts

    out = accounts.suspicion(accounts.author_features(t.authors_raw, t.posts_raw, AS_OF))
    return out.orderBy(F.desc_nulls_last(F.round("suspicion", 9)), "platform_user_id").limit(25).select(F.col("platform_user_id").alias("id"), F.round("suspicion", 6).alias("suspicion"))


@query("tk06_priority_pools", "acts", "a AS (SELECT e FROM acts WHERE kind = 'error' ORDER BY e LIMIT 30), b AS (SELECT e FROM acts WHERE u < 20 AND e NOT IN (SELECT e FROM a) ORDER BY e LIMIT 40), c AS (SELECT e FROM acts WHERE e NOT IN (SELECT e FROM a) AND e NOT IN (SELECT e FROM b) ORDER BY e LIMIT 10) SELECT e, 0 AS pool FROM a UNION ALL SELECT e, 1 FROM b UNION ALL SELECT e, 2 FROM c")
def _(t: Tables):
    pools = [t.acts.where("kind = 'error'").select("e"), t.acts.where("u < 20").select("e"), t.acts.select("e")]
    return selection.by_priority(pools, "e", [30, 40, 10], ["e"])


@query("st07_minhash_clusters")
def _(t: Tables):
    return neardup.clusters(t.documents, "doc_id", "text")


@query("ev01_first_drop", "posts scores acts", "c AS (SELECT concat('p', e) AS id, e % 5 AS case_id FROM acts UNION ALL SELECT concat('gone', e), 5 FROM acts), p AS (SELECT c.case_id, (p.platform_post_id IS NOT NULL)::INT AS a, (s.label IN ('hate', 'offensive'))::INT AS b, (s.p_hate >= 0.9 AND s.label IN ('hate', 'offensive') AND c.case_id <> 3)::INT AS d FROM c LEFT JOIN posts p ON p.platform_post_id = c.id LEFT JOIN scores s ON s.platform_post_id = c.id) SELECT case_id, sum(a)::BIGINT AS n_presence, coalesce(sum(b), 0)::BIGINT AS n_embedding, coalesce(sum(d), 0)::BIGINT AS n_rank, CASE WHEN sum(a) = 0 THEN 'presence' WHEN sum(b) = 0 THEN 'embedding' WHEN sum(d) = 0 THEN 'clustering' END AS dropped_at FROM p GROUP BY 1")
def _(t: Tables):
    case = t.acts.select(F.concat(F.lit("p"), F.col("e").cast("string")).alias("platform_post_id"), (F.col("e") % 5).alias("case_id"))
    case = case.unionByName(t.acts.select(F.concat(F.lit("gone"), F.col("e").cast("string")).alias("platform_post_id"), F.lit(5).cast("long").alias("case_id")))
    bad = t.scores.where("label in ('hate', 'offensive')")
    far = bad.where("p_hate >= 0.9").join(case.where("case_id = 3"), "platform_post_id", "left_anti")
    return E.first_drop(case, t.posts, bad, far, far, far).select("case_id", "n_presence", "n_embedding", "n_rank", "dropped_at")


@query("ev02_resolve_posts", "posts", "SELECT platform_post_id FROM posts WHERE text ILIKE '%WARUDI kwao%' OR text ILIKE '%fumigate%'")
def _(t: Tables):
    return E.resolve_posts(t.posts, ["%WARUDI kwao%", "%fumigate%"]).select("platform_post_id")


@query("hs02_stale_tables", "scores engagements_raw", "SELECT NOT coalesce((SELECT max(scored_at) FROM scores) >= TIMESTAMP '2024-02-01' - INTERVAL 24 HOURS, false) AS scores_stale, NOT coalesce((SELECT max(collected_at) FROM engagements_raw) >= TIMESTAMP '2024-02-01' - INTERVAL 1 HOURS, false) AS edges_stale")
def _(t: Tables):
    return t.spark.createDataFrame([(seeds.is_stale(t.scores, "scored_at", AS_OF, 24), seeds.is_stale(t.engagements_raw, "collected_at", AS_OF, 1))], "scores_stale boolean, edges_stale boolean")


@query("hs04_term_examples", "posts", "SELECT platform_post_id FROM posts WHERE regexp_matches(text, '\\bkwao\\b', 'i') ORDER BY created_at DESC, platform_post_id LIMIT 5")
def _(t: Tables):
    return seeds.term_examples(t.posts, "kwao").select("platform_post_id")


@query("sl02_with_toxic", "posts scores", "b AS (SELECT platform_post_id AS id FROM posts WHERE like_count > 890), x AS (SELECT platform_post_id AS id FROM scores WHERE label = 'hate') SELECT id AS object_id, 'baseline' AS lane FROM b UNION ALL SELECT id, 'toxic' FROM x WHERE id NOT IN (SELECT id FROM b)")
def _(t: Tables):
    own = F.col("platform_post_id").alias("object_id")
    return ledgers.with_toxic_first(t.posts.where("like_count > 890").select(own), t.scores.where("label = 'hate'").select(own))


@query("sl06_cluster_accounts", "posts authors_raw", "m AS (SELECT DISTINCT author_id, CAST(substr(author_id, 2) AS BIGINT) % 9 AS c FROM posts) SELECT c AS cluster_id, a.handle FROM m JOIN authors_raw a ON a.platform_user_id = m.author_id WHERE c IN (SELECT c FROM m GROUP BY 1 ORDER BY count(*) DESC, c LIMIT 3)")
def _(t: Tables):
    m = t.posts.select("author_id").distinct().withColumn("cluster_id", F.substring("author_id", 2, 9).cast("long") % 9)
    top = m.groupBy("cluster_id").count().orderBy(F.desc("count"), "cluster_id").limit(3).select("cluster_id")
    who = L.latest(t.authors_raw, ("platform", "platform_user_id"), "collected_at").select(F.col("platform_user_id").alias("author_id"), "handle")
    return m.join(F.broadcast(top), "cluster_id").join(who, "author_id").select("cluster_id", "handle")


@query("sl10_rotation", "acts", "w AS (SELECT concat('w', k) AS term, k % 3 AS pool, max(ts) AS l FROM acts GROUP BY 1, 2) SELECT term, pool FROM w QUALIFY row_number() OVER (PARTITION BY pool ORDER BY l NULLS FIRST, term) <= 4")
def _(t: Tables):
    w = t.acts.groupBy(F.concat(F.lit("w"), F.col("k").cast("string")).alias("term"), (F.col("k") % 3).alias("pool")).agg(F.max("ts").alias("last_searched"))
    return ledgers.rotation(w, 4).select("term", "pool")


@query("sl11_next_level", "acts", "fo AS (SELECT DISTINCT concat('u', u) AS f, concat('u', (u * 3 + k) % 150) AS t FROM acts) SELECT DISTINCT t AS id FROM fo WHERE f IN ('u1', 'u2') AND t NOT IN ('u1', 'u2', 'u3', 'u4', 'u5')")
def _(t: Tables):
    from tidemark.plans.stories import follows

    ids = lambda *x: t.spark.createDataFrame([(i,) for i in x], "id string")
    return ledgers.next_level(follows(t), ids("u1", "u2"), ids("u1", "u2", "u3", "u4", "u5"))


@query("sl12_over_band", "posts", "d AS (SELECT repost_of_id, count(*) AS n FROM posts WHERE repost_of_id IS NOT NULL GROUP BY 1) SELECT round(avg((n > 22)::INT), 6) AS share, avg((n > 22)::INT) > 0.15 AS drifting FROM d")
def _(t: Tables):
    d = t.posts.where("repost_of_id is not null").groupBy("repost_of_id").agg(F.count(F.lit(1)).alias("n"))
    return ledgers.over_band(d, 22).withColumn("share", F.round("share", 6))


@query("co18_claim_coordination", "timed posts", f"{STRONG}, w AS (SELECT DISTINCT p.author_id FROM posts p WHERE p.conversation_id = 'c7'), i AS (SELECT * FROM st WHERE src IN (SELECT author_id FROM w) AND dst IN (SELECT author_id FROM w)) SELECT (SELECT count(*) FROM w) AS n_accounts, count(*) AS n_edges, coalesce(max(weight), 0) AS max_weight, (SELECT count(DISTINCT x) FROM (SELECT src AS x FROM i UNION ALL SELECT dst FROM i)) AS n_linked, round(2.0 * count(*) / ((SELECT count(*) FROM w) * ((SELECT count(*) FROM w) - 1)), 8) AS density FROM i")
def _(t: Tables):
    who = t.posts.where("conversation_id = 'c7'")  # the claim's own posts
    return E.claim_coordination(who, strong(t)).withColumn("density", F.round("density", 8))


@query("co13_cluster_names", "", f"""{STORY}, w AS (SELECT story_id, unnest(regexp_extract_all(regexp_replace(lower(text), 'https?://\\S+|@\\w+|#\\w+|[^\\w\\s]', ' ', 'g'), '[a-z]{{3,}}')) AS term FROM sr WHERE story_id IS NOT NULL), tf AS (SELECT story_id, term, count(*) AS tf FROM w GROUP BY 1, 2), sz AS (SELECT story_id, sum(tf) AS n FROM tf GROUP BY 1), us AS (SELECT term, sum(tf) AS n FROM tf GROUP BY 1),
sc AS (SELECT tf.story_id, term, row_number() OVER (PARTITION BY story_id ORDER BY round(tf::DOUBLE / sz.n * ln(1 + (SELECT avg(n) FROM sz) / us.n), 10) DESC, term) AS r FROM tf JOIN sz USING (story_id) JOIN us USING (term)), ba AS (SELECT story_id, string_agg(term, ' / ' ORDER BY r) AS base FROM sc WHERE r <= 3 GROUP BY 1),
nu AS (SELECT s.story_id, size, coalesce(base, 'mixed') AS base, row_number() OVER (PARTITION BY coalesce(base, 'mixed') ORDER BY size DESC, s.story_id) AS k FROM (SELECT story_id, count(*) AS size FROM sr WHERE story_id IS NOT NULL GROUP BY 1) s LEFT JOIN ba USING (story_id)) SELECT story_id, size, concat(base, CASE WHEN k > 1 THEN concat(' ', k) ELSE '' END, ' (n=', size, ')') AS name FROM nu""")
def _(t: Tables):
    rows = story_rows(t).where("story_id is not null")
    return E.names(ST.class_terms(rows, "story_id", "text"), rows.groupBy("story_id").agg(F.count(F.lit(1)).alias("size")), "story_id")


@query("co24_node_attributes", "timed authors_raw", f"{STRONG}, d AS (SELECT x AS author_id, count(*) AS degree, sum(weight)::BIGINT AS strength FROM (SELECT src AS x, weight FROM st UNION ALL SELECT dst, weight FROM st) GROUP BY 1) SELECT author_id, handle, degree, strength FROM d JOIN authors_raw ON platform_user_id = author_id")
def _(t: Tables):
    ends = strong(t).select(F.explode(F.array("src", "dst")).alias("author_id"), "weight").groupBy("author_id").agg(F.count(F.lit(1)).alias("degree"), F.sum("weight").alias("strength"))
    who = L.latest(t.authors_raw, ("platform", "platform_user_id"), "collected_at").select(F.col("platform_user_id").alias("author_id"), "handle")
    return ends.join(who, "author_id")


@query("lb01_merge_labellers", "", f"{PAIRS} SELECT doc_id AS post_id, a = b AS agree, CASE WHEN doc_id % 2 = 0 THEN CASE WHEN doc_id % 3 = 0 THEN 'sarcasm,slur' ELSE 'slur' END WHEN doc_id % 3 = 0 THEN 'sarcasm' ELSE '' END AS flags FROM pa")
def _(t: Tables):
    p = pairs(t).withColumnRenamed("doc_id", "post_id")
    one = p.select("post_id", F.col("a").alias("label"), F.when(F.col("post_id") % 2 == 0, F.array(F.lit("slur"))).alias("flags"))
    two = p.select("post_id", F.col("b").alias("label"), F.when(F.col("post_id") % 3 == 0, F.array(F.lit("sarcasm"))).alias("flags"))
    return LB.merge_labellers(p.select("post_id"), one, two).select("post_id", "agree", F.array_join("flags", ",").alias("flags"))


@query("lb03_gold_split", "", f"{PAIRS} SELECT doc_id, CASE WHEN a <> b THEN NULL WHEN doc_id % 5 IN (1, 2) THEN 'challenge' ELSE 'gold' END AS pool FROM pa")
def _(t: Tables):
    m = pairs(t).select("doc_id", (F.col("doc_id") % 5).cast("string").alias("stratum"), F.when(F.col("a") == F.col("b"), F.col("a")).alias("final"))
    return E.gold_split(m, ("1", "2")).select("doc_id", "pool")


@query("lb05_gates", "", f"{PAIRS}, c(label) AS (VALUES ('hate'), ('offensive'), ('neither')) SELECT label, coalesce(count(*) FILTER (WHERE a = label AND b = label)::DOUBLE / nullif(count(*) FILTER (WHERE a = label), 0), 0) >= 0.2 AND coalesce(count(*) FILTER (WHERE a = label AND b = label)::DOUBLE / nullif(count(*) FILTER (WHERE b = label), 0), 0) >= 0.3 AS passes FROM pa, c GROUP BY 1")
def _(t: Tables):
    return E.gates(LB.class_metrics(pairs(t)), 0.2, 0.3).select("label", "passes")


@query("lb08_movement", "", f"{PAIRS}, c(a) AS (VALUES ('hate'), ('offensive'), ('neither')) SELECT x.a, y.a AS b, (SELECT count(*) FROM pa WHERE pa.a = x.a AND pa.b = y.a AND doc_id % 2 = 0) AS n FROM c x, c y")
def _(t: Tables):
    p = pairs(t).where("doc_id % 2 = 0")
    return LB.movement(p.select("doc_id", F.col("a").alias("label")), p.select("doc_id", F.col("b").alias("label")), "doc_id", CLASSES)


@query("lb11_language_mask", "", "SELECT doc_id, (length(text) < 40 OR regexp_matches(lower(text), '\\b(sana|kwa)\\b') OR lang IN ('en', 'fr')) AS keep FROM documents")
def _(t: Tables):
    return E.language_mask(t.documents, ("en", "fr"), ("sana", "kwa")).select("doc_id", "keep")


@query("cl01_stance_filter", "posts", f"{LP.replace('posts_raw', 'posts')} SELECT platform_post_id FROM lp WHERE text ILIKE '%nairobi%' ORDER BY created_at DESC, platform_post_id LIMIT 200")
def _(t: Tables):
    return E.resolve_posts(L.latest(t.posts, L.POST_KEY, "collected_at"), ["%nairobi%"]).orderBy(F.desc("created_at"), "platform_post_id").limit(200).select("platform_post_id")


@query("cl04_baseline")
def _(t: Tables):
    x = t.documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(t.labels.select("doc_id", F.col("toxic").cast("double").alias("label")), "doc_id")
    split = selection.split(x.withColumn("s", F.lit(1)), "doc_id", "s", {"train": 0.7, "test": 0.3}, 1)
    return E.baseline(split.where("split = 'train'"), split.where("split = 'test'")).select("doc_id", "label", "prediction")


@query("se01_embed_new", "posts", "SELECT platform_post_id FROM posts WHERE length(trim(text)) > 0 AND like_count >= 450")
def _(t: Tables):
    todo = L.pending(t.posts, t.posts.where("like_count < 450"))
    return E.encode(todo).where(F.size("embedding") == 64).select("platform_post_id")


@query("sf10_mining_terms", "", "SELECT term, count(*) AS n FROM (SELECT unnest(regexp_extract_all(regexp_replace(regexp_replace(lower(text), 'https?://\\S+', ' ', 'g'), '[@#][\\w_]+', ' ', 'g'), '[\\p{L}][\\p{L}''-]{2,}')) AS term FROM documents) GROUP BY 1")
def _(t: Tables):
    words = t.documents.select(F.explode(T.mining_terms(F.col("text"))).alias("term"))
    return words.groupBy("term").agg(F.count(F.lit(1)).alias("n"))


@query("sm04_streamed_hours", "acts", "SELECT epoch_us(date_trunc('hour', ts)) AS hour_us, count(*) AS n FROM acts GROUP BY 1")
def _(t: Tables):
    t.spark.conf.set("spark.sql.session.timeZone", "UTC")
    schema = t.spark.read.parquet(f"{t.sf_dir}/events.parquet").schema
    stream = t.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(t.sf_dir).select(F.col("ts").cast("timestamp").alias("created_at"))
    name = f"hours_{uuid.uuid4().hex}"
    run = passes.hourly_counts(stream).writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    run.awaitTermination()
    return t.spark.table(name).select(F.unix_micros("hr").alias("hour_us"), "n")


@query("co09_layers", "timed", f"{STRONG}, m AS (SELECT count(*) AS n FROM st) SELECT 'timed' AS channel, n FROM m")
def _(t: Tables):
    return strong(t).agg(F.count(F.lit(1)).alias("n")).select(F.lit("timed").alias("channel"), "n")


@query("ag14_corroborated", "timed", f"{STRONG} SELECT src, dst, 1 + (weight >= 3)::INT AS n_channels FROM st")
def _(t: Tables):
    s = checkpointed(strong(t)).withColumn("min_gap", F.lit(0.0))
    layers = s.withColumn("channel", F.lit("a")).unionByName(s.where("weight >= 3").withColumn("channel", F.lit("b")))
    return N.aggregate_layers(layers, "mass").select("src", "dst", "n_channels")
