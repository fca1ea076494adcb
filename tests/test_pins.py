"""Behaviour that the method pins, on small tables of our own."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import lexicon as X
from tidemark.functions import stats as S
from tidemark.functions import text as T
from tidemark.operators import graphs
from tidemark.operators import labels as LB
from tidemark.operators import latest as L
from tidemark.operators import network as N
from tidemark.operators import seeds, selection
from tidemark.operators import stories as ST

POST = "platform string, platform_post_id string, type string, author_handle string, collected_at timestamp"


def posts(spark, rows):
    return spark.createDataFrame(rows, "platform_post_id string, type string, day int").select(F.lit("x").alias("platform"), "platform_post_id", "type", F.lit("h").alias("author_handle"), F.timestamp_seconds(F.col("day") * 86400).alias("collected_at"))


def test_scopes_partition_the_corpus_and_the_first_collection_decides(spark):
    p = posts(spark, [("a", "search", 1), ("a", "hate_search", 2), ("b", "hate_search", 1), ("b", "search", 3), ("c", "timeline", 1)])
    base = {r[0] for r in L.latest_posts(p, "baseline").select("platform_post_id").collect()}
    target = {r[0] for r in L.latest_posts(p, "targeted").select("platform_post_id").collect()}
    assert base == {"a", "c"} and target == {"b"}
    assert L.latest_posts(p, "baseline").where("platform_post_id = 'a'").first()["type"] == "hate_search"


def test_promoted_timelines_are_targeted(spark):
    p = posts(spark, [("a", "timeline", 1)])
    assert L.latest_posts(p, "baseline", {"someone"}).count() == 0
    assert L.latest_posts(p, "targeted", {"someone"}).count() == 1
    assert L.latest_posts(p, "baseline", {"h"}).count() == 1


def test_unknown_kind_raises(spark):
    p = posts(spark, [("a", "mystery", 1)])
    with pytest.raises(Exception, match="mystery"):
        L.latest_posts(p, "baseline").collect()
    with pytest.raises(ValueError, match="mystery"):
        L.check_kinds(p)
    with pytest.raises(ValueError):
        L.in_scope(F.col("type"), "other")


def traces(spark, rows):
    return spark.createDataFrame([(a, o, None) for a, o in rows], "author_id string, action_object string, created_at timestamp")


def background(users=200, objects=200, seed=1):
    rng = random.Random(seed)
    rows = {(f"u{u}", f"o{rng.randrange(objects)}") for u in range(users) for _ in range(2)}
    for viral in range(2):
        rows |= {(f"u{u}", f"v{viral}") for u in rng.sample(range(users), 60)}
    return sorted(rows)


def test_chance_overlap_on_viral_objects_is_no_evidence(spark):
    edges = N.validated_edges(traces(spark, background()), capped=False).cache()
    m = edges.count()
    uniform = edges.where(F.col("p_uniform") < 0.01 / m).count()
    assert edges.where("sig_bonferroni").count() == 0
    assert uniform > edges.where("sig_bonferroni").count() or m == 0


def test_planted_ring_is_found_exactly(spark):
    rows = background() + [(f"bot{b}", f"seed{o}") for b in range(10) for o in range(6)]
    found = N.validated_edges(traces(spark, rows)).where("sig_bonferroni")
    assert found.where("src like 'bot%' and dst like 'bot%'").count() == 45
    assert found.where("not (src like 'bot%' and dst like 'bot%')").count() == 0


def test_injected_ring_is_recovered_and_shuffled_traces_hold_next_to_nothing(spark):
    t = traces(spark, background())
    r = N.recovery(N.validated_edges(N.inject(t, 10, 6)), "sig_bonferroni").first()
    assert r["recall"] == 1.0 and r["precision"] == 1.0
    # Only pairs with two shared objects are tested, so a handful may pass by chance; a ring has 45.
    assert N.validated_edges(N.shuffled(t)).where("sig_bonferroni").count() <= 4


def test_hub_cap_counters(spark):
    rows = [(f"u{i}", "hub") for i in range(12)] + [("u0", "a"), ("u1", "a"), ("u2", "b"), ("u3", "b")]
    kept = N.without_hubs(traces(spark, rows), floor=5, ceiling=5)
    assert kept.count() == 4 and {r[0] for r in kept.select("action_object").distinct().collect()} == {"a", "b"}


def test_timed_projection_counts_within_delta(spark):
    at = [("a", 0), ("b", 30), ("c", 60), ("d", 120)]
    t = spark.createDataFrame(at, "author_id string, s int").select("author_id", F.lit("o").alias("action_object"), F.timestamp_seconds("s").alias("created_at"))
    got = {(r["src"], r["dst"]) for r in N.project(t, delta=60, least=1).collect()}
    assert got == {("a", "b"), ("a", "c"), ("b", "c"), ("c", "d")}


@pytest.mark.parametrize("x,mean", [(1, 0.5), (3, 0.5), (10, 2.0), (5, 40.0), (60, 40.0), (200, 150.0)])
def test_poisson_tail(spark, x, mean):
    want = 1 - sum(math.exp(k * math.log(mean) - mean - math.lgamma(k + 1)) for k in range(x))
    got = spark.range(1).select(S.poisson_tail(F.lit(x), F.lit(mean)).alias("p")).first()["p"]
    assert got == pytest.approx(want, rel=1e-7, abs=1e-13)


def test_benjamini_hochberg(spark):
    p = [0.001, 0.008, 0.039, 0.041, 0.042, 0.06, 0.074, 0.205]
    df = spark.createDataFrame([(x,) for x in p], "p double")
    got = {r["p"] for r in S.benjamini_hochberg(df, "p", "ok", 0.05).where("ok").collect()}
    assert got == {0.001, 0.008}


def test_pct_rank_averages_ties_and_skips_nulls(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 2.0), (4, None)], "i int, v double")
    got = {r["i"]: r["r"] for r in S.with_pct_rank(df, "v", "r").collect()}
    assert got[1] == pytest.approx(1 / 3) and got[2] == got[3] == pytest.approx(2.5 / 3) and got[4] is None


def test_wilson_prefers_evidence(spark):
    got = spark.createDataFrame([(1, 1), (40, 300)], "k int, n int").select("k", S.wilson_lower(F.col("k"), F.col("n")).alias("w"))
    w = {r["k"]: r["w"] for r in got.collect()}
    assert w[40] > 0.05 and S.required_sample_size(0.5, 0.05) in range(370, 395)


def test_components_and_communities(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (10, 11), (12, 10), (20, 20)], "src long, dst long")
    got = {r["node"]: r["component"] for r in graphs.connected_components(links).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 10: 10, 11: 10, 12: 10, 20: 20}
    ring = [(f"{g}{i}", f"{g}{j}", 1.0) for g in "ab" for i in range(5) for j in range(i + 1, 5)] + [("a0", "b0", 0.1)]
    e = spark.createDataFrame(ring, "src string, dst string, weight double")
    of = {r["author_id"]: r["cluster_id"] for r in N.communities(e, 0.3).collect()}
    assert len(set(of.values())) == 2 and of["a0"] != of["b0"] and len({of[f"a{i}"] for i in range(5)}) == 1


def test_curveball_keeps_degrees():
    import numpy as np

    a, o = np.array([0, 0, 0, 1, 1, 2, 3]), np.array([0, 1, 2, 2, 3, 1, 4])
    sets = graphs.curveball(4, a, o, np.random.default_rng(0))
    assert [len(s) for s in sets] == [3, 2, 1, 1] and sorted(x for s in sets for x in s) == sorted(o.tolist())


MEASURES = [
    # text, menace, criticism, label, flag -> domain, coded, explicit
    ("madoa doa out of Nairobi", 0.46, 0.3, "neither", False, "home", True, False),
    ("mende in the kitchen", 0.6, 0.1, "neither", False, "ambiguous", False, False),
    ("mende they are", 0.7, 0.1, "neither", False, "ambiguous", True, False),
    ("fumigate them", 0.56, 0.6, "neither", False, "ambiguous", False, False),
    ("Trump and the Congress", 0.9, 0.0, "hate", True, "offdomain", False, False),
    ("Trump in Nairobi", None, None, "offensive", False, "home", False, True),
    (None, 0.9, 0.0, "neither", True, "ambiguous", False, True),
]


@pytest.mark.parametrize("text,menace,criticism,label,flag,domain,coded,explicit", MEASURES)
def test_measures(spark, text, menace, criticism, label, flag, domain, coded, explicit):
    row = [(text, menace, None, None, criticism, label, flag)]
    df = spark.createDataFrame(row, "text string, dehumanisation_score double, violence_call_score double, othering_score double, political_criticism_score double, label string, hate_flag boolean")
    got = X.with_measures(df).first()
    assert (got["domain"], got["coded_suspect"], got["explicit_toxic"]) == (domain, coded, explicit)


def test_text_keys(spark):
    one = spark.range(1)
    assert one.select(T.url_key(F.lit("HTTPS://A.b/c/?utm_source=x&fbclid=y"))).first()[0] == "https://a.b/c"
    assert one.select(T.content_words(F.lit("See https://a.b/c @who #Tag x ab"))).first()[0] == 3
    assert one.select(T.stable_id(F.array(F.lit("b"), F.lit("a")))).first()[0] == one.select(T.stable_id(F.array(F.lit("a"), F.lit("b")))).first()[0]


def test_majority_and_agreement(spark):
    df = spark.createDataFrame([("hate", "hate", "neither"), ("hate", "offensive", "neither")], "a string, b string, c string")
    got = [r[0] for r in df.select(LB.majority([F.col("a"), F.col("b"), F.col("c")], ("hate", "offensive", "neither"))).collect()]
    assert got == ["hate", "offensive"]
    with pytest.raises(ValueError):
        LB.check_batch(df.withColumn("label", F.lit("odd")).withColumn("id", F.monotonically_increasing_id()), ["label"], "id", ["hate"])


def test_due_is_null_safe(spark):
    items = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    ledger = spark.createDataFrame([("a", 100), (None, 100)], "k string, s int").select("k", F.timestamp_seconds("s").alias("visited_at"))
    assert [r[0] for r in L.due(items, ledger, "k", "1970-01-01 01:00:00", 12).collect()] == ["b"]


def test_sampling_is_reproducible_and_proportional(spark):
    df = spark.range(1000).withColumn("s", (F.col("id") % 4 == 0).cast("string"))
    a, b = (sorted(r[0] for r in selection.stratified(df, "s", "id", 100, 5).select("id").collect()) for _ in range(2))
    assert a == b and len(a) == 100
    n = selection.split(df, "id", "s", {"train": 0.8, "val": 0.1, "test": 0.1}, 1).groupBy("split").count().collect()
    assert {r[0]: r[1] for r in n}["train"] == 800


def test_tiers(spark):
    card = spark.createDataFrame([(0, 5, 0.5, 0.0, 0.0, 0.6), (1, 2, 0.99, 0.1, 0.0, 0.9), (2, 2, 0.99, 0.6, 0.0, 0.1), (3, 2, 0.5, 0.9, 0.0, 0.9)], "story_id int, size int, corroboration_gap double, amplifier_botness double, coordination_overlap double, story_suspicion_index double")
    text = spark.createDataFrame([(i, "Some Name here") for i in range(4)], "story_id int, text string")
    got = {r["story_id"]: (r["tier"], r["high_suspicion"]) for r in ST.assign_tiers(card, text).collect()}
    assert got == {0: ("main", True), 1: ("thin_evidence", False), 2: ("thin_evidence", True)}


def test_same_topic_other_claim_does_not_corroborate(spark):
    s = spark.createDataFrame([(0, "Motorcade crash near Embu injured several people", [1.0, 0.0, 0.0])], "story_id int, text string, vec array<double>")
    t = spark.createDataFrame([("t1", "news", "Bus crash near Nakuru injured several people", [0.9, 0.1, 0.0]), ("t2", "news", "Motorcade crash at Embu injured several", [0.8, 0.6, 0.0])], "platform_post_id string, author_handle string, text string, vec array<double>")
    got = ST.corroboration(s, t).first()
    assert got["nearest_post_id"] == "t2" and got["corrob_sim"] == pytest.approx(0.8)
    none = ST.corroboration(s, t.where("platform_post_id = 't1'").limit(1)).first()
    assert none["corrob_sim"] == 0.0 and none["nearest_post_id"] is None


def test_ledger_merge_keeps_approval(spark):
    known = spark.createDataFrame([("old", True, 0, 0, 1.0), ("gone", False, 0, 0, 1.0)], "term string, approved boolean, f int, l int, novelty double").select("term", "approved", F.timestamp_seconds("f").alias("first_seen"), F.timestamp_seconds("l").alias("last_seen"), "novelty")
    found = spark.createDataFrame([("new", 3.0), ("newer", 5.0)], "term string, novelty double")
    got = {r["term"] for r in seeds.merge_terms(known, found, "1970-03-01 00:00:00", 30, 1).collect()}
    assert got == {"old", "newer"}
