"""Iterative and random operators against planted structure, brute force and their own invariants."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.test_pins import background, traces
from tidemark.functions import order as O
from tidemark.functions import requests as R
from tidemark.functions import stats as S
from tidemark.functions import text as T
from tidemark.operators import accounts, forensics, ledgers, neardup, runs, scoring, selection, vectors
from tidemark.operators import labels as LB
from tidemark.operators import latest as L
from tidemark.operators import network as N
from tidemark.operators import stories as ST
from tidemark.sources.catalog import Catalog, write_artifact
from tidemark.streaming import passes


def test_numbering_and_ranks_match_pandas(spark):
    rng = np.random.default_rng(0)
    d = pd.DataFrame({"i": range(3000), "g": rng.integers(0, 3, 3000), "v": np.where(rng.random(3000) < 0.3, 5.0, rng.integers(0, 40, 3000) / 4)})
    df = spark.createDataFrame(d).withColumn("v", F.when(F.col("i") % 50 != 0, F.col("v")))
    d.loc[d["i"] % 50 == 0, "v"] = np.nan
    n = O.numbered(df, "v", "i").toPandas().sort_values("_n")
    assert n["_n"].tolist() == list(range(3000)) and n["i"].tolist() == d.sort_values(["v", "i"], na_position="first")["i"].tolist()
    got = S.with_pct_rank(S.with_pct_rank(df, "v", "all"), "v", "within", by=("g",)).toPandas().set_index("i").sort_index()
    assert np.allclose(got["all"], d["v"].rank(pct=True), equal_nan=True)
    assert np.allclose(got["within"], d.groupby("g")["v"].rank(pct=True), equal_nan=True)
    p = O.with_percent_rank(df, "v", "p", ("g",)).toPandas().set_index("i").sort_index()["p"]
    m = d.groupby("g")["v"].rank(method="min")
    assert np.allclose(p, (m - 1) / (d.groupby("g")["v"].transform("count") - 1), equal_nan=True)


def test_hypergeometric_tail(spark):
    from math import comb

    cases = [(1, 50, 10, 10), (3, 50, 10, 10), (10, 50, 10, 10), (0, 50, 10, 10), (40, 60, 50, 45), (36, 60, 50, 45), (35, 60, 50, 45), (11, 50, 10, 10), (30, 4000, 300, 250), (5, 4000, 300, 250)]
    df = spark.createDataFrame(cases, "x long, n long, a long, b long").withColumn("p", S.hypergeometric_tail(F.col("x"), F.col("n"), F.col("a"), F.col("b")))
    for r in df.collect():
        want = sum(comb(r.a, k) * comb(r.n - r.a, r.b - k) for k in range(r.x, min(r.a, r.b) + 1)) / comb(r.n, r.b)
        assert r.p == pytest.approx(want, rel=1e-6, abs=1e-13)


def test_trades_keep_degrees_and_move_objects(spark):
    t = traces(spark, background(60, 40))
    got = N.traded(t, 3, rounds=6, seed=1).toPandas()
    want = t.toPandas()
    for _, g in got.groupby("rep"):
        for c in ("author_id", "action_object"):
            assert g.groupby(c).size().to_dict() == want.groupby(c).size().to_dict()
        assert not g.duplicated(["author_id", "action_object"]).any()
        assert len(g.merge(want[["author_id", "action_object"]])) < 0.8 * len(want)


@pytest.mark.parametrize("how", ["curveball", "times"])
def test_replicates_tell_a_ring_from_chance(spark, how):
    rng = np.random.default_rng(2)
    rows = [(f"u{u}", f"o{o}", int(rng.integers(0, 10**6))) for u in range(30) for o in rng.choice(25, 6, replace=False)]
    rows += [(f"bot{b}", f"o{o}", 1000 * o + b) for b in range(4) for o in range(8)]
    t = spark.createDataFrame(rows, "author_id string, action_object string, s int").select("author_id", "action_object", F.timestamp_seconds("s").alias("created_at"))
    delta = 60 if how == "times" else None
    p = N.replicate_p_values(t, N.project(t, delta=delta), how, iterations=20, delta=delta).toPandas()
    bots = p[p["src"].str.startswith("bot") & p["dst"].str.startswith("bot")]
    others = p[~p.index.isin(bots.index)]
    assert len(bots) == 6 and bots["p_value"].max() <= 2 / 21
    assert not len(others) or others["p_value"].mean() > bots["p_value"].mean()
    with pytest.raises(ValueError):
        N.replicate_p_values(t, N.project(t), "other")


def test_anomaly_ranks_a_planted_oddity_first(spark):
    rng = np.random.default_rng(1)
    columns = [*accounts.ANOMALY]
    x = rng.normal(10, 1, (120, len(columns))).clip(1)
    x[7] = 400.0
    df = spark.createDataFrame(pd.DataFrame(x, columns=columns).assign(who=[f"a{i}" for i in range(120)]))
    got = accounts.anomaly(df, "who").toPandas().set_index("who")
    assert got["anomaly_score"].idxmax() == "a7" and got.loc["a7", "anomaly_rank"] == 1
    assert accounts.anomaly(df.limit(50), "who").where("anomaly_score is not null").count() == 0


def ring_edges(spark, groups=4, size=6):
    rows = [(f"g{g}m{i}", f"g{g}m{j}", 1.0) for g in range(groups) for i in range(size) for j in range(i + 1, size)]
    rows += [(f"g{g}m0", f"g{g + 1}m0", 0.2) for g in range(groups - 1)]
    return spark.createDataFrame(rows, "src string, dst string, weight double")


def test_communities_and_their_summary_find_planted_groups(spark):
    e = ring_edges(spark)
    members = N.communities(e, 0.3).toPandas()
    assert members.groupby(members["author_id"].str[:2])["cluster_id"].nunique().tolist() == [1] * 4 and members["cluster_id"].nunique() == 4
    s = N.cluster_summary(e, spark.createDataFrame(members)).toPandas()
    assert (s["size"] == 6).all() and (s["density"] == 1).all() and (s["internal_share"] > 0.9).all()
    sweep = N.resolution_sweep(e, [0.001, 0.3, 2.0]).toPandas().sort_values("resolution")
    assert sweep["n_clusters"].tolist()[:2] == [1, 4] and len(sweep) == 2  # at 2.0 no pair is worth a cluster


def test_random_subsets_flag_the_planted_cluster(spark):
    pool = spark.range(300).select(F.concat(F.lit("a"), F.col("id")).alias("author_id"), F.when(F.col("id") < 10, 1000.0).otherwise(F.col("id") % 50.0).alias("v"))
    members = spark.range(30).select(F.concat(F.lit("a"), F.col("id")).alias("author_id"), (F.col("id") >= 10).cast("int").alias("cluster_id"))
    got = {r["cluster_id"]: r["p_value"] for r in forensics.random_subsets(members, pool, "v", 99).collect()}
    assert got[0] == 0.01 and got[1] > 0.3
    drawn = forensics.drawn_groups(spark.createDataFrame([(0, 10), (1, 250)], "cluster_id int, size long"), pool, 5).toPandas()
    assert (drawn.groupby(["cluster_id", "draw"])["author_id"].nunique() == drawn.groupby(["cluster_id", "draw"]).size()).all()
    assert drawn.groupby("cluster_id").size().to_dict() == {0: 50, 1: 1250}


def test_validation_tells_planted_clusters_from_random_ones(spark):
    rng = np.random.default_rng(0)
    susp = spark.createDataFrame([(f"a{i}", 0.9 if i < 8 else float(rng.random()) * 0.4) for i in range(200)], "author_id string, suspicion double")
    v = rng.standard_normal((200, 16))
    v[:8] = v[0] + 0.05 * rng.standard_normal((8, 16))
    posts = spark.createDataFrame([(f"a{i}", [float(x) for x in r]) for i, r in enumerate(v)], "author_id string, vec array<double>")
    members = spark.createDataFrame([(f"a{i}", "ring") for i in range(8)] + [(f"a{i}", "none") for i in range(100, 108)] + [("a9", "small")], "author_id string, cluster_id string")
    got = {r["cluster_id"]: r for r in runs.internal_validation(members, susp, posts, draws=60).collect()}
    assert set(got) == {"ring", "none"} and got["ring"]["p_suspicion"] == got["ring"]["p_homogeneity"] == pytest.approx(1 / 61)
    assert got["none"]["p_suspicion"] > 0.03 and got["none"]["p_homogeneity"] > 0.03 and got["ring"]["suspicion_effect"] > 3


def test_a_run_finds_corroborated_rings_and_stores_counters_first(spark, tmp_path):
    t = N.inject(traces(spark, background()), 10, 6)
    other = t.withColumn("action_object", F.concat(F.lit("r"), "action_object"))
    store = Catalog(spark, f"file://{tmp_path}")
    out = runs.run({"co_retweet": t, "co_reply": other}, store)
    assert (out["n_clusters"], out["n_accounts"], out["n_corroborated_clusters"]) == (1, 10, 1)
    assert out["stored"][0] == "coordination/run_metrics" and out["stored"][-1] == "coordination/clusters" and not out["failed"]
    assert store.latest("coordination/clusters").count() == 10 and store.latest("coordination/edges", method="bonferroni").count() == 90
    m = {(r["channel"], r["metric"]): r["value"] for r in store.table("coordination/run_metrics").collect()}
    assert m["co_reply", "edges_bonferroni"] == 45 and m["all", "n_clusters"] == 1
    # A pass that finds nothing stores its counters and nothing else; a failing counter write loses nothing.
    empty = runs.run({"co_retweet": traces(spark, background(70, 200))}, Catalog(spark, f"file://{tmp_path}/none"))
    assert empty["n_clusters"] == 0 and empty["stored"] == ["coordination/run_metrics"]

    class Broken(Catalog):
        def append(self, name, *a, **k):
            if name.endswith("metrics"):
                raise OSError("no room")
            return super().append(name, *a, **k)

    again = runs.run({"co_retweet": t, "co_reply": other}, Broken(spark, f"file://{tmp_path}/b"))
    assert again["failed"] == ["coordination/run_metrics: no room"] and "coordination/clusters" in again["stored"]
    with pytest.raises(ValueError):
        runs.build_layers({"co_retweet": t}, method="other")
    assert "**weight**" in runs.glossary() and pytest.raises(ValueError, runs.glossary, ["unknown"])


def test_cluster_names_fall_back_to_channels_and_differ(spark):
    s = spark.createDataFrame([("a", 9, ["co_reply"]), ("b", 8, ["co_reply", "co_url"]), ("c", 7, []), ("d", 6, ["co_url"]), ("e", 5, ["co_url"]), ("f", 4, ["co_url"])], "cluster_id string, size int, channels array<string>")
    terms = spark.createDataFrame([(c, w, i + 1) for c, ws in (("d", "rain road town hill"), ("e", "rain road town lake")) for i, w in enumerate(ws.split())], "cluster_id string, term string, rank int")
    got = {r["cluster_id"]: r["name"] for r in runs.cluster_names(s, terms).collect()}
    assert got == {"a": "reply ring", "b": "several signals", "c": "cluster", "d": "rain road town", "e": "rain road town lake", "f": "common links"}


def test_shift_cohorts_match_all_pairs(spark):
    rng = np.random.default_rng(5)
    p = rng.dirichlet(np.ones(24), 60)
    p[10:16] = p[10] + rng.random((6, 24)) * 0.002
    p /= p.sum(axis=1, keepdims=True)
    rows = [(f"u{i:02d}", h, float(x)) for i, r in enumerate(p) for h, x in enumerate(r)]
    got = forensics.shift_cohorts(spark.createDataFrame(rows, "author_id string, hour int, p double"), 0.0, 0.12).collect()
    m = (p[:, None] + p[None]) / 2
    jsd = ((p[:, None] * np.log2(p[:, None] / m)) + (p[None] * np.log2(p[None] / m))).sum(axis=2) / 2
    linked = {i for i in range(60) for j in range(60) if i != j and jsd[i, j] <= 0.12}
    assert {r["author_id"] for r in got} == {f"u{i:02d}" for i in linked} and {f"u{i}" for i in range(10, 16)} <= {r["author_id"] for r in got}


def test_nearest_in_blocks_matches_brute_force(spark):
    v = np.random.default_rng(6).standard_normal((300, 8))
    rows = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "id long, vec array<double>")
    got = vectors.nearest(rows.where("id < 40"), rows, 5, block=16, rows_block=64).toPandas()
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    for q, g in got.groupby("query_id"):
        s = np.round(u @ u[q], 6)
        s[q] = -9
        assert sorted(g["id"]) == sorted(np.lexsort((np.arange(300), -s))[:5])
    assert len(got) == 200


def test_near_duplicates_match_plain_jaccard(spark):
    rng = np.random.default_rng(7)
    words = [f"word{i}" for i in range(300)]
    texts = [" ".join(rng.choice(words, 60)) for _ in range(25)]
    for i in range(12):
        w = texts[i].split()
        for _ in range(int(rng.integers(0, 8))):
            w[int(rng.integers(60))] = str(rng.choice(words))
        texts.append(" ".join(w))
    texts += ["", None, "short", "Short ", texts[0]]
    got = {r["k"]: r["cluster"] for r in neardup.clusters(spark.createDataFrame(list(enumerate(texts)), "k long, text string"), "k", "text").collect()}
    sets = [{low[j : j + 5] for j in range(max(1, len(low) - 4))} if (low := " ".join((t or "").lower().split())) else None for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.85:
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    assert [got[i] for i in range(len(texts))] == root and len(set(root)) < len(root) - 5


def test_topics_are_dense_regions_and_the_rest_is_noise(spark):
    rng = np.random.default_rng(8)
    c = rng.standard_normal((2, 12)) * 3
    v = np.vstack([c[0] + rng.standard_normal((30, 12)) * 0.4, c[1] + rng.standard_normal((20, 12)) * 0.4, rng.standard_normal((15, 12))])
    rows = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "id long, vec array<double>")
    got = ST.assign_topics(rows, 0.9, 10, 4).toPandas().set_index("id").sort_index()["topic"]
    assert set(got[:30]) == {0} and set(got[30:50]) == {1} and (got[50:] == -1).all()
    clusters = ST.content_clusters(rows, 0.9).toPandas()
    assert set(clusters["cluster_id"]) == {0, 30} and len(clusters) == 50


def test_census_arms(spark):
    from datetime import datetime, timedelta

    now = datetime(2024, 2, 1)
    base = {"platform": "x", "author_id": "a", "text": "t", "quoted_post_id": None, "quote_count": 0, "collected_at": now - timedelta(days=1), "created_at": now - timedelta(days=2)}
    rows = []
    for i, (oid, reposts, conv, replies) in enumerate([("hub", 5000, "big", 900), ("mid", 100, "m1", 40), ("low", 1, "s", 0), ("mid2", 50, "m2", 50), ("old", 80, "m3", 60)]):
        rows.append(base | {"platform_post_id": f"p{i}", "repost_of_id": oid, "repost_count": reposts, "conversation_id": conv, "reply_count": replies, "in_reply_to_id": "gone", "created_at": now - timedelta(days=30 if oid == "old" else 2)})
    posts = spark.createDataFrame([tuple(r.values()) for r in rows], "platform string, author_id string, text string, quoted_post_id string, quote_count long, collected_at timestamp, created_at timestamp, platform_post_id string, repost_of_id string, repost_count long, conversation_id string, reply_count long, in_reply_to_id string")
    eng = spark.createDataFrame([("mid", "z", "retweet", now - timedelta(hours=2)), ("hub", "z", "retweet", now - timedelta(days=9))], "platform_post_id string, platform_user_id string, kind string, collected_at timestamp")
    got = [(r["object_id"], r["worked"], r["in_band"], r["open"]) for r in ledgers.hot_reposts(posts, eng, str(now), 14, (5, 500), 24, 10).collect()]
    assert got == [("mid2", False, 2, 1), ("mid", True, 2, 1)]  # hub, single and old ones are out; the worked one is last and counted
    full = ledgers.hot_reposts(posts.where("repost_of_id = 'mid'"), eng, str(now), 14, (5, 500), 24, 10).collect()
    assert [(r["object_id"], r["in_band"], r["open"]) for r in full] == [("mid", 1, 0)]  # a band all worked still reports itself
    talk = ledgers.hot_conversations(posts, posts.where("conversation_id = 'm2'"), str(now), 14, (5, 500), 48, 1).collect()
    assert [(r["object_id"], r["in_band"], r["open"]) for r in talk] == [("m1", 2, 1)]
    refs = ledgers.to_hydrate(posts, eng, str(now), 14, 10).collect()
    assert [r["ref"] for r in refs][:2] == ["hub", "mid"] and refs[0]["censused"] and not refs[-1]["censused"]


def test_frontier_ledger(spark):
    day = lambda d: f"2024-01-{d:02d} 00:00:00"
    ledger = spark.createDataFrame([("a", "ha", day(1), 3, "ok", 0), ("b", "hb", day(30), 3, "ok", 0), ("c", "hc", day(1), 0, "failed", 3), ("d", "hd", day(1), 0, "failed", 1)], "author_id string, handle string, expanded_at string, n_posts long, status string, attempts int").withColumn("expanded_at", F.to_timestamp("expanded_at"))
    ranked = spark.createDataFrame([(x, i) for i, x in enumerate(["b", "c", "d", "new", None, "a"])], "author_id string, rank int")
    assert [r[0] for r in ledgers.frontier(ranked, ledger, day(31), 2, 7, 3).select("author_id").collect()] == ["d", "new"]
    after = {r["author_id"]: (r["status"], r["attempts"], r["handle"]) for r in ledgers.recorded(ledger, spark.createDataFrame([("d", "", 0, "failed"), ("c", "hc2", 2, "ok"), ("n", "hn", 1, "ok")], "author_id string, handle string, n_posts long, status string"), day(31)).collect()}
    assert after == {"a": ("ok", 0, "ha"), "b": ("ok", 0, "hb"), "c": ("ok", 0, "hc2"), "d": ("failed", 2, "hd"), "n": ("ok", 0, "hn")}
    assert ledgers.pruned(ledger, day(31), 5).count() == 1
    assert tuple(ledgers.frontier_summary(ledger, 3).first()) == (4, 2, 2, 1)
    pool = spark.createDataFrame([(f"u{i}", f"h{i}") for i in range(6)], "author_id string, handle string")
    tried = spark.createDataFrame([("u0", day(30)), ("u1", day(2))], "author_id string, attempted_at string").withColumn("attempted_at", F.to_timestamp("attempted_at"))
    picked, now = ledgers.discovered(pool, tried, day(31), 7, 3)
    ids = {r[0] for r in picked.select("author_id").collect()}
    assert len(ids) == 3 and "u0" not in ids and {r[0] for r in now.select("author_id").collect()} == ids | {"u0"}


def test_search_queries_and_windows(spark):
    q = lambda **k: spark.createDataFrame([("a OR b",)], "w string").select(R.search_query(F.col("w"), **k).alias("q")).first()["q"]
    assert q() == "(a OR b)" and q(anchors=["x", "y"], exclude=["z"], until=F.lit("2024-01-02")) == "(a OR b) (x OR y) -z until:2024-01-02"
    with pytest.raises(Exception, match="over the limit"):
        q(anchors=["x" * 600])
    w = [tuple(r) for r in R.backfill_windows(spark, "2024-02-01", 3, 20).collect()]
    assert w == [("2024-01-09", "2024-01-29"), ("2024-01-02", "2024-01-09")] and R.backfill_windows(spark, "2024-02-01", 30, 5).count() == 0
    assert [tuple(r) for r in R.recent_windows(spark, "2024-02-01", 2).orderBy("since").collect()] == [("2024-01-31", "2024-02-01"), ("2024-02-01", "2024-02-02")]


def test_texts_without_words_and_wrapped_ones(spark):
    d = spark.createDataFrame([(1, "a", None, 1), (2, "a", None, 2), (3, "b", None, 3), (4, "a", "Same ", 4), (5, "a", "same", 5)], "i int, author_id string, text string, s int").select(F.col("i").cast("string").alias("platform_post_id"), "author_id", "text", F.lit(False).alias("is_repost"), F.timestamp_seconds("s").alias("created_at"))
    assert sorted(r[0] for r in L.independent_voices(d).select("platform_post_id").collect()) == ["1", "3", "4"]  # one null text an author
    assert L.original(d).count() == 5
    x = spark.createDataFrame([("['one', 'two']",), ('"just this"',), ("plain  @Who text",)], "t string").select(T.clean(F.col("t")).alias("t"))
    assert [r[0] for r in x.collect()] == ["one two", "just this", "plain @user text"]


def test_labelling_tools(spark):
    a = spark.createDataFrame([("1", "hate"), ("2", "neither")], "post_id string, label string")
    with pytest.raises(ValueError, match="right"):
        LB.one_to_one(a, a.union(a), "post_id")
    rows = spark.createDataFrame([(str(i), "hate" if i % 4 == 0 else "neither", "train" if i < 80 else "gold") for i in range(100)], "post_id string, label string, split string")
    got = LB.rebuilt_splits(rows, "post_id", 20).groupBy("split", "label").count().toPandas().set_index(["split", "label"])["count"].to_dict()
    assert got == {("val", "hate"): 5, ("val", "neither"): 15, ("train", "hate"): 15, ("train", "neither"): 45, ("gold", "hate"): 5, ("gold", "neither"): 15}
    for bad, size in ((rows.withColumn("split", F.lit("other")), 5), (rows, 80)):
        with pytest.raises(ValueError):
            LB.rebuilt_splits(bad, "post_id", size)


def test_mined_candidates_keep_strata_caps_and_near_duplicates(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(200)]
    rows = [(f"p{i}", f"a{i % 7}", " ".join(rng.choice(words, 30)), float(rng.random()), float(rng.random()), ["mende"] if i < 5 else [], 0.9 if 5 <= i < 9 else 0.1, 0.5) for i in range(120)]
    rows.append(("copy", "z", rows[0][2] + "!", 0.01, 0.0, [], 0.1, 0.5))
    pool = spark.createDataFrame(rows, "platform_post_id string, author_handle string, text string, p_hate double, p_offensive double, lexicon_hits array<string>, menace double, criticism double")
    got = LB.mine_candidates(pool, {"nli_tail": 3, "p_hate_top": 10, "p_offensive_top": 10, "random_control": 200}, cap=6).toPandas()
    assert got["author_handle"].value_counts().max() <= 6 and "copy" not in set(got["platform_post_id"])
    assert (got["stratum"] == "lexicon").sum() == 5 and (got["stratum"] == "nli_tail").sum() == 3 and got["platform_post_id"].is_unique


def test_scoring_pass_takes_hits_first_and_fills_missing_scores(spark):
    posts = spark.createDataFrame([("x", f"p{i}", "mende here" if i == 0 else "plain words", i) for i in range(6)] + [("x", "blank", "  ", 9)], "platform string, platform_post_id string, text string, s int").withColumn("created_at", F.timestamp_seconds("s")).withColumn("collected_at", F.col("created_at"))
    done = posts.where("platform_post_id = 'p5'")
    out = scoring.incitement_pass(posts, done, lambda d: d.select("platform_post_id", F.lit(0.5).alias("othering_score")), limit=3).toPandas().set_index("platform_post_id")
    assert set(out.index) == {"p0", "p4", "p3"} and list(out.loc["p0", "lexicon_hits"]) == ["mende"] and out["violence_call_score"].isna().all()
    assert scoring.stance(posts, "MENDE", lambda d: d).count() == 1


def test_store_extras(spark, tmp_path):
    c = Catalog(spark, f"file://{tmp_path}")
    assert c.write_manifest(spark.createDataFrame([("term", "a", 3)], "target_type string, term string, n_posts int")) == 1
    assert c.write_manifest(spark.createDataFrame([], "target_type string, term string, n_posts int")) == 0
    assert c.write_census_run({}) == 1 and c.table("census_runs").first()["n_rows"] == 0
    assert "term" in c.columns("collection_runs") and c.columns("posts") == []
    assert c.register("mem", pd.DataFrame({"a": [1, 2]})).count() == 2 and spark.sql("select sum(a) from mem").first()[0] == 3
    card = spark.createDataFrame([(1, 0.9, "x"), (2, 0.1, "y")], "story_id long, story_suspicion_index double, unknown string")
    assert ST.persist_stories(c, card, least=0.5) == 1 and ST.persist_stories(c, card, least=2.0) == 0 and c.latest("stories").first()["story_id"] == 1
    for name, key in (("authors", "platform_user_id"), ("labels", "platform_post_id"), ("follows", "followed_id")):
        fields = {f.name for f in c.table(name).schema.fields}
        rows = spark.createDataFrame([("k", 1), ("k", 2)], f"{key} string, s int").withColumn("platform", F.lit("x"))
        order = next(o for o in ("collected_at", "labeled_at") if o in fields)
        c.append(name, rows.withColumn(order, F.timestamp_seconds("s")))
        assert c.latest(name).count() == 1 and c.latest(name).select(F.unix_seconds(order)).first()[0] == 2
    c.append("metrics", spark.createDataFrame([("a", 5), ("a", 1)], "platform_post_id string, s int").withColumn("platform", F.lit("x")).withColumn("collected_at", F.timestamp_seconds("s")))
    assert [r[0] for r in c.latest("metrics").select(F.unix_seconds("collected_at")).collect()] == [1, 5]  # a series: all rows, in order
    c.replace_state("due", spark.createDataFrame([("a",)], "k string"))
    broken = tmp_path / "state" / "due" / "version=99999999999999999999-x"
    broken.mkdir(parents=True)
    (broken / "part-0.parquet").write_bytes(b"half")
    assert [r[0] for r in c.state("due").collect()] == ["a"]  # a version without its mark is not there
    write_artifact(card, f"file://{tmp_path}/a", "parquet")
    assert spark.read.parquet(f"file://{tmp_path}/a").count() == 2 and pytest.raises(ValueError, write_artifact, card, "x", "xml")


def test_loop_isolates_failures_and_keeps_its_hours():
    now, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    work = iter([3, 0, 0, 0])
    jobs = iter([RuntimeError("down"), None, None])

    def refresh():
        e = next(jobs)
        if e:
            raise e

    def fails():
        raise ValueError("broken")

    log = passes.run_loop({"bad": fails, "good": lambda: next(work)}, 4, busy=5, idle=(60, 180), periodic={"clusters": (refresh, 6 * 3600, 100)}, sleep=sleep, clock=lambda: now[0], seed=1)
    assert [e["done"] for e in log] == [{"good": 3}, {"good": 0}, {"good": 0}, {"good": 0}] and all(e["failed"]["bad"] == "broken" for e in log)
    assert slept[0] == 5 and all(60 <= s <= 180 for s in slept[1:])
    assert log[0]["failed"]["clusters"] == "down" and not log[1]["ran"] and sum(len(e["ran"]) for e in log) == 1


def test_flushes_store_before_they_mark(spark):
    events = []

    def fetch(i):
        if i == 3:
            raise ValueError("gone")
        return spark.range(1).withColumn("item", F.lit(i))

    done, failed = passes.in_flushes(list(range(7)), fetch, lambda d: events.append(("stored", d.count())), lambda m: events.append(("marked", list(m))), every=2)
    assert done == 6 and failed == [(3, "gone")]
    assert events == [("stored", 2), ("marked", [0, 1]), ("stored", 2), ("marked", [2, 4]), ("stored", 2), ("marked", [5, 6])]

    def no_room(_):
        raise OSError("no room")

    marked = []
    with pytest.raises(OSError):
        passes.in_flushes([1, 2], fetch, no_room, marked.append, every=1)
    assert not marked


def test_ttl_ledger(spark):
    visits = spark.createDataFrame([("a", 0), ("a", 3600), ("b", 3600)], "k string, s int").withColumn("visited_at", F.timestamp_seconds("s"))
    items = spark.createDataFrame([("a", "fast"), ("b", "slow"), ("c", "slow"), ("d", "odd"), (None, "fast")], "k string, lane string")
    got = {r["k"] for r in passes.due_by_ttl(visits, items, "k", "1970-01-01 14:00:00", {"fast": 12, "slow": 72}).collect()}
    assert got == {"a", "c"}


def test_late_snapshots_do_not_undo_newer_ones(spark, tmp_path):
    def write(rows):
        spark.createDataFrame(rows, "platform_post_id string, type string, s int").withColumn("collected_at", F.timestamp_seconds("s")).write.mode("append").parquet(f"file://{tmp_path}/in")

    def step():
        stream = spark.readStream.schema("platform_post_id string, type string, s int, collected_at timestamp").parquet(f"file://{tmp_path}/in")
        out = passes.latest_state(stream).writeStream.option("checkpointLocation", f"file://{tmp_path}/cp").foreachBatch(lambda d, _: d.write.mode("append").parquet(f"file://{tmp_path}/out")).trigger(once=True).start()
        assert out.awaitTermination(60)

    write([("a", "one", 100), ("a", "zero", 50), ("b", "one", 10)])
    step()
    write([("a", "late", 70), ("b", "two", 20)])
    step()
    got = spark.read.parquet(f"file://{tmp_path}/out").toPandas()
    newest = got.sort_values("collected_us").groupby("platform_post_id").last()["type"].to_dict()
    assert newest == {"a": "one", "b": "two"} and "late" not in set(got["type"])


def test_reservoir_and_terms(spark):
    d = spark.range(500).withColumnRenamed("id", "e")
    one, two = ({r[0] for r in selection.reservoir(d.repartition(k), "e", 40, 1).collect()} for k in (2, 7))
    assert one == two and len(one) == 40 and max(one) > 300
    t = spark.createDataFrame([(["A", "b"],), (None,)], "x array<string>")
    assert {r[0] for r in selection.distinct_terms(t, t).collect()} == {"a", "b"}


def test_mining_stores_texts_of_taken_rows_only(spark, monkeypatch):
    rows = [(f"p{i}", f"a{i}", " ".join(str((i * 7919 + j * 104729) % 99991) for j in range(6)), i / 100, 1 - i / 100, ["mende"] if i < 5 else [], 0.1, 0.5) for i in range(60)]
    pool = spark.createDataFrame(rows, "platform_post_id string, author_handle string, text string, p_hate double, p_offensive double, lexicon_hits array<string>, menace double, criticism double")
    stored, plain = [], LB.O.checkpointed
    monkeypatch.setattr(LB.O, "checkpointed", lambda df: stored.append(df.columns) or plain(df))
    got = LB.mine_candidates(pool, {"nli_tail": 3, "p_hate_top": 4, "p_offensive_top": 4, "random_control": 4}, cap=6)
    assert got.count() == 17 and sum("text" in c for c in stored) == 2
