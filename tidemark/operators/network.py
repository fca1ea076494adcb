"""Co-action networks: traces, hub cap, projection, null models, layers, clusters."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import stats as S
from tidemark.functions import text as T
from tidemark.functions.order import checkpointed, numbered, running
from tidemark.operators import coactions as coactions_of
from tidemark.operators import packed
from tidemark.operators.latest import latest

#: The defaults of the method.
HUB_FLOOR, HUB_SHARE, HUB_CEILING = 50, 0.05, 100
ALPHA, RESOLUTION, MIN_REPETITION = 0.01, 0.05, 2
DELTAS = {"fast_co_share": 300, "text_sim": 3600}
CHANNELS = ("co_retweet", "co_reply", "text_sim", "fast_co_share", "co_hashtag", "co_url", "co_mention")


def traces(posts: DataFrame, channel: str, engagements: DataFrame | None = None, content: DataFrame | None = None) -> DataFrame:
    """Distinct (author_id, action_object, created_at) of one channel.

    posts are the windowed latest posts. engagements adds known reposts without a time; content maps
    posts to near-duplicate clusters for text_sim.
    """

    def from_column(obj: Column) -> DataFrame:
        return posts.select("author_id", obj.alias("action_object"), "created_at")

    if channel in ("co_retweet", "fast_co_share"):
        out = from_column(F.col("repost_of_id"))
        if channel == "co_retweet" and engagements is not None:
            out = out.unionByName(engagement_traces(engagements, posts))
    elif channel == "co_reply":
        out = from_column(F.col("in_reply_to_id"))
    elif channel == "co_hashtag":
        out = from_column(F.explode(F.transform("hashtags", F.lower)))
    elif channel == "co_mention":
        out = from_column(F.explode(F.transform("mentions", F.lower)))
    elif channel == "co_url":
        out = posts.select("author_id", F.explode("urls").alias("u"), "created_at").select("author_id", T.url_key(F.col("u")).alias("action_object"), "created_at")
    elif channel == "text_sim":
        if content is None:
            raise ValueError("text_sim needs the content clusters")
        out = posts.join(content, "platform_post_id").select("author_id", F.concat(F.lit("c"), F.col("cluster_id").cast("string")).alias("action_object"), "created_at")
    else:
        raise ValueError(f"unknown channel {channel!r}, expected one of {CHANNELS}")
    return out.where("author_id is not null and action_object is not null").distinct()


def engagement_traces(engagements: DataFrame, posts: DataFrame) -> DataFrame:
    """Known reposts of the posts at hand. Their time is unknown, bounded by the post's own."""
    known = latest(engagements, ("platform", "platform_post_id", "platform_user_id", "kind"), "collected_at")
    known = known.where("kind = 'retweet'").join(posts.select("platform_post_id"), "platform_post_id", "left_semi")
    return known.select(F.col("platform_user_id").alias("author_id"), F.col("platform_post_id").alias("action_object"), F.lit(None).cast("timestamp").alias("created_at"))


def object_degrees(t: DataFrame) -> DataFrame:
    return t.select("action_object", "author_id").distinct().groupBy("action_object").agg(F.count(F.lit(1)).alias("n"))


def account_degrees(t: DataFrame) -> DataFrame:
    return t.select("author_id", "action_object").distinct().groupBy("author_id").agg(F.count(F.lit(1)).alias("n_objects"))


def without_hubs(t: DataFrame, floor: int = HUB_FLOOR, share: float = HUB_SHARE, ceiling: int = HUB_CEILING) -> DataFrame:
    """Traces on objects with no more distinct accounts than max(floor, min(share of all accounts, ceiling)).

    Bounds the pairs of one object, so that the projection cannot grow with the square of a crowd.
    """
    cap = t.agg(F.greatest(F.lit(floor), F.least(F.floor(F.countDistinct("author_id") * share), F.lit(ceiling))).alias("cap"))
    kept = object_degrees(t).crossJoin(F.broadcast(cap)).where("n <= cap").select("action_object")
    return t.join(kept, "action_object", "left_semi")


def project(t: DataFrame, delta: int | None = None, least: int = MIN_REPETITION, detail: bool = True) -> DataFrame:
    """Pairs of accounts (src < dst) by shared objects: weight, n_objects_shared, n_coactions, min_gap.

    weight counts shared objects, or co-actions within `delta` seconds where that is given. Without detail,
    which then needs delta, only src, dst and weight. Where actions meet many others, pairs are counted in
    blocks of accounts, and co-actions are neither shuffled nor stored; else the join is on the object, with
    delta also on slices of time delta long, neighbours included. Both are exact: the choice is by cost.
    """
    own = t.where("author_id is not null and action_object is not null")
    own = checkpointed(own.select("author_id", "action_object", "created_at"))
    actions, coactions, timed = _load(own, delta)
    blocks = coactions_of.blocks_for(actions, coactions)
    if coactions > 4 * blocks * actions:
        named = own.select(F.col("author_id").alias("a"), F.col("action_object").cast("string").alias("b"), _seconds().alias("at"))
        out = coactions_of.pairs(named, blocks, delta, least, detail)
    elif not timed:
        own = own.groupBy("author_id", "action_object").agg(F.count(F.lit(1)).alias("n"))
        met = _met(own, "n", F.col("src_n") * F.col("dst_n"))
        out = met.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n_objects_shared"), F.sum("x").alias("n_coactions")).withColumn("min_gap", F.lit(None).cast("double"))
    else:
        pairs = _meetings(own, ["action_object"], delta)
        # First per object, then over objects: the distinct count needs no second shuffle of co-actions.
        per_object = pairs.groupBy("src", "dst", "action_object").agg(F.count(F.lit(1)).alias("n"), F.min("gap").alias("gap"))
        out = per_object.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n_objects_shared"), F.sum("n").alias("n_coactions"), F.min("gap").alias("min_gap"))
    out = out.withColumn("weight", F.col("n_coactions" if delta else "n_objects_shared")).where(F.col("weight") >= least)
    return out.select("src", "dst", *(["n_objects_shared", "n_coactions", "min_gap"] if detail else []), "weight")


def _met(own: DataFrame, value: str, x: Column) -> DataFrame:
    """(src, dst, x) of accounts that meet on an object, a row an object, x of src_value and dst_value; dealt by pair.

    Dealt before any sum: an account pair seldom meets twice in a task, so sums in part before the shuffle
    would fill memory and disk and save nothing.
    """
    a, b = (own.select(F.col("author_id").alias(s), "action_object", F.col(value).alias(f"{s}_{value}")) for s in ("src", "dst"))
    return a.join(b, "action_object").where("src < dst").select("src", "dst", x.alias("x")).repartition("src", "dst")


def _seconds() -> Column:
    return F.unix_micros("created_at") / 1e6


def _load(t: DataFrame, delta: int | None) -> tuple[int, float, bool]:
    """Actions, about as many co-actions as they have (from the crowds of objects, or of their slices of time), and whether any has a time."""
    by = ["action_object"] + ([F.floor(_seconds() / delta).alias("_slot")] if delta else [])
    n = F.col("n").cast("double")
    crowds = t.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count("created_at").alias("t"))
    row = crowds.agg(F.sum("n").alias("rows"), F.sum(n * n if delta else n * (n - 1) / 2).alias("met"), F.sum("t").alias("timed")).first()
    return row["rows"] or 0, row["met"] or 0.0, bool(row["timed"])


def _meetings(t: DataFrame, on: list[str], delta: int | None) -> DataFrame:
    """(on, src, dst, gap) of actions that meet on the same values of on, within delta seconds if given; src < dst.

    With delta the join is also on slices of time delta long, neighbours included.
    """
    stamped = t.withColumn("at", _seconds())
    a, b = (stamped.select(F.col("author_id").alias(n), *on, F.col("at").alias(f"{n}_at")) for n in ("src", "dst"))
    if delta:
        slot = F.floor(F.col("src_at") / delta)
        a = a.withColumn("slot", F.explode(F.array(slot - 1, slot, slot + 1)))
        b = b.withColumn("slot", F.floor(F.col("dst_at") / delta))
    gap = F.abs(F.col("src_at") - F.col("dst_at"))
    pairs = a.join(b, [*on, "slot"] if delta else on).where("src < dst")
    return (pairs.where(gap <= delta) if delta else pairs).withColumn("gap", gap)


def tfidf_weights(t: DataFrame, capped: bool = True) -> DataFrame:
    """Cosine of accounts' objects weighted by ln(accounts / accounts on the object): src, dst, weight_tfidf.

    Crowded objects are left out first, as for every projection, and are worth little here anyway.
    """
    own = without_hubs(t) if capped else t
    own = own.select("author_id", "action_object").distinct()
    own = checkpointed(own)
    accounts = own.agg(F.countDistinct("author_id").alias("accounts"))
    rare = object_degrees(own).crossJoin(F.broadcast(accounts)).select("action_object", F.log(F.col("accounts") / F.col("n")).alias("w"))
    v = own.join(rare, "action_object")
    norms = v.groupBy("author_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = _met(v, "w", F.col("src_w") * F.col("dst_w")).groupBy("src", "dst").agg(F.sum("x").alias("dot"))
    left, right = (norms.select(F.col("author_id").alias(n), F.col("norm").alias(f"{n}_norm")) for n in ("src", "dst"))
    return dots.join(left, "src").join(right, "dst").select("src", "dst", F.try_divide("dot", F.col("src_norm") * F.col("dst_norm")).alias("weight_tfidf"))


def with_p_values(edges: DataFrame, t: DataFrame, uniform: bool = False) -> DataFrame:
    """edges with p_value of sharing so many objects: Poisson with both degrees, or hypergeometric if uniform."""
    own = account_degrees(t)
    left, right = (own.select(F.col("author_id").alias(n), F.col("n_objects").alias(f"{n}_n")) for n in ("src", "dst"))
    totals = object_degrees(t).agg(F.count(F.lit(1)).alias("objects"), F.sum("n").alias("total"), F.sum(F.col("n").cast("double") * F.col("n")).alias("squares"))
    out = edges.join(left, "src").join(right, "dst").crossJoin(F.broadcast(totals))
    if uniform:
        p = S.hypergeometric_tail(F.col("n_objects_shared"), F.col("objects"), F.col("src_n"), F.col("dst_n"))
    else:
        p = S.poisson_tail(F.col("n_objects_shared"), F.col("src_n") * F.col("dst_n") * F.col("squares") / (F.col("total").cast("double") * F.col("total")))
    return out.withColumn("p_value", p).drop("src_n", "dst_n", "objects", "total", "squares")


def validated_edges(t: DataFrame, delta: int | None = None, alpha: float = ALPHA, quantile: float = 0.95, capped: bool = True) -> DataFrame:
    """Projected pairs with p_value, p_uniform and the flags sig_bonferroni, sig_fdr and sig_percentile.

    Traces and edges are stored once: degrees, both nulls, the quantile and the ranks read them.
    """
    t = checkpointed(without_hubs(t) if capped else t)
    edges = checkpointed(with_p_values(with_p_values(project(t, delta), t, uniform=True).withColumnRenamed("p_value", "p_uniform"), t))
    m = edges.agg(F.count(F.lit(1)).alias("_m"), F.expr(f"percentile(weight, {quantile})").alias("_q"))
    edges = edges.crossJoin(F.broadcast(m)).withColumn("sig_bonferroni", F.col("p_value") < F.lit(alpha) / F.col("_m")).withColumn("sig_percentile", F.col("weight") >= F.col("_q")).drop("_m", "_q")
    return S.benjamini_hochberg(edges, "p_value", "sig_fdr", alpha)


def edge_report(t: DataFrame, alpha: float = ALPHA, quantile: float = 0.95, least: int = MIN_REPETITION) -> DataFrame:
    """One row: edges, bonferroni, fdr, pct, fdr_and_pct: how many pairs validated_edges(capped=False) flags.

    A pair's flags depend only on its weight and on the product of its accounts' degrees, so tasks count
    their pairs by these two, and no pair is ever a row. Accounts are numbered by degree: a number tells it.
    """
    own = checkpointed(t.where("author_id is not null and action_object is not null").select("author_id", "action_object").distinct())
    degrees = numbered(own.groupBy("author_id").agg(F.count(F.lit(1)).alias("n")), "n", "author_id", out="a")
    degrees = checkpointed(degrees)
    first = degrees.groupBy("n").agg(F.min("a").alias("a")).orderBy("n").toPandas()  # a row per degree that occurs
    bounds, values = first["a"].to_numpy(np.int64), first["n"].to_numpy(np.int64)
    totals = own.groupBy("action_object").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("total"), F.sum(F.col("n").cast("double") * F.col("n")).alias("squares"), F.sum(F.col("n").cast("double") * (F.col("n") - 1) / 2).alias("met")).first()
    actions = own.join(degrees.select("author_id", "a"), "author_id").select("a", F.col("action_object").alias("b"))

    def tally(batches):
        seen: dict[tuple[int, int], int] = {}
        for batch in batches:
            src, dst, x = (batch.column(c).to_numpy() for c in ("src", "dst", "n_objects_shared"))
            product = values[np.searchsorted(bounds, src, "right") - 1] * values[np.searchsorted(bounds, dst, "right") - 1]
            order = np.lexsort((product, x))
            x, product = x[order], product[order]
            s = coactions_of._runs(x, product)
            for key, n in zip(zip(x[s].tolist(), product[s].tolist()), np.diff(np.append(s, len(x))).tolist()):
                seen[key] = seen.get(key, 0) + n
        if seen:
            cols = [[k[0] for k in seen], [k[1] for k in seen], list(seen.values())]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["weight", "product", "n"])

    then = tally, "weight long, product long, n long"
    count, met = totals["total"] or 0, totals["met"] or 0.0
    blocks = coactions_of.blocks_for(count, met)
    if met > 40 * blocks * count:
        found = coactions_of.pairs(actions.withColumn("b", F.col("b").cast("string")).withColumn("at", F.lit(None).cast("double")), blocks, None, least, then=then)
    else:
        found = coactions_of.tallied_by_object(actions, int(values.size and degrees.count()), met, least, then)
    kinds = checkpointed(found.groupBy("weight", "product").agg(F.sum("n").alias("n")))
    p = S.poisson_tail(F.col("weight"), F.col("product") * F.lit(totals["squares"] or 0.0) / (F.lit(float(count)) * F.lit(count)))
    kinds = checkpointed(kinds.withColumn("p_value", p))
    m = kinds.agg(F.sum("n").alias("_m"), F.expr(f"percentile(weight, {quantile}, n)").alias("_q"))
    ranks = checkpointed(kinds.where("p_value is not null").groupBy("p_value").agg(F.sum("n").alias("_n")))
    ranked = running(ranks, "p_value", "_n", "_upto").crossJoin(F.broadcast(m))
    cut = ranked.where(F.col("p_value") <= F.col("_upto") * alpha / F.col("_m")).agg(F.max("p_value").alias("_cut"))
    flags = kinds.crossJoin(F.broadcast(m)).crossJoin(F.broadcast(cut))
    fdr, pct = F.coalesce(F.col("p_value") <= F.col("_cut"), F.lit(False)), F.col("weight") >= F.col("_q")
    counted = {"edges": F.lit(True), "bonferroni": F.col("p_value") < F.lit(alpha) / F.col("_m"), "fdr": fdr, "pct": pct, "fdr_and_pct": fdr & pct}
    return flags.agg(*[F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long").alias(name) for name, c in counted.items()])


def channel_counters(t: DataFrame) -> DataFrame:
    """One row: accounts, objects, traces, and what the hub cap and pairing leave of them."""
    own = t.select("author_id", "action_object").distinct().join(object_degrees(t), "action_object")
    cap = t.agg(F.greatest(F.lit(HUB_FLOOR), F.least(F.floor(F.countDistinct("author_id") * HUB_SHARE), F.lit(HUB_CEILING))).alias("cap"))
    own = own.crossJoin(F.broadcast(cap))
    free, pairable = F.col("n") <= F.col("cap"), (F.col("n") >= 2) & (F.col("n") <= F.col("cap"))
    return own.agg(
        F.countDistinct("author_id").alias("accounts_all"),
        F.countDistinct("action_object").alias("objects_all"),
        F.countDistinct(F.when(~free, F.col("action_object"))).alias("hub_objects"),
        F.countDistinct(F.when(free, F.col("action_object"))).alias("objects_nohub"),
        F.countDistinct(F.when(pairable, F.col("author_id"))).alias("accounts_pairable"),
        F.count(F.lit(1)).alias("traces_all"),
        S.count_if(free).alias("traces_nohub"),
    )


def aggregate_layers(layers: DataFrame, norm: str = "max") -> DataFrame:
    """Layers (channel, src, dst, weight, min_gap) as one weighted graph: weight, min_gap, channels, n_channels."""
    if norm not in ("max", "mass"):
        raise ValueError(f"unknown normalisation {norm!r}")
    scale = layers.groupBy("channel").agg((F.max("weight") if norm == "max" else F.sum("weight")).alias("_scale"))
    scaled = layers.join(F.broadcast(scale), "channel").withColumn("w", F.col("weight") / F.col("_scale"))
    own = F.array_sort(F.collect_set("channel"))
    return scaled.groupBy("src", "dst").agg(F.sum("w").alias("weight"), F.min("min_gap").alias("min_gap"), own.alias("channels"), F.size(own).alias("n_channels"))


def communities(edges: DataFrame | packed.Packed, resolution: float = RESOLUTION) -> DataFrame:
    """(author_id, cluster_id) under the constant Potts model, singletons left out.

    Such communities never span connected components, so each component is optimised on its own, by
    moves, refinement and merging (see graphs.potts): in one task, or where it has over packed.ALONE edges
    by rounds over blocks of it (see packed.potts). Edges are packed as they are read, and stored so.
    """
    return packed.communities(_packed(edges), [resolution])[0]


def _packed(edges: DataFrame | packed.Packed) -> packed.Packed:
    return edges if isinstance(edges, packed.Packed) else packed.pack(edges)


def resolution_sweep(edges: DataFrame | packed.Packed, resolutions: list[float]) -> DataFrame:
    """Clusters and clustered accounts at each resolution."""
    runs = [found.withColumn("resolution", F.lit(g)) for g, found in zip(resolutions, packed.communities(_packed(edges), resolutions))]
    return reduce(DataFrame.unionByName, runs).groupBy("resolution").agg(F.countDistinct("cluster_id").alias("n_clusters"), F.count(F.lit(1)).alias("n_accounts"))


def cluster_summary(edges: DataFrame | packed.Packed, members: DataFrame, least: int = 3) -> DataFrame:
    """Per cluster its size, internal pairs and weight, density, and share of its accounts' weight that is internal."""
    # Edges are read once: what follows needs only their sums between clusters.
    if isinstance(edges, packed.Packed):
        members = checkpointed(members)
        sums = packed.between(edges, members)
    else:
        a, b = (members.select(F.col("author_id").alias(n), F.col("cluster_id").alias(f"{n}_c")) for n in ("src", "dst"))
        sums = edges.join(a, "src").join(b, "dst").groupBy("src_c", "dst_c").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight"))
    between = checkpointed(sums)
    inner = between.where("src_c = dst_c").select(F.col("src_c").alias("cluster_id"), F.col("n").alias("internal_edges"), F.col("weight").alias("internal_weight"))
    ends = between.select(F.explode(F.array("src_c", "dst_c")).alias("cluster_id"), "weight").groupBy("cluster_id").agg(F.sum("weight").alias("w"))
    size = members.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= least)
    out = size.join(inner, "cluster_id", "left").join(ends, "cluster_id", "left")
    pairs = F.col("size") * (F.col("size") - 1) / 2
    return out.select("cluster_id", "size", F.coalesce("internal_edges", F.lit(0)).alias("internal_edges"), F.coalesce(F.try_divide(F.coalesce("internal_edges", F.lit(0)), pairs), F.lit(0.0)).alias("density"), F.coalesce(2 * F.col("internal_weight") / F.col("w"), F.lit(0.0)).alias("internal_share"))


def traded(t: DataFrame, iterations: int, rounds: int = 10, seed: int = 0) -> DataFrame:
    """(rep, author_id, action_object): replicates of the distinct traces that keep every account's and object's degree.

    In each round of each replicate the accounts meet in random pairs, and each pair deals what only one of
    them has anew between them, as many to each as before. rounds * accounts / 2 trades a replicate, all in
    parallel; accounts are paired within hash buckets, so no task orders all of them.
    """
    own = t.select("author_id", "action_object").distinct()
    n = own.select("author_id").distinct().count()
    buckets = max(1, n // 512)
    now = checkpointed(own.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1)))))
    people = checkpointed(now.select("rep", "author_id").distinct())
    for r in range(rounds):
        key = F.xxhash64(F.lit(seed), F.lit(r), "rep", "author_id")
        dealt = people.select("rep", "author_id", key.alias("_h"), F.pmod(F.xxhash64(F.lit(seed), F.lit(-r - 1), "rep", "author_id"), F.lit(buckets)).alias("_b"))
        place = F.row_number().over(Window.partitionBy("rep", "_b").orderBy("_h", "author_id")) - 1
        met = dealt.select("rep", "author_id", "_b", F.floor(place / 2).alias("_p"), (place % 2).alias("_side"))
        held = now.join(met, ["rep", "author_id"])
        # What both have stays; the rest is dealt anew. A pair's objects are one account's or the other's.
        pair = Window.partitionBy("rep", "_b", "_p")
        held = held.withColumn("_both", F.count(F.lit(1)).over(Window.partitionBy("rep", "_b", "_p", "action_object")) == 2)
        names = held.groupBy("rep", "_b", "_p").agg(F.max(F.when(F.col("_side") == 0, F.col("author_id"))).alias("_first"), F.max(F.when(F.col("_side") == 1, F.col("author_id"))).alias("_second"), F.count(F.when(~F.col("_both") & (F.col("_side") == 0), 1)).alias("_keep"))
        loose = held.where(~F.col("_both")).withColumn("_r", F.row_number().over(pair.orderBy(F.xxhash64(F.lit(seed), F.lit(r), "rep", "action_object"), "action_object")))
        loose = loose.drop("author_id").join(names, ["rep", "_b", "_p"])
        loose = loose.select("rep", F.when(F.col("_r") <= F.col("_keep"), F.col("_first")).otherwise(F.coalesce("_second", "_first")).alias("author_id"), "action_object")
        now = checkpointed(held.where("_both").select("rep", "author_id", "action_object").unionByName(loose))
    return now


def replicate_p_values(t: DataFrame, edges: DataFrame, how: str, iterations: int = 100, seed: int = 0, delta: int | None = None) -> DataFrame:
    """edges with an empirical p_value = (1 + exceedances) / (1 + iterations) against random traces.

    how = "curveball": trades of objects between accounts, which keep both kinds of degree. how =
    "times": each account's times are dealt anew among its own actions. All replicates are rows of one
    table; nothing of the traces or edges reaches the driver.
    """
    if how not in ("times", "curveball"):
        raise ValueError(f"unknown null model {how!r}")
    edges = checkpointed(edges)
    own = checkpointed(t.where("author_id is not null and action_object is not null").select("author_id", "action_object", "created_at"))
    named = [F.col("author_id").alias("a"), F.col("action_object").alias("b"), _seconds().alias("at")]
    actions, coactions, _ = _load(own, delta)
    blocks = coactions_of.blocks_for(actions, coactions, edges.count())
    if how == "times":
        acts = own.select(*named, F.xxhash64(F.lit(seed), "author_id", "action_object", "created_at").alias("h"))
        exceed = coactions_of.exceedances(acts, edges.select("src", "dst", "weight"), blocks, delta, redealt=iterations)
    else:
        random = traded(own, iterations, seed=seed).withColumn("created_at", F.lit(None).cast("timestamp"))
        exceed = coactions_of.exceedances(random.select(*named, "rep"), edges.select("src", "dst", "weight"), blocks, None)
    return edges.join(exceed, ["src", "dst"], "left").withColumn("p_value", (1 + F.coalesce("exceed", F.lit(0))) / (1 + F.lit(iterations))).drop("exceed")


def inject(t: DataFrame, accounts: int, objects: int) -> DataFrame:
    """t with a planted ring: `accounts` accounts that all act on `objects` objects of their own."""
    spark = t.sparkSession
    a = spark.range(accounts).select(F.concat(F.lit("planted_"), F.col("id").cast("string")).alias("author_id"))
    o = spark.range(objects).select(F.concat(F.lit("planted_object_"), F.col("id").cast("string")).alias("action_object"))
    ring = a.crossJoin(F.broadcast(o)).withColumn("created_at", F.lit(None).cast("timestamp"))
    return t.select("author_id", "action_object", "created_at").unionByName(ring)


def recovery(edges: DataFrame, flag: str) -> DataFrame:
    """Precision, recall and F1 of planted pairs among the flagged ones."""
    planted = F.col("src").startswith("planted_") & F.col("dst").startswith("planted_")
    out = edges.agg(S.count_if(F.col(flag) & planted).alias("hit"), S.count_if(F.col(flag)).alias("flagged"), S.count_if(planted).alias("planted"))
    p, r = F.coalesce(F.try_divide("hit", "flagged"), F.lit(0.0)), F.coalesce(F.try_divide("hit", "planted"), F.lit(0.0))
    return out.select(p.alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1"))


def shuffled(t: DataFrame, seed: int = 0, what: str = "object") -> DataFrame:
    """Traces with objects, or times, dealt anew over the same accounts: both degrees stay (up to repeats)."""
    if what not in ("object", "time"):
        raise ValueError(f"cannot deal {what!r} anew, expected object or time")
    rows = t.select("author_id", "action_object").distinct() if what == "object" else t.select("author_id", "action_object", "created_at")
    names = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns]
    n = max(1, rows.count() // 4096)
    own = rows.withColumn("_b", F.pmod(F.xxhash64(*names, F.lit(seed)), F.lit(n)))
    w = Window.partitionBy("_b")
    order = names if what == "time" else [F.col("author_id"), F.col("action_object")]
    moved = "action_object" if what == "object" else "created_at"
    stay = [c for c in rows.columns if c != moved]
    a = own.select("_b", *stay, F.row_number().over(w.orderBy(*order)).alias("_k"))
    b = own.select("_b", moved, F.row_number().over(w.orderBy(F.xxhash64(*reversed(names), F.lit(seed + 1)), *order)).alias("_k"))
    out = a.join(b, ["_b", "_k"])
    return out.select("author_id", "action_object", F.lit(None).cast("timestamp").alias("created_at") if what == "object" else "created_at").distinct()
