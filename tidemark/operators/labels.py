"""Label agreement, evaluation metrics, adjudication, provenance."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import order as O
from tidemark.functions import stats as S


def confusion(pairs: DataFrame, classes: Sequence[str]) -> DataFrame:
    """Counts of (a, b) over the full grid of classes."""
    spark = pairs.sparkSession
    one = spark.createDataFrame([(c,) for c in classes], "a string")
    grid = one.crossJoin(F.broadcast(one.withColumnRenamed("a", "b")))
    n = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    return grid.join(n, ["a", "b"], "left").na.fill(0, ["n"])


def agreement(pairs: DataFrame) -> DataFrame:
    """One row: n, share that agrees, Cohen's kappa. Expected agreement from the two margins."""
    n = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    left, right = n.groupBy("a").agg(F.sum("n").alias("x")), n.groupBy(F.col("b").alias("a")).agg(F.sum("n").alias("y"))
    total = n.agg(F.sum("n").alias("total"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    chance = left.join(right, "a").agg(F.sum(F.col("x").cast("double") * F.col("y")).alias("xy"))
    po, pe = F.col("same") / F.col("total"), F.col("xy") / (F.col("total").cast("double") * F.col("total"))
    return total.crossJoin(chance).select(F.col("total").alias("n"), po.alias("agree"), F.when(pe < 1, S.kappa(po, pe)).alias("kappa"))


def class_metrics(pairs: DataFrame) -> DataFrame:
    """Per class of the truth a or the guess b: precision, recall, F1 and support."""
    side = F.explode(F.array_distinct(F.array("a", "b"))).alias("label")
    x = pairs.select("a", "b", side)
    out = x.groupBy("label").agg(S.count_if((F.col("a") == F.col("label")) & (F.col("b") == F.col("label"))).alias("hit"), S.count_if(F.col("a") == F.col("label")).alias("support"), S.count_if(F.col("b") == F.col("label")).alias("guessed"))
    p, r = (F.coalesce(F.try_divide("hit", c), F.lit(0.0)) for c in ("guessed", "support"))
    f1 = F.coalesce(F.try_divide(2 * F.col("hit"), F.col("guessed") + F.col("support")), F.lit(0.0))
    return out.select("label", p.alias("precision"), r.alias("recall"), f1.alias("f1"), "support")


def threshold_sweep(scored: DataFrame, score: str, truth: str, thresholds: Sequence[float]) -> DataFrame:
    """Per threshold: flagged, precision and recall of score >= threshold."""
    t = scored.sparkSession.createDataFrame([(float(x),) for x in thresholds], "threshold double")
    x = scored.select(F.col(score).alias("s"), F.col(truth).alias("y")).crossJoin(F.broadcast(t))
    hit = F.col("s") >= F.col("threshold")
    out = x.groupBy("threshold").agg(S.count_if(hit).alias("flagged"), S.count_if(hit & F.col("y")).alias("k"), S.count_if(F.col("y")).alias("pos"))
    return out.select("threshold", "flagged", F.coalesce(F.try_divide("k", "flagged"), F.lit(0.0)).alias("precision"), F.coalesce(F.try_divide("k", "pos"), F.lit(0.0)).alias("recall"))


def best_threshold(sweep: DataFrame, recall: float = 0.80) -> DataFrame:
    return sweep.where(F.col("recall") >= recall).orderBy(F.desc("precision"), F.desc("threshold")).limit(1)


def majority(votes: list[Column], severity: Sequence[str]) -> Column:
    """The label of two votes or more of three, else the middle one in order of severity."""
    a, b, c = votes
    rank = F.create_map(*[F.lit(x) for i, s in enumerate(severity) for x in (s, i)])
    middle = F.element_at(F.array_sort(F.array(*[F.element_at(rank, v) for v in votes])), 2)
    return F.when((a == b) | (a == c), a).when(b == c, b).otherwise(F.element_at(F.array(*[F.lit(s) for s in severity]), middle + 1))


def merge_labellers(batch: DataFrame, one: DataFrame, two: DataFrame, key: str = "post_id") -> DataFrame:
    """batch with both labels, whether they agree, the union of flags, and whether it goes to a third vote."""
    a = one.select(key, F.col("label").alias("label_a"), F.col("flags").alias("flags_a"))
    b = two.select(key, F.col("label").alias("label_b"), F.col("flags").alias("flags_b"))
    out = batch.join(a, key).join(b, key)
    none = F.array().cast("array<string>")
    flags = F.array_sort(F.array_union(F.coalesce("flags_a", none), F.coalesce("flags_b", none)))
    return out.withColumn("agree", F.col("label_a") == F.col("label_b")).withColumn("flags", flags).withColumn("queued", ~F.col("agree")).drop("flags_a", "flags_b")


def adjudicate(merged: DataFrame, third: DataFrame, severity: Sequence[str], key: str = "post_id") -> DataFrame:
    out = merged.join(third.select(key, F.col("label").alias("label_c")), key, "left")
    voted = majority([F.col("label_a"), F.col("label_b"), F.col("label_c")], severity)
    return out.withColumn("final", F.when(F.col("agree"), F.col("label_a")).when(F.col("label_c").isNotNull(), voted))


def by_precedence(sources: Sequence[tuple[str, DataFrame]], key: str) -> DataFrame:
    """One label per key: that of the first source that has it; column source tells which."""
    every = reduce(DataFrame.unionByName, [d.select(key, "label").withColumn("source", F.lit(n)).withColumn("_p", F.lit(i)) for i, (n, d) in enumerate(sources)])
    w = Window.partitionBy(key).orderBy("_p", "label")
    return every.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_p")


def movement(before: DataFrame, after: DataFrame, key: str, classes: Sequence[str]) -> DataFrame:
    pairs = before.select(key, F.col("label").alias("a")).join(after.select(key, F.col("label").alias("b")), key)
    return confusion(pairs, classes)


def check_batch(df: DataFrame, required: Sequence[str], key: str, classes: Sequence[str]) -> None:
    """Raise unless df has the required columns, unique non-null keys and known labels only."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    bad = df.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(key).alias("k"), S.count_if(~F.coalesce(F.col("label").isin(*classes), F.lit(False))).alias("odd")).first()
    if bad["n"] != bad["k"]:
        raise ValueError(f"{key} is not unique or null")
    if bad["odd"]:
        raise ValueError(f"{bad['odd']} unknown labels")


def same_ids(a: DataFrame, b: DataFrame, key: str) -> bool:
    return a.join(b, key, "left_anti").isEmpty() and b.join(a, key, "left_anti").isEmpty()


def annotator_agreement(votes: DataFrame, columns: Sequence[str]) -> DataFrame:
    """votes with the share of the largest vote count and whether it is unanimous."""
    total = reduce(lambda x, y: x + y, [F.col(c) for c in columns])
    share = F.try_divide(F.greatest(*columns), total)
    return votes.withColumn("agreement", share).withColumn("unanimous", share == 1)


def one_to_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """left joined to right on a key that is unique in both, or an error that names a key which is not."""
    for side, d in (("left", left), ("right", right)):
        twice = d.groupBy(key).count().where("count > 1").orderBy(key).limit(1).collect()
        if twice:
            raise ValueError(f"{key} {twice[0][0]!r} is not unique in the {side} table")
    return left.join(right, key)


def in_pools(rows: DataFrame, pools: Sequence[tuple[str, Column]]) -> DataFrame:
    """rows with pool: the first of the named conditions that holds; rows of none are left out."""
    pool = reduce(lambda acc, p: acc.when(p[1], p[0]), pools[1:], F.when(pools[0][1], pools[0][0]))
    return rows.withColumn("pool", pool).where("pool is not null")


def two_labeller_pools(rows: DataFrame, a: str, b: str, target: str = "hate") -> DataFrame:
    """rows in pools by how two labellers agree on the target class; coded strata stand apart."""
    x, y = F.col(a), F.col(b)
    coded = F.col("stratum").isin("lexicon", "nli_tail")
    return in_pools(rows, [(f"only_{b}", (x != target) & (y == target)), (f"only_{a}", (x == target) & (y != target)), (f"agree_{target}", (x == y) & (x == target)), ("agree_coded", (x == y) & coded), ("agree", x == y)])


def pool_agreement(rows: DataFrame) -> DataFrame:
    """Per pool the rows with a consensus label, and the share on which the human agrees with it."""
    known = rows.where("label is not null and label <> ''")
    return known.groupBy("pool").agg(F.count(F.lit(1)).alias("n"), S.share(F.col("human_label") == F.col("label")).alias("agreement"))


def axis_errors(rows: DataFrame, target: str = "hate") -> DataFrame:
    """Rows with a consensus label on which human and consensus part over the target class: error is missed or over."""
    human, own = F.col("human_label") == target, F.col("label") == target
    known = rows.where("label is not null and label <> ''")
    return known.withColumn("error", F.when(human & ~own, "missed").when(own & ~human, "over")).where("error is not null")


def labeller_axis(rows: DataFrame, columns: Sequence[str], target: str = "hate") -> DataFrame:
    """Per labeller column its exact agreement with the human, and precision and recall of the target class."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("labeller"), F.col(c).alias("guess")) for c in columns])).alias("g")
    x = rows.select("human_label", each).select("human_label", "g.labeller", "g.guess")
    truth, guess = F.col("human_label") == target, F.col("guess") == target
    out = x.groupBy("labeller").agg(S.share(F.col("guess") == F.col("human_label")).alias("exact"), S.count_if(truth & guess).alias("hit"), S.count_if(truth & ~guess).alias("missed"), S.count_if(~truth & guess).alias("over"))
    ratio = lambda c: F.coalesce(F.try_divide(F.col("hit"), F.col("hit") + F.col(c)), F.lit(0.0))
    return out.withColumn("precision", ratio("over")).withColumn("recall", ratio("missed"))


def flag_metrics(rows: DataFrame, truth: str, guess: str, flags: Sequence[str]) -> DataFrame:
    """Per flag of two array columns: precision, recall, F1 and support."""
    each = F.explode(F.array(*[F.lit(f) for f in flags])).alias("flag")
    x = rows.select(truth, guess, each).select("flag", F.array_contains(truth, F.col("flag")).alias("t"), F.array_contains(guess, F.col("flag")).alias("g"))
    out = x.groupBy("flag").agg(S.count_if(F.col("t") & F.col("g")).alias("hit"), S.count_if(F.col("t")).alias("support"), S.count_if(F.col("g")).alias("guessed"))
    p, r = (F.coalesce(F.try_divide("hit", c), F.lit(0.0)) for c in ("guessed", "support"))
    f1 = F.coalesce(F.try_divide(2 * F.col("hit"), F.col("guessed") + F.col("support")), F.lit(0.0))
    return out.select("flag", p.alias("precision"), r.alias("recall"), f1.alias("f1"), "support")


def calibration(reference: DataFrame, labels: DataFrame, flags: Sequence[str], key: str = "post_id") -> dict[str, DataFrame]:
    """A labeller (label, flags) against a human reference (human_label, human_flags), one row a key on both sides.

    classes and flags are metrics, mismatches the rows that differ in the label or in any flag.
    """
    joined = one_to_one(reference, labels, key)
    pairs = joined.select(F.col("human_label").alias("a"), F.col("label").alias("b"))
    odd = (F.size(F.array_except("human_flags", "flags")) > 0) | (F.size(F.array_except("flags", "human_flags")) > 0)
    return {"classes": class_metrics(pairs), "flags": flag_metrics(joined, "human_flags", "flags", flags), "mismatches": joined.where((F.col("label") != F.col("human_label")) | odd)}


def rebuilt_splits(rows: DataFrame, key: str, val_size: int, seed: int = 0, allowed: Sequence[str] = ("train", "challenge", "gold")) -> DataFrame:
    """rows with new labels in the parts they were in; of the train part val_size rows become val, in proportion to labels.

    A row without a part, or in one nobody knows, is an error; so is a train part too small to give val_size.
    """
    from tidemark.operators import selection

    odd = rows.where(F.col("split").isNull() | ~F.col("split").isin(*allowed)).select(key).limit(1).collect()
    if odd:
        raise ValueError(f"{key} {odd[0][0]!r} has no known part")
    train = rows.where("split = 'train'")
    n = train.count()
    if n <= val_size:
        raise ValueError(f"{n} train rows cannot give {val_size}")
    quota = selection.quotas(train.groupBy("label").count(), "label", "count", val_size)
    placed = selection.placed(train, "label", key, seed).join(F.broadcast(quota.withColumnRenamed("label", "_l")), F.col("label") == F.col("_l"))
    moved = placed.where("_r < quota").select(key).withColumn("_val", F.lit(True))
    out = rows.join(moved, key, "left")
    return out.withColumn("split", F.when(F.col("_val"), "val").otherwise(F.col("split"))).drop("_val")


def mine_candidates(pool: DataFrame, quotas: dict[str, int], cap: int, seed: int = 0, menace: float = 0.85) -> DataFrame:
    """Posts to label, in strata of falling interest, without near-duplicates and with at most cap of an author.

    Strata in turn: all with a lexicon hit (lexicon), menace over criticism (nli_tail), the highest p_hate
    (p_hate_top), the highest p_offensive (p_offensive_top), others (random_control); a stratum takes its
    quota of what those before it left. Of near-duplicates the one of the first stratum stays, then of the
    highest p_hate. pool has platform_post_id, author_handle, text, p_hate, p_offensive, lexicon_hits,
    menace and criticism.
    """
    from tidemark.operators import neardup, selection

    key, shuffled = "platform_post_id", F.xxhash64(F.lit(seed), "platform_post_id")
    tail = F.coalesce((F.col("menace") >= menace) & (F.col("menace") > F.col("criticism")), F.lit(False))
    hit = F.coalesce(F.size("lexicon_hits") > 0, F.lit(False))
    strata = [("nli_tail", F.col("_tail"), [shuffled]), ("p_hate_top", F.lit(True), [F.desc("p_hate")]), ("p_offensive_top", F.lit(True), [F.desc("p_offensive")]), ("random_control", F.lit(True), [shuffled])]
    # Only rows that are taken are stored whole: those with a hit, and at last the few that quotas let in.
    taken = O.checkpointed(pool.where(hit).withColumn("stratum", F.lit("lexicon")).withColumn("_rank", F.lit(0)))
    left = pool.where(~hit).select(key, "p_hate", "p_offensive", tail.alias("_tail")).join(taken.select(key), key, "left_anti")
    left, few = O.checkpointed(left), None
    for rank, (name, condition, order) in enumerate(strata, 1):
        own = left if few is None else left.join(F.broadcast(few.select(key)), key, "left_anti")
        own = own.where(condition).orderBy(*order, key).limit(quotas.get(name, 0))
        own = O.checkpointed(own.select(key, F.lit(name).alias("stratum"), F.lit(rank).alias("_rank")))
        few = own if few is None else few.unionByName(own)
    rest = pool.join(F.broadcast(few.select(key)), key, "left_semi").join(F.broadcast(few), key)
    taken = O.checkpointed(taken.unionByName(rest))
    groups = neardup.clusters(taken, key, "text").withColumnRenamed("cluster", "_cluster")
    best = selection.capped(taken.join(groups, key), "_cluster", 1, "_rank", F.desc("p_hate"), key)
    return selection.capped(best, "author_handle", cap, "_rank", F.desc("p_hate"), key).drop("_rank", "_cluster")
