from pyspark.sql import functions as F

from tidemark.operators import evaluation as E
from tidemark.operators import forensics, ledgers, neardup


def test_near_duplicate_clusters(spark):
    base = "the quick brown fox jumps over the lazy dog and runs far away into the deep dark wood tonight"
    rows = [(1, base), (2, base + "!"), (3, base), (4, "something else altogether that shares no long run of letters"), (5, ""), (6, None)]
    got = {r["k"]: r["cluster"] for r in neardup.clusters(spark.createDataFrame(rows, "k long, text string"), "k", "text").collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6}


def test_first_drop_and_cut(spark):
    case = spark.createDataFrame([(0, "a"), (0, "b"), (1, "c"), (2, "d")], "case_id int, platform_post_id string")
    has = lambda *x: spark.createDataFrame([(i,) for i in x], "platform_post_id string")
    got = {r["case_id"]: r["dropped_at"] for r in E.first_drop(case, has("a", "b", "c"), has("a", "c"), has("a"), has("a"), has("a")).collect()}
    assert got == {0: None, 1: "clustering", 2: "presence"} and E.triage_cut(10) == 20 and E.triage_cut(1000) == 150


def test_names_are_told_apart(spark):
    terms = spark.createDataFrame([(1, "a", 1), (2, "a", 1)], "g int, term string, rank int")
    sizes = spark.createDataFrame([(1, 5), (2, 9), (3, 2)], "g int, size int")
    got = {r["g"]: r["name"] for r in E.names(terms, sizes, "g").collect()}
    assert got == {1: "a 2 (n=5)", 2: "a (n=9)", 3: "mixed (n=2)"}


def test_encoder_is_unit_and_deterministic(spark):
    d = spark.createDataFrame([("a", "some words here"), ("b", None)], "platform_post_id string, text string")
    one, two = (E.encode(d).orderBy("platform_post_id").collect() for _ in range(2))
    assert one == two and abs(sum(x * x for x in one[0]["embedding"]) - 1) < 1e-5 and not any(one[1]["embedding"])


def test_step_jumps_and_convergence(spark):
    curve = spark.createDataFrame([("a", t, v) for t, v in enumerate([0, 1, 2, 50, 51])], "k string, t int, v int")
    r = forensics.step_jumps(curve, "k", "t", "v", "t").first()
    assert r["at"] == 3 and abs(r["share"] - 48 / 51) < 1e-9
    f = spark.createDataFrame([("u", "x"), ("u", "x"), ("u", "y"), ("w", "x")], "author_id string, lens string")
    assert [(r["author_id"], r["lenses"]) for r in forensics.convergence(f).collect()] == [("u", "x,y")]


def test_rotation_prefers_the_never_searched(spark):
    t = spark.createDataFrame([("a", 1, 5), ("b", 1, None), ("c", 2, 1)], "term string, pool int, s int").withColumn("last_searched", F.timestamp_seconds("s"))
    assert {r["term"] for r in ledgers.rotation(t, 1).collect()} == {"b", "c"}
