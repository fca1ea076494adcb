import pytest
from pyspark.sql import functions as F

from tidemark.sources.catalog import Catalog, read_csv, read_jsonl, read_yaml, write_csv
from tidemark.streaming import passes


def posts(spark, rows):
    return spark.createDataFrame(rows, "platform_post_id string, text string, s int").select("platform_post_id", "text", F.lit("x").alias("platform"), F.lit("search").alias("type"), F.timestamp_seconds("s").alias("collected_at"), F.timestamp_seconds("s").alias("created_at"))


def test_catalog_round_trip(spark, tmp_path):
    c = Catalog(spark, f"file://{tmp_path}")
    assert c.table("posts").count() == 0 and c.healthy()
    assert c.append("posts", posts(spark, [("a", "one", 0), ("b", "two", 0)])) == 2
    assert c.append("posts", posts(spark, [("a", "newer", 90000)])) == 1
    assert c.append("posts", posts(spark, []).limit(0)) == 0
    assert c.table("posts").count() == 3 and c.latest("posts").where("platform_post_id = 'a'").first()["text"] == "newer"
    assert c.table("posts", type="hate_search").count() == 0
    assert c.query("SELECT count(*) FROM posts").first()[0] == 3
    with pytest.raises(ValueError):
        c.table("posts", colour="red")
    with pytest.raises(ValueError):
        c.table("nothing")
    plan = c.table("posts", type="search")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(type" in plan


def test_state_versions(spark, tmp_path):
    c = Catalog(spark, f"file://{tmp_path}")
    assert c.state("due") is None
    c.replace_state("due", spark.createDataFrame([("a",)], "k string"))
    c.replace_state("due", spark.createDataFrame([("b",)], "k string"))
    assert [r[0] for r in c.state("due").collect()] == ["b"]


def test_files(spark, tmp_path):
    write_csv(spark.createDataFrame([(1, "a")], "i int, s string"), f"file://{tmp_path}/c")
    assert read_csv(spark, f"file://{tmp_path}/c", "i int, s string").collect()[0]["s"] == "a"
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "1.jsonl").write_text('{"id": "a", "label": "x"}\n{"id": "b", "label": "y"}\n')
    (tmp_path / "j" / "2.jsonl").write_text('{"id": "a", "label": "z"}\n')
    got = {r["id"]: r["label"] for r in read_jsonl(spark, f"file://{tmp_path}/j", "id string, label string", "id").collect()}
    assert got == {"a": "z", "b": "y"}
    with pytest.raises(ValueError):
        read_jsonl(spark, f"file://{tmp_path}/j", "id string, label string", "id", strict=True)
    (tmp_path / "r.yaml").write_text("x:\n  accounts:\n    - One\n    - two\n  n: 3\n")
    assert read_yaml(str(tmp_path / "r.yaml"))["x"]["accounts"] == ["One", "two"]


def test_streaming_pass_scores_each_post_once(spark, tmp_path):
    c = Catalog(spark, f"file://{tmp_path}/store")
    src = tmp_path / "in"
    posts(spark, [("a", "one", 0), ("b", " ", 0), ("c", "three", 0)]).write.parquet(f"file://{src}")

    def run():
        stream = spark.readStream.schema(posts(spark, []).limit(0).schema).parquet(f"file://{src}")
        done = lambda: c.table("hatespeech")
        score = lambda df: df.select("platform_post_id", F.lit("neither").alias("label"), F.lit("x").alias("platform"), F.current_timestamp().alias("scored_at"))
        passes.score_new(stream, done, score, lambda df: c.append("hatespeech", df), f"file://{tmp_path}/cp").awaitTermination(120)

    run()
    posts(spark, [("a", "one", 5), ("d", "four", 5)]).write.mode("append").parquet(f"file://{src}")
    run()
    assert sorted(r[0] for r in c.table("hatespeech").select("platform_post_id").collect()) == ["a", "c", "d"]


def test_streaming_windows(spark, tmp_path):
    posts(spark, [("a", "x", 10), ("b", "x", 20), ("c", "x", 4000)]).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(posts(spark, []).limit(0).schema).parquet(f"file://{tmp_path}/in")
    q = passes.hourly_counts(stream).writeStream.outputMode("complete").format("memory").queryName("hours").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r["n"] for r in spark.sql("SELECT n FROM hours").collect()) == [1, 2]
