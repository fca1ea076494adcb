"""What goes through shuffles and files, and how much of it at once."""

import glob
import re

from tidemark.operators import accounts
from tidemark.plans import stored
from tidemark.plans.tables import AS_OF, Tables


def test_texts_stay_out_of_the_features_shuffles(spark):
    """the newest snapshots are found without their texts."""
    t = Tables(spark, "/root/testdata/sf0.001")
    posts = spark.createDataFrame(t.posts_raw.limit(50).collect(), t.posts_raw.schema)
    plan = accounts.author_features(t.authors_raw, posts, AS_OF)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window" in line or "Project" in line and "md5" in line]
    assert any("md5" in line for line in windows)
    assert not any(re.search(r"\btext#", line) for line in plan.splitlines() if "Window" in line or "Aggregate" in line)


def test_a_streams_batch_is_of_many_files(spark, monkeypatch):
    """no task has half of the table."""
    monkeypatch.setattr(stored, "FILE_ROWS", 10)
    made = []
    monkeypatch.setattr(stored, "_folder", lambda t, _own=stored._folder: made.append(_own(t)) or made[-1])
    t = Tables(spark, "/root/testdata/sf0.001")
    stored._streamed(t, spark.range(100).selectExpr("cast(id as string) as platform_post_id"))
    assert len(glob.glob(made[0].removeprefix("file://") + "/*.parquet")) >= 8
