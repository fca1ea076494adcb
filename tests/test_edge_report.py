from pyspark.sql import functions as F

from tidemark.plans.bindings import QUERIES, SQL
from tests.oracle import connect


def test_edge_report_counts_pairs_of_crowded_objects(spark, tmp_path):
    """Two objects of 120 accounts each are above the hub cap; all their pairs are reported (F23)."""
    spark.range(240).select((F.col("id") % 120).alias("l_suppkey"), F.floor(F.col("id") / 120).alias("l_partkey")).toPandas().to_parquet(f"{tmp_path}/lineitem.parquet")
    got = QUERIES["ag18_edge_report"](spark, str(tmp_path)).first().asDict()
    assert got["edges"] == 120 * 119 // 2
    want = connect(str(tmp_path)).execute(SQL["ag18_edge_report"]).df().iloc[0].to_dict()
    assert got == {k: int(v) for k, v in want.items()}


def test_edge_report_has_the_counts_of_validated_edges(spark, monkeypatch):
    """By object and in blocks, without a row per pair (F8)."""
    from tidemark.operators import coactions, network

    t = spark.range(400).select(F.concat(F.lit("s"), F.col("id") % 23).alias("author_id"), F.concat(F.lit("o"), (F.col("id") * F.col("id")) % 37).alias("action_object"), F.lit(None).cast("timestamp").alias("created_at"))
    e = network.validated_edges(t, capped=False).toPandas()
    want = {"edges": len(e), "bonferroni": e["sig_bonferroni"].sum(), "fdr": e["sig_fdr"].sum(), "pct": e["sig_percentile"].sum(), "fdr_and_pct": (e["sig_fdr"] & e["sig_percentile"]).sum()}
    assert network.edge_report(t).first().asDict() == want and want["edges"] > 20
    monkeypatch.setattr(coactions, "blocks_for", lambda *_: 0)  # so that pairs are counted in blocks
    monkeypatch.setattr(coactions, "pairs", lambda a, b, *rest, _own=coactions.pairs, **kw: _own(a, 3, *rest, **kw))
    assert network.edge_report(t).first().asDict() == want
