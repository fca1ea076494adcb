"""The pipeline against its stages done plainly, and its contract."""

import numpy as np
import pytest

import corpus_pipeline
from tests.llm.test_text import library, plain_components, plain_fingerprint
from tidemark.llm import common, mixing, queries, toxicity

SF = "/root/testdata/sf0.001"


def test_stages_in_order_and_columns(spark, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "pii", "mixing", "packing"]
    docs = common.read(spark, SF, "documents")
    seen = {r["doc_id"]: r for r in docs.collect()}
    made = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"file://{tmp_path}/{name}")
        docs = spark.read.parquet(f"file://{tmp_path}/{name}")
        made[name] = docs.collect()
        if name != "packing":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
    chain = toxicity.train(common.read(spark, SF, "documents"), common.read(spark, SF, "labels"))
    clean = {r["doc_id"] for r in toxicity.classify(common.read(spark, SF, "documents"), chain).where("not toxic").collect()}
    assert {r["doc_id"] for r in made["toxicity"]} == clean
    ids = sorted(clean)
    heads = plain_components([plain_fingerprint(seen[i]["text"]) for i in ids], ids)
    assert {r["doc_id"] for r in made["simhash_near_dedup"]} == {i for i, h in zip(ids, heads) if i == h}
    assert {r["doc_id"] for r in made["pii"]} == {r["doc_id"] for r in made["simhash_near_dedup"]}
    assert all(r["n_chars"] == len(r["text"]) for r in made["pii"])
    text = {r["doc_id"]: r["text"] for r in made["pii"]}
    assert not any("@mail" in t for t in text.values())
    assert all(r["text"] == text[r["doc_id"]] for r in made["mixing"])
    want = sum(len(library("byte_bpe_50k.json", r["text"])) + 1 for r in made["mixing"][:40])
    some = [r["doc_id"] for r in made["mixing"][:40]]
    lengths = {}
    for r in made["packing"]:
        lengths[r["doc_id"]] = lengths.get(r["doc_id"], 0) + r["length"]
    copies = {i: sum(r["doc_id"] == i for r in made["mixing"]) for i in some}
    assert sum(lengths[i] / copies[i] for i in some) == want


def test_registered_queries():
    names = list(queries.queries())
    assert sorted({int(n[2:].split("_")[0]) for n in names}) == list(range(1, 11)) and len(names) == 10
    assert np.isclose(mixing.WEIGHTS, (5, 2, 1)).all()


ODD = "doc_id long, text string, lang string, source string, n_chars long, toxic string, fp string, shard string, size string, _row string, component string"


def odd_docs(spark):
    words = [f"w{i}" for i in range(400)]
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(rng.choice(words, 30)), "en", "abc"[i % 3], 5, "t", f"f{i}", "s", "z", "r", "c") for i in range(40)]
    rows += rows[:2]  # repeated rows
    rows += [(50, None, None, None, None, None, None, None, None, None, None), (51, "", "en", "a", 0, None, "f", None, None, None, None), (52, " \n", "en", None, 2, None, None, None, None, None, None)]
    rows += [(None, "no id a@mail.org here", "en", "b", None, "x", None, None, None, None, None), (53, "very long text " * 20_000, "en", "c", 1, None, None, None, None, None, None), (54, "é" * 50_000, "fr", "", 1, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, ODD), rows


def tables(spark, tmp_path, docs, labels=()):
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    return f"file://{tmp_path}"


def test_every_stage_takes_odd_rows(spark, tmp_path):
    docs, rows = odd_docs(spark)
    sf = tables(spark, tmp_path, docs, [(i, 1, int(i < 3)) for i in range(30)])
    same = {(r[0], r[1], r[5], r[6]) for r in rows}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, sf)
        assert got.columns == docs.columns, name
        kept = got.collect()
        if name == "pii":
            assert len(kept) == len(rows) and [r["text"] for r in kept if r["doc_id"] is None] == ["no id [EMAIL] here"]
            assert {r["text"] for r in kept if r["doc_id"] == 50} == {None}
        else:  # other columns come through untouched
            assert kept and {(r["doc_id"], r["text"], r["toxic"], r["fp"]) for r in kept} <= same, name
        if name == "simhash_near_dedup":
            ids = [r["doc_id"] for r in kept]
            assert sorted(i for i in ids if i is not None) == [*range(40), 50, 53, 54] and ids.count(None) == 1
        if name == "mixing":
            assert all(sum(k["doc_id"] == i for k in kept) <= 2 * sum(r[0] == i for r in rows) for i in range(55))
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf).toPandas()
    firsts = packed[packed["piece"] == 0]
    assert len(firsts) == len(rows) and (packed[packed["doc_id"].isin([50, 51])]["length"] == 1).all()
    total = sum(len(library("byte_bpe_50k.json", r[1])) + 1 for r in rows)
    assert packed["length"].sum() == total


def test_empty_tables_give_no_rows(spark, tmp_path):
    docs, _ = odd_docs(spark)
    sf = tables(spark, tmp_path, docs.limit(0))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0
    assert corpus_pipeline.run(spark, sf).count() == 0
    assert corpus_pipeline.drop_toxic(spark, docs, sf).count() == docs.count()  # nothing is labelled


def test_whole_pipeline_on_odd_rows_and_sweep(spark, tmp_path):
    import os

    docs, _ = odd_docs(spark)
    sf = tables(spark, tmp_path, docs, [(i, 1, int(i < 3)) for i in range(30)])
    assert corpus_pipeline.run(spark, sf).groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").count() == 0
    shared = common.shared_dir(spark).removeprefix("file://")
    assert os.listdir(shared)
    common.sweep(spark)
    assert not os.listdir(shared)


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_every_query_runs_and_agrees_with_its_sql(spark, name):
    from tests.oracle import connect, rows

    got = queries.queries()[name](spark, SF).toPandas()
    con = connect()
    whole = con.execute("SELECT count(*) FROM documents").fetchone()[0]
    if name in queries.SQL:
        want = con.execute(queries.SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)
    elif name == "op4_html":
        assert len(got) == con.execute("SELECT count(*) FROM pages").fetchone()[0]
    elif name == "op8_licenses":
        assert len(got) > 0 and got["coverage"].between(0.8, 1).all()
    else:
        assert got["doc_id"].nunique() == whole and len(got) >= whole
