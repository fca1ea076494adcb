"""The queries of this subpackage's operators over the synthetic tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import ann, capfilters, common, html, licenses, mixing, packing, pii, simhash, tokenfile, toxicity


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(common.read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op2_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.write_and_read(common.read(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=2)


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(common.read(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 20 == 0, top=20)


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(common.read(spark, sf_dir, "pages"))


def op5_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capfilters.link(common.read(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    chain = toxicity.train(docs, common.read(spark, sf_dir, "labels"))
    return toxicity.classify(docs, chain).select("doc_id", "p_low_quality", "p_toxic", "toxic")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(common.read(spark, sf_dir, "documents"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(common.read(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(common.read(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.Mix(common.read(spark, sf_dir, "documents")).rows()


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


#: The vectors that take part in comparisons, in double precision.
_VECTORS = """usable AS (
    SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
    WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
)"""

#: Brute force; the other queries' tokenizers, models, fingerprints and draws are beyond SQL.
SQL = {
    "op3_ann": f"""WITH {_VECTORS},
        scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS score
            FROM usable q JOIN usable c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
        ),
        ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM scored)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 20""",
    "op5_cap_filters": f"""WITH RECURSIVE {_VECTORS},
        link AS (SELECT a.vec_id AS src, b.vec_id AS dst FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.93),
        reach AS (SELECT vec_id, vec_id AS far FROM embeddings UNION SELECT r.vec_id, l.dst FROM reach r JOIN link l ON r.far = l.src),
        least AS (SELECT vec_id, min(far) AS component_id FROM reach GROUP BY vec_id),
        counted AS (SELECT src, count(*) AS n FROM link GROUP BY src)
        SELECT e.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, e.vec_id = component_id AS kept
        FROM embeddings e JOIN least USING (vec_id) LEFT JOIN counted ON src = e.vec_id""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
