"""A training corpus from documents: drop toxic ones, keep one of each near-duplicate group, mask
personal data, mix sources to target weights, pack into sequences.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which
is written as Parquet and read again as the next one's docs. All but the last return the columns of
docs, those beyond COLUMNS untouched whatever their names.

Defined results, for every stage: an empty table gives no rows; null and empty texts are texts without
words, never an error; a null id, source, language or n_chars is kept as it is; texts of any length are
read whole; ties are broken by doc_id or by a fixed hash, so reruns agree.

    python corpus_pipeline.py <folder of tables> <folder for the result>
"""

from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common, mixing, packing, pii, simhash, toxicity
from tidemark.llm.queries import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _keeping(docs: DataFrame, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """work(docs) with the columns of docs; names beyond COLUMNS are out of the operators' way meanwhile."""
    others = {c: f"_kept{i}" for i, c in enumerate(docs.columns) if c not in COLUMNS}
    done = work(docs.select(*[F.col(f"`{c}`").alias(others.get(c, c)) for c in docs.columns]))
    return done.select(*[F.col(others.get(c, c)).alias(c) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not call toxic. It learns from the table labels.

    Rows that repeat are judged alike; a text without words gets the models' intercepts; without any
    labelled document nothing is called toxic.
    """
    labels = common.read(spark, sf_dir, "labels")

    def work(own: DataFrame) -> DataFrame:
        return toxicity.classify(own, toxicity.train(own, labels)).where(~F.col("toxic"))

    return _keeping(docs, work)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: the one with the smallest doc_id, a null id being the smallest.

    Rows that repeat are one component, of which one row stays; all texts without words are one component.
    """
    return _keeping(docs, simhash.deduplicate)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind in brackets and n_chars made to fit.

    A null text stays null, with its n_chars; of overlapping spans the first gives its name.
    """
    return _keeping(docs, lambda own: pii.find(own, redact=True))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per copy of a document that the mix takes: none, one or two.

    Documents without a source are one source, ordered last; texts without words have size 0 and may be
    taken or not; rows equal in id, source and text are taken alike.
    """
    return _keeping(docs, lambda own: mixing.Mix(own).documents())


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document, with its sequence and place there.

    A text without tokens is one piece of the end id alone; every row, repeated ones too, is packed once.
    """
    return packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("pii", mask_personal_data),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: Models, fingerprints and tokenizers are beyond SQL: tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Call common.sweep(spark) when the result is stored."""
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


def main(sf_dir: str, out: str) -> None:
    """Write the result of run() to out, then delete what the stages wrote."""
    from tidemark.session import session

    spark = session()
    try:
        run(spark, sf_dir).write.mode("overwrite").parquet(out)
    finally:
        common.sweep(spark)


if __name__ == "__main__":
    main(*sys.argv[1:3])
