"""Training-data pipeline over ``documents``: each stage calls one operator of wattflow.llm.

run(spark, sf_dir) applies the stages in order; every stage's result is written
to the folder that the cluster shares and reread as the next one's input.

In every stage a null text counts as empty and stays null where texts stay,
null ids and extra columns are kept, texts are read whole, and an empty table
gives an empty one.  Repeated rows are judged each, but near_duplicates keeps
one row of each group, so equal rows become one there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattflow.llm import bpe, decontaminate, secret_scan, simhash, toxicity
from wattflow.llm.common import cut
from wattflow.llm.queries import RANKS, public_tokenizers


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go; the model learns from the labelled ones of ``docs`` that are not held out.

    Empty texts have the base rate alone; without usable labels nothing goes.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.without_toxic(docs, toxicity.train(docs, labels))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one of the smallest id (null last; ties to the smallest row hash).

    All texts without words are one group.
    """
    return simhash.first_of_each_group(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated by passages of ``benchmark`` (those of a null id too) go."""
    return decontaminate.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"),
                                              null_ids=True)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by a mark and n_chars follows; other documents stay as they are."""
    return (secret_scan.masked(docs).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars"))
            .select(*docs.columns))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decodes): token ids, and whether they decode to the text."""
    return bpe.encode_documents(docs, RANKS, public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("byte_bpe", encode),
]
# a trained model, XXH64 fingerprints and BPE are beyond SQL: tested against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table: (doc_id, n_tokens, ids, decodes) of what is kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
