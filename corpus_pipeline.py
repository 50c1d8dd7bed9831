"""Documents to packed training sequences: the stages in order, each written and read again.

1. toxicity: documents that the string-kernel machine rejects go
2. near duplicates: of each class the document with the smallest id stays
3. benchmark decontamination: documents that leak a benchmark item go
4. personal data: spans in the text are replaced by their kind in brackets
5. packing: token pieces of the remaining texts, placed in sequences of at most 2048 tokens

Clean documents pass every stage; stages 1 to 4 return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from cohortwise.llm import decontaminate, near_dups, packing, pii, toxicity
from cohortwise.llm.common import materialise, settle, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The machine learns from the stage's own documents and the labels, fold 1 left out as in its query."""
    settle(spark)
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    settle(spark)
    return near_dups.deduplicate(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    settle(spark)
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    settle(spark)
    return pii.redact_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    settle(spark)
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json")).drop("ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("personal_data", redact_personal_data),
    ("best_fit_packing", pack),
]

ORACLE_SQL = None  # trained models and tokenisers are beyond SQL; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(settle(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
