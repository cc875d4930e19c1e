"""From raw documents to packed training sequences, in five stages.

Each stage works on all rows its predecessor kept, is written as Parquet to the cluster's
shared folder and read again. All but the last keep the columns of ``documents`` as they are,
extra ones included. An empty table passes through every stage.

1. toxicity: documents whose calibrated probability of being toxic is 0.3 or more go. A null
   text has no evidence and stays.
2. language ID: documents without a letter, with a null text, or whose cross-entropy is beyond
   the calibrated limit of every language go.
3. n-gram Jaccard join: of each class of near duplicates the document of the smallest id stays.
4. benchmark decontamination: contaminated documents (a hit, and at least one word in twenty
   hit) go.
5. best-fit packing: the rest, as token pieces with their sequence and offset.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fogon.llm import decontamination, langid, near_duplicates, packing, toxicity
from fogon.llm.common import drop_stage, fold, tune
from fogon.operators.staging import fresh_dir, staged_here


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = tune(spark).read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(toxicity.training_rows(docs, labels, fold()))
    return docs.where(toxicity.detect(model, docs["text"])["score"] < 0.3)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tune(spark)
    # A name that no column has.
    own = "r" + "_" * max(map(len, docs.columns))
    return langid.label(docs, fold() != 2, docs.columns, own).where(~F.col(own)["rejected"]).drop(own)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tune(spark)
    return near_duplicates.keep_one(docs)[0]


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    items = tune(spark).read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontamination.Decontaminator(docs, items)
    return docs.where(~found.hits(docs["text"])["contaminated"])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tune(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=0, capacity=2048)


STAGES = [
    ("toxicity", toxicity_stage),
    ("language_id", language_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("best_fit_packing", packing_stage),
]

#: Trained models and tokenizers are not SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        path = fresh_dir(spark, name)
        # What a stage wrote for itself goes when its result is written.
        with staged_here():
            made = stage(spark, docs, sf_dir)
            made.write.parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
        if before:
            drop_stage(before)
        before = path
    return docs
