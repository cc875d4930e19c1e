"""Registered queries of the training-data operators and their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from fogon.llm import collocations, decontamination, fingerprints, html_text, langid, near_duplicates, packing, personal_data, preferences, prefix_trie, token_files, toxicity, warc
from fogon.llm.common import fold, tune
from fogon.operators.staging import fresh_dir


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_next(_table(spark, sf_dir, "documents"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.jaccard_join(_table(spark, sf_dir, "documents"))[0].select("doc_id", "class_id", "n_links")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = token_files.write_token_files(
        _table(spark, sf_dir, "documents"), fresh_dir(spark, "tokens"),
        public_tokenizers.path("byte_bpe_50k.json"), end_id=2,
    )
    return token_files.read_token_files(spark, files, digest=True)


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(
        _table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=0, capacity=2048
    )


def op6_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = preferences.preference_pairs(_table(spark, sf_dir, "conversations"))
    return preferences.format_preferences(pairs)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.Decontaminator(docs, _table(spark, sf_dir, "benchmark"))
    return docs.select("doc_id", found.hits(docs["text"]).alias("hits")).select("doc_id", "hits.*")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    warc.register(spark)
    path = fresh_dir(spark, "warc")
    warc.dedup_records(_table(spark, sf_dir, "pages")).write.format("fogon_warc").mode("append").save(path)
    records = spark.read.format("fogon_warc").load(path)
    return records.select(
        warc.page_id_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        warc.page_id_of("refers_to").alias("refers_to"),
    )


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = langid.label(docs, fold() != 2, ["doc_id"], "r").withColumn("held_out", fold() == 2)
    return found.select("doc_id", "held_out", "r.lang_pred", "r.score", "r.entropy", "r.rejected")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit(toxicity.training_rows(docs, _table(spark, sf_dir, "labels"), fold()))
    found = docs.select("doc_id", (fold() == 2).alias("held_out"), toxicity.detect(model, F.col("text")).alias("r"))
    return found.select(
        "doc_id", "held_out", "r.score", (F.col("r.score") >= 0.3).cast("int").alias("predicted"),
        "r.evidence", F.size("r.passages").alias("n_passages"),
    )


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.personal_data(_table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(_table(spark, sf_dir, "conversations"))


OP8_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
q AS (SELECT page_id, strlen(html) AS n, sha256(html) AS digest,
        CASE WHEN strlen(html) >= 100 THEN min(page_id) OVER (PARTITION BY html) END AS first
      FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
  CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM q
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fingerprints": op1_fingerprints,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_token_files": op3_token_files,
    "op4_html_text": op4_html_text,
    "op5_packing": op5_packing,
    "op6_preferences": op6_preferences,
    "op7_decontamination": op7_decontamination,
    "op8_warc": op8_warc,
    "op9_langid": op9_langid,
    "op10_toxicity": op10_toxicity,
    "op11_collocations": op11_collocations,
    "op12_personal_data": op12_personal_data,
    "op13_prefix_trie": op13_prefix_trie,
    "pipeline": corpus_pipeline.run,
}

SQL: dict[str, str] = {
    "op6_preferences": preferences.SQL,
    "op7_decontamination": decontamination.SQL,
    "op8_warc": OP8_SQL,
    "op11_collocations": collocations.SQL,
    "op13_prefix_trie": prefix_trie.SQL,
}
