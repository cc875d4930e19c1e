"""The pipeline, stage by stage, against plain versions on the smallest data."""

from collections import Counter

import corpus_pipeline
import public_tokenizers
from pyspark.sql import functions as F
from tests.llm.test_decontamination import words
from tests.llm.test_near_duplicates import brute
from tokenizers import Tokenizer

from fogon.llm import langid, toxicity
from fogon.llm.common import fold

SF = "/root/testdata/sf0.001"


def test_stages_and_run(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    rows = [r.asDict() for r in docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, SF)
        path = f"{tmp_path}/{name}"
        made.write.parquet(path)
        after = spark.read.parquet(path)
        if name == "toxicity":
            model = toxicity.fit(toxicity.training_rows(docs, spark.read.parquet(f"{SF}/labels.parquet"), fold()))
            scores = {r.doc_id: r.s for r in docs.select("doc_id", toxicity.detect(model, F.col("text"))["score"].alias("s")).collect()}
            want = [r for r in rows if scores[r["doc_id"]] < 0.3]
        elif name == "language_id":
            model = langid.fit(docs.where(fold() != 2))
            bad = {r.doc_id for r in docs.where(langid.identify(model, F.col("text"))["rejected"]).collect()}
            want = [r for r in rows if r["doc_id"] not in bad]
        elif name == "ngram_jaccard_join":
            classes = {d: c for d, c, _ in brute([(r["doc_id"], r["text"]) for r in rows])}
            want = [r for r in rows if classes[r["doc_id"]] == r["doc_id"]]
            assert len(want) < len(rows)
        elif name == "benchmark_decontamination":
            items = [words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            windows = {tuple(b[i : i + 13]) for b in items for i in range(max(1, len(b) - 12)) if b}
            want = []
            for r in rows:
                w, hit = words(r["text"]), set()
                for p in range(len(w) - 12):
                    if tuple(w[p : p + 13]) in windows:
                        hit |= set(range(p, p + 13))
                if not (hit and 20 * len(hit) >= len(w)):
                    want.append(r)
            assert len(want) < len(rows)
        else:
            plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
            total = Counter({r["doc_id"]: len(plain.encode(r["text"], add_special_tokens=False).ids) + 1 for r in rows})
            pieces = after.collect()
            got = Counter()
            for p in pieces:
                got[p.doc_id] += p.length
            assert got == total
            break
        assert after.columns == columns
        assert sorted((r.asDict() for r in after.collect()), key=str) == sorted(want, key=str)
        docs, rows = after, want
    ran = corpus_pipeline.run(spark, SF)
    key = ("doc_id", "piece", "start", "length", "ids_crc32")
    assert sorted(tuple(r[k] for k in key) for r in ran.collect()) == sorted(tuple(r[k] for k in key) for r in pieces)


def test_nulls_clashing_columns_and_an_empty_table(spark, tmp_path):
    whole = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    odd = spark.createDataFrame([(None, None, None, None, None), (5, "", "en", "s", 0), (5, "", "en", "s", 0)], whole.schema)
    frame = whole.unionByName(odd).withColumns({"key": F.lit("k"), "score": F.lit(1.0), "rejected": F.lit("r"), "pid": F.lit(1)})
    for n, docs in enumerate((frame, frame.limit(0))):
        for name, stage in corpus_pipeline.STAGES:
            made = stage(spark, docs, SF)
            if name != "best_fit_packing":
                assert made.columns == frame.columns
            made.write.parquet(f"{tmp_path}/{n}-{name}")
            docs = spark.read.parquet(f"{tmp_path}/{n}-{name}")
        assert bool(docs.count()) == (n == 0)
