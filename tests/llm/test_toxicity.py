"""Toxicity: held-out quality, all maximal segments, calibration and hard cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fogon.llm import queries, toxicity
from fogon.llm.common import fold

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def model(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    return toxicity.fit(toxicity.training_rows(docs, labels, fold()))


def test_held_out_quality(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = queries.op10_toxicity(spark, SF).where("held_out").join(labels, "doc_id").collect()
    hit = sum(r.predicted and r.toxic for r in rows)
    assert hit / sum(r.toxic for r in rows) > 0.75
    assert hit / sum(r.predicted for r in rows) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    # Calibrated: the mean score is the share of label 1.
    assert abs(np.mean([r.score for r in rows]) - np.mean([r.toxic for r in rows])) < 0.03


def maximal(scores):
    """All maximal segments by definition, recursively: the best segment, then both sides."""
    def best(a, b):
        top = None
        for i in range(a, b):
            total = 0.0
            for j in range(i, b):
                total += scores[j]
                key = (total, -(j - i), -i)
                if total > 1e-12 and (top is None or key > top[0]):
                    top = (key, i, j + 1, total)
        return top

    out, todo = [], [(0, len(scores))]
    while todo:
        a, b = todo.pop()
        top = best(a, b)
        if top:
            out.append((top[1], top[2], round(top[3], 6)))
            todo += [(a, top[1]), (top[2], b)]
    return sorted(out)


@pytest.mark.parametrize("seed", range(20))
def test_segments_against_the_definition(seed):
    rng = random.Random(seed)
    model = toxicity.ToxicityModel(weights={b"x": 2.03, b"y": 0.91, b"z": 0.2}, plain=-0.57)
    words = [rng.choice([b"x", b"y", b"z", b"o", b"o", b"p", b"q"]) for _ in range(40)]
    scores = [model.weights.get(w, model.plain) for w in words]
    got = [(a, b, round(s, 6)) for a, b, s in model.segments(words)]
    assert got == maximal(scores)


def test_lambda_solves_its_equation():
    p, s = np.array([0.01, 0.02, 0.97]), np.array([5.0, 2.0, -0.1])
    lam = toxicity._lambda(p, s)
    assert abs((p * np.exp(lam * s)).sum() - 1) < 1e-6 or (p * s).sum() >= 0


def test_passages_are_found_where_they_are(model):
    clean = ["orre"] * 300
    words = [w.encode() for w in clean[:100] + ["you", "stupid", "pathetic", "idiot"] + clean[100:]]
    passages = model.passages(words)
    assert len(passages) == 1 and passages[0][0] in (100, 101) and passages[0][1] == 104
    assert model.passages([w.encode() for w in clean]) == []


def run(spark, model, texts):
    frame = spark.createDataFrame([(i, t, 0.5) for i, t in enumerate(texts)], "i int, text string, score double")
    return [r.r for r in frame.select("i", toxicity.detect(model, F.col("text")).alias("r")).orderBy("i").collect()]


def test_hard_cases(spark, model):
    got = run(spark, model, [None, "", "!!", "idiot " * 100_000, "You stupid, WORTHLESS idiot"])
    assert got[0].score == got[1].score == got[2].score < 0.1 and not got[0].passages
    assert got[3].score > 0.9 and got[3].n_words == 100_000 and got[4].score > 0.9


def test_labels_of_any_kind(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (None, "b"), (3, "c")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 1), (3, None), (None, 1)], "doc_id long, toxic int")
    rows = toxicity.training_rows(docs, labels, F.lit(0)).collect()
    assert sorted(((r.text, r.toxic) for r in rows), key=str) == [("a", 1), ("a", 1), (None, 1)]
    for some in (labels.limit(0), labels.where("toxic = 1"), labels.where("doc_id = 3")):
        model = toxicity.fit(toxicity.training_rows(docs, some, F.lit(0)))
        assert {r.score for r in run(spark, model, ["a", None])} == {model.base}


def test_bound_on_labels(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    labels = docs.select("doc_id", F.lit(1).alias("toxic"))
    assert 300 < toxicity.training_rows(docs, labels, F.lit(0), max_labels=500).count() <= 500


def test_all_labels_are_learned_from(spark):
    """More labels than the 200,000 a cap once left, none of them dropped."""
    docs = spark.range(210_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    labels = docs.select("doc_id", F.lit(1).alias("toxic"))
    rows = toxicity.training_rows(docs, labels, F.lit(0))
    assert rows.count() == 210_000
    assert "ResolvedHint" not in rows._jdf.queryExecution().analyzed().toString()
    assert toxicity.fit(rows).base == 1.0


def test_words_are_counted_once_for_all_models(spark, monkeypatch):
    """One pass gives the counts of every fold; texts and labels are shuffled at any size."""
    passes, plans = [], []
    count, write = toxicity._word_counts, toxicity.write_stage
    monkeypatch.setattr(toxicity, "_word_counts", lambda *a: passes.append(a) or count(*a))

    def seen(df, label):
        plans.append((label, df._jdf.queryExecution().executedPlan().toString()))
        return write(df, label)

    monkeypatch.setattr(toxicity, "write_stage", seen)
    docs = spark.range(300).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("plain words "), F.when(F.col("id") % 3 == 0, "vile ").otherwise("good "), F.col("id")).alias("text")
    )
    labels = docs.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    model = toxicity.fit(toxicity.training_rows(docs, labels, F.lit(0)))
    assert set(model.weights) == {b"vile"} and any(model.curve)
    assert len(passes) == 1
    assert "BroadcastHashJoin" not in dict(plans)["labelled"] and "SortMergeJoin" in dict(plans)["labelled"]
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == before


def test_counts_by_fold(spark):
    rows = spark.createDataFrame(
        [("a b a", 1, 0), ("A c", 0, 0), ("b", 0, 1), ("b", 1, 1), (None, 1, 1)], "text string, toxic int, own int"
    )
    got = {bytes(r.word): tuple(r)[1:] for r in toxicity._word_counts(rows, 2).collect()}
    assert got == {b"a": (1, 1, 0, 0), b"b": (1, 0, 1, 1), b"c": (0, 1, 0, 0)}
