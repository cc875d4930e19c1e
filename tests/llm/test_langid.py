"""Language ID: held-out accuracy, probabilities that add up, rejection, hard cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fogon.llm import langid, queries
from fogon.llm.common import fold

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return langid.fit(docs.where(fold() != 2).select("doc_id", "lang", "text"))


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    got = queries.op9_langid(spark, SF).join(docs, "doc_id")
    rows = got.groupBy("held_out").agg(
        F.avg((F.col("lang_pred") == F.col("lang")).cast("double")).alias("right"),
        F.avg(F.col("rejected").cast("double")).alias("rejected"), F.count("*").alias("n"),
    ).collect()
    assert {r.held_out for r in rows} == {True, False} and sum(r.n for r in rows) == 1000
    assert all(r.right > 0.98 and r.rejected < 0.005 for r in rows)


def test_probabilities_of_the_next_character_add_up(model):
    """Over the alphabet of a language, the interpolated probabilities sum to 1 for any history."""
    column = model.languages.index("en")
    codes = {int(c) for c in map(ord, "abcdefghijklmnopqrstuvwxyz")}
    for history in ("the", "qqq", langid._START * 3, "th"):
        padded = (langid._START * 3 + history)[-3:]
        total = 0.0
        letters = [chr(c) for c in range(0x61, 0x7B)] + [langid._END] + [chr(c) for c in range(0xDF, 0x100)]
        for c in letters:
            grams = np.frombuffer((padded + c).encode("utf-32-le"), "<u4").astype("uint64")
            p = model.unknown[column]
            for n in range(1, langid.ORDER + 1):
                h = langid._hashes(grams, np.array([3]), n)[0]
                i = np.searchsorted(model.keys[n - 1], h)
                hit = i < len(model.keys[n - 1]) and model.keys[n - 1][i] == h
                if n > 1:
                    g = langid._hashes(grams, np.array([2]), n - 1)[0]
                    j = np.searchsorted(model.keys[n - 2], g)
                    known = j < len(model.keys[n - 2]) and model.keys[n - 2][j] == g
                    p *= model.back[n - 2][j][column] if known else 1.0
                if hit and not np.isnan(model.prob[n - 1][i][column]):
                    p = model.prob[n - 1][i][column]
            total += p
        assert 0.97 < total < 1.0001, (history, total)
    assert codes


def run(spark, model, texts):
    frame = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "i int, text string, score string")
    return [r.r for r in frame.select("i", langid.identify(model, F.col("text")).alias("r")).orderBy("i").collect()]


def test_hard_cases(spark, model):
    english = spark.read.parquet(f"{SF}/documents.parquet").where("lang = 'en'").first().text
    got = run(spark, model, [None, "", "123 !!", "中文文本没有空格" * 20, english, english.upper(), english * 50, "ß"])
    assert [r.lang_pred for r in got[:3]] == ["und"] * 3 and [r.score for r in got[:3]] == [0.0] * 3
    assert all(r.rejected for r in got[:4])
    assert [r.lang_pred for r in got[4:7]] == ["en"] * 3 and not any(r.rejected for r in got[4:7])
    assert all(0 <= r.score <= 1 for r in got) and got[7].lang_pred == "de"


def test_bounded_word_table_changes_nothing(model, spark, monkeypatch):
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(40).collect()]
    whole = langid._Scorer(model).score(texts)
    monkeypatch.setattr(langid, "_KEPT", 10)
    small = langid._Scorer(model)
    again = [small.score([t])[0] for t in texts]
    assert [a[0] for a in again] == [w[0] for w in whole]
    assert np.allclose([a[2] for a in again], [w[2] for w in whole])


def test_nothing_to_learn_from(spark):
    frame = spark.createDataFrame([(1, None, "text"), (None, None, None)], "doc_id long, lang string, text string")
    for docs in (frame, frame.limit(0)):
        model = langid.fit(docs)
        assert run(spark, model, ["text", None])[0].lang_pred == "und"


def test_ngram_counts_against_a_loop(spark):
    from collections import Counter

    texts = [("en", "Ab ab 12 b-c"), ("en", "ab"), ("fr", "é"), (None, "zz"), ("fr", None)]
    want = Counter()
    for lang, text in texts:
        for w in (text or "").lower().replace("-", " ").split() if lang else ():
            if any(c.isalpha() for c in w):
                padded = langid._START * 3 + w + langid._END
                want.update((lang, padded[i : i + 4]) for i in range(len(w) + 1))
    frame = spark.createDataFrame(texts, "lang string, text string")
    got = {(r.lang, bytes(r.gram).decode()): r.n for r in langid.ngram_counts(frame).collect()}
    assert got == dict(want)


def test_no_ngram_of_a_rare_language_is_left_out(spark):
    """More than 200,000 repeated n-grams of one language beside a few single ones of another."""
    rng = np.random.default_rng(3)
    hot = ["".join(map(chr, row)) for row in rng.integers(0x4E00, 0x9000, (45_000, 5)).tolist()]
    rare = "zwölf boxkämpfer jagen viktor quer"
    rows = [(i, "hot", " ".join(hot[i % 9 :: 9] * 2)) for i in range(9)] + [(99, "rare", rare)]
    frame = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    model = langid.fit(frame)
    assert model.languages == ["hot", "rare"]
    padded = [langid._START * 3 + w + langid._END for w in [*hot, *rare.split()]]
    grams = {p[i : i + 4] for p in padded for i in range(len(p) - 3)}  # the languages share none
    assert len(grams) > 200_000 and len(model.keys[3]) == len(grams)
    got = run(spark, model, [rare, rows[0][2]])
    assert [r.lang_pred for r in got] == ["rare", "hot"] and not any(r.rejected for r in got)


def by_hand(texts, history, c):
    """Interpolated Kneser-Ney probability of a character of one language, by its definition."""
    from collections import Counter

    level = Counter()
    for w in " ".join(texts).split():
        padded = langid._START * 3 + w + langid._END
        level.update(padded[i : i + 4] for i in range(len(w) + 1))
    levels = [level]
    for _ in range(3):
        levels.insert(0, Counter(g[1:] for g in levels[0]))
    p = 1 / (len(levels[0]) + 1)
    for n, counts in enumerate(levels, 1):
        context = history[len(history) - n + 1 :]
        after = {g: k for g, k in counts.items() if g[:-1] == context}
        if after:
            ones, twos = (sum(k == x for k in counts.values()) for x in (1, 2))
            d = min(0.9, max(0.1, ones / (ones + 2 * twos))) if ones + 2 * twos else 0.5
            p = (max(after.get(context + c, 0) - d, 0) + d * len(after) * p) / sum(after.values())
    return p


def test_model_against_a_loop_whatever_the_ranges(spark, monkeypatch):
    texts = ["banana bandana ban", "ana band anna", "nab bad dab"]
    frame = spark.createDataFrame([(i, "en", t) for i, t in enumerate(texts)], "doc_id long, lang string, text string")
    for rows in (8_000_000, 5):
        monkeypatch.setattr(langid, "_RANGE_ROWS", rows)
        model = langid.fit(frame)
        for word in ("banana", "dna", "nbd"):
            padded = langid._START * 3 + word + langid._END
            want = sum(np.log(by_hand(texts, padded[i - 3 : i], padded[i])) for i in range(3, len(padded)))
            assert np.isclose(model.log_probs([word])[0, 0], want, rtol=1e-5)


def test_limits_come_from_all_training_texts(spark):
    """More texts of a language than the 2,000 a sample once took: exact quantiles per length class."""
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdefgh"), n)) for n in rng.integers(2, 7, 400)]
    texts = [" ".join(rng.choice(words, n)) for n in rng.integers(1, 9, 3000)] + ["qxyz" * 40]
    frame = spark.createDataFrame([(i, "aa", t) for i, t in enumerate(texts)], "doc_id long, lang string, text string")
    model = langid.fit(frame)
    classes = {}
    for r in run(spark, model, texts):
        classes.setdefault(r.letters.bit_length(), []).append(r.entropy)
    want = {(0, k): sorted(e)[int(np.ceil(0.995 * len(e))) - 1] + 2.0 for k, e in classes.items()}
    assert set(model.limits) == set(want) and all(np.isclose(model.limits[k], want[k], atol=1e-9) for k in want)


def test_label_scores_once_and_rejects_as_the_model(spark, monkeypatch):
    rows = [(i, lang, t, i) for i, (lang, t) in enumerate([
        ("en", "the cat sat on the mat " * 5), ("en", "a dog ran after the cat"), ("de", "der hund lief der katze nach"),
        ("de", "zwölf boxkämpfer jagen viktor"), (None, "zzqq xxjj qqkk"), ("en", None), ("de", "123 !!"), ("en", "中文文本没有空格" * 9),
    ] * 3)] + [(None, "en", "the mat", 0), (0, "en", "the mat", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string, rejected int")
    model = langid.fit(docs.where(fold() != 2))
    want = docs.select("doc_id", "rejected", langid.identify(model, F.col("text")).alias("r")).collect()
    calls = []
    scored = langid.identify
    monkeypatch.setattr(langid, "identify", lambda *a: calls.append(a) or scored(*a))
    got = langid.label(docs, fold() != 2, ["doc_id", "rejected"], "r")
    assert sorted(map(str, got.collect())) == sorted(map(str, want)) and len(calls) == 1
    nothing = langid.label(docs.withColumn("lang", F.lit(None).cast("string")), fold() != 2, ["doc_id"], "r")
    assert {(r.r.lang_pred, r.r.rejected) for r in nothing.collect()} == {("und", True)}
