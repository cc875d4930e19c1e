"""Collocations against plain counting."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from fogon.llm import collocations as col

SCHEMA = "doc_id long, lang string, text string"


def counted(rows):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        folded = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", folded):
            words = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    counts[lang, " ".join(words[i : i + k])] += 1
    return counts, totals


def brute_force(rows, least, keep=2000):
    counts, totals = counted(rows)
    frequent = {k: n for k, n in counts.items() if n >= least}
    found = []
    for (lang, phrase), a in frequent.items():
        words = phrase.split(" ")
        if len(words) < 2:
            continue
        score, _, l, r = min(
            (2_000_000 * a // (counts[lang, " ".join(words[:k])] + counts[lang, " ".join(words[k:])]), k,
             counts[lang, " ".join(words[:k])], counts[lang, " ".join(words[k:])])
            for k in range(1, len(words))
        )
        inside = any(
            g == lang and len(longer.split(" ")) > len(words) and f" {phrase} " in f" {longer} " and 100 * n >= 80 * a
            for (g, longer), n in frequent.items()
        )
        if not inside:
            found.append((lang, -score, -a, phrase.encode(), l, r))
    out, rank = [], Counter()
    for lang, score, a, phrase, l, r in sorted(found):
        rank[lang] += 1
        if rank[lang] <= keep:
            out.append((lang, rank[lang], phrase.decode(), -a, l, r, totals[lang], -score))
    return sorted(out)


def texts(seed, n, words="the of to in a 日本 über b c x1 THE Of".split(" ")):
    rng = random.Random(seed)
    weights = [1 / (i + 1) for i in range(len(words))]
    for _ in range(n):
        out = ""
        for w in rng.choices(words, weights, k=rng.randrange(0, 60)):
            out += w + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", " -"])
        yield (rng.choice(["en", "en", "fr", None]), out)


def found(spark, rows, least=5, keep=2000, **columns):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SCHEMA)
    got = col.collocations(df, least=least, keep=keep).collect()
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got)


def test_equals_plain_counting(spark):
    rows = [*texts(1, 150), ("en", None), (None, ""), ("", "the of the of " * 9), ("fr", "the of x1 " * 4000)]
    want = brute_force(rows, 5)
    assert len(want) > 50
    assert found(spark, rows) == want
    assert found(spark, rows, keep=3) == brute_force(rows, 5, keep=3)


def test_no_rows_without_frequent_phrases(spark):
    assert found(spark, []) == []
    assert found(spark, [("en", "a b c"), ("en", "d e")]) == []


def test_other_columns_are_not_looked_at(spark):
    rows = list(texts(3, 40))
    df = spark.createDataFrame(
        [(i, *r, 1, "x", 2) for i, r in enumerate(rows)], SCHEMA + ", n long, phrase string, route int"
    )
    got = sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in col.collocations(df, 5).collect())
    assert got == brute_force(rows, 5)


@pytest.mark.parametrize("size, route_bytes", [(50, 200), (400, 100_000)])
def test_many_routes_with_and_without_hot_pairs(spark, monkeypatch, size, route_bytes):
    """A third of all suffixes start with one pair, which is dealt to all routes."""
    rows = [*texts(5, 80), *[("en", f"hot pair w{i % 40} w{i % 11}") for i in range(400)]]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SCHEMA)
    for share in (2.0, 1 / 50):
        monkeypatch.setattr(col, "HOT_SHARE", share)
        _, every, _ = col.phrase_counts(df, 6, size, route_bytes)
        want = {k: n for k, n in counted(rows)[0].items() if n >= 6}
        assert {(r.lang, r.phrase): r.f for r in every.collect()} == want


def test_a_hot_pair_is_spread_over_routes(spark, monkeypatch):
    from types import SimpleNamespace

    import pyarrow as pa

    monkeypatch.setattr(col, "HOT_SHARE", 1 / 50)
    batch = pa.record_batch([pa.array(["en"] * 300), pa.array([f"hot pair w{i} w{i % 7}" for i in range(300)])], ["lang", "text"])
    bits = SimpleNamespace(value=np.full(1 << (col.BITS - 3), 255, "uint8"))
    for pairs, least_routes, most in (({}, 1, 300), ({"en": {(b"hot", b"pair")}}, 15, 60)):
        sizes = Counter()
        for out in col._router(10**6, 20, bits, SimpleNamespace(value=pairs))(iter([batch])):
            for route, n, words, rows in zip(*(out.column(i).to_pylist() for i in (0, 2, 3, 4))):
                texts, local, _ = col._unpack(n, words, rows)
                sizes[route] += sum(texts[i - 1] == b"hot" for i in local[0])
        assert max(sizes.values()) <= most and len([v for v in sizes.values() if v]) >= least_routes


@pytest.mark.parametrize("small", [0, 3, 10_000])
def test_quicksort_equals_counting(small):
    rng = np.random.default_rng(small)
    rows = rng.integers(0, 5, (3000, 4)).astype("int32")
    rows[:, 0] = np.maximum(rows[:, 0], 1)
    for i in range(1, 4):
        rows[:, i] = np.where(rows[:, i - 1] > 0, rows[:, i], 0)
    weights = rng.integers(1, 4, 3000)
    want = Counter()
    for row, w in zip(rows.tolist(), weights.tolist()):
        for d in range(1, 5):
            if all(row[:d]):
                want[tuple(row[:d])] += w
    for least in (1, 30, 10**6):
        got = {}
        for row, depth, count in col.multikey_quicksort(list(rows.T), weights, least, small=max(small, 64)):
            key = tuple(rows[row, :depth].tolist())
            assert key not in got
            got[key] = count
        assert got == {k: n for k, n in want.items() if n >= least}
    partial = {2: np.array([3])}
    got = {tuple(rows[r, :d].tolist()): c for r, d, c in col.multikey_quicksort(list(rows.T), weights, 200, partial)}
    assert got == {k: n for k, n in want.items() if n >= 200 or k == (2,) or k[:2] == (2, 3) and len(k) < 4}


def test_bitmap_holds_every_frequent_word(spark):
    words = [("en", f"w{i}") for i in range(500)] + [("fr", "été")]
    bits = col._bitmap(spark.createDataFrame(words, "lang string, a string"))
    assert len(bits) == 1 << (col.BITS - 3)
    at = [col._word_hash(lang, w.encode()) & ((1 << col.BITS) - 1) for lang, w in words]
    assert all(bits[i >> 3] >> (i & 7) & 1 for i in at)
    assert int(np.unpackbits(bits).sum()) == len(set(at))
