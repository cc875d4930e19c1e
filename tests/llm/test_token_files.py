"""Token files: round trips, damage, ranges, and the query against encoding text by text."""

import os
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from fogon.llm import queries
from fogon.llm import token_files as tf
from fogon.llm.tokens import encoder
from fogon.operators.staging import fresh_dir

ODD = [
    "", " ", "  ", "a  b", "a \nb", "\n\n x", "a\t b ", "don't  'll", "\x1c a\x1cb", "<|endoftext|> x<|startoftext|>",
    "é ́x", "Σας ΣΣ", "日本語 テキスト", "a,  b", "x　 y\r\n z", "12 345  6", "ABC's I'M", "\u0085 x", "🙂 🙂",
    "ﬁ İ i̇", "a\n b\n", "\x00 \x7f a", "Ÿ ŉ ſ İ", "a\xadb", "wörd, Wörd. WÖRD!", " lead", "trail ", "a. b? c! d: e; f",
]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_the_library(spark, name):
    plain = Tokenizer.from_file(public_tokenizers.path(name))
    texts = ODD + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    for text, want in zip(texts, plain.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(encoder(public_tokenizers.path(name)).encode(text), "<u4").tolist() == want.ids, text


def test_encoder_forgets_but_stays_right(monkeypatch):
    from fogon.llm import tokens

    monkeypatch.setattr(tokens, "_KEPT", 3)
    path = public_tokenizers.path("byte_bpe_50k.json")
    small = tokens.TextEncoder(path)
    text = "one, two three four five six one, two seven. " * 3
    assert np.frombuffer(small.encode(text), "<u4").tolist() == small.tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 1000, tf.BLOCK, tf.BLOCK + 1])
@pytest.mark.parametrize("kinds", [1, 2, 50_000])
def test_block_round_trip(n, kinds):
    ids = (np.random.default_rng(n).zipf(1.3, n) % kinds).astype("<u4") if n else np.empty(0, "<u4")
    if not n:
        return
    table = tf.Table.of(ids)
    assert table.freq.sum() == 1 << tf.SCALE and (table.freq > 0).all()
    raw = tf.encode_block(ids, table)
    assert (tf.decode_block(raw[:24], raw[24:], table) == ids).all()


def test_scaled_counts_with_many_rare_ids():
    counts = np.ones(60_000, dtype="int64")
    counts[:3] = [10**9, 10**8, 7]
    freq = tf.scaled(counts)
    assert freq.sum() == 1 << tf.SCALE and freq.min() == 1


def test_file_ranges_segments_and_damage(tmp_path, monkeypatch):
    monkeypatch.setattr(tf, "BLOCK", 500)
    monkeypatch.setattr(tf, "SEGMENT", 2000)
    rng = np.random.default_rng(5)
    docs = [(None if i == 3 else i, rng.integers(0, 70_000, int(rng.integers(0, 900))).astype("<u4")) for i in range(20)]
    path = f"{tmp_path}/a.rans"
    writer = tf.TokenFileWriter(path)
    for doc_id, ids in docs:
        writer.add(doc_id, ids.tobytes())
    every = np.concatenate([ids for _, ids in docs])
    assert writer.close() == (20, len(every))
    assert os.listdir(tmp_path) == ["a.rans"]
    file = tf.TokenFile(path)
    assert [(d, ids.tolist()) for d, _, ids in file.rows()] == [(d, ids.tolist()) for d, ids in docs]
    for a, b in ((0, 1), (499, 501), (1990, 4100), (len(every) - 3, len(every))):
        assert file.read(a, b).tolist() == every[a:b].tolist()
    whole = bytearray(open(path, "rb").read())
    whole[len(whole) // 3] ^= 1
    open(path, "wb").write(whole)
    with pytest.raises(ValueError, match="damaged|differ"):
        list(tf.TokenFile(path).rows())


def by_hand(rows):
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_query_against_the_library(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = by_hand([(r.doc_id, r.text) for r in docs.collect()])
    got = queries.op3_token_files(spark, "/root/testdata/sf0.01").orderBy("start").collect()
    assert [tuple(r) for r in got] == want


def test_many_files_nulls_and_an_empty_table(spark):
    rows = [(None, "a"), (None, None), (5, None), (1, "x y z"), (1, "x y z"), (9, ""), *((i, f"text {i}") for i in range(20, 90))]
    frame = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, ids long")
    path = public_tokenizers.path("byte_bpe_50k.json")
    files = tf.write_token_files(frame, fresh_dir(spark, "tokens"), path, 2, rows=10)
    assert len(files) > 3
    got = sorted((tuple(r) for r in tf.read_token_files(spark, files, digest=True).collect()), key=lambda r: r[1])
    assert got == by_hand(rows)
    raw = tf.read_token_files(spark, files).where("doc_id = 5").first()
    assert np.frombuffer(raw.ids, "<u4").tolist() == [2]
    assert tf.write_token_files(frame.limit(0), fresh_dir(spark, "tokens"), path, 2) == []
    assert tf.read_token_files(spark, []).collect() == []


def test_line_breaks_are_cuts():
    """A word beside a line break is kept once, not once with each neighbour; ids stay the library's."""
    import random

    from fogon.llm import tokens

    small = tokens.TextEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    words = [f"w{chr(97 + i)}" for i in range(20)]
    text = " ".join(f"{a}\n{b}" for a in words for b in words)
    want = small.tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(small.encode(text), "<u4").tolist() == want
    assert len(small.after_blank) + len(small.plain) <= 2 * len(words) + 1
    rng = random.Random(3)
    parts = ["a", "bc", " ", "  ", "\n", "\n\n", " \n", "\n ", "\t", "\r\n", "é", "中", "\x1a", "\x1c", "\xa0", ",", "'s", "x\ny"]
    for _ in range(3000):
        text = "".join(rng.choices(parts, k=rng.randint(1, 12)))
        want = small.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(small.encode(text), "<u4").tolist() == want, text
