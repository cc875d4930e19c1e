"""Fingerprints: equality, likeness, located edits, and the query against a plain loop."""

import hashlib
import random

from fogon.llm import queries
from fogon.llm.fingerprints import _tree, belongs, branch, changed, compare_with_next, edited_text, fingerprint, likeness


def words(rng, n):
    return " ".join(f"w{rng.randrange(5000)}" for _ in range(n))


def test_equal_texts_and_only_they_have_equal_roots():
    texts = ["", "a", "a ", "a\n", "a\n\nb", "a\nb", "é", "x" * 50_000, "\x85  z", None]
    roots = {}
    for t in texts:
        roots.setdefault(fingerprint(t).partition(":")[0], set()).add(t or "")
    assert all(len(v) == 1 for v in roots.values())
    assert fingerprint("a\nb c") == fingerprint("a\nb c")


def test_likeness_follows_the_share_that_is_kept():
    rng = random.Random(1)
    text = "\n".join(words(rng, 40) for _ in range(30))
    for cut in (0.1, 0.25, 0.5):
        n = int(len(text) * cut)
        new = text[: len(text) - n] + "\n".join(words(rng, 40) for _ in range(30))[:n]
        assert abs(likeness(fingerprint(text), fingerprint(new)) - (1 - cut)) < 0.08
    assert likeness(fingerprint(text), fingerprint(text)) == 1
    assert likeness(fingerprint(text), fingerprint(text + " ")) < 1
    assert likeness(fingerprint(text), fingerprint(words(rng, 900))) < 0.02
    assert likeness(fingerprint(""), fingerprint(text)) == 0
    # An edit in front moves nothing that follows.
    assert likeness(fingerprint(text), fingerprint("one new line\n" + text)) > 0.95


def test_edits_are_located():
    rng = random.Random(2)
    lines = [words(rng, 12) for _ in range(50)]
    other = list(lines)
    other[7], other[33] = "changed", lines[33] + " more"
    del other[20]
    assert changed(fingerprint("\n".join(lines)), fingerprint("\n".join(other))) == [7, 20, 33]


def test_branches_lead_to_the_root():
    rng = random.Random(3)
    lines = [words(rng, rng.randrange(0, 12)) + "\n" for _ in range(60)]
    text = "".join(lines)
    fp = fingerprint(text)
    assert len(_tree(text)) > 3
    for i, line in enumerate(lines):
        way = branch(text, i)
        assert belongs(line, way, fp)
        assert not belongs(line + " ", way, fp) and not belongs(line, way, fingerprint(text + "x"))
    assert not belongs(lines[0], branch(text, 1), fp) or lines[0] == lines[1]
    # Digests of the tree are those that the fingerprint shows.
    assert fp.count("/") == len(_tree(text)) and fp.count(".") == len(lines)


def by_hand(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    out = []
    for i, (doc_id, text) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        n = len(text) // 4
        new = text[: len(text) - n] + after[:n]
        assert new == edited_text(text, after)
        own = fingerprint(text)
        out.append(
            (doc_id, len(text), hashlib.sha256(new.encode()).hexdigest(), own, fingerprint(new),
             likeness(own, fingerprint(new)), likeness(own, fingerprint(after)))
        )
    return sorted(out, key=str)


def test_query_against_a_plain_loop(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = by_hand([(r.doc_id, r.text) for r in docs.collect()])
    got = queries.op1_fingerprints(spark, "/root/testdata/sf0.01").collect()
    assert sorted((tuple(r)[:7] for r in got), key=str) == want
    near = sorted(r.near_edited for r in got)
    assert near[len(near) // 2] > 0.6 and sum(r.near_edited > r.near_next for r in got) > 0.95 * len(got)


def test_many_ranges_nulls_and_repeated_rows(spark, monkeypatch):
    from fogon.llm import common, fingerprints

    monkeypatch.setattr(fingerprints, "in_key_order", lambda *a, **k: common.in_key_order(*a, rows=7, **k))
    rng = random.Random(3)
    rows = [(i * 3, words(rng, rng.randrange(60))) for i in rng.sample(range(90), 60)]
    rows += [(None, "null id"), (4, None), (6000, ""), (6000, ""), (7000, "x" * 99_999)]
    frame = spark.createDataFrame([(*r, "e", 1.0) for r in rows], "doc_id long, text string, pid string, k double")
    got = [tuple(r)[:7] for r in compare_with_next(frame).collect()]
    assert sorted(got, key=str) == by_hand(rows)
    assert compare_with_next(frame.limit(0)).collect() == []
    one = spark.createDataFrame([(5, "abcdefgh")], "doc_id long, text string")
    assert compare_with_next(one).first().edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest()
