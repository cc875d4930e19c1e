"""The similarity join against all pairs of a small table, and its hard cases."""

import numpy as np
import pytest

from fogon.llm import near_duplicates as nd
from fogon.llm.components import components


def brute(rows, threshold=0.8):
    """(class id, links) per row, by comparing all pairs of shingle sets."""
    sets = [set(nd.shingles(t).tolist()) if t is not None else None for _, t in rows]
    n = len(rows)
    up = list(range(n))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    links = [0] * n
    for i in range(n):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a is None or b is None:
                continue
            if not a or not b:
                same = not a and not b and rows[i][1] == rows[j][1]
            else:
                both = len(a & b)
                same = both >= threshold * (len(a) + len(b) - both) - 1e-9
            if same:
                links[i] += 1
                links[j] += 1
                up[max(root(i), root(j))] = min(root(i), root(j))
    members = {}
    for i in range(n):
        members.setdefault(root(i), []).append(rows[i][0])
    ids = {r: min((x for x in m if x is not None), default=None) for r, m in members.items()}
    return sorted(((rows[i][0], ids[root(i)], links[i]) for i in range(n)), key=str)


def joined(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted((tuple(r)[:3] for r in nd.jaccard_join(frame)[0].collect()), key=str)


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    assert joined(spark, rows) == brute(rows)


def test_hard_cases(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(400)]
    base = [words[i] for i in rng.integers(0, 400, 120)]
    rows = [(None, None), (1, None), (2, ""), (3, ""), (4, "!!"), (5, "one two"), (6, "One, two"), (7, "one two"), (7, "one two")]
    for i in range(60):  # near copies, some linked only through others
        copy = list(base)
        for j in rng.integers(0, 120, int(rng.integers(0, 5))):
            copy[j] = words[rng.integers(0, 400)]
        rows.append((100 + i, " ".join(copy)))
    rows += [(300 + i, " ".join(words[j] for j in rng.integers(0, 400, 80))) for i in range(20)]
    rows.append((None, " ".join(base)))
    assert joined(spark, rows) == brute(rows)


def test_small_blocks_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK_ROWS", 8)
    monkeypatch.setattr(nd, "BLOCK_SHINGLES", 500)
    test_hard_cases(spark)


def test_one_document_of_each_class_stays(spark):
    text = "a b c d e f g h"
    rows = [(3, text, "x"), (2, text, "y"), (2, text, "y"), (None, text, "z"), (None, "p q", "u"), (None, "p q", "u"),
            (None, None, "v"), (None, None, "v"), (9, "!!", "w"), (8, "!!", "w"), (2, "other words", "t")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, key string")
    kept = nd.keep_one(frame)[0]
    assert kept.columns == frame.columns
    want = [(2, text, "y"), (None, "p q", "u"), (None, None, "v"), (None, None, "v"), (8, "!!", "w"), (2, "other words", "t")]
    assert sorted((tuple(r) for r in kept.collect()), key=str) == sorted(want, key=str)
    assert nd.keep_one(frame.limit(0))[0].collect() == []


def test_empty_table(spark):
    assert joined(spark, []) == []


def test_prefix_is_shortened_until_the_recall_is_reached():
    assert nd.prefix_length(0.8, 16, 5, 0.9999) == 3
    assert nd.prefix_length(0.8, 16, 5, 0.99) == 5
    assert nd.prefix_length(0.8, 1, 5, 0.9999) == 1


def test_intersections_match_sets():
    rng = np.random.default_rng(1)
    a = [np.unique(rng.integers(0, 9000, 6000).astype("uint64")) for _ in range(4)]
    b = [np.unique(rng.integers(0, 9000, n).astype("uint64")) for n in (1, 50, 7000)]
    want = [[len(set(x.tolist()) & set(y.tolist())) for y in b] for x in a]
    assert nd.intersections(a, b).tolist() == want


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = np.random.default_rng(seed)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 60, (45, 2))] + [(100 + i, 101 + i) for i in range(30)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        up[max(root(a), root(b))] = min(root(a), root(b))
    want = {x: root(x) for a, b in edges for x in (a, b) if a != b}
    got = components(spark.createDataFrame(edges, "a long, b long"))[0].collect()
    assert {r.node: r.root for r in got} == want and len(got) == len(want)


def test_null_and_repeated_ids_are_joined_once(spark):
    """Rows of one null id are looked up by id and text, not all with all; repeated rows count
    as documents, and stand for their class once."""
    import random

    rng = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    base = [" ".join(rng.choices(words, k=60)) for _ in range(30)]
    rows = [(None, t) for t in base] + [(None, t + " end") for t in base] + [(7, base[0])] * 5
    df = spark.createDataFrame(rows, "doc_id long, text string")
    joined = nd.jaccard_join(df)[0].collect()
    assert len(joined) == 65
    links = sorted(r.n_links for r in joined)
    assert links == [1] * 58 + [6] * 7
    work = spark.createDataFrame(
        [(nd.text_key(t), None, 1, b"r", 1) for t in base], "key binary, rep long, weight long, root binary, nb long"
    ).join(spark.createDataFrame([(nd.text_key(t), t) for t in base], "key binary, text string"), "key")
    from pyspark.sql import functions as F

    sets = nd._sets(df, work.withColumn("mark", F.xxhash64("text")).drop("text"), 5)
    assert sets.count() == 30
    kept = nd.keep_one(df)[0].collect()
    assert len(kept) == 30 and sum(r.doc_id == 7 for r in kept) == 1


def test_crowded_trees_keep_long_prefixes_until_the_recall_is_met():
    crowds = [(t, [1000 * (t + 1), 100, 10]) for t in range(10)]
    at = nd.matched_depths(crowds, 6, 0.8, 3, 5, 0.9999)
    assert set(at) == set(range(10)) and set(at.values()) == {4, 5}
    # The cheapest trees are shortened first, the most crowded stay deep.
    assert [at[t] for t in sorted(at)] == sorted(at.values())
    missed = (1 - 0.8**3) ** 6 * np.prod([1 - 0.8**d for d in at.values()])
    assert missed <= 1e-4
    one_less = dict(at)
    first = max(t for t, d in at.items() if d < 5)
    one_less[first] += 1
    assert (1 - 0.8**3) ** 6 * np.prod([1 - 0.8**d for d in one_less.values()]) > 1e-4
    assert nd.matched_depths([], 16, 0.8, 3, 5, 0.9999) == {}
    assert nd.matched_depths([(0, [9, 8, 8])], 0, 0.8, 3, 5, 0.9999) == {0: 3}


def test_matched_depth_differs_between_documents(spark):
    """A crowd shares its first three values in most trees; a quiet pair does so in one."""
    rng = np.random.default_rng(11)
    crowd, rows = rng.integers(0, 2**32, (nd.TREES, nd.DEPTH), dtype="uint32"), []
    for i in range(200):
        own = crowd.copy()
        own[:, 3:] = rng.integers(0, 4, (nd.TREES, 2))
        own[12:, :3] = rng.integers(0, 2**32, (4, 3))
        rows.append((f"crowd{i}".encode(), nd.paths_of(own.reshape(-1))))
    quiet = rng.integers(0, 2**32, (2, nd.TREES, nd.DEPTH), dtype="uint32")
    quiet[1, 7, :3] = quiet[0, 7, :3]
    rows += [(f"quiet{i}".encode(), nd.paths_of(q.reshape(-1))) for i, q in enumerate(quiet)]
    frame = spark.createDataFrame(rows, "key binary, paths binary")
    got, _ = nd.forest_nodes(frame, 3, 0.8, 0.9999, crowd=64)
    nodes = {}
    for r in got.collect():
        nodes.setdefault(r.node, (r.m, []))[1].append(bytes(r.key))
    assert all(m == len(keys) == len(set(keys)) for m, keys in nodes.values())
    pair = [keys for _, keys in nodes.values() if any(k.startswith(b"quiet") for k in keys)]
    assert [sorted(k) for k in pair] == [[b"quiet0", b"quiet1"]]
    sizes = sorted(len(keys) for _, keys in nodes.values())
    assert sizes.count(200) < 12 and 200 in sizes  # some trees at three values, some deeper
    assert any(2 < n < 200 for n in sizes)
    # Each class has at most one node per tree, and none lost its shallowest open node.
    per_key = {}
    for _, keys in nodes.values():
        for k in keys:
            per_key[k] = per_key.get(k, 0) + 1
    assert all(per_key[f"crowd{i}".encode()] <= 12 for i in range(200))


def test_a_crowd_of_near_copies_keeps_all_links(spark, monkeypatch):
    monkeypatch.setattr(nd, "CROWD", 8)
    rng = np.random.default_rng(23)
    base = [f"w{i}" for i in rng.integers(0, 3000, 300)]
    rows = []
    for i in range(150):
        copy = list(base)
        for at in rng.integers(0, 300, int(rng.integers(0, 7))):
            copy[at] = f"x{i}_{at}"
        rows.append((i, " ".join(copy)))
    assert joined(spark, rows) == brute(rows)
