"""The trie of rebuilt conversations against one that builds every text."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import pytest

from fogon.llm import prefix_trie as trie

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute_force(rows):
    def order(row):
        role, text = row[2] or "", row[3] or ""
        digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
        return (row[1] is not None, row[1] or 0, digest)

    convs = defaultdict(list)
    for row in sorted((r for r in rows if r[0] is not None), key=order):
        convs[row[0]].append((row[2] or "", row[3] or ""))
    members, ends = defaultdict(list), defaultdict(list)
    for c, own in sorted(convs.items()):
        h = zlib.crc32(str(c).encode()) % 4
        path = convs.get(c - int(math.fmod(c, 20)), [])[:h] + own[h:]  # as SQL's remainder
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
        ends[tuple(path)].append(c)
    out = []
    for node, ids in members.items():
        below = [n for n in members if n[: len(node)] == node]
        children = [n for n in below if len(n) == len(node) + 1]
        leaves = [n for n in below if not any(m[: len(n)] == n and len(m) > len(n) for m in below)]
        saved = sum(
            (len(members[n]) - 1) * len([w for w in n[-1][1].translate({i: " " for i in range(9, 14)}).split(" ") if w])
            for n in below if n
        )
        joined = ",".join(map(str, sorted(ends.get(node, []))))
        out.append((
            ids[0], len(node), members[node[:-1]][0] if node else None, len(ids), len(children), len(leaves), saved,
            hashlib.sha256(joined.encode()).hexdigest(),
        ))
    return sorted(out)


def found(spark, rows, schema=SCHEMA, **options):
    df = spark.createDataFrame(rows, schema)
    return sorted(tuple(r[c] for c in COLUMNS) for r in trie.prefix_trie(df, **options).collect())


def conversations(seed, n):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        if c % 9 == 4:
            continue
        for t in range(rng.choice([1, 1, 2, 3, 5, 9])):
            text = rng.choice(["a", "a  b", " \t", "", None, "b\nc d"]) if rng.random() < 0.9 else "x " * 5000
            rows.append((c, rng.choice([t, t, t, None, 2]), rng.choice(["user", "user", "assistant", None]), text))
    return rows + rows[:7] + [(None, 1, "user", "nobody's"), (-3, 0, "user", "a"), (40, 99, "tool", "a")]


def test_equals_a_trie_of_texts(spark):
    rows = conversations(1, 75)
    assert found(spark, rows) == brute_force(rows)


def test_columns_of_the_same_names_and_an_empty_table(spark):
    rows = conversations(2, 12)
    wide = [(*r, 7, "x", 1.5) for r in rows]
    assert found(spark, wide, SCHEMA + ", k1 long, depth string, words double") == brute_force(rows)
    assert found(spark, []) == []


def test_a_conversation_over_many_tasks_and_a_common_one(spark):
    """One conversation has a third of the turns and spans ranges; another is repeated by a
    third of the ids."""
    rows = [(20, t, "user", f"word {t % 3}") for t in range(300)]
    rows += [(c, t, "user", "same words here") for c in range(41, 141) for t in range(2)]
    rows += [(c, 0, "user", f"turn {c}") for c in range(200, 300)]
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        assert found(spark, rows) == brute_force(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)


def test_colliding_fingerprints_are_seen_and_drawn_anew(spark, monkeypatch):
    """With a base of -1 the first and third turn may change places."""
    real, drawn = trie._bases, []

    def bases(seed):
        drawn.append(seed)
        return [trie.PRIME - 1] * 4 if seed == 0 else real(seed)

    monkeypatch.setattr(trie, "_bases", bases)
    rows = [(40, i, "user", x) for i, x in enumerate("abcd")] + [(60, i, "user", x) for i, x in enumerate("cbad")]
    assert found(spark, rows) == brute_force(rows)
    assert drawn == [0, 1]


def test_different_turns_under_one_digest_are_refused(spark):
    turns = spark.createDataFrame([("u", "a", "d1"), ("u", "b", "d1")], "role string, text string, digest string")
    with pytest.raises(RuntimeError):
        trie._check_turns(turns)


def test_ends_of_a_node_stream_in_chunks(spark):
    ids = [*range(0, 9000, 7), *range(10**6, 10**6 + 50)]
    members = spark.createDataFrame([(c, 1, 5, 6, True) for c in ids] + [(3, 2, 5, 6, True), (4, 2, 5, 7, False)],
                                    "conv_id long, depth long, k1 long, k2 long, last boolean")
    got = {(r.depth, r.k1, r.k2): r.ends_sha256 for r in trie._ends(members, chunk=100).collect()}
    whole = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert got == {(1, 5, 6): whole, (2, 5, 6): hashlib.sha256(b"3").hexdigest()}
