"""Decontamination against the statement, a word-by-word loop and in several blocks."""

import hashlib
import re

from tests.compare import compare, duck

from fogon.llm import decontamination as dc
from fogon.llm import queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def by_hand(docs, items, size):
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for item, body in items:
            b = words(body)
            k = min(size, len(b))
            for i in range(len(b) - k + 1 if b else 0):
                for p in range(len(w) - k + 1):
                    if w[p : p + k] == b[i : i + k]:
                        hit |= set(range(p, p + k))
                        found.add("" if item is None else str(item))
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def test_query_equals_the_statement(spark):
    sf_dir = "/root/testdata/sf0.01"
    equal, message = compare(spark, duck(sf_dir), sf_dir, "op7", queries.op7_decontamination, dc.SQL)
    assert equal, message


DOCS = [
    (1, "x a b c d y"), (2, "A,b;C.d"), (3, None), (4, ""), (5, "a a a a a a a a"), (6, "the zoo"), (6, "the zoo"),
    (None, "a b c d"), (7, "one two three four five six seven eight nine ten"), (8, "É é a-b 'c"),
    (9, "a b c d " + "z " * 5000), (10, "b c d e f a b c"),
]
ITEMS = [(1, "a b c d"), (2, "a b c d e f"), (None, "zoo"), (3, ""), (4, None), (5, "a a a"), (5, "three four five six seven"), (6, "zoo"), (10, "é")]


def test_hard_cases_in_one_block_and_in_many(spark):
    docs = spark.createDataFrame([(*d, 0, "x") for d in DOCS], "doc_id long, text string, n_hit int, items string")
    items = spark.createDataFrame([(*i, 1) for i in ITEMS], "item_id long, text string, doc_id int")
    want = by_hand(DOCS, ITEMS, 4)
    for block in (100_000, 2):
        found = dc.Decontaminator(docs, items, size=4, block_windows=block)
        got = docs.select("doc_id", found.hits(docs["text"]).alias("h")).select("doc_id", "h.*").collect()
        assert sorted((tuple(r) for r in got), key=str) == want
    for some_docs, some_items in ((docs.limit(0), items), (docs, items.limit(0))):
        found = dc.Decontaminator(some_docs, some_items)
        got = some_docs.select(found.hits(some_docs["text"]).alias("h")).select("h.*").collect()
        assert not any(r.n_hit for r in got)


def test_prefix_is_the_rarest_token():
    block = dc.Block([("i", b"a b c d e f g")])
    tokens = [(k, t) for _, _, k, t in block.tokens()]
    block.order_by_rarity(dict(zip(tokens, (9, 2, 5), strict=True)))
    assert block.prefix[5][2].tolist() == [1]


def test_short_runs_beside_items_of_any_length(spark):
    """Production window size; runs of 1 to 4 benchmark words meet shingles of 5."""
    long = " ".join(f"w{i}" for i in range(20))
    rows = [(1, "uno"), (2, "due tre"), (3, "alfa beta gamma"), (5, "w1 w2 q r s"), (20, long)]
    texts = ["x w1 w2 w3 y", "uno", "z due tre z", "w1 x w2 w3 z w4 w5 w6 w7 z", "alfa beta gamma z alfa beta", f"z {long} z", "w1 w2 q r s"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame(rows, "item_id long, text string")
    for block in (100_000, 2):
        found = dc.Decontaminator(docs, items, block_windows=block)
        got = docs.select("doc_id", found.hits(docs["text"]).alias("h")).select("doc_id", "h.*").collect()
        assert sorted((tuple(r) for r in got), key=str) == by_hand(list(enumerate(texts)), rows, 13)
