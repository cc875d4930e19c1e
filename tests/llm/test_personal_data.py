"""Base matches against the plain expressions, and the bootstrap on planted contexts."""

import hashlib
import random
import re

import pyarrow.parquet as pq
import pytest

from fogon.llm import personal_data as pii

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"


def plain(text):
    """The expressions of the task as they stand."""
    def luhn(digits):
        doubled = [int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(digits[::-1])]
        return sum(doubled) % 10 == 0

    digits = lambda m: re.sub("[^0-9]", "", m.group())
    tests = (
        (EMAIL, lambda m: True),
        (IP, lambda m: all(int(p) <= 255 for p in m.group().split("."))),
        (CARD, lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
        (PHONE, lambda m: 9 <= len(digits(m)) <= 15),
    )
    return [(k, *m.span()) for k, (pattern, test) in enumerate(tests) for m in re.finditer(pattern, text) if test(m)]


def test_base_matches_of_random_texts():
    rng = random.Random(4)
    pieces = ["a", "b.c", "@", ".", "1", "25", "255", "256", "4111 1111 1111 1111", "4111-1111", "+", "+1 ", "(555)", "-", " ",
              "x@y.zz", "1.2.3.4", "..", "%", "é", "00000000000001", "\n", "+44 20 7946 0958", ".5", "--1", "@@"]
    for _ in range(20_000):
        text = "".join(rng.choices(pieces, k=rng.randrange(1, 14)))
        assert pii.base_spans(text) == plain(text), text


@pytest.mark.parametrize("text", ["1" * 400_000, "a" * 400_000 + "@", "a@" * 200_000, "+1" + " " * 400_000, "1." * 200_000, "1 " * 200_000, "@a." * 100_000])
def test_linear_time_on_long_runs(text):
    import time

    start = time.time()
    pii.base_spans(text)
    pii.occurrences(text)
    assert time.time() - start < 5


def rows_of(spark, texts, **options):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r for r in pii.personal_data(df, **options).collect()}


def test_contexts_lead_to_identifiers_of_other_forms(spark):
    """Seeds make "call me on" trusted; a local number found there makes "my number is" trusted."""
    seeds, local = [f"+1 212 555 {i:04d}" for i in range(1000, 1080)], [f"020 7946 {i:04d}" for i in range(12)]
    texts = [f"please call me on {n} today" for n in seeds + local]
    texts += [f"well my number is {n}." for n in local] + ["well my number is 030 1234 5678!"]
    texts += ["invoice total 7946 0001 2222 paid", "my number is unknown", None, "", "call me on 5"]
    got = rows_of(spark, texts)
    assert all(got[i].n_phone == 1 and got[i].n_found == 0 for i in range(80))
    for i in range(80, 105):
        assert (got[i].spans, got[i].n_phone, got[i].n_found) == ("phone:18:31", 0, 1)
    for i in range(105, 110):
        assert (got[i].spans, got[i].n_found) == ("", 0)
    assert rows_of(spark, texts, rounds=1)[104].spans == ""


def test_patterns_of_mixed_company_are_not_trusted(spark):
    texts = [f"sent to ann{i}@example.org now" for i in range(5)] + [f"sent to 10.0.0.{i} now" for i in range(5)]
    texts += ["sent to bob@localhost now", "sent to 4444 5555 666 now"]
    got = rows_of(spark, texts)
    assert got[10].spans == "" and got[11].spans == ""
    texts = [f"write mail to ann{i}@example.org now" for i in range(8)] + ["write mail to bob@localhost now"]
    assert rows_of(spark, texts)[8].spans == "email:14:27"


def test_whole_table_keeps_the_base_matches(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    got = {r.doc_id: r for r in pii.personal_data(spark.read.parquet(path)).collect()}
    table = pq.read_table(path, columns=["doc_id", "text"]).to_pylist()
    assert len(got) == len(table)
    for row in table:
        spans = plain(row["text"] or "")
        joined = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in spans)
        r = got[row["doc_id"]]
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for k, _, _ in spans) for i in range(4)]
        assert set(filter(None, joined.split(","))) <= set(r.spans.split(","))


def test_repeated_rows_clashing_columns_and_no_rows(spark):
    text = "Mail a.b@example.com, é 10.1.2.3"
    df = spark.createDataFrame(
        [(1, text, "x", 5), (1, text, "y", 6), (None, text, None, None), (2, None, "z", 1)],
        "doc_id long, text string, row string, kind long",
    )
    got = pii.personal_data(df).collect()
    assert sorted((r.doc_id or -1, r.spans) for r in got) == [(-1, "email:5:20,ip:24:32"), (1, "email:5:20,ip:24:32"), (1, "email:5:20,ip:24:32"), (2, "")]
    assert pii.personal_data(df.limit(0)).count() == 0
