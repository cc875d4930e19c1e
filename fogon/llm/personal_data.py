"""Personal data by bootstrapped contextual extraction.

Seeds are what the base expressions find: e-mail addresses, IPv4 addresses, payment cards
with a right check digit, and phone numbers with a country code. Every seed, and every other
token that looks like an identifier (it has a digit or an ``@``), stands in lexical patterns:
the two words before it, and the words on both sides. Patterns and instances (the tokens,
case-folded) are the two sides of a graph whose edges are counted over the corpus, and Spark
scores the sides in turn:

* a pattern's confidence for a kind is the mean score of its distinct instances for that kind,
  over all its instances of whatever kind or none, with ``PRIOR`` instances of score 0 added;
* an instance that is no seed gets the highest confidence of its patterns, if that reaches
  ``LEAST_CONFIDENCE`` and the token has the form of the kind; else 0.

Seeds keep score 1. A pattern needs ``LEAST_SEEDS`` distinct scored instances. After each round
instances found by one pattern support the next ones, as identifiers of new forms do: a local
phone number after "call me on" is not a seed, but lets "my number is" be trusted. Rounds end
when no instance changes its kind or score, at the latest after ``rounds``. An occurrence is reported if its
instance has a kind and one of its own patterns is confident of that kind, so the same digits
elsewhere are left alone.

The graph is joins and grouped sums over occurrences, which are far fewer than words; common
patterns and instances are pre-aggregated and nothing is gathered. Spans return to their
documents by the row's number.

Base matches are leftmost and do not overlap within a kind, and a match that fails a test is
dropped without a second try. The expressions run in linear time on any text.

Defined cases: null texts are empty and have no spans; a row of a repeated or null id is a row
of its own; spans are code points, end exclusive; a found span never overlaps a base span;
an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fogon.llm.common import write_stage

KINDS = ("email", "ip", "card", "phone")
LEAST_SEEDS = 3
LEAST_CONFIDENCE = 0.8
PRIOR = 0.25

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MARK = re.compile("[0-9@]")
_DIGITS = re.compile("[0-9]")
_TOKEN_END = re.compile(r"\s|\Z")
_WORD = re.compile(r"\S++")
_TRIM = ".,;:!?()[]{}<>\"'"


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """An @ with a domain, and the run of local characters before it."""
    end = 0
    at = text.find("@")
    while at >= 0:
        domain = _DOMAIN.match(text, at)
        if domain:
            before = text[end:at]
            start = end + len(before.rstrip(_LOCAL))
            if start < at:
                yield start, domain.end()
                end = domain.end()
        following = text.find("@", at + 1)
        end = max(end, at + 1)  # no local part reaches over an @
        at = following


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") for p in m.groups()]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            yield m.span()


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and _luhn(digits):
                yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 9 <= len(_DIGITS.findall(m.group())) <= 15:
            yield m.span()


_FINDERS = (_emails, _ips, _cards, _phones)


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of the base expressions, by kind, then start."""
    if not text or not _MARK.search(text):
        return []
    return [(kind, *span) for kind, finder in enumerate(_FINDERS) for span in finder(text)]


def _others(text: str, taken: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Tokens with a digit or @ that touch no base span, without the punctuation around them;
    groups of digits with single blanks between them are one token."""
    at = 0
    while m := _MARK.search(text, at):
        left = m.start()
        while left > at and not text[left - 1].isspace():
            left -= 1
        group = _CARD.match(text, m.start())
        stop = max(_TOKEN_END.search(text, m.start()).start(), group.end() if group else 0)
        stop = _TOKEN_END.search(text, stop).start()
        at = stop
        token = text[left:stop]
        start = left + len(token) - len(token.lstrip(_TRIM))
        end = left + len(token.rstrip(_TRIM))
        if end - start >= 5 and not any(start < e and s < end for s, e in taken):
            yield start, end


def _neighbours(text: str, start: int, end: int) -> tuple[str, str, str]:
    """The two words before a span and the one after it, bare and in small letters. A word is
    looked for within 64 code points, so the cost of an occurrence is bounded; a longer word is
    taken by its near end."""
    before = _WORD.findall(text[max(0, start - 64) : start])[-2:]
    after = _WORD.findall(text[end : end + 64])[:1]
    bare = [w.strip(_TRIM).casefold() for w in (["", "", *before])[-2:] + (after or [""])]
    return bare[0], bare[1], bare[2]


_OCCURRENCE = pa.struct([
    ("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("instance", pa.string()),
    ("patterns", pa.list_(pa.string())), ("forms", pa.list_(pa.int32())),
])
_ROWS = pa.schema([("doc_id", pa.int64()), ("occurrences", pa.list_(_OCCURRENCE))])
_ROWS_DDL = (
    "doc_id long, occurrences array<struct<kind:int,start:bigint,end:bigint,instance:string,"
    "patterns:array<string>,forms:array<int>>>"
)


def _forms(token: str) -> list[int]:
    """Kinds whose form a token has that is no seed: an @, dotted or coloned groups, or seven
    digits and more without letters."""
    n = len(_DIGITS.findall(token))
    out = [0] if "@" in token.strip("@") else []
    if re.fullmatch(r"[0-9A-Fa-f]*(?:[.:][0-9A-Fa-f]*){3,7}", token) and n >= 4:
        out.append(1)
    if re.fullmatch(r"[0-9+().\x20/-]+", token):
        out += [2] if 12 <= n <= 19 else []
        out += [3] if 7 <= n <= 15 else []
    return out


def occurrences(text: str | None) -> list[tuple]:
    """Seeds and other identifier-like tokens with their patterns; kind -1 for the others."""
    base = base_spans(text)
    if not text or not (base or _MARK.search(text)):
        return []
    # A token under two seeds (a card inside a phone number) counts for both.
    found = [(kind, s, e, []) for kind, s, e in base]
    for s, e in _others(text, sorted((s, e) for _, s, e in base)):
        found.append((-1, s, e, _forms(text[s:e])))
    out = []
    for kind, s, e, forms in found:
        far, near, after = _neighbours(text, s, e)
        patterns = ([f"{far} {near} _"] if near else []) + ([f"{near} _ {after}"] if near and after else [])
        out.append((kind, s, e, text[s:e].casefold(), patterns, forms))
    return out


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.name for f in _OCCURRENCE]
    for batch in batches:
        rows = [
            [dict(zip(names, o, strict=True)) for o in occurrences(text)] for text in batch.column(1).to_pylist()
        ]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, _ROWS.field(1).type)], schema=_ROWS)


def _confidence(edges: DataFrame, scores: DataFrame) -> DataFrame:
    """(pattern, kind, confidence) of the patterns to trust."""
    supported = edges.join(scores, "instance").groupBy("pattern", "kind").agg(
        F.sum("score").alias("score"), F.count("*").alias("support")
    )
    sizes = edges.groupBy("pattern").agg(F.count("*").alias("instances"))
    confidence = F.col("score") / (F.col("instances") + PRIOR)
    return supported.where(F.col("support") >= LEAST_SEEDS).join(sizes, "pattern").select(
        "pattern", "kind", confidence.alias("confidence")
    ).where(F.col("confidence") >= LEAST_CONFIDENCE)


def bootstrap(found: DataFrame, rounds: int = 6) -> tuple[DataFrame, list[str]]:
    """(row, kind, start, end) of identifiers that are no seeds, from (row, kind, start, end,
    instance, patterns, forms); also the folders it reads."""
    spark = found.sparkSession
    edges = found.select("instance", F.explode("patterns").alias("pattern")).distinct()
    edges_path = write_stage(edges, "pii-edges")
    edges = spark.read.schema(edges.schema).parquet(edges_path)
    seeds = found.where("kind >= 0").select("instance", "kind").distinct().withColumn("score", F.lit(1.0))
    forms = found.where("kind < 0").select("instance", F.explode("forms").alias("kind")).distinct()
    forms = forms.join(seeds.select("instance").distinct(), "instance", "left_anti")
    known = None
    paths = [edges_path]
    for _ in range(rounds):
        trusted = _confidence(edges, seeds if known is None else seeds.unionByName(known))
        # The kind with the highest confidence; equal ones go to the first kind.
        best = F.max_by(F.struct("kind", "confidence"), F.struct("confidence", -F.col("kind"))).alias("best")
        named = (
            edges.join(forms, "instance").join(trusted, ["pattern", "kind"]).groupBy("instance").agg(best)
            .select("instance", "best.kind", F.round("best.confidence", 3).alias("score"))
        )
        path = write_stage(named, "pii-instances")
        paths.append(path)
        following = spark.read.schema(named.schema).parquet(path)
        if known is None:
            same = not following.limit(1).count()
        else:
            keys = ["instance", "kind", "score"]
            same = not (following.join(known, keys, "left_anti").limit(1).count() + known.join(following, keys, "left_anti").limit(1).count())
        known = following
        if same:
            break
    trusted = _confidence(edges, seeds.unionByName(known))
    occurrence = found.where("kind < 0").select("row", "start", "end", "instance", F.explode("patterns").alias("pattern"))
    new = (
        occurrence.join(known.select("instance", "kind"), "instance").join(trusted, ["pattern", "kind"])
        .select("row", "kind", "start", "end").distinct()
    )
    return new, paths


def _joined(spans: Column) -> Column:
    name = F.element_at(F.array(*[F.lit(k) for k in KINDS]), spans["kind"] + 1)
    return F.concat_ws(":", name, spans["start"].cast("string"), spans["end"].cast("string"))


def personal_data(docs: DataFrame, rounds: int = 6) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base matches), base_sha256, spans (base and found
    ones as kind:start:end, by kind, then start) and n_found for every row of (doc_id, text).
    The folders that the result reads stay in the shared staging folder.
    """
    spark = docs.sparkSession
    made = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_find, _ROWS_DDL)
    numbered = made.withColumn("row", F.monotonically_increasing_id())
    path = write_stage(numbered, "pii-rows")
    rows = spark.read.schema(numbered.schema).parquet(path)
    found = rows.where(F.size("occurrences") > 0).select("row", F.explode("occurrences").alias("x")).select("row", "x.*")
    new, _ = bootstrap(found, rounds)
    span = F.struct("kind", "start", "end")
    extra = new.groupBy("row").agg(F.collect_set(span).alias("extra"))
    base = F.transform(
        F.filter("occurrences", lambda x: x["kind"] >= 0), lambda x: F.struct(x["kind"], x["start"], x["end"])
    )

    def count_of(kind: int) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")

    held = rows.select("row", "doc_id", base.alias("base")).join(extra, "row", "left")
    every = F.array_sort(F.concat("base", F.coalesce("extra", F.filter("base", lambda x: F.lit(False)))))
    return held.select(
        "doc_id",
        *[count_of(i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.sha2(F.array_join(F.transform("base", _joined), ","), 256).alias("base_sha256"),
        F.array_join(F.transform(every, _joined), ",").alias("spans"),
        F.size(F.coalesce("extra", F.array())).cast("long").alias("n_found"),
    )
