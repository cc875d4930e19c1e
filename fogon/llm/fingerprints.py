"""Document fingerprints: a Merkle tree over paragraphs and sections.

Tree. A text is cut at line breaks into paragraphs (each keeps its break). A section ends
at a blank line, or after a paragraph whose hash is 0 modulo 8, so an edit moves no other
section border. The leaves below a paragraph are runs of words that end where a word's hash
is 0 modulo 4 (about four words). Each node has a 128-bit digest: a paragraph's covers its leaf
hashes and its exact text, a section's the digests of its paragraphs, the root's those of all
sections; equal roots mean equal texts. A branch (:func:`branch`) holds the digests beside the way from
a paragraph to the root, so :func:`belongs` checks a paragraph against a root without the text.

The fingerprint is text: ``root:/SECTION.PARAGRAPH LEAVES...`` where the root is 128 bits in
hex; the digests of sections and paragraphs are cut to 11 and 6 URL-safe base64 digits, leaf hashes
have 4. It alone
is enough to compare two texts (:func:`likeness`) and to locate edits (:func:`changed`).

Defined cases: a null text is fingerprinted as the empty one; the empty text has a root and
no section; a text without words has paragraphs without leaves. Repeated texts get equal
fingerprints. Texts are processed whole, row by row, so memory is bounded by one text.
"""

from __future__ import annotations

import base64
import hashlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fogon.llm.common import Interned, docs_of, emit, in_key_order, word_bytes

_SECTION, _PARAGRAPH, _LEAF = 11, 6, 4
_DIGITS = np.frombuffer(
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", dtype="uint8"
)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_WORDS = Interned(lambda w: xxhash.xxh3_64_intdigest(w))


#: (paragraph digest, its digits with those of its leaves)
Leafed = tuple[bytes, str]
#: Digests beside a paragraph: before and after it in its section, sections before and after that one.
Branch = tuple[list[bytes], list[bytes], list[bytes], list[bytes]]


def _digits(digest: bytes, n: int) -> str:
    return base64.urlsafe_b64encode(digest[:9]).decode()[:n]


def _digest(level: bytes, *parts: bytes) -> bytes:
    """128-bit digest of a node; nodes of different levels never agree."""
    return hashlib.blake2b(b"".join(parts), digest_size=16, person=level).digest()


def _paragraph_digest(raw: bytes, leaves: str) -> bytes:
    return _digest(b"paragraph", len(leaves).to_bytes(8, "big"), leaves.encode(), raw)


def _leaves(paragraphs: list[str]) -> list[str]:
    """Leaf hashes of each paragraph, four digits a leaf; one pass over the whole text."""
    cut = [word_bytes(p) for p in paragraphs]
    sizes = np.fromiter(map(len, cut), dtype="int64", count=len(cut))
    n = int(sizes.sum())
    if not n:
        return [""] * len(paragraphs)
    h = np.fromiter(map(_WORDS.__getitem__, chain.from_iterable(cut)), dtype="uint64", count=n)
    borders = np.cumsum(sizes)
    ends = (h & np.uint64(3)) == 0
    ends[borders[sizes > 0] - 1] = True  # a leaf never leaves its paragraph
    stops = np.flatnonzero(ends) + 1
    starts = np.concatenate(([0], stops[:-1]))
    # Order within a leaf counts: word i of a leaf is multiplied by an odd number of its place.
    place = np.arange(n) - np.repeat(starts, stops - starts)
    mixed = h * (place.astype("uint64") * np.uint64(2) + np.uint64(1))
    leaf = np.add.reduceat(mixed, starts) * _MIX
    leaf ^= leaf >> np.uint64(32)
    codes = np.stack([(leaf >> np.uint64(6 * i)) & np.uint64(63) for i in range(_LEAF)], axis=1)
    digits = _DIGITS[codes.astype("int64")].tobytes().decode()
    upto = (np.searchsorted(stops, borders, side="right") * _LEAF).tolist()
    return [digits[a:b] for a, b in zip([0, *upto[:-1]], upto, strict=True)]


def _tree(text: str | None) -> list[list[Leafed]]:
    """Sections of a text as lists of their paragraphs."""
    sections: list[list[Leafed]] = []
    ended = True
    paragraphs = (text or "").splitlines(keepends=True)
    for paragraph, leaves in zip(paragraphs, _leaves(paragraphs), strict=True):
        if ended:
            sections.append([])
        own = _paragraph_digest(paragraph.encode("utf-8", "surrogatepass"), leaves)
        sections[-1].append((own, _digits(own, _PARAGRAPH) + leaves))
        ended = own[-1] % 8 == 0 or not paragraph.strip()
    return sections


def _section_digest(section: list[Leafed]) -> bytes:
    return _digest(b"section", *(d for d, _ in section))


def fingerprint(text: str | None) -> str:
    sections = _tree(text)
    digests = [_section_digest(section) for section in sections]
    body = (
        "/" + _digits(digest, _SECTION) + "".join("." + digits for _, digits in section)
        for digest, section in zip(digests, sections, strict=True)
    )
    return _digest(b"root", *digests).hex() + ":" + "".join(body)


def branch(text: str | None, number: int) -> Branch:
    """The digests that lead from paragraph ``number`` (from 0) to the root."""
    sections = _tree(text)
    digests = [_section_digest(section) for section in sections]
    for i, section in enumerate(sections):
        if number < len(section):
            own = [d for d, _ in section]
            return own[:number], own[number + 1 :], digests[:i], digests[i + 1 :]
        number -= len(section)
    raise IndexError(number)


def belongs(paragraph: str, way: Branch, fp: str) -> bool:
    """Whether a paragraph (with its line break) stands at the place of a branch below the root of a fingerprint."""
    left, right, before, after = way
    own = _paragraph_digest(paragraph.encode("utf-8", "surrogatepass"), _leaves([paragraph])[0])
    section = _digest(b"section", *left, own, *right)
    return _digest(b"root", *before, section, *after).hex() == fp[:32]


def _sections(fp: str) -> list[tuple[str, str]]:
    body = fp.partition(":")[2]
    return [(s[:_SECTION], s[_SECTION:]) for s in body.split("/")[1:]]


def _paragraphs(section: str) -> list[str]:
    return section.split(".")[1:]


def _weight(paragraph: str) -> int:
    """Leaves of a paragraph; one without words counts as one."""
    return max(1, (len(paragraph) - _PARAGRAPH) // _LEAF)


def likeness(a: str, b: str) -> float:
    """Share of leaves that two fingerprints have in common (Dice), 0 to 1.

    Equal branches are taken whole: first sections, then paragraphs, then leaves, so only
    differing branches are opened. 1 exactly for equal roots; 0 if one text is empty.
    """
    if a[:32] == b[:32]:
        return 1.0
    left, right = _sections(a), _sections(b)
    same = Counter(h for h, _ in left) & Counter(h for h, _ in right)
    total = common = 0
    rest: list[list[str]] = []
    for side in (left, right):
        open_, left_over = Counter(same), []
        for h, body in side:
            paragraphs = _paragraphs(body)
            weight = sum(map(_weight, paragraphs))
            total += weight
            if open_[h] > 0:
                open_[h] -= 1
                common += weight
            else:
                left_over += paragraphs
        rest.append(left_over)
    same = Counter(rest[0]) & Counter(rest[1])
    leaves: list[Counter] = []
    for side in rest:
        open_, counts = Counter(same), Counter()
        for p in side:
            if open_[p] > 0:
                open_[p] -= 1
                common += _weight(p)
            else:
                counts.update(p[i : i + _LEAF] for i in range(_PARAGRAPH, len(p), _LEAF))
        leaves.append(counts)
    common += 2 * sum((leaves[0] & leaves[1]).values())
    # A differing pair never reaches 1, even if only a blank or a mark was changed.
    return min(common / total, 1 - 1e-9) if total else 0.0


def changed(a: str, b: str) -> list[int]:
    """Numbers (from 0) of the paragraphs of ``a`` that ``b`` does not have."""
    if a[:32] == b[:32]:
        return []
    there = Counter(h for h, _ in _sections(b))
    out, n, open_ = [], 0, []
    for h, body in _sections(a):
        paragraphs = _paragraphs(body)
        if there[h] > 0:
            there[h] -= 1
        else:
            open_ += list(enumerate(paragraphs, n))
        n += len(paragraphs)
    gone = Counter(p for h, body in _sections(b) for p in _paragraphs(body) if there[h] > 0)
    for i, p in open_:
        if gone[p] > 0:
            gone[p] -= 1
        else:
            out.append(i)
    return out


def fingerprint_column(text) -> Column:
    """Fingerprint of a text column; null is fingerprinted as the empty text."""
    return F.pandas_udf(lambda s: s.map(fingerprint), "string")(text)


def edited_text(text: str, following: str) -> str:
    """The last quarter of the code points replaced by the first as many of the next text."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


_COMPARED = pa.schema(
    [
        ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()),
        ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
        ("near_edited", pa.float64()), ("near_next", pa.float64()), ("n_changed", pa.int64()),
    ]
)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        held = None
        for _, ghost, doc_id, text in docs_of(batches):
            text = text or ""
            own = fingerprint(text)
            if held is not None:
                yield pair(held, (doc_id, text, own))
            # A ghost only closes the row before it; more of them (repeated ids) add nothing.
            held = None if ghost else (doc_id, text, own)

    def pair(this, following):
        doc_id, text, own = this
        new = edited_text(text, following[1])
        new_fp = fingerprint(new)
        return (
            doc_id, len(text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(),
            own, new_fp, likeness(own, new_fp), likeness(own, following[2]),
            len(changed(own, new_fp)),
        )

    yield from emit(rows(), _COMPARED, 500)


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Fingerprint each document and its edited text and compare with both neighbours.

    The next document is the one that follows by (doc_id, text), nulls first; after the
    last comes the first, and a single document follows itself. One shuffle by ranges of
    the id; a task streams its range and holds two texts.
    """
    ordered = in_key_order(docs, "doc_id", ["text"], with_next=True)
    return ordered.mapInArrow(_compare, _spark_schema(_COMPARED))


def _spark_schema(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.int32(): "int", pa.string(): "string", pa.float64(): "double"}
    return ", ".join(f"`{f.name}` {names[f.type]}" for f in schema)
