"""Token-id files: static range asymmetric numeral system (rANS) over interleaved blocks.

File layout (little-endian). ``FOGRANS1``, then segments, then a footer. A segment holds one
frequency table, shared by its blocks, and the blocks. A block codes up to ``BLOCK`` ids with
``lanes`` interleaved states (id ``t`` belongs to lane ``t % lanes``), is independent of all
other blocks, and carries CRC-32 sums of its bytes and of its ids. The footer lists a
checkpoint per block (first id, count, byte offset, table offset) and the documents (id,
count of ids), so any block, range of ids or document can be decoded alone and in parallel.

Coding. Frequencies are scaled to 2**20 with at least 1 for an id that occurs; states are
64-bit and give off 32-bit words. A step of all lanes is one numpy expression, so the cost
per id is a few array operations.

Defined cases: a null text is the empty one, i.e. only the end id; a null document id is
kept as null and comes first; repeated ids keep one entry per row, ordered by text; an
empty table gives no file and reads as no rows. Files are written under a temporary name
and renamed, so a repeated task replaces its file by the same bytes.
"""

from __future__ import annotations

import posixpath
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fogon.llm.common import docs_of, emit, in_key_order
from fogon.llm.tokens import encoder

MAGIC = b"FOGRANS1"
SCALE = 20
BLOCK = 1 << 18
LANES = 1024
#: Ids of one segment; with its table the most a task holds.
SEGMENT = 16 * BLOCK
#: Ids below this are looked up in an array, larger ones by bisection.
_DENSE = 1 << 22
_LOW = np.uint64(1 << 31)
_BLOCK_HEAD = struct.Struct("<IIIIII")
_CHECKPOINT = np.dtype([("first", "<u8"), ("count", "<u4"), ("at", "<u8"), ("table", "<u8")])
_DOCUMENT = np.dtype([("id", "<i8"), ("known", "u1"), ("count", "<u8")])


# ---- frequency tables -------------------------------------------------------------


def scaled(counts: np.ndarray) -> np.ndarray:
    """Counts as frequencies that add up to 2**SCALE, none of an occurring id below 1."""
    total, goal = counts.sum(), 1 << SCALE
    freq = np.where(counts > 0, np.maximum(1, counts * goal // max(1, total)), 0).astype("int64")
    short = goal - freq.sum()
    if short > 0:
        freq[np.argmax(freq)] += short
    while short < 0:  # the ones rounded up are taken from the largest
        big = np.argsort(-freq, kind="stable")[: min(-short, int((freq > 1).sum()))]
        take = np.minimum(freq[big] - 1, -(-(-short) // len(big)))
        take = np.where(np.cumsum(take) <= -short, take, np.maximum(0, -short - (np.cumsum(take) - take)))
        freq[big] -= take
        short = goal - freq.sum()
    return freq


class Table:
    """Shared frequency table of a segment."""

    def __init__(self, symbols: np.ndarray, freq: np.ndarray):
        self.symbols, self.freq = symbols.astype("<u4"), freq.astype("uint64")
        self.start = np.concatenate(([0], np.cumsum(self.freq)[:-1])).astype("uint64")
        self._slots: np.ndarray | None = None
        self._places: np.ndarray | None = None

    @classmethod
    def of(cls, ids: np.ndarray) -> Table:
        if len(ids) and int(ids.max()) < _DENSE:
            counts = np.bincount(ids)
            symbols = np.flatnonzero(counts)
            counts = counts[symbols]
        else:
            symbols, counts = np.unique(ids, return_counts=True)
        return cls(symbols, scaled(counts.astype("int64")))

    def codes(self, ids: np.ndarray) -> np.ndarray:
        """Place of each id in the table."""
        if not len(self.symbols) or int(self.symbols[-1]) >= _DENSE:
            return np.searchsorted(self.symbols, ids)
        if self._places is None:
            self._places = np.zeros(int(self.symbols[-1]) + 1, dtype="uint32")
            self._places[self.symbols] = np.arange(len(self.symbols), dtype="uint32")
        return self._places[ids]

    @property
    def slots(self) -> np.ndarray:
        if self._slots is None:
            self._slots = np.repeat(np.arange(len(self.freq), dtype="uint32"), self.freq.astype("int64"))
        return self._slots

    def to_bytes(self) -> bytes:
        raw = zlib.compress(np.diff(self.symbols, prepend=np.uint32(0)).astype("<u4").tobytes() + self.freq.astype("<u4").tobytes(), 6)
        return struct.pack("<III", len(self.symbols), len(raw), zlib.crc32(raw)) + raw

    @classmethod
    def from_bytes(cls, head: bytes, read) -> Table:
        n, size, crc = struct.unpack("<III", head)
        raw = read(size)
        if zlib.crc32(raw) != crc:
            raise ValueError("frequency table is damaged")
        both = np.frombuffer(zlib.decompress(raw), dtype="<u4")
        return cls(np.cumsum(both[:n], dtype="uint32"), both[n:])


# ---- blocks -----------------------------------------------------------------------


def encode_block(ids: np.ndarray, table: Table) -> bytes:
    """One block: header, lane states, words in decoding order."""
    n = len(ids)
    lanes = max(1, min(LANES, n // 64))
    code = table.codes(ids)
    freq, start = table.freq[code], table.start[code]
    limit = freq << np.uint64(31 - SCALE + 32)
    state = np.full(lanes, _LOW, dtype="uint64")
    words: list[np.ndarray] = []
    for row in range((n - 1) // lanes, -1, -1):
        a, b = row * lanes, min(n, (row + 1) * lanes)
        x, f = state[: b - a], freq[a:b]
        full = x >= limit[a:b]
        if full.any():
            words.append(x[full].astype("<u4"))
            x = np.where(full, x >> np.uint64(32), x)
        q = x // f
        state[: b - a] = (q << np.uint64(SCALE)) + (x - q * f) + start[a:b]
    words.reverse()
    body = state.astype("<u8").tobytes() + (np.concatenate(words).tobytes() if words else b"")
    raw = ids.astype("<u4").tobytes()
    return _BLOCK_HEAD.pack(n, lanes, len(body), zlib.crc32(body), zlib.crc32(raw), 0) + body


def decode_block(head: bytes, body: bytes, table: Table) -> np.ndarray:
    n, lanes, size, crc, ids_crc, _ = _BLOCK_HEAD.unpack(head)
    if len(body) != size or zlib.crc32(body) != crc:
        raise ValueError("block is damaged")
    state = np.frombuffer(body, dtype="<u8", count=lanes).astype("uint64")
    words = np.frombuffer(body, dtype="<u4", offset=8 * lanes).astype("uint64")
    slots, freq, start = table.slots, table.freq, table.start
    code = np.empty(n, dtype="uint32")
    mask, at = np.uint64((1 << SCALE) - 1), 0
    for a in range(0, n, lanes):
        b = min(n, a + lanes)
        x = state[: b - a]
        slot = x & mask
        s = slots[slot]
        code[a:b] = s
        x = freq[s] * (x >> np.uint64(SCALE)) + slot - start[s]
        low = x < _LOW
        k = int(np.count_nonzero(low))
        if k:
            x[low] = (x[low] << np.uint64(32)) | words[at : at + k]
            at += k
        state[: b - a] = x
    ids = table.symbols[code]
    if zlib.crc32(ids.astype("<u4").tobytes()) != ids_crc:
        raise ValueError("decoded ids differ from what was written")
    return ids


# ---- files ------------------------------------------------------------------------


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if ":/" in path else f"file://{path}")


class TokenFileWriter:
    """Writes documents in the order given; holds one segment."""

    def __init__(self, path: str):
        self.fs, self.path = _filesystem(path)
        self.fs.create_dir(posixpath.dirname(self.path), recursive=True)
        self.temporary = f"{self.path}.{uuid.uuid4().hex}.part"
        self.out = self.fs.open_output_stream(self.temporary)
        self.out.write(MAGIC)
        self.held: list[bytes] = []
        self.n_held = self.n_ids = 0
        self.checkpoints: list[tuple] = []
        self.documents: list[tuple] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.documents.append((doc_id or 0, doc_id is not None, len(ids) // 4))
        view = memoryview(ids)
        while view:
            part = view[: 4 * (SEGMENT - self.n_held)]
            self.held.append(bytes(part))
            self.n_held += len(part) // 4
            view = view[len(part) :]
            if self.n_held == SEGMENT:
                self._flush()

    def _flush(self) -> None:
        if not self.n_held:
            return
        ids = np.frombuffer(b"".join(self.held), dtype="<u4")
        table = Table.of(ids)
        table_at = self.out.tell()
        self.out.write(table.to_bytes())
        for a in range(0, len(ids), BLOCK):
            block = ids[a : a + BLOCK]
            self.checkpoints.append((self.n_ids, len(block), self.out.tell(), table_at))
            self.out.write(encode_block(block, table))
            self.n_ids += len(block)
        self.held, self.n_held = [], 0

    def close(self) -> tuple[int, int]:
        """Numbers of documents and ids."""
        self._flush()
        points = np.array(self.checkpoints, dtype=_CHECKPOINT).tobytes()
        documents = zlib.compress(np.array(self.documents, dtype=_DOCUMENT).tobytes(), 6)
        raw = struct.pack("<QQQ", len(self.checkpoints), len(self.documents), self.n_ids) + points + documents
        self.out.write(raw + struct.pack("<II", len(raw), zlib.crc32(raw)) + MAGIC)
        self.out.close()
        self.fs.move(self.temporary, self.path)
        return len(self.documents), self.n_ids


class TokenFile:
    """Reads a file: whole and streaming, or any range of ids by its checkpoints."""

    def __init__(self, path: str):
        fs, path = _filesystem(path)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        self.file.seek(size - 16)
        length, crc, magic = struct.unpack("<II8s", self.file.read(16))
        self.file.seek(size - 16 - length)
        raw = self.file.read(length)
        if magic != MAGIC or zlib.crc32(raw) != crc:
            raise ValueError(f"not a whole token file: {path}")
        points, documents, self.n_ids = struct.unpack_from("<QQQ", raw)
        self.checkpoints = np.frombuffer(raw, dtype=_CHECKPOINT, count=points, offset=24)
        rest = zlib.decompress(raw[24 + self.checkpoints.nbytes :])
        self.documents = np.frombuffer(rest, dtype=_DOCUMENT, count=documents)
        self._table: tuple[int, Table] | None = None

    def _table_at(self, at: int) -> Table:
        if self._table is None or self._table[0] != at:
            self.file.seek(at)
            self._table = (at, Table.from_bytes(self.file.read(12), self.file.read))
        return self._table[1]

    def blocks(self, first: int = 0, last: int | None = None) -> Iterator[tuple[int, np.ndarray]]:
        """(number of the first id, ids) of the blocks that meet [first, last)."""
        last = self.n_ids if last is None else last
        for p in self.checkpoints:
            if int(p["first"]) < last and int(p["first"]) + int(p["count"]) > first:
                table = self._table_at(int(p["table"]))
                self.file.seek(int(p["at"]))
                head = self.file.read(_BLOCK_HEAD.size)
                yield int(p["first"]), decode_block(head, self.file.read(_BLOCK_HEAD.unpack(head)[2]), table)

    def read(self, first: int, last: int) -> np.ndarray:
        parts = [ids[max(0, first - at) : last - at] for at, ids in self.blocks(first, last)]
        return np.concatenate(parts) if parts else np.empty(0, "<u4")

    def rows(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(document id, ids before it in the file, its ids), holding one block and one text."""
        blocks, held, begin = self.blocks(), np.empty(0, "<u4"), 0
        for d in self.documents:
            need, parts = int(d["count"]), []
            while need > len(held):
                parts.append(held)
                need -= len(held)
                held = next(blocks)[1]
            parts.append(held[:need])
            held = held[need:]
            yield (int(d["id"]) if d["known"] else None), begin, np.concatenate(parts)
            begin += int(d["count"])


# ---- Spark jobs -------------------------------------------------------------------

_WRITTEN = pa.schema([("pid", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
_READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int, rows: int = 8192) -> list[tuple]:
    """Encode ``docs`` (doc_id, text) into files of ``folder`` in ascending id order.

    Returns (path, ids before the file, documents, ids) per file: one entry for each range
    of ids, which is all that passes through the driver.
    """
    end = struct.pack("<I", end_id)

    def work(batches):
        def files():
            writer = pid = None
            for p, _, doc_id, text in docs_of(batches):
                if p != pid:
                    if writer is not None:
                        yield pid, path, *writer.close()
                    pid, path = p, f"{folder}/part-{p:06d}.rans"
                    writer = TokenFileWriter(path)
                writer.add(doc_id, encoder(tokenizer).encode(text) + end)
            if writer is not None:
                yield pid, path, *writer.close()

        yield from emit(files(), _WRITTEN)

    ordered = in_key_order(docs, "doc_id", ["text"], rows)
    found = ordered.mapInArrow(work, "pid long, path string, n_docs long, n_ids long").collect()
    out, before = [], 0
    for f in sorted(found, key=lambda f: f.pid):
        out.append((f.path, before, f.n_docs, f.n_ids))
        before += f.n_ids
    return out


def read_token_files(spark: SparkSession, files: list[tuple], digest: bool = False) -> DataFrame:
    """Documents of files as (doc_id, start, n_tokens, ids); a task takes whole files.

    ``ids`` are little-endian uint32 bytes; with ``digest`` their unsigned CRC-32 as
    ``ids_crc32`` instead, so ids need not leave the task that decodes them.
    """
    schema = pa.schema([*list(_READ)[:3], ("ids_crc32", pa.int64())]) if digest else _READ

    def work(batches):
        def rows():
            for path, before in docs_of(batches):
                for doc_id, begin, ids in TokenFile(path).rows():
                    raw = ids.astype("<u4").tobytes()
                    yield doc_id, before + begin, len(ids), zlib.crc32(raw) if digest else raw

        yield from emit(rows(), schema, 1000)

    names = "doc_id long, start long, n_tokens long, " + ("ids_crc32 long" if digest else "ids binary")
    if not files:
        return spark.createDataFrame([], names)
    paths = spark.createDataFrame(
        [(p, b, n) for n, (p, b, _, _) in enumerate(files)], "path string, before long, n int"
    )
    return paths.repartitionById(len(files), F.col("n")).select("path", "before").mapInArrow(work, names)
