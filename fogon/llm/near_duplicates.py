"""N-gram Jaccard join of documents by a MinHash LSH forest with exact verification.

Texts are sets of shingles of ``k`` words. Two texts are linked if their Jaccard similarity
is at least ``threshold``.

1. Classes. Texts with equal shingle sets are one class (a 128-bit hash of the set), found by
   one group-by; from here on a class is one row, whatever its number of copies.
2. Forest. Each class has ``trees`` MinHash sequences; as big-endian bytes they sort like
   the paths of a prefix trie per tree, and a prefix of a path is a node. Matching starts at
   the full depth. A class shortens its matched prefixes, tree by tree and value by value,
   where that brings in the fewest further classes, until the chance that a link at the
   threshold shares one of its prefixes reaches ``recall`` (:func:`matched_depths`). So a
   class in a quiet place is matched by short prefixes in every tree, one below crowded
   nodes keeps long prefixes in its most crowded trees (:func:`forest_nodes`). Classes
   below the same matched node are candidates.
3. Groups. Within a node (split over a hash if it is large) classes are compared with a few
   leaders by 8-bit MinHash agreement; those within six standard errors of the threshold are
   joined. Nodes whose members are then still in different groups are compared exhaustively
   between the groups, in blocks. Only spanning edges leave a task.
4. Verification. Each group is dealt out as pairs of blocks of bounded size; a task counts
   exact intersections and gives, per class, the number of linked documents and spanning
   edges of the exact links. So no pair is written, no group is gathered, and links inside
   a large group are all counted.
5. The connected components of exact links are the result's classes.

Defined cases: a text of fewer than ``k`` words, but not none, has one shingle of all its
words; texts without words are linked only to equal texts; a null text is linked to none;
repeated rows are copies of each other; a class id is the smallest document id in it (null
if all are null); an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fogon.llm.common import Interned, docs_of, drop_stage, emit, word_bytes, write_stage
from fogon.llm.components import components

TREES, DEPTH = 16, 5
_MIX = np.uint64(0x9E3779B97F4A7C15)
_EMPTY = np.empty(0, "uint64")
#: Rows and shingles of a block; a task holds two blocks.
BLOCK_ROWS, BLOCK_SHINGLES = 1024, 1 << 17
#: A trie node is crowded above this many classes; below, its prefix is shortened without asking.
CROWD = 64


def word_hashes() -> Interned:
    """Hashes of words, kept by a task for as long as it runs."""
    return Interned(xxhash.xxh3_64_intdigest)


def shingles(text: str | None, k: int = 5, known: Interned | None = None) -> np.ndarray:
    """Sorted distinct hashes of the text's runs of ``k`` words."""
    words = word_bytes(text)
    if not words:
        return _EMPTY
    hash_of = xxhash.xxh3_64_intdigest if known is None else known.__getitem__
    h = np.fromiter(map(hash_of, words), dtype="uint64", count=len(words))
    k = min(k, len(h))
    out = np.zeros(len(h) - k + 1, dtype="uint64")
    for i in range(k):
        out = (out ^ h[i : i + len(out)]) * _MIX
        out ^= out >> np.uint64(32)
    return np.unique(out)


def prefix_length(threshold: float, trees: int, depth: int, recall: float) -> int:
    """Longest prefix at which, used in every tree, a pair at the threshold is found with chance
    ``recall``: no prefix has to be shortened below it."""
    d = depth
    while d > 1 and 1 - (1 - threshold**d) ** trees < recall:
        d -= 1
    return d


def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(1, 2**63, n, dtype="uint64") | np.uint64(1), rng.integers(0, 2**63, n, dtype="uint64")


def signature(shingle_hashes: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> np.ndarray:
    """``trees * depth`` minima of multiply-shift hashes (upper 32 bits)."""
    a, b = _permutations(trees * depth)
    out = np.full(trees * depth, np.iinfo("uint32").max, dtype="uint32")
    for i in range(0, len(shingle_hashes), 2048):
        part = shingle_hashes[i : i + 2048]
        h = (part[None, :] * a[:, None] + b[:, None]) >> np.uint64(32)
        out = np.minimum(out, h.min(axis=1).astype("uint32"))
    return out


def paths_of(sig: np.ndarray) -> bytes:
    """The signature as bytes that sort like the values: the paths of all trees, one after another."""
    return sig.astype(">u4").tobytes()


def matched_depths(
    crowds: list[tuple[int, list[int]]], quiet: int, threshold: float, shortest: int, depth: int, recall: float
) -> dict[int, int]:
    """Tree -> length of the prefix by which a class is matched there.

    ``crowds`` holds, for each crowded tree, the classes below the class's nodes of lengths
    ``shortest`` to ``depth``; in ``quiet`` further trees it is matched at ``shortest``. A
    link at the threshold is missed by a tree with chance 1 - threshold^length. Prefixes are
    shortened one value at a time, the one that brings in the fewest classes first.
    """
    miss = {d: float(np.log1p(-(threshold**d))) for d in range(shortest, depth + 1)}
    at = {tree: depth for tree, _ in crowds}
    total = quiet * miss[shortest] + len(crowds) * miss[depth]
    steps = [(n[-2] - n[-1], tree) for tree, n in crowds] if depth > shortest else []
    heapq.heapify(steps)
    sizes = dict(crowds)
    while steps and total > np.log(1 - recall):
        _, tree = heapq.heappop(steps)
        at[tree] -= 1
        d = at[tree]
        total += miss[d] - miss[d + 1]
        if d > shortest:
            n = sizes[tree]
            heapq.heappush(steps, (n[d - 1 - shortest] - n[d - shortest], tree))
    return at


_SIGNED = pa.schema(
    [("doc_id", pa.int64()), ("mark", pa.int64()), ("key", pa.binary()), ("n", pa.int64()), ("paths", pa.binary()), ("bits", pa.binary())]
)


def _mark():
    """Tells texts of one id apart where a row is looked up again: ids may be null or repeated."""
    return F.xxhash64("text").alias("mark")


def _signed(docs: DataFrame, k: int) -> DataFrame:
    def work(batches):
        def rows():
            known = word_hashes()
            for doc_id, mark, text in docs_of(batches):
                own = shingles(text, k, known)
                if len(own):
                    sig = signature(own)
                    yield (
                        doc_id, mark, xxhash.xxh3_128_digest(own.tobytes()), len(own),
                        paths_of(sig), (sig & np.uint32(255)).astype("u1").tobytes(),
                    )
                else:
                    key = None if text is None else b"=" + xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass"))
                    yield doc_id, mark, key, 0, None, None

        yield from emit(rows(), _SIGNED, 1000)

    return docs.select(F.col("doc_id").cast("long"), _mark(), "text").mapInArrow(
        work, "doc_id long, mark long, key binary, n long, paths binary, bits binary"
    )


# ---- work inside tasks ------------------------------------------------------------


def groups_of(batches: Iterator[pa.RecordBatch], by: int) -> Iterator[tuple[tuple, list[list]]]:
    """Runs of rows with equal first ``by`` columns: (their values, the other columns)."""
    key, held = None, []
    for row in docs_of(batches):
        if row[:by] != key:
            if held:
                yield key, [list(c) for c in zip(*held, strict=True)]
            key, held = row[:by], []
        held.append(row[by:])
    if held:
        yield key, [list(c) for c in zip(*held, strict=True)]


class _Joined:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        a, b = self.root(i), self.root(j)
        self.up[max(a, b)] = min(a, b)
        return a != b


def _bits(rows: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(rows), dtype="u1").reshape(len(rows), -1)


_EDGE = pa.schema([("a", pa.binary()), ("b", pa.binary())])


def _leader_edges(least: float, leaders: int = 32):
    """Spanning edges between the members of a node part and the leaders they resemble.

    Linear work; the members come by key, so the trees tend to choose the same leaders and
    give the same edges.
    """

    def work(batches):
        def rows():
            for _, (keys, bits) in groups_of(batches, 2):
                table = _bits(bits)
                chosen: list[int] = []
                joined = _Joined(len(keys))
                for i in range(len(keys)):
                    like = (table[chosen] == table[i]).mean(axis=1) >= least if chosen else np.zeros(0, bool)
                    for j in np.flatnonzero(like).tolist():
                        if joined.join(i, chosen[j]):
                            yield keys[i], keys[chosen[j]]
                    if not like.any() and len(chosen) < leaders:
                        chosen.append(i)

        yield from emit(rows(), _EDGE, 5000)

    return work


def _cross_edges(least: float):
    """Spanning edges between members of different groups below one node, block by block."""

    def work(batches):
        def rows():
            for (_, i, j), (blocks, keys, roots, bits) in groups_of(batches, 3):
                table = _bits(bits)
                left = [p for p, b in enumerate(blocks) if b == i]
                right = [p for p, b in enumerate(blocks) if b == j]
                number = {r: n for n, r in enumerate(dict.fromkeys(roots))}
                group = np.array([number[r] for r in roots])
                joined = _Joined(len(number))
                for p in left:
                    other = [q for q in right if group[q] != group[p]]
                    if other:
                        like = (table[other] == table[p]).mean(axis=1) >= least
                        for q in np.array(other)[like].tolist():
                            if joined.join(int(group[p]), int(group[q])):
                                yield keys[p], keys[q]

        yield from emit(rows(), _EDGE, 5000)

    return work


def intersections(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two lists of sets, as dense products over shared elements."""
    sizes_a, sizes_b = [len(x) for x in a], [len(x) for x in b]
    every, place = np.unique(np.concatenate([*a, *b]), return_inverse=True)
    cut = sum(sizes_a)
    in_a, in_b = np.zeros(len(every), bool), np.zeros(len(every), bool)
    in_a[place[:cut]] = True
    in_b[place[cut:]] = True
    shared = np.flatnonzero(in_a & in_b)
    column = np.full(len(every), -1)
    column[shared] = np.arange(len(shared))
    row_a, col_a = np.repeat(np.arange(len(a)), sizes_a), column[place[:cut]]
    row_b, col_b = np.repeat(np.arange(len(b)), sizes_b), column[place[cut:]]
    out = np.zeros((len(a), len(b)), dtype="float32")
    for at in range(0, len(shared), 4096):
        sides = []
        for n, row, col in ((len(a), row_a, col_a), (len(b), row_b, col_b)):
            use = (col >= at) & (col < at + 4096)
            dense = np.zeros((n, min(4096, len(shared) - at)), dtype="float32")
            dense[row[use], col[use] - at] = 1
            sides.append(dense)
        out += sides[0] @ sides[1].T
    return out


_VERIFIED = pa.schema([("key", pa.binary()), ("links", pa.int64()), ("root", pa.binary())])


def _verify(threshold: float):
    """Per class of a block pair: linked documents on the other side, and a spanning edge."""

    def work(batches):
        def rows():
            for (_, i, j), columns in groups_of(batches, 3):
                # Repeated rows of a class's document bring its set more than once.
                once = list({key: p for p, key in enumerate(columns[1])}.values())
                blocks, keys, weights, sets = ([c[p] for p in once] for c in columns)
                arrays = [np.frombuffer(s, dtype="<u8") for s in sets]
                left = [p for p, b in enumerate(blocks) if b == i]
                right = [p for p, b in enumerate(blocks) if b == j]
                if not left or not right:
                    continue
                common = intersections([arrays[p] for p in left], [arrays[q] for q in right]).astype("float64")
                n_left = np.array([len(arrays[p]) for p in left])[:, None]
                n_right = np.array([len(arrays[q]) for q in right])[None, :]
                linked = common >= threshold * (n_left + n_right - common) - 1e-9
                if i == j:
                    np.fill_diagonal(linked, False)
                weight = np.array(weights, dtype="int64")
                joined = _Joined(len(keys))
                for p, row in zip(left, linked, strict=True):
                    for q in np.flatnonzero(row).tolist():
                        joined.join(p, right[q])
                counts = np.zeros(len(keys), dtype="int64")
                counts[left] += linked @ weight[right]
                if i != j:
                    counts[right] += linked.T @ weight[left]
                for p in np.flatnonzero(counts).tolist():
                    yield keys[p], int(counts[p]), keys[joined.root(p)]

        yield from emit(rows(), _VERIFIED, 5000)

    return work


# ---- Spark job --------------------------------------------------------------------


def _grouped(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.repartition(*keys).sortWithinPartitions(*keys)


def _in_block_pairs(df: DataFrame, blocks: str, by: list[str], rest: list[str]) -> DataFrame:
    """Rows with column ``blocks`` (number of blocks) copied to every pair (i <= j) they are in."""
    own = F.pmod(F.xxhash64("key"), F.col(blocks)).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col(blocks).cast("int") - 1)).alias("o")
    spread = df.withColumn("block", own).select("*", other)
    return spread.select(*by, F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "block", *rest)


def _part(parts: str):
    """Part of a large node that a class is in, so joins by node are dealt over its parts."""
    return F.pmod(F.xxhash64("key"), F.col(parts)).cast("int")


def _every_part(parts: str):
    return F.explode(F.sequence(F.lit(0), F.col(parts).cast("int") - 1)).alias("part")


def _by_node(rows: DataFrame, prefix, value, name: str) -> DataFrame:
    """``rows`` (tree, path, key, parts, ...) with an aggregate over each node ``prefix`` of a tree.

    One row per node and task is shuffled to aggregate; the join is dealt over node parts.
    """
    held = rows.withColumns({"prefix": prefix, "part": _part("parts")})
    # Nodes of one crowd share its number of parts.
    per_node = held.groupBy("tree", "prefix").agg(value.alias(name), F.first("parts").alias("parts"))
    spread = per_node.select("tree", "prefix", name, _every_part("parts"))
    return held.join(spread, ["tree", "prefix", "part"]).drop("prefix", "part")


def forest_nodes(classes: DataFrame, shortest: int, threshold: float, recall: float, crowd: int | None = None) -> tuple[DataFrame, list[str]]:
    """(node, key, m): the matched node of each class (key, paths) in each tree, ``m`` classes
    below it; nodes of one class are left out. Also the staged folders it reads.

    Nodes of at most ``crowd`` classes at the shortest prefix are matched there. Classes below
    crowded ones choose by :func:`matched_depths`; a node is matched if a class chose it, and
    every class below it joins, so a pair meets wherever either of the two has shortened.
    """
    crowd = CROWD if crowd is None else crowd
    spark, width, staged = classes.sparkSession, 4 * DEPTH, []

    def written(df: DataFrame, label: str) -> DataFrame:
        staged.append(write_stage(df, label))
        return spark.read.schema(df.schema).parquet(staged[-1])

    def prefix(d: int):
        return F.substring("path", 1, 4 * d)

    every = F.sequence(F.lit(0), F.lit(TREES - 1))
    rows = classes.select("key", "paths", F.explode(every).alias("tree")).select(
        "key", "tree", F.substr("paths", F.col("tree") * width + 1, F.lit(width)).alias("path")
    )
    sizes = rows.groupBy("tree", prefix(shortest).alias("prefix")).agg(F.count("*").alias("m")).where("m > 1")
    met = rows.withColumn("prefix", prefix(shortest)).join(sizes, ["tree", "prefix"])
    met = written(met.select("tree", "path", "key", "m"), "met")
    node = F.xxhash64("tree", "prefix").alias("node")
    quiet = met.where(F.col("m") <= crowd).withColumn("prefix", prefix(shortest)).select(node, "key", "m")

    crowded = met.where(F.col("m") > crowd).withColumn("parts", F.ceil(F.col("m") / BLOCK_ROWS))
    crowded = crowded.withColumnRenamed("m", f"m{shortest}")
    for d in range(shortest + 1, DEPTH + 1):
        crowded = _by_node(crowded, prefix(d), F.count("*"), f"m{d}")
    crowded = written(crowded, "crowded")

    @F.pandas_udf("array<struct<tree:int,depth:int>>")
    def choose(trees: pd.Series) -> pd.Series:
        def one(held) -> list[dict]:
            crowds = [(int(r["tree"]), [int(n) for n in r["n"]]) for r in held]
            at = matched_depths(crowds, TREES - len(crowds), threshold, shortest, DEPTH, recall)
            return [{"tree": t, "depth": d} for t, d in at.items()]

        return trees.map(one)

    # At most one row per tree for each class.
    counts = F.array(*(f"m{d}" for d in range(shortest, DEPTH + 1)))
    wanted = crowded.groupBy("key").agg(F.collect_list(F.struct("tree", counts.alias("n"))).alias("held"))
    chosen = wanted.select("key", F.explode(choose("held")).alias("c")).select("key", "c.tree", "c.depth")
    cut = written(crowded.join(chosen, ["key", "tree"]), "cut")
    # The shortest matched prefix above a class is its node: longer ones lie below it.
    for d in range(shortest, DEPTH):
        cut = _by_node(cut, prefix(d), F.min("depth"), f"least{d}")
    depth, m = F.lit(DEPTH), F.col(f"m{DEPTH}")
    for d in range(DEPTH - 1, shortest - 1, -1):
        depth = F.when(F.col(f"least{d}") <= d, d).otherwise(depth)
        m = F.when(F.col(f"least{d}") <= d, F.col(f"m{d}")).otherwise(m)
    deep = cut.select("tree", "path", "key", m.alias("m"), depth.alias("depth")).where("m > 1")
    deep = deep.withColumn("prefix", F.substr("path", F.lit(1), F.col("depth") * 4)).select(node, "key", "m")
    return quiet.unionByName(deep), staged


def text_key(text: str | None, k: int = 5) -> bytes | None:
    """Equal for texts of equal shingle sets; texts without words by the text, null for null."""
    own = shingles(text, k)
    if len(own):
        return xxhash.xxh3_128_digest(own.tobytes())
    return None if text is None else b"=" + xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass"))


def jaccard_join(
    docs: DataFrame, threshold: float = 0.8, k: int = 5, recall: float = 0.9999
) -> tuple[DataFrame, list[str]]:
    """(doc_id, class_id, n_links, key, group, mark) per row of (doc_id, text); also the staged
    folders it reads.

    ``n_links`` counts the other documents at or above the threshold, copies included.
    ``key`` is the text's :func:`text_key`, ``group`` the same for all texts of a class.
    """
    spark = docs.sparkSession
    d = prefix_length(threshold, TREES, DEPTH, recall)
    width = TREES * DEPTH
    error = np.sqrt(threshold * (1 - threshold) / width)
    least = threshold - 6 * error

    signed_path = write_stage(_signed(docs, k), "signed")
    signed = spark.read.schema(
        "doc_id long, mark long, key binary, n long, paths binary, bits binary"
    ).parquet(signed_path)
    # Copies collapse before anything is shuffled twice; signatures follow for one row a class.
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")
    class_path = write_stage(
        signed.where("n > 0").groupBy("key").agg(
            F.min(place).alias("at"), F.count("*").alias("weight"), F.first("n").alias("n"),
            F.first("paths").alias("paths"), F.first("bits").alias("bits"),
        ).select("key", F.col("at.doc_id").alias("rep"), F.col("at.mark").alias("mark"), "weight", "n", "paths", "bits"),
        "classes",
    )
    classes = spark.read.schema(
        "key binary, rep long, mark long, weight long, n long, paths binary, bits binary"
    ).parquet(class_path)

    matched, matched_paths = forest_nodes(classes.select("key", "paths"), d, threshold, recall)
    active_path = write_stage(matched, "nodes")
    drop_stage(*matched_paths)
    active = spark.read.schema("node long, key binary, m long").parquet(active_path)
    bits = classes.select("key", "bits")
    with_bits = active.join(bits, "key")
    parts = with_bits.select(
        "node", F.pmod(F.xxhash64("key"), F.ceil(F.col("m") / BLOCK_ROWS)).alias("part"), "key", "bits"
    )
    ordered = parts.repartition("node", "part").sortWithinPartitions("node", "part", "key")
    first = ordered.mapInArrow(_leader_edges(least), "a binary, b binary")
    group, first_path = components(first)

    # Nodes that still span several groups, and what they add.
    rooted = active.join(group.withColumnRenamed("node", "key"), "key", "left").withColumn(
        "root", F.coalesce("root", "key")
    )
    rooted = rooted.withColumn("nb", F.ceil(F.col("m") / BLOCK_ROWS))
    spanning = rooted.groupBy("node").agg(
        (F.min("root") < F.max("root")).alias("open"), F.first("nb").alias("parts")
    ).where("open").select("node", _every_part("parts"))
    blocks = _in_block_pairs(
        rooted.withColumn("part", _part("nb")).join(spanning, ["node", "part"]).join(bits, "key"),
        "nb", ["node"], ["key", "root", "bits"],
    )
    second = _grouped(blocks, ["node", "i", "j"]).mapInArrow(_cross_edges(least), "a binary, b binary")
    known = group.select(F.col("node").alias("a"), F.col("root").alias("b"))
    whole, whole_path = components(second.unionByName(known))
    drop_stage(first_path, active_path)

    # Exact verification of each group in pairs of bounded blocks.
    narrow = classes.select("key", "rep", "mark", "weight", "n").join(whole.withColumnRenamed("node", "key"), "key")
    totals = narrow.groupBy("root").agg(F.count("*").alias("m"), F.sum("n").alias("s"))
    work = narrow.join(totals, "root").select(
        "key", "rep", "mark", "weight", "root",
        F.greatest(F.ceil(F.col("m") / BLOCK_ROWS), F.ceil(F.col("s") / BLOCK_SHINGLES)).alias("nb"),
    )
    sets = _sets(docs, work, k)
    pairs = _in_block_pairs(sets, "nb", ["root"], ["key", "weight", "shingles"])
    verified_path = write_stage(
        _grouped(pairs, ["root", "i", "j"]).mapInArrow(_verify(threshold), "key binary, links long, root binary"), "links"
    )
    verified = spark.read.schema("key binary, links long, root binary").parquet(verified_path)
    exact, exact_path = components(verified.select(F.col("key").alias("a"), F.col("root").alias("b")))
    drop_stage(whole_path)

    found = (
        classes.select("key", "rep", "weight")
        .join(exact.withColumnRenamed("node", "key"), "key")
        .join(verified.groupBy("key").agg(F.sum("links").alias("links")), "key")
    )
    least_id = found.groupBy("root").agg(F.min("rep").alias("class_id"))
    linked = found.join(least_id, "root").select("key", "class_id", "links", F.col("root").alias("group"))
    copies = signed.where("key IS NOT NULL").groupBy("key").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first"))
    per_key = copies.join(linked, "key", "left").select(
        "key", F.coalesce("class_id", "first").alias("class_id"),
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        F.coalesce("group", "key").alias("group"),
    )
    result = signed.select("doc_id", "mark", "key").join(per_key, "key", "left").select(
        "doc_id",
        F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        "key", "group", "mark",
    )
    return result, [signed_path, class_path, verified_path, exact_path]


def keep_one(docs: DataFrame, threshold: float = 0.8, k: int = 5) -> tuple[DataFrame, list[str]]:
    """The rows of ``docs``, all columns, that stay: one per class, of the smallest id.

    Null ids come last, further ties are broken by the text's key; of rows equal in id and text
    one stays. Rows with a null text are in no class and stay.
    """
    joined, paths = jaccard_join(docs, threshold, k)
    last = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "mark")
    some = joined.where("group IS NOT NULL")
    kept = some.groupBy("group").agg(F.min(last).alias("kept"))
    kept = kept.select(F.col("kept.doc_id").alias("kept_id"), F.col("kept.mark").alias("kept_mark"))
    # Both columns are keys of the join, so a group of copies spreads over its ids.
    texts = docs.where(F.col("text").isNotNull())
    same = (F.xxhash64(texts["text"]) == kept["kept_mark"]) & texts["doc_id"].cast("long").eqNullSafe(kept["kept_id"])
    one = texts.join(kept, same, "left_semi")
    # Texts are only sorted where rows do repeat.
    repeated = some.groupBy("doc_id", "mark").agg(F.count("*").alias("n")).where("n > 1")
    if repeated.limit(1).count():
        one = one.dropDuplicates(["text", "doc_id"])
    return docs.where(F.col("text").isNull()).unionByName(one), paths


def _sets(docs: DataFrame, work: DataFrame, k: int) -> DataFrame:
    """Shingle sets of the classes in ``work``, from the text of one document of each."""
    schema = pa.schema(
        [("key", pa.binary()), ("weight", pa.int64()), ("root", pa.binary()), ("nb", pa.int64()), ("shingles", pa.binary())]
    )

    def cut(batches):
        def rows():
            known = word_hashes()
            for text, key, weight, root, nb in docs_of(batches):
                own = shingles(text, k, known).tobytes()
                # Another text may have the same mark; the key tells.
                if xxhash.xxh3_128_digest(own) == key:
                    yield key, weight, root, nb, own

        yield from emit(rows(), schema, 500)

    texts = docs.select(F.col("doc_id").cast("long").alias("rep_id"), _mark().alias("rep_mark"), "text")
    same = F.col("rep_id").eqNullSafe(F.col("rep")) & (F.col("rep_mark") == F.col("mark"))
    # Of repeated rows one stands for the class.
    joined = texts.join(work, same).dropDuplicates(["key"]).select("text", "key", "weight", "root", "nb")
    return joined.mapInArrow(cut, "key binary, weight long, root binary, nb long, shingles binary")
