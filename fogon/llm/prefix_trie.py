"""The prefix trie of rebuilt conversations, without building their texts.

A rebuilt conversation is the head of a base conversation followed by its own suffix. A
sequence of turns has a fingerprint from a composable monoid: with elements ``e_1 .. e_d``
(taken from the SHA-256 of role and text) it is ``sum(e_i * B**i) mod p`` for four bases at
once, and ``F(u + v) = F(u) + B**len(u) * F(v)``. So every prefix of a rebuilt conversation
is put together from two stored prefixes, those of the base's head and of the own turns, by
a few multiplications of integers; no rebuilt text or sequence exists anywhere. The same rule
joins the pieces of a conversation that is spread over several tasks.

Prefixes of one depth and fingerprint are one node. That is verified, not believed: all
members of a group must refer to one stored turn (the SHA-256 under which it is stored) and
to one parent group, and all turns stored under a digest must be equal as text. By induction
over the depth a group is then one sequence. If a group fails, all is done again with other
bases.

Sums over subtrees need no descent. The smallest member of a node is also the smallest of the
nodes below it on its own path, so each conversation owns the lower end of its path. A sum
over the subtree of a node is the owner's part from there down, plus everything owned by its
other members: one grouped sum over (conversation, depth) rows.

Nothing gathers a conversation or a node in a task: positions come from range partitions
whose sums are carried on, groups are sums, minima and counts, and the members that end at a
node meet as strings of at most 4096 ids, streamed in order through one hash state (SHA-256
cannot be computed in parts).

Defined cases: turns are ordered by (turn, digest), null turns first; repeated rows are turns
of their own; a null role or text is empty; rows without a conversation id belong to none and
give no node; other columns are not looked at; an empty table has no nodes, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fogon.llm.common import drop_stage, write_stage

PRIME = 2**31 - 1
LANES = range(4)
_POSITION_BITS = 33
_HEAD = 3
_EMPTY = hashlib.sha256(b"").hexdigest()


def _bases(seed: int) -> list[int]:
    drawn = hashlib.sha256(f"bases {seed}".encode()).digest()
    return [int.from_bytes(drawn[4 * j : 4 * j + 4], "big") % (PRIME - 2) + 2 for j in LANES]


def _times(a: Column, b: Column) -> Column:
    return a * b % F.lit(PRIME)


def _tables(base: int) -> list[Column]:
    """Powers of ``base`` for every value of every five bits of an exponent below 2**35."""
    return [
        F.lit(np.array([pow(base, digit << low, PRIME) for digit in range(32)])) for low in range(0, 35, 5)
    ]


def _power(tables: list[Column], exponent: Column) -> Column:
    """The base to the power of ``exponent`` mod p: a product of look-ups."""
    digits = [F.shiftright(exponent, 5 * i).bitwiseAND(F.lit(31)).cast("int") for i in range(len(tables))]
    return reduce(_times, [F.get(table, digit) for table, digit in zip(tables, digits, strict=True)])


def _turns(conversations: DataFrame) -> DataFrame:
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    return conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        role.alias("role"), text.alias("text"), digest.alias("digest"),
    )


def _check_turns(turns: DataFrame) -> None:
    """Turns stored under one digest must be equal."""
    content = F.struct("role", "text")
    differing = turns.groupBy("digest").agg(F.min(content).alias("low"), F.max(content).alias("high"))
    if differing.where("low <> high").limit(1).count():
        raise RuntimeError("two different turns have one SHA-256 digest")


def _stored(turns: DataFrame, seed: int) -> DataFrame:
    """Turns in range partitions of their order, with position and prefix fingerprints ``f``
    (turn included) and ``g`` (before it) inside the part of the conversation in that range."""
    d = [F.conv(F.substring("digest", 16 * j + 1, 16), 16, -10).cast("long").alias(f"d{j}") for j in LANES]
    rows = turns.select(
        "conv_id", "turn", "digest", *d,
        F.regexp_count("text", F.lit("[^\\x20\\x09-\\x0D]+")).cast("long").alias("words"),
        # Equal rows of one conversation may be dealt to several ranges.
        F.monotonically_increasing_id().alias("salt"),
    )
    order = ["conv_id", "turn", "digest", "salt"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return ranged.drop("salt", "digest", "turn").withColumn("at", F.monotonically_increasing_id())


def _positions(stored: DataFrame, bases: list[int]) -> DataFrame:
    """(conv_id, pos, d*, words, f*, g*) with position and prefix fingerprints in the whole
    conversation; ``f`` includes the turn, ``g`` does not."""
    tables = [_tables(b) for b in bases]
    part = stored.withColumn("part", F.shiftrightunsigned("at", _POSITION_BITS))
    here = Window.partitionBy("conv_id", "part").orderBy("at")
    placed = part.withColumn("own", F.row_number().over(here).cast("long")).drop("at")
    upto = Window.partitionBy("conv_id", "part").orderBy("own").rowsBetween(Window.unboundedPreceding, 0)
    element = [_times(F.pmod(F.col(f"d{j}"), F.lit(PRIME)), _power(t, F.col("own"))) for j, t in enumerate(tables)]
    local = placed.withColumns({f"e{j}": e for j, e in enumerate(element)})
    local = local.withColumns({f"s{j}": F.sum(f"e{j}").over(upto) % PRIME for j in LANES})
    parts = local.groupBy("conv_id", "part").agg(
        F.count("*").alias("n"), *[(F.sum(f"e{j}") % PRIME).alias(f"t{j}") for j in LANES]
    )
    # A conversation has as many parts as ranges it touches: few rows in a window.
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    carried = carried.withColumns({f"b{j}": _power(t, F.col("before")) for j, t in enumerate(tables)})
    carried = carried.withColumns(
        {f"c{j}": F.coalesce(F.sum(_times(F.col(f"b{j}"), F.col(f"t{j}"))).over(before) % PRIME, F.lit(0)) for j in LANES}
    )

    def joined(inside) -> list[Column]:
        return [(F.col(f"c{j}") + _times(F.col(f"b{j}"), inside(j))) % PRIME for j in LANES]

    f = joined(lambda j: F.col(f"s{j}"))
    g = joined(lambda j: (F.col(f"s{j}") - F.col(f"e{j}") + PRIME) % PRIME)
    return local.join(carried, ["conv_id", "part"]).select(
        "conv_id", (F.col("before") + F.col("own")).alias("pos"), "words", *[f"d{j}" for j in LANES],
        *[c.alias(f"f{j}") for j, c in enumerate(f)], *[c.alias(f"g{j}") for j, c in enumerate(g)],
    )


def _packed(lanes: list[Column], names: tuple[str, str]) -> list[Column]:
    """Four residues as two integers."""
    return [(lanes[2 * i] * F.lit(2**31) + lanes[2 * i + 1]).alias(n) for i, n in enumerate(names)]


def _members(positions: DataFrame, bases: list[int], span: int) -> DataFrame:
    """A row for every rebuilt conversation and every depth from 0 to its length:
    (conv_id, depth, k1, k2: its node; q1, q2: the parent node; d*: the stored turn it refers
    to; words, last)."""
    kept = ["words", *[f"{x}{j}" for x in "df" for j in LANES]]
    heads = positions.groupBy("conv_id").agg(
        F.max("pos").alias("n"),
        *[F.max(F.when(F.col("pos") == i, F.col(c))).alias(f"{c}_{i}") for i in range(1, _HEAD + 1) for c in kept],
    )
    base = heads.select(*[F.col(c).alias(f"base_{c}") for c in heads.columns])
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (_HEAD + 1)).cast("long")
    known = heads.withColumn("h", h).join(
        base, F.col("conv_id") - F.col("conv_id") % span == F.col("base_conv_id"), "left"
    ).withColumn("hb", F.least("h", F.coalesce("base_n", F.lit(0).cast("long"))))

    def head_value(prefix: str, upto: str, column: str) -> Column:
        """The value at the last turn of a head of ``upto`` turns; 0 for none."""
        cases = F.lit(0).cast("bigint")
        for i in range(1, _HEAD + 1):
            cases = F.when(F.col(upto) == i, F.col(f"{prefix}{column}_{i}")).otherwise(cases)
        return cases

    convs = known.withColumns(
        {f"fb{j}": head_value("base_", "hb", f"f{j}") for j in LANES}
        | {f"fc{j}": F.coalesce(head_value("", "h", f"f{j}"), F.lit(0)) for j in LANES}
        | {"length": F.col("hb") + F.greatest(F.col("n") - F.col("h"), F.lit(0))}
    )
    zero, none = F.lit(0).cast("bigint"), F.lit(None).cast("bigint")
    top = F.struct(zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), none.alias("q1"), none.alias("q2"),
                   *[none.alias(f"d{j}") for j in LANES], zero.alias("words"))

    def at(i: int) -> Column:
        values = {c: F.col(f"base_{c}_{i}") for c in kept}
        parent = [F.col(f"base_f{j}_{i - 1}") if i > 1 else zero for j in LANES]
        return F.struct(
            F.lit(i).cast("long").alias("depth"), *_packed([values[f"f{j}"] for j in LANES], ("k1", "k2")),
            *_packed(parent, ("q1", "q2")), *[values[f"d{j}"].alias(f"d{j}") for j in LANES], values["words"].alias("words"),
        )

    shared = convs.select(
        "conv_id", "length",
        F.explode(F.filter(F.array(top, *[at(i) for i in range(1, _HEAD + 1)]), lambda x: x["depth"] <= F.col("hb"))).alias("x"),
    ).select("conv_id", "x.*", (F.col("x.depth") == F.col("length")).alias("last"))

    # Own turns: the head of h turns is taken off in front, the base's head of hb put there.
    shift = [F.lit(np.array([pow(b, -i, PRIME) for i in range(_HEAD + 1)])) for b in bases]
    info = convs.select("conv_id", "h", "hb", "length", *[f"{x}{j}" for x in ("fb", "fc") for j in LANES])
    own = positions.join(info, "conv_id").where("pos > h")

    def moved(x: str) -> list[Column]:
        return [
            (F.col(f"fb{j}") + _times(F.get(shift[j], (F.col("h") - F.col("hb")).cast("int")),
                                      (F.col(f"{x}{j}") - F.col(f"fc{j}") + PRIME) % PRIME)) % PRIME
            for j in LANES
        ]

    depth = F.col("hb") + F.col("pos") - F.col("h")
    suffix = own.select(
        "conv_id", depth.alias("depth"), *_packed(moved("f"), ("k1", "k2")), *_packed(moved("g"), ("q1", "q2")),
        *[f"d{j}" for j in LANES], "words", (depth == F.col("length")).alias("last"),
    )
    return shared.unionByName(suffix)


_ENDS = pa.schema([("depth", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("ends_sha256", pa.string())])


def _hash_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One SHA-256 per run of equal nodes in a sorted stream of (depth, k1, k2, ids)."""
    node, state, done = None, None, []
    for batch in batches:
        keys = zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)
        for key, ids in zip(keys, batch.column(3).to_pylist(), strict=True):
            if key == node:
                state.update(b",")
            else:
                if node is not None:
                    done.append((*node, state.hexdigest()))
                node, state = key, hashlib.sha256()
            state.update(ids.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], schema=_ENDS)
            done = []
    if node is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*node, state.hexdigest())], schema=_ENDS)


NODE = ["depth", "k1", "k2"]


def _ends(members: DataFrame, chunk: int = 4096) -> DataFrame:
    """SHA-256 of the ids that end at a node, ascending and comma-joined."""
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    chunks = members.where("last").groupBy(*NODE, F.floor(F.col("conv_id") / chunk).alias("chunk")).agg(ids.alias("ids"))
    ordered = chunks.repartition(*NODE).sortWithinPartitions(*NODE, "chunk").select(*NODE, "ids")
    return ordered.mapInArrow(_hash_runs, "depth long, k1 long, k2 long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, span: int = 20, seed: int = 0) -> DataFrame:
    """Nodes of the trie of rebuilt conversations (conv_id, turn, role, text).

    Conversation c takes the first crc32(c) % 4 turns of conversation c - c % span, then its
    own turns after as many. Returns per node: conv_id (smallest member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256; (conv_id, depth)
    identifies a node.
    """
    spark = conversations.sparkSession
    turns = _turns(conversations)
    _check_turns(turns)

    def staged(df: DataFrame, label: str) -> tuple[DataFrame, str]:
        path = write_stage(df, label)
        return spark.read.schema(df.schema).parquet(path), path

    stored, stored_path = staged(_stored(turns, seed), "trie-turns")
    while True:
        bases = _bases(seed)
        positions, positions_path = staged(_positions(stored, bases), "trie-positions")
        members, members_path = staged(_members(positions, bases, span), "trie-members")
        drop_stage(positions_path)
        refs = ["q1", "q2", *[f"d{j}" for j in LANES], "words"]
        groups = members.groupBy(*NODE).agg(
            F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"),
            *[F.min(c).alias(c) for c in refs], *[F.max(c).alias(f"max_{c}") for c in refs],
        )
        same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"max_{c}")) for c in refs])
        checked = groups.withColumn("same", same)
        nodes, nodes_path = staged(checked.select(*NODE, "n_convs", "conv_id", "q1", "q2", "words", "same"), "trie-nodes")
        if not nodes.where("NOT same").limit(1).count():
            break
        drop_stage(members_path, nodes_path)
        seed += 1
    drop_stage(stored_path)

    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("q1").alias("k1"), F.col("q2").alias("k2")).agg(
        F.count("*").alias("n_children")
    )
    weight = (F.col("n_convs") - 1) * F.col("words")
    weighed = nodes.join(children, NODE, "left").select(
        *NODE, "n_convs", "conv_id", "q1", "q2", weight.alias("weight"), F.coalesce("n_children", F.lit(0)).alias("n_children")
    )
    # What each conversation owns, from a depth down: inside a block of depths, then block by block.
    block = F.floor(F.col("depth") / 1024).alias("block")
    blocks = weighed.groupBy("conv_id", block).agg(F.sum("weight").alias("total"))
    later = Window.partitionBy("conv_id").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("conv_id", "block", F.coalesce(F.sum("total").over(later), F.lit(0)).alias("later"))
    down = Window.partitionBy("conv_id", "block").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    owned = weighed.withColumn("block", block).withColumn("down", F.sum("weight").over(down)).join(blocks, ["conv_id", "block"])
    owners = weighed.groupBy("conv_id").agg(F.sum("weight").alias("total"), F.count_if(F.col("n_children") == 0).alias("leaves"))
    below = members.join(owners, "conv_id", "left").groupBy(*NODE).agg(
        F.sum(F.coalesce("total", F.lit(0))).alias("members_total"), F.sum(F.coalesce("leaves", F.lit(0))).alias("n_leaves")
    )
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("q1"), F.col("k2").alias("q2"), F.col("conv_id").alias("parent_conv_id"))
    out = (
        owned.join(below, NODE).join(_ends(members), NODE, "left")
        .join(owners.select("conv_id", "total"), "conv_id")
        .join(parents, ["depth", "q1", "q2"], "left")
    )
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
        (F.col("down") + F.col("later") + F.col("members_total") - F.col("total")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256"),
    )


SQL = r"""
WITH bytes AS (
  SELECT list(list_reduce([i] || range(8), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)
              ORDER BY i) AS t
  FROM range(256) r(i)
),
convs AS (
  SELECT conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')}
           ORDER BY turn NULLS FIRST,
             sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
),
heads AS (
  SELECT conv_id, turns,
    xor(list_reduce([4294967295] || list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
                    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 4 AS h
  FROM convs, bytes
),
rebuilt AS (
  SELECT c.conv_id,
    coalesce(list_slice(b.turns, 1, c.h), []) || list_slice(c.turns, c.h + 1, len(c.turns)) AS path
  FROM heads c LEFT JOIN convs b ON b.conv_id = c.conv_id - c.conv_id % 20
),
members AS (
  SELECT conv_id, d AS depth, list_slice(path, 1, d) AS prefix, len(path) = d AS last
  FROM rebuilt, range(len(path) + 1) r(d)
),
nodes AS (
  SELECT depth, prefix, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE last), '')) AS ends_sha256,
    CASE WHEN depth > 0 THEN
      (count(*) - 1) * len(list_filter(regexp_split_to_array(prefix[depth]['t'], '[\x20\x09-\x0D]+'), lambda w: w <> '')) ELSE 0
    END AS weight
  FROM members GROUP BY depth, prefix
),
edges AS (SELECT depth - 1 AS depth, list_slice(prefix, 1, depth - 1) AS prefix, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1, 2),
known AS (
  SELECT n.*, coalesce(e.n, 0) AS n_children FROM nodes n LEFT JOIN edges e ON n.depth = e.depth AND n.prefix = e.prefix
),
tops AS (
  SELECT list_slice(k.prefix, 1, d) AS prefix, d AS depth, count_if(n_children = 0) AS n_leaves, sum(weight) AS saved
  FROM known k, range(k.depth + 1) r(d) GROUP BY 1, 2
)
SELECT k.conv_id, k.depth, p.conv_id AS parent_conv_id, k.n_convs, k.n_children, t.n_leaves::BIGINT AS n_leaves,
  t.saved::BIGINT AS saved_tokens, k.ends_sha256
FROM known k JOIN tops t ON k.depth = t.depth AND k.prefix = t.prefix
LEFT JOIN nodes p ON p.depth = k.depth - 1 AND p.prefix = list_slice(k.prefix, 1, k.depth - 1)
"""
