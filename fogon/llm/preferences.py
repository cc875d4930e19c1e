"""Preference formatting, in DataFrame functions only.

A pair is a chosen and a rejected conversation. Their longest common prefix of turns is
rendered once as the prompt; the rest of each side is its completion. The mask of a
completion lists the code points to train on, as ``start:length`` spans joined by commas:
the text and end mark of assistant turns. Other turns and all role headers are masked out.

A turn is rendered as ``<|role|>\\ntext<|end|>\\n``; ``<|`` inside a text becomes ``< |``, so a
text cannot forge a turn.

The two sides are lined up by turn position, and the prefix length is the smallest position
at which they differ. All steps are windows and groups of a pair, so turns are shuffled once
to be paired and once to be formatted; a pair meets in a task as its output is one row.

Defined cases: turns are ordered by (turn, role, text), nulls first, and a repeated row
counts once; a null role is ``user``, a null text the empty one; a conversation without a
counterpart gives a prompt-free row whose other completion is empty; an empty table gives
no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def preference_pairs(turns: DataFrame) -> DataFrame:
    """(pair_id, side, turn, role, text) from (conv_id, turn, role, text).

    The table has no preference labels, so every conversation is the chosen side of a pair
    whose rejected side takes another course: it keeps the turns before the last assistant
    turn and goes on, from that turn number, with the turns of the neighbouring
    conversation (id with its last bit flipped).
    """
    # Neighbours share a group, so one shuffle brings together all that follows.
    group = F.shiftright("conv_id", 1)
    rows = (
        turns.select("conv_id", "turn", "role", "text", group.alias("pairing"))
        .repartition("pairing")
        .dropDuplicates(["pairing", "conv_id", "turn", "role", "text"])
    )
    last = F.when(F.col("role") == "assistant", F.col("turn"))
    odd = F.col("conv_id").bitwiseAND(F.lit(1)) == 1
    whole, own = Window.partitionBy("pairing"), Window.partitionBy("pairing", "conv_id")
    known = rows.withColumns(
        {
            "cut": F.max(last).over(own),
            "other_cut": F.when(odd, F.max(F.when(~odd, last)).over(whole)).otherwise(
                F.max(F.when(odd, last)).over(whole)
            ),
        }
    )
    kept = F.col("cut").isNull() | F.col("turn").isNull() | (F.col("turn") < F.col("cut"))
    other = F.col("conv_id").bitwiseXOR(F.lit(1))
    # A turn is in its own pair's sides, and in the neighbour's rejected side from its cut on.
    places = F.array(
        F.struct(F.col("conv_id").alias("pair_id"), F.lit("chosen").alias("side"), F.lit(True).alias("use")),
        F.struct(F.col("conv_id").alias("pair_id"), F.lit("rejected").alias("side"), kept.alias("use")),
        F.struct(other.alias("pair_id"), F.lit("rejected").alias("side"), (F.col("turn") >= F.col("other_cut")).alias("use")),
    )
    placed = known.select(F.explode(F.filter(places, lambda x: x["use"])).alias("at"), "turn", "role", "text")
    return placed.select("at.pair_id", "at.side", "turn", "role", "text")


def format_preferences(turns: DataFrame) -> DataFrame:
    """One row per pair of (pair_id, side, turn, role, text), side ``chosen`` or ``rejected``.

    Columns: pair_id, n_common (turns of the prompt), prompt, chosen, rejected, chosen_mask,
    rejected_mask.
    """
    # One shuffle by pair; every step below finds a pair's rows together.
    rows = (
        turns.select("pair_id", "side", "turn", "role", "text")
        .repartition("pair_id")
        .dropDuplicates(["pair_id", "side", "turn", "role", "text"])
    )
    order = [F.asc_nulls_first("turn"), F.asc_nulls_first("role"), F.asc_nulls_first("text")]
    placed = rows.withColumn(
        "pos", F.row_number().over(Window.partitionBy("pair_id", "side").orderBy(*order)).cast("long")
    ).select(
        "pair_id", "side", "pos",
        F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    # A position is common if both sides are there and equal.
    at = Window.partitionBy("pair_id", "pos")
    turn = F.struct("role", "text")
    different = (F.count("*").over(at) < 2) | (F.min(turn).over(at) != F.max(turn).over(at))
    pair = Window.partitionBy("pair_id")
    common = placed.withColumn("different", different).withColumn(
        "n_common",
        F.coalesce(F.min(F.when(F.col("different"), F.col("pos"))).over(pair) - 1, F.max("pos").over(pair)),
    )
    rendered = common.withColumns(
        {
            "head": F.concat(F.lit("<|"), "role", F.lit("|>\n")),
            "body": F.concat(F.replace("text", F.lit("<|"), F.lit("< |")), F.lit("<|end|>")),
        }
    )
    # The prompt takes the common turns of the chosen side only.
    part = F.when(F.col("pos") <= F.col("n_common"), "prompt").otherwise(F.col("side"))
    pieces = rendered.where((F.col("pos") > F.col("n_common")) | (F.col("side") == "chosen")).select(
        "pair_id", "n_common", "pos", "role", "head", "body", part.alias("part"),
        (F.length("head") + F.length("body") + 1).alias("size"),
    )
    before = Window.partitionBy("pair_id", "part").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    spans = pieces.withColumn(
        "span",
        F.when(
            F.col("role") == "assistant",
            F.concat(
                (F.coalesce(F.sum("size").over(before), F.lit(0)) + F.length("head")).cast("string"),
                F.lit(":"), F.length("body").cast("string"),
            ),
        ),
    )

    def joined(name: str, value, by: str):
        of = F.when(F.col("part") == name, F.struct("pos", value.alias("value")))
        return F.array_join(F.transform(F.array_sort(F.collect_list(of)), lambda x: x["value"]), by)

    text = F.concat("head", "body", F.lit("\n"))
    return spans.groupBy("pair_id").agg(
        F.first("n_common").alias("n_common"),
        joined("prompt", text, "").alias("prompt"),
        joined("chosen", text, "").alias("chosen"),
        joined("rejected", text, "").alias("rejected"),
        joined("chosen", F.col("span"), ",").alias("chosen_mask"),
        joined("rejected", F.col("span"), ",").alias("rejected_mask"),
    )


SQL = """
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
last AS (SELECT conv_id, max(turn) AS cut FROM t WHERE role = 'assistant' GROUP BY conv_id),
sides AS (
  SELECT conv_id AS pair_id, 'chosen' AS side, turn, role, text FROM t
  UNION ALL
  SELECT t.conv_id, 'rejected', turn, role, text
  FROM t LEFT JOIN last l ON t.conv_id IS NOT DISTINCT FROM l.conv_id
  WHERE cut IS NULL OR turn IS NULL OR turn < cut
  UNION ALL
  SELECT l.conv_id, 'rejected', t.turn, t.role, t.text
  FROM last l JOIN t ON t.conv_id = xor(l.conv_id, 1) AND t.turn >= l.cut
),
placed AS (
  SELECT pair_id, side, coalesce(role, 'user') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY pair_id, side
      ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos
  FROM (SELECT DISTINCT * FROM sides)
),
common AS (
  SELECT coalesce(c.pair_id, r.pair_id) AS pair_id,
    coalesce(min(CASE WHEN c.pos IS NULL OR r.pos IS NULL OR c.role <> r.role OR c.text <> r.text
                      THEN coalesce(c.pos, r.pos) END) - 1, max(coalesce(c.pos, r.pos))) AS n_common
  FROM (SELECT * FROM placed WHERE side = 'chosen') c
  FULL JOIN (SELECT * FROM placed WHERE side = 'rejected') r
    ON c.pair_id IS NOT DISTINCT FROM r.pair_id AND c.pos = r.pos
  GROUP BY 1
),
pieces AS (
  SELECT p.pair_id, n_common, pos, role,
    CASE WHEN pos <= n_common THEN 'prompt' ELSE side END AS part,
    '<|' || role || '|>' || chr(10) AS head,
    replace(text, '<|', '< |') || '<|end|>' AS body
  FROM placed p JOIN common c ON p.pair_id IS NOT DISTINCT FROM c.pair_id
  WHERE pos > n_common OR side = 'chosen'
),
spans AS (
  SELECT *, head || body || chr(10) AS whole,
    CASE WHEN role = 'assistant' THEN
      (coalesce(sum(length(head) + length(body) + 1) OVER (
         PARTITION BY pair_id, part ORDER BY pos
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head))::BIGINT::VARCHAR
      || ':' || length(body)::VARCHAR END AS span
  FROM pieces
)
SELECT pair_id, max(n_common)::BIGINT AS n_common,
  coalesce(string_agg(whole, '' ORDER BY pos) FILTER (WHERE part = 'prompt'), '') AS prompt,
  coalesce(string_agg(whole, '' ORDER BY pos) FILTER (WHERE part = 'chosen'), '') AS chosen,
  coalesce(string_agg(whole, '' ORDER BY pos) FILTER (WHERE part = 'rejected'), '') AS rejected,
  coalesce(string_agg(span, ',' ORDER BY pos) FILTER (WHERE part = 'chosen'), '') AS chosen_mask,
  coalesce(string_agg(span, ',' ORDER BY pos) FILTER (WHERE part = 'rejected'), '') AS rejected_mask
FROM spans GROUP BY pair_id
"""
