"""Multi-party perspective rotation of dialogues, in DataFrame operations.

For every participant of a conversation the dialogue is rendered with that
speaker as the assistant and all others as named users; the mask marks what
the assistant says, with its end marker, as trained. Roles in ``context``
(by default ``system``) are rendered for everyone and are no participants.

A turn is ``<|assistant|>``, ``<|user name="X"|>`` or ``<|system|>``, a line
feed, the text, ``<|end|>`` and a line feed. ``<|`` inside a text becomes
``<\\|`` (and ``<\\|`` becomes ``<\\\\|``), so markers can't be forged and the
text can be had back. The mask is run lengths in characters: header, text with
its end marker, line feed, for every turn.

A conversation of more than ``block`` turns comes in blocks of as many, so
one that holds a third of all rows is rendered by many tasks; blocks in order
make up the dialogue. Only long conversations are ranked, by a sort over
range partitions.

Defined cases: turns come by turn, then role, then text, nulls first; a null
text is empty; a null role is the speaker ``unknown``; rows with a null
conv_id form one conversation; repeated turns are repeated; a very long text
is rendered whole in its turn; a conversation without participants, and an
empty table, give no rows; further columns, whatever their names, are left
behind.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.llm.common import col, materialise, table

BLOCK = 2048
END = "<|end|>"


def _blocks(turns: DataFrame, block: int) -> DataFrame:
    """Adds ``block``: 0 but in conversations of more than ``block`` turns."""
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    long = materialise(sizes.where(F.col("n") > block).select(F.col("conv_id").alias("long_id")))
    if long.isEmpty():
        return turns.withColumn("block", F.lit(0).cast("long"))
    is_long = F.col("conv_id").eqNullSafe(F.col("long_id"))
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")]
    tagged = turns.join(long.withColumn("hit", F.lit(True)), is_long, "left")
    parts = materialise(
        tagged.where("hit").drop("hit", "long_id").repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    )
    # A row for each conversation and partition: offsets of a conversation's ranks.
    before = W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = parts.groupBy("conv_id", "part").agg(F.count("*").alias("n")).select(
        F.col("conv_id").alias("c"), F.col("part").alias("p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")
    )
    within = W.partitionBy("conv_id", "part").orderBy(*order)
    ranked = parts.withColumn("at", F.row_number().over(within) - 1).join(
        offsets, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p"))
    )
    long_rows = ranked.select("conv_id", "turn", "role", "text", F.floor((F.col("offset") + F.col("at")) / block).cast("long").alias("block"))
    rest = tagged.where("hit IS NULL").select("conv_id", "turn", "role", "text", F.lit(0).cast("long").alias("block"))
    return rest.unionByName(long_rows)


def _runs(me: Column, context: Sequence[str]) -> Column:
    """Of each turn in ``turns`` its three strings and whether the middle one is trained."""

    def one(t: Column) -> Column:
        name = F.regexp_replace(t["role"], r'[\x00-\x1F"<|>]', "_")
        is_me = t["role"] == me
        header = (
            F.when(t["role"].isin(*context), F.concat(F.lit("<|"), name, F.lit("|>\n")))
            .when(is_me, F.lit("<|assistant|>\n"))
            .otherwise(F.concat(F.lit('<|user name="'), name, F.lit('"|>\n')))
        )
        text = F.regexp_replace(F.coalesce(t["text"], F.lit("")), r"<(\\*)\|", r"<\\$1|")
        return F.struct(header.alias("header"), F.concat(text, F.lit(END)).alias("body"), is_me.alias("trained"))

    return F.transform("turns", one)


def perspectives(
    conversations: DataFrame, *, context: Sequence[str] = ("system",), block: int = BLOCK,
    conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
) -> DataFrame:
    """``(conv_id, perspective, block, n_turns, text, mask)``; mask is ``array<struct<n, trained>>``."""
    turns = conversations.select(
        col(conv_col).alias("conv_id"), col(turn_col).alias("turn"),
        F.coalesce(col(role_col).cast("string"), F.lit("unknown")).alias("role"), col(text_col).cast("string").alias("text"),
    )
    speakers = turns.where(~F.col("role").isin(*context)).select(F.col("conv_id").alias("c"), F.col("role").alias("perspective")).distinct()
    grouped = _blocks(turns, block).groupBy("conv_id", "block").agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns")
    )
    runs = grouped.join(speakers, F.col("conv_id").eqNullSafe(F.col("c"))).select(
        "conv_id", "perspective", "block", F.size("turns").cast("long").alias("n_turns"),
        _runs(F.col("perspective"), context).alias("runs"),
    )
    length = lambda c: F.length(c).cast("int")
    run = lambda n, on: F.struct(n.alias("n"), on.alias("trained"))
    return runs.select(
        "conv_id", "perspective", "block", "n_turns",
        F.array_join(F.transform("runs", lambda r: F.concat(r["header"], r["body"], F.lit("\n"))), "").alias("text"),
        F.flatten(F.transform("runs", lambda r: F.array(
            run(length(r["header"]), F.lit(False)), run(length(r["body"]), r["trained"]), run(F.lit(1), F.lit(False))
        ))).alias("mask"),
    )


def op6_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = perspectives(table(spark, sf_dir, "conversations"))
    trained = F.aggregate("mask", F.lit(0), lambda s, r: s + F.when(r["trained"], r["n"]).otherwise(0))
    runs = F.array_join(F.transform("mask", lambda r: F.concat(r["n"].cast("string"), F.when(r["trained"], F.lit("+")).otherwise(F.lit("-")))), "")
    return done.select(
        "conv_id", "perspective", "block", "n_turns", F.length("text").cast("long").alias("n_chars"),
        trained.cast("long").alias("n_trained"), F.sha2("text", 256).alias("text_sha256"), F.sha2(runs, 256).alias("mask_sha256"),
    )


OP6_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, text FROM conversations),
p AS (SELECT DISTINCT conv_id, role AS perspective FROM t WHERE role <> 'system'),
n AS (SELECT *, (row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text NULLS FIRST) - 1) AS i FROM t),
r AS (
  SELECT n.conv_id, perspective, i // 2048 AS block, i, role = perspective AS me,
    CASE WHEN role = 'system' THEN '<|system|>' || chr(10) WHEN role = perspective THEN '<|assistant|>' || chr(10)
      ELSE '<|user name="' || regexp_replace(role, '[\x00-\x1F"<|>]', '_', 'g') || '"|>' || chr(10) END AS header,
    regexp_replace(coalesce(text, ''), '<(\\*)\|', '<\\\1|', 'g') || '<|end|>' AS body
  FROM n JOIN p ON n.conv_id IS NOT DISTINCT FROM p.conv_id),
g AS (
  SELECT conv_id, perspective, block, count(*) AS n_turns, string_agg(header || body || chr(10), '' ORDER BY i) AS text,
    sum(CASE WHEN me THEN length(body) ELSE 0 END)::BIGINT AS n_trained,
    string_agg(length(header) || '-' || length(body) || CASE WHEN me THEN '+' ELSE '-' END || '1-', '' ORDER BY i) AS runs
  FROM r GROUP BY ALL)
SELECT conv_id, perspective, block::BIGINT AS block, n_turns, length(text) AS n_chars, n_trained, sha256(text) AS text_sha256, sha256(runs) AS mask_sha256 FROM g
"""
