"""Connected components over an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import FEW_KEYS, few, forget, materialise


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Links each node's larger (``large``) or smaller neighbours to the least one; written.

    The minimum is aggregated before the shuffle and written, so the join needs
    no shuffle while there are few nodes, and else is a plain equi-join of two
    tables that adaptive execution may split: one node with very many
    neighbours does not fill a task.
    """
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges
    least = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
    least = materialise(least.select("node", F.least("node", "m").alias("m")))
    linked = both.join(few(least, FEW_KEYS), F.col("a") == F.col("node"))
    if large:
        out = linked.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = linked.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select(F.col("node").alias("a"), F.col("m").alias("b"))
        )
    done = materialise(out.where("a <> b").distinct())
    forget(least)
    return done


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node of ``edges`` (``a``, ``b``); root is the least node reachable.

    Edges stay distributed; each round's table is written to the shared folder
    and its predecessor deleted, and only a count and a checksum come to the
    driver. No edges give no rows.
    """
    now = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    seen = None
    for _ in range(rounds):
        wide = _stars(now, True)
        then, now = now, _stars(wide, False)
        forget(then, wide)
        state = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        if state == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        seen = state
    raise RuntimeError(f"components did not settle in {rounds} rounds")
