"""Mixing sources to target weights by capped water-filling.

The plan is made on a table with one row a source: weights are shared out,
sources over their cap are clamped there, the excess goes to the others by
weight, until none is above its cap. A document then gets whole repetitions,
and one more if its seeded draw key lies below its source's cut. The cut is
found from bucket totals, so no source is ever sorted as a whole.

Defined cases: a null or wordless text has size 0 and is taken 0 times its
words; null sources form one source, ordered last; an empty table gives an
empty result; rows that share a doc_id draw alike; a null doc_id draws like
the text ``null``. Columns ``mix_*`` of the input are replaced, others pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.llm.common import col, count_words, draw_key, materialise, nested, table
from weftline.operators.ordering import global_rank

#: Hexadecimal digits by which a bucket of draw keys is cut into smaller ones, and rows from which it is.
DIGITS = 2
FEW_ROWS = 1000
#: Plans of up to this number of sources (under 100 bytes each) are broadcast, so a hot source stays where its rows are.
FEW_SOURCES = 200_000
ADDED = ("mix_size", "mix_source_size", "mix_target", "mix_copies", "mix_taken")


def water_fill(sources: DataFrame, budget: float, max_epochs: int) -> DataFrame:
    """``(source, weight, source_size)`` plus ``target``.

    Each round reads three sums from the cluster; only they reach the driver.
    """
    cap = F.col("source_size") * F.lit(max_epochs)
    fixed = F.col("weight") <= 0
    share, known = F.lit(0.0), None
    while True:
        free_w, held, n_fixed = sources.agg(
            F.sum(F.when(~fixed, F.col("weight"))), F.sum(F.when(fixed & (F.col("weight") > 0), cap)), F.count_if(fixed)
        ).first()
        if n_fixed == known:
            break
        known = n_fixed
        if not free_w:
            share = F.lit(0.0)
            break
        left = budget - float(held or 0)
        share = F.col("weight").cast("double") * F.lit(left) / F.lit(float(free_w))
        fixed = fixed | (share > cap)
    target = F.when(F.col("weight") <= 0, F.lit(0.0)).when(fixed, cap.cast("double")).otherwise(share)
    return sources.withColumn("target", target)


def _inside(sized: DataFrame, edge: DataFrame) -> DataFrame:
    """Documents with words whose draw keys begin with a ``prefix`` of their source, with that row of ``edge``."""
    here = F.col("source").eqNullSafe(F.col("s")) & F.col("draw").startswith(F.col("prefix"))
    few = F.broadcast(edge) if edge.count() <= FEW_SOURCES else edge
    return sized.where("size > 0").join(few, here)


def plan(sized: DataFrame, weights: Sequence[float], budget_share: float, max_epochs: int) -> DataFrame:
    """One row a source: ``source, source_size, target, whole, cut``; ``sized`` has ``source, size, draw``."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    cycle = F.array(*[F.lit(w) for w in weights])
    weighted = materialise(
        global_rank(sources, [F.col("source").asc_nulls_last()]).withColumn("weight", F.element_at(cycle, (F.col("rank") % len(weights) + 1).cast("int"))).drop("rank")
    )
    total = weighted.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    filled = materialise(water_fill(weighted, budget_share * total, max_epochs)).select(
        "source", "source_size", "target",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long").alias("whole"),
    ).withColumn("extra", F.col("target") - F.col("whole") * F.col("source_size"))

    edge = filled.select(F.col("source").alias("s"), "extra", F.lit("").alias("prefix"), F.lit(0).cast("long").alias("base"), F.lit(None).cast("long").alias("rows"))
    while True:
        # The bucket in which a source's extra words end, and then the buckets inside that one.
        buckets = _inside(sized, edge).groupBy("s", "extra", "base", F.substr("draw", F.lit(1), F.length("prefix") + DIGITS).alias("prefix"))
        buckets = buckets.agg(F.sum("size").alias("n"), F.count("*").alias("rows"))
        up_to = W.partitionBy("s", "base").orderBy("prefix")
        upto = F.col("base") + F.sum("n").over(up_to)
        found = buckets.withColumn("upto", upto).where((F.col("upto") >= F.col("extra")) & (F.col("upto") - F.col("n") <= F.col("extra")))
        edge = materialise(found.select("s", "extra", "prefix", (F.col("upto") - F.col("n")).alias("base"), "rows"))
        deep, most = edge.agg(F.max(F.length("prefix")), F.max("rows")).first()
        if not most or most <= FEW_ROWS or deep >= 32:
            break
    steps = _inside(sized, edge).groupBy("s", "prefix", "base", "extra", "draw").agg(F.sum("size").alias("n"))
    running = F.col("base") + F.sum("n").over(W.partitionBy("s", "prefix").orderBy("draw"))
    cuts = (
        steps.withColumn("off", F.abs(running - F.col("extra")))
        .select("s", F.struct("off", "draw").alias("at"))
        # Or nothing of the bucket: the cut is then at its lower end.
        .unionByName(edge.select("s", F.struct(F.abs(F.col("base") - F.col("extra")).alias("off"), F.col("prefix").alias("draw")).alias("at")))
        .groupBy("s").agg(F.min("at").alias("at"))
    )
    return filled.join(cuts, F.col("source").eqNullSafe(F.col("s")), "left").select(
        "source", "source_size", "target", "whole", F.col("at.draw").alias("cut")
    )


def mix_sources(
    docs: DataFrame,
    *,
    weights: Sequence[float] = (5, 2, 1),
    budget_share: float = 1.5,
    max_epochs: int = 2,
    seed: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    carry: Sequence[str] | None = None,
) -> DataFrame:
    """Documents with ``mix_size, mix_source_size, mix_target, mix_copies, mix_taken``.

    ``weights`` repeat over the sources in code point order; together the
    sources take ``budget_share`` of all words, none more than ``max_epochs``
    times its own. ``carry`` names the columns to keep (all if None): without
    the text among them, the text is read once only.
    """
    keep = [c for c in (docs.columns if carry is None else carry) if c not in ADDED]
    rows = docs.select(
        nested(docs, keep), col(source_col).alias("source"),
        count_words(col(text_col).cast("string")).alias("size"), draw_key(seed, col(id_col)).alias("draw"),
    )
    if carry is not None:
        rows = materialise(rows)
    sized = materialise(rows.drop("row"))
    sources = materialise(plan(sized, weights, budget_share, max_epochs))
    copies = (F.col("whole") + F.when(F.col("draw") <= F.col("cut"), 1).otherwise(0)).cast("long")
    few = sources.count() <= FEW_SOURCES
    sources = sources.withColumnRenamed("source", "s")
    sources = F.broadcast(sources) if few else sources
    return rows.join(sources, F.col("source").eqNullSafe(F.col("s"))).select(
        *[F.col("row").getField(c).alias(c) for c in keep],
        F.col("size").alias("mix_size"), F.col("source_size").cast("long").alias("mix_source_size"),
        F.col("target").alias("mix_target"), copies.alias("mix_copies"), (copies * F.col("size")).alias("mix_taken"),
    )


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return mixed.select(
        "doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"), F.col("mix_taken").alias("taken"),
    )


#: Sorted by size over weight, the clamped sources come first; ``held`` and ``free`` are sums up to there.
OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(concat('1:', coalesce(doc_id::VARCHAR, 'null'))) AS draw
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM s),
o AS (SELECT *, source_size / weight AS ratio, row_number() OVER (ORDER BY source_size / weight, source) AS k FROM w),
c AS (SELECT *, coalesce(sum(2 * source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held,
        sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free,
        1.5::DOUBLE * (SELECT sum(source_size) FROM s) AS total FROM o),
f AS (SELECT *, weight::DOUBLE * (total - held::DOUBLE) / free::DOUBLE > 2 * source_size AS full_ FROM c),
e AS (SELECT total - coalesce(sum(2 * source_size) FILTER (full_), 0)::DOUBLE AS left_, sum(weight) FILTER (NOT full_)::DOUBLE AS free FROM f GROUP BY total),
t AS (SELECT source, source_size, CASE WHEN full_ THEN 2.0::DOUBLE * source_size ELSE weight::DOUBLE * left_ / e.free END AS target FROM f, e),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
r AS (SELECT d.*, source_size, target, whole, target - whole * source_size AS extra,
        sum(size) OVER (PARTITION BY d.source ORDER BY draw RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
      FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
b AS (SELECT source, min(struct_pack(off := abs(upto - extra), draw := draw)) AS at_ FROM (
        SELECT source, upto, extra, draw FROM r WHERE size > 0
        UNION ALL SELECT DISTINCT source, 0, extra, '' FROM r) GROUP BY source)
SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN draw <= at_.draw THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r JOIN b ON r.source IS NOT DISTINCT FROM b.source
"""
