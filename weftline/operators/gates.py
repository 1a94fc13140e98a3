"""Quality gates: assertion aggregates as ``(gate, status, detail)`` rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import textops as T
from weftline.operators import metrics
from weftline.operators.ordering import rotated


def gate(facts: DataFrame, name: str, ok: Column, detail: Column) -> DataFrame:
    """A row from a one-row table of facts."""
    return facts.select(F.lit(name).alias("gate"), F.when(ok, "PASS").otherwise("FAIL").alias("status"), detail.cast("string").alias("detail"))


def skipped(spark, name: str, why: str) -> DataFrame:
    return spark.createDataFrame([(name, "SKIP", why)], "gate string, status string, detail string")


def metric_gates(rows: DataFrame) -> DataFrame:
    """Texts against themselves score 1, against their neighbours next to nothing; ``rows`` has ``ordinal, id, ref``."""
    self_ = rows.withColumn("hyp", F.col("ref"))
    shifted = rotated(rows, "ref").withColumn("hyp", F.col("shifted"))
    near = lambda c, eps: F.abs(F.col(c) - 1) < eps
    show = lambda c: F.round(c, 4)
    return reduce(DataFrame.unionByName, [
        gate(metrics.bleu(self_), "self_bleu", near("bleu", 1e-6), show("bleu")),
        gate(metrics.rouge_l(self_), "self_rouge_l", near("rouge_l", 1e-3), show("rouge_l")),
        gate(metrics.chrf(self_), "self_chrf", near("chrf", 1e-6), show("chrf")),
        gate(metrics.bleu(shifted), "shifted_bleu", F.col("bleu") < 0.05, F.col("bleu") < 0.05),
    ])


def text_gate(rows: DataFrame, text: str, most: float = 0.0) -> DataFrame:
    """No more than the share ``most`` of all texts may be degenerate."""
    facts = rows.agg(F.count("*").alias("n"), F.count_if(T.degenerate(F.col(text))).alias("bad"))
    return gate(facts, "non_degenerate", F.col("bad") <= F.lit(most) * F.col("n"), _ratio("bad", "n"))


def _ratio(a: str, b: str) -> Column:
    return F.concat_ws("/", F.col(a).cast("string"), F.col(b).cast("string"))


def roundtrip_gate(rows: DataFrame, text: str, back: str, least: float = 0.99) -> DataFrame:
    """More than the share ``least`` of all texts come back as they were."""
    facts = rows.agg(F.count("*").alias("n"), F.count_if(F.col(text).eqNullSafe(F.col(back))).alias("same"))
    return gate(facts, "roundtrip", F.col("same") > F.lit(least) * F.col("n"), _ratio("same", "n"))


def ids_gate(rows: DataFrame, ids: str, tags: list[int], special: list[int], end: int) -> DataFrame:
    """Every sequence begins with a tag and ends with the end mark, and neither they nor ``special`` stand inside."""
    inner = F.slice(ids, F.lit(2), F.greatest(F.size(ids) - 2, F.lit(0)))
    good = F.get(ids, F.lit(0)).isin(tags) & (F.element_at(ids, -1) == end) & ~F.arrays_overlap(inner, F.array(*[F.lit(x) for x in sorted({*tags, *special, end})]))
    facts = rows.agg(F.count("*").alias("n"), F.count_if(good).alias("good"))
    return gate(facts, "special_ids", F.col("good") == F.col("n"), _ratio("good", "n"))


def vocabulary_gate(spark, size: int, expected: int) -> DataFrame:
    return gate(spark.range(1).select(F.lit(size).alias("size")), "vocabulary_size", F.col("size") == expected, F.concat_ws("/", F.col("size").cast("string"), F.lit(str(expected))))


def unknown_gate(rows: DataFrame, ids: str, name: str, unk: int = 1, most: float = 0.005) -> DataFrame:
    """Fewer than the share ``most`` of all ids are unknown."""
    hits = F.sum(F.size(F.filter(ids, lambda x: x == unk)))
    facts = rows.agg(F.coalesce(hits, F.lit(0)).alias("unknown"), F.coalesce(F.sum(F.size(ids)), F.lit(0)).alias("ids"))
    return gate(facts, name, F.col("unknown") < F.lit(most) * F.greatest("ids", F.lit(1)), _ratio("unknown", "ids"))


def conservation_gate(counters: DataFrame) -> DataFrame:
    """What was read is what was dropped or kept."""
    n = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    c = F.col("counter")
    facts = counters.agg(n(c == "read").alias("read"), n(c.startswith("dropped_") | (c == "kept")).alias("out"))
    return gate(facts, "conservation", F.col("read") == F.col("out"), F.concat_ws("/", F.col("read").cast("string"), F.col("out").cast("string")))


def totals(gates: DataFrame) -> DataFrame:
    return gates.groupBy("status").agg(F.count("*").alias("n"))


def failed(gates: DataFrame) -> DataFrame:
    return gates.agg(F.coalesce(F.bool_or(F.col("status") == "FAIL"), F.lit(False)).alias("failed"))
