"""Aggregates around training runs: losses, schedules, checkpoints, early stopping, candidates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions import textops as T
from weftline.operators.ordering import delete


def token_loss(rows: DataFrame, by: list[str], loss: str, tokens: str) -> DataFrame:
    return rows.groupBy(*by).agg((F.sum(loss) / F.greatest(F.sum(tokens), F.lit(1))).alias("loss"))


def unknown_rate(rows: DataFrame, ids: str, unk: int = 1) -> DataFrame:
    hits = F.sum(F.size(F.filter(ids, lambda x: x == unk)))
    return rows.agg(hits.cast("long").alias("unknown"), F.sum(F.size(ids)).cast("long").alias("tokens"), F.coalesce(F.try_divide(hits.cast("double"), F.sum(F.size(ids))), F.lit(0.0)).alias("rate"))


def exact_rate(rows: DataFrame, a: str, b: str) -> DataFrame:
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col(a).eqNullSafe(F.col(b))).alias("matches"))


def vocabulary(rows: DataFrame, words: Column, size: int) -> list[str]:
    """The ``size`` commonest words, commonest first (of equals the smaller word): a list of bounded length."""
    counts = rows.select(F.explode(words).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    return [r["w"] for r in counts.orderBy(F.desc("n"), "w").limit(size).collect()]


def word_encoder(known: list[str], first: int, unk: int = 1):
    """A column function from words to ids: ``first`` and up in the order of ``known``, else ``unk``; in Arrow batches, no shuffle."""

    ids = {w: first + k for k, w in enumerate(known)}

    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words, numbers = pa.array(ids, pa.string()), pa.array(ids.values(), pa.int32())
        for b in batches:
            # Values and sizes alone, since null rows may have values of their own.
            found = pc.fill_null(numbers.take(pc.index_in(b.flatten(), value_set=words)), unk)
            ends = np.cumsum(pc.fill_null(pc.list_value_length(b), 0).to_numpy(zero_copy_only=False))
            yield pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), found, mask=b.is_null())

    return encode


def word_decoder(known: list[str], first: int, unk_piece: str = "<unk>"):
    """A column function from ids to text; ids that ``known`` lacks become ``unk_piece``."""
    names = F.array(*[F.lit(w) for w in known])
    word = lambda i: F.coalesce(F.get(names, i - F.lit(first)), F.lit(unk_piece))
    return lambda ids: F.array_join(F.transform(ids, word), " ")


def schedule(steps: DataFrame, step: str, d_model: int, warmup: int, scale: float = 1.0) -> DataFrame:
    """Adds the learning ``rate`` of each step."""
    return steps.withColumn("rate", T.noam_rate(F.col(step), d_model, warmup, scale))


def patience(history: DataFrame, run: str, step: str, loss: str, limit: int) -> DataFrame:
    """Adds ``best`` (before this step), ``bad`` (steps without improvement up to here) and ``stop``; a run is short."""
    order = W.partitionBy(run).orderBy(step)
    marked = history.withColumn("best", F.min(loss).over(order.rowsBetween(W.unboundedPreceding, -1)))
    better = F.col("best").isNull() | (F.col(loss) < F.col("best"))
    streaks = marked.withColumn("__streak", F.sum(better.cast("int")).over(order))
    bad = F.row_number().over(W.partitionBy(run, "__streak").orderBy(step)) - 1
    return streaks.withColumn("bad", bad.cast("long")).withColumn("stop", F.col("bad") >= limit).drop("__streak")


def average_checkpoints(parameters: DataFrame, name: str, values: str) -> DataFrame:
    """``(name, values)``: the mean of each position over all checkpoints."""
    each = parameters.select(name, F.posexplode(values).alias("pos", "v"))
    mean = each.groupBy(name, "pos").agg(F.avg(F.col("v").cast("double")).alias("v"))
    return mean.groupBy(name).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "v"))), lambda x: x["v"]).alias(values))


def checkpoint_name(step: int) -> str:
    return f"step{step}.parquet"


def save_checkpoint(state: DataFrame, folder: str, step: int) -> None:
    state.write.mode("overwrite").parquet(f"{folder}/{checkpoint_name(step)}")


def checkpoints(spark: SparkSession, folder: str) -> DataFrame:
    """``(path, step)`` of the checkpoints in a folder that any file system of Spark's holds; those not written to the end are left out."""
    base = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(base, "step*.parquet/_SUCCESS")) or []
    rows = spark.createDataFrame([(str(f.getPath().getParent().toString()),) for f in found], "path string")
    return rows.withColumn("step", F.regexp_extract("path", r"step(\d+)\.[^.]*$", 1).cast("long")).where("step IS NOT NULL")


def prune_checkpoints(spark: SparkSession, folder: str, keep: int) -> list[str]:
    """Deletes all checkpoints but the ``keep`` latest; returns what went, in order of steps."""
    if keep < 1:
        raise ValueError("at least one checkpoint must stay")
    # Names in one folder: as many as checkpoints were saved.
    old = [r["path"] for r in checkpoints(spark, folder).orderBy("step").collect()][:-keep]
    for path in old:
        delete(spark, path)
    return old


def resume_point(spark: SparkSession, folder: str) -> DataFrame | None:
    """The state of the latest whole checkpoint with its ``step``; None if there is none."""
    last = checkpoints(spark, folder).orderBy(F.desc("step")).first()
    return None if last is None else spark.read.parquet(last["path"]).withColumn("step", F.lit(last["step"]))


def latest_checkpoints(listing: DataFrame, path: str, n: int) -> DataFrame:
    """The last ``n`` by the number at the end of their names."""
    step = F.regexp_extract(path, r"(\d+)\.[^.]*$", 1).cast("long")
    return listing.withColumn("step", step).where("step IS NOT NULL").orderBy(F.desc("step")).limit(n)


def k_best(candidates: DataFrame, key: str, score: Column, length: Column, alpha: float, order: Column, k: int) -> DataFrame:
    """The ``k`` candidates of each key with the best length-normalised scores, with ``score`` and ``place`` from 0.

    Every task keeps the best ``k`` of its own before the shuffle, so a key
    with very many candidates sends few of them.
    """
    value = candidates.withColumns({"score": score / T.length_penalty(length, alpha), "__o": order})
    over = W.partitionBy(key).orderBy(F.desc("score"), "__o")
    return value.withColumn("__k", F.row_number().over(over)).where(F.col("__k") <= k).withColumn("place", F.col("__k").cast("long") - 1).drop("__k", "__o")


def best_candidate(candidates: DataFrame, key: str, score: Column, length: Column, alpha: float, order: Column, keep: str) -> DataFrame:
    """Of each key the candidate with the best length-normalised score; of equals the first."""
    value = score / T.length_penalty(length, alpha)
    best = F.struct(value.alias("v"), (-order).alias("o"))
    return candidates.groupBy(key).agg(F.max_by(keep, best).alias(keep), F.max(value).alias("score"))


def vocabulary_coverage(vocabulary: DataFrame, known: DataFrame, key: str) -> DataFrame:
    hit = known.select(key).distinct().withColumn("__hit", F.lit(1))
    joined = vocabulary.select(key).distinct().join(hit, key, "left")
    return joined.agg(F.count("*").alias("vocabulary"), F.count("__hit").alias("hits"))


def word_vectors(rows: DataFrame, words: str, size: int = 512, window: int = 5, epochs: int = 5, seed: int = 1):
    """A fitted skip-gram model over arrays of words."""
    from pyspark.ml.feature import Word2Vec

    return Word2Vec(vectorSize=size, windowSize=window, minCount=1, maxIter=epochs, seed=seed, inputCol=words, outputCol="vector").fit(rows)


def translated(rows: DataFrame, translate, schema: str) -> DataFrame:
    """Hook for a model: ``translate`` maps an iterator of pandas batches to another, in executors."""
    return rows.mapInPandas(translate, schema)
