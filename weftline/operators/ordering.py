"""Dense global ranks and what follows from them, without sorting in one task."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is set and all run on this machine."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='weftline-')}")
        path = spark.sparkContext.getCheckpointDir()
    return path.rstrip("/")


def scratch(spark: SparkSession) -> str:
    """This application's own place in the shared folder."""
    return f"{shared_dir(spark)}/weftline/{spark.sparkContext.applicationId}"


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder, where its lineage ends.

    The files outlive any executor, so later stages recover without running
    what came before.
    """
    path = f"{scratch(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.written_to = path
    if _open:
        _open[-1].append(table)
    return table


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def forget(*tables: DataFrame) -> None:
    """Deletes what ``written`` wrote, once nothing is to be computed from these tables any more."""
    for t in tables:
        delete(t.sparkSession, t.written_to)


#: Tables written since each ``only_result`` that has not returned yet.
_open: list[list[DataFrame]] = []


def only_result(make: Callable[[], DataFrame]) -> DataFrame:
    """``make()`` as a written table; all others that were written on the way are deleted."""
    _open.append([])
    result = None
    try:
        result = written(make())
        return result
    finally:
        forget(*[t for t in _open.pop() if t is not result])
        if result is not None and _open:
            _open[-1].append(result)


def clear_written(spark: SparkSession) -> None:
    """Deletes this application's tables; results that were not saved elsewhere need them no more."""
    delete(spark, scratch(spark))


def global_rank(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Adds dense ranks from 0 in ``order``, which should be total.

    Rows are range-partitioned and ranked in their partition; the offsets are
    a table with a row for each partition.
    """
    parts = written(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    offsets = parts.groupBy("__part").agg(F.count("*").alias("__n")).select(
        "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset")
    )
    at = F.row_number().over(W.partitionBy("__part").orderBy(*order)) - 1
    return parts.withColumn("__at", at).join(F.broadcast(offsets), "__part").withColumn(name, (F.col("__offset") + F.col("__at")).cast("long")).drop("__part", "__at", "__offset")


def head_by_ordinal(df: DataFrame, n: int, ordinal: str = "ordinal") -> DataFrame:
    """The first ``n`` by position: a filter, never a bare limit."""
    return df.where(F.col(ordinal) < n)


def stride(df: DataFrame, total: int, n: int, ordinal: str = "ordinal") -> DataFrame:
    """``n`` evenly spaced rows."""
    step = max(total // n, 1)
    return df.where((F.col(ordinal) % step == 0) & (F.col(ordinal) < step * n))


def seeded_key(key: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def seeded_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows without replacement, the same in every run."""
    return df.withColumn("__draw", seeded_key(F.col(key), seed)).orderBy("__draw", key).limit(n).drop("__draw")


def top_per_group(df: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    return df.withColumn("__r", F.row_number().over(W.partitionBy(*group).orderBy(*order))).where(F.col("__r") <= n).drop("__r")


def holdout_split(df: DataFrame, key: str, n: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """``(holdout, rest)`` in seeded order."""
    held = seeded_sample(df, key, n, seed)
    return held, df.join(held.select(key), key, "left_anti")


def rotated(df: DataFrame, value: str, ordinal: str = "ordinal") -> DataFrame:
    """Adds ``shifted``: the next row's value, the first one's at the end; an equi-join on position."""
    n = df.agg(F.max(ordinal)).first()[0]
    if n is None:
        return df.withColumn("shifted", F.col(value))
    nxt = df.select(F.when(F.col(ordinal) == 0, n).otherwise(F.col(ordinal) - 1).alias(ordinal), F.col(value).alias("shifted"))
    return df.join(nxt, ordinal)
