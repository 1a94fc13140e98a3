"""Structured Streaming forms of cleaning, filtering, de-leaking and counting.

Cleaning and drop reasons are projections, so the batch functions run on a
stream as they are. The static side of de-leaking is read anew by each
micro-batch. Exact duplicates are kept out within a watermark only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.config import DEFAULT, Config
from weftline.operators import corpus, filters


def cleaned(stream: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Cleaned pairs with ``flags`` and ``reason``; keep rows whose reason is null."""
    return filters.filtered(filters.clean_pairs(stream, config), config)


def without_leaks(stream: DataFrame, held: DataFrame, keys: list[str]) -> DataFrame:
    """Stream rows whose keys are in no row of the static ``held``."""
    known = held.select(corpus.hash_key(*keys).alias("__held"))
    return stream.withColumn("__key", corpus.hash_key(*keys)).join(known, F.col("__key") == F.col("__held"), "left_anti").drop("__key")


def counters(stream: DataFrame, by: str) -> DataFrame:
    """Running counters in long form; output mode update or complete."""
    return filters.report(stream, by)


def distinct_within(stream: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def windowed_counters(stream: DataFrame, time: str, delay: str, width: str) -> DataFrame:
    """Reasons by event-time window, append mode, late rows dropped after ``delay``."""
    reason = F.coalesce("reason", F.lit("kept"))
    return stream.withWatermark(time, delay).groupBy(F.window(time, width), reason.alias("reason")).agg(F.count("*").alias("n"))
