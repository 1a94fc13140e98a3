"""What several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.ordering import forget
from weftline.operators.ordering import written as materialise

__all__ = ["FEW_KEYS", "HOT", "WORD", "col", "count_words", "draw_key", "few", "forget", "least_draws", "materialise", "met", "nested", "table", "unnested"]

#: Keys with more than one in this many of all rows are told to every task, so there are at most as many.
HOT = 10_000

#: Keys up to this number (16 to 32 bytes each) are broadcast, so that rows are not shuffled.
FEW_KEYS = 400_000

#: A word is a run of anything but space, tab, line feed, vertical tab, form feed and return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def col(name: str) -> Column:
    """The column of that very name, which may hold points."""
    return F.col("`" + name.replace("`", "``") + "`")


def nested(docs: DataFrame, names: Sequence[str] | None = None) -> Column:
    """The row as one struct, so that no name an operator uses can clash with its columns."""
    return F.struct(*[col(c) for c in (docs.columns if names is None else names)]).alias("row")


def unnested(docs: DataFrame, row: str = "row") -> list[Column]:
    return [F.col(row).getField(c).alias(c) for c in docs.columns]


def few(table: DataFrame, most: int) -> DataFrame:
    """A written table of keys, to be broadcast if it has no more than ``most`` rows, which are counted."""
    return F.broadcast(table) if table.count() <= most else table


def count_words(text: Column) -> Column:
    """Number of words of a text as a long; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw_key(seed: int, key: Column) -> Column:
    """A seeded pseudo-random string for each key, the same in every run and engine."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))))


def least_draws(rows: DataFrame, limit: int, keep: Column | None = None, total: int | None = None, draw: str = "draw") -> DataFrame:
    """Of the rows that ``keep`` holds for, the ``limit`` ones with the least draw keys (of equal ones any), without sorting all rows.

    Keys are evenly spread, so a cut a little above the wanted share leaves few
    rows to sort, and to ask ``keep`` of; a cut that leaves too few is raised.
    ``total`` is about the number of rows; they are counted if it is not given.
    """
    keep = F.lit(True) if keep is None else keep
    total = rows.count() if total is None else total
    share = 4 * limit / total if total else 1.0
    while share < 1.0:
        near = materialise(rows.where(F.col(draw) < f"{int(share * (1 << 64)):016x}").where(keep))
        if near.count() >= limit:
            return near.orderBy(draw).limit(limit)
        forget(near)
        share *= 4
    return rows.where(keep).orderBy(draw).limit(limit)


def met(rows: DataFrame, known: DataFrame, on: list[str], few: int, hot: int = HOT) -> DataFrame:
    """``rows`` joined with ``known``, which has one row for each key with its number ``m`` of rows; no task gathers a hot key.

    Up to ``few`` keys are broadcast; beyond that only the hot ones are, and
    the rows of the others are shuffled.
    """
    n, total = known.agg(F.count("*"), F.sum("m")).first()
    if n <= few:
        return rows.join(F.broadcast(known.drop("m")), on)
    cut = (total or 0) // hot
    top, rest = F.broadcast(known.where(F.col("m") > cut).drop("m")), known.where(F.col("m") <= cut).drop("m")
    return rows.join(top, on).unionByName(rows.join(top.select(*on), on, "left_anti").join(rest, on))
