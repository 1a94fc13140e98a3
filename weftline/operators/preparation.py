"""Corpus preparation from raw pairs to a clean corpus, with counters that add up.

Pairs have ``lang, split, src, tgt`` and an ``ordinal`` that orders a split.
Each is cleaned and filtered; of training pairs that repeat the first stays,
and those whose source stands in the other splits of the language go. Every
pair keeps its row with the ``reason`` why it went, so counters, kept pairs
and lines of any kind follow from one table.

Keys travel as 128-bit hashes, never as texts. Defined cases: a null side is
an empty field; an empty table gives an empty result; further columns pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.config import DEFAULT, Config
from weftline.operators import filters
from weftline.operators.corpus import hash_key
from weftline.operators.ordering import written

DUPLICATE, LEAKED = "duplicate", "leaked_into_eval"


def prepared(pairs: DataFrame, config: Config = DEFAULT, lid=None, train: str = "train") -> DataFrame:
    """Cleaned ``pairs`` with ``flags`` and ``reason`` (null: kept)."""
    rows = written(
        filters.filtered(filters.clean_pairs(pairs, config), config, lid)
        .withColumns({"__pair": hash_key("lang", "src", "tgt"), "__src": hash_key("lang", "src")})
    )
    # What follows needs hashes and positions only; texts are joined once, with the pairs that go.
    slim = rows.where("reason IS NULL").select("split", "ordinal", "__pair", "__src")
    own = slim.where(F.col("split") == train)
    first = own.groupBy(F.col("__pair").alias("__p")).agg(F.min("ordinal").alias("__first"))
    held = slim.where(F.col("split") != train).select(F.col("__src").alias("__s"), F.lit(True).alias("__held")).distinct()
    judged = own.join(first, F.col("__pair") == F.col("__p")).join(held, F.col("__src") == F.col("__s"), "left")
    late = F.when(F.col("ordinal") > F.col("__first"), DUPLICATE).when(F.coalesce("__held", F.lit(False)), LEAKED)
    gone = written(judged.select(F.col("ordinal").alias("__o"), F.col("__pair").alias("__q"), late.alias("__late")).where("__late IS NOT NULL").distinct())
    # Whether that is broadcast is up to the optimiser, which knows the written size.
    here = (F.col("split") == train) & F.col("reason").isNull() & (F.col("ordinal") == F.col("__o")) & (F.col("__pair") == F.col("__q"))
    joined = rows.join(gone, here, "left")
    return joined.withColumn("reason", F.coalesce("reason", "__late")).drop("__pair", "__src", "__o", "__q", "__late")


def kept(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("reason").isNull())


def report_json(counters: DataFrame, coverage: DataFrame, config: Config = DEFAULT, lid_enabled: bool = False) -> DataFrame:
    """One row ``value``: the report as a JSON object with ``config``, ``per_file`` and ``val_tm_coverage``.

    ``counters`` is ``(file, counter, n)`` and ``coverage`` ``(section, records, hits, pct)``: a bounded number of rows each.
    """

    def as_map(rows: DataFrame, key: str, value: Column) -> DataFrame:
        return rows.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(key), value)))).alias("m"))

    one = counters.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("counter", "n"))).alias("c"))
    files = one.agg(F.sort_array(F.collect_list(F.struct("file", "c"))).alias("f"))
    per_file = F.map_from_entries(F.transform("f", lambda x: F.struct(x["file"], F.map_from_entries(x["c"]))))
    found = F.struct("section", F.struct("records", F.col("hits").alias("tm_hits"), "pct"))
    covered = coverage.agg(F.map_from_entries(F.sort_array(F.collect_list(found))).alias("val_tm_coverage"))
    settings = F.struct(
        F.lit(config.fold_bengali_danda).alias("fold_bengali_danda"), F.lit(lid_enabled).alias("lid_enabled"),
        F.lit(config.min_script_ratio).alias("min_script_ratio"), F.lit(config.max_length_ratio).alias("max_len_ratio"),
    )
    return files.crossJoin(covered).select(F.to_json(F.struct(settings.alias("config"), per_file.alias("per_file"), "val_tm_coverage")).alias("value"))
