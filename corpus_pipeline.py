"""Corpus pipeline: stages over ``documents``, each written as Parquet and read again by the next.

Every stage but the last returns the columns of ``documents``. The text of a
document may shrink in line dedup, and ``n_chars`` follows it; a document that
loses all its lines stays as an empty text until SimHash near-dedup, where all
empty texts are one group. Near-dedup takes shingles of five words and a
similarity of 0.8 or more. The last stage returns the mix: the documents it
takes, with their repetitions in ``mix_copies`` and the other ``mix_*``
columns; a consumer repeats a row as often as that says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import decontaminate, lines, mixing, quality, simhash
from weftline.llm.common import table
from weftline.operators.ordering import forget, only_result


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.quality_model(docs, table(spark, sf_dir, "labels"))
    return quality.keep_good(docs, model)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = lines.dedup_lines(docs)
    n_chars = F.when(F.col("lines_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long")
    return cut.withColumn("n_chars", n_chars).select(*docs.columns)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs, simhash.Similar(share=0.8, words=5))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(docs).where("mix_copies > 0")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("mixing_sources", mixing_sources),
]

#: A trained classifier and a transitive closure are not expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix as a written table; what the stages wrote on the way is deleted, each one's input when the next is done."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        before, docs = docs, only_result(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))
        if before is not docs and hasattr(before, "written_to"):
            forget(before)
    return docs
