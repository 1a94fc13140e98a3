"""Scans. Every relation that has an order carries it as ``ordinal``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions import textops as T
from weftline.operators.metrics import zipped
from weftline.operators.ordering import written

#: Blocks of files up to this number (some 150 bytes each) are broadcast.
FEW_BLOCKS = 500_000
VALIDATION = "map<string,struct<Validation:map<string,struct<source:string>>>>"
HYPOTHESES = "map<string,map<string,string>>"
MEMORY = "map<string,string>"
REPORT = "per_file map<string,map<string,bigint>>"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(path, ordinal, value)``: lines in file order, counted from 0 in each file; a folder of part files counts as one file.

    Nothing is sorted or copied: lines are counted by the blocks that tasks
    read, sums over blocks say where each begins, and a line's place in its
    block follows from the order in which the task reads it. Blocks that are
    cut otherwise when the lines are read, or files that changed, are an error.
    """
    file, block, at = F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()
    raw = spark.read.text(path).select("value", file.alias("__file"), block.alias("__block"), at.alias("__id"))
    # A row for each block of a file.
    blocks = raw.groupBy(F.col("__file").alias("__f"), F.col("__block").alias("__b")).agg(F.count("*").alias("__n"), F.min("__id").alias("__first"), F.max("__id").alias("__last"))
    whole = F.regexp_replace("__f", r"/part-[^/]*$", "")
    before = W.partitionBy(whole).orderBy("__f", "__b").rowsBetween(W.unboundedPreceding, -1)
    blocks = written(blocks.withColumns({"path": whole, "__offset": F.coalesce(F.sum("__n").over(before), F.lit(0))}))
    small = F.broadcast if blocks.count() <= FEW_BLOCKS else (lambda df: df)
    joined = raw.join(small(blocks), (F.col("__file") == F.col("__f")) & (F.col("__block") == F.col("__b")), "left")
    known = F.col("__id").between(F.col("__first"), F.col("__last")) & (F.col("__last") - F.col("__first") + 1 == F.col("__n"))
    changed = F.raise_error(F.concat(F.lit("files or their blocks changed while they were read: "), F.col("__file"))).cast("long")
    ordinal = F.when(known, F.col("__id") - F.col("__first") + F.col("__offset")).otherwise(changed)
    return joined.select("path", ordinal.alias("ordinal"), "value")


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """``(path, ordinal, src, tgt)``: blank lines are skipped, a line of any but two fields is an error."""
    lines = read_lines(spark, path).where(F.col("value") != "").withColumn("__f", F.split("value", "\t", -1))
    where = F.concat(F.col("path"), F.lit(":"), (F.col("ordinal") + 1).cast("string"), F.lit(": expected 2 fields"))
    fields = F.when(F.size("__f") == 2, F.col("__f")).otherwise(F.raise_error(where).cast("array<string>"))
    return lines.withColumn("__g", fields).select("path", "ordinal", F.col("__g")[0].alias("src"), F.col("__g")[1].alias("tgt"))


def read_corpus(spark: SparkSession, root: str) -> DataFrame:
    """All ``{pair}/{split}.tsv`` below ``root`` with ``pair, split, lang`` (the target's) from the path."""
    rows = read_tsv(spark, f"{root}/*/*.tsv")
    part = lambda k: F.regexp_extract("path", r"([^/]+)/([^/]+)\.tsv$", k)
    return rows.select(part(1).alias("pair"), part(2).alias("split"), F.regexp_extract("path", r"_(\w+)/[^/]+\.tsv$", 1).alias("lang"), "ordinal", "src", "tgt")


def read_pair(spark: SparkSession, hyp_path: str, ref_path: str, known: list[str]) -> DataFrame:
    """Two files zipped by position: ``(ordinal, lang, hyp, ref)`` of hypothesis lines and a tagged TSV; different lengths are an error."""
    hyp = read_lines(spark, hyp_path).select("ordinal", F.col("value").alias("hyp"))
    ref = read_tagged(spark, ref_path, known).select("ordinal", "lang", F.col("tgt").alias("ref"))
    return zipped(hyp, ref).join(ref.select("ordinal", "lang"), "ordinal").select("ordinal", "lang", "hyp", "ref")


def read_tagged(spark: SparkSession, path: str, known: list[str]) -> DataFrame:
    """Tagged TSV as ``(ordinal, lang, src, tgt)``."""
    rows = read_tsv(spark, path).withColumn("__t", T.split_tag(F.col("src"), known))
    return rows.select("ordinal", F.col("__t.lang").alias("lang"), F.col("__t.text").alias("src"), "tgt")


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("j"))


def read_validation(spark: SparkSession, path: str) -> DataFrame:
    """Nested JSON as ``(section, ordinal, id, source)`` in document order."""
    sections = _json(spark, path, VALIDATION).select(F.posexplode("j").alias("s", "section", "v"))
    return sections.select("section", F.posexplode("v.Validation").alias("ordinal", "id", "r")).select("section", "ordinal", "id", F.col("r.source").alias("source"))


def read_hypotheses(spark: SparkSession, path: str) -> DataFrame:
    """``(section, id, hyp)`` from nested JSON."""
    return _json(spark, path, HYPOTHESES).select(F.explode("j").alias("section", "m")).select("section", F.explode("m").alias("id", "hyp"))


def read_memory_json(spark: SparkSession, path: str | None) -> DataFrame:
    """``(lang, src, tgt)`` from a flat JSON object whose keys are language, tab, source; no path is an empty memory."""
    if not path:
        return spark.createDataFrame([], "lang string, src string, tgt string")
    flat = _json(spark, path, MEMORY).select(F.explode("j").alias("k", "tgt"))
    return flat.select(F.substring_index("k", "\t", 1).alias("lang"), F.element_at(F.split("k", "\t", 2), 2).alias("src"), "tgt")


def read_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).schema("step long, dev_loss double").json(path)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """``(file, counter, n)`` of a report's ``per_file``."""
    files = _json(spark, path, REPORT).select(F.explode("j.per_file").alias("file", "c"))
    return files.select("file", F.explode("c").alias("counter", "n"))


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """``(slice, bleu, rouge_l, chrf, total, n)`` of a score file."""
    each = _json(spark, path, "map<string,string>").select(F.explode("j").alias("slice", "v")).where("slice <> 'cross_check'")
    return each.select("slice", F.from_json("v", "bleu double, rouge_l double, chrf double, total double, n long").alias("s")).select("slice", "s.*")


def read_settings(path: str) -> dict:
    """A YAML file as nested dicts; needs the optional package."""
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("reading YAML needs the package yaml") from e
    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f)
