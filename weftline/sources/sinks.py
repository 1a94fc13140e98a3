"""Sinks. One ordered file is a range sort into one partition, only where the format is a single file."""

from __future__ import annotations

import json
import uuid
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import textops as T
from weftline.operators.ordering import delete, global_rank, scratch


def _single(df: DataFrame, *order) -> DataFrame:
    return df.orderBy(*order).coalesce(1)


def write_tsv(rows: DataFrame, path: str, ordinal: str = "ordinal", one_file: bool = False) -> None:
    """Fields joined by a tab, unquoted; a folder of files in order unless one is asked for."""
    picked = _single(rows, ordinal) if one_file else rows.repartitionByRange(ordinal).sortWithinPartitions(ordinal)
    picked.select(F.concat_ws("\t", "src", "tgt")).write.mode("overwrite").text(path)


def write_corpus(rows: DataFrame, root: str, pair: str = "pair", split: str = "split", ordinal: str = "ordinal") -> None:
    """``{pair}/{split}.tsv`` below ``root``, a folder each, for every pair and split that occurs: one job, then their folders get their names."""
    spark = rows.sparkSession
    # Never null and no constant: a constant is no sort key, and the writer would sort anew and lose the order in a file.
    never = F.when(F.monotonically_increasing_id() < 0, F.lit(""))
    picked = rows.select(F.coalesce(never, F.col(pair)).alias("pair"), F.coalesce(never, F.col(split)).alias("split"), F.col(ordinal).alias("o"), F.concat_ws("\t", "src", "tgt").alias("value"))
    made = f"{scratch(spark)}/{uuid.uuid4().hex}"
    picked.repartitionByRange("pair", "split", "o").sortWithinPartitions("pair", "split", "o").drop("o").write.partitionBy("pair", "split").text(made)
    path, conf = spark._jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()
    here, there = path(made).getFileSystem(conf), path(root).getFileSystem(conf)
    for f in here.globStatus(path(f"{made}/pair=*/split=*")) or []:
        names = [unquote(part.split("=", 1)[1]) for part in str(f.getPath().toString()).rsplit("/", 2)[1:]]
        to = path(f"{root}/{names[0]}/{names[1]}.tsv")
        there.delete(to, True)
        there.mkdirs(to.getParent())
        # Another file system than that of the shared folder is copied to, the same one renames.
        if here.getUri().equals(there.getUri()):
            here.rename(f.getPath(), to)
        else:
            spark._jvm.org.apache.hadoop.fs.FileUtil.copy(here, f.getPath(), there, to, False, conf)
    delete(spark, made)


def write_lines(rows: DataFrame, path: str, text: str, *order) -> None:
    """A line for each row, line feeds as blanks."""
    _single(rows, *order).select(T.one_line(F.col(text))).write.mode("overwrite").text(path)


def write_by_language(rows: DataFrame, path: str, langs: list[str], src: str = "src") -> None:
    """A folder for each language tag: a prefix filter."""
    lang = T.tag_language(F.col(src))
    rows.where(lang.isin(*langs)).withColumn("lang", lang).write.mode("overwrite").partitionBy("lang").parquet(path)


def _name(text: Column) -> Column:
    """A text as a JSON string."""
    listed = F.to_json(F.array(text))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def _member(key: Column, value: Column) -> Column:
    """``"key": value`` of a JSON object."""
    entry = F.to_json(F.create_map(key, value))
    return F.substring(entry, F.lit(2), F.length(entry) - 2)


def _object(ranked: DataFrame, line: Column, end: str) -> DataFrame:
    """Lines of a JSON object in the order of ``rank``, streamed into one file: no row holds more than a member."""
    opened = ranked.select("rank", F.concat(F.when(F.col("rank") == 0, F.lit("")).otherwise(F.lit(",")), line).alias("value"))
    spark = ranked.sparkSession
    marks = spark.createDataFrame([(-1, "{"), ((1 << 62), end)], "rank long, value string")
    return opened.unionByName(marks).orderBy("rank").coalesce(1).select("value")


def write_memory_json(memory: DataFrame, path: str) -> None:
    """One flat JSON object, keys in order. Parquet is the form to keep for large memories."""
    keyed = memory.select(F.concat("lang", F.lit("\t"), "src").alias("k"), "tgt")
    ranked = global_rank(keyed, [F.col("k")])
    _object(ranked, _member(F.col("k"), F.col("tgt")), "}").write.mode("overwrite").text(path)


def write_report(counters: DataFrame, path: str) -> None:
    counters.coalesce(1).write.mode("overwrite").json(path)


def write_json(one: DataFrame, path: str) -> None:
    """The one row ``value`` of a report as a JSON file."""
    one.select("value").coalesce(1).write.mode("overwrite").text(path)


def write_history(history: DataFrame, path: str) -> None:
    """``step, dev_loss`` as a JSON array in order of steps."""
    one = history.agg(F.to_json(F.sort_array(F.collect_list(F.struct("step", "dev_loss")))).alias("value"))
    write_json(one, path)


def write_hypotheses(rows: DataFrame, path: str) -> None:
    """A folder for each section, as Parquet."""
    rows.write.mode("overwrite").partitionBy("section").parquet(path)


def write_hypotheses_json(rows: DataFrame, path: str) -> None:
    """``{section: {id: hyp}}``, streamed in the order of sections and ids."""
    ranked = global_rank(rows.select("section", "id", "hyp"), [F.col("section"), F.col("id")])
    starts = ranked.groupBy(F.col("section").alias("s")).agg(F.min("rank").alias("first"))
    # A row for each section.
    marked = ranked.join(F.broadcast(starts), F.col("section") == F.col("s"))
    head = F.concat(F.when(F.col("rank") > 0, F.lit("},")).otherwise(F.lit("")), _name(F.col("section")), F.lit(":{"))
    line = F.concat(F.when(F.col("rank") == F.col("first"), head).otherwise(F.lit(",")), _member(F.col("id"), F.col("hyp")))
    marks = rows.sparkSession.createDataFrame([(-1, "{"), ((1 << 62), "}}")], "rank long, value string")
    if ranked.isEmpty():
        marks = rows.sparkSession.createDataFrame([(0, "{}")], "rank long, value string")
    marked.select("rank", line.alias("value")).unionByName(marks).orderBy("rank").coalesce(1).select("value").write.mode("overwrite").text(path)


def write_hypotheses_lines(rows: DataFrame, path: str, *order) -> None:
    write_lines(rows, path, "hyp", *order)


def scores_json(scores: DataFrame, checks: dict | None = None) -> DataFrame:
    """One row ``value``: ``{slice: {bleu, rouge_l, chrf, total, n}}`` and ``cross_check`` if there is one."""
    entry = F.struct("slice", F.to_json(F.struct("bleu", "rouge_l", "chrf", "total", "n")).alias("j"))
    parts = F.transform("x", lambda x: F.concat(_name(x["slice"]), F.lit(":"), x["j"]))
    tail = [] if checks is None else [F.lit('"cross_check":' + json.dumps(checks))]
    rows = scores.agg(F.sort_array(F.collect_list(entry)).alias("x")).select(parts.alias("p"))
    return rows.select(F.concat(F.lit("{"), F.array_join(F.concat("p", F.array(*tail).cast("array<string>")), ","), F.lit("}")).alias("value"))


def write_submission(rows: DataFrame, path: str, *order) -> None:
    """Tab-separated, every field quoted, with a header and CRLF."""
    _single(rows, *order).select(F.col("id").alias("ID"), F.col("text").alias("Translation")).write.mode("overwrite").csv(
        path, sep="\t", quoteAll=True, header=True, escape='"', lineSep="\r\n", emptyValue="", nullValue=""
    )


def write_scores(scores: DataFrame, path: str) -> None:
    """Lines ``name: value`` of a one-row score table, three places each, and their total."""
    names = ["bleu", "rouge_l", "chrf"]
    rounded = [F.round(c, 3).alias(c) for c in names]
    total = scores.select(*rounded).withColumn("total", F.round(sum((F.col(c) for c in names[1:]), F.col(names[0])), 3))
    lines = F.array(*[F.format_string("%s: %f", F.lit(c), F.col(c)) for c in [*names, "total"]])
    total.select(F.explode(lines)).coalesce(1).write.mode("overwrite").text(path)


def copy_existing(spark, paths: list[str], target: str) -> list[str]:
    """Copies the files that exist to ``target`` through the cluster's file systems; returns which."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder, done = jvm.org.apache.hadoop.fs.Path(target), []
    to = folder.getFileSystem(conf)
    to.mkdirs(folder)
    for p in paths:
        src = jvm.org.apache.hadoop.fs.Path(p)
        fs = src.getFileSystem(conf)
        if fs.exists(src):
            jvm.org.apache.hadoop.fs.FileUtil.copy(fs, src, to, jvm.org.apache.hadoop.fs.Path(folder, src.getName()), False, conf)
            done.append(p)
    return done
