"""Command lines: ``python -m weftline prepare|lid|gate|score|submit ...``; the session comes from the Spark configuration."""

from __future__ import annotations

import argparse
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.config import DEFAULT
from weftline.functions import textops as T
from weftline.operators import corpus, filters, gates, langid, metrics, ordering, preparation
from weftline.operators.ordering import written
from weftline.sources import readers, sinks


def prepare(spark: SparkSession, a: argparse.Namespace) -> None:
    """Raw ``{pair}/{split}.tsv`` to clean ones, tagged ones, translation memories and a report."""
    config = replace(DEFAULT, fold_bengali_danda=a.fold_bengali_danda)
    lid = langid.load_json(spark, a.lid, a.langs) if a.lid else None
    raw = readers.read_corpus(spark, a.raw)
    files = sorted({"/".join(f.split("/part-")[0].rsplit("/", 2)[1:]).removesuffix(".tsv") for f in raw.inputFiles() if ".tsv" in f})
    rows, counters = filters.observed(preparation.prepared(raw, config, lid).withColumn("file", F.concat_ws("/", "pair", "split")), "file", files)
    # One job writes the kept pairs and counts them all.
    kept = written(preparation.kept(rows).drop("file"))
    counters = spark.createDataFrame(counters(), "file string, counter string, n long")
    sinks.write_corpus(kept, f"{a.out}/pairs")
    place = F.array_position(F.array(*[F.lit(x) for x in a.langs]), F.col("lang"))
    tagged = kept.withColumns({"src": T.tag_source(F.col("src"), F.col("lang")), "pair": F.lit("combined"), "ordinal": F.struct(place, "ordinal")})
    sinks.write_corpus(tagged, a.out)
    # Of targets seen equally often the first: by split, then by position.
    seen = kept.withColumn("seen", F.array_position(F.array(*[F.lit(x) for x in ("train", "dev", "test")]), F.col("split")) * (1 << 40) + F.col("ordinal"))
    memories = {k: corpus.translation_memory(df, ["lang", "src"], "tgt", F.col("seen")) for k, df in (("tm_all", seen), ("tm_train", seen.where("split = 'train'")))}
    for name, memory in memories.items():
        sinks.write_memory_json(memory, f"{a.out}/{name}.json")
    covered = spark.createDataFrame([], "section string, records long, hits long, pct double")
    if a.validation:
        sections = dict(x.split("=", 1) for x in a.section)
        items = readers.read_validation(spark, a.validation).select("section", F.create_map(*[F.lit(x) for kv in sections.items() for x in kv])[F.col("section")].alias("lang"), T.normalise(F.col("source"), None).alias("src"))
        covered = corpus.coverage(items, memories["tm_all"], ["lang", "src"], "section")
    sinks.write_json(preparation.report_json(counters, covered, config, lid is not None), f"{a.out}/report.json")


def lid(spark: SparkSession, a: argparse.Namespace) -> None:
    """A language model of both sides of the training pairs, normalised, at most ``limit`` texts a class; held-out accuracy and mistakes."""
    rows = readers.read_corpus(spark, a.raw).where("split = 'train'")
    english = rows.select(T.normalise(F.col("src"), None).alias("text"), F.lit("en").alias("lang"))
    both = english.unionByName(rows.select(T.normalise(F.col("tgt"), F.col("lang")).alias("text"), "lang")).where("text <> ''")
    keyed = both.withColumn("key", F.xxhash64("lang", "text"))
    samples = written(langid.bounded_samples(keyed, "key", "lang", "text", a.limit, a.seed) if a.limit else keyed)
    # Texts that repeat are on one side: they have one key.
    held, rest = ordering.holdout_split(samples, "key", min(a.holdout, samples.count() // 10), a.seed)
    model = langid.fit(rest, "text", "lang", a.langs)
    langid.save_json(model, a.out)
    said = written(held.withColumn("predicted", langid.predictor(model)(F.col("text"))))
    langid.accuracy(said, "lang", "predicted").withColumn("accuracy", F.try_divide("correct", "n")).show()
    langid.confusion(said, "lang", "predicted").where("truth <> predicted").orderBy(F.desc("n"), "truth", "predicted").show(10, truncate=False)


def gate(spark: SparkSession, a: argparse.Namespace) -> None:
    """Quality gates of a prepared folder: metrics, texts, counters, and leaks of training sources; fails if one does."""
    rows = readers.read_corpus(spark, f"{a.out}/pairs")
    held = written(rows.where("split <> 'train'").withColumns({"id": F.xxhash64("pair", "split", "ordinal"), "ref": F.col("tgt")}))
    ranked = ordering.global_rank(held.select("id", "ref"), [F.col("id")], "ordinal")
    counters = readers.read_report(spark, f"{a.out}/report.json")
    train = rows.where("split = 'train'")
    left = corpus.without_leaks(train, held, ["lang", "src"])
    found = written(reduce(DataFrame.unionByName, [
        gates.metric_gates(ranked), gates.text_gate(rows, "tgt"), gates.conservation_gate(counters),
        gates.gate(train.agg(F.count("*").alias("n")).join(left.agg(F.count("*").alias("m"))), "no_leaks", F.col("n") == F.col("m"), F.col("n") - F.col("m")),
    ]))
    found.orderBy("gate").show(truncate=False)
    gates.totals(found).show()
    if gates.failed(found).first()["failed"]:
        raise SystemExit(1)


def score(spark: SparkSession, a: argparse.Namespace) -> None:
    """BLEU, ROUGE-L and chrF++ of hypothesis lines against a tagged TSV, overall and by language."""
    rows = written(readers.read_pair(spark, a.hyp, a.ref, a.langs).withColumnRenamed("ordinal", "id"))
    scores = written(metrics.score_report(rows, "lang"))
    scores.orderBy("slice").show(truncate=False)
    if a.out:
        sinks.write_json(sinks.scores_json(scores, metrics.cross_check(rows) if a.cross_check else None), a.out)


def submit(spark: SparkSession, a: argparse.Namespace) -> None:
    """The answer file: from the memory, else from the hypotheses, every id once."""
    sections = dict(x.split("=", 1) for x in a.section)
    order = F.array_position(F.array(*[F.lit(s) for s in sections]), F.col("section"))
    lang = F.create_map(*[F.lit(x) for kv in sections.items() for x in kv])[F.col("section")]
    items = written(readers.read_validation(spark, a.validation).where(order > 0).select(order.alias("place"), "ordinal", "id", lang.alias("lang"), T.normalise(F.col("source"), None).alias("src")))
    rows = corpus.submission(items, readers.read_memory_json(spark, a.tm), readers.read_hypotheses(spark, a.hyps).select("id", "hyp"), ["lang", "src"], "id")
    corpus.text_diagnostics(rows).show()
    sinks.write_submission(rows, a.out, "place", "ordinal")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="weftline")
    sub = top.add_subparsers(dest="command", required=True)

    def command(f, *options: tuple[str, dict]) -> None:
        p = sub.add_parser(f.__name__, help=f.__doc__)
        p.set_defaults(run=f)
        p.add_argument("--langs", nargs="+", default=list(DEFAULT.scripts))
        for name, how in options:
            p.add_argument(name, **how)

    need, many = {"required": True}, {"nargs": "+", "default": [], "help": "SECTION=LANG"}
    command(prepare, ("--raw", need), ("--out", need), ("--lid", {}), ("--validation", {}), ("--section", many), ("--fold-bengali-danda", {"action": "store_true"}))
    count = lambda n: {"type": int, "default": n}
    command(lid, ("--raw", need), ("--out", need), ("--limit", count(0)), ("--seed", count(13)), ("--holdout", count(2000)))
    command(gate, ("--out", need))
    command(score, ("--hyp", need), ("--ref", need), ("--out", {}), ("--cross-check", {"action": "store_true"}))
    command(submit, ("--validation", need), ("--section", {**many, "required": True}), ("--hyps", need), ("--tm", {}), ("--out", need))
    return top


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    a.run(SparkSession.builder.appName(f"weftline {a.command}").getOrCreate(), a)


if __name__ == "__main__":
    main()
