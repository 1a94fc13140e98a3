"""Queries that write a file of each kind, read it back and return what was read."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import functions as F

from weftline.functions import textops as T
from weftline.operators import corpus, filters, langid, metrics, preparation
from weftline.operators.ordering import scratch, written
from weftline.plans import cleaning, corpora, language, scoring
from weftline.plans import tables as P
from weftline.sources import readers, sinks


def _place(spark, name):
    return f"{scratch(spark)}/{uuid.uuid4().hex}/{name}"


def _flat_pairs(spark, sf_dir):
    """Pairs as TSV can hold them: no tabs and line ends in a field, and one position each."""
    flat = lambda c: F.translate(c, "\t\r\n", "   ")
    rows = P.pairs(spark, sf_dir).withColumns({"src": flat("src"), "tgt": flat("tgt"), "ordinal": F.col("conv_id") * 1000 + F.col("turn")})
    return rows.select("ordinal", "split", "lang", "src", "tgt")


def _digest(*columns):
    return [F.md5(c).alias(f"{c}_md5") for c in columns]


def tsv_roundtrip(spark, sf_dir):
    path = _place(spark, "pairs.tsv")
    sinks.write_tsv(_flat_pairs(spark, sf_dir), path)
    return readers.read_tsv(spark, path).select("ordinal", *_digest("src", "tgt"))


def corpus_layout(spark, sf_dir):
    root = _place(spark, "corpus")
    sinks.write_corpus(_flat_pairs(spark, sf_dir).withColumn("pair", F.concat(F.lit("en_"), "lang")), root)
    return readers.read_corpus(spark, root).select("pair", "split", "lang", "ordinal", *_digest("src", "tgt"))


def tagged_roundtrip(spark, sf_dir):
    path = _place(spark, "tagged.tsv")
    sinks.write_tsv(_flat_pairs(spark, sf_dir).withColumn("src", T.tag_source(F.col("src"), F.col("lang"))), path)
    return readers.read_tagged(spark, path, P.LANGS).select("ordinal", "lang", *_digest("src", "tgt"))


def zipped_files(spark, sf_dir):
    """Hypothesis lines and a tagged TSV, zipped by position and scored by ROUGE-L's parts."""
    hyps, refs = _place(spark, "hyps.txt"), _place(spark, "refs.tsv")
    rows = _flat_pairs(spark, sf_dir)
    sinks.write_hypotheses_lines(P.scored(rows, "tgt").select("ordinal", "hyp"), hyps, "ordinal")
    sinks.write_tsv(rows.withColumn("src", T.tag_source(F.col("src"), F.col("lang"))), refs)
    return readers.read_pair(spark, hyps, refs, P.LANGS).select("ordinal", "lang", *_digest("hyp", "ref"))


def validation_json(spark, sf_dir):
    path = _place(spark, "validation.json")
    items = P.table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("id"), F.struct(F.col("text").alias("source")).alias("r"), "item_id")
    entries = F.transform(F.sort_array(F.collect_list(F.struct("item_id", "id", "r"))), lambda x: F.struct(x["id"], x["r"]))
    one = items.agg(F.map_from_entries(entries).alias("v"))
    sinks.write_json(one.select(F.to_json(F.create_map(F.lit("English"), F.struct(F.col("v").alias("Validation")))).alias("value")), path)
    return readers.read_validation(spark, path).select("section", F.col("ordinal").cast("long").alias("ordinal"), "id", *_digest("source"))


def _hypotheses(spark, sf_dir):
    rows = P.table(spark, sf_dir, "conversations")
    return rows.select(F.col("role").alias("section"), F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("text").alias("hyp"))


def hypotheses_json(spark, sf_dir):
    path = _place(spark, "hyps.json")
    sinks.write_hypotheses_json(_hypotheses(spark, sf_dir), path)
    return readers.read_hypotheses(spark, path).select("section", "id", *_digest("hyp"))


def hypotheses_table(spark, sf_dir):
    path = _place(spark, "hyps")
    sinks.write_hypotheses(_hypotheses(spark, sf_dir), path)
    return spark.read.parquet(path).select(F.col("section").cast("string").alias("section"), "id", *_digest("hyp"))


def memory_json(spark, sf_dir):
    path = _place(spark, "tm.json")
    memory = corpora.tm_build(spark, sf_dir).select("lang", F.col("src").cast("string").alias("src"), "tgt")
    sinks.write_memory_json(memory, path)
    return readers.read_memory_json(spark, path)


def _prepared(spark, sf_dir):
    """Pairs tagged English, cleaned, judged by the language model of documents, deduplicated and de-leaked."""
    pairs = P.pairs(spark, sf_dir).withColumn("ordinal", F.col("conv_id") * 1000 + F.col("turn"))
    return preparation.prepared(pairs, lid=language._model(spark, sf_dir))


def prepare_reasons(spark, sf_dir):
    rows = _prepared(spark, sf_dir)
    return rows.select("ordinal", F.coalesce("reason", F.lit("kept")).alias("reason"))


def prepare_report(spark, sf_dir):
    """The report file of a corpus preparation, read back as counters."""
    path = _place(spark, "report.json")
    rows = _prepared(spark, sf_dir).withColumn("file", F.concat(F.lit("en_en/"), "split"))
    # One job writes the kept pairs and counts them all.
    counted, counters = filters.observed(rows, "file", [f"en_en/{s}" for s in ("train", "dev", "test")])
    kept = written(preparation.kept(counted))
    # From Arrow: rows of Python objects would start workers of their own for these.
    kinds = pa.schema([("file", pa.string()), ("counter", pa.string()), ("n", pa.int64())])
    counters = spark.createDataFrame(pa.Table.from_pylist([dict(zip(kinds.names, c, strict=True)) for c in counters()], kinds))
    memory = corpus.translation_memory(kept, ["lang", "src"], "tgt", F.col("ordinal"))
    items = P.table(spark, sf_dir, "benchmark").select(F.lit("English").alias("section"), F.lit("en").alias("lang"), T.normalise(F.col("text"), None).alias("src"))
    sinks.write_json(preparation.report_json(counters, corpus.coverage(items, memory, ["lang", "src"], "section"), lid_enabled=True), path)
    return readers.read_report(spark, path)


def combined_files(spark, sf_dir):
    """Kept pairs of a preparation as tagged TSV, one file a split."""
    root = _place(spark, "combined")
    rows = preparation.kept(_prepared(spark, sf_dir)).withColumns({"src": T.tag_source(F.col("src"), F.col("lang")), "pair": F.lit("all_en")})
    sinks.write_corpus(rows, root)
    return readers.read_corpus(spark, root).groupBy("split").agg(F.count("*").alias("n"), F.max("ordinal").alias("last"))


def scores_json(spark, sf_dir):
    path = _place(spark, "scores.json")
    rows = scoring._turns(spark, sf_dir)
    sinks.write_json(sinks.scores_json(metrics.score_report(rows, "role"), metrics.cross_check(rows)), path)
    return readers.read_scores(spark, path)


def scores_lines(spark, sf_dir):
    path = _place(spark, "scores.txt")
    one = metrics.score_report(scoring._turns(spark, sf_dir))
    sinks.write_scores(one, path)
    return readers.read_lines(spark, path).select("ordinal", "value")


def submission_csv(spark, sf_dir):
    path = _place(spark, "answer.csv")
    held = P.pairs(spark, sf_dir).where("split <> 'train'").withColumn("id", F.concat_ws("-", "conv_id", "turn"))
    hyps = held.where(F.length("tgt") % 2 == 0).select("id", F.concat(F.lit("> "), "tgt").alias("hyp"))
    rows = corpus.submission(held.select("id", "src"), corpora._memory(spark, sf_dir), hyps, ["src"], "id")
    sinks.write_submission(rows, path, "id")
    back = spark.read.csv(path, sep="\t", header=True, quote='"', escape='"', multiLine=True, emptyValue="", lineSep="\r\n", schema="ID string, Translation string")
    return back.select(F.col("ID").alias("id"), F.md5(F.coalesce("Translation", F.lit(""))).alias("text_md5"))


def lid_json(spark, sf_dir):
    path = _place(spark, "lid.json")
    langid.save_json(language._model(spark, sf_dir), path)
    model = langid.load_json(spark, path, P.LANGS)
    return model.grams.select("cls", "gram", F.round("log_prob", 6).alias("log_prob"))


def history_json(spark, sf_dir):
    path = _place(spark, "history.json")
    months = P.table(spark, sf_dir, "orders").groupBy((F.year("o_orderdate") * 100 + F.month("o_orderdate")).cast("long").alias("step"))
    sinks.write_history(months.agg(F.round(F.avg("o_totalprice"), 2).alias("dev_loss")), path)
    return readers.read_history(spark, path)


def language_folders(spark, sf_dir):
    path = _place(spark, "by_language")
    docs = P.table(spark, sf_dir, "documents").select("doc_id", T.tag_source(F.col("text"), F.col("lang")).alias("src"))
    sinks.write_by_language(docs, path, P.LANGS)
    return spark.read.parquet(path).groupBy(F.col("lang").cast("string").alias("lang")).agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


def copied_tables(spark, sf_dir):
    """Copies of two tables, and of one that is not there."""
    path = _place(spark, "copies")
    done = sinks.copy_existing(spark, [f"{sf_dir}/{t}.parquet" for t in ("nation", "region", "nowhere")], path)
    copied = [spark.read.parquet(f"{path}/{p.rsplit('/', 1)[-1]}").agg(F.lit(p.rsplit("/", 1)[-1]).alias("name"), F.count("*").alias("n")) for p in done]
    return copied[0].unionByName(copied[1])


QUERIES = {
    f.__name__: f
    for f in (
        tsv_roundtrip, corpus_layout, tagged_roundtrip, zipped_files, validation_json, hypotheses_json, hypotheses_table, memory_json, prepare_reasons, prepare_report,
        combined_files, scores_json, scores_lines, submission_csv, lid_json, history_json, language_folders, copied_tables,
    )
}

_FLAT = "translate({0}, chr(9) || chr(13) || chr(10), '   ')"
FLAT = f"""{P.PAIRS}, flat AS (SELECT conv_id * 1000 + turn AS o, split, {_FLAT.format('src')} AS src, {_FLAT.format('tgt')} AS tgt FROM pairs),
  placed AS (SELECT *, row_number() OVER (ORDER BY o) - 1 AS ordinal, row_number() OVER (PARTITION BY split ORDER BY o) - 1 AS own FROM flat)"""
#: Reasons with the language check, then first occurrences and leaks.
PREPARED = f"""{language.MODEL}, {cleaning.CLEANED},
  asked AS (SELECT conv_id, turn, t2 FROM reasons WHERE (reason IS NULL OR reason = 'length_ratio') AND length(t2) >= 15),
  pg AS ({' UNION ALL '.join(
      f"SELECT conv_id, turn, unnest(list_transform(range(1, length(t) - {n} + 2), lambda i: substr(t, i, {n}))) AS gram FROM (SELECT conv_id, turn, ' ' || t2 || ' ' AS t FROM asked)"
      for n in (1, 2, 3)
  )}),
  pc AS (SELECT conv_id, turn, gram, count(*) AS n FROM pg GROUP BY ALL),
  ps AS (SELECT conv_id, turn, c.cls, any_value(log_prior) + sum(n * coalesce(log_prob, log_unseen)) AS score
    FROM pc CROSS JOIN c LEFT JOIN m ON m.cls = c.cls AND m.gram = pc.gram GROUP BY conv_id, turn, c.cls),
  said AS (SELECT conv_id, turn, cls FROM ps QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY round(score, 9) DESC, list_position(['en', 'fr', 'de', 'es'], cls)) = 1),
  judged AS (SELECT r.conv_id * 1000 + r.turn AS ordinal, split, s2, t2, flags, CASE WHEN said.cls <> 'en' THEN 'lid_language_mismatch' ELSE reason END AS reason
    FROM reasons r LEFT JOIN said ON r.conv_id = said.conv_id AND r.turn = said.turn),
  firsts AS (SELECT s2 AS fs, t2 AS ft, min(ordinal) AS first FROM judged WHERE reason IS NULL AND split = 'train' GROUP BY ALL),
  done AS (SELECT ordinal, split, s2, t2, flags, CASE WHEN reason IS NOT NULL THEN reason WHEN split = 'train' AND ordinal > first THEN 'duplicate'
      WHEN split = 'train' AND s2 IN (SELECT s2 FROM judged WHERE reason IS NULL AND split <> 'train') THEN 'leaked_into_eval' END AS reason
    FROM judged LEFT JOIN firsts ON s2 = fs AND t2 = ft)"""

ORACLES = {
    "tsv_roundtrip": f"WITH {FLAT} SELECT ordinal, md5(src) AS src_md5, md5(tgt) AS tgt_md5 FROM placed",
    "corpus_layout": f"WITH {FLAT} SELECT 'en_en' AS pair, split, 'en' AS lang, own AS ordinal, md5(src) AS src_md5, md5(tgt) AS tgt_md5 FROM placed",
    "tagged_roundtrip": f"WITH {FLAT} SELECT ordinal, 'en' AS lang, md5(src) AS src_md5, md5(tgt) AS tgt_md5 FROM placed",
    "zipped_files": f"WITH {FLAT} SELECT ordinal, 'en' AS lang, md5({P.sql_hyp('tgt')}) AS hyp_md5, md5(tgt) AS ref_md5 FROM placed",
    "validation_json": "SELECT 'English' AS section, row_number() OVER (ORDER BY item_id) - 1 AS ordinal, item_id::VARCHAR AS id, md5(text) AS source_md5 FROM benchmark",
    "hypotheses_json": "SELECT role AS section, conv_id || '-' || turn AS id, md5(text) AS hyp_md5 FROM conversations",
    "hypotheses_table": "SELECT role AS section, conv_id || '-' || turn AS id, md5(text) AS hyp_md5 FROM conversations",
    "memory_json": f"SELECT lang, src::VARCHAR AS src, tgt FROM ({corpora.ORACLES['tm_build']}) t",
    "prepare_reasons": f"WITH {PREPARED} SELECT ordinal, coalesce(reason, 'kept') AS reason FROM done",
    "prepare_report": f"""WITH {PREPARED}, counted AS (SELECT split, unnest(list_concat(['read', coalesce('dropped_' || reason, 'kept')], flags)) AS counter FROM done)
        SELECT 'en_en/' || split AS file, counter, count(*) AS n FROM counted GROUP BY ALL""",
    "combined_files": f"WITH {PREPARED} SELECT split, count(*) AS n, count(*) - 1 AS last FROM done WHERE reason IS NULL GROUP BY split",
    "scores_json": scoring.ORACLES["score_report"],
    "scores_lines": f"""WITH s AS (SELECT round(bleu, 3) AS b, round(rouge_l, 3) AS r, round(chrf, 3) AS c FROM ({scoring.ORACLES['score_report']}) t WHERE slice = 'overall')
        SELECT 0::BIGINT AS ordinal, format('bleu: {{:.6f}}', b) AS value FROM s UNION ALL SELECT 1, format('rouge_l: {{:.6f}}', r) FROM s
        UNION ALL SELECT 2, format('chrf: {{:.6f}}', c) FROM s UNION ALL SELECT 3, format('total: {{:.6f}}', round(b + r + c, 3)) FROM s""",
    "submission_csv": f"SELECT id, md5(text) AS text_md5 FROM ({corpora.ORACLES['tm_apply']}) t",
    "lid_json": language.ORACLES["lid_model"],
    "history_json": "SELECT (year(o_orderdate) * 100 + month(o_orderdate))::BIGINT AS step, round(avg(o_totalprice), 2) AS dev_loss FROM orders GROUP BY 1",
    "language_folders": "SELECT lang, count(*) AS n, sum(doc_id)::BIGINT AS ids FROM documents GROUP BY lang",
    "copied_tables": "SELECT 'nation.parquet' AS name, count(*) AS n FROM nation UNION ALL SELECT 'region.parquet', count(*) FROM region",
}
