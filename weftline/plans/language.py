"""Queries on character n-grams and language identification."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import langid
from weftline.plans import tables as P


def ngram_counts(spark, sf_dir):
    docs = P.table(spark, sf_dir, "documents")
    return langid.gram_counts(docs, "text", "lang").select(F.col("cls").alias("lang"), "gram", "n")


def _model(spark, sf_dir):
    train = P.table(spark, sf_dir, "documents").where("doc_id % 10 <> 0")
    return langid.fit(train, "text", "lang", P.LANGS)


def lid_model(spark, sf_dir):
    model = _model(spark, sf_dir)
    return model.grams.select("cls", "gram", F.round("log_prob", 6).alias("log_prob"))


def lid_classes(spark, sf_dir):
    return _model(spark, sf_dir).classes.select("cls", F.round("log_prior", 6).alias("log_prior"), F.round("log_unseen", 6).alias("log_unseen"))


def _predicted(spark, sf_dir):
    """Every document, with a flag for those outside the model's training."""
    docs = P.table(spark, sf_dir, "documents")
    said = langid.predict(docs, _model(spark, sf_dir), "doc_id", "text")
    held = (F.col("doc_id") % 10 == 0).alias("held_out")
    return docs.select("doc_id", "lang", held).join(said, "doc_id")


def lid_predict(spark, sf_dir):
    return _predicted(spark, sf_dir).select("doc_id", "lang", "held_out", "predicted", F.round("score", 4).alias("score"))


def lid_confusion(spark, sf_dir):
    return langid.confusion(_predicted(spark, sf_dir), "lang", "predicted", "held_out")


def lid_accuracy(spark, sf_dir):
    return langid.accuracy(_predicted(spark, sf_dir), "lang", "predicted", "held_out")


def lid_samples(spark, sf_dir):
    docs = P.table(spark, sf_dir, "documents")
    return langid.bounded_samples(docs, "doc_id", "lang", "text", 50, 13).select("lang", "doc_id")


QUERIES = {f.__name__: f for f in (ngram_counts, lid_model, lid_classes, lid_predict, lid_confusion, lid_accuracy, lid_samples)}


def _grams(where: str) -> str:
    parts = " UNION ALL ".join(
        f"SELECT doc_id, lang, unnest(list_transform(range(1, length(t) - {n} + 2), lambda i: substr(t, i, {n}))) AS gram FROM p" for n in (1, 2, 3)
    )
    strip = f"regexp_replace(text, '^{P.WS}+|{P.WS}+$', '', 'g')"
    return f"(WITH p AS (SELECT doc_id, lang, ' ' || {strip} || ' ' AS t FROM documents WHERE {where}) {parts})"


MODEL = f"""a AS (SELECT lang AS cls, gram, count(*) AS n FROM {_grams('doc_id % 10 <> 0')} GROUP BY lang, gram),
  k AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY cls ORDER BY n DESC, gram) <= 60000),
  v AS (SELECT count(DISTINCT gram) AS v FROM k), s AS (SELECT cls, sum(n) + 0.1::DOUBLE * (SELECT v FROM v) AS denom FROM k GROUP BY cls),
  dn AS (SELECT lang AS cls, count(*) AS docs FROM documents WHERE doc_id % 10 <> 0 GROUP BY lang),
  m AS (SELECT k.cls, gram, ln((n + 0.1::DOUBLE) / denom) AS log_prob FROM k JOIN s ON k.cls = s.cls),
  c AS (SELECT dn.cls, ln(docs::DOUBLE / (SELECT sum(docs) FROM dn)) AS log_prior, ln(0.1::DOUBLE / denom) AS log_unseen FROM dn JOIN s ON dn.cls = s.cls)"""
PREDICTED = f"""{MODEL}, g AS (SELECT doc_id, lang, gram, count(*) AS n FROM {_grams('true')} GROUP BY ALL),
  sc AS (SELECT doc_id, lang, c.cls, any_value(log_prior) + sum(n * coalesce(log_prob, log_unseen)) AS score
    FROM g CROSS JOIN c LEFT JOIN m ON m.cls = c.cls AND m.gram = g.gram GROUP BY doc_id, lang, c.cls),
  b AS (SELECT doc_id, lang, cls AS predicted, score FROM sc
    QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, list_position(['en', 'fr', 'de', 'es'], cls)) = 1)"""

ORACLES = {
    "ngram_counts": f"SELECT lang, gram, count(*) AS n FROM {_grams('true')} GROUP BY ALL",
    "lid_model": f"WITH {MODEL} SELECT cls, gram, round(log_prob, 6) AS log_prob FROM m",
    "lid_classes": f"WITH {MODEL} SELECT cls, round(log_prior, 6) AS log_prior, round(log_unseen, 6) AS log_unseen FROM c",
    "lid_predict": f"WITH {PREDICTED} SELECT doc_id, lang, predicted, round(score, 4) AS score, doc_id % 10 = 0 AS held_out FROM b",
    "lid_accuracy": f"WITH {PREDICTED} SELECT doc_id % 10 = 0 AS held_out, count(*) AS n, count(*) FILTER (lang = predicted) AS correct FROM b GROUP BY 1",
    "lid_samples": """SELECT lang, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY md5('13:' || doc_id)) AS r FROM documents) WHERE r <= 50 AND text <> ''""",
    "lid_confusion": f"WITH {PREDICTED} SELECT doc_id % 10 = 0 AS held_out, lang AS truth, predicted, count(*) AS n FROM b GROUP BY ALL",
}
