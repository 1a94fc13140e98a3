"""Queries on cleaning, filtering, tags and tokens."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import arrays as A
from weftline.functions import textops as T
from weftline.operators import filters
from weftline.plans import tables as P


def clean_normalise(spark, sf_dir):
    docs = P.table(spark, sf_dir, "documents")
    return docs.select("doc_id", T.normalise(T.strip_digit_prefix(F.col("text")), F.col("lang")).alias("clean"))


def script_ratio(spark, sf_dir):
    docs = P.table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.round(T.script_ratio(F.col("text"), F.col("lang")), 6).alias("ratio"))


def _filtered(spark, sf_dir):
    return filters.filtered(filters.clean_pairs(P.pairs(spark, sf_dir)))


def filter_reasons(spark, sf_dir):
    rows = _filtered(spark, sf_dir)
    return rows.select("conv_id", "turn", F.coalesce("reason", F.lit("kept")).alias("reason"), F.array_join("flags", ",").alias("flags"))


def filter_report(spark, sf_dir):
    return filters.report(_filtered(spark, sf_dir), "split")


def tokenize_words(spark, sf_dir):
    rows = P.table(spark, sf_dir, "conversations").withColumn("t", A.tokens(F.col("text")))
    return rows.select("conv_id", "turn", F.size("t").cast("long").alias("n_tokens"), F.array_join("t", " ").alias("tokens"))


def tag_roundtrip(spark, sf_dir):
    tagged = P.table(spark, sf_dir, "documents").select("doc_id", T.tag_source(F.col("text"), F.col("lang")).alias("tagged"))
    parts = T.split_tag(F.col("tagged"), P.LANGS)
    return tagged.select("doc_id", parts["lang"].alias("lang"), T.tag_language(F.col("tagged")).alias("tag"), F.length(parts["text"]).cast("long").alias("n_chars"))


def char_stats(spark, sf_dir):
    t = F.col("text")
    return P.table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", T.has_assamese(t).alias("assamese"), F.length(T.drop_space(t)).cast("long").alias("solid_chars"),
        T.degenerate(t).alias("degenerate"), F.length(T.one_line(t)).cast("long").alias("line_chars"),
        F.round(T.length_ratio(t, F.col("role")), 6).alias("ratio"),
    )


QUERIES = {f.__name__: f for f in (clean_normalise, script_ratio, filter_reasons, filter_report, tokenize_words, tag_roundtrip, char_stats)}

CLEANED = f"""{P.PAIRS},
stripped AS (SELECT *, {P.sql_strip('src')} AS s1, {P.sql_strip('tgt')} AS t1 FROM pairs),
normal AS (SELECT conv_id, turn, split, src, tgt, s1, t1, {P.sql_normalise('s1')} AS s2, {P.sql_normalise('t1')} AS t2 FROM stripped),
reasons AS (SELECT *, CASE
    WHEN coalesce(s2, '') = '' OR coalesce(t2, '') = '' THEN 'empty_field'
    WHEN s2 = t2 THEN 'src_equals_tgt'
    WHEN {P.sql_latin_ratio('t2')} < 0.5 THEN 'wrong_script'
    WHEN len(regexp_extract_all(t2, '{T.ASSAMESE}')) >= 3 THEN 'assamese_target'
    WHEN least(length(s2), length(t2)) >= 10 AND greatest(length(s2), length(t2)) / least(length(s2), length(t2)) > 3.0 THEN 'length_ratio'
    END AS reason, list_filter([CASE WHEN t1 <> tgt THEN 'digit_prefix_stripped' END, CASE WHEN s1 <> src THEN 'digit_prefix_stripped_src' END,
      CASE WHEN s2 <> s1 OR t2 <> t1 THEN 'normalised' END], lambda f: f IS NOT NULL) AS flags FROM normal)"""

ORACLES = {
    "clean_normalise": f"SELECT doc_id, {P.sql_normalise(P.sql_strip('text'), 'lang')} AS clean FROM documents",
    "script_ratio": f"SELECT doc_id, round({P.sql_latin_ratio('text')}, 6) AS ratio FROM documents",
    "filter_reasons": f"WITH {CLEANED} SELECT conv_id, turn, coalesce(reason, 'kept') AS reason, array_to_string(flags, ',') AS flags FROM reasons",
    "filter_report": f"""WITH {CLEANED}, c AS (SELECT split, unnest(list_concat(['read', coalesce('dropped_' || reason, 'kept')], flags)) AS counter FROM reasons)
        SELECT split, counter, count(*) AS n FROM c GROUP BY ALL""",
    "tokenize_words": f"""SELECT conv_id, turn, len(t)::BIGINT AS n_tokens, array_to_string(t, ' ') AS tokens
        FROM (SELECT conv_id, turn, {P.sql_tokens('text')} AS t FROM conversations)""",
    "tag_roundtrip": "SELECT doc_id, lang, lang AS tag, length(text)::BIGINT AS n_chars FROM documents",
    "char_stats": f"""SELECT conv_id, turn, regexp_matches(text, '{T.ASSAMESE}') AS assamese,
        length(regexp_replace(text, '{P.WS}+', '', 'g'))::BIGINT AS solid_chars,
        {P.sql_squeeze('text')} = '' OR len(regexp_extract_all(text, '<unk>')) > 3 AS degenerate, length(replace(text, chr(10), ' '))::BIGINT AS line_chars,
        round(greatest(length(text), length(role))::DOUBLE / least(length(text), length(role)), 6) AS ratio FROM conversations""",
}
