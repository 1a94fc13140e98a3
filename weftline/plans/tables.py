"""How the supplied tables stand for a parallel corpus.

Pairs are user turns and the assistant turns after them; a document's or
conversation's id modulo 10 gives its split; hypotheses are texts without
every fifth word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import textops as T
from weftline.operators import corpus

LANGS = ["en", "fr", "de", "es"]
WS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def split_of(key: Column) -> Column:
    return F.when(key % 10 == 0, "dev").when(key % 10 == 1, "test").otherwise("train")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus.pairs_of(table(spark, sf_dir, "conversations"))
    return rows.select("conv_id", "turn", split_of(F.col("conv_id")).alias("split"), F.lit("en").alias("lang"), "src", "tgt")


def scored(rows: DataFrame, text: str) -> DataFrame:
    """``ref`` and a ``hyp`` that lacks every fifth word."""
    kept = F.filter(F.split(text, " "), lambda x, i: (i + 1) % 5 != 0)
    return rows.withColumns({"hyp": F.array_join(kept, " "), "ref": F.col(text)})


SPLIT = "CASE WHEN {0} % 10 = 0 THEN 'dev' WHEN {0} % 10 = 1 THEN 'test' ELSE 'train' END"
PAIRS = f"""pairs AS (
  SELECT conv_id, turn, {SPLIT.format('conv_id')} AS split, text AS src, next_text AS tgt FROM (
    SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
  WHERE role = 'user' AND next_role = 'assistant')"""


def sql_squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'))"


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '{T.DIGIT_PREFIX}', '')"


def sql_normalise(x: str, lang: str | None = None) -> str:
    c = f"regexp_replace(nfc_normalize({x}), '{T.CONTROLS}', ' ', 'g')"
    c = f"translate({c}, chr(65279) || chr(8203) || chr(8288) || chr(173), '')"
    if lang:
        c = f"CASE {lang} WHEN 'bn' THEN translate({c}, chr(1472), chr(2404)) WHEN 'hi' THEN translate({c}, '|', chr(2404)) ELSE {c} END"
    return sql_squeeze(c)


def sql_latin_ratio(x: str) -> str:
    letters = f"regexp_extract_all({x}, '\\p{{L}}')"
    return f"coalesce(len(list_filter({letters}, lambda c: unicode(c) BETWEEN 65 AND 591))::DOUBLE / nullif(len({letters}), 0), 0.0)"


def sql_tokens(x: str) -> str:
    r = r"(?s)^(\p{P}*)(.*?)(\p{P}*)$"
    part = lambda k: f"regexp_extract(w, '{r}', {k})"
    peel = f"list_concat(list_concat(string_split({part(1)}, ''), [{part(2)}]), string_split({part(3)}, ''))"
    return f"list_filter(flatten(list_transform(string_split({sql_squeeze(x)}, ' '), lambda w: {peel})), lambda t: t <> '')"


def sql_hyp(x: str) -> str:
    return f"array_to_string(list_filter(string_split({x}, ' '), lambda w, i: i % 5 <> 0), ' ')"


def sql_grams(tokens: str, n: int, sep: str) -> str:
    return f"list_transform(range(1, len({tokens}) - {n} + 2), lambda i: array_to_string({tokens}[i:i + {n} - 1], '{sep}'))"
