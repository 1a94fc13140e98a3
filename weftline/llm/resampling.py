"""Importance resampling towards a target distribution, by n-grams from a position table.

Words are taken apart with their positions, following words come beside them
by ``lead`` over the document, and the runs of each order are features, hashed
to buckets. A bucket's gain is the logarithm of its smoothed share of the
target's features over that of the source's. A document's weight is the mean
gain of its features, its score adds seeded Gumbel noise, and the greatest
scores are a draw without replacement in proportion to the weights.

Everything is DataFrame operations. Bucket counts and sums of gains are
aggregated where the texts are, so with order 1 no word is shuffled. Higher
orders shuffle words by blocks of ``BLOCK`` positions, each with the first
words of the next one, so a very long document is no single task. Gains are a
table with at most a row for each bucket, which is broadcast. Ranks come from
range partitions of ids and scores.

Defined cases: null, empty and wordless texts have no features and weight 0; a
null doc_id draws its noise as ``null`` and ranks after others at equal scores;
repeated rows, and rows that repeat an id, each come back and count; ties go to
the smaller doc_id; an empty table gives an empty result, and with an empty
target every bucket's gain follows from the smoothing alone; further columns,
whatever their names, are left behind.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.llm.common import col, forget, materialise, table
from weftline.operators.ordering import global_rank

#: Words: runs of ASCII letters and digits and of all that is not ASCII.
FEATURE_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Positions of a document in one block.
BLOCK = 65_536
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    #: Least and greatest number of consecutive words of a feature.
    first: int = 1
    last: int = 1
    buckets: int = 10_000
    seed: int = 2024
    #: Documents of fewer words are not drawn; of the others this share in per cent.
    least_words: int = 20
    percent: int = 10


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(key, w)``: the words of every row; rows of one key are copies."""
    text = col(text_col).cast("string")
    rows = docs.select(
        col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"),
        F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(FEATURE_WORD), F.lit(0)).alias("w"),
    )
    return rows.select(F.struct("doc_id", "a", "b", F.greatest(F.size("w"), F.lit(0)).alias("n_words")).alias("key"), "w")


def features(words: DataFrame, rule: Rule) -> DataFrame:
    """``(key, first, bucket, m)``: every feature ``m`` times; ``first`` marks one row of each document, its bucket may be null."""
    at = words.select("key", F.posexplode_outer("w").alias("pos", "word"))
    first = F.coalesce(F.col("pos") == 0, F.lit(True))

    def bucket(gram: Column) -> Column:
        return F.crc32(gram) % rule.buckets

    if rule.last == 1:
        return at.select("key", first.alias("first"), bucket(F.col("word")).alias("bucket"), F.lit(1).cast("long").alias("m"))
    own = F.floor(F.coalesce(F.col("pos"), F.lit(0)) / BLOCK)
    also = F.when((F.col("pos") >= BLOCK) & (F.col("pos") % BLOCK < rule.last - 1), own - 1)
    blocks = at.select("key", "pos", "word", own.alias("own"), F.explode(F.array_compact(F.array(own, also))).alias("block"))
    # One shuffle serves both the copies and the windows.
    one = blocks.repartition("key", "block").groupBy("key", "block", "pos").agg(F.min("word").alias("word"), F.min("own").alias("own"), F.count("*").alias("m"))
    over = W.partitionBy("key", "block").orderBy("pos")
    runs = one.select("key", "pos", "word", "m", "own", "block", *[F.lead("word", k).over(over).alias(f"w{k}") for k in range(1, rule.last)]).where("own = block")
    grams = [F.when(F.col(f"w{k - 1}" if k > 1 else "word").isNotNull(), F.concat_ws(" ", "word", *[f"w{j}" for j in range(1, k)])) for k in range(rule.first, rule.last + 1)]
    each = runs.select("key", first.alias("starts"), "m", F.posexplode_outer(F.array_compact(F.array(*grams))).alias("at", "gram"))
    return each.select("key", (F.col("starts") & (F.coalesce("at", F.lit(0)) == 0)).alias("first"), bucket(F.col("gram")).alias("bucket"), "m")


def bucket_gains(source: DataFrame, target: DataFrame, rule: Rule) -> DataFrame:
    """``(bucket, gain)`` for every bucket of the source; the number of rows is bounded by ``rule.buckets``."""

    def counted(rows: DataFrame, name: str) -> DataFrame:
        return rows.where("bucket IS NOT NULL").groupBy("bucket").agg(F.sum("m").alias(name))

    s, t = materialise(counted(source, "s")), materialise(counted(target, "t"))
    n_s, n_t = s.agg(F.coalesce(F.sum("s"), F.lit(0))).first()[0], t.agg(F.coalesce(F.sum("t"), F.lit(0))).first()[0]
    up = (F.coalesce("t", F.lit(0)).cast("double") + 1) * float(n_s + rule.buckets)
    down = (F.col("s").cast("double") + 1) * float(n_t + rule.buckets)
    gains = materialise(s.join(F.broadcast(t), "bucket", "left").select("bucket", F.floor(1000 * F.log(up / down)).cast("long").alias("gain")))
    forget(s, t)
    return gains


def resample(docs: DataFrame, target: DataFrame, rule: Rule = Rule(), *, id_col: str = "doc_id", text_col: str = "text", target_id_col: str = "item_id", target_text_col: str = "text") -> DataFrame:
    """``(doc_id, n_words, n_features, weight, score, rank)`` for every row of ``docs``; ``rank`` is null unless drawn."""
    source = features(keyed(docs, id_col, text_col), rule)
    gains = bucket_gains(source, features(keyed(target, target_id_col, target_text_col), rule), rule)
    sums = source.join(F.broadcast(gains), "bucket", "left").groupBy("key").agg(
        F.sum(F.when(F.col("first"), F.col("m")).otherwise(0)).alias("copies"),
        F.sum(F.when(F.col("bucket").isNotNull(), F.col("m")).otherwise(0)).alias("f"), F.coalesce(F.sum(F.col("m") * F.col("gain")), F.lit(0)).alias("g"),
    )
    # Whole numbers divide exactly and down.
    weight = F.when(F.col("f") == 0, 0).otherwise(F.expr("(g - pmod(g, f)) div f")).cast("long")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{rule.seed}:"), F.coalesce(F.col("key.doc_id").cast("string"), F.lit("null"))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    each = sums.select(
        F.col("key.doc_id").alias("doc_id"), F.col("key.n_words").cast("long").alias("n_words"), F.expr("f div copies").alias("n_features"),
        weight.alias("weight"), (weight + noise).alias("score"), F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"),
    )
    scored = materialise(each.drop("copy"))
    fit = F.col("n_words") >= rule.least_words
    drawn = scored.where(fit).count() * rule.percent // 100
    ranked = global_rank(scored.where(fit), [F.desc("score"), F.asc_nulls_last("doc_id")])
    ranked = ranked.withColumn("rank", F.when(F.col("rank") < drawn, F.col("rank") + 1))
    return ranked.unionByName(scored.where(~fit).withColumn("rank", F.lit(None).cast("long")))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


#: CRC-32 from its polynomial: a table of 256 remainders, then byte by byte over each distinct word.
OP12_SQL = r"""
WITH crc_table AS (SELECT list(c ORDER BY i) AS t FROM (
  SELECT i, list_reduce([i, 0, 1, 2, 3, 4, 5, 6, 7], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS i))),
ws AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
wt AS (SELECT regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
fs AS (SELECT doc_id, unnest(w) AS word FROM ws),
ft AS (SELECT unnest(w) AS word FROM wt),
vocabulary AS (SELECT word, hex(word) AS x FROM (SELECT word FROM fs UNION SELECT word FROM ft)),
b AS (SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(x), 2), lambda i: ('0x' || substr(x, i, 2))::BIGINT)),
        lambda c, y: xor(t[(xor(c, y) & 255) + 1], c >> 8)), 4294967295) % 10000 AS bucket FROM vocabulary, crc_table),
s AS (SELECT bucket, count(*) AS s FROM fs JOIN b USING (word) GROUP BY 1),
t AS (SELECT bucket, count(*) AS t FROM ft JOIN b USING (word) GROUP BY 1),
g AS (SELECT bucket, floor(1000 * ln(((coalesce(t, 0)::DOUBLE + 1) * ((SELECT coalesce(sum(s), 0) FROM s)::DOUBLE + 10000)) / ((s::DOUBLE + 1) * ((SELECT coalesce(sum(t), 0) FROM t)::DOUBLE + 10000))))::BIGINT AS gain
      FROM s LEFT JOIN t USING (bucket)),
d AS (SELECT doc_id, count(*) AS n, sum(gain)::BIGINT AS total FROM fs JOIN b USING (word) JOIN g USING (bucket) GROUP BY 1),
r AS (SELECT ws.doc_id, coalesce(n, 0) AS n_features, coalesce(floor(total::DOUBLE / n), 0)::BIGINT AS weight, ('0x' || substr(sha256('2024:' || ws.doc_id), 1, 8))::BIGINT AS h FROM ws LEFT JOIN d USING (doc_id)),
z AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM r),
k AS (SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) END AS place FROM z)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= (SELECT count(*) FROM z WHERE n_features >= 20) * 10 // 100 THEN place END AS rank FROM k
"""
