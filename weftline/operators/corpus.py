"""Deduplication, de-leaking, translation memories and what is built from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import textops as T
from weftline.operators.membership import may_hold
from weftline.operators.ordering import global_rank, written

#: Keys (32 bytes each) that are broadcast, and keys for which a filter (2 to 4 bytes each) is.
FEW_KEYS, MOST_KEYS = 500_000, 50_000_000


def pairs_of(conversations: DataFrame) -> DataFrame:
    """User turns with the assistant turn that follows: ``conv_id, turn, src, tgt``.

    Turns are ranked over range partitions, so that one huge conversation is
    not sorted in one task; each user turn is then joined with the assistant
    turn of the next rank. Of equal turns any may come first.
    """
    turns = global_rank(conversations.select("conv_id", "turn", "role", "text"), [F.col("conv_id"), F.col("turn")], "__rank")
    user = turns.where("role = 'user'").select("__rank", "conv_id", "turn", F.col("text").alias("src"))
    answer = turns.where("role = 'assistant'").select((F.col("__rank") - 1).alias("__rank"), F.col("conv_id").alias("__c"), F.col("text").alias("tgt"))
    return user.join(answer, "__rank").where(F.col("conv_id").eqNullSafe(F.col("__c"))).select("conv_id", "turn", "src", "tgt")


def hash_key(*columns: str) -> Column:
    """128 bits that stand for the columns' values, so that texts are no shuffle keys; nulls are values."""
    parts = [x for c in columns for x in (F.col(c).isNull(), F.col(c))]
    return F.struct(F.xxhash64(*parts).alias("a"), F.xxhash64(F.lit(1), *parts).alias("b"))


def first_of_each(rows: DataFrame, keys: list[str], ordinal: str, keep: list[str]) -> DataFrame:
    """The smallest ordinal of each key combination, with those of its keys to ``keep``; minima are taken before the shuffle."""
    hashed = rows.select(hash_key(*keys).alias("__key"), ordinal, *keep)
    return hashed.groupBy("__key").agg(*[F.min(c).alias(c) for c in (*keep, ordinal)]).drop("__key")


def without_leaks(train: DataFrame, held: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``train`` whose keys are in no held-out row.

    Few held-out keys are broadcast. Of more a Bloom filter is, so that only
    the rows that it suspects are shuffled, and what it clears passes where it
    is. Beyond ``MOST_KEYS`` the optimiser joins both sides.
    """
    known = written(held.select(hash_key(*keys).alias("__held")).distinct())
    n = known.count()
    rows = train.withColumn("__key", hash_key(*keys))
    same = F.col("__key") == F.col("__held")
    if not FEW_KEYS < n <= MOST_KEYS:
        return rows.join(F.broadcast(known) if n <= FEW_KEYS else known, same, "left_anti").drop("__key")
    rows = rows.withColumn("__maybe", may_hold(known.select("__held.*"), n)(F.col("__key")))
    clear, suspect = (rows.where(c).drop("__maybe") for c in (~F.col("__maybe"), F.col("__maybe")))
    return clear.unionByName(suspect.join(known.hint("shuffle_hash"), same, "left_anti")).drop("__key")


def translation_memory(rows: DataFrame, keys: list[str], target: str, ordinal: Column) -> DataFrame:
    """The commonest target of each key; of equals the one seen first. Keys travel as hashes, texts once for each key and target."""
    hashed = rows.select(hash_key(*keys).alias("__key"), hash_key(target).alias("__target"), *keys, target, ordinal.alias("__o"))
    counted = hashed.groupBy("__key", "__target").agg(F.count("*").alias("__n"), F.min("__o").alias("__first"), F.first(F.struct(*keys, target)).alias("__x"))
    best = F.struct(F.col("__n"), (-F.col("__first")).alias("__f"))
    top = counted.groupBy("__key").agg(F.max_by("__x", best).alias("__x"), F.max("__n").alias("n"))
    return top.select(*[F.col("__x").getField(c).alias(c) for c in (*keys, target)], "n")


def coverage(items: DataFrame, memory: DataFrame, keys: list[str], by: str) -> DataFrame:
    """``(by, records, hits, pct)``: how many items the memory has; one left join on hashes."""
    known = memory.select(hash_key(*keys).alias("__m"), F.lit(1).alias("__hit")).distinct()
    asked = items.select(by, F.when(_whole(keys), hash_key(*keys)).alias("__key"))
    joined = asked.join(known, F.col("__key") == F.col("__m"), "left").groupBy(by).agg(F.count("*").alias("records"), F.count("__hit").alias("hits"))
    return joined.withColumn("pct", F.round(100.0 * F.col("hits") / F.col("records"), 2))


def _whole(keys: list[str]) -> Column:
    """Whether no key is null: a null key equals none."""
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).isNotNull()
    return out


def apply_memory(items: DataFrame, memory: DataFrame, hypotheses: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """Each item's text: from the memory, else from its hypothesis, else empty; with ``origin``."""
    tm = memory.select(hash_key(*keys).alias("__m"), F.col("tgt").alias("__tm"))
    asked = items.withColumn("__key", F.when(_whole(keys), hash_key(*keys)))
    out = asked.join(tm, F.col("__key") == F.col("__m"), "left").join(hypotheses.select(id_col, F.col("hyp").alias("__hyp")), id_col, "left")
    text = F.coalesce("__tm", "__hyp", F.lit(""))
    origin = F.when(F.col("__tm").isNotNull(), "memory").when(F.col("__hyp").isNotNull(), "hypothesis").otherwise("missing")
    return out.select(*items.columns, T.squeeze(text).alias("text"), origin.alias("origin"))


def submission(items: DataFrame, memory: DataFrame, hypotheses: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """``apply_memory``, with an error if an id of ``items`` is lost, doubled or new."""
    rows = written(apply_memory(items, memory, hypotheses, keys, id_col))
    wrong = reconcile(items, rows, id_col).first()
    if wrong is not None:
        raise ValueError(f"id mismatch: {wrong['side']} {wrong['id']}")
    return rows


def reconcile(want: DataFrame, got: DataFrame, key: str) -> DataFrame:
    """Ids that one side lacks, counted by multiplicity: ``(side, id)``."""
    a, b = want.select(F.col(key).alias("id")), got.select(F.col(key).alias("id"))
    return a.exceptAll(b).select(F.lit("missing").alias("side"), "id").unionByName(b.exceptAll(a).select(F.lit("extra").alias("side"), "id"))


def combined(rows: DataFrame, blocks: list[str], lang: str, text: str, ordinal: str) -> DataFrame:
    """Tagged texts of the languages in ``blocks`` order: ``(block, ordinal, tagged)``."""
    place = F.array_position(F.array(*[F.lit(b) for b in blocks]), F.col(lang)) - 1
    return rows.where(F.col(lang).isin(*blocks)).select(place.cast("long").alias("block"), ordinal, T.tag_source(F.col(text), F.col(lang)).alias("tagged"))


def alternating_lines(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Source and target as lines of their own: ``(*keys, pos, line)``."""
    return pairs.select(*keys, F.posexplode(F.array("src", "tgt")).alias("pos", "line")).withColumn("line", T.one_line(F.col("line")))


def text_diagnostics(applied: DataFrame) -> DataFrame:
    """``(rows, memory_hits, missing, empty)`` of what ``apply_memory`` returned."""
    return applied.agg(
        F.count("*").alias("rows"), F.count_if(F.col("origin") == "memory").alias("memory_hits"),
        F.count_if(F.col("origin") == "missing").alias("missing"), F.count_if(F.col("text") == "").alias("empty"),
    )
