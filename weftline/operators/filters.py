"""Cleaning, first-match drop reasons, and the counters of both."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from weftline.config import DEFAULT, Config
from weftline.functions import textops as T


def clean_pairs(pairs: DataFrame, config: Config = DEFAULT, compose: bool = True) -> DataFrame:
    """``pairs`` (``src, tgt, lang`` and more) cleaned on both sides, with a ``flags`` array."""
    src, tgt = T.strip_digit_prefix(F.col("src")), T.strip_digit_prefix(F.col("tgt"))
    step = pairs.withColumns({"__s": src, "__t": tgt})
    clean = step.withColumns({
        "__ns": T.normalise(F.col("__s"), None, compose=compose),
        "__nt": T.normalise(F.col("__t"), F.col("lang"), config.fold_bengali_danda, compose=compose),
    })
    flag = lambda cond, name: F.when(cond, F.lit(name))
    flags = F.array_compact(F.array(
        flag(F.col("__t") != F.col("tgt"), "digit_prefix_stripped"),
        flag(F.col("__s") != F.col("src"), "digit_prefix_stripped_src"),
        flag((F.col("__ns") != F.col("__s")) | (F.col("__nt") != F.col("__t")), "normalised"),
    ))
    return clean.withColumns({"flags": flags, "src": F.col("__ns"), "tgt": F.col("__nt")}).drop("__s", "__t", "__ns", "__nt")


def drop_reason(config: Config = DEFAULT, predicted: Column | None = None) -> Column:
    """The first reason that holds for ``src, tgt, lang``, or null; ``predicted`` is the language found for ``tgt``."""
    src, tgt, lang = F.col("src"), F.col("tgt"), F.col("lang")
    none = F.coalesce(src, F.lit("")) == ""
    ls, lt = F.length(src), F.length(tgt)
    reason = (
        F.when(none | (F.coalesce(tgt, F.lit("")) == ""), "empty_field")
        .when(src == tgt, "src_equals_tgt")
        .when(T.script_ratio(tgt, lang, config) < config.min_script_ratio, "wrong_script")
        .when(T.assamese_letters(tgt) >= config.max_assamese_letters, "assamese_target")
    )
    if predicted is not None:
        reason = reason.when((lt >= config.min_length_for_lid) & (predicted != lang), "lid_language_mismatch")
    long_enough = F.least(ls, lt) >= config.min_length_for_ratio
    return reason.when(long_enough & (T.length_ratio(src, tgt) > config.max_length_ratio), "length_ratio")


def filtered(pairs: DataFrame, config: Config = DEFAULT, lid=None) -> DataFrame:
    """Cleaned ``pairs`` with ``reason``. With a language model only rows that pass the cheap tests are scored, where they are."""
    cheap = pairs.withColumn("reason", drop_reason(config))
    if lid is None:
        return cheap
    from weftline.operators import langid

    asked = (F.col("reason").isNull() | (F.col("reason") == "length_ratio")) & (F.length("tgt") >= config.min_length_for_lid)
    said = cheap.withColumn("__said", langid.predictor(lid, config)(F.when(asked, F.col("tgt"))))
    return said.withColumn("reason", F.when(F.col("__said") != F.col("lang"), F.lit("lid_language_mismatch")).otherwise(F.col("reason"))).drop("__said")


REASONS = ("empty_field", "src_equals_tgt", "wrong_script", "assamese_target", "lid_language_mismatch", "length_ratio", "duplicate", "leaked_into_eval")
FLAGS = ("digit_prefix_stripped", "digit_prefix_stripped_src", "normalised")


def observed(rows: DataFrame, by: str, values: list[str]) -> tuple[DataFrame, Callable[[], list[tuple[str, str, int]]]]:
    """``rows`` as they are, and after an action on them the counters ``(value, counter, n)`` above zero of each of a few ``values``.

    They are counted in the pass that writes the rows. Spark takes a task's
    counts once, when it succeeds in the stage that writes, so tasks that are
    run again don't add to them; no shuffle may come after.
    """
    seen = Observation()
    reason = F.col("reason")
    tests = {"read": F.lit(True), "kept": reason.isNull()}
    tests |= {f"dropped_{r}": reason == r for r in REASONS} | {f: F.array_contains("flags", f) for f in FLAGS}
    names = {f"c{i}": (v, c) for i, (v, c) in enumerate((v, c) for v in values for c in tests)}
    out = rows.observe(seen, *[F.count_if((F.col(by) == v) & tests[c]).alias(k) for k, (v, c) in names.items()])
    return out, lambda: [(*names[k], n) for k, n in seen.get.items() if n]


def report(rows: DataFrame, by: str) -> DataFrame:
    """Counters in long form: ``(by, counter, n)``, only those above zero. One pass, one shuffle."""
    counters = F.concat(
        F.array(F.lit("read"), F.when(F.col("reason").isNull(), F.lit("kept")).otherwise(F.concat(F.lit("dropped_"), F.col("reason")))),
        F.col("flags"),
    )
    return rows.select(by, F.explode(counters).alias("counter")).groupBy(by, "counter").agg(F.count("*").alias("n"))
