"""Scalar string expressions.

Regular expressions keep to what Java and RE2 read alike. ``WS`` is Unicode
white space spelled out, since Java's ``\\s`` is ASCII only.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from weftline.config import DEFAULT, Config

WS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]"
DIGIT_PREFIX = rf"^{WS}*\p{{Nd}}+{WS}*:{WS}*"
#: Controls that become blanks, code points that are removed, and the sentence marks of each language.
CONTROLS = r"[\x00-\x08\x0b-\x0c\x0e-\x1f\x7f]"
ZERO_WIDTH = "\ufeff\u200b\u2060\u00ad"
DANDA, BENGALI_FOUR, PASEQ = "\u0964", "\u09f7", "\u05c0"
ASSAMESE = r"[\x{09F0}\x{09F1}]"
#: Texts that are composed at a time.
RUN = 128


@cache
def uncomposed() -> str:
    """A character class: any text without its members is composed.

    Members are marks with a combining class, characters that composition
    replaces, and those that it may join to the one before: the second parts of
    canonical pairs, and the vowels and finals of Hangul syllables.
    """
    found = set(range(0x1161, 0x1176)) | set(range(0x11A8, 0x11C3))
    for c in range(0xC0, sys.maxunicode + 1):
        x = chr(c)
        if unicodedata.combining(x) or not unicodedata.is_normalized("NFC", x):
            found.add(c)
        parts = unicodedata.decomposition(x).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            found.add(int(parts[1], 16))
    starts = sorted(c for c in found if c - 1 not in found)
    ends = sorted(c for c in found if c + 1 not in found)
    return "[" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in zip(starts, ends, strict=True)) + "]"


def composed_run(texts: list[str | None]) -> list[str | None]:
    return [None if x is None else unicodedata.normalize("NFC", x) for x in texts]


@F.arrow_udf(StringType())
def _composed(text: pa.Array) -> pa.Array:
    # A batch without doubtful texts, the usual one, goes back as it is.
    if text.null_count == len(text):
        return text
    return pa.concat_arrays([pa.array(composed_run(text.slice(at, RUN).to_pylist()), text.type) for at in range(0, len(text), RUN)])


def nfc(text: Column) -> Column:
    """Unicode canonical composition, which Spark has no function for: only texts that may need it go to Python."""
    # Most texts hold nothing above U+02FF, which one cheap look tells.
    doubtful = text.rlike(r"[^\x00-\x{2FF}]") & text.rlike(uncomposed())
    return F.coalesce(_composed(F.when(doubtful, text)), text)


def strip_digit_prefix(text: Column) -> Column:
    """Without a leading number and colon, in any script's digits."""
    return F.regexp_replace(text, DIGIT_PREFIX, "")


def replace_controls(text: Column) -> Column:
    return F.regexp_replace(text, CONTROLS, " ")


def strip_zero_width(text: Column) -> Column:
    return F.translate(text, ZERO_WIDTH, "")


def map_danda(text: Column, lang: Column | None, fold_bengali: bool = False) -> Column:
    """Sentence marks of Bengali and Hindi in one form; other languages, and none, unchanged."""
    if lang is None:
        return text
    bengali = F.translate(text, PASEQ + BENGALI_FOUR, DANDA * 2) if fold_bengali else F.translate(text, PASEQ, DANDA)
    return F.when(lang == "bn", bengali).when(lang == "hi", F.translate(text, "|", DANDA)).otherwise(text)


def squeeze(text: Column) -> Column:
    """White space runs as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, f"{WS}+", " "))


def normalise(text: Column, lang: Column | None = None, fold_bengali: bool = False, compose: bool = True) -> Column:
    """Composition, controls, zero-width marks, sentence marks, white space, in this order.

    ``compose=False`` leaves the Python step out, for text known to be composed.
    """
    c = nfc(text) if compose else text
    return squeeze(map_danda(strip_zero_width(replace_controls(c)), lang, fold_bengali))


def script_ratio(text: Column, lang: Column, config: Config = DEFAULT) -> Column:
    """Letters in the language's script over all letters; 0 without letters or for an unknown language."""
    inside = F.lit(0)
    for (lo, hi) in sorted(set(config.scripts.values())):
        names = [k for k, v in config.scripts.items() if v == (lo, hi)]
        count = F.regexp_count(text, F.lit(rf"[\p{{L}}&&[\x{{{lo:04X}}}-\x{{{hi:04X}}}]]"))
        inside = F.when(lang.isin(*names), count).otherwise(inside)
    return F.coalesce(F.try_divide(inside.cast("double"), F.regexp_count(text, F.lit(r"\p{L}"))), F.lit(0.0))


def tag_source(text: Column, lang: Column) -> Column:
    return F.concat(F.lit("<2"), lang, F.lit("> "), text)


def split_tag(tagged: Column, known: list[str]) -> Column:
    """``struct<lang, text>`` of a tagged text; an unknown tag is an error."""
    lang = F.regexp_extract(tagged, r"^<2(\w+)> ", 1)
    text = F.element_at(F.split(tagged, " ", 2), 2)
    return F.when(lang.isin(*known), F.struct(lang.alias("lang"), text.alias("text"))).otherwise(
        F.raise_error(F.concat(F.lit("unknown tag: "), tagged))
    )


def tag_language(tagged: Column) -> Column:
    """The language of the first word, bare of the marks around it."""
    return F.regexp_replace(F.element_at(F.split(tagged, " ", 2), 1), r"^[<>2]+|[<>2]+$", "")


def has_assamese(text: Column) -> Column:
    return text.rlike(ASSAMESE)


def assamese_letters(text: Column) -> Column:
    return F.regexp_count(text, F.lit(ASSAMESE))


def length_ratio(a: Column, b: Column) -> Column:
    """Longer over shorter in code points; null if one is empty."""
    x, y = F.length(a), F.length(b)
    return F.try_divide(F.greatest(x, y).cast("double"), F.least(x, y))


def drop_space(text: Column) -> Column:
    return F.regexp_replace(text, f"{WS}+", "")


def one_line(text: Column) -> Column:
    return F.translate(text, "\n", " ")


def length_penalty(length: Column, alpha: float) -> Column:
    return F.pow((length + 5) / F.lit(6.0), F.lit(alpha))


def noam_rate(step: Column, d_model: int, warmup: int, scale: float = 1.0) -> Column:
    """Inverse square root schedule with linear warm-up; steps below 1 count as 1."""
    s = F.greatest(step, F.lit(1)).cast("double")
    return F.lit(scale * d_model**-0.5) * F.least(F.pow(s, F.lit(-0.5)), s * F.lit(warmup**-1.5))


def perplexity(loss: Column, cap: float = 20.0) -> Column:
    return F.exp(F.least(loss, F.lit(cap)))


def degenerate(text: Column, unknown: str = "<unk>", most: int = 3) -> Column:
    """Blank, or with more than ``most`` unknown marks."""
    return (squeeze(text) == "") | (F.regexp_count(text, F.lit(unknown)) > most)
