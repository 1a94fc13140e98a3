"""Array expressions: n-grams, tokens, frames, masks, and longest common subsequences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from weftline.functions.textops import WS, squeeze

PAD, UNK, BOS, EOS = 0, 1, 2, 3


def shingles(items: Column, n: int, sep: str = "") -> Column:
    """Joined runs of ``n`` neighbours: shifted copies zipped, without index arithmetic for each."""
    out = items
    for k in range(1, n):
        rest = F.slice(items, F.lit(k + 1), F.greatest(F.size(items) - k, F.lit(0)))
        out = F.zip_with(out, rest, lambda a, b: F.concat(a, F.lit(sep), b) if sep else F.concat(a, b))
    # The shorter side ran out on the last n - 1, which are null.
    return F.slice(out, F.lit(1), F.greatest(F.size(items) - (n - 1), F.lit(0)))


def char_ngrams(text: Column, orders: tuple[int, ...] = (1, 2, 3)) -> Column:
    """Character n-grams of the trimmed text between blanks, order by order."""
    chars = F.split(F.concat(F.lit(" "), F.regexp_replace(text, f"^{WS}+|{WS}+$", ""), F.lit(" ")), "")
    return F.concat(*[shingles(chars, n) for n in orders])


def tokens(text: Column) -> Column:
    """White space words with each leading and trailing punctuation mark a token of its own."""
    split3 = r"(?s)^(\p{P}*)(.*?)(\p{P}*)$"

    def peel(w: Column) -> Column:
        marks = lambda k: F.split(F.regexp_extract(w, split3, k), "")
        return F.concat(marks(1), F.array(F.regexp_extract(w, split3, 2)), marks(3))

    return F.filter(F.flatten(F.transform(F.split(squeeze(text), " "), peel)), lambda t: t != "")


def words(text: Column) -> Column:
    return F.filter(F.split(squeeze(text), " "), lambda t: t != "")


def frame(ids: Column, tag: Column, max_len: int) -> Column:
    """Tag, at most ``max_len - 2`` ids, end mark."""
    return F.concat(F.array(tag), F.slice(ids, 1, max_len - 2), F.array(F.lit(EOS)))


def pad(ids: Column, width: Column) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(PAD), F.greatest(width - F.size(ids), F.lit(0))))


def decoder_input(ids: Column) -> Column:
    return F.slice(ids, F.lit(1), F.greatest(F.size(ids) - 1, F.lit(0)))


def decoder_target(ids: Column) -> Column:
    return F.slice(ids, F.lit(2), F.greatest(F.size(ids) - 1, F.lit(0)))


def padding_mask(ids: Column) -> Column:
    return F.transform(ids, lambda x: x != PAD)


def causal_mask(ids: Column) -> Column:
    """For each position which others it may see: itself and those before."""
    return F.transform(ids, lambda _, i: F.transform(ids, lambda __, j: j <= i))


def strip_special(ids: Column) -> Column:
    """Up to the first end mark, without begin marks and padding."""
    at = F.array_position(ids, F.lit(EOS))
    head = F.when(at > 0, F.slice(ids, F.lit(1), (at - 1).cast("int"))).otherwise(ids)
    return F.filter(head, lambda x: ~x.isin(BOS, PAD))


def banned_next(ids: Column, n: int) -> Column:
    """What may not follow, lest an n-gram of ``ids`` repeat."""
    size = F.size(ids)
    tail = F.slice(ids, F.greatest(size - (n - 2), F.lit(1)), n - 1)
    starts = F.filter(F.sequence(F.lit(1), F.greatest(size - (n - 1), F.lit(1))), lambda i: (i + n - 1 <= size) & (F.slice(ids, i, n - 1) == tail))
    return F.when(size < n, F.array().cast("array<int>")).otherwise(
        F.array_distinct(F.transform(starts, lambda i: F.get(ids, i + F.lit(n - 2))))
    )


def lookup(m: Column, key: Column, default: Column) -> Column:
    return F.coalesce(F.try_element_at(m, key), default)


def item_size(src: Column, tgt: Column | None = None) -> Column:
    return F.size(src) if tgt is None else F.greatest(F.size(src), F.coalesce(F.size(tgt), F.lit(0)))


def common_length(x: list[str], y: list[str]) -> int:
    """Length of the longest common subsequence, a bit for each token of ``x``.

    A row of the dynamic program is one integer, so a pair costs as many big
    integer steps as ``y`` has tokens.
    """
    at: dict[str, int] = {}
    for i, t in enumerate(x):
        at[t] = at.get(t, 0) | 1 << i
    full = (1 << len(x)) - 1
    row = full
    for t in y:
        m = row & at.get(t, 0)
        row = (row + m | row - m) & full
    return len(x) - row.bit_count()


def runs(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Bounds of runs of rows whose sizes add up to ``most`` at the highest; a larger row is a run by itself."""
    ends = np.cumsum(sizes)
    at = 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield at, to
        at = to


@F.pandas_udf(LongType())
def lcs_length(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([0 if x is None or y is None else common_length(x, y) for x, y in zip(a, b, strict=True)], dtype="int64")
