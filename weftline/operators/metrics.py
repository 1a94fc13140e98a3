"""Corpus BLEU, ROUGE-L and chrF++ over ``(hyp, ref)`` rows, overall and by slice.

Tokens are made in the JVM; Arrow batches then count n-grams where the rows
are, a bounded run of rows at a time, and send a row of sums for each slice and
order. Sums add up, so all slices and all metrics come from one scan and no
text or n-gram is shuffled. A null side counts as an empty text. A worker holds
an Arrow batch and some 100 bytes for each item of a run, or of a longer row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions import arrays as A
from weftline.functions import textops as T
# By itself: what runs in workers must not drag a module along that may hold a session's objects.
from weftline.functions.arrays import common_length, runs
from weftline.operators.ordering import written

#: The least positive normal double, which stands for a precision of zero.
TINY = 2.2250738585072014e-308
ALL = "overall"
#: Tokens, and bytes of characters, that are counted at a time.
RUN = 1 << 17


def zipped(hyp: DataFrame, ref: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """``(ordinal, hyp, ref)`` by position; different row counts are an error."""
    n, m = hyp.count(), ref.count()
    if n != m:
        raise ValueError(f"{n} hypotheses for {m} references")
    return hyp.select(ordinal, "hyp").join(ref.select(ordinal, "ref"), ordinal)


def _clipped(tokens: np.ndarray, lengths: np.ndarray, hyp: np.ndarray, group: np.ndarray, orders: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each order sums of matches, hypothesis and reference n-grams by group: ``(n, 3 x groups)``.

    Texts follow each other in ``tokens``, two for each row; ``hyp`` says which
    are hypotheses, ``group`` is each row's. An n-gram of a row is numbered by
    that of one token less and its last token, so numbers stay exact.
    """
    rows = np.repeat(np.arange(len(lengths)) // 2, lengths)
    own = np.repeat(hyp, lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(tokens))
    base = int(tokens.max(initial=0)) + 1
    at, ids = np.arange(len(tokens)), rows
    for n in range(1, orders + 1):
        keep = left[at] >= n
        at, ids = at[keep], ids[keep]
        _, first, ids = np.unique(ids * base + tokens[at + n - 1], return_index=True, return_inverse=True)
        h, r = np.bincount(ids[own[at]], minlength=len(first)), np.bincount(ids[~own[at]], minlength=len(first))
        g = group[rows[at[first]]] if len(at) else np.empty(0, np.int64)
        yield n, np.stack([np.bincount(g, x, minlength=int(group.max(initial=0)) + 1) for x in (np.minimum(h, r), h, r)]).astype(np.int64)


def _numbered(texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of all texts as numbers, and how many each has."""
    flat = pa.array([t for x in texts for t in x], pa.string()).dictionary_encode()
    return flat.indices.to_numpy().astype(np.int64), np.fromiter(map(len, texts), np.int64, len(texts))


def _characters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return flat.astype(np.int64), np.fromiter(map(len, texts), np.int64, len(texts))


def _rouge(ref: list[str], hyp: list[str]) -> float:
    common = common_length(ref, hyp)
    if not common:
        return 0.0
    r, p = common / len(ref), common / len(hyp)
    beta2 = (p / (r + 1e-12)) ** 2
    return (1 + beta2) * r * p / (r + beta2 * p + 1e-12)


def _sums(rows: DataFrame, slice_col: str | None, *, tokens: int = 0, rouge: bool = False, chars: int = 0, words: int = 0) -> DataFrame:
    """``(slice, kind, n, matches, hyp_n, ref_n, value)``: n-grams of kind ``t``, ``c`` and ``w`` up to these orders; ROUGE-L and rows as ``rouge``."""
    empty = F.array().cast("array<string>")
    made = {"t": A.tokens, "c": T.drop_space, "w": A.words}
    asked = [k for k, on in (("t", tokens or rouge), ("c", chars), ("w", words)) if on]
    cols = [F.coalesce(made[k](F.col(c)), F.lit("") if k == "c" else empty).alias(f"{c}_{k}") for k in asked for c in ("hyp", "ref")]

    def summed(b: pa.RecordBatch) -> pa.RecordBatch:
        names = b.column(0).dictionary_encode(null_encoding="encode")
        group, slices = names.indices.to_numpy().astype(np.int64), names.dictionary.to_pylist()
        out = []
        for k, n in (("t", tokens), ("c", chars), ("w", words)):
            if not n:
                continue
            at = 1 + 2 * asked.index(k)
            texts = [x for pair in zip(b.column(at).to_pylist(), b.column(at + 1).to_pylist(), strict=True) for x in pair]
            flat, lengths = _characters(texts) if k == "c" else _numbered(texts)
            for order, sums in _clipped(flat, lengths, np.arange(len(texts)) % 2 == 0, group, n):
                out += [(slices[g], k, order, *sums[:, g].tolist(), 0.0) for g in range(len(slices))]
        if rouge:
            value = np.array([_rouge(r, h) for h, r in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)])
            sums, count = np.bincount(group, value, len(slices)), np.bincount(group, minlength=len(slices))
            out += [(slices[g], "rouge", 0, int(count[g]), 0, 0, float(sums[g])) for g in range(len(slices))]
        parts = list(zip(*out, strict=True)) or [()] * 7
        kinds = (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(parts, kinds, strict=True)], ["slice", "kind", "n", "matches", "hyp_n", "ref_n", "value"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = np.zeros(b.num_rows, np.int64)
            for c in b.columns[1:]:
                sizes += (pc.binary_length(c) if pa.types.is_string(c.type) else pc.list_value_length(c)).to_numpy()
            for at, to in runs(sizes, RUN):
                yield summed(b.slice(at, to - at))

    picked = rows.select((F.col(slice_col).cast("string") if slice_col else F.lit(ALL)).alias("slice"), *cols)
    sums = picked.mapInArrow(run, "slice string, kind string, n int, matches long, hyp_n long, ref_n long, value double")
    aggs = [F.sum(c).alias(c) for c in ("matches", "hyp_n", "ref_n", "value")]
    if slice_col is None:
        return sums.groupBy("slice", "kind", "n").agg(*aggs)
    out = sums.groupingSets([[F.col("kind"), F.col("n")], [F.col("kind"), F.col("n"), F.col("slice")]], "kind", "n", "slice").agg(*aggs, F.grouping_id().alias("__g"))
    return out.withColumn("slice", F.when(F.col("__g") == 0, F.col("slice")).otherwise(F.lit(ALL))).drop("__g")


def _bleu(sums: DataFrame) -> DataFrame:
    pick = lambda c, n: F.coalesce(F.sum(F.when(F.col("n") == n, F.col(c))), F.lit(0)).alias(f"{c}{n}")
    wide = sums.where("kind = 't'").groupBy("slice").agg(*[pick(c, n) for c in ("matches", "hyp_n", "ref_n") for n in range(1, 5)])
    dead = (F.col("matches1") == 0) | F.least(*[F.col(f"hyp_n{n}") for n in range(1, 5)]).isin(0)
    logs = F.lit(0.0)
    for n in range(1, 5):
        p = F.try_divide(F.col(f"matches{n}").cast("double"), F.col(f"hyp_n{n}"))
        logs = logs + 0.25 * F.log(F.when(p > 0, p).otherwise(F.lit(TINY)))
    brevity = F.when(F.col("hyp_n1") > F.col("ref_n1"), 1.0).otherwise(F.exp(1 - F.try_divide(F.col("ref_n1").cast("double"), F.col("hyp_n1"))))
    return wide.select("slice", F.when(dead, 0.0).otherwise(brevity * F.exp(logs)).alias("bleu"))


def _chrf(sums: DataFrame, orders: int, beta: float) -> DataFrame:
    share = lambda c: F.coalesce(F.try_divide(F.col("matches").cast("double"), F.col(c)), F.lit(0.0))
    mean = sums.where("kind IN ('c', 'w')").groupBy("slice").agg((F.sum(share("hyp_n")) / float(orders)).alias("p"), (F.sum(share("ref_n")) / float(orders)).alias("r"))
    b2 = beta**2
    score = F.try_divide((1 + b2) * F.col("p") * F.col("r"), b2 * F.col("p") + F.col("r"))
    return mean.select("slice", F.coalesce(score, F.lit(0.0)).alias("chrf"))


def _rouge_l(sums: DataFrame) -> DataFrame:
    return sums.where("kind = 'rouge'").select("slice", F.coalesce(F.try_divide("value", "matches"), F.lit(0.0)).alias("rouge_l"), F.col("matches").alias("n"))


def _with_overall(scores: DataFrame) -> DataFrame:
    """``scores`` of ROUGE-L, with a row of zeros for all of no rows."""
    one = scores.sparkSession.range(1).select(F.lit(ALL).alias("__s"))
    both = scores.join(one, F.col("slice") == F.col("__s"), "full")
    return both.select(F.coalesce("slice", "__s").alias("slice"), F.coalesce("rouge_l", F.lit(0.0)).alias("rouge_l"), F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def bleu(rows: DataFrame, slice_col: str | None = None) -> DataFrame:
    """``(slice, bleu)``: BLEU-4 with equal weights and no smoothing, 0 without a match or without n-grams of an order."""
    return _bleu(_sums(rows, slice_col, tokens=4))


def chrf(rows: DataFrame, slice_col: str | None = None, char_order: int = 6, word_order: int = 2, beta: float = 2.0) -> DataFrame:
    """``(slice, chrf)``: precision and recall averaged over all orders, those without n-grams as 0."""
    return _chrf(_sums(rows, slice_col, chars=char_order, words=word_order), char_order + word_order, beta)


def rouge_rows(rows: DataFrame) -> DataFrame:
    """Adds ``rouge`` for each row, 0 if a side has no tokens or nothing in common."""
    split = rows.withColumns({"__h": A.tokens(F.col("hyp")), "__r": A.tokens(F.col("ref"))})
    with_lcs = split.withColumn("__l", A.lcs_length("__r", "__h").cast("double"))
    r, p = F.try_divide("__l", F.size("__r")), F.try_divide("__l", F.size("__h"))
    beta2 = F.pow(p / (r + 1e-12), F.lit(2.0))
    f = (1 + beta2) * r * p / (r + beta2 * p + 1e-12)
    return with_lcs.withColumn("rouge", F.when(F.col("__l") > 0, f).otherwise(0.0)).drop("__h", "__r", "__l")


def rouge_l(rows: DataFrame, slice_col: str | None = None) -> DataFrame:
    """``(slice, rouge_l, n)``: the mean over rows."""
    return _with_overall(_rouge_l(_sums(rows, slice_col, rouge=True)))


def score_report(rows: DataFrame, slice_col: str | None = None) -> DataFrame:
    """``(slice, bleu, rouge_l, chrf, total, n)``: four places, and the total of three-place values; one scan of ``rows``."""
    # A few rows for each slice.
    sums = written(_sums(rows, slice_col, tokens=4, rouge=True, chars=6, words=2))
    all_ = _with_overall(_rouge_l(sums)).join(_bleu(sums), "slice", "left").join(_chrf(sums, 8, 2.0), "slice", "left")
    m = {c: F.coalesce(c, F.lit(0.0)) for c in ("bleu", "rouge_l", "chrf")}
    total = F.round(F.round(m["bleu"], 3) + F.round(m["rouge_l"], 3) + F.round(m["chrf"], 3), 4)
    return all_.select("slice", *[F.round(c, 4).alias(k) for k, c in m.items()], total.alias("total"), "n")


def cross_check(rows: DataFrame) -> dict[str, float | str]:
    """Scores of the well-known libraries where they are installed, for evaluation sets that fit the driver; else why not."""
    out: dict[str, float | str] = {}
    try:
        import sacrebleu
    except ImportError as e:
        out["sacrebleu"] = f"unavailable ({type(e).__name__})"
        return out
    hyp, ref = zip(*((r["hyp"], r["ref"]) for r in rows.select("hyp", "ref").toLocalIterator()), strict=True)
    out["sacrebleu_bleu_x100"] = round(sacrebleu.corpus_bleu(hyp, [ref]).score, 3)
    out["sacrebleu_chrf++_x100"] = round(sacrebleu.corpus_chrf(hyp, [ref], word_order=2).score, 3)
    return out
