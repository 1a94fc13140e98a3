"""Toxicity: FTRL-proximal logistic regression over hashed words, word pairs and skip pairs.

Each coordinate has its own rate, and L1 keeps most weights at exactly zero,
so the model is a short list of buckets and weights: at most 2**20 of them
whatever the corpus, small enough to go to every task.

Defined cases: null and empty texts score the model's bias; labels that are
null count for nothing; without labels every score is 0.5 and predicted is 1
only by the fixed threshold; a score of exactly ``threshold`` is predicted 1
(ties); a very long text is read whole, its features taking some 100 bytes a
word while it is scored; a null doc_id is scored, not held out, and never
learnt from; repeated rows come back as often; an empty table gives an empty
result; further columns, whatever their names, are left behind.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import labelled
from weftline.llm.common import col, table
from weftline.llm.textbytes import texts

#: Labelled rows that are learnt from at most, by least draw key.
SAMPLE = 20000
BITS = 20
SEED = 7
#: A word also counts by its first bytes, so that an inflected form never seen can still tell.
STEMS = (4, 5)
#: ASCII punctuation and controls part words; upper case counts as lower.
PLAIN = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256))


def features(text: bytes) -> np.ndarray:
    """Buckets of words, their stems, adjacent pairs and pairs with one word skipped, repeats included."""
    words = text.lower().translate(PLAIN).split()
    h = np.fromiter(map(crc32, words), np.uint32, len(words))
    first = h * np.uint32(0x85EBCA6B)
    grams = [h, (first[:-1] ^ h[1:]) + np.uint32(1), (first[:-2] ^ h[2:]) + np.uint32(2)]
    for k in STEMS:
        stem = np.fromiter((crc32(w[:k]) for w in words), np.uint32, len(words))
        grams.append(stem * np.uint32(0xC2B2AE35) + np.uint32(k))
    every = np.concatenate(grams)
    return (every * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)


def presence(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(features(text)), np.empty(0, np.float32)


def fit(examples: list[labelled.Example], epochs: int = 4, alpha: float = 2.0, beta: float = 1.0, l1: float = 5.0, l2: float = 0.1) -> dict[str, np.ndarray]:
    """FTRL-proximal in a fixed order; coordinate 0 of the last place is the bias, without L1."""
    size = 1 << BITS
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    lam = np.full(size + 1, l1)
    lam[size] = 0.0

    def weights(at):
        za, na = z[at], n[at]
        w = -(za - np.sign(za) * lam[at]) / ((beta + np.sqrt(na)) / alpha + l2)
        return np.where(np.abs(za) > lam[at], w, 0.0)

    for _ in range(epochs):
        for at, _, y in examples:
            at = np.append(at, size)
            w = weights(at)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            root = np.sqrt(n[at])
            z[at] += g - (np.sqrt(n[at] + g * g) - root) / alpha * w
            n[at] += g * g
    w = weights(np.arange(size + 1))
    some = np.flatnonzero(w[:size])
    return {"at": some.astype(np.uint32), "w": w[some].astype(np.float32), "bias": w[size:]}


def toxicity_model(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> dict[str, np.ndarray]:
    """Learnt from ``labels`` as they are given: leave out what is to be held out."""
    return labelled.train(
        labelled.sampled(docs, labels, F.col("toxic"), limit, SEED), presence, fit
    )


def toxicity(docs: DataFrame, model: dict[str, np.ndarray], *, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, score, predicted)`` for every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.zeros(1 << BITS, np.float32)
        w[model["at"]] = model["w"]
        bias = float(model["bias"][0])
        for b in batches:
            s = np.empty(b.num_rows)
            for k, x in enumerate(texts(b.column(1))):
                at = features(x)
                s[k] = bias + w[np.unique(at[w[at] != 0])].sum(dtype=np.float64)
            p = 1 / (1 + np.exp(-np.clip(s, -35, 35)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    picked = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id long, score double, predicted int")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    model = toxicity_model(docs, labels.where(~held_out))
    return toxicity(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")
