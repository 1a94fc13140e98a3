"""Quality rules: fixed counts of a text, and a calibrated hashed n-gram classifier.

The classifier is a logistic regression on relative frequencies of hashed
words and word pairs, and of hashed character 3- and 4-grams, learnt from rows
with a quality label. A held-back fifth of them calibrates its scores to
probabilities (Platt scaling); a text is kept at ``threshold`` or more.

Defined cases: a null text is an empty text with no words, and fails the base
rules; a very long text is read whole, its n-grams taking some 20 bytes a
character while it is scored; a probability of exactly ``threshold`` is kept
(ties); null labels and null ids are not learnt from; ``keep_good`` passes all
columns, whatever their names; without usable labels of both kinds every score is the base rate (1 if
there are none at all); repeated rows come back as often; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from weftline.llm import labelled
from weftline.llm.common import col, table
from weftline.llm.textbytes import parts, texts

#: Labelled rows that are learnt from at most, by least draw key.
SAMPLE = 8000
BITS = 15
SEED = 9
CONTINUES = bytes(range(0x80, 0xC0))
SYMBOLS = b"#*$%&|<>"


def repeated_words(words: list[bytes], window: int = 3) -> int:
    """Words inside windows that occur twice or more."""
    n = len(words)
    if n <= window:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    key = ids[: n - window + 1]
    for k in range(1, window):
        if k > 1:  # small numbers again, so that a product can't overflow
            key = np.unique(key, return_inverse=True)[1]
        key = key * len(known) + ids[k : n - window + 1 + k]
    _, at, counts = np.unique(key, return_inverse=True, return_counts=True)
    again = counts[at] > 1
    if not again.any():
        return 0
    covered = np.zeros(n, bool)
    for k in range(window):
        covered[k : k + len(again)] |= again
    return int(covered.sum())


def rule_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` of a UTF-8 text."""
    words = text.split()
    word_chars = len(b"".join(words).translate(None, CONTINUES))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    seen, repeats = set(), 0
    for line in text.split(b"\n"):
        if line and not line.isspace():
            repeats += line in seen
            seen.add(line)
    return len(words), word_chars, symbols, repeats, repeated_words(words)


def _hash(x: np.ndarray, bits: int) -> np.ndarray:
    return (x.astype(np.uint32) * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)


def buckets(text: bytes, words: list[bytes] | None = None, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of word 1- and 2-grams, and those of character 3- and 4-grams, repeats included."""
    words = text.split() if words is None else words
    h = np.fromiter(map(crc32, words), np.uint32, len(words))
    pairs = h[:-1] * np.uint32(0x85EBCA6B) ^ h[1:]
    raw = np.frombuffer(text, np.uint8).astype(np.uint32)
    three = raw[:-2] << np.uint32(16) | raw[1:-1] << np.uint32(8) | raw[2:] if len(raw) > 2 else raw[:0]
    four = three[:-1] << np.uint32(8) | raw[3:] if len(raw) > 3 else raw[:0]
    return _hash(np.concatenate((h, pairs)), bits), _hash(np.concatenate((three + np.uint32(7), four)), bits)


def frequencies(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Sparse relative frequencies: word buckets first, character buckets after them."""
    at, x = [], []
    for k, b in enumerate(buckets(text)):
        ids, counts = np.unique(b, return_counts=True)
        at.append(ids + (k << BITS))
        x.append(counts / max(1, len(b)))
    return np.concatenate(at), np.concatenate(x)


def fit(examples: list[labelled.Example], epochs: int = 6, rate: float = 2.0, ridge: float = 1e-6, hold_back: int = 5) -> dict[str, np.ndarray]:
    """Adaptive-gradient logistic regression in a fixed order, then calibration on every fifth example."""
    w = np.zeros(2 << BITS, np.float64)
    g2 = np.full(2 << BITS, 1e-8)
    bias, bias_g2 = 0.0, 1e-8
    learn = [e for k, e in enumerate(examples) if k % hold_back]
    for _ in range(epochs):
        for at, x, y in learn:
            p = 1 / (1 + np.exp(-np.clip(bias + w[at] @ x, -30, 30)))
            d = p - y
            g = d * x + ridge * w[at]
            g2[at] += g * g
            w[at] -= rate * g / np.sqrt(g2[at])
            bias_g2 += d * d
            bias -= 0.1 * d / np.sqrt(bias_g2)
    held = [e for k, e in enumerate(examples) if k % hold_back == 0]
    s = np.array([bias + w[at] @ x for at, x, _ in held])
    a, b = platt(s, np.array([y for *_, y in held]))
    return {"w": w.astype(np.float32), "scale": np.array([a, b + a * bias])}


def platt(s: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """``a, b`` of the probability ``1 / (1 + exp(-(a s + b)))``, with smoothed targets."""
    if not len(y):
        return 0.0, 35.0
    pos, neg = float(y.sum()), float(len(y) - y.sum())
    t = y * (pos + 1) / (pos + 2) + (1 - y) / (neg + 2)
    if min(pos, neg) == 0:
        return 0.0, float(np.log(t.mean() / (1 - t.mean())))
    m, sd = s.mean(), s.std() or 1.0
    u, theta = (s - m) / sd, np.array([1.0, np.log((pos + 1) / (neg + 1))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(theta[0] * u + theta[1], -35, 35)))
        grad = np.array([((p - t) * u).sum(), (p - t).sum()]) + 1e-3 * np.array([theta[0], 0])
        c = np.maximum(p * (1 - p), 1e-9)
        hess = np.array([[(c * u * u).sum() + 1e-3, (c * u).sum()], [(c * u).sum(), c.sum() + 1e-6]])
        step = np.linalg.solve(hess, grad)
        theta = theta - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(theta[0] / sd), float(theta[1] - theta[0] * m / sd)


def probability(model: dict[str, np.ndarray], text: bytes, words: list[bytes] | None = None) -> float:
    s = model["scale"][1]
    for k, b in enumerate(buckets(text, words)):
        if len(b):
            s += model["scale"][0] * float(model["w"][(k << BITS) : (k + 1) << BITS][b].mean(dtype=np.float64))
    return float(1 / (1 + np.exp(-np.clip(s, -35, 35))))


def quality_model(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> dict[str, np.ndarray]:
    return labelled.train(labelled.sampled(docs, labels, F.col("quality"), limit, SEED), frequencies, fit)


def quality_rules(
    docs: DataFrame, model: dict[str, np.ndarray], *, threshold: float = 0.5, min_words: int = 50, max_repeat_percent: int = 50,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``doc_id``, the counts, ``quality`` (probability), ``base_failed`` and ``kept`` for every row of ``docs``."""
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "quality", "base_failed", "kept"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = np.empty((b.num_rows, 5), np.int64)
            p = np.empty(b.num_rows)
            for k, x in enumerate(texts(b.column(1))):
                counts[k] = rule_counts(x)
                p[k] = probability(model, x)
            failed = (counts[:, 0] < min_words) | (100 * counts[:, 4] > max_repeat_percent * counts[:, 0])
            cols = [b.column(0), *(pa.array(counts[:, k]) for k in range(5)), pa.array(p), pa.array(failed), pa.array(~failed & (p >= threshold))]
            yield pa.RecordBatch.from_arrays(cols, names)

    picked = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, quality double, base_failed boolean, kept boolean")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules(docs, quality_model(docs, table(spark, sf_dir, "labels")))


def keep_good(docs: DataFrame, model: dict[str, np.ndarray], *, threshold: float = 0.5, min_words: int = 50, max_repeat_percent: int = 50, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the base rules and the classifier keep, with all their columns."""
    names = docs.columns
    place = names.index(text_col)
    # Numbered names on the way, since a name may hold points.
    plain = [f"c{k}" for k in range(len(names))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            keep = []
            for x in texts(b.column(place)):
                words = x.split()
                n = len(words)
                failed = n < min_words or 100 * repeated_words(words) > max_repeat_percent * n
                keep.append(not failed and probability(model, x, words) >= threshold)
            yield b.filter(pa.array(keep, pa.bool_()))

    schema = StructType([StructField(p, f.dataType) for p, f in zip(plain, docs.schema, strict=True)])
    kept = docs.select(*[col(c).alias(p) for c, p in zip(names, plain, strict=True)]).mapInArrow(run, schema)
    return kept.select(*[F.col(p).alias(c) for c, p in zip(names, plain, strict=True)])
