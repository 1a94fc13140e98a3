"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or abstain on every document. Expectation
maximisation over the counts of vote patterns (at most 3 to the number of
labellers, whatever the corpus) estimates how often each labeller gives each
vote on good and on bad documents, and with it the probability that a pattern
belongs to a good document. These posteriors label a bounded sample from which
a hashed linear scorer learns; it scores every document.

Defined cases: null and empty texts are documents without words; a very long
text is read whole, its word counts taking some 100 bytes a different word;
without any documents the result is empty; if all documents have one pattern,
its posterior is the prior's; a score of exactly ``threshold`` is kept (ties);
repeated rows come back as often; null ids stay null and are not learnt from;
further columns, whatever their names, are left behind.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import labelled, quality
from weftline.llm.common import col, materialise, table
from weftline.llm.textbytes import texts

SAMPLE = 8000
SEED = 3
#: Frequent words of English, French, German and Spanish.
FREQUENT = frozenset(
    "the of and to in a is that it for was on are as with be by this at from or have an not "
    "le la les de des du et en un une est que qui dans pour par sur au avec ne pas se "
    "der die das und ist von den dem ein eine zu mit sich auf für nicht im des es "
    "el los las del y que en por con para una su al lo como más".encode().split()
)


def votes(text: bytes) -> tuple[int, ...]:
    """1 good, -1 bad, 0 abstains.

    Length, symbols, capitals, repetition, repeated lines, plain words, sentence
    ends, frequent words, a word twice in a row and one word's share, in this
    order; the second to the fifth and the last two only ever find faults, and
    abstain on a text without.
    """
    words = text.split()
    n = len(words)
    if not n:
        return (-1,) + (0,) * (LABELLERS - 1)
    _, chars, symbols, dup_lines, repeated = quality.rule_counts(text)
    upper = len(text) - len(text.translate(None, CAPITALS))
    ends = sum(w[-1:] in (b".", b"!", b"?") for w in words)
    frequent = sum(w.lower() in FREQUENT for w in words)
    stutter = sum(map(eq, words, words[1:]))
    most = max(Counter(words).values())

    def judge(x: float, good_to: float, bad_from: float) -> int:
        return 1 if x <= good_to else -1 if x >= bad_from else 0

    plain = sum(w.strip(MARKS).isalpha() if w.isascii() else w.strip(MARKS).decode().isalpha() for w in words)
    return (
        judge(-n, -50, -1),
        min(0, judge(symbols / n, 0.02, 0.15)),
        min(0, judge(upper / max(1, chars), 0.15, 0.4)),
        min(0, judge(repeated / n, 0.1, 0.5)),
        min(0, judge(dup_lines / (text.count(b"\n") + 1), 0.05, 0.3)),
        judge(-plain / n, -0.95, -0.8),
        int(ends > 0) if n < 20 else judge(abs(ends / n - 0.1), 0.09, 0.4),
        int(frequent > 0) if n < 20 else judge(-frequent / n, -0.1, -0.02),
        min(0, judge(stutter / n, 0.01, 0.05)),
        min(0, judge(most / n, 0.15, 0.3)) if n >= 20 else 0,
    )


MARKS = b".,;:!?\"'()-"
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LABELLERS = 10


def pattern(v: tuple[int, ...]) -> int:
    return sum((x + 1) * 3**k for k, x in enumerate(v))


def posteriors(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Probability of a good document for each pattern, by expectation-maximisation."""
    if not len(patterns):
        return np.empty(0)
    v = patterns[:, None] // 3 ** np.arange(LABELLERS) % 3
    c = counts.astype(float)
    p = np.clip(0.5 + 0.25 * (v - 1).sum(axis=1), 0.05, 0.95)
    for _ in range(rounds):
        prior = np.clip((c @ p) / c.sum(), 1e-6, 1 - 1e-6)
        log = []
        for r in (p, 1 - p):
            rates = np.array([[(c * r)[v[:, k] == x].sum() + 0.5 for x in range(3)] for k in range(LABELLERS)])
            log.append(np.log(rates / rates.sum(axis=1, keepdims=True))[np.arange(LABELLERS), v].sum(axis=1))
        odds = np.log(prior / (1 - prior)) + log[0] - log[1]
        new = 1 / (1 + np.exp(-np.clip(odds, -35, 35)))
        done = np.abs(new - p).max() < 1e-9
        p = new
        if done:
            break
    return p


def weak_labels(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, pattern, posterior)`` for every row of ``docs``."""
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = pa.array([pattern(votes(x)) for x in texts(b.column(1))], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), got], ["doc_id", "pattern"])

    picked = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).cast("string").alias("text"))
    voted = materialise(picked.mapInArrow(run, "doc_id long, pattern int"))
    counted = sorted(tuple(r) for r in voted.groupBy("pattern").count().collect())
    p = posteriors(np.array([r[0] for r in counted], np.int64), np.array([r[1] for r in counted], np.int64))
    rows = [(r[0], float(x)) for r, x in zip(counted, p, strict=True)]
    known = spark.createDataFrame(rows, "pattern int, posterior double")
    return voted.join(F.broadcast(known), "pattern").select("doc_id", "pattern", "posterior")


def weak_quality(docs: DataFrame, *, limit: int = SAMPLE, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, score, kept)`` for every row of ``docs``."""
    labels = weak_labels(docs, id_col, text_col)
    sample = labelled.sampled(docs.withColumnRenamed(id_col, "doc_id"), labels, F.col("posterior"), limit, SEED, "doc_id", text_col)
    model = labelled.train(sample, quality.frequencies, quality.fit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = np.array([quality.probability(model, x) for x in texts(b.column(1))], float)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p, pa.float64()), pa.array(p >= threshold, pa.bool_())], ["doc_id", "score", "kept"])

    picked = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id long, score double, kept boolean")


def op3_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_quality(table(spark, sf_dir, "documents").select("doc_id", "text"))
