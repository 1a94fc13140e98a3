"""A bounded, seeded sample of labelled documents as hashed features, gathered in one training task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import col, draw_key, least_draws
from weftline.llm.textbytes import parts, texts

Example = tuple[np.ndarray, np.ndarray, float]


def sampled(docs: DataFrame, labels: DataFrame, label: Column, limit: int, seed: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, draw, label, text)`` of at most ``limit`` labelled ids, those with the least draw keys.

    Labels that are null count for nothing; several of one id are averaged.
    The ids are bounded by ``limit``, so they are broadcast and texts are not shuffled.
    """
    chosen = (
        labels.select(col(id_col).cast("long").alias("k"), label.cast("double").alias("label")).dropna()
        .groupBy("k").agg(F.avg("label").alias("label"))
        .withColumn("draw", draw_key(seed, F.col("k")))
    )
    chosen = least_draws(chosen, limit)
    rows = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).cast("string").alias("text"))
    return rows.join(F.broadcast(chosen), F.col("doc_id") == F.col("k")).select("doc_id", "draw", "label", "text")


def train(sample: DataFrame, features: Callable[[bytes], tuple[np.ndarray, np.ndarray]], fit: Callable[[list[Example]], dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    """Features are made where the texts are; one task then fits a model of fixed size, which comes back as arrays.

    Examples come in the order of their draw keys whatever the partitions, and
    rows that repeat an id count once, so a rerun gives the same model.
    """
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            got = [features(x) for x in texts(b.column(3))]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array([x[0].astype(np.uint32).tobytes() for x in got], pa.binary()), pa.array([x[1].astype(np.float32).tobytes() for x in got], pa.binary())],
                ["doc_id", "draw", "label", "at", "x"],
            )

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Example] = {}
        for b in parts(batches):
            for draw, y, at, x in zip(*(b.column(k).to_pylist() for k in (1, 2, 3, 4)), strict=True):
                if draw not in seen or (at, x) < (seen[draw][0].astype(np.uint32).tobytes(), seen[draw][1].tobytes()):
                    ids = np.frombuffer(at, np.uint32)
                    # Half the room where buckets are few.
                    seen[draw] = (ids.astype(np.uint16) if ids.max(initial=0) < 1 << 16 else ids, np.frombuffer(x, np.float32), y)
        model = fit([seen[k] for k in sorted(seen)])
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(model)), pa.array([str(v.dtype) for v in model.values()]), pa.array([v.tobytes() for v in model.values()], pa.binary())],
            ["name", "kind", "data"],
        )

    encoded = sample.mapInArrow(encode, "doc_id long, draw string, label double, at binary, x binary")
    rows = encoded.repartition(1).mapInArrow(learn, "name string, kind string, data binary").collect()
    return {r["name"]: np.frombuffer(bytes(r["data"]), r["kind"]) for r in rows}
