"""Subword encoding with a given SentencePiece model; optional, and never trained here."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F


def _load(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def encoder(path: str):
    """A column function from text to ids; the model is loaded once a task."""

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = _load(path)
        for b in batches:
            yield pd.Series(model.encode(b.fillna("").tolist(), out_type=int), index=b.index)

    return encode


def decoder(path: str):
    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = _load(path)
        for b in batches:
            yield pd.Series([model.decode([int(i) for i in x]) if x is not None else None for x in b], index=b.index)

    return decode
