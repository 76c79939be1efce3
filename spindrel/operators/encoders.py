"""Texts to token vectors by a pluggable encoder, and the pooling of token vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import hashed_token_vectors, tokens


def encode_texts(df: DataFrame, load: Callable[[], Callable[[list[str]], list[np.ndarray]]], key: str = "doc_id", text: str = "text", batch: int = 256) -> DataFrame:
    """(doc_id, flat): the token vectors that a model gives for each text.

    ``load`` is called once per task and returns a function from texts to (tokens, dim) arrays. A null text is an empty one.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for frame in batches:
            for start in range(0, len(frame), batch):
                part = frame.iloc[start : start + batch]
                yield pd.DataFrame({"doc_id": part["k"], "flat": [np.asarray(x, np.float32).ravel() for x in model([t or "" for t in part["t"]])]})

    return df.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).mapInPandas(run, "doc_id long, flat array<float>")


def demonstration_vectors(df: DataFrame, dim: int, key: str = "doc_id", text: str = "text", most: int = 32) -> DataFrame:
    """(doc_id, flat): fixed pseudo-random vectors of a text's first ``most`` tokens, where no model is at hand."""
    return df.select(F.col(key).cast("long").alias("doc_id"), F.flatten(hashed_token_vectors(F.slice(tokens(text), 1, most), dim)).cast("array<float>").alias("flat"))


def pooled(docs: DataFrame, dim: int, factor: int = 2) -> DataFrame:
    """(doc_id, flat): documents with about one vector for every ``factor``, the means of like tokens.

    The two most similar groups (cosine of their means) are joined until few enough are left. The first token is kept apart.
    """

    def pool(x: np.ndarray) -> np.ndarray:
        if len(x) <= 2:
            return x
        head, sums, counts = x[:1], x[1:].copy(), np.ones(len(x) - 1)
        unit = lambda v: v / np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), 1e-12)
        sim = unit(sums) @ unit(sums).T
        np.fill_diagonal(sim, -np.inf)
        alive = np.ones(len(sums), bool)
        for _ in range(len(sums) - max(1, len(sums) // factor)):
            a, b = sorted(divmod(int(np.argmax(sim)), len(sums)))
            sums[a] += sums[b]
            counts[a] += counts[b]
            alive[b] = False
            sim[b, :] = sim[:, b] = -np.inf
            row = np.where(alive, unit(sums) @ unit(sums[a]), -np.inf)
            row[a] = -np.inf
            sim[a, :] = sim[:, a] = row
        return np.concatenate([head, sums[alive] / counts[alive, None]])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            yield pd.DataFrame({"doc_id": frame["doc_id"], "flat": [None if x is None else pool(np.asarray(x, np.float64).reshape(-1, dim)).ravel() for x in frame["flat"]]})

    return docs.select(F.col("doc_id").cast("long"), "flat").mapInPandas(run, "doc_id long, flat array<double>")
