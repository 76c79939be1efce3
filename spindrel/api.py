"""The engine for callers with arrays and lists in memory: an index class, metadata by path, metrics, and MaxSim kernels.

Everything here wraps the DataFrame operators; use those for collections that don't fit in memory.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import corpus, evaluation
from .operators import metadata as meta
from .operators.index import VectorIndex
from .operators.kmeans import collect_matrix, partition_count, sample_size, train
from .plans.store import Store
from .session import ship


class Retriever:
    """An index in a folder, for lists of (tokens, dim) arrays. Positions are counted from 0."""

    def __init__(self, index: str, spark: SparkSession | None = None):
        self.spark = ship(spark or SparkSession.builder.getOrCreate())
        self.path = index
        self.index = VectorIndex(self.spark, index)

    def create(self, documents_embeddings: Iterable, kmeans_niters: int = 4, max_points_per_centroid: int = 256, nbits: int = 4, n_samples_kmeans: int | None = None, seed: int = 42, metadata: Sequence[dict] | None = None) -> Retriever:
        """Build the index. The sample for training is the first documents, so ``seed`` has no effect."""
        documents = list(documents_embeddings)
        dim = np.asarray(documents[0]).shape[-1]
        self.index = VectorIndex(self.spark, self.path, dim)
        samples = n_samples_kmeans or sample_size(len(documents))
        self.index.create(corpus.from_arrays(self.spark, documents), kmeans_niters, nbits, codec="plain", metadata=metadata, per=max_points_per_centroid, samples=samples)
        return self

    def update(self, documents_embeddings: Iterable, metadata: Sequence[dict] | None = None) -> Retriever:
        """Add documents with the codec as it is."""
        first = self.index.store.table("docs").agg(F.max("doc_id")).first()[0]
        self.index.update(corpus.from_arrays(self.spark, documents_embeddings, 0 if first is None else first + 1), metadata)
        return self

    def delete(self, subset: int | list[int]) -> Retriever:
        """Remove documents by position; the rest are numbered anew."""
        self.index.delete(subset)
        return self

    def search(self, queries_embeddings: Iterable, top_k: int = 10, n_full_scores: int = 4096, n_ivf_probe: int = 8, subset=None, batch_size: int | None = None, legacy_empty_subset: bool = False) -> list[list[tuple[int, float]]]:
        """Per query the best (position, score). An empty subset admits nothing, unless ``legacy_empty_subset``; batches are Spark's."""
        if legacy_empty_subset and isinstance(subset, list) and not subset:
            subset = None
        queries = list(queries_embeddings)
        rows = self.index.search(corpus.queries_from_arrays(self.spark, queries), top_k, n_full_scores, n_ivf_probe, subset).orderBy("query_id", "rank").collect()
        out: list[list[tuple[int, float]]] = [[] for _ in queries]
        for r in rows:
            out[r["query_id"]].append((r["doc_idx"], r["score"]))
        return out


def compute_kmeans(spark: SparkSession, documents_embeddings: Iterable, kmeans_niters: int = 4, max_points_per_centroid: int = 256, n_samples_kmeans: int | None = None, num_partitions: int | None = None) -> np.ndarray:
    """Unit centroids of documents in memory."""
    documents = [np.asarray(x) for x in documents_embeddings]
    used = documents[: n_samples_kmeans or sample_size(len(documents))]
    dim = used[0].shape[-1]
    tokens = corpus.unpacked(corpus.from_arrays(spark, used), dim).select((F.col("doc_id") * (1 << 20) + F.col("pos")).alias("t"), "vec")
    total = sum(len(x) for x in used)
    k = min(num_partitions or partition_count(len(documents), total / len(used)), total)
    return collect_matrix(train(tokens, k, kmeans_niters, normalise=True, per=max_points_per_centroid), "cid")[1]


# metadata by path


def _metadata(spark: SparkSession, index: str):
    return Store(spark, index).table("metadata")


def metadata_create(spark: SparkSession, index: str, metadata: Sequence[dict]) -> int:
    """Write metadata in place of any before; returns the number of rows."""
    Store(spark, index).commit(replace={"metadata": meta.from_rows(spark, metadata)})
    return len(metadata)


def metadata_update(spark: SparkSession, index: str, metadata: Sequence[dict]) -> int:
    Store(spark, index).commit(replace={"metadata": meta.appended(_metadata(spark, index), metadata)})
    return len(metadata)


def metadata_delete(spark: SparkSession, index: str, subset: int | list[int]) -> int:
    current = _metadata(spark, index)
    left = meta.deleted(current, subset)
    n = current.count()
    Store(spark, index).commit(replace={"metadata": left})
    return n - _metadata(spark, index).count()


def metadata_get(spark: SparkSession, index: str, condition: str | None = None, parameters: Sequence = (), subset: int | list[int] | None = None) -> list[dict]:
    return [r.asDict() for r in meta.get(_metadata(spark, index), condition, parameters, subset).collect()]


def metadata_where(spark: SparkSession, index: str, condition: str, parameters: Sequence = ()) -> list[int]:
    return [r[0] for r in meta.where(_metadata(spark, index), condition, parameters).collect()]


# evaluation


def add_duplicates(queries: Sequence[str], scores: Sequence[list]) -> list[list]:
    """Results of the distinct queries (in the order they first occur) for every query, repeated ones included."""
    place = {q: i for i, q in enumerate(dict.fromkeys(queries))}
    return [scores[place[q]] for q in queries]


def evaluate(spark: SparkSession, scores: Sequence[Sequence[tuple]], qrels: dict[str, dict], queries: Sequence[str], metrics: Sequence[str] = evaluation.DEFAULT) -> dict[str, float]:
    """Metrics of result lists (document, score) per query against judgements {query: {document: relevance}}."""
    if len(scores) < len(queries):
        scores = add_duplicates(queries, scores)
    run = [(q, str(d), float(s)) for q, found in zip(queries, scores) for d, s in found]
    marks = [(q, str(d), int(r)) for q, docs in qrels.items() for d, r in docs.items()]
    frames = spark.createDataFrame(run, "query string, doc_id string, score double"), spark.createDataFrame(marks, "query string, doc_id string, rel int")
    return {r["metric"]: r["value"] for r in evaluation.evaluate(*frames, metrics).collect()}


# kernels over arrays


def _matrix(x, dim: int | None) -> np.ndarray:
    x = np.asarray(x, np.float64)
    if x.ndim == 2:
        return x
    if dim is None or x.size % dim:
        raise ValueError("a flat array needs a dimension that divides its length")
    return x.reshape(-1, dim)


def maxsim(query, document, dim: int | None = None, normalised: bool = False) -> float:
    """MaxSim of two arrays (2-D, or flat with ``dim``); 0 if one is empty. ``normalised``: the mean over query tokens."""
    q, d = _matrix(query, dim), _matrix(document, dim)
    if not len(q) or not len(d):
        return 0.0
    best = (q @ d.T).max(1)
    return float(best.mean() if normalised else best.sum())


def maxsim_batch(query, documents: Sequence, dim: int | None = None, normalised: bool = False) -> list[float]:
    """MaxSim of a query with each document, in their order."""
    return [maxsim(query, d, dim, normalised) for d in documents]


def maxsim_batch_flat(query, flat, lengths: Sequence[int], dim: int, normalised: bool = False) -> list[float]:
    """The same for documents one after the other in a flat array, of so many tokens each."""
    flat = np.asarray(flat, np.float64)
    if sum(lengths) * dim != flat.size:
        raise ValueError("the lengths don't add up to the array")
    ends = np.cumsum(lengths) * dim
    return [maxsim(query, flat[e - n * dim : e], dim, normalised) for e, n in zip(ends, lengths)]


class Preloaded:
    """Documents in memory for many queries."""

    def __init__(self, documents: Sequence, dim: int | None = None):
        self.documents = [_matrix(d, dim) for d in documents]

    def search(self, query, normalised: bool = False) -> list[float]:
        """Scores of all documents, in their order."""
        return maxsim_batch(query, self.documents, self.documents[0].shape[1] if self.documents else None, normalised)

    def __len__(self) -> int:
        return len(self.documents)
