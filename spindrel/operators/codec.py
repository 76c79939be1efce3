"""Residual codecs: training, encoding and decoding.

Two codecs share the arithmetic. The *centred* one (4 bits) takes a signed mean residual off, buckets all dimensions by
the same cutoffs and decodes by a weight per bucket and dimension. The *plain* one (1, 2, 4 or 8 bits) buckets the bare
residual by its quantiles and decodes by one weight per bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bits import pack_fields, unpack_fields
from ..plans.lineage import cut
from ..plans.ranks import ranked
from .kmeans import assigned
from .maxsim import collect_matrix

BUCKETS = 16


@dataclass
class Codec:
    """A codebook with what it takes to encode residuals. ``weights`` is (buckets, dim) or (buckets,)."""

    centroids: np.ndarray
    cutoffs: np.ndarray
    weights: np.ndarray
    average: np.ndarray
    bits: int = 4
    layout: str = "nibbles"
    ids: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def __post_init__(self):
        if not len(self.ids):
            self.ids = np.arange(len(self.centroids))

    def pack(self, levels: np.ndarray) -> np.ndarray:
        if self.layout == "nibbles":
            if levels.shape[1] % 2:
                levels = np.pad(levels, ((0, 0), (0, 1)))
            return (levels[:, ::2] << 4 | levels[:, 1::2]).astype(np.uint8)
        return pack_fields(levels, self.bits)

    def unpack(self, packed: np.ndarray) -> np.ndarray:
        dim = self.centroids.shape[1]
        if self.layout == "nibbles":
            return np.stack([packed >> 4, packed & 15], 2).reshape(len(packed), -1)[:, :dim].astype(np.int64)
        return unpack_fields(packed, self.bits, dim)

    def levels(self, vectors: np.ndarray, codes: np.ndarray) -> np.ndarray:
        residual = np.round(vectors - self.centroids[codes] - self.average, 9)
        return np.searchsorted(self.cutoffs, residual, side="right")

    def decode(self, codes: np.ndarray, levels: np.ndarray, normalise: bool = True) -> np.ndarray:
        spread = self.weights[levels, np.arange(levels.shape[1])[None, :]] if self.weights.ndim == 2 else self.weights[levels]
        x = self.centroids[codes] + self.average + spread
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12) if normalise else x


def _residual_rows(tokens: DataFrame, centroids: DataFrame) -> DataFrame:
    book = centroids.select("cid", F.col("vec").cast("array<double>").alias("c"))
    return tokens.join(F.broadcast(book), "cid").select("t", F.posexplode(F.zip_with(F.col("vec").cast("array<double>"), "c", lambda x, c: x - c)).alias("d", "r"))


def residuals(tokens: DataFrame, centroids: DataFrame, average: np.ndarray | None = None) -> DataFrame:
    """(t, d, r): the residuals of tokens (t, cid, vec) by dimension, centred by ``average`` if given, rounded to 9 decimals."""
    rows = _residual_rows(tokens, centroids)
    if average is None:
        return rows.select("t", "d", F.round("r", 9).alias("r"))
    mean = F.array(*(F.lit(float(a)) for a in average))
    return rows.select("t", "d", F.round(F.col("r") - mean[F.col("d")], 9).alias("r"))


def average_residual(tokens: DataFrame, centroids: DataFrame, absolute: bool = False) -> DataFrame:
    """(d, avg): the mean residual by dimension, signed or absolute, rounded to 9 decimals."""
    value = F.abs("r") if absolute else F.col("r")
    return _residual_rows(tokens, centroids).groupBy("d").agg(F.round(F.avg(value), 9).alias("avg"))


def bucket_weights(centred: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(d, bucket, weight): means of the slices of each dimension's sorted residuals (t, d, r); 0 for an empty slice.

    A residual of place k among n is in bucket floor((buckets * (k + 1) - 1) / n), the slice of equal shares. Places come
    from a sort by range, so that a dimension with all tokens isn't one task's.
    """
    placed = ranked(centred, ["r", "t"], group=["d"])
    n = placed.groupBy("d").agg(F.count(F.lit(1)).alias("n"))
    sliced = placed.join(F.broadcast(n), "d").groupBy("d", F.expr(f"({buckets} * (rank0 + 1) - 1) div n").cast("int").alias("bucket")).agg(F.round(F.avg("r"), 9).alias("weight"))
    every = n.select("d", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"))
    return every.join(sliced, ["d", "bucket"], "left").select("d", "bucket", F.coalesce("weight", F.lit(0.0)).alias("weight"))


def bucket_cutoffs(weights: DataFrame) -> DataFrame:
    """(i, cutoff): the inner cutoffs, midpoints of neighbouring buckets' weights averaged over dimensions, to 9 decimals."""
    mean = weights.groupBy("bucket").agg(F.avg("weight").alias("w"))
    following = F.lead("w").over(Window.orderBy("bucket"))  # a row per bucket
    return mean.select((F.col("bucket") + 1).alias("i"), F.round((F.col("w") + following) / 2, 9).alias("cutoff")).where("cutoff is not null")


def train_centred(tokens: DataFrame, centroids: DataFrame) -> Codec:
    """The 4-bit codec of all tokens (t, vec): signed mean residual, weights per bucket and dimension, cutoffs."""
    coded = cut(assigned(tokens, centroids, keep=["t", "vec"]).drop("near"), "coded")
    ids, matrix = collect_matrix(centroids, "cid")
    dim = matrix.shape[1]
    mean = {r["d"]: r["avg"] for r in average_residual(coded, centroids).collect()}  # a row per dimension
    average = np.array([mean.get(d, 0.0) for d in range(dim)])
    table = cut(bucket_weights(residuals(coded, centroids, average)), "weights")
    weights = np.zeros((BUCKETS, dim))
    for r in table.collect():  # a row per bucket and dimension
        weights[r["bucket"], r["d"]] = r["weight"]
    cutoffs = np.array([r["cutoff"] for r in bucket_cutoffs(table).orderBy("i").collect()])
    return Codec(matrix, cutoffs, weights, average, ids=ids)


def train_plain(tokens: DataFrame, centroids: DataFrame, bits: int = 4, accuracy: int = 1_000_000) -> Codec:
    """The codec of pooled residuals: cutoffs at their quantiles i/2^bits, weights at (i + 0.5)/2^bits, codes by dot product.

    ``tokens`` are those held out for it. Quantiles are of a mergeable summary whose error is 1/accuracy of the ranks.
    """
    if bits not in (1, 2, 4, 8):
        raise ValueError("bits must be 1, 2, 4 or 8")
    coded = assigned(tokens, centroids, metric="dot", keep=["t", "vec"])
    buckets = 2**bits
    at = [i / buckets for i in range(1, buckets)] + [(i + 0.5) / buckets for i in range(buckets)]
    found = residuals(coded, centroids).agg(F.percentile_approx("r", [float(x) for x in at], accuracy).alias("q")).first()["q"]
    ids, matrix = collect_matrix(centroids, "cid")
    if found is None:
        found = [0.0] * len(at)
    return Codec(matrix, np.array(found[: buckets - 1]), np.array(found[buckets - 1 :]), np.zeros(matrix.shape[1]), bits, "fields", ids)


def _flat(lists: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (n % dim).any():
        within = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
        flat = flat[within < np.repeat(n // dim * dim, n)]
    return n // dim, flat.reshape(-1, dim)


def encode(docs: DataFrame, codec: Codec, metric: str = "l2") -> DataFrame:
    """(doc_id, codes, residuals, n_tokens): documents (doc_id, flat) with the nearest centroid and packed residual of every token."""
    from .kmeans import _nearest

    shared = docs.sparkSession.sparkContext.broadcast(codec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared.value
        for batch in batches:
            n, x = _flat(batch.column(1), codec.centroids.shape[1])
            rows, _ = _nearest(x, codec.centroids, metric) if len(x) else (np.zeros(0, np.int64), None)
            packed = codec.pack(codec.levels(x, rows)) if len(x) else np.zeros((0, 1), np.uint8)
            ends = np.concatenate([[0], np.cumsum(n)])
            raw = packed.tobytes()
            width = packed.shape[1]
            codes = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(codec.ids[rows].astype(np.int32)))
            blobs = pa.array([raw[a * width : b * width] for a, b in zip(ends, ends[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), codes, blobs, pa.array(n, pa.int32())], names=["doc_id", "codes", "residuals", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long"), "flat").mapInArrow(run, "doc_id long, codes array<int>, residuals binary, n_tokens int")


def decode(encoded: DataFrame, codec: Codec, normalise: bool = True) -> DataFrame:
    """(doc_id, flat): the documents that (doc_id, codes, residuals) stand for.

    Null codes or residuals, residuals of another length than the codes, and codes without a centroid give a null ``flat``.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(codec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared.value
        dim = codec.centroids.shape[1]
        width = codec.pack(np.zeros((1, dim), np.int64)).shape[1]
        order = np.argsort(codec.ids)
        for batch in batches:
            codes, blobs = batch.column(1), batch.column(2)
            n = pc.fill_null(pc.list_value_length(codes), -1).to_numpy(zero_copy_only=False)
            size = pc.fill_null(pc.binary_length(blobs), -1).to_numpy(zero_copy_only=False)
            flat = pc.fill_null(pc.cast(codes.flatten(), pa.int64()), -1).to_numpy(zero_copy_only=False)
            at = order[np.minimum(np.searchsorted(codec.ids, flat, sorter=order), len(order) - 1)]
            doc = np.repeat(np.arange(len(n)), np.maximum(n, 0))
            unknown = np.bincount(doc, codec.ids[at] != flat, minlength=len(n)) > 0
            good = (n >= 0) & (size == n * width) & ~unknown
            raw = b"".join(x for x, ok in zip(blobs.to_pylist(), good) if ok)
            x = codec.decode(at[good[doc]], codec.unpack(np.frombuffer(raw, np.uint8).reshape(-1, width)), normalise) if raw else np.zeros((0, dim))
            ends = np.concatenate([[0], np.cumsum(np.where(good, n, 0) * dim)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x.ravel()), mask=pa.array(~good))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["doc_id", "flat"])

    return encoded.select(F.col("doc_id").cast("long"), "codes", "residuals").mapInArrow(run, "doc_id long, flat array<double>")


def stored_codec(row_table: DataFrame, clusters: DataFrame) -> Codec:
    """The codec of a stored one-row table and the centroids of its clusters; a cluster's centroid is null in some rows."""
    row = row_table.first()
    book = clusters.where("centroid is not null").groupBy(F.col("cluster_id").alias("cid")).agg(F.min_by("centroid", "segment").alias("vec"))
    ids, matrix = collect_matrix(book, "cid")
    dim = row["embedding_dim"]
    return Codec(matrix, np.array(row["bucket_cutoffs"][1:-1], np.float64), np.array(row["bucket_weights"], np.float64).reshape(-1, dim), np.array(row["avg_residual"], np.float64), ids=ids)


def reconstruction_error(docs: DataFrame, decoded: DataFrame) -> DataFrame:
    """(doc_id, mse, cosine): mean squared error of all values, and the mean cosine of the whole buffers, to 6 decimals."""
    pair = docs.select("doc_id", F.col("flat").cast("array<double>").alias("x")).join(decoded.select("doc_id", F.col("flat").alias("y")), "doc_id").where("size(x) = size(y) and size(x) > 0")
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, e: s + e)
    mse = total(F.zip_with("x", "y", lambda a, b: (a - b) * (a - b))) / F.size("x")
    cosine = total(F.zip_with("x", "y", lambda a, b: a * b)) / F.sqrt(total(F.transform("x", lambda a: a * a)) * total(F.transform("y", lambda a: a * a)))
    return pair.select("doc_id", F.round(mse, 6).alias("mse"), F.round(cosine, 6).alias("cosine"))
