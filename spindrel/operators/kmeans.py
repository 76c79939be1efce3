"""K-means codebooks, and the assignment of vectors to their nearest centroid.

A step sends the centroids, a checked number of bytes, to the tasks and gets partial sums per centroid back, so a
round moves a codebook per task and no vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut
from ..plans.ranks import ranked
from .maxsim import collect_matrix

#: Tokens at most that the generator's shuffle draws.
SHUFFLED = 1 << 20

#: Rows whose distances are computed at a time.
ROWS = 2048


def partition_count(documents: int, mean_length: float) -> int:
    """Partitions of an index: the power of two below 16 times the root of the tokens."""
    tokens = mean_length * documents
    return 2 ** math.floor(math.log2(16 * math.sqrt(tokens))) if tokens > 0 else 1


def sample_size(documents: int) -> int:
    """Documents that train a codebook."""
    return min(1 + int(16 * math.sqrt(120 * documents)), documents)


def holdout_size(tokens: int) -> int:
    """Sampled tokens that are held out for the codec: 5 %, 50 000 at most."""
    return round(min(0.05 * tokens, 50_000))


def default_centroids(tokens: int) -> int:
    return max(1, min(512, tokens // 10))


def lcg_order(n: int, k: int, state: int = 123456789) -> np.ndarray:
    """The first k places of a partial shuffle of 0..n-1 by a 64-bit linear congruential generator."""
    moved: dict[int, int] = {}
    out = np.empty(min(k, n), np.int64)
    for i in range(len(out)):
        state = (state * 1664525 + 1013904223) % (1 << 64)
        j = i + state % (n - i)
        out[i] = moved.get(j, j)
        moved[j] = moved.get(i, i)
    return out


def training_sample(tokens: DataFrame, centroids: int, per: int = 256, key: str = "t", n: int | None = None) -> DataFrame:
    """(t, vec) in training order: all tokens, or ``per`` of them per centroid where there are more.

    Samples of up to SHUFFLED tokens are drawn by the generator's shuffle, larger ones by a hash, which needs no order.
    """
    n = n if n is not None else tokens.count()
    if n <= per * centroids:
        return tokens.select(F.col(key).alias("t"), "vec")
    if per * centroids > SHUFFLED:
        share = per * centroids / n
        return tokens.where(F.pmod(F.xxhash64(key), F.lit(1 << 31)) < int(share * (1 << 31))).select(F.col(key).alias("t"), "vec")
    chosen = lcg_order(n, per * centroids)
    order = tokens.sparkSession.createDataFrame([(int(x), i) for i, x in enumerate(chosen)], "place long, t long")
    place = ranked(tokens.select(F.col(key).alias("key"), "vec"), ["key"], into="place")
    return place.join(order, "place").select("t", "vec")


def evenly_spaced(tokens: DataFrame, centroids: int, key: str = "t", n: int | None = None) -> DataFrame:
    """(cid, vec): the start of training, the tokens at places floor(cid * n / centroids) of the order by ``key``."""
    n = n if n is not None else tokens.count()
    places = [(c, min(c * n // centroids, n - 1)) for c in range(centroids)] if n else []
    wanted = tokens.sparkSession.createDataFrame(places, "cid long, rank0 long")
    return ranked(tokens.select(F.col(key).alias("t"), "vec"), ["t"]).join(F.broadcast(wanted), "rank0").select("cid", F.col("vec").cast("array<double>").alias("vec"))


def _nearest(x: np.ndarray, matrix: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """The column and value of the nearest row of the matrix; the first of equals. Values are rounded, so that equal ones are equal."""
    best, value = np.empty(len(x), np.int64), np.empty(len(x))
    for start in range(0, len(x), ROWS):
        part = x[start : start + ROWS]
        dots = part @ matrix.T
        if metric == "dot":
            score = np.round(dots, 9)
            best[start : start + ROWS] = score.argmax(1)
            value[start : start + ROWS] = score.max(1)
        else:
            # candidates by the expanded square; those near the least again by differences, which are exact where it counts
            rough = (part * part).sum(1)[:, None] - 2 * dots + (matrix * matrix).sum(1)[None, :]
            close = rough <= rough.min(1)[:, None] + 1e-6
            rows, cols = np.nonzero(close)
            exact = np.round(((part[rows] - matrix[cols]) ** 2).sum(1), 9)
            order = np.lexsort((cols, exact, rows))
            first = order[np.searchsorted(rows[order], np.arange(len(part)))]
            best[start : start + ROWS] = cols[first]
            value[start : start + ROWS] = exact[first]
    return best, value


def assigned(tokens: DataFrame, centroids: DataFrame, metric: str = "l2", keep: list[str] | None = None, codebook: tuple | None = None) -> DataFrame:
    """The columns ``keep`` (all by default) with ``cid``, the nearest centroid, and ``near``, its squared distance or dot product.

    Equal ones go to the smaller id. Rows with a null vector have none.
    """
    keep = keep if keep is not None else tokens.columns
    ids, matrix = codebook or collect_matrix(centroids, "cid")
    shared = tokens.sparkSession.sparkContext.broadcast((ids, matrix))
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.select(*keep).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            best, value = _nearest(x, matrix, metric)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(ids[best]), pa.array(value)], names=[*keep, "cid", "near"])

    narrow = tokens.where(F.col("vec").isNotNull()).select(F.col("vec").cast("array<double>").alias("__x"), *keep)
    return narrow.mapInArrow(run, f"{out}, cid long, near double")


def lloyd_step(tokens: DataFrame, codebook: tuple[np.ndarray, np.ndarray], empty: str = "keep") -> tuple[np.ndarray, np.ndarray]:
    """One round: assign by squared distance, then the mean of each centroid's vectors.

    A centroid without vectors stays (``keep``) or becomes zero (``zero``).
    """
    ids, matrix = codebook
    shared = tokens.sparkSession.sparkContext.broadcast(codebook)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix = shared.value
        sums, counts = np.zeros_like(matrix), np.zeros(len(ids), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            best, _ = _nearest(x, matrix, "l2")
            np.add.at(sums, best, x)
            counts += np.bincount(best, minlength=len(ids))
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used]), pa.array(list(sums[used]), pa.list_(pa.float64()))], names=["row", "n", "s"])

    parts = tokens.where(F.col("vec").isNotNull()).select(F.col("vec").cast("array<double>").alias("x")).mapInArrow(run, "row long, n long, s array<double>")
    dim = matrix.shape[1] if len(matrix) else 0
    summed = parts.groupBy("row").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("s")[d]) for d in range(dim))).alias("s")).toArrow()  # a row per centroid
    out = matrix.copy() if empty == "keep" else np.zeros_like(matrix)
    if summed.num_rows:
        rows = summed.column("row").to_numpy()
        out[rows] = np.array(summed.column("s").to_pylist(), float) / summed.column("n").to_numpy()[:, None]
    return ids, out


def codebook_frame(spark, codebook: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(cid, vec) of a codebook."""
    ids, matrix = codebook
    return spark.createDataFrame(pa.table({"cid": pa.array(ids, pa.int64()), "vec": pa.array(list(matrix), pa.list_(pa.float64()))}))


def train(tokens: DataFrame, centroids: int, rounds: int = 5, key: str = "t", empty: str = "keep", normalise: bool = False, per: int = 256) -> DataFrame:
    """(cid, vec): a codebook after so many rounds from evenly spaced tokens of the training sample, ``per`` tokens a centroid at most."""
    n = tokens.count()
    sample = training_sample(tokens, centroids, per, key, n)
    sample = cut(sample, "sample")
    codebook = collect_matrix(evenly_spaced(sample, centroids), "cid")
    for _ in range(rounds):
        codebook = lloyd_step(sample, codebook, empty)
    if normalise:
        codebook = codebook[0], codebook[1] / np.maximum(np.linalg.norm(codebook[1], axis=1, keepdims=True), 1e-12)
    return codebook_frame(tokens.sparkSession, codebook)
