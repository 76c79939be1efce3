"""MaxSim: for every query token the largest dot product with a document's tokens, summed or averaged over the query.

Documents are scored in Arrow batches by one matrix product a batch. The query set is stated by the caller and travels
with the tasks up to a checked size; a larger one is cut into blocks, each of which reads the documents once more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of query vectors that travel with a task, and of a stated query set in all.
QUERY_BYTES, QUERY_TOTAL = 64 << 20, 1 << 30

#: Cells (document tokens x query tokens) that are multiplied at a time.
CELLS = 1 << 23


class QueryBlock:
    """Some queries: their tokens one after the other, and where each begins."""

    def __init__(self, ids: list[int], lengths: list[int], vectors: np.ndarray):
        self.ids, self.lengths, self.vectors = np.array(ids, np.int64), np.array(lengths), vectors
        self.starts = np.cumsum(self.lengths) - self.lengths


def query_blocks(queries: DataFrame) -> list[QueryBlock]:
    """The stated query set in blocks of QUERY_BYTES at most. Queries without tokens have none."""
    rows = queries.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("qpos", "vec"))).alias("t")).orderBy("query_id")
    blocks, ids, lengths, parts, size = [], [], [], [], 0
    for row in rows.toLocalIterator(prefetchPartitions=True):
        x = np.array([t["vec"] for t in row["t"]], np.float64)
        if size and size + x.nbytes > QUERY_BYTES:
            blocks.append(QueryBlock(ids, lengths, np.concatenate(parts)))
            ids, lengths, parts, size = [], [], [], 0
        if len(blocks) * QUERY_BYTES > QUERY_TOTAL:
            raise ValueError(f"a query set has {QUERY_TOTAL >> 20} MB of vectors at most; search in parts")
        ids.append(row["query_id"])
        lengths.append(len(x))
        parts.append(x)
        size += x.nbytes
    if ids:
        blocks.append(QueryBlock(ids, lengths, np.concatenate(parts)))
    return blocks


def score_batch(starts: np.ndarray, tokens: np.ndarray, block: QueryBlock, average: bool = False) -> np.ndarray:
    """Scores (documents x queries) of documents whose tokens begin at ``starts``; none of them is empty."""
    out = np.empty((len(starts), len(block.ids)))
    ends = np.append(starts[1:], len(tokens))
    step = max(1, CELLS // max(1, len(block.vectors)))
    first = 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + step, "right")))
        dots = tokens[starts[first] : ends[last - 1]] @ block.vectors.T
        best = np.maximum.reduceat(dots, starts[first:last] - starts[first], axis=0)
        out[first:last] = np.add.reduceat(best, block.starts, axis=1)
        first = last
    return out / block.lengths if average else out


def _scored(docs: DataFrame, block: QueryBlock, dim: int, keep: int | None, average: bool, empty_zero: bool) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        for batch in batches:
            lists = batch.column(1)
            n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False) // dim
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            has = n > 0
            scores = np.zeros((len(ids), len(block.ids)))
            if has.any():
                lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
                flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                if (lengths % dim).any():
                    within = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                    flat = flat[within < np.repeat(n * dim, lengths)]
                tokens = flat.reshape(-1, dim)
                scores[has] = score_batch((np.cumsum(n) - n)[has], tokens, block, average)
            scores = np.round(scores, 6)
            usable = (np.ones(len(ids), bool) if empty_zero else has) & ~np.isnan(scores).any(1)
            ids, scores = ids[usable], scores[usable]
            if keep and len(ids) > keep:
                # what isn't among the best of its batch isn't among the best of all
                order = np.stack([np.lexsort((ids, -scores[:, j]))[:keep] for j in range(len(block.ids))], 1)
                q = np.tile(np.arange(len(block.ids)), keep)
                rows = order.ravel()
            else:
                rows, q = np.repeat(np.arange(len(ids)), len(block.ids)), np.tile(np.arange(len(block.ids)), len(ids))
            yield pa.RecordBatch.from_arrays([pa.array(block.ids[q]), pa.array(ids[rows]), pa.array(scores[rows, q])], names=["query_id", "doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("flat")).mapInArrow(run, "query_id long, doc_id long, score double")


def scores(docs: DataFrame, queries: DataFrame, dim: int, average: bool = False, empty_zero: bool = False, keep: int | None = None) -> DataFrame:
    """(query_id, doc_id, score): MaxSim of every query and document, rounded to 6 decimals.

    ``average``: the mean over the query's tokens in place of the sum. ``empty_zero``: documents without tokens score 0;
    else they have no rows. Documents with NaN have none. ``keep``: at most so many of the best of each batch.
    Without queries or documents there are no rows.
    """
    parts = [_scored(docs, block, dim, keep, average, empty_zero) for block in query_blocks(queries)]
    if not parts:
        return docs.sparkSession.createDataFrame([], "query_id long, doc_id long, score double")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def best(scored: DataFrame, k: int, by: str = "score", key: str = "doc_id") -> DataFrame:
    """Adds ``rank`` and keeps the k best rows of every query; equal scores go to the smaller document."""
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(by), F.asc(key))))
    return ranked.where(F.col("rank") <= k)


def search_exact(docs: DataFrame, queries: DataFrame, dim: int, k: int = 10, average: bool = False) -> DataFrame:
    """(query_id, rank, doc_id, score): the k best documents of every query by brute force."""
    return best(scores(docs, queries, dim, average, keep=k), k).select("query_id", "rank", "doc_id", "score")


def similarity_matrix(tokens: DataFrame, axes: DataFrame, key: str = "cid") -> DataFrame:
    """(query_id, qpos, key, score): dot products of query tokens with every row (key, vec) of ``axes``, a bounded set such as centroids."""
    ids, matrix = collect_matrix(axes, key)
    shared = tokens.sparkSession.sparkContext.broadcast((ids, matrix))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
            dots = np.round(x @ matrix.T, 6)
            rows = pa.array(np.repeat(np.arange(len(x)), len(ids)), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(np.tile(ids, len(x))), pa.array(dots.ravel())], names=["query_id", "qpos", key, "score"])

    return tokens.select(F.col("query_id").cast("long"), F.col("qpos").cast("long"), "vec").mapInArrow(run, f"query_id long, qpos long, {key} long, score double")


def nearest_axes(tokens: DataFrame, axes: DataFrame, k: int, key: str = "cid") -> DataFrame:
    """(query_id, qpos, key, score): of every query token the ``k`` rows of ``axes`` with the largest dot products, rounded to 6 decimals; equal ones by the smaller id. Only these rows leave the task."""
    ids, matrix = collect_matrix(axes, key)
    shared = tokens.sparkSession.sparkContext.broadcast((ids, matrix))
    k = min(k, len(ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix = shared.value
        for batch in batches:
            x = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
            step = max(1, CELLS // max(1, len(ids)))
            for start in range(0, batch.num_rows if k else 0, step):
                dots = np.round(x[start : start + step] @ matrix.T, 6)
                order = np.rint(dots * 1e6).astype(np.int64) * len(ids) - np.arange(len(ids))  # no two are equal
                top = np.argpartition(-order, k - 1, axis=1)[:, :k]
                rows = pa.array(np.repeat(np.arange(start, start + len(dots)), k), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(ids[top.ravel()]), pa.array(np.take_along_axis(dots, top, 1).ravel())], names=["query_id", "qpos", key, "score"])

    return tokens.select(F.col("query_id").cast("long"), F.col("qpos").cast("long"), "vec").mapInArrow(run, f"query_id long, qpos long, {key} long, score double")


#: Bytes of a codebook that travel with a task.
MATRIX_BYTES = 256 << 20


def collect_matrix(axes: DataFrame, key: str, vec: str = "vec") -> tuple[np.ndarray, np.ndarray]:
    """A codebook as ids and a matrix, in the order of the ids, after a check of its size."""
    head = axes.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(vec)).alias("d")).first()
    if (head["n"] or 0) * (head["d"] or 0) * 8 > MATRIX_BYTES:
        raise ValueError(f"the codebook has {head['n']} vectors; {MATRIX_BYTES >> 20} MB may travel with a task")
    rows = axes.select(F.col(key).cast("long").alias("k"), F.col(vec).cast("array<double>").alias("v")).orderBy("k").toArrow()
    ids = rows.column("k").to_numpy()
    return ids, np.array(rows.column("v").to_pylist(), np.float64).reshape(len(ids), -1)
