"""Search over encoded documents: the quantised search and the staged one."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut
from .codec import Codec, _flat, decode
from .ivf import candidates, probed
from .kmeans import codebook_frame
from .maxsim import QueryBlock, best, query_blocks, score_batch

#: Share of a query's candidates that is decoded at least. The rank by centroids says little of the exact one, so a fixed number loses more the more candidates there are.
SHARE = 0.9

#: Documents whose centroids are multiplied with the queries at a time.
PART = 512


@dataclass
class SearchParameters:
    """top_k results; ``probes`` clusters a query token; ``full_scores`` documents that approximate scores leave, of which a quarter is decoded, but ``share`` of a query's candidates at least."""

    top_k: int = 10
    probes: int = 8
    full_scores: int = 4096
    share: float = SHARE


def _asked(found: DataFrame, docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, ...) with ``asks``, the queries that want the document, by number; a document travels once."""
    wanted = found.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.array_sort(F.collect_set(F.col("query_id").cast("long"))).alias("asks"))
    return docs.join(wanted, "doc_id")


def _pairs(asks: pa.ListArray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, query): the asked pairs whose query is one of ``ids``, which ascend, as places in the batch and in ``ids``."""
    n = pc.list_value_length(asks).to_numpy(zero_copy_only=False)
    q = asks.flatten().to_numpy(zero_copy_only=False)
    place = np.minimum(np.searchsorted(ids, q), len(ids) - 1)
    here = ids[place] == q
    return np.repeat(np.arange(len(n)), n)[here], place[here]


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers starts[i], starts[i] + 1, ... of all ranges, one after the other."""
    return np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())


def pair_scores(starts: np.ndarray, ends: np.ndarray, tokens: np.ndarray, block: QueryBlock, row: np.ndarray, query: np.ndarray) -> np.ndarray:
    """MaxSim of the pairs (row, query), ordered by row, of documents tokens[starts[row] : ends[row]] that aren't empty.

    Only the tokens of queries that ask for a document are multiplied with it; where most of the batch's pairs are asked for, one product does for all.
    """
    if len(row) * 2 > len(starts) * len(block.ids):
        has = np.flatnonzero(ends > starts)
        return score_batch(starts[has], tokens, block)[np.searchsorted(has, row), query]
    out = np.empty(len(row))
    firsts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, np.int64)
    for first, last in zip(firsts, np.r_[firsts[1:], len(row)]):
        asked = query[first:last]
        lengths = block.lengths[asked]
        dots = tokens[starts[row[first]] : ends[row[first]]] @ block.vectors[_ranges(block.starts[asked], lengths)].T
        out[first:last] = np.add.reduceat(dots.max(0), np.cumsum(lengths) - lengths)
    return out


def _over_blocks(rows: DataFrame, queries: DataFrame, kernel, out: str) -> DataFrame:
    """``kernel(batch, block)`` over the batches of ``rows``, for every block of the query set."""
    parts = []
    for block in query_blocks(queries):
        shared = rows.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    yield kernel(batch, shared.value)

        parts.append(rows.mapInArrow(run, out))
    if not parts:
        return rows.sparkSession.createDataFrame([], out)
    return reduce(DataFrame.unionByName, parts)


def rescored(found: DataFrame, docs: DataFrame, queries: DataFrame, dim: int, average: bool = False) -> DataFrame:
    """(query_id, doc_id, score): exact MaxSim of the given pairs (query_id, doc_id) over packed documents.

    A document travels once, with the list of queries that want it, and is multiplied with these alone.
    """
    rows = _asked(found, docs.select(F.col("doc_id").cast("long"), "flat")).select("doc_id", "flat", "asks")

    def kernel(batch: pa.RecordBatch, block: QueryBlock) -> pa.RecordBatch:
        n, tokens = _flat(batch.column(1), dim)
        ends = np.cumsum(n)
        row, query = _pairs(batch.column(2), block.ids)
        row, query = row[n[row] > 0], query[n[row] > 0]
        scores = pair_scores(ends - n, ends, tokens, block, row, query)
        if average:
            scores = scores / block.lengths[query]
        return pa.RecordBatch.from_arrays([pa.array(block.ids[query]), batch.column(0).take(pa.array(row, pa.int64())), pa.array(np.round(scores, 6))], names=["query_id", "doc_id", "score"])

    return _over_blocks(rows, queries, kernel, "query_id long, doc_id long, score double")


def search_ivf(queries: DataFrame, docs: DataFrame, centroids: DataFrame, lists: DataFrame, dim: int, probes: int, k: int = 10, delta: DataFrame | None = None, subset: DataFrame | None = None) -> DataFrame:
    """(query_id, rank, doc_id, score): candidates of the probed clusters, scored exactly over packed documents."""
    found = candidates(probed(queries, centroids, probes), lists, delta, subset)
    return best(rescored(found, docs, queries, dim), k).select("query_id", "rank", "doc_id", "score")


def search_quantised(queries: DataFrame, encoded: DataFrame, codec: Codec, lists: DataFrame, probes: int, k: int = 10, delta: DataFrame | None = None, subset: DataFrame | None = None) -> DataFrame:
    """As ``search_ivf`` over encoded documents, of which only candidates are decoded; adds candidates_searched and num_clusters_probed."""
    centroids = codebook_frame(encoded.sparkSession, (codec.ids, codec.centroids))
    probes_ = cut(probed(queries, centroids, probes), "probes")
    found = cut(candidates(probes_, lists, delta, subset), "candidates")
    wanted = encoded.join(found.select("doc_id").distinct(), "doc_id", "left_semi")
    scored = rescored(found, decode(wanted, codec), queries, codec.centroids.shape[1])
    counts = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("candidates_searched"))
    cells = probes_.groupBy("query_id").agg(F.countDistinct("cid").alias("num_clusters_probed"))
    return best(scored, k).join(counts, "query_id").join(cells, "query_id").select("query_id", "rank", "doc_id", "score", "candidates_searched", "num_clusters_probed")


def approximate(found: DataFrame, coded: DataFrame, queries: DataFrame, codebook: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(query_id, doc_id, approx): MaxSim of the pairs with each document token replaced by its centroid.

    ``coded`` is (doc_id, codes), ``codebook`` ids and vectors. The centroids of a part of a batch are multiplied once
    with the block's query tokens; a pair then takes the largest of its document's codes for every token of its query.
    """
    shared = found.sparkSession.sparkContext.broadcast(codebook)
    rows = _asked(found, coded.select(F.col("doc_id").cast("long"), F.array_distinct("codes").cast("array<long>").alias("codes")).where("size(codes) > 0")).select("doc_id", "codes", "asks")

    def kernel(batch: pa.RecordBatch, block: QueryBlock) -> pa.RecordBatch:
        ids, matrix = shared.value
        row, query = _pairs(batch.column(2), block.ids)
        n = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
        ends = np.cumsum(n)
        codes = batch.column(1).flatten().to_numpy(zero_copy_only=False)
        approx = np.empty(len(row))
        for start in range(0, batch.num_rows, PART):
            mine = np.flatnonzero((row >= start) & (row < start + PART))
            stop = min(start + PART, batch.num_rows)
            used, at = np.unique(codes[ends[start] - n[start] : ends[stop - 1]], return_inverse=True)
            dots = np.round(block.vectors @ matrix[np.searchsorted(ids, used)].T, 6)
            offset = ends[start] - n[start]
            for k in mine:
                q, d = query[k], row[k]
                tokens = slice(block.starts[q], block.starts[q] + block.lengths[q])
                approx[k] = dots[tokens, at[ends[d] - n[d] - offset : ends[d] - offset]].max(1).sum()
        return pa.RecordBatch.from_arrays([pa.array(block.ids[query]), batch.column(0).take(pa.array(row, pa.int64())), pa.array(np.round(approx, 6))], names=["query_id", "doc_id", "approx"])

    return _over_blocks(rows, queries, kernel, "query_id long, doc_id long, approx double")


def pruned(approx: DataFrame, full_scores: int, share: float = 0.0) -> DataFrame:
    """(query_id, doc_id, approx, rank): the best ``full_scores`` of each query, then the best quarter of that number (one at least); ``share`` of the query's candidates at least."""
    keep = min(full_scores, max(full_scores // 4, 1))
    ranked = approx.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("approx"), F.asc("doc_id"))))
    if not share:
        return ranked.where(F.col("rank") <= keep)
    counts = approx.groupBy("query_id").agg(F.ceil(F.count(F.lit(1)) * F.lit(share)).alias("least"))
    return ranked.join(counts, "query_id").where(F.col("rank") <= F.greatest(F.lit(keep), F.col("least"))).drop("least")


def search_staged(queries: DataFrame, encoded: DataFrame, codec: Codec, lists: DataFrame, parameters: SearchParameters, subset: DataFrame | None = None, delta: DataFrame | None = None) -> DataFrame:
    """(query_id, rank, doc_id, score): probe, restrict to the subset, score by centroids, prune twice, decode and score exactly."""
    book = (codec.ids, codec.centroids)
    found = candidates(probed(queries, codebook_frame(encoded.sparkSession, book), parameters.probes), lists, delta, subset)
    left = cut(pruned(approximate(found, encoded, queries, book), parameters.full_scores, parameters.share).select("query_id", "doc_id"), "pruned")
    wanted = encoded.join(left.select("doc_id").distinct(), "doc_id", "left_semi")
    return best(rescored(left, decode(wanted, codec), queries, codec.centroids.shape[1]), parameters.top_k).select("query_id", "rank", "doc_id", "score")
