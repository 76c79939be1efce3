"""Inverted files: from a centroid to the documents that have a token near it."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .maxsim import nearest_axes


def postings(codes: DataFrame, mode: str = "all_tokens") -> DataFrame:
    """(cid, doc_id), each once, of token rows (doc_id, pos, cid). ``first_token``: only a document's first token counts."""
    rows = codes if mode == "all_tokens" else codes.where("pos = 0")
    return rows.select("cid", "doc_id").distinct()


def postings_of_lists(encoded: DataFrame, codes: str = "codes") -> DataFrame:
    """(cid, doc_id), each once, of encoded documents with a list of codes; null codes count not."""
    return encoded.select("doc_id", F.explode(F.array_distinct(codes)).alias("cid")).where("cid is not null").select("cid", "doc_id").distinct()


def effective_probes(clusters: int, probes: int = 1) -> int:
    """Clusters that a query token probes: the root of all up to 100 clusters, ``probes`` beyond."""
    return probes if clusters > 100 else math.ceil(math.sqrt(clusters))


def clamped_probes(probes: int, clusters: int) -> int:
    return min(max(1, probes), clusters)


def probed(queries: DataFrame, centroids: DataFrame, probes: int) -> DataFrame:
    """(query_id, qpos, cid, score): of every query token the best clusters by dot product; equal ones by the smaller id."""
    return nearest_axes(queries, centroids, probes)


def candidates(probes: DataFrame, lists: DataFrame, delta: DataFrame | None = None, subset: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id), each once: documents in the probed clusters, of the base lists and the delta.

    ``subset`` (query_id, doc_id), or (doc_id) for all queries, restricts them before anything is scored; an empty subset
    leaves none.
    """
    every = lists if delta is None else lists.unionByName(delta)
    found = probes.select("query_id", "cid").distinct().join(every, "cid").select("query_id", "doc_id").distinct()
    return found if subset is None else found.join(subset, [c for c in ("query_id", "doc_id") if c in subset.columns], "left_semi")


def cluster_statistics(centroids: DataFrame, lists: DataFrame) -> DataFrame:
    """One row: clusters, empty, smallest, upper median and largest number of documents, and their mean."""
    sizes = centroids.select("cid").join(lists.groupBy("cid").agg(F.count(F.lit(1)).alias("n")), "cid", "left").select("cid", F.coalesce("n", F.lit(0)).alias("n"))
    # sizes are counted by value, so that the median is found without an order of all clusters
    by_size = sizes.groupBy("n").agg(F.count(F.lit(1)).alias("c"))
    upto = Window.orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    placed = by_size.withColumn("upto", F.sum("c").over(upto)).withColumn("all", F.sum("c").over(Window.partitionBy()))
    return placed.agg(
        F.sum("c").alias("clusters"), F.coalesce(F.sum(F.when(F.col("n") == 0, F.col("c"))), F.lit(0)).alias("empty_clusters"), F.min("n").alias("min_size"),
        F.min(F.when(F.col("upto") > F.expr("all div 2"), F.col("n"))).alias("median_size"), F.max("n").alias("max_size"),
        F.round(F.sum(F.col("n") * F.col("c")) / F.sum("c"), 6).alias("avg_size"),
    )


def largest_clusters(lists: DataFrame, k: int = 10) -> DataFrame:
    """(cid, n): the k clusters with most documents."""
    return lists.groupBy("cid").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc("cid")).limit(k)
