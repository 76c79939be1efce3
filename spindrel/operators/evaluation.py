"""Retrieval metrics over runs (query, doc_id, score) and judgements (query, doc_id, rel).

Queries with judgements but no results score 0; queries without judgements don't count.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DEFAULT = ("ndcg@10", "hits@1", "hits@2", "hits@3", "hits@4", "hits@5", "hits@10")


def judged(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """(query, doc_id, rank, rel): the run by descending score (equal ones by the smaller document), with judgements, for judged queries."""
    of = qrels.select("query").distinct()
    best = run.groupBy("query", "doc_id").agg(F.max("score").alias("score"))
    ranked = best.join(of, "query", "left_semi").withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc("doc_id"))))
    rel = qrels.groupBy("query", "doc_id").agg(F.max("rel").alias("rel"))
    return ranked.join(rel, ["query", "doc_id"], "left").select("query", "doc_id", "rank", F.coalesce("rel", F.lit(0)).alias("rel"))


def ideal(qrels: DataFrame) -> DataFrame:
    """(query, rank, rel): relevant documents from the most relevant on."""
    rel = qrels.groupBy("query", "doc_id").agg(F.max("rel").alias("rel")).where("rel > 0")
    return rel.select("query", "rel", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("rel"), F.asc("doc_id"))).alias("rank"))


def per_query(run: DataFrame, qrels: DataFrame, metric: str) -> DataFrame:
    """(query, value): one of ndcg@k, recall@k, hits@k, map, ndcg or recall for every judged query, to 6 decimals."""
    m = re.fullmatch(r"(ndcg|recall|hits|map)(?:@(\d+))?", metric)
    if not m:
        raise ValueError(f"unknown metric {metric}")
    name, k = m[1], int(m[2]) if m[2] else None
    rows = judged(run, qrels)
    top = rows.where(F.col("rank") <= k) if k else rows
    relevant = qrels.groupBy("query", "doc_id").agg(F.max("rel").alias("rel")).groupBy("query").agg(F.count_if(F.col("rel") > 0).alias("r"))
    gain = lambda: F.sum(F.col("rel") / (F.log(F.col("rank") + 1) / F.log(F.lit(2.0))))
    if name == "ndcg":
        best = ideal(qrels)
        value = top.groupBy("query").agg(gain().alias("v"))
        of = (best.where(F.col("rank") <= k) if k else best).groupBy("query").agg(gain().alias("of"))
    elif name == "map":
        hit = top.where("rel > 0").withColumn("nth", F.row_number().over(Window.partitionBy("query").orderBy("rank")))
        value = hit.groupBy("query").agg(F.sum(F.col("nth") / F.col("rank")).alias("v"))
        of = relevant.select("query", F.col("r").cast("double").alias("of"))
    else:
        value = top.groupBy("query").agg(F.count_if(F.col("rel") > 0).cast("double").alias("v"))
        of = relevant.select("query", (F.col("r") if name == "recall" else F.lit(1)).cast("double").alias("of"))
    out = relevant.select("query").join(value, "query", "left").join(of, "query", "left")
    return out.select("query", F.round(F.when(F.col("of") > 0, F.coalesce("v", F.lit(0.0)) / F.col("of")).otherwise(0.0), 6).alias("value"))


def evaluate(run: DataFrame, qrels: DataFrame, metrics: Sequence[str] = DEFAULT) -> DataFrame:
    """(metric, value): each metric averaged over the judged queries, to 6 decimals."""
    out = None
    for metric in metrics:
        row = per_query(run, qrels, metric).agg(F.round(F.avg("value"), 6).alias("value")).select(F.lit(metric).alias("metric"), "value")
        out = row if out is None else out.unionByName(row)
    return out


def without_self(run: DataFrame) -> DataFrame:
    """The run without a query's own document."""
    return run.where(F.col("doc_id") != F.col("query"))


def duplicate_counts(queries: DataFrame) -> DataFrame:
    """(query, n): query texts that occur more than once."""
    return queries.groupBy("query").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def with_duplicates(queries: DataFrame, results: DataFrame) -> DataFrame:
    """Results of distinct queries (query, ...) for every query (query_no, query), repeated ones included."""
    return queries.join(results, "query")


def with_documents(results: DataFrame, documents: DataFrame, keep_missing: bool = True) -> DataFrame:
    """Results with the document's record; without one the fields are null, or the result is left out."""
    return results.join(documents, "doc_id", "left" if keep_missing else "inner")
