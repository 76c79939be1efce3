"""The data model: documents as packed token vectors, queries as rows of tokens.

docs(doc_id, flat): ``flat`` holds the token vectors one after the other, so lengths may differ and nothing is padded.
queries(query_id, qpos, vec): one row per query token.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import is_valid_embedding, token_of
from ..plans.ranks import running_total


def packed(tokens: DataFrame, key: str = "doc_id", pos: str = "pos", vec: str = "vec") -> DataFrame:
    """(doc_id, flat): token rows gathered to documents, in the order of their positions."""
    rows = tokens.groupBy(F.col(key).alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(vec).alias("v")))).alias("t"))
    return rows.select("doc_id", F.flatten(F.transform("t", lambda x: x["v"])).alias("flat"))


def unpacked(docs: DataFrame, dim: int) -> DataFrame:
    """(doc_id, pos, vec): a row per token of the packed documents."""
    n = F.floor(F.size("flat") / dim).cast("int")
    rows = docs.where(F.size("flat") >= dim).select("doc_id", F.col("flat"), F.explode(F.sequence(F.lit(0), n - 1)).alias("pos"))
    return rows.select("doc_id", "pos", token_of("flat", F.col("pos"), dim).alias("vec"))


#: Values of a chunk of a flat buffer.
BUFFER = 1 << 14


def from_flat_buffer(values: DataFrame, info: DataFrame, dim: int) -> DataFrame:
    """Documents out of one flat buffer.

    ``values`` is (i, x), the buffer by position, or (i, xs), runs of values of which the first has position i; ``info`` is
    (ord, doc_id, num_tokens). Each document takes as many vectors as it has tokens, in the order of ``ord``. A document
    that the buffer ends within is left out. Runs are joined with the documents they overlap, and cut by offsets.
    """
    if "xs" not in values.columns:
        runs = values.groupBy(F.expr(f"i div {BUFFER}").alias("run")).agg(F.min("i").alias("i"), F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v"))
        values = runs.select("i", F.transform("v", lambda e: e["x"]).alias("xs"))
    cells = F.explode(F.sequence(F.expr(f"i div {BUFFER}"), F.expr(f"(i + size(xs) - 1) div {BUFFER}"))).alias("run")
    held = values.where("size(xs) > 0").select("i", "xs", cells)
    offsets = running_total(info, ["ord"], "num_tokens", "start")
    wanted = offsets.where("num_tokens > 0").select("doc_id", "ord", (F.col("num_tokens") * dim).alias("n"), (F.col("start") * dim).alias("from"))
    wanted = wanted.withColumn("run", F.explode(F.sequence(F.expr(f"`from` div {BUFFER}"), F.expr(f"(`from` + n - 1) div {BUFFER}"))))
    low = F.greatest(F.col("from"), F.col("i"), F.col("run") * BUFFER)
    high = F.least(F.col("from") + F.col("n"), F.col("i") + F.size("xs"), (F.col("run") + 1) * BUFFER)
    parts = wanted.join(held, "run").withColumn("low", low).withColumn("len", (high - low).cast("int")).where("len > 0")
    parts = parts.select("doc_id", "ord", "n", "low", F.slice("xs", (F.col("low") - F.col("i") + 1).cast("int"), F.col("len")).alias("part"))
    docs = parts.groupBy("ord", "doc_id", "n").agg(F.array_sort(F.collect_list(F.struct("low", "part"))).alias("t"))
    return docs.select("doc_id", "n", F.flatten(F.transform("t", lambda e: e["part"])).alias("flat")).where("size(flat) = n").drop("n")


def from_arrays(spark: SparkSession, documents: Iterable, first: int = 0) -> DataFrame:
    """(doc_id, flat) of arrays in memory: a list of (tokens, dim) arrays, with or without a leading dimension of 1, or one 3-D array."""
    rows = []
    for i, x in enumerate(documents):
        x = np.asarray(x, np.float32)
        rows.append((first + i, (x[0] if x.ndim == 3 and len(x) == 1 else x).ravel().tolist()))
    return spark.createDataFrame(rows, "doc_id long, flat array<float>")


def queries_from_arrays(spark: SparkSession, queries: Iterable) -> DataFrame:
    """(query_id, qpos, vec) of arrays in memory, as ``from_arrays`` takes them. Rows of zeros are padding and left out."""
    rows = []
    for q, x in enumerate(queries):
        x = np.asarray(x, np.float32)
        x = x[0] if x.ndim == 3 and len(x) == 1 else x
        rows += [(q, p, v.tolist()) for p, v in enumerate(x) if v.any()]
    return spark.createDataFrame(rows, "query_id long, qpos long, vec array<float>")


def inferred_dim(total_values: int, total_tokens: int) -> int:
    """The dimension of a flat buffer: values per token, a remainder is left out."""
    return total_values // total_tokens if total_tokens else 0


def latest(df: DataFrame, key: str, at: str) -> DataFrame:
    """One row per key: its latest delivery. Null keys are left out; equal times are settled by the other columns."""
    rest = [c for c in df.columns if c not in (key, at)]
    chosen = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(F.col(at), F.xxhash64(*rest))).alias("r"))
    return chosen.select(key, "r.*")


def checked(docs: DataFrame, dim: int, flat: str = "flat") -> DataFrame:
    """Adds ``valid``: whole vectors of values in [-10, 10]."""
    return docs.withColumn("valid", is_valid_embedding(flat, dim))
