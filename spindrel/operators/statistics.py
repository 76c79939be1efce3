"""Statistics of corpora, of timings and of compression."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ranks import ranked


def length_statistics(docs: DataFrame, n: str = "n_tokens") -> DataFrame:
    """One row: documents, tokens, mean, smallest and largest length; null lengths count as 0."""
    x = F.coalesce(F.col(n), F.lit(0))
    return docs.agg(F.count(F.lit(1)).alias("num_docs"), F.sum(x.cast("long")).alias("num_tokens"), F.round(F.avg(x), 6).alias("avg_doclen"), F.min(x).alias("min_doclen"), F.max(x).alias("max_doclen"))


def length_quantiles(docs: DataFrame, n: str = "n_tokens", shares: tuple[float, ...] = (0.5, 0.75, 0.9, 0.95)) -> DataFrame:
    """(stride): the lengths at places floor(share * count) of the order, and the longest; positive, each once, ascending.

    Lengths are counted by value, so that only as many rows as there are lengths are put in order.
    """
    by = docs.groupBy(F.col(n).alias("len")).agg(F.count(F.lit(1)).alias("c")).where("len is not null")
    upto = Window.orderBy("len").rowsBetween(Window.unboundedPreceding, 0)
    placed = by.withColumn("upto", F.sum("c").over(upto)).withColumn("all", F.sum("c").over(Window.partitionBy())).withColumn("top", F.max("len").over(Window.partitionBy()))
    wanted = F.explode(F.array(*(F.least(F.floor(F.lit(s) * F.col("all")), F.col("all") - 1) for s in shares), F.col("all") - 1)).alias("at")
    hits = placed.select("len", "upto", "c", wanted).where("at < upto and at >= upto - c")
    return hits.where("len > 0").select(F.col("len").cast("int").alias("stride")).distinct()


def corpus_statistics(papers: DataFrame) -> DataFrame:
    """One row: papers, mean length of abstracts, years and venues (distinct), first and last year."""
    return papers.agg(
        F.count(F.lit(1)).alias("num_papers"), F.round(F.avg(F.length("abstract")), 6).alias("avg_abstract_length"), F.countDistinct("year").alias("num_years"),
        F.min("year").alias("min_year"), F.max("year").alias("max_year"), F.countDistinct("venue").alias("num_venues"),
    )


def top_values(df: DataFrame, column: str, k: int = 5) -> DataFrame:
    """(value, n): the k most frequent values that aren't null; equal counts in the order of the values."""
    return df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc("value")).limit(k)


def timing_statistics(df: DataFrame, group: str, value: str) -> DataFrame:
    """(group, n, avg, min, max) of a measured value, to 6 decimals; nulls don't count."""
    return df.groupBy(group).agg(F.count(value).alias("n"), F.round(F.avg(value), 6).alias("avg_value"), F.round(F.min(value), 6).alias("min_value"), F.round(F.max(value), 6).alias("max_value"))


def compression_statistics(tokens: int | F.Column, dim: int, bits: int = 4, code_bytes: int = 1) -> dict[str, F.Column]:
    """Bytes of vectors as they are and encoded, their ratio and the saved percentage, as expressions of a token count."""
    tokens = F.lit(tokens) if isinstance(tokens, int) else tokens
    raw, small = tokens * (dim * 4), tokens * (code_bytes + (dim * bits + 7) // 8)
    return {"raw_bytes": raw.cast("long"), "encoded_bytes": small.cast("long"), "ratio": F.round(raw / small, 6), "saved_percent": F.round((raw - small) / raw * 100, 6)}


def prefix_sample(df: DataFrame, order: str, k: int) -> DataFrame:
    """The first k rows by a unique order: the sample a codebook is trained on."""
    return ranked(df, [order]).where(F.col("rank0") < k)


def hashed_sample(df: DataFrame, key: str, k: int, seed: int = 42) -> DataFrame:
    """k rows in the order of a seeded hash: the same ones whatever the partitions are."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), F.col(key)).limit(k)


def held_out(df: DataFrame, order: str, n: int, total: int) -> DataFrame:
    """Adds ``held_out``: whether the row is among the last n by the order."""
    return ranked(df, [order]).withColumn("held_out", F.col("rank0") >= total - n).drop("rank0")
