"""Global ranks and running totals without a window over one partition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut


def _columns(order: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def ranked(df: DataFrame, order: Sequence[str | Column], group: Sequence[str] = (), into: str = "rank0") -> DataFrame:
    """Adds the 0-based place of every row in its group by ``order``, which must leave no ties.

    Rows are sorted by range; a row's place is its place in its range plus the sizes of the ranges before. Only a count
    per range and group is put in order, so a group may be the whole table.
    """
    sorted_ = df.repartitionByRange(*[F.col(c) for c in group], *_columns(order)).sortWithinPartitions(*[F.col(c) for c in group], *_columns(order))
    placed = cut(sorted_.withColumn("__m", F.monotonically_increasing_id()), "ranked").withColumn("__p", F.shiftright("__m", 33))
    sizes = placed.groupBy("__p", *group).agg(F.count(F.lit(1)).alias("__n"), F.min("__m").alias("__first"))
    before = Window.partitionBy(*group).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1) if group else Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    keys = ["__p", *group]
    at = starts.select(*[F.col(c).alias(f"__k_{c}") for c in keys], "__first", "__before")
    match = [placed[c].eqNullSafe(at[f"__k_{c}"]) for c in keys]
    return placed.join(at, match).withColumn(into, F.col("__m") - F.col("__first") + F.col("__before")).select(*df.columns, into)


def renumbered(df: DataFrame, order: Sequence[str | Column], into: str) -> DataFrame:
    """Replaces ``into`` by the 0-based place of the row by ``order``."""
    out = ranked(df, order, into="__rank0")
    rest = [c for c in df.columns if c != into]
    return out.select(F.col("__rank0").alias(into), *rest)


def running_total(df: DataFrame, order: Sequence[str | Column], value: str, into: str = "offset") -> DataFrame:
    """Adds the sum of ``value`` over all rows before, by ``order``; null counts as 0."""
    sorted_ = df.repartitionByRange(*_columns(order)).sortWithinPartitions(*_columns(order))
    placed = cut(sorted_.withColumn("__m", F.monotonically_increasing_id()), "running").withColumn("__p", F.shiftright("__m", 33))
    sizes = placed.groupBy("__p").agg(F.sum(F.coalesce(F.col(value), F.lit(0))).alias("__n"))
    starts = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    own = F.coalesce(F.sum(F.coalesce(F.col(value), F.lit(0))).over(Window.partitionBy("__p").orderBy("__m").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed.join(F.broadcast(starts), "__p").withColumn(into, own + F.col("__before")).select(*df.columns, into)
