"""Joins whose left side may hold a third of all rows under one key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut

#: Rows of a key that one task joins; keys with more are split.
HOT = 100_000


def hot_keys(df: DataFrame, key: str, hot: int = HOT) -> DataFrame:
    """(key, parts) of the keys that more than ``hot`` rows share; there are fewer than rows / ``hot`` of them."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("__c")).where(F.col("__c") > hot).select(key, F.ceil(F.col("__c") / hot).cast("int").alias("parts"))


def split_join(left: DataFrame, right: DataFrame, key: str, by: str, how: str = "left", hot: int = HOT) -> DataFrame:
    """left join right on ``key``, which is unique on the right. Rows of a hot key are dealt out by a hash of ``by``, and the key's row on the right is repeated for each part."""
    hot_ = cut(hot_keys(left, key, hot), "hot")
    if hot_.isEmpty():
        return left.join(right, key, how)
    dealt = left.join(hot_, key, "left").withColumn("__part", F.pmod(F.xxhash64(by), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    held = right.join(hot_, key, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    return dealt.join(held, [key, "__part"], how).drop("__part")
