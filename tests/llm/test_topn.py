import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from spindrel.llm import topn
from spindrel.llm.topn import bounded, top_n

SCHEMA = "query_id long, passage_ids array<long>, scores array<float>, score double, item long"


def best(rows, n, skip=(-1,)):
    top = {}
    for q, items, scores, *_ in rows:
        for i, s in zip(items or [], scores or []):
            if i is not None and i not in skip and s is not None and s == s:
                group = top.setdefault(q, {})
                group[i] = max(group.get(i, -1e30), s)
    return {(q, i) for q, g in top.items() for i, _ in sorted(g.items(), key=lambda x: (-x[1], x[0]))[:n]}


def test_against_brute_force(spark):
    r = random.Random(1)
    rows = [(1, None, None, 0.0, 1), (2, [], [], 0.0, 1), (None, [5, 6], [1.0, 2.0], 0.0, 1), (3, [-1, 7, None], [-9999.0, float("nan"), 2.0], 0.0, 1), (4, [8, 9], [None, 1.0], 0.0, 1), (5, [1, 2, 3], [0.5], 0.0, 1)]
    for _ in range(600):
        n = r.randint(0, 12)
        rows.append((r.choice([10, 10, 10, r.randint(11, 40)]), [r.randint(0, 60) for _ in range(n)], [float(r.randint(0, 20)) for _ in range(r.randint(0, n))], 0.0, 1))
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {(x["group"], x["item"]) for x in top_n(df, "query_id", "passage_ids", "scores", 10, skip=(-1,)).collect()}
    assert got == best(rows, 10)
    # the same with heaps that are passed on early, and with repeated rows
    kept, topn.HOLD = topn.HOLD, 1
    try:
        again = {(x["group"], x["item"]) for x in top_n(df.unionByName(df), "query_id", "passage_ids", "scores", 10, skip=(-1,)).collect()}
    finally:
        topn.HOLD = kept
    assert again == got


def test_plain_columns_ties_and_empty(spark):
    rows = [(1, None, None, 1.0, i) for i in range(30, 0, -1)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert [x["item"] for x in top_n(df, "query_id", "item", "score", 3).orderBy("item").collect()] == [1, 2, 3]
    assert top_n(df.where("false"), "query_id", "passage_ids", "scores", 3).count() == 0
    text = df.select(F.lit("a").alias("g"), F.col("item").cast("string").alias("i"), "score")
    assert [x["item"] for x in top_n(text, "g", "i", "score", 2).orderBy("item").collect()] == ["1", "10"]


def test_heaps_merge_in_any_order():
    rng = np.random.default_rng(2)
    rows = pd.DataFrame({"g": rng.integers(0, 4, 500), "i": rng.integers(0, 80, 500), "s": rng.integers(0, 9, 500).astype(float)})
    whole = set(map(tuple, bounded(rows, 5)[["g", "i", "s"]].to_numpy()))
    parts = [bounded(rows.iloc[k::7], 5) for k in range(7)]
    rng.shuffle(parts)
    assert set(map(tuple, bounded(pd.concat(parts), 5)[["g", "i", "s"]].to_numpy())) == whole


def test_one_shuffle(spark):
    df = spark.createDataFrame([(1, [2], [3.0], 0.0, 1)], SCHEMA)
    plan = top_n(df, "query_id", "passage_ids", "scores", 10)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
