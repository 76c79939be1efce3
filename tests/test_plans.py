"""Plans: what reaches the scan, what is shuffled, and that nothing is gathered in one place."""

import re

import pytest
from pyspark.sql import functions as F

from spindrel import queries as q
from spindrel.operators import ivf, kmeans, maxsim, metadata
from spindrel.plans.spread import spread
from spindrel.session import ship


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_read_only_what_is_used(spark, sf):
    text = plan(q.maxsim_bruteforce_topk(ship(spark), sf))
    schemas = re.findall(r"ReadSchema: (struct<[^\n]*>)", text)
    assert schemas and all(set(re.findall(r"(\w+):", s)) <= {"vec_id", "embedding", "label", "element"} for s in schemas)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_brute_force_shuffles_the_best_of_each_batch(spark, sf):
    scored = maxsim.search_exact(q._ragged(ship(spark), sf), q._ragged_queries(spark, sf), q.DIM, 10)
    text = plan(scored)
    assert text.count("Exchange hashpartitioning(query_id") == 1 and "WindowGroupLimit" in text


def test_conditions_reach_the_scan(spark, sf):
    docs = q._table(spark, sf, "documents").select(F.col("doc_id").alias(metadata.KEY), "n_chars", "kind")
    text = plan(metadata.filtered(docs, "n_chars > ? AND kind IS NOT NULL", [500]))
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThan\(n_chars,500\)", text) and "IsNotNull(kind)" in text


def test_a_subset_restricts_candidates_before_scoring(spark):
    probes = spark.createDataFrame([(0, 0, 1, 0.5)], "query_id long, qpos long, cid long, score double")
    lists = spark.createDataFrame([(1, 7), (1, 8)], "cid long, doc_id long")
    subset = spark.createDataFrame([(8,)], "doc_id long")
    found = ivf.candidates(probes, lists, subset=subset)
    assert "LeftSemi" in plan(found) and [r["doc_id"] for r in found.collect()] == [8]


def test_codebooks_and_query_sets_are_bounded(spark, monkeypatch):
    book = spark.createDataFrame([(i, [1.0] * 8) for i in range(10)], "cid long, vec array<double>")
    monkeypatch.setattr(maxsim, "MATRIX_BYTES", 100)
    with pytest.raises(ValueError):
        maxsim.collect_matrix(book, "cid")
    with pytest.raises(ValueError):
        kmeans.assigned(book.withColumnRenamed("cid", "t"), book)
    monkeypatch.setattr(maxsim, "QUERY_BYTES", 10)
    monkeypatch.setattr(maxsim, "QUERY_TOTAL", 20)
    with pytest.raises(ValueError):
        maxsim.query_blocks(book.select(F.col("cid").alias("query_id"), F.lit(0).alias("qpos"), "vec"))


def test_only_small_inputs_are_spread(spark):
    small = spark.range(100).coalesce(1)
    assert spread(small).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    wide = spark.range(100).repartition(3)
    assert spread(wide) is wide  # it is shuffled already
    many = spark.range(0, 100, 1, 64)
    assert spread(many) is many
