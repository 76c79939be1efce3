import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrel.functions import bits, text, vectors
from spindrel.operators import corpus, kmeans, maxsim
from spindrel.operators.index import chunk_count, needs_compaction
from spindrel.operators.ivf import clamped_probes, effective_probes
from spindrel.plans.ranks import ranked, running_total


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(k) for k, c in columns.items())).first()


def arr(*xs):
    return F.array(*(F.lit(x) for x in xs)) if xs else F.array().cast("array<double>")


def test_maxsim_micro(spark):
    docs = spark.createDataFrame([(0, [1.0, 0.0, 0.6, 0.8]), (1, [0.0, 1.0]), (2, [-1.0, 0.0, 0.8, -0.6]), (3, []), (4, None)], "doc_id long, flat array<float>")
    queries = spark.createDataFrame([(0, 0, [1.0, 0.0]), (0, 1, [0.0, 1.0])], "query_id long, qpos long, vec array<float>")
    got = {r["doc_id"]: r["score"] for r in maxsim.scores(docs, queries, 2).collect()}
    assert got == {0: 1.8, 1: 1.0, 2: 0.8}
    assert {r["doc_id"]: r["score"] for r in maxsim.scores(docs, queries, 2, average=True).collect()} == {0: 0.9, 1: 0.5, 2: 0.4}
    assert {r["doc_id"]: r["score"] for r in maxsim.scores(docs, queries, 2, empty_zero=True).collect()}[4] == 0
    assert [r["doc_id"] for r in maxsim.search_exact(docs, queries, 2, 2).orderBy("rank").collect()] == [0, 1]
    assert maxsim.scores(docs, queries.where("false"), 2).count() == 0
    assert maxsim.scores(docs.where("false"), queries, 2).count() == 0


def test_query_blocks(spark, monkeypatch):
    rng = np.random.default_rng(0)
    docs = spark.createDataFrame([(i, rng.standard_normal(8).tolist()) for i in range(9)], "doc_id long, flat array<double>")
    queries = spark.createDataFrame([(q, p, rng.standard_normal(4).tolist()) for q in range(7) for p in range(1 + q % 3)], "query_id long, qpos long, vec array<double>")
    whole = sorted(map(tuple, maxsim.search_exact(docs, queries, 4, 3).collect()))
    monkeypatch.setattr(maxsim, "QUERY_BYTES", 70)
    assert len(maxsim.query_blocks(queries)) > 2
    assert sorted(map(tuple, maxsim.search_exact(docs, queries, 4, 3).collect())) == whole


def test_expressions(spark):
    r = one(spark, dot=vectors.dot(arr(1.0, 2.0), arr(3.0, 4.0)), l2=vectors.squared_distance(arr(1.0, 2.0), arr(3.0, 5.0)), zero=vectors.normalized(arr(0.0, 0.0)), null=vectors.dot(F.lit(None).cast("array<double>"), arr(1.0)), w=vectors.windows(arr(1, 2, 3), 2), none=vectors.windows(arr(1), 2))
    assert (r["dot"], r["l2"], r["zero"], r["null"], r["w"], r["none"]) == (11.0, 13.0, [0.0, 0.0], None, [[1, 2], [2, 3]], None)
    valid = lambda *xs: one(spark, v=vectors.is_valid_embedding(arr(*xs), 2))["v"]
    assert valid(1.0, -10.0) and valid() and not valid(1.0) and not valid(1.0, 10.5) and not valid(1.0, float("nan"))
    cut = F.array(*(F.lit(round(-0.7 + 0.1 * i, 1)) for i in range(15)))
    assert [one(spark, b=vectors.bucket(F.lit(x), cut))["b"] for x in (-0.75, -0.7, 0.05, 0.69, 0.7, float("nan"))] == [0, 1, 8, 14, 15, 15]


def test_bits(spark):
    assert one(spark, p=F.hex(bits.pack_nibbles(arr(10, 5))))["p"] == "A5"
    assert one(spark, p=F.hex(bits.pack_nibbles(arr(10, 5), even_high=False)))["p"] == "5A"
    assert bits.pack_fields(np.array([[10, 5]]), 4).tobytes().hex() == "5a"
    assert bits.pack_fields(np.array([[1, 2, 3, 0]]), 2).tobytes().hex() == "9c"
    assert one(spark, p=bits.fields_to_hex(arr(1, 2, 3, 0), 2))["p"] == "9c"
    assert one(spark, u=bits.unpack_nibbles(F.unhex(F.lit("A5"))))["u"] == [10, 5]
    assert one(spark, u=bits.unpack_nibbles(F.unhex(F.lit("A5")), even_high=False))["u"] == [5, 10]
    assert one(spark, u=bits.unpack_nibbles(F.unhex(F.lit("A5F")), F.lit(3)), e=bits.unpack_nibbles(F.unhex(F.lit(""))))["e"] == []
    rng = np.random.default_rng(1)
    for n in (1, 2, 4, 8):
        codes = rng.integers(0, 2**n, (20, 16))
        assert (bits.unpack_fields(bits.pack_fields(codes, n), n, 16) == codes).all()


def test_text(spark):
    r = one(spark, t=text.tokens(F.lit(" Don't  PANIC, ok_1!")), n=text.tokens(F.lit(None).cast("string")), c=text.collapsed(F.lit(" a \n\t b ")), p=text.composed(F.lit("a"), F.lit(""), F.lit("b"), sep=". "), i=text.after_last(F.lit("http://x/abs/12/abs/34")))
    assert r["t"] == ["[CLS]", "don", "t", "panic", "ok_1", "[SEP]"] and r["n"] == ["[CLS]", "[SEP]"] and r["c"] == "a b" and r["p"] == "a. b" and r["i"] == "34"


def test_size_rules():
    assert [effective_probes(c, p) for c, p in ((100, 1), (50, 1), (101, 4))] == [10, 8, 4]
    assert clamped_probes(0, 16) == 1 and clamped_probes(1000, 16) == 16
    assert not needs_compaction(100, 9) and needs_compaction(100, 10)
    assert [kmeans.partition_count(n, t) for n, t in ((100, 300), (100, 5), (400, 5))] == [2048, 256, 512]
    assert [chunk_count(n) for n in (100, 25_000, 60_000)] == [1, 1, 3]
    assert [kmeans.sample_size(n) for n in (100, 25_000, 60_000)] == [100, 25_000, 42_933]
    assert kmeans.default_centroids(5) == 1


def test_partial_shuffle_is_a_choice_without_repeats():
    order = kmeans.lcg_order(1000, 256)
    assert len(set(order.tolist())) == 256 and order.max() < 1000
    assert sorted(kmeans.lcg_order(50, 99).tolist()) == list(range(50))


def test_kmeans_empty_cluster(spark):
    tokens = spark.createDataFrame([(0, [0.0, 0.0]), (1, [0.0, 0.0]), (2, [5.0, 5.0])], "t long, vec array<double>")
    start = np.arange(3), np.array([[0.0, 0.0], [0.0, 0.0], [5.0, 5.0]])
    assert kmeans.lloyd_step(tokens, start)[1].tolist() == [[0, 0], [0, 0], [5, 5]]
    moved = np.arange(2), np.array([[0.0, 0.0], [90.0, 90.0]])
    assert kmeans.lloyd_step(tokens, moved, "zero")[1][1].tolist() == [0, 0]
    assert kmeans.lloyd_step(tokens, moved, "keep")[1][1].tolist() == [90, 90]


def test_ranks_and_totals(spark):
    df = spark.range(200).selectExpr("id", "id % 3 as g", "199 - id as o", "id % 5 as v").repartition(7)
    rows = ranked(df, ["o"], ["g"]).collect()
    for g in range(3):
        mine = sorted((r["o"], r["rank0"]) for r in rows if r["g"] == g)
        assert [x for _, x in mine] == list(range(len(mine)))
    total = 0
    for r in sorted(running_total(df, ["id"], "v").collect(), key=lambda r: r["id"]):
        assert r["offset"] == total
        total += r["v"]
    assert ranked(df.where("false"), ["o"]).count() == 0


def test_flat_buffer(spark):
    values = spark.createDataFrame([(i, float(i)) for i in range(11)], "i long, x double")
    info = spark.createDataFrame([(0, 7, 2), (1, 8, 0), (2, 9, 1), (3, 5, 9)], "ord long, doc_id long, num_tokens int")
    got = {r["doc_id"]: r["flat"] for r in corpus.from_flat_buffer(values, info, 2).collect()}
    assert got == {7: [0.0, 1.0, 2.0, 3.0], 9: [4.0, 5.0]} and corpus.inferred_dim(11, 3) == 3 and math.isfinite(corpus.inferred_dim(1, 0))


@pytest.mark.parametrize("metric", ["l2", "dot"])
def test_ties_go_to_the_smaller_centroid(spark, metric):
    tokens = spark.createDataFrame([(0, [1.0, 0.0])], "t long, vec array<double>")
    book = spark.createDataFrame([(4, [1.0, 0.0]), (2, [1.0, 0.0])], "cid long, vec array<double>")
    assert kmeans.assigned(tokens, book, metric, ["t"]).first()["cid"] == 2


def test_pruning_grows_with_the_candidates(spark):
    from spindrel.operators.search import SearchParameters, pruned

    approx = spark.createDataFrame([(q, d, float(d)) for q, n in ((0, 1000), (1, 40)) for d in range(n)], "query_id long, doc_id long, approx double")
    kept = lambda share: {r["query_id"]: r["count"] for r in pruned(approx, 320, share).groupBy("query_id").count().collect()}
    assert kept(0.0) == {0: 80, 1: 40} and kept(SearchParameters().share) == {0: 900, 1: 40}
