import random
from collections import defaultdict

import pytest

from spindrel.llm.packing import pack
from spindrel.llm.tokens import count_tokens


def check(df, capacity):
    rows = pack(df, capacity=capacity, shard_items=64).collect()
    inside, space = defaultdict(int), {}
    for r in rows:
        assert 0 < r["tokens"] <= capacity
        inside[r["container"]] += r["tokens"]
        space.setdefault(r["container"], r["unused"])
        assert space[r["container"]] == r["unused"]
    assert all(inside[c] + space[c] == capacity for c in inside)
    return rows, len(inside)


def test_whole_texts_in_tight_containers(spark):
    words = "retrieval index token vector cluster residual centroid".split()
    texts = [" ".join(words[(i * k) % 7] for k in range(3 + i * 7 % 90)) for i in range(500)]
    texts += ["same text again"] * 150 + ["long " * 700, "", None, "   "]
    df = spark.createDataFrame([(i, t, 1, "c") for i, t in enumerate(texts)], "doc_id long, text string, size int, container string")
    rows, containers = check(df, 256)
    want = {r["doc_id"]: r["n_tokens"] for r in count_tokens(df.select("doc_id", "text")).collect() if r["n_tokens"]}
    placed = defaultdict(list)
    for r in rows:
        placed[r["doc_id"]].append((r["piece"], r["tokens"]))
    assert {k: sum(t for _, t in v) for k, v in placed.items()} == want
    for k, v in placed.items():
        assert sorted(p for p, _ in v) == list(range(len(v)))
        assert len(v) == -(-want[k] // 256)
    assert containers <= sum(want.values()) / 256 * 1.03 + 1


def test_empty_and_single(spark):
    schema = "doc_id long, text string"
    assert pack(spark.createDataFrame([], schema)).count() == 0
    assert pack(spark.createDataFrame([(1, None), (2, "")], schema)).count() == 0
    (row,) = pack(spark.createDataFrame([(1, "alone")], schema), capacity=8).collect()
    assert row["unused"] == 8 - row["tokens"]


def test_repeated_keys_and_exact_multiples(spark):
    df = spark.createDataFrame([(1, " a" * 16), (1, " a" * 16), (2, " a" * 32)], "doc_id long, text string")
    rows, containers = check(df, 16)
    assert containers == 4 and all(r["unused"] == 0 for r in rows)


@pytest.mark.parametrize("n", [400, 2400])
def test_containers_hold_lexical_neighbours(spark, n):
    """Items of a container share a topic far more often than items drawn at random, in one shard and in many, and containers are full."""
    r = random.Random(n)
    topics = [[f"{a}{b}" for b in ("ora", "ine", "ust", "elm", "ark", "ift")] for a in ("br", "cl", "dr", "fl", "gr", "pl", "sk", "tr", "sp", "st", "sw", "th")]
    texts = [" ".join(r.choice(topics[i % 12]) for _ in range(r.randint(10, 60))) for i in range(n)]
    rows = pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), capacity=512, shard_items=300).collect()
    inside = {}
    for x in rows:
        inside.setdefault(x["container"], []).append(x)
    alike = [a["doc_id"] % 12 == b["doc_id"] % 12 for g in inside.values() for a in g for b in g if a["doc_id"] < b["doc_id"]]
    assert sum(alike) / len(alike) > 4 / 12
    assert sum(x["tokens"] for x in rows) / (512 * len(inside)) > 0.97 and len({x["doc_id"] for x in rows}) == n
