import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrel.llm.graph import components
from spindrel.llm.spectral import VECTORS, Clusters, affinities, cauchy, embed, k_means

from .test_neighbours import clustered, frame, isolated_pairs, random_directions


def union_find(edges, nodes=()):
    root = {x: x for x in nodes}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(root)}


@pytest.mark.parametrize("kind", ["random", "chain", "star", "loops"])
def test_components(spark, kind):
    r = random.Random(5)
    edges = {"random": [(r.randint(0, 300), r.randint(0, 300)) for _ in range(220)], "chain": [(i, i + 1) for i in range(0, 260)], "star": [(1000, i) for i in range(200)], "loops": [(1, 1), (2, 3), (3, 2), (None, 4)]}[kind]
    got = {x["node"]: x["component"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == union_find([e for e in edges if None not in e])


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def exact(ids, x, least=0.85):
    sim = np.round(x @ x.T, 6)
    return union_find([(int(ids[a]), int(ids[b])) for a, b in zip(*np.where(sim >= least)) if a < b], map(int, ids))


def test_clusters_are_the_connected_documents(spark):
    ids, x = clustered(500, seed=7)
    x[40:60] = x[0]  # equal vectors
    got = {r["id"]: r["cluster"] for r in Clusters(frame(spark, ids, x)).labels().collect()}
    assert got == exact(ids, x)


def test_a_long_chain_of_documents(spark):
    """The walk settles slowly on a chain; the exact check has to join its parts."""
    rng = np.random.default_rng(1)
    x = np.zeros((120, 64))
    position = np.eye(64)[0]
    for i in range(120):
        x[i] = position
        step = rng.standard_normal(64)
        step -= step @ position * position
        position = position * 0.9 + step / np.linalg.norm(step) * np.sqrt(1 - 0.81)
        position /= np.linalg.norm(position)
    got = {r["id"]: r["cluster"] for r in Clusters(frame(spark, np.arange(120), x), ways=12).labels().collect()}
    assert got == exact(np.arange(120), x)


def test_blocks_keep_the_components(spark):
    ids, x = clustered(400, seed=9, hot=0.5)
    edges = [(r["a"], r["b"]) for r in affinities(frame(spark, ids, x), block=60).collect()]
    assert union_find(edges, map(int, ids)) == exact(ids, x)
    assert len(edges) < 400 * 40


def test_embedding_is_level_within_a_clique(spark):
    edges = [(a, b, 1.0) for g in (0, 10, 20) for a in range(g, g + 5) for b in range(a + 1, g + 5)]
    cells = {r["id"]: r["cell"] for r in k_means(embed(spark.createDataFrame(edges, "a long, b long, w double"))).collect()}
    assert len({cells[i] for i in range(5)}) == 1 and len(set(cells.values())) == 3


def test_described(spark):
    ids, x = clustered(200, seed=11)
    x[:4] = np.eye(64)[3]
    rows = Clusters(frame(spark, ids, x)).described(3, 3).collect()
    labels = exact(ids, x)
    for r in rows:
        members = [i for i in labels if labels[i] == r["cluster"]]
        assert r["size"] == len(members) >= 3
        at = {int(i): k for k, i in enumerate(ids)}
        mean = np.mean([x[at[r["id"]]] @ x[at[m]] for m in members if m != r["id"]])
        assert abs(mean - r["affinity"]) < 2e-6
    assert Clusters(frame(spark, [], [])).labels().count() == 0
    assert Clusters(frame(spark, [], [])).described().count() == 0


def test_isolated_links_are_found_among_thousands_of_directions(spark, monkeypatch):
    monkeypatch.setattr("spindrel.llm.spectral.directions", lambda vectors, n: random_directions(4000))  # as many as of a large collection
    ids, x, pairs = isolated_pairs(1500, 3000)
    edges = {(r["a"], r["b"]) for r in affinities(frame(spark, ids, x), block=2048).collect()}
    assert edges == pairs and union_find(edges, map(int, ids)) == exact(ids, x)


def partition(rows):
    """The groups of (id, name)."""
    groups = {}
    for i, name in rows:
        groups.setdefault(name, set()).add(i)
    return {frozenset(g) for g in groups.values()}


def test_the_walk_makes_the_clusters(spark):
    """What k-means finds in the settled coordinates are the clusters already; without iterations they fall apart."""
    ids, x = clustered(600, seed=21)
    clusters = Clusters(frame(spark, ids, x))
    want = {g for g in partition(exact(ids, x).items()) if len(g) > 1}
    got = partition((r["id"], r["name"]) for r in clusters.spectral().collect())
    assert len(want & got) >= 0.95 * len(want) and all(any(g <= w for w in want) for g in got)
    none = partition((r["id"], r["name"]) for r in clusters.spectral(iterations=0).collect())
    assert len(want & none) <= 0.05 * len(want)


def test_large_components_stay_apart(spark):
    """Means of Cauchy values don't draw together, however many there are, as those of uniform ones do."""
    n = 400_000
    rows = spark.range(2 * n).select((F.col("id") % 2).alias("part"), *(cauchy("id", j).alias(f"c{j}") for j in range(VECTORS)), F.rand(3).alias("uniform"))
    a, b = rows.groupBy("part").agg(*(F.avg(f"c{j}").alias(f"c{j}") for j in range(VECTORS)), F.avg("uniform").alias("uniform")).orderBy("part").collect()
    apart = [abs(np.arcsinh(a[f"c{j}"]) - np.arcsinh(b[f"c{j}"])) for j in range(VECTORS)]
    assert max(apart) > 0.1 and abs(a["uniform"] - b["uniform"]) < 0.005
