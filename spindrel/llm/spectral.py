"""Clusters of similar documents by power iteration.

Similar pairs make a sparse graph. Its affinities are normalised to a random walk;
several random vectors are multiplied by it again and again, until a vertex and its
neighbours have the same coordinates. Vertices are then clustered by k-means in these
coordinates, started from the cells of a grid; an exact check joins clusters that a
similar pair still connects, where the walk hasn't settled.

The vectors start with Cauchy values: a mean of any number of them, and so what a
component settles at, is spread like a single one. Large components thus stay as far
apart as small ones.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut
from .graph import components
from .vectors import directions, met, routed

#: Random vectors, iterations at most, and the distance below which coordinates count as equal.
VECTORS, ITERATIONS, NEAR = 8, 24, 1e-5

#: Cells (queries x objects) whose similarities are computed at a time.
CELLS = 1 << 20

#: Room for rounding where cosines of unit vectors are first computed in single precision.
NARROW = 1e-4


def sparse_links(ids: np.ndarray, vectors: np.ndarray, asks: np.ndarray, held: np.ndarray, least: float, k: int) -> pd.DataFrame:
    """(a, b, w): of each asking vector its k most similar held ones, and a forest that connects all that similar pairs connect here.

    A pair beyond the k nearest is kept only where it connects what is apart so far, so links are in proportion to the
    vectors, however dense a cluster is.
    """
    label = np.arange(len(ids))  # of what is connected so far
    out_a, out_b, out_w = [], [], []
    step = max(1, CELLS // max(1, len(held)))
    for start in range(0, len(asks), step):
        at = asks[start : start + step]
        sim = np.round(vectors[at] @ vectors[held].T, 6)
        sim[ids[at][:, None] == ids[held][None, :]] = -2
        near = np.argpartition(-sim, k, axis=1)[:, :k] if len(held) > k else np.tile(np.arange(len(held)), (len(at), 1))
        similar = np.take_along_axis(sim, near, 1) >= least
        for row in np.flatnonzero(similar.any(1)):
            partners = np.flatnonzero(sim[row] >= least)
            labels, first = np.unique(label[held[partners]], return_index=True)
            other = labels != label[at[row]]
            kept = np.union1d(near[row][similar[row]], partners[first[other]])
            out_a.append(np.full(len(kept), ids[at[row]]))
            out_b.append(ids[held[kept]])
            out_w.append(sim[row, kept])
            if other.any():
                onto = np.arange(len(ids))
                onto[labels] = onto[label[at[row]]] = min(labels[0], label[at[row]])
                label = onto[label]
    if not out_a:
        return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64), "w": np.zeros(0)})
    a, b = np.concatenate(out_a), np.concatenate(out_b)
    return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "w": np.concatenate(out_w)}).drop_duplicates()


def _edges(least: float, k: int):
    def run(group: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id")
        asks, held = np.flatnonzero(rows["query"].to_numpy(bool)), np.flatnonzero(rows["object"].to_numpy(bool))
        return sparse_links(rows["id"].to_numpy(np.int64), np.stack(rows["vec"].to_numpy()), asks, held, least, k)

    return run


def bridges(ids: np.ndarray, vectors: np.ndarray, labels: np.ndarray, asks: np.ndarray, held: np.ndarray, least: float) -> pd.DataFrame:
    """(a, b, w): similar pairs of an asking and a held vector of different labels, one per step and pair of labels."""
    out = []
    asked, objects, of = vectors[asks].astype(np.float32), vectors[held].astype(np.float32), labels[held]
    step = max(1, CELLS // max(1, len(held)))
    for start in range(0, len(asks), step):
        row, col = np.nonzero(asked[start : start + step] @ objects.T >= least - NARROW)
        row += start
        other = labels[asks[row]] != of[col]
        q, o = asks[row[other]], held[col[other]]
        w = np.round(np.einsum("ij,ij->i", vectors[q], vectors[o]), 6)
        q, o, w = q[w >= least], o[w >= least], w[w >= least]
        found = pd.DataFrame({"a": np.minimum(ids[q], ids[o]), "b": np.maximum(ids[q], ids[o]), "w": w, "u": np.minimum(labels[q], labels[o]), "v": np.maximum(labels[q], labels[o])})
        out.append(found.drop_duplicates(["u", "v"])[["a", "b", "w"]])
    return pd.concat(out, ignore_index=True)


def _bridges(least: float):
    def run(group: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        asks, held = np.flatnonzero(rows["query"].to_numpy(bool)), np.flatnonzero(rows["object"].to_numpy(bool))
        if not len(asks) or not len(held):
            return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64), "w": np.zeros(0)})
        return bridges(rows["id"].to_numpy(np.int64), np.stack(rows["vec"].to_numpy()), rows["label"].to_numpy(np.int64), asks, held, least)

    return run


def affinities(vectors: DataFrame, least: float = 0.85, k: int = 8, ways: int = 6, block: int = 16_384) -> DataFrame:
    """(a, b, w), a < b: a sparse graph of similar documents with the connected components of the full one.

    Vectors are unit vectors (id, vec); those of equal coordinates must be one row. Each group of ``routed`` gives its
    vectors' k most similar partners and what else it takes to connect them, so its size is in proportion to the
    vectors, however large a cluster is. Similar vectors may share no group; so every block of vectors then meets every
    block, and pairs that connect components still apart are added.
    """
    n = vectors.count()
    axes = directions(vectors, n)
    if not len(axes):
        return vectors.sparkSession.createDataFrame([], "a long, b long, w double")
    groups = routed(vectors, axes, ways, block)
    found = groups.groupBy("axis", "qb", "ob").applyInPandas(_edges(least, k), "a long, b long, w double")
    found = cut(found.groupBy("a", "b").agg(F.max("w").alias("w")), "routes")
    labelled = vectors.join(components(found).withColumnRenamed("node", "id"), "id", "left").select("id", "vec", F.coalesce("component", "id").alias("label"))
    missing = met(cut(labelled, "labelled"), n, block, once=True).groupBy("qb", "ob").applyInPandas(_bridges(least), "a long, b long, w double")
    return found.unionByName(missing).groupBy("a", "b").agg(F.max("w").alias("w"))


def cauchy(key: str, j: int) -> Column:
    """The j-th start value of a vertex: Cauchy, by its hash."""
    share = (F.xxhash64(key, F.lit(j)).bitwiseAND((1 << 52) - 1) + F.lit(0.5)) / F.lit(float(1 << 52))
    return F.tan((share - F.lit(0.5)) * F.lit(math.pi))


def embed(edges: DataFrame, vectors: int = VECTORS, iterations: int = ITERATIONS, near: float = NEAR) -> DataFrame:
    """(id, x): coordinates of every vertex after power iteration on the normalised affinities of (a, b, w).

    A vertex keeps half its value in a step (an edge to itself), which makes the walk converge on any graph. A step is
    one join and one aggregation over the edges, combined before the shuffle, and names the state once, so that plans
    grow by a step and no more. It ends early when no edge is longer than ``near``. Coordinates are the values' inverse
    hyperbolic sines, which measure large values by their ratio.
    """
    both = edges.select("a", "b", "w").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    degree = both.groupBy("a").agg(F.sum("w").alias("d"))
    steps = both.join(degree, "a").select(F.col("a").alias("id"), F.col("b").alias("src"), (F.col("w") / F.col("d") / 2).alias("p"))
    walk = cut(steps.unionByName(degree.select(F.col("a").alias("id"), F.col("a").alias("src"), F.lit(0.5).alias("p"))), "walk")
    names = [f"x{j}" for j in range(vectors)]
    state = walk.where("id = src").select("src", *(cauchy("src", j).alias(x) for j, x in enumerate(names)))
    for step in range(1, iterations + 1):
        state = walk.join(state, "src").groupBy("id").agg(*(F.sum(F.col("p") * F.col(x)).alias(x) for x in names)).withColumnRenamed("id", "src")
        if step % 4 == 0:
            state = cut(state, "state")
        if step % 8 == 0:
            ends = walk.join(state, "src").groupBy("id").agg(*(F.max(x).alias(f"{x}_") for x in names), *(F.min(x).alias(x) for x in names))
            longest = ends.agg(F.max(F.greatest(*(F.asinh(f"{x}_") - F.asinh(x) for x in names)))).first()[0]
            if longest is None or longest < near:
                break
    return state.select(F.col("src").alias("id"), F.array(*(F.asinh(x) for x in names)).alias("x"))


def k_means(points: DataFrame, near: float = NEAR, rounds: int = 2) -> DataFrame:
    """(id, cell): k-means of (id, x) whose centres start from the cells of a grid, one per cell.

    The grid is as wide as ten times what still separates neighbours, so the centres of two cells are no nearer than
    that but at a border. A Lloyd round moves each centre to the mean of its points; a point then goes to the nearest of
    the centres of its cluster and of the cells beside it. The number of clusters isn't given and may grow
    with the data, so centres are joined by cell and never gathered.
    """
    wide = near * 10
    beside = lambda up: F.xxhash64(F.transform("x", lambda v, j: F.floor(v / F.lit(wide)) + F.when(j == 0, F.lit(up)).otherwise(F.lit(0))))
    placed = points.select("id", "x", beside(0).alias("cell"))
    off = F.aggregate(F.zip_with("x", "c", lambda u, v: (u - v) * (u - v)), F.lit(0.0), lambda s, v: s + v)
    for _ in range(rounds):
        flat = placed.select("cell", F.posexplode("x").alias("j", "v")).groupBy("cell", "j").agg(F.avg("v").alias("v"))
        centres = flat.groupBy("cell").agg(F.array_sort(F.collect_list(F.struct("j", "v"))).alias("c")).select("cell", F.transform("c", lambda e: e["v"]).alias("c"))
        tries = placed.select("id", "x", F.explode(F.array_distinct(F.array("cell", beside(0), beside(-1), beside(1)))).alias("cell"))
        placed = cut(tries.join(centres, "cell").groupBy("id").agg(F.first("x").alias("x"), F.min_by("cell", F.struct(off.alias("o"), "cell")).alias("cell")), "means")
    return placed.select("id", "cell")


class Clusters:
    """Clusters of the documents of (id, vec), unit vectors with each id once; empty tables have none.

    Documents of equal vectors are one vertex, whose least id stands for them.
    """

    def __init__(self, vectors: DataFrame, least: float = 0.85, ways: int = 6):
        self.vectors = cut(vectors.select("id", "vec"), "vectors")
        same = F.transform("vec", lambda v: F.round(v, 12) + F.lit(0.0))
        keyed = self.vectors.select("id", "vec", F.xxhash64(same).alias("h"), F.hash(same).alias("g"))
        classes = keyed.groupBy("h", "g").agg(F.min("id").alias("rep"), F.min_by("vec", "id").alias("v"))
        self.members = cut(keyed.select("id", "h", "g").join(classes.select("h", "g", "rep"), ["h", "g"]).select("id", "rep"), "members")
        self.edges = cut(affinities(cut(classes.select(F.col("rep").alias("id"), F.col("v").alias("vec")), "vertices"), least, ways=ways), "affinities")

    def spectral(self, iterations: int = ITERATIONS) -> DataFrame:
        """(id, name): the vertices with a similar one, by the clusters of k-means in the coordinates that the walk settles at; named by their smallest id."""
        cells = k_means(embed(self.edges, iterations=iterations))
        named = cells.groupBy("cell").agg(F.min("id").alias("name"))
        return cells.join(named, "cell").select("id", "name")

    def labels(self) -> DataFrame:
        """(id, cluster): every document with the smallest id of its cluster; itself if it is similar to none."""
        spectral = cut(self.spectral(), "spectral")
        # exact check: clusters that a similar pair connects are one; where the walk has settled, there are none
        ends = self.edges.join(spectral.select(F.col("id").alias("a"), F.col("name").alias("u")), "a").join(spectral.select(F.col("id").alias("b"), F.col("name").alias("v")), "b")
        joined = components(ends.where("u <> v").select("u", "v"), "u", "v").select(F.col("node").alias("name"), F.col("component"))
        whole = spectral.join(joined, "name", "left").select(F.col("id").alias("rep"), F.coalesce("component", "name").alias("root"))
        placed = self.members.join(whole, "rep", "left").select("id", F.coalesce("root", "rep").alias("root"))
        smallest = placed.groupBy("root").agg(F.min("id").alias("cluster"))
        return placed.join(smallest, "root").select("id", "cluster")

    def described(self, least_size: int = 3, typical: int = 3) -> DataFrame:
        """(cluster, size, rank, id, affinity): the most typical members of every cluster.

        A member's affinity is its mean cosine to the other members, by the sum of the cluster's vectors, so that no
        pairs are made; equal ones (rounded to 6 decimals) are ranked by the smaller id.
        """
        labels = cut(self.labels(), "clusters")
        held = labels.join(self.vectors, "id")
        dim = self.vectors.select(F.size("vec").alias("d")).limit(1).collect()
        dim = dim[0]["d"] if dim else 0
        sums = held.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.array(*(F.sum(F.col("vec")[j]) for j in range(dim))).cast("array<double>").alias("s")).where(F.col("size") >= least_size)
        inner = F.aggregate(F.zip_with("vec", "s", lambda u, v: u * v), F.lit(0.0), lambda a, b: a + b)
        scored = held.join(sums, "cluster").select("cluster", "size", "id", F.round((inner - 1) / (F.col("size") - 1), 6).alias("affinity"))
        ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("affinity"), F.asc("id"))))
        return ranked.where(F.col("rank") <= typical).select("cluster", "size", "rank", "id", "affinity")

