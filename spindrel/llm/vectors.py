"""Vectors of documents, the routing of like vectors into bounded blocks, and the meeting of all blocks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.lineage import cut
from ..plans.spread import spread

#: Sampled vectors at most that become directions of the routing; with 64 doubles each they take 8 MB in every task.
DIRECTIONS = 16_384

#: Bytes of a codebook at most that travel with the tasks.
CODEBOOK = 64 << 20


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def mean_vectors(df: DataFrame, key: str = "id", values: str = "embeddings", tokens: str = "num_tokens", at: str = "encoded_at", dim: int = 64) -> DataFrame:
    """(id, vec): per document the unit vector of the mean of its token vectors.

    ``values`` holds the token vectors one after the other. An id counts once, by its latest delivery that counts. Rows
    with a null id, null or empty values, a null or NaN among them, a length that isn't a multiple of ``dim``, or a zero
    mean take no part. ``tokens`` isn't trusted: the length of the values decides.
    """
    narrow = df.select(F.col(key).cast("long").alias("id"), F.col(at).cast("timestamp").alias("at"), F.col(values).alias("v")).where("id is not null and size(v) > 0")
    out = T.StructType([T.StructField("id", T.LongType()), T.StructField("at", T.TimestampType()), T.StructField("vec", T.ArrayType(T.DoubleType(), False))])

    def means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            n = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become NaN
            ok = n % dim == 0
            rows = np.flatnonzero(ok)
            if not len(rows):
                continue
            take = np.repeat(ok, n)
            sums = np.add.reduceat(flat[take].reshape(-1, dim), (np.cumsum(n[rows]) - n[rows]) // dim, axis=0)
            norm = np.linalg.norm(sums, axis=1)
            good = np.isfinite(norm) & (norm > 0)
            vec = sums[good] / norm[good, None]
            kept = pa.array(rows[good], pa.int64())
            offsets = pa.array(np.arange(0, vec.size + 1, dim), pa.int32())
            lists = pa.ListArray.from_arrays(offsets, pa.array(vec.ravel()), type=pa.list_(pa.field("element", pa.float64(), False)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(kept), batch.column(1).take(kept), lists], names=["id", "at", "vec"])

    return spread(narrow).mapInArrow(means, out).groupBy("id").agg(F.max_by("vec", F.struct("at", "vec")).alias("vec"))


def code_vectors(df: DataFrame, clusters: DataFrame, key: str = "id", codes: str = "centroid_codes", at: str = "written_at", dim: int = 64) -> DataFrame:
    """(id, vec): per document the unit vector of the sum of the centroids of its codes, repeats included.

    ``clusters`` has (cluster_id, segment, centroid); a cluster's centroid is the same in all segments and null in some
    rows. Null codes and codes without a centroid take no part; a document left without any takes no part, nor does a
    null id. An id counts once, by its latest delivery with codes. A codebook of up to CODEBOOK bytes travels with the
    tasks, so that documents needn't be shuffled by code; a larger one is joined.
    """
    known = clusters.where("centroid is not null and cluster_id is not null").groupBy("cluster_id").agg(F.min_by("centroid", "segment").alias("c")).where(F.size("c") == dim)
    docs = df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(at).alias("at"), F.filter(codes, lambda c: c.isNotNull()).alias("codes")).where("size(codes) > 0")
    docs = docs.groupBy("id").agg(F.max_by("codes", F.struct("at", "codes")).alias("codes"))
    if known.count() * dim * 8 > CODEBOOK:
        rows = docs.select("id", F.explode("codes").alias("cluster_id")).join(known, "cluster_id").select("id", F.posexplode(F.col("c").cast("array<double>")).alias("d", "x"))
        sums = rows.groupBy("id", "d").agg(F.sum("x").alias("x"))
        flat = sums.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("d", "x"))).alias("v")).select("id", F.transform("v", lambda e: e["x"]).alias("vec"))
        norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x))
        return flat.withColumn("n", norm).where("n > 0").select("id", F.transform("vec", lambda x: x / F.col("n")).alias("vec"))
    book = known.toArrow()
    place = {c: k for k, c in enumerate(book.column("cluster_id").to_pylist())}
    matrix = np.array(book.column("c").to_pylist(), np.float64).reshape(len(place), dim)
    shared = df.sparkSession.sparkContext.broadcast((place, matrix))
    out = T.StructType([T.StructField("id", T.LongType()), T.StructField("vec", T.ArrayType(T.DoubleType(), False))])

    def sums_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, matrix = shared.value
        for batch in batches:
            lists = batch.column(1)
            n = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(n)), n)
            at = np.array([place.get(c, -1) for c in lists.flatten().to_pylist()], np.int64)
            vec = np.zeros((len(n), dim))
            np.add.at(vec, row[at >= 0], matrix[at[at >= 0]])
            norm = np.linalg.norm(vec, axis=1)
            good = np.flatnonzero(norm > 0)
            vec = vec[good] / norm[good, None]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, vec.size + 1, dim), pa.int32()), pa.array(vec.ravel()), type=pa.list_(pa.field("element", pa.float64(), False)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(good, pa.int64())), lists], names=["id", "vec"])

    return docs.mapInArrow(sums_of, out)


def directions(vectors: DataFrame, n: int, per: int = 64, most: int = DIRECTIONS) -> np.ndarray:
    """Directions drawn from a bounded sample of the vectors: about one per ``per`` vectors, no two alike (cosine under 0.7).

    The sample is the vectors of smallest hash; it has ``most`` vectors at most, whatever the collection's size is.
    """
    want = int(min(most, max(8, math.ceil(n / per))))
    rows = vectors.select("id", "vec").orderBy(F.xxhash64("id"), "id").limit(want).toArrow()
    sample = np.array(rows.column("vec").to_pylist(), float)
    if not len(sample):
        return np.zeros((0, 1))
    kept: list[np.ndarray] = []
    for start in range(0, len(sample), 256):
        block = sample[start : start + 256]
        if kept:
            block = block[(block @ np.concatenate(kept).T).max(1) < 0.7]
        own: list[int] = []
        like = block @ block.T
        for k in range(len(block)):
            if not own or like[k, own].max() < 0.7:
                own.append(k)
        if own:
            kept.append(block[own])
    return np.concatenate(kept)


def routed(vectors: DataFrame, axes: np.ndarray, ways: int, block: int = 16_384) -> DataFrame:
    """(axis, qb, ob, query, object, id, vec): every vector in the groups of its ``ways`` strongest directions.

    A group (axis, qb, ob) has at most about ``block`` queries and ``block`` objects. The vectors of a direction with more
    are split by a hash into blocks, and every block of queries meets every block of objects in a group of its own, so
    that no pair of the direction is lost and no task holds more than two blocks.
    """
    spark = vectors.sparkSession
    shared = spark.sparkContext.broadcast(axes)  # bounded by DIRECTIONS
    ways = min(ways, len(axes))
    out = T.StructType([T.StructField("id", T.LongType()), T.StructField("vec", T.ArrayType(T.DoubleType(), False)), T.StructField("axes", T.ArrayType(T.IntegerType(), False))])

    def strongest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                part = batch.slice(start, 2048)
                x = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                along = x @ shared.value.T
                top = np.argpartition(-along, ways - 1, axis=1)[:, :ways]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, top.size + 1, ways), pa.int32()), pa.array(top.ravel(), pa.int32()), type=pa.list_(pa.field("element", pa.int32(), False)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists], names=["id", "vec", "axes"])

    # directions are found once and kept, as every vector is compared with all of them
    ways_of = cut(vectors.select("id", "vec").mapInArrow(strongest, out), "routed").select(F.explode("axes").alias("axis"), "id", "vec")
    large = {r["axis"]: math.ceil(r["n"] / block) for r in ways_of.groupBy("axis").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block).collect()}  # a row per direction at most
    if not large:
        return ways_of.select("axis", F.lit(0).alias("qb"), F.lit(0).alias("ob"), F.lit(True).alias("query"), F.lit(True).alias("object"), "id", "vec")
    many = spark.createDataFrame(list(large.items()), "axis int, blocks int")
    own = ways_of.join(F.broadcast(many), "axis", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    same = own.select("axis", F.col("own").alias("qb"), F.col("own").alias("ob"), F.lit(True).alias("query"), F.lit(True).alias("object"), "id", "vec")
    more = own.where("blocks > 1").withColumn("b", other).where("b <> own")
    asks = more.select("axis", F.col("own").alias("qb"), F.col("b").alias("ob"), F.lit(True).alias("query"), F.lit(False).alias("object"), "id", "vec")
    held = more.select("axis", F.col("b").alias("qb"), F.col("own").alias("ob"), F.lit(False).alias("query"), F.lit(True).alias("object"), "id", "vec")
    return same.unionByName(asks).unionByName(held)


def met(vectors: DataFrame, n: int, block: int = 16_384, once: bool = False) -> DataFrame:
    """(qb, ob, query, object, and the columns of ``vectors``): every block of vectors meets every block in a group of its own, so that no pair is lost.

    ``n`` is the number of vectors. A group has at most about ``block`` queries and as many objects. ``once``: two blocks meet in one of the two
    orders only, for pairs without direction. Rows are the vectors times the blocks, and pairs grow with the square of the vectors.
    """
    blocks = max(1, math.ceil(n / block), min(4, n // 1024))  # a few even of a small table, to keep cores busy
    own = vectors.withColumn("own", F.pmod(F.xxhash64("id", F.lit(3)), F.lit(blocks)).cast("int"))
    columns = vectors.columns
    same = own.select(F.col("own").alias("qb"), F.col("own").alias("ob"), F.lit(True).alias("query"), F.lit(True).alias("object"), *columns)
    more = own.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).where("b <> own")
    asks = more.select(F.col("own").alias("qb"), F.col("b").alias("ob"), F.lit(True).alias("query"), F.lit(False).alias("object"), *columns)
    held = more.select(F.col("b").alias("qb"), F.col("own").alias("ob"), F.lit(False).alias("query"), F.lit(True).alias("object"), *columns)
    out = same.unionByName(asks).unionByName(held)
    return out.where("qb <= ob") if once else out
