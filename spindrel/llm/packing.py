"""Filling containers of fixed capacity with whole texts, lexical neighbours first.

Items are routed to shards of bounded size by their most telling terms: all items are
sorted by these, and a shard is a run of them, so that lexical neighbours lie together
and a term of a third of all items fills as many shards as it needs. A shard's task
builds a BM25 inverted index of its items, with the term statistics of the whole
collection; each container is opened by the largest unused item, filled with its best
unused neighbours, and its last gap closed with the items that leave least space. Containers that stay too empty are
taken apart, and their items packed again in the shards of the next round.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.lineage import cut
from ..plans.ranks import ranked
from .tokens import count_tokens, vocabulary_size

#: Usual constants of BM25.
K1, B = 1.2, 0.75

#: The last gap of a container, in median sizes of what fits: it is closed by size, all before by the order of BM25.
LAST = 1.0

#: Terms that an item is routed by, and items at least that must have such a term.
ROUTES, SHARED = 3, 8


def document_frequencies(items: DataFrame, ids: str, size: int) -> np.ndarray:
    """In how many items each token id occurs, over all items. At most ``size`` rows (ids of the vocabulary) come to the driver."""
    rows = items.select(F.explode(F.array_distinct(ids)).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    table = np.zeros(size, np.int64)
    for batch in rows.toArrow().to_batches():
        table[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
    return table


def _routes(items: DataFrame, idf, frequency: np.ndarray) -> DataFrame:
    """(item, piece, terms): of each item the ROUTES terms with the largest tf x idf among those that SHARED items have; -1 where there are fewer."""
    shared = items.sparkSession.sparkContext.broadcast(frequency >= SHARED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.full((batch.num_rows, ROUTES), -1, np.int64)
            n = pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False)
            flat = batch.column(2).flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(n)), n)[shared.value[flat]]
            pair, tf = np.unique(row << 32 | flat[shared.value[flat]].astype(np.int64), return_counts=True)
            row, term = pair >> 32, pair & 0xFFFFFFFF
            best = np.lexsort((term, -tf * idf.value[term], row))
            row, term = row[best], term[best]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            found[row[place < ROUTES], place[place < ROUTES]] = term[place < ROUTES]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, found.size + 1, ROUTES), pa.int32()), pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], names=["item", "piece", "terms"])

    return items.select("item", "piece", "ids").mapInArrow(run, "item long, piece int, terms array<long>")


class Shard:
    """The inverted index of some items, of which a used one is passed over."""

    def __init__(self, sizes: np.ndarray, terms: list[np.ndarray], idf: np.ndarray, mean_size: float):
        self.sizes = sizes
        self.unused = np.ones(len(sizes), bool)
        lengths = np.fromiter((len(x) for x in terms), np.int64, len(terms))
        item = np.repeat(np.arange(len(terms)), lengths)
        flat = np.concatenate(terms) if len(terms) else np.zeros(0, np.int64)
        pair, tf = np.unique(flat.astype(np.int64) * len(terms) + item, return_counts=True)
        term, self.item = pair // max(1, len(terms)), pair % max(1, len(terms))
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[self.item] / mean_size))
        self.weight = weight
        self.words, self.starts = np.unique(term, return_index=True)
        self.ends = np.append(self.starts[1:], len(term))
        order = np.argsort(self.item, kind="stable")
        self.own = np.split(term[order], np.cumsum(np.bincount(self.item, minlength=len(terms)))[:-1])

    def neighbours(self, seed: int) -> np.ndarray:
        """BM25 scores of all items for the terms of the seed."""
        at = np.searchsorted(self.words, self.own[seed])
        starts, n = self.starts[at], self.ends[at] - self.starts[at]
        rows = np.repeat(starts - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        return np.bincount(self.item[rows], self.weight[rows], len(self.sizes))

    def fill(self, capacity: int) -> list[list[int]]:
        """Containers of item numbers; every item is in exactly one."""
        containers = []
        for seed in np.argsort(-self.sizes, kind="stable"):
            if not self.unused[seed]:
                continue
            self.unused[seed] = False
            inside, gap = [int(seed)], capacity - int(self.sizes[seed])
            candidates = np.flatnonzero(self.unused & (self.sizes <= gap))
            if len(candidates):
                scores = self.neighbours(int(seed))
                candidates = candidates[np.lexsort((candidates, -scores[candidates]))]
                typical = float(np.median(self.sizes[candidates]))
                for item in candidates:
                    if gap <= LAST * typical:
                        break
                    if self.sizes[item] <= gap:
                        inside.append(int(item))
                        self.unused[item] = False
                        gap -= int(self.sizes[item])
                self.close(inside, gap, scores)
            containers.append(inside)
        return containers

    def close(self, inside: list[int], gap: int, scores: np.ndarray) -> None:
        """Fill the rest: again and again the two items (or one) that leave least space, of equal sizes the best neighbour."""
        while True:
            left = np.flatnonzero(self.unused & (self.sizes <= gap))
            if not len(left):
                return
            sizes, counts = np.unique(self.sizes[left], return_counts=True)
            partner = np.searchsorted(sizes, gap - sizes, side="right") - 1
            partner = np.where((partner >= 0) & (sizes[partner] == sizes) & (counts < 2), partner - 1, partner)
            total = sizes + np.where(partner >= 0, sizes[partner], 0)
            first = int(np.argmax(total))
            for size in [sizes[first], *([sizes[partner[first]]] if partner[first] >= 0 else [])]:
                same = left[(self.sizes[left] == size) & self.unused[left]]
                item = int(same[np.lexsort((same, -scores[same]))[0]])
                inside.append(item)
                self.unused[item] = False
                gap -= int(size)


def pack(df: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = 1024, shard_items: int = 2048, full: float = 0.985, rounds: int = 4, vocabulary: str | None = None) -> DataFrame:
    """(key, piece, tokens, container, unused): the container of every text, or of every piece of a text longer than one.

    ``tokens`` is the size of the row's piece, ``unused`` the space left in its container. A text longer than the
    capacity is cut into pieces that fill containers of their own, and a rest that is packed like a text. Null and
    empty texts have no tokens and are not placed. Repeated keys are items of their own (their containers may differ),
    ties go to the smaller key; an empty table gives no rows. Shards are runs of ``shard_items`` items in the order of
    their most telling terms, so no group of like texts can make a large one. In each round but the last,
    containers filled less than ``full`` are taken apart; the next round sorts by another of the terms.
    """
    spark = df.sparkSession
    kind = df.schema[key].dataType
    encoded = count_tokens(df.select(F.col(key).alias("key"), F.col(text).alias("text")), into="size", ids="ids", vocabulary=vocabulary).where("size > 0")
    encoded = encoded.withColumn("item", F.xxhash64(F.monotonically_increasing_id(), "key"))
    encoded = cut(encoded, "pack")  # item numbers must not change when a task is run again
    size = vocabulary_size(vocabulary)
    n, total, long = encoded.agg(F.count(F.lit(1)), F.sum("size"), F.sum((F.col("size") > capacity).cast("int"))).first()
    schema = T.StructType([T.StructField("key", kind), T.StructField("piece", T.IntegerType()), T.StructField("tokens", T.IntegerType()), T.StructField("container", T.LongType()), T.StructField("unused", T.IntegerType())])
    named = lambda x: x.select(F.col("key").alias(key), "piece", "tokens", "container", "unused")
    if not n:
        return named(spark.createDataFrame([], schema))
    frequency = document_frequencies(encoded, "ids", size)
    idf = np.log1p((n - frequency + 0.5) / (frequency + 0.5)).astype(np.float32)
    shared = spark.sparkContext.broadcast(idf)  # a number per id of the vocabulary
    mean_size = total / n

    pieces = F.col("size").cast("int") / F.lit(capacity)
    whole = encoded.where(F.col("size") > capacity).select("key", "item", F.explode(F.sequence(F.lit(0), F.floor(pieces).cast("int") - 1)).alias("piece"))
    # the space of container numbers: whole pieces get negative ones
    whole = whole.select("key", "piece", F.lit(capacity).alias("tokens"), (-F.abs(F.shiftright(F.xxhash64("item", "piece"), 1)) - 1).alias("container"), F.lit(0).alias("unused"))
    rest = encoded.select(
        "key", "item",
        F.when(F.col("size") > capacity, F.floor(pieces).cast("int")).otherwise(0).alias("piece"),
        F.when(F.col("size") > capacity, F.col("size") % capacity).otherwise(F.col("size")).cast("int").alias("tokens"),
        F.when(F.col("size") > capacity, F.slice("ids", F.floor(pieces).cast("int") * capacity + 1, F.lit(capacity))).otherwise(F.col("ids")).alias("ids"),
    ).where("tokens > 0")

    def packer(last: bool, level: int):
        out = T.StructType([*schema.fields, T.StructField("item", T.LongType())])

        def run(group: tuple, items: pd.DataFrame) -> pd.DataFrame:
            items = items.sort_values(["key", "item"]).reset_index(drop=True)
            sizes = items["tokens"].to_numpy(np.int64)
            shard = Shard(sizes, [np.asarray(x, np.int64) for x in items["ids"]], shared.value, mean_size)
            number, space = np.zeros(len(items), np.int64), np.zeros(len(items), np.int64)
            for k, inside in enumerate(shard.fill(capacity)):
                gap = capacity - int(sizes[inside].sum())
                kept = last or gap <= (1 - full) * capacity
                number[inside] = (level << 56) + (int(group[0]) << 16) + k if kept else -1
                space[inside] = gap
            return pd.DataFrame({"key": items["key"], "piece": items["piece"], "tokens": items["tokens"], "container": number, "unused": space.astype(np.int32), "item": items["item"]})

        return run, out

    routes = cut(_routes(rest, shared, frequency), "routes")
    done, open_items, left = [whole] if long else [], rest, n
    for level in range(rounds):
        shards = max(1, math.ceil(left / shard_items))
        last = level == rounds - 1 or shards == 1
        run, out = packer(last, level)
        if shards == 1:
            shard = open_items.withColumn("shard", F.lit(0).cast("long"))
        else:
            order = [F.col("terms")[(level + j) % ROUTES] for j in range(ROUTES)]
            places = ranked(routes.join(open_items.select("item", "piece"), ["item", "piece"], "left_semi"), [*order, "item", "piece"], into="place")
            shard = open_items.join(places.select("item", "piece", F.floor(F.col("place") / shard_items).alias("shard")), ["item", "piece"])
        placed = shard.groupBy("shard").applyInPandas(run, out)
        if not last:
            placed = cut(placed, "packed")
        done.append(placed.where("container >= 0").select("key", "piece", "tokens", "container", "unused"))
        if last:
            break
        again = placed.where("container < 0").select("item", "piece")
        left = again.count()
        if not left:
            break
        open_items = open_items.join(again, ["item", "piece"], "left_semi")
    result = done[0]
    for part in done[1:]:
        result = result.unionByName(part)
    return named(result)
