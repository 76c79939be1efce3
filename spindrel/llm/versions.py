"""Near-duplicate records by multi-index hashing of word fingerprints.

A fingerprint is a code of symbols: symbol by symbol the word that comes first in a random
order of all words, of which common ones come early less often. Two records agree in a symbol with the probability of
the (weighted) share of words that they have in common. The code is cut into segments, each with a table of its own;
records that agree in a whole segment meet there and are verified by the complete Hamming distance of a bit per symbol,
then by the words themselves. Segments have as many symbols as the number of records asks for, and there are the more of
them, the longer they are, so that like records still meet. Tables take a few numbers a record; words are read
again for the records of pairs that are near, and never kept. Records of equal words are one class, whose least id stands for it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.lineage import cut
from ..plans.spread import spread
from .graph import components

#: Share of symbols in which records agree that share 75 % of their words, probability that such a pair meets in no table, and symbols of a segment at least.
AGREE, MISS, LEAST = 0.6, 0.005, 3

#: Unrelated records that a record meets in a table at most, when of n records n x 10 ** -(symbols + 0.5) agree in a segment (measured at 3 to 5 symbols).
STRANGERS = 300

#: Words beyond this share of all records count less in the fingerprint, by the root of how much they are beyond it.
COMMON = 0.01

#: Bits of the complete distance, and in how many of them records may differ that share 75 % of their words: 0.2 of them on average, with room for chance.
BITS, DIFFER = 160, 52

#: Cells (words x symbols) whose values are held at a time.
CELLS = 1 << 23

#: Keys whose rows are counted at a time.
COUNTED = 1 << 22

#: Rows of a table key at most that meet in one place; keys with more are split.
HOT = 2_000


def words(*texts: Column) -> Column:
    """The longest runs of a-z and 0-9 of the lower-cased texts, joined by blanks."""
    return F.regexp_extract_all(F.lower(F.concat_ws(" ", *texts)), F.lit("[a-z0-9]+"), F.lit(0))


def layout(n: int) -> tuple[int, int]:
    """(segments, symbols of a segment) for ``n`` classes: a table key is shared by few unrelated classes, whatever their number, and like ones meet but for MISS."""
    symbols = max(LEAST, math.ceil(math.log10(max(1, n) / STRANGERS) - 0.5))
    return math.ceil(math.log(MISS) / math.log1p(-(AGREE**symbols))), symbols


def _mixed(x: np.ndarray) -> np.ndarray:
    """64 random bits for each number, the same in every task."""
    with np.errstate(over="ignore"):
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def _symbols(flat: np.ndarray, lengths: np.ndarray, common: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    """(rows x n) symbols of the lists of sorted word hashes; a word that repeats is another one each time."""
    begins = np.cumsum(lengths) - lengths
    at = np.arange(len(flat))
    new = np.append(True, flat[1:] != flat[:-1])
    new[begins] = True
    before = (at - np.maximum.accumulate(np.where(new, at, 0))).astype(np.uint64)
    with np.errstate(over="ignore"):
        element = flat.view(np.uint64) + before * np.uint64(0xD6E8FEB86659FD93)
    element, first, place = np.unique(element, return_index=True, return_inverse=True)
    rate = np.ones(len(element), np.float32)
    if len(common):
        k = np.minimum(np.searchsorted(common, flat[first]), len(common) - 1)
        known = common[k] == flat[first]
        rate[known] = weights[k[known]]
    out = np.empty((len(lengths), n), np.uint32)
    step = max(1, CELLS // len(flat))
    for lane in range(0, n, step):
        lanes = np.arange(lane, min(lane + step, n), dtype=np.uint64)
        with np.errstate(over="ignore"):
            u = _mixed(element[:, None] + (lanes + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
        # exponential times: the first of several words is each in proportion to its rate
        times = -np.log(((u >> np.uint64(40)).astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-24)) / rate[:, None]
        times = (times.view(np.uint32) & np.uint32(0xFFFFFF00)) | (u & np.uint64(0xFF)).astype(np.uint32)  # order by time, the last bits tell words apart
        out[:, lane : lane + len(lanes)] = np.minimum.reduceat(times[place], begins, axis=0)
    return out


def fingerprints(rows: DataFrame, common: np.ndarray, weights: np.ndarray, segments: int, symbols: int) -> DataFrame:
    """The columns of ``rows`` (words, sorted hashes, last) without the words, and (keys, f0, f1, f2): a key of every segment, and a bit per symbol.

    A row without words has keys of 0; its number of words says so.
    """
    kept = rows.columns[:-1]
    out = T.StructType([*rows.select(kept).schema.fields, T.StructField("keys", T.ArrayType(T.IntegerType(), False)), T.StructField("f0", T.LongType()), T.StructField("f1", T.LongType()), T.StructField("f2", T.IntegerType())])
    lanes = max(BITS, segments * symbols)

    def parts(lengths: np.ndarray) -> Iterator[slice]:
        """Runs of rows of about so many words as are held at a time."""
        ends, start = np.cumsum(lengths), 0
        while start < len(lengths):
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + CELLS // lanes, "right")))
            yield slice(start, stop)
            start = stop

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(len(kept))
            lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            begins = np.cumsum(lengths) - lengths
            keys, bits = np.zeros((len(lengths), segments), np.int32), np.zeros((len(lengths), BITS), bool)
            for part in parts(lengths):
                some = np.flatnonzero(lengths[part]) + part.start
                if not len(some):
                    continue
                found = _symbols(flat[begins[some[0]] : begins[some[-1]] + lengths[some[-1]]], lengths[some], common, weights, lanes)
                key = np.repeat(np.arange(segments, dtype=np.uint64)[None, :], len(some), 0)
                for j in range(symbols):
                    with np.errstate(over="ignore"):
                        key = _mixed(key * np.uint64(0x9E3779B97F4A7C15) + found[:, j : segments * symbols : symbols])
                keys[some] = (key & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)
                bits[some] = (_mixed(found[:, :BITS].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) & np.uint64(1)).astype(bool)
            packed = np.packbits(bits, axis=1)
            longs, last = np.ascontiguousarray(packed[:, :16]).view(np.int64), np.ascontiguousarray(packed[:, 16:20]).view(np.int32)
            listed = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, segments), pa.int32()), pa.array(keys.ravel()), type=pa.list_(pa.field("element", pa.int32(), False)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], listed, pa.array(longs[:, 0]), pa.array(longs[:, 1]), pa.array(last[:, 0])], names=out.names)

    return rows.mapInArrow(run, out)


def hot_keys(prints: DataFrame, hot: int) -> DataFrame:
    """(key, parts) of keys that more than ``hot`` rows share. Counts begin where the rows are read: only keys that a task sees often are shuffled."""
    often = max(2, hot // (4 * max(1, prints.rdd.getNumPartitions())))

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                key, n = np.unique(np.concatenate(held), return_counts=True)
                held.clear()
                yield pa.RecordBatch.from_arrays([pa.array(key[n >= often]), pa.array(n[n >= often].astype(np.int64))], names=["key", "n"])

        for batch in batches:
            held.append(batch.column(0).flatten().to_numpy(zero_copy_only=False))
            if sum(map(len, held)) > COUNTED:
                yield from flush()
        yield from flush()

    counted = prints.select("keys").mapInArrow(counts, "key int, n long").groupBy("key").agg(F.sum("n").alias("c"))
    return counted.where(F.col("c") > hot).select("key", F.ceil(F.col("c") / hot).cast("int").alias("parts"))


def hamming_pairs(prints: DataFrame, share: float = 0.75) -> DataFrame:
    """(a, b), a < b: classes of (rep, n, keys, f0, f1, f2) that meet in a table, whose lengths allow them to share so many words, and whose fingerprints are near enough.

    The tables' rows are shuffled once, for both sides.
    """
    bits = ("f0", "f1", "f2")
    hot = cut(hot_keys(prints, HOT), "hot")
    table = prints.select("rep", "n", *bits, F.posexplode("keys").alias("s", "key"))
    on = ["key", "s"]
    if not hot.isEmpty():
        # the rows of a key that very many classes share are dealt out; every two parts meet in a place of their own
        on += ["p1", "p2"]
        parts = F.coalesce("parts", F.lit(1))
        table = table.join(F.broadcast(hot), "key", "left").withColumn("part", F.pmod(F.xxhash64("rep"), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
        table = table.select("rep", "n", *bits, "s", "key", "part", F.least("part", "other").alias("p1"), F.greatest("part", "other").alias("p2"))
    x, y = table.alias("x"), table.alias("y")
    match = (F.col("x.rep") < F.col("y.rep")) & (F.least("x.n", "y.n") >= F.lit(share) * F.greatest("x.n", "y.n"))
    # bit_count widens integers with their sign
    match = match & (sum((F.bit_count(F.col(f"x.{c}").bitwiseXOR(F.col(f"y.{c}")).bitwiseAND(F.lit(-1 if c != "f2" else 0xFFFFFFFF).cast("long"))) for c in bits), F.lit(0)) <= DIFFER)
    for c in on:
        match = match & (F.col(f"x.{c}") == F.col(f"y.{c}"))
    if len(on) > 2:
        match = match & ((F.col("x.part") != F.col("y.part")) | (F.col("x.p1") == F.col("x.p2")))
    return x.join(y.hint("shuffle_hash"), match).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct()


def numbered_words(hashes: Column) -> Column:
    """The sorted hashes, those that repeat with how often they came before, so that shared values are shared words, repeats included."""
    place = lambda x, i: F.when((i > 0) & (F.element_at(hashes, F.greatest(i, F.lit(1)).cast("int")) == x), F.xxhash64(x, i - F.array_position(hashes, x) + 1)).otherwise(x)
    return F.transform(hashes, place)


def _usable() -> Column:
    """Whether a delivery (x, y) can take part."""
    return (F.length("x") > 0) & (F.length("y") > 0)


def _hashes() -> Column:
    """The sorted hashes of the words of (x, y); none of a delivery that can't take part."""
    return F.when(_usable(), F.sort_array(F.transform(words(F.col("x"), F.col("y")), lambda w: F.xxhash64(w))))


class Versions:
    """Versions of records: classes of equal words, links between classes, groups of linked classes.

    A record is an id of ``df``, by its latest delivery; its words are those of ``first`` and ``second``. Rows with a null
    id, or a null or empty text in one of the two, or without any word take no part. An empty table gives no rows.
    ``share``: of the words of the longer record, how many the shorter must share.
    """

    def __init__(self, df: DataFrame, key: str = "id", first: str = "title", second: str = "abstract", at: str = "ingested_at", share: float = 0.75):
        self.share = share
        rows = df.select(F.col(key).cast("long").alias("id"), F.col(at).alias("at"), F.col(first).alias("x"), F.col(second).alias("y")).where("id is not null")
        self.texts = spread(rows)
        hashed = self.texts.select("id", "at", _hashes().alias("words"))
        n = rows.where(_usable()).count()
        seen = hashed.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > COMMON * n).toArrow().sort_by("word")  # at most the words of 1 / COMMON records
        common, weights = seen.column("word").to_numpy(), np.sqrt(COMMON * n / seen.column("c").to_numpy()).astype(np.float32)
        told = hashed.select("id", "at", F.xxhash64("words").alias("h"), F.hash("words").alias("g"), F.coalesce(F.size("words"), F.lit(-1)).alias("n"), "words")
        printed = fingerprints(told, common, weights, *layout(n))
        latest = printed.groupBy("id").agg(F.max_by(F.struct("at", "h", "g", "n", "keys", "f0", "f1", "f2"), F.struct("at", "h")).alias("r")).select("id", "r.*").where("n > 0")
        self.records = cut(latest, "records")
        classes = self.records.groupBy("h", "g", "n").agg(F.min_by(F.struct("id", "at", "keys", "f0", "f1", "f2"), "id").alias("r"), F.count(F.lit(1)).alias("copies"))
        self.classes = cut(classes.select("h", "g", "n", "copies", F.col("r.id").alias("rep"), "r.at", "r.keys", "r.f0", "r.f1", "r.f2"), "classes")
        self.members = self.records.select("id", "h", "g", "n").join(self.classes.select("h", "g", "n", "rep", "copies"), ["h", "g", "n"]).select("id", "rep", "copies")

    def links(self) -> DataFrame:
        """(a, b, shared), a < b: representatives of classes whose share of words is large enough."""
        found = cut(hamming_pairs(self.classes.select("rep", "n", "keys", "f0", "f1", "f2"), self.share), "near")
        # the words of the records in question are read again, by the delivery that counts
        asked = found.select(F.col("a").alias("rep")).union(found.select(F.col("b").alias("rep"))).distinct().join(self.classes.select("rep", "at", "h"), "rep")
        asked = asked.select(F.col("rep").alias("id"), F.col("at").alias("t"), F.col("h"))
        again = self.texts.join(asked, "id").where(F.col("at").eqNullSafe(F.col("t"))).select("id", "h", _hashes().alias("words")).where(F.xxhash64("words") == F.col("h"))
        held = cut(again.groupBy("id").agg(F.first("words").alias("words")), "words")
        words = lambda c: held.select(F.col("id").alias(c), numbered_words(F.col("words")).alias(f"w{c}"))
        both = found.join(words("a"), "a").join(words("b"), "b")
        shared = both.select("a", "b", (F.size(F.array_intersect("wa", "wb")) / F.greatest(F.size("wa"), F.size("wb"))).alias("shared"))
        return shared.where(F.col("shared") >= self.share)

    def pairs(self) -> DataFrame:
        """(id_a, id_b), id_a < id_b: all records of linked classes, and of one class."""
        links = cut(self.links().select("a", "b"), "links")
        mine, other = self.members.select(F.col("id").alias("i"), F.col("rep").alias("a")), self.members.select(F.col("id").alias("j"), F.col("rep").alias("b"))
        across = links.join(mine, "a").join(other, "b").select("i", "j")
        # the copies of a class are split, so that no task pairs all of a large one
        copies = self.members.where("copies > 1").withColumn("parts", F.ceil(F.col("copies") / HOT).cast("int"))
        some = copies.select(F.col("id").alias("i"), "rep", F.pmod(F.xxhash64("id"), "parts").cast("int").alias("part"))
        all_ = copies.select(F.col("id").alias("j"), "rep", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        within = some.join(all_, ["rep", "part"]).where("i < j").select("i", "j")
        return across.unionByName(within).select(F.least("i", "j").alias("id_a"), F.greatest("i", "j").alias("id_b"))

    def groups(self) -> DataFrame:
        """(id, class_id, group_id, links): every record with its class, the least id of its group of versions, and the number of classes that its class is linked to."""
        links = cut(self.links().select("a", "b"), "links")
        found = components(links)
        degree = links.select(F.col("a").alias("rep")).unionByName(links.select(F.col("b").alias("rep"))).groupBy("rep").agg(F.count(F.lit(1)).alias("links"))
        joined = self.members.join(found.withColumnRenamed("node", "rep"), "rep", "left").join(degree, "rep", "left")
        return joined.select("id", F.col("rep").alias("class_id"), F.coalesce("component", "rep").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
