"""The life of an index: create, update, delete, compact, search; vectors and metadata in one versioned store.

Tables: docs(doc_idx, doc_id, codes, residuals, n_tokens, chunk), postings(cid, doc_id), postings_delta(cid, doc_id),
codec (one row), metadata (by ``_subset_`` = doc_idx). In postings, doc_id is the document's position.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import cut
from ..plans.ranks import renumbered
from ..plans.store import Store
from . import metadata as meta
from .codec import Codec, encode, train_centred, train_plain
from .corpus import unpacked
from .ivf import effective_probes, postings_of_lists
from .kmeans import default_centroids, holdout_size, partition_count, train
from .search import SearchParameters, search_quantised, search_staged

#: Documents of a chunk, and the share of pending documents (in percent) at which deltas are compacted.
CHUNK, COMPACT_AT = 25_000, 10

#: Parts of a table that updates may leave before they are merged.
PARTS = 32

#: Held-out tokens up to which the sample is drawn exactly, by an order that keeps so many a task.
HELD = 1 << 16

#: Tokens at most (those of smallest hash) whose residuals train the centred codec; each gives a row per dimension.
CODEC_TOKENS = 1 << 20


def chunk_count(documents: int) -> int:
    size = min(CHUNK, documents + 1)
    return -(-documents // size)


def needs_compaction(base: int, pending: int) -> bool:
    return base > 0 and pending * 100 / base >= COMPACT_AT


def numbered(docs: DataFrame, first: int = 0) -> DataFrame:
    """(doc_idx, doc_id, flat) in the order of doc_id, from ``first`` on."""
    return renumbered(docs.select("doc_id", "flat").withColumn("doc_idx", F.lit(0).cast("long")), ["doc_id"], "doc_idx").withColumn("doc_idx", F.col("doc_idx") + first)


def _share(tokens: DataFrame, n: int, total: int) -> DataFrame:
    """About ``n`` of the ``total`` tokens, those of smallest hash; nothing is sorted or gathered."""
    return tokens.where(F.pmod(F.xxhash64("t"), F.lit(1 << 31)) < math.ceil(n / total * (1 << 31)))


class VectorIndex:
    """A multi-vector index in a folder. Documents are (doc_id, flat); queries are (query_id, qpos, vec)."""

    def __init__(self, spark: SparkSession, path: str, dim: int | None = None):
        self.spark, self.store, self._dim = spark, Store(spark, path), dim

    # facts

    @property
    def facts(self) -> dict:
        return self.store.manifest()["facts"]

    @property
    def dim(self) -> int:
        return self.facts["dim"] if self.store.exists else self._dim

    def codec(self) -> Codec:
        row = self.store.table("codec").first()
        dim = row["dim"]
        weights = np.array(row["weights"])
        return Codec(np.array(row["centroids"]).reshape(-1, dim), np.array(row["cutoffs"]), weights.reshape(-1, dim) if row["layout"] == "nibbles" else weights, np.array(row["average"]), row["bits"], row["layout"])

    def info(self) -> DataFrame:
        """One row: documents, base documents, pending ones and their share in percent, dimension, tokens, mean length."""
        facts = self.facts
        docs = self.store.table("docs")
        pending = facts["pending"]
        out = docs.agg(F.count(F.lit(1)).alias("num_documents"), F.coalesce(F.sum(F.col("n_tokens").cast("long")), F.lit(0)).alias("num_embeddings"), F.round(F.avg("n_tokens"), 6).alias("avg_doclen"))
        return out.select(F.lit(True).alias("loaded"), "num_documents", (F.col("num_documents") - pending).alias("base_documents"), F.lit(pending).alias("pending_deltas"), F.round(F.lit(pending) * 100 / F.greatest(F.col("num_documents") - pending, F.lit(1)), 6).alias("delta_ratio_percent"), F.lit(facts["dim"]).alias("embedding_dim"), F.lit(facts["centroids"]).alias("num_partitions"), F.lit(facts["bits"]).alias("nbits"), F.lit(chunk_count(docs.count())).alias("num_chunks"), "num_embeddings", "avg_doclen")

    # building

    def create(self, docs: DataFrame, rounds: int = 4, bits: int = 4, centroids: int | None = None, codec: str = "centred", metadata: Sequence[dict] | DataFrame | None = None, per: int = 256, samples: int | None = None, held_out: int | None = None) -> VectorIndex:
        """Train on ``docs`` (on the first ``samples`` of them, if given; the plain codec on ``held_out`` tokens, 5 % and 50 000 at most by default) and write a new version of the whole index, metadata included."""
        docs = cut(numbered(docs), "docs")
        n = docs.count()
        if not n:
            raise ValueError("an index needs a document")
        if metadata is not None:
            metadata = meta.from_rows(self.spark, metadata) if not isinstance(metadata, DataFrame) else metadata
            if metadata.count() != n:
                raise ValueError(f"there are {n} documents but {metadata.count()} rows of metadata")
        if self._dim is None:
            raise ValueError("the dimension must be given")
        dim = self._dim
        tokens = cut(unpacked(docs.select(F.col("doc_idx").alias("doc_id"), "flat"), dim).select((F.col("doc_id") * (1 << 20) + F.col("pos")).alias("t"), "vec"), "tokens")
        total = tokens.count()
        want = centroids or (min(partition_count(n, total / n), total) if codec == "plain" else default_centroids(total))
        learnt = tokens if samples is None or samples >= n else cut(tokens.where(F.shiftright("t", 20) < samples), "sample")
        book = cut(train(learnt, max(1, want), rounds, normalise=codec == "plain", per=per), "book")
        if codec == "plain":
            held = held_out or max(1, holdout_size(total))
            chosen = tokens if held >= total else tokens.orderBy(F.xxhash64("t"), "t").limit(held) if held <= HELD else _share(tokens, held, total)
            trained = train_plain(chosen, book, bits)
        else:
            trained = train_centred(tokens if total <= CODEC_TOKENS else cut(_share(tokens, CODEC_TOKENS, total), "sample"), book)
        self._write(docs, trained, metadata, dim)
        return self

    def _encoded(self, docs: DataFrame, codec: Codec) -> DataFrame:
        coded = encode(docs.select(F.col("doc_idx").alias("doc_id"), "flat"), codec, "l2" if codec.layout == "nibbles" else "dot")
        out = coded.withColumnRenamed("doc_id", "doc_idx").join(docs.select("doc_idx", "doc_id"), "doc_idx")
        return out.select("doc_idx", "doc_id", "codes", "residuals", "n_tokens", F.floor(F.col("doc_idx") / CHUNK).alias("chunk"))

    def _write(self, docs: DataFrame, codec: Codec, metadata: DataFrame | None, dim: int) -> None:
        coded = cut(self._encoded(docs, codec), "encoded")
        row = self.spark.createDataFrame([(dim, codec.bits, codec.layout, codec.centroids.ravel().tolist(), codec.cutoffs.tolist(), codec.weights.ravel().tolist(), codec.average.tolist())], "dim int, bits int, layout string, centroids array<double>, cutoffs array<double>, weights array<double>, average array<double>")
        lists = postings_of_lists(coded.select(F.col("doc_idx").alias("doc_id"), "codes"))
        tables = {"docs": coded, "postings": lists.repartition("cid").sortWithinPartitions("cid", "doc_id"), "codec": row}
        drop = ["postings_delta"]
        if metadata is None:
            drop.append("metadata")
        else:
            tables["metadata"] = metadata
        self.store.commit(replace=tables, drop=tuple(drop), facts={"dim": dim, "pending": 0, "centroids": len(codec.centroids), "bits": codec.bits})

    def update(self, docs: DataFrame, metadata: Sequence[dict] | DataFrame | None = None, posting_mode: str = "all_tokens", facts: dict | None = None) -> int:
        """Add documents with the codec as it is; returns how many. Postings go to the delta, which is compacted at its threshold.

        Without ``metadata`` the rows of new documents are empty, if there is metadata at all. ``facts`` go into the manifest
        of the same commit.
        """
        old = self.store.table("docs")
        base = old.count()
        fresh = cut(numbered(docs, base), "fresh")
        n = fresh.count()
        given = n if metadata is None else metadata.count() if isinstance(metadata, DataFrame) else len(metadata)
        if given != n:
            raise ValueError(f"there are {n} documents but {given} rows of metadata")
        if not n:
            return 0
        coded = cut(self._encoded(fresh, self.codec()), "encoded")
        codes = F.col("codes") if posting_mode == "all_tokens" else F.slice("codes", 1, 1)
        delta = postings_of_lists(coded.select(F.col("doc_idx").alias("doc_id"), codes.alias("codes")))
        replace, append = {}, {"docs": coded, "postings_delta": delta}
        if self.store.has("metadata"):
            current = self.store.table("metadata")
            first = meta.next_key(current)
            if metadata is None:  # rows without values: only their numbers are written
                append["metadata"] = self.spark.range(first, first + n).select(F.col("id").alias(meta.KEY))
            elif isinstance(metadata, DataFrame):
                replace["metadata"] = cut(meta.appended(current, metadata), "metadata")
            else:
                rows = meta.from_rows(self.spark, list(metadata), first, current.schema)
                known = all(current.schema[c].dataType == rows.schema[c].dataType for c in rows.columns if c in current.columns)
                if known:
                    append["metadata"] = rows
                else:  # a column without a value so far takes a type
                    replace["metadata"] = cut(meta.extended(current, rows), "metadata")
        pending = self.facts["pending"] + n
        self.store.commit(replace=replace, append=append, facts={"pending": pending} | (facts or {}))
        if needs_compaction(base + n - pending, pending):
            self.compact()
        elif max(self.store.parts(t) for t in ("docs", "metadata", "postings_delta")) > PARTS:
            self.merge()
        return n

    def merge(self) -> None:
        """Write every table of many parts as one, so that a stream of small batches doesn't leave a part a batch."""
        self.store.commit(replace={t: self.store.table(t) for t in ("docs", "metadata", "postings_delta") if self.store.parts(t) > 1})

    def compact(self) -> None:
        """Merge the delta into the postings, and the parts of documents and metadata."""
        if not self.store.has("postings_delta"):
            return
        both = self.store.table("postings").unionByName(self.store.table("postings_delta")).distinct()
        merged = {t: self.store.table(t) for t in ("docs", "metadata") if self.store.parts(t) > 1}
        self.store.commit(replace=merged | {"postings": both.repartition("cid").sortWithinPartitions("cid", "doc_id")}, drop=("postings_delta",), facts={"pending": 0})

    def delete(self, subset: int | Iterable[int] | DataFrame) -> int:
        """Remove documents by position, of a list or of the first column of a table, and number the rest anew, vectors and metadata in one commit; returns how many went."""
        if isinstance(subset, DataFrame):
            gone = subset.select(F.col(subset.columns[0]).cast("long").alias("doc_idx")).where("doc_idx is not null").distinct()
        else:
            ids = meta.ids_of(subset, ordered=True)
            if not ids:
                return 0
            gone = meta.id_frame(self.spark, ids, "doc_idx")
        old = self.store.table("docs")
        left = cut(renumbered(old.join(gone, "doc_idx", "left_anti"), ["doc_idx"], "doc_idx").withColumn("chunk", F.floor(F.col("doc_idx") / CHUNK)), "left")
        tables = {"docs": left, "postings": postings_of_lists(left.select(F.col("doc_idx").alias("doc_id"), "codes"))}
        if self.store.has("metadata"):
            tables["metadata"] = cut(meta.deleted(self.store.table("metadata"), gone.withColumnRenamed("doc_idx", meta.KEY)), "metadata")
        n = old.count() - left.count()
        self.store.commit(replace=tables, drop=("postings_delta",), facts={"pending": 0})
        return n

    # searching

    def _subset(self, subset, queries: DataFrame) -> DataFrame | None:
        """(doc_id), or (query_id, doc_id) where there is a list per query. None is no restriction, an empty list admits nothing."""
        if subset is None:
            return None
        if isinstance(subset, DataFrame):
            names = {"doc_idx": "doc_id", meta.KEY: "doc_id"}
            return subset.select(*(F.col(c).alias(names.get(c, c)) for c in subset.columns))
        if isinstance(subset, int):
            subset = [subset]
        if subset and not isinstance(subset[0], int):
            ids = [r[0] for r in queries.select("query_id").distinct().orderBy("query_id").collect()]
            if len(ids) != len(subset):
                raise ValueError(f"there are {len(ids)} queries but {len(subset)} subsets")
            return self.spark.createDataFrame([(q, d) for q, docs in zip(ids, subset) for d in dict.fromkeys(docs)], "query_id long, doc_id long")
        return meta.id_frame(self.spark, list(subset), "doc_id")

    def search(self, queries: DataFrame, top_k: int = 10, n_full_scores: int = 4096, n_ivf_probe: int = 8, subset=None, staged: bool = True) -> DataFrame:
        """(query_id, rank, doc_idx, score) of all queries. ``staged``: the cascade; else every candidate is scored exactly."""
        codec = self.codec()
        docs = self.store.table("docs").select(F.col("doc_idx").alias("doc_id"), "codes", "residuals", "n_tokens")
        lists = self.store.table("postings")
        delta = self.store.table("postings_delta") if self.store.has("postings_delta") else None
        restrict = self._subset(subset, queries)
        probes = min(max(1, n_ivf_probe), len(codec.centroids))
        if staged:
            found = search_staged(queries, docs, codec, lists, SearchParameters(top_k, probes, n_full_scores), restrict, delta)
        else:
            found = search_quantised(queries, docs, codec, lists, effective_probes(len(codec.centroids), probes), top_k, delta, restrict).select("query_id", "rank", "doc_id", "score")
        return found.withColumnRenamed("doc_id", "doc_idx")

    def search_lists(self, queries: DataFrame, **options) -> list[list[tuple[int, float]]]:
        """Results as a list per query of (position, score); for small, stated query sets."""
        ids = [r[0] for r in queries.select("query_id").distinct().orderBy("query_id").collect()]
        rows: dict[int, list[tuple[int, float]]] = {q: [] for q in ids}
        for r in self.search(queries, **options).orderBy("query_id", "rank").collect():
            rows[r["query_id"]].append((r["doc_idx"], r["score"]))
        return [rows[q] for q in ids]

    # metadata

    @property
    def metadata(self) -> DataFrame:
        return self.store.table("metadata")

    def where(self, condition: str, parameters: Sequence = ()) -> DataFrame:
        return meta.where(self.metadata, condition, parameters)

    def get(self, condition: str | None = None, parameters: Sequence = (), subset=None) -> DataFrame:
        return meta.get(self.metadata, condition, parameters, subset)
