"""Binary files of embeddings and of indexes. All numbers are little-endian.

Files are read whole, one per task, and become rows at once; larger collections are kept in Parquet.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.codec import Codec

#: Fixed values of the file format: its first bytes and version.
MAGIC, VERSION = b"FPQZ", 1


class Reader:
    """Takes arrays from the front of a buffer."""

    def __init__(self, raw: bytes):
        self.raw, self.at = raw, 0

    def take(self, kind: str, n: int | None = None):
        dtype = np.dtype(kind).newbyteorder("<")
        size = dtype.itemsize * (1 if n is None else n)
        if self.at + size > len(self.raw):
            raise ValueError("the file ends within a value")
        out = np.frombuffer(self.raw, dtype, 1 if n is None else n, self.at)
        self.at += size
        return out[0].item() if n is None else out

    def bytes(self, n: int) -> bytes:
        return self.take("u1", n).tobytes()


def write_embeddings(docs: list[np.ndarray]) -> bytes:
    """Counted documents: number, dimension, then per document its tokens and values."""
    dim = docs[0].shape[1] if docs else 0
    return struct.pack("<II", len(docs), dim) + b"".join(struct.pack("<I", len(d)) + d.astype("<f4").tobytes() for d in docs)


def parse_embeddings(raw: bytes) -> tuple[int, list[np.ndarray]]:
    r = Reader(raw)
    n, dim = r.take("u4"), r.take("u4")
    return dim, [r.take("f4", r.take("u4") * dim).reshape(-1, dim) for _ in range(n)]


def parse_uniform_embeddings(raw: bytes) -> tuple[int, list[np.ndarray]]:
    """Documents of one length: number, tokens of each, dimension, then all values."""
    r = Reader(raw)
    n, tokens, dim = r.take("i4"), r.take("i4"), r.take("i4")
    return dim, list(r.take("f4", n * tokens * dim).reshape(n, tokens, dim))


def write_uniform_embeddings(docs: list[np.ndarray]) -> bytes:
    """Documents of one length, which are written without a count of their own."""
    shape = docs[0].shape if docs else (0, 0)
    if any(d.shape != shape for d in docs):
        raise ValueError("the documents must have equally many tokens")
    return struct.pack("<iii", len(docs), *shape) + b"".join(d.astype("<f4").tobytes() for d in docs)


def embedding_blobs(docs: DataFrame, dim: int, per: int = 4096, uniform: bool = False) -> DataFrame:
    """(path, content): packed documents (doc_id, flat) as files of ``per`` documents at most, each made in one task. ``uniform``: in the layout of documents of one length.

    A file's documents are in the order of their ids, which the path tells apart by the first of them.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            frame = frame.sort_values("doc_id")
            for start in range(0, len(frame), per):
                part = frame.iloc[start : start + per]
                content = (write_uniform_embeddings if uniform else write_embeddings)([np.asarray(x, np.float32).reshape(-1, dim) for x in part["flat"]])
                yield pd.DataFrame({"path": [f"embeddings-{part['doc_id'].iloc[0]}.bin"], "content": [content], "ids": [part["doc_id"].to_numpy()]})

    return docs.where("flat is not null").select(F.col("doc_id").cast("long"), "flat").mapInPandas(run, "path string, content binary, ids array<long>")


def write_blobs(files: DataFrame, folder: str) -> list[str]:
    """Write (path, content) rows as files, one at a time; returns their paths."""
    spark = files.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    done = []
    for row in files.select("path", "content").toLocalIterator():
        place = hadoop.Path(f"{folder.rstrip('/')}/{row['path']}")
        out = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(place, True)
        out.write(bytes(row["content"]))
        out.close()
        done.append(place.toString())
    return done


def embeddings_of(files: DataFrame, uniform: bool = False) -> DataFrame:
    """(path, ord, n_tokens, dim, flat): a row per document of the files (path, content)."""
    parse = parse_uniform_embeddings if uniform else parse_embeddings

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, raw in zip(batch["path"], batch["content"]):
                dim, docs = parse(bytes(raw))
                for start in range(0, len(docs), 4096):
                    part = docs[start : start + 4096]
                    yield pd.DataFrame({"path": path, "ord": np.arange(start, start + len(part)), "n_tokens": [len(d) for d in part], "dim": dim, "flat": [d.ravel() for d in part]})

    return files.select("path", "content").mapInPandas(run, "path string, ord long, n_tokens int, dim int, flat array<float>")


def read_embeddings(spark: SparkSession, path: str, uniform: bool = False) -> DataFrame:
    """``embeddings_of`` stored files."""
    return embeddings_of(_stored(spark, path), uniform)


def _stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def write_index(dim: int, centroids: np.ndarray, lists: list[list[int]], codebook: np.ndarray, average: np.ndarray, cutoffs: np.ndarray, weights: np.ndarray, docs: list[tuple[int, list[int], bytes]]) -> bytes:
    """A quantised index: centroids and inverted lists, the codec with infinite outer cutoffs, documents with codes and residuals.

    The format keeps a code in one byte; a larger code is refused.
    """
    if any(c > 255 for _, codes, _ in docs for c in codes):
        raise ValueError("the format holds 256 centroids at most")
    out = [MAGIC, struct.pack("<IIII", VERSION, dim, len(docs), len(lists)), centroids.astype("<f4").tobytes()]
    out += [struct.pack("<I", len(x)) + np.array(x, "<u4").tobytes() for x in lists]
    ends = np.concatenate([[-np.inf], cutoffs, [np.inf]])
    out += [struct.pack("<I", len(codebook)), codebook.astype("<f4").tobytes(), average.astype("<f4").tobytes(), ends.astype("<f4").tobytes(), weights.astype("<f4").tobytes()]
    for doc_id, codes, residuals in docs:
        out += [struct.pack("<qII", doc_id, len(codes), len(codes)), bytes(codes), struct.pack("<I", len(residuals)), residuals]
    return b"".join(out)


def index_size(dim: int, clusters: int, listed: int, tokens: list[int], codebook: int | None = None) -> int:
    """Bytes of the written index: ``listed`` entries in all lists, ``tokens`` of each document."""
    k = clusters if codebook is None else codebook
    return 20 + 4 * clusters * dim + 4 * clusters + 4 * listed + 4 + 4 * k * dim + 4 * dim + 68 + 64 * dim + sum(20 + t + (t * dim + 1) // 2 for t in tokens)


def parse_index(raw: bytes) -> dict:
    r = Reader(raw)
    if r.bytes(4) != MAGIC:
        raise ValueError("this is no index file")
    if (version := r.take("u4")) != VERSION:
        raise ValueError(f"version {version} isn't known")
    dim, n, clusters = r.take("u4"), r.take("u4"), r.take("u4")
    out = {"dim": dim, "centroids": r.take("f4", clusters * dim).reshape(clusters, dim)}
    out["lists"] = [r.take("u4", r.take("u4")).tolist() for _ in range(clusters)]
    k = r.take("u4")
    out |= {"codebook": r.take("f4", k * dim).reshape(k, dim), "average": r.take("f4", dim), "cutoffs": r.take("f4", 17)[1:-1], "weights": r.take("f4", 16 * dim).reshape(16, dim)}
    docs = []
    for _ in range(n):
        doc_id, tokens = r.take("i8"), r.take("u4")
        codes = r.take("u1", r.take("u4")).tolist()
        docs.append({"doc_id": doc_id, "n_tokens": tokens, "codes": codes, "residuals": r.bytes(r.take("u4"))})
    return out | {"docs": docs}


def parse_minmax_index(raw: bytes) -> dict:
    """The older 4-bit index: least and largest value per dimension, one continuous stream of nibbles, low half first."""
    r = Reader(raw)
    tokens, dim, papers, clusters = (r.take("u4") for _ in range(4))
    out = {"dim": dim, "low": r.take("f4", dim), "high": r.take("f4", dim), "boundaries": r.take("u4", papers + 1), "centroids": r.take("f4", clusters * dim).reshape(clusters, dim), "labels": r.take("u2", papers)}
    out["lists"] = [r.take("u4", r.take("u4")).tolist() for _ in range(clusters)]
    stream = r.take("u1", (tokens * dim + 1) // 2)
    levels = np.stack([stream & 15, stream >> 4], 1).ravel()[: tokens * dim].reshape(tokens, dim)
    out["vectors"] = levels / 15 * (out["high"] - out["low"]) + out["low"]
    return out


def write_minmax_index(low: np.ndarray, high: np.ndarray, docs: list[np.ndarray]) -> bytes:
    """The older 4-bit index of documents (tokens, dim), in one cluster that lists them all: levels of 0 to 15 between the least and largest value per dimension."""
    ends = np.cumsum([0, *(len(d) for d in docs)])
    tokens = np.concatenate(docs) if docs else np.zeros((0, len(low)))
    levels = np.floor((tokens - low) / np.where(high > low, high - low, 1) * 15).astype(np.uint8).ravel()
    levels = np.pad(levels, (0, len(levels) % 2))
    lists = struct.pack("<I", len(docs)) + np.arange(len(docs), dtype="<u4").tobytes()
    head = struct.pack("<IIII", len(tokens), len(low), len(docs), 1) + low.astype("<f4").tobytes() + high.astype("<f4").tobytes() + ends.astype("<u4").tobytes()
    return head + np.zeros(len(low), "<f4").tobytes() + np.zeros(len(docs), "<u2").tobytes() + lists + (levels[::2] | levels[1::2] << 4).tobytes()


def minmax_blobs(docs: DataFrame, ends: DataFrame, dim: int, per: int = 25_000) -> DataFrame:
    """(path, content, ids): packed documents (doc_id, flat) as older 4-bit files; ``ends`` (d, low, high) has a row per dimension."""
    rows = {r["d"]: r for r in ends.collect()}
    low, high = (np.array([rows[d][c] for d in range(dim)]) for c in ("low", "high"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for start in range(0, len(frame), per):
                part = frame.iloc[start : start + per].sort_values("doc_id")
                content = write_minmax_index(low, high, [np.asarray(x, np.float64).reshape(-1, dim) for x in part["flat"]])
                yield pd.DataFrame({"path": [f"minmax-{part['doc_id'].iloc[0]}.bin"], "content": [content], "ids": [part["doc_id"].to_numpy()]})

    return docs.where("flat is not null").select(F.col("doc_id").cast("long"), "flat").mapInPandas(run, "path string, content binary, ids array<long>")


def index_blobs(encoded: DataFrame, codec: Codec, per: int = 25_000) -> DataFrame:
    """(path, content): encoded documents (doc_id, codes, residuals, n_tokens) as index files of about ``per`` documents.

    Each file has the codec, the centroids and the inverted lists of its own documents, and is made in one task.
    """
    n = max(1, -(-encoded.count() // per))
    shared = encoded.sparkSession.sparkContext.broadcast(codec)

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        codec = shared.value
        frame = frame.sort_values("doc_id")
        docs = [(int(i), list(map(int, c)), bytes(r)) for i, c, r in zip(frame["doc_id"], frame["codes"], frame["residuals"])]
        lists: list[list[int]] = [[] for _ in range(len(codec.centroids))]
        for place, (_, codes, _) in enumerate(docs):
            for c in sorted(set(codes)):
                lists[c].append(place)
        content = write_index(codec.centroids.shape[1], codec.centroids, lists, codec.centroids, codec.average, codec.cutoffs, codec.weights, docs)
        return pd.DataFrame({"path": [f"index-{key[0]:06d}.bin"], "content": [content]})

    rows = encoded.where("codes is not null and residuals is not null").select("doc_id", "codes", "residuals", F.pmod(F.xxhash64("doc_id"), F.lit(n)).alias("part"))
    return rows.groupBy("part").applyInPandas(run, "path string, content binary")


def _parsed(files: DataFrame, parse: Callable[[str, bytes], pd.DataFrame], schema: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, raw in zip(batch["path"], batch["content"]):
                yield parse(path, bytes(raw))

    return files.select("path", "content").mapInPandas(run, schema)


def index_documents_of(files: DataFrame) -> DataFrame:
    """(path, doc_id, n_tokens, codes, residuals) of the quantised index files (path, content)."""

    def parse(path: str, raw: bytes) -> pd.DataFrame:
        return pd.DataFrame([{"path": path, **d} for d in parse_index(raw)["docs"]], columns=["path", "doc_id", "n_tokens", "codes", "residuals"])

    return _parsed(files, parse, "path string, doc_id long, n_tokens int, codes array<int>, residuals binary")


def read_index_documents(spark: SparkSession, path: str) -> DataFrame:
    """``index_documents_of`` stored files."""
    return index_documents_of(_stored(spark, path))


def read_index_postings(spark: SparkSession, path: str) -> DataFrame:
    """(path, cid, doc_id): the inverted lists of quantised index files; doc_id is the place of a document in its file."""

    def parse(path: str, raw: bytes) -> pd.DataFrame:
        return pd.DataFrame([(path, c, d) for c, x in enumerate(parse_index(raw)["lists"]) for d in x], columns=["path", "cid", "doc_id"])

    return _parsed(_stored(spark, path), parse, "path string, cid long, doc_id long")


def minmax_documents_of(files: DataFrame) -> DataFrame:
    """(path, doc_id, label, flat) of older index files (path, content), by the boundaries of their token stream."""

    def parse(path: str, raw: bytes) -> pd.DataFrame:
        x = parse_minmax_index(raw)
        ends = x["boundaries"]
        return pd.DataFrame([(path, i, int(x["labels"][i]), x["vectors"][a:b].ravel()) for i, (a, b) in enumerate(zip(ends, ends[1:]))], columns=["path", "doc_id", "label", "flat"])

    return _parsed(files, parse, "path string, doc_id long, label int, flat array<double>")


def read_minmax_documents(spark: SparkSession, path: str) -> DataFrame:
    """``minmax_documents_of`` stored files."""
    return minmax_documents_of(_stored(spark, path))
