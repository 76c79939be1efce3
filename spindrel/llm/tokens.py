"""Token ids and token counts of whole text columns, and budgets over cubes of them."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.spread import spread
from .tokenizer import encoder, fast_encoder, vocabulary_path

#: Entries of a taxonomy at most; a larger one is refused, as it travels with every task.
TAXONOMY = 100_000


def encode_corpus(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(key, ids): the token ids of every row's text, by prefix dynamic programming, without special tokens.

    A null or empty text gives an empty list, a blank one its own ids. Texts are encoded whole. Repeated rows are each
    encoded; strings of special tokens are ordinary text. Other columns are dropped, so their names can't clash. The
    vocabulary is loaded once per worker; nothing is shuffled.
    """
    path = vocabulary or vocabulary_path()
    narrow = df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    out = T.StructType([T.StructField(key, narrow.schema["k"].dataType), T.StructField("ids", T.ArrayType(T.IntegerType(), False))])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            # a batch goes out in parts, so that the longest texts never gather
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                ids = pa.array([own.encode(x) for x in part.column(1).to_pylist()], pa.list_(pa.field("element", pa.int32(), False)))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=[key, "ids"])

    return spread(narrow).mapInArrow(encode, out)


def count_tokens(df: DataFrame, text: str = "text", into: str = "n_tokens", vocabulary: str | None = None, ids: str | None = None) -> DataFrame:
    """All columns of ``df`` but ``text``, with the exact token count of the whole text; 0 for a null or empty one.

    With ``ids``, that column holds the token ids too. A column named ``into`` or ``ids`` before is replaced.
    """
    path = vocabulary or vocabulary_path()
    rest = [c for c in df.columns if c not in (text, into, ids)]
    narrow = df.select(*rest, F.col(text).cast("string").alias("__text"))
    out = T.StructType([*(narrow.schema[c] for c in rest), T.StructField(into, T.IntegerType()), *([T.StructField(ids, T.ArrayType(T.IntegerType(), False))] if ids else [])])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = fast_encoder(path)
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                encoded = own.encode_ordinary_batch([x or "" for x in part.column(len(rest)).to_pylist()], num_threads=1)
                columns = [*part.columns[: len(rest)], pa.array([len(x) for x in encoded], pa.int32())]
                if ids:
                    columns.append(pa.array(encoded, pa.list_(pa.field("element", pa.int32(), False))))
                yield pa.RecordBatch.from_arrays(columns, names=out.names)

    return spread(narrow).mapInArrow(count, out)


def regular_source(column: str) -> F.Column:
    """One spelling of a source: lower case, no outer blanks, hyphens for underscores and blanks; 'unknown' for none."""
    plain = F.regexp_replace(F.trim(F.lower(F.col(column))), r"[_\s]+", "-")
    return F.when(plain.isNull() | (plain == ""), "unknown").otherwise(plain)


def regular_language(column: str) -> F.Column:
    """One spelling of a language: lower case without a region; 'und' for none."""
    plain = F.regexp_extract(F.trim(F.lower(F.col(column))), r"^([a-z]+)", 1)
    return F.when(plain.isNull() | (plain == ""), "und").otherwise(plain)


def token_budget(records: DataFrame, taxonomy: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(source, lang, domain, docs, tokens): totals over the cube of the three; '*' stands for all values.

    A record is an id of ``records`` (id, text, source, lang, categories, ingested_at), counted once, by its latest
    delivery. The domain is that of the first category that ``taxonomy`` (category, domain) knows, whatever case and
    blanks it is written with; 'unknown' if there is none. Null and empty texts count as documents of 0 tokens; rows
    with a null id are one record. Empty tables give the grand total of no rows, that is no row. A value '*' in the
    data is kept apart from totals, as it is spelt '\\*' there.
    """
    known = taxonomy.select(F.trim(F.lower("category")).alias("c"), "domain").where("c is not null and domain is not null").groupBy("c").agg(F.min("domain").alias("d")).limit(TAXONOMY + 1).collect()
    if len(known) > TAXONOMY:
        raise ValueError(f"a taxonomy has {TAXONOMY} categories at most")
    domains = F.create_map(*[F.lit(x) for row in known for x in row]) if known else F.create_map(F.lit(""), F.lit("unknown"))
    of = F.transform(F.coalesce("categories", F.array().cast("array<string>")), lambda c: F.when(c.isNotNull(), F.try_element_at(domains, F.trim(F.lower(c)))))
    first = F.coalesce(F.try_element_at(F.filter(of, lambda d: d.isNotNull()), F.lit(1)), F.lit("unknown"))
    kept = lambda c: F.when(c == "*", F.lit("\\*")).otherwise(c)
    narrow = records.select("id", F.col("ingested_at").alias("at"), kept(regular_source("source")).alias("source"), kept(regular_language("lang")).alias("lang"), kept(first).alias("domain"), "text")
    counted = count_tokens(narrow, into="tokens", vocabulary=vocabulary)
    # the token count is made before the shuffle, so texts are never shuffled
    once = counted.groupBy("id").agg(F.max(F.struct("at", "tokens", "source", "lang", "domain")).alias("r")).select("r.*")
    cube = once.cube("source", "lang", "domain").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.col("tokens").cast("long")).alias("tokens"))
    return cube.select(*(F.coalesce(c, F.lit("*")).alias(c) for c in ("source", "lang", "domain")), "docs", "tokens").where("docs > 0")


def vocabulary_size(path: str | None = None) -> int:
    """Ids of a rank file; the bound of tables that have a row per token id."""
    with Path(path or vocabulary_path()).open("rb") as lines:
        return sum(1 for _ in lines)
