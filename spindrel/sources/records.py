"""Records in JSON, JSON lines, Atom and BEIR folders, and synthetic ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import after_last, collapsed, composed

_STRINGS = T.ArrayType(T.StringType())

PAPER = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("title", T.StringType()), T.StructField("abstract", T.StringType()), T.StructField("authors", _STRINGS), T.StructField("venue", T.StringType()),
    T.StructField("year", T.IntegerType()), T.StructField("keywords", _STRINGS), T.StructField("arxiv_id", T.StringType()), T.StructField("doi", T.StringType()),
])

ARCHIVED = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("title", T.StringType()), T.StructField("abstract", T.StringType()), T.StructField("published", T.StringType()), T.StructField("categories", _STRINGS), T.StructField("text", T.StringType()),
])


def read_papers(spark: SparkSession, path: str, schema: T.StructType = PAPER) -> DataFrame:
    """A JSON array of papers, or an object with one under ``papers``."""
    both = T.StructType([*schema.fields, T.StructField("papers", T.ArrayType(schema))])
    rows = spark.read.schema(both).json(path, multiLine=True)
    inside = rows.where("papers is not null").select(F.explode("papers").alias("p")).select("p.*")
    return rows.where("papers is null").select(*schema.names).unionByName(inside)


def read_paper_lines(spark: SparkSession, path: str, schema: T.StructType = PAPER) -> DataFrame:
    """JSON lines, compressed or not; blank and malformed lines are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def write_papers(df: DataFrame, path: str) -> None:
    df.write.json(path)


def read_archive_feed(spark: SparkSession, path: str, category: str | None = None) -> DataFrame:
    """Records of stored Atom pages: ids without their link, titles and abstracts on one line; ``category`` goes before ids."""
    entry = T.StructType([T.StructField("id", T.StringType()), T.StructField("title", T.StringType()), T.StructField("summary", T.StringType()), T.StructField("published", T.StringType()), T.StructField("category", T.ArrayType(T.StructType([T.StructField("_term", T.StringType())])))])
    rows = spark.read.format("xml").option("rowTag", "entry").schema(entry).load(path)
    key = after_last("id") if category is None else F.concat(F.lit(f"{category}_"), after_last("id"))
    out = rows.select(key.alias("id"), collapsed("title").alias("title"), collapsed("summary").alias("abstract"), "published", F.transform("category", lambda c: c["_term"]).alias("categories"))
    return out.withColumn("text", composed("title", "abstract", sep=" "))


def read_archive_feeds(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """The records of several categories' pages, one after the other; a category goes before its ids."""
    out = None
    for category, path in paths.items():
        part = read_archive_feed(spark, path, category)
        out = part if out is None else out.unionByName(part)
    return out


def read_beir(spark: SparkSession, folder: str, split: str = "test") -> tuple[DataFrame, DataFrame, DataFrame]:
    """documents(id, text), queries(query_id, query), qrels(query, doc_id, rel): judgements are keyed by the query's text."""
    corpus = spark.read.schema("_id string, title string, text string").json(f"{folder}/corpus.jsonl")
    queries = spark.read.schema("_id string, text string").json(f"{folder}/queries.jsonl").select(F.col("_id").alias("query_id"), F.col("text").alias("query"))
    marks = spark.read.csv(f"{folder}/qrels/{split}.tsv", sep="\t", header=True, schema="`query-id` string, `corpus-id` string, score int")
    qrels = marks.join(queries, F.col("query-id") == F.col("query_id")).select("query", F.col("corpus-id").alias("doc_id"), F.col("score").alias("rel"))
    judged = queries.join(marks.select(F.col("query-id").alias("query_id")).distinct(), "query_id", "left_semi")
    return corpus.select(F.col("_id").alias("id"), composed("title", "text").alias("text")), judged, qrels


def synthetic_papers(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """Papers with reproducible fields, for demonstrations."""
    topics = F.array(*(F.lit(x) for x in ("retrieval", "ranking", "indexing", "compression", "clustering", "evaluation")))
    pick = lambda j: F.element_at(topics, (F.pmod(F.xxhash64("id", F.lit(seed), F.lit(j)), F.lit(6)) + 1).cast("int"))
    rows = spark.range(n).select(
        "id", F.concat_ws(" ", F.lit("On"), pick(1), F.lit("and"), pick(2), F.col("id")).alias("title"), F.concat_ws(" ", F.lit("We study"), pick(3), F.lit("for"), pick(4)).alias("abstract"),
        F.array(F.concat(F.lit("Author "), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(97)))).alias("authors"), F.concat(F.lit("Venue "), F.pmod(F.xxhash64("id"), F.lit(9))).alias("venue"),
        (F.lit(2015) + F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(10))).cast("int").alias("year"), F.array(pick(1), pick(2)).alias("keywords"), F.lit(None).cast("string").alias("arxiv_id"), F.lit(None).cast("string").alias("doi"),
    )
    return rows


def results_as_json(results: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """(query_id, json): one object per query with passage ids and scores in order of rank."""
    rows = results.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id", "score"))).alias("r"), *(F.first(c).alias(c) for c in extra))
    return rows.select("query_id", F.to_json(F.struct("query_id", F.transform("r", lambda x: x["doc_id"]).alias("passage_ids"), F.transform("r", lambda x: x["score"]).alias("scores"), *extra)).alias("json"))
