"""Queries of the operators for training records, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .neighbours import nearest, similar_vectors
from .packing import pack
from .spectral import Clusters
from .tokens import encode_corpus, token_budget
from .topn import top_n
from .truncation import truncated, truncation_report
from .vectors import code_vectors, mean_vectors
from .versions import Versions


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return Versions(_table(spark, folder, "papers")).pairs()


def p1_groups(spark: SparkSession, folder: str) -> DataFrame:
    return Versions(_table(spark, folder, "papers")).groups()


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    found = similar_vectors(mean_vectors(_table(spark, folder, "document_embeddings")), k=5, least=0.85)
    return found.select(F.least("query", "id").alias("id_a"), F.greatest("query", "id").alias("id_b")).distinct()


def p2_nearest(spark: SparkSession, folder: str) -> DataFrame:
    vectors = mean_vectors(_table(spark, folder, "document_embeddings"))
    found = nearest(vectors.where("id % 100 = 0"), vectors, k=5)
    return found.select(F.col("query").alias("query_id"), "rank", F.col("id").alias("neighbour_id"), F.col("sim").alias("similarity"))


def _clusters(spark: SparkSession, folder: str) -> Clusters:
    return Clusters(code_vectors(_table(spark, folder, "quantized_documents"), _table(spark, folder, "ivf_clusters")))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    labels = _clusters(spark, folder).labels()
    large = labels.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).where("n >= 3")
    return labels.where("id <> cluster").join(large, "cluster", "left_semi").select(F.col("cluster").alias("id_a"), F.col("id").alias("id_b"))


def p3_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return _clusters(spark, folder).described()


def p4_budget(spark: SparkSession, folder: str) -> DataFrame:
    return token_budget(_table(spark, folder, "papers"), _table(spark, folder, "taxonomy"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return top_n(_table(spark, folder, "query_results"), "query_id", "passage_ids", "scores", 10, skip=(-1,)).select(F.col("group").alias("query_id"), F.col("item").alias("passage_id"))


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode_corpus(_table(spark, folder, "documents"))


def p7_containers(spark: SparkSession, folder: str) -> DataFrame:
    return pack(_table(spark, folder, "documents"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return truncated(_table(spark, folder, "documents")).where("cut").select("doc_id")


def p8_sources(spark: SparkSession, folder: str) -> DataFrame:
    return truncation_report(_table(spark, folder, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_groups, p2_found, p2_nearest, p3_found, p3_clusters, p4_budget, p5_found, p6_ids, p7_containers, p8_found, p8_sources)}


_P1_WORDS = """
records AS (
  SELECT id, regexp_extract_all(lower(any_value(title) || ' ' || any_value(abstract)), '[a-z0-9]+') AS words
  FROM papers WHERE title <> '' AND abstract <> '' GROUP BY id),
counts AS (SELECT id, w, count(*) AS n FROM (SELECT id, unnest(words) AS w FROM records) GROUP BY id, w),
sizes AS (SELECT id, len(words) AS n FROM records),
shared AS (
  SELECT a.id AS id_a, b.id AS id_b, sum(least(a.n, b.n)) AS s
  FROM counts a JOIN counts b ON a.w = b.w AND a.id < b.id GROUP BY 1, 2),
found AS (
  SELECT id_a, id_b FROM shared JOIN sizes x ON x.id = id_a JOIN sizes y ON y.id = id_b
  WHERE s >= 0.75 * greatest(x.n, y.n))"""

_P2_VECTORS = """
latest AS (
  SELECT id, any_value(embeddings) AS e FROM document_embeddings
  WHERE len(embeddings) > 0 AND NOT isnan(list_sum(embeddings::DOUBLE[])) GROUP BY id),
parts AS (SELECT id, unnest(e)::DOUBLE AS x, generate_subscripts(e, 1) - 1 AS p FROM latest),
dims AS (SELECT id, p % 64 AS d, sum(x) AS x FROM parts GROUP BY 1, 2),
norms AS (SELECT id, sqrt(sum(x * x)) AS n FROM dims GROUP BY id),
vectors AS (SELECT id, list(x / n ORDER BY d) AS v FROM dims JOIN norms USING (id) GROUP BY id)"""

_P3_LINKS = """
latest AS (SELECT id, any_value(centroid_codes) AS c FROM quantized_documents WHERE centroid_codes IS NOT NULL GROUP BY id),
codes AS (SELECT id, unnest(c) AS cluster_id FROM latest),
book AS (SELECT cluster_id, any_value(centroid) AS c FROM ivf_clusters WHERE centroid IS NOT NULL GROUP BY 1),
wide AS (SELECT cluster_id, unnest(c)::DOUBLE AS x, generate_subscripts(c, 1) AS d FROM book),
dims AS (SELECT id, d, sum(x) AS x FROM codes JOIN wide USING (cluster_id) GROUP BY 1, 2),
norms AS (SELECT id, sqrt(sum(x * x)) AS n FROM dims GROUP BY id),
vectors AS (SELECT id, list(x / n ORDER BY d) AS v FROM dims JOIN norms USING (id) GROUP BY id),
links AS (
  SELECT a.id AS a, b.id AS b FROM vectors a JOIN vectors b ON a.id <> b.id
  WHERE round(list_dot_product(a.v, b.v), 6) >= 0.85),
reach(a, b) AS (SELECT id, id FROM vectors UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
labels AS (SELECT a AS id, min(b) AS cluster FROM reach GROUP BY a)"""

_P5 = """
entries AS (
  SELECT query_id, unnest(passage_ids) AS passage_id, unnest(scores[:len(passage_ids)]) AS score FROM query_results
  WHERE len(passage_ids) > 0 AND len(scores) > 0),
best AS (
  SELECT query_id, passage_id, max(score) AS score FROM entries
  WHERE score IS NOT NULL AND NOT isnan(score) AND passage_id IS NOT NULL AND passage_id <> -1 GROUP BY 1, 2)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"WITH {_P1_WORDS} SELECT id_a, id_b FROM found",
        "p2_found": f"""WITH {_P2_VECTORS},
            sims AS (SELECT a.id AS q, b.id AS o, round(list_dot_product(a.v, b.v), 6) AS s FROM vectors a JOIN vectors b ON a.id <> b.id),
            ranked AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, o) AS r FROM sims)
            SELECT DISTINCT least(q, o) AS id_a, greatest(q, o) AS id_b FROM ranked WHERE r <= 5 AND s >= 0.85""",
        "p2_nearest": f"""WITH {_P2_VECTORS},
            sims AS (SELECT a.id AS q, b.id AS o, round(list_dot_product(a.v, b.v), 6) AS s FROM vectors a JOIN vectors b ON a.id <> b.id AND a.id % 100 = 0),
            ranked AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, o) AS r FROM sims)
            SELECT q AS query_id, r::INTEGER AS rank, o AS neighbour_id, s AS similarity FROM ranked WHERE r <= 5""",
        "p3_found": f"""WITH RECURSIVE {_P3_LINKS}
            SELECT cluster AS id_a, id AS id_b FROM labels WHERE id <> cluster
            AND cluster IN (SELECT cluster FROM labels GROUP BY cluster HAVING count(*) >= 3)""",
        "p3_clusters": f"""WITH RECURSIVE {_P3_LINKS},
            held AS (SELECT cluster, l.id, v, count(*) OVER (PARTITION BY cluster) AS n FROM labels l JOIN vectors USING (id)),
            typical AS (SELECT a.cluster, a.n AS size, a.id, round(sum(list_dot_product(a.v, b.v)) / any_value(a.n - 1), 6) AS affinity FROM held a JOIN held b ON a.cluster = b.cluster AND a.id <> b.id WHERE a.n >= 3 GROUP BY ALL),
            ranked AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY affinity DESC, id) AS rank FROM typical)
            SELECT cluster, size, rank::INTEGER AS rank, id, affinity FROM ranked WHERE rank <= 3""",
        "p1_groups": f"""WITH RECURSIVE {_P1_WORDS},
            classes AS (SELECT list_sort(words) AS sig, min(id) AS rep FROM records WHERE len(words) > 0 GROUP BY 1),
            members AS (SELECT id, rep FROM records JOIN classes ON list_sort(words) = sig),
            links AS (SELECT id_a AS a, id_b AS b FROM found WHERE id_a IN (SELECT rep FROM classes) AND id_b IN (SELECT rep FROM classes)),
            sides AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
            reach(a, b) AS (SELECT rep, rep FROM classes UNION SELECT r.a, l.b FROM reach r JOIN sides l ON l.a = r.b)
            SELECT id, rep AS class_id, (SELECT min(b) FROM reach WHERE a = rep) AS group_id, (SELECT count(*) FROM sides WHERE a = rep) AS links FROM members""",
        "p5_found": f"""WITH {_P5}, ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, passage_id) AS r FROM best)
            SELECT query_id, passage_id FROM ranked WHERE r <= 10""",
    }
