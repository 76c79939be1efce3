"""One query per operator, each over whole tables, and the same in SQL.

The embeddings table is read as documents of five tokens (doc_id = vec_id div 5). Search queries are made of the rows
whose id is divisible by 100: query (vec_id div 100) % 3. Ragged documents are those of document_embeddings, and queries
among them the documents whose id is divisible by 100.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import bits, text, vectors
from .operators import codec as codecs
from .operators import corpus, evaluation, ivf, kmeans, maxsim, metadata, search, statistics
from .operators.index import VectorIndex, chunk_count
from .plans.lineage import cut, scratch
from .plans.ranks import ranked, renumbered, running_total
from .sources import binary, records
from .streaming.incremental import add_stream

DIM, CENTROIDS, PROBES, TOP, FULL_SCORES = 64, 16, 4, 10, 320

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its name, with its SQL."""

    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


# inputs


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _tokens(spark, folder) -> DataFrame:
    e = _table(spark, folder, "embeddings")
    return e.select(F.col("vec_id").alias("t"), F.expr("vec_id div 5").alias("doc_id"), (F.col("vec_id") % 5).alias("pos"), vectors.doubles("embedding").alias("vec"), "label")


def _docs(spark, folder) -> DataFrame:
    return corpus.packed(_tokens(spark, folder))


def _search_queries(spark, folder) -> DataFrame:
    e = _table(spark, folder, "embeddings").where("vec_id % 100 = 0")
    return e.select(F.expr("(vec_id div 100) % 3").alias("query_id"), F.expr("vec_id div 300").alias("qpos"), vectors.doubles("embedding").alias("vec"), "label")


def _ragged(spark, folder) -> DataFrame:
    rows = corpus.latest(_table(spark, folder, "document_embeddings").select("id", "embeddings", "encoded_at"), "id", "encoded_at")
    return rows.select(F.col("id").alias("doc_id"), F.col("embeddings").alias("flat"))


def _ragged_queries(spark, folder) -> DataFrame:
    return corpus.unpacked(_ragged(spark, folder).where("doc_id % 100 = 0"), DIM).select(F.col("doc_id").alias("query_id"), F.col("pos").alias("qpos"), "vec")


def _centroids(spark, folder) -> DataFrame:
    return cut(kmeans.evenly_spaced(_tokens(spark, folder), CENTROIDS), "centroids")


def _coded(spark, folder, centroids: DataFrame, metric: str = "l2") -> DataFrame:
    return kmeans.assigned(_tokens(spark, folder), centroids, metric, ["t", "doc_id", "pos", "vec"])


def _codec(spark, folder) -> codecs.Codec:
    return codecs.train_centred(_tokens(spark, folder).select("t", "vec"), _centroids(spark, folder))


_TOK = """tok AS (SELECT vec_id AS t, vec_id // 5 AS doc_id, vec_id % 5 AS pos, embedding::DOUBLE[] AS vec, label FROM embeddings),
qry AS (SELECT (vec_id // 100) % 3 AS query_id, vec_id // 300 AS qpos, embedding::DOUBLE[] AS vec, label FROM embeddings WHERE vec_id % 100 = 0)"""
_DOTS = _TOK + """,
best AS (SELECT query_id, qpos, doc_id, max(list_dot_product(q.vec, k.vec)) AS m FROM qry q CROSS JOIN tok k GROUP BY ALL),
score AS (SELECT query_id, doc_id, round(sum(m), 6) AS score FROM best GROUP BY ALL)"""
_RAG = """rag AS (SELECT id AS doc_id, any_value(embeddings)::DOUBLE[] AS flat FROM document_embeddings WHERE embeddings IS NOT NULL GROUP BY id),
rtok AS (SELECT doc_id, p AS pos, flat[p * 64 + 1 : p * 64 + 64] AS vec FROM (SELECT doc_id, flat, unnest(range(len(flat) // 64)) AS p FROM rag WHERE len(flat) >= 64)),
rqry AS (SELECT doc_id AS query_id, pos AS qpos, vec FROM rtok WHERE doc_id % 100 = 0),
fine AS (SELECT doc_id FROM rag WHERE len(flat) > 0 AND NOT isnan(list_sum(flat)))"""
_CENT = _TOK + """,
cent AS (SELECT c.cid, k.vec FROM (SELECT unnest(range(16)) AS cid) c
  JOIN (SELECT vec, row_number() OVER (ORDER BY t) - 1 AS r, count(*) OVER () AS n FROM tok) k ON k.r = c.cid * k.n // 16),
asg AS (SELECT t, doc_id, pos, cid, near FROM (
  SELECT t, doc_id, pos, cid, near, row_number() OVER (PARTITION BY t ORDER BY near, cid) AS rn
  FROM (SELECT k.t, k.doc_id, k.pos, c.cid, round(pow(list_distance(k.vec, c.vec), 2), 9) AS near FROM tok k CROSS JOIN cent c)) WHERE rn = 1)"""
_IVF = _CENT + """,
post AS (SELECT DISTINCT cid, doc_id FROM asg),
mat AS (SELECT q.query_id, q.qpos, c.cid, round(list_dot_product(q.vec, c.vec), 6) AS score FROM qry q CROSS JOIN cent c),
prb AS (SELECT query_id, qpos, cid, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, qpos ORDER BY score DESC, cid) AS r FROM mat) WHERE r <= 4),
cand AS (SELECT DISTINCT query_id, doc_id FROM prb JOIN post USING (cid))"""
_CODEC = _IVF + """,
lng AS (SELECT a.t, a.cid, unnest(range(64)) AS d, unnest(list_transform(range(1, 65), lambda i: k.vec[i] - c.vec[i])) AS r
  FROM asg a JOIN tok k USING (t) JOIN cent c USING (cid)),
avgr AS (SELECT d, round(avg(r), 9) AS avg FROM lng GROUP BY d),
cen AS (SELECT t, d, round(r - avg, 9) AS r FROM lng JOIN avgr USING (d)),
wts AS (SELECT d, bucket, round(avg(r), 9) AS weight FROM (
  SELECT d, r, (16 * row_number() OVER (PARTITION BY d ORDER BY r, t) - 1) // count(*) OVER (PARTITION BY d) AS bucket FROM cen) GROUP BY ALL),
cuts AS (SELECT i, cutoff FROM (SELECT bucket + 1 AS i, round((w + lead(w) OVER (ORDER BY bucket)) / 2, 9) AS cutoff
  FROM (SELECT bucket, avg(weight) AS w FROM wts GROUP BY bucket)) WHERE cutoff IS NOT NULL),
lev AS (SELECT t, d, count(cutoff) AS level FROM cen LEFT JOIN cuts ON cutoff <= r GROUP BY ALL),
raw AS (SELECT a.doc_id, l.t, l.d, c.vec[l.d + 1] + g.avg + w.weight AS x
  FROM lev l JOIN asg a USING (t) JOIN cent c USING (cid) JOIN avgr g ON g.d = l.d JOIN wts w ON w.d = l.d AND w.bucket = l.level),
dec AS (SELECT doc_id, t, list(x / n ORDER BY d) AS vec FROM raw JOIN (SELECT t, greatest(sqrt(sum(x * x)), 1e-12) AS n FROM raw GROUP BY t) USING (t) GROUP BY doc_id, t)"""


def _top(source: str, k: int = TOP) -> str:
    return f"SELECT query_id, rank::INTEGER AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM {source}) WHERE rank <= {k}"


# scoring


@query(f"WITH {_DOTS} {_top('score')}")
def maxsim_bruteforce_topk(spark, folder):
    return maxsim.search_exact(_docs(spark, folder), _search_queries(spark, folder), DIM, TOP)


@query(f"WITH {_DOTS} SELECT query_id, doc_id, round(avg(m), 6) AS score FROM best GROUP BY ALL")
def maxsim_normalized(spark, folder):
    return maxsim.scores(_docs(spark, folder), _search_queries(spark, folder), DIM, average=True)


@query(f"WITH {_DOTS} SELECT query_id, doc_id, score FROM score")
def maxsim_all_scores(spark, folder):
    return maxsim.scores(_docs(spark, folder), _search_queries(spark, folder), DIM)


_RSCORE = _RAG + """,
rbest AS (SELECT query_id, qpos, k.doc_id, max(list_dot_product(q.vec, k.vec)) AS m FROM rqry q CROSS JOIN rtok k
  WHERE query_id IN (SELECT doc_id FROM fine) AND k.doc_id IN (SELECT doc_id FROM fine) GROUP BY ALL),
rscore AS (SELECT query_id, doc_id, round(sum(m), 6) AS score FROM rbest GROUP BY ALL)"""


def _valid_queries(spark, folder):
    valid = corpus.checked(_ragged(spark, folder), DIM).where("valid")
    return corpus.unpacked(valid.where("doc_id % 100 = 0"), DIM).select(F.col("doc_id").alias("query_id"), F.col("pos").alias("qpos"), "vec")


@query(f"WITH {_RSCORE} SELECT query_id, doc_id, score FROM rscore")
def maxsim_ragged(spark, folder):
    return maxsim.scores(_ragged(spark, folder), _valid_queries(spark, folder), DIM)


@query(f"""WITH {_RSCORE}, every AS (SELECT id AS doc_id, bool_or(embeddings IS NOT NULL AND len(embeddings) > 0) AS has FROM document_embeddings GROUP BY id)
SELECT q.query_id, e.doc_id, coalesce(s.score, 0.0) AS score FROM (SELECT DISTINCT query_id FROM rqry WHERE query_id IN (SELECT doc_id FROM fine)) q CROSS JOIN every e
LEFT JOIN rscore s ON s.query_id = q.query_id AND s.doc_id = e.doc_id WHERE NOT e.has OR e.doc_id IN (SELECT doc_id FROM fine)""")
def maxsim_empty_docs_zero(spark, folder):
    return maxsim.scores(_ragged(spark, folder), _valid_queries(spark, folder), DIM, empty_zero=True)


@query(f"WITH {_RSCORE}, other AS (SELECT * FROM rscore WHERE doc_id <> query_id) {_top('other')}")
def exclude_self_match(spark, folder):
    run = maxsim.scores(_ragged(spark, folder), _valid_queries(spark, folder), DIM, keep=TOP + 1)
    return maxsim.best(evaluation.without_self(run.withColumnRenamed("query_id", "query")).withColumnRenamed("query", "query_id"), TOP).select("query_id", "rank", "doc_id", "score")


@query("SELECT x.vec_id AS a, y.vec_id AS b, round(list_dot_product(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 6) AS dot FROM embeddings x JOIN embeddings y ON y.vec_id = x.vec_id + 1")
def dot_product(spark, folder):
    return _neighbours(spark, folder).select("a", "b", F.round(vectors.dot("x", "y"), 6).alias("dot"))


def _neighbours(spark, folder):
    e = _table(spark, folder, "embeddings")
    return e.select(F.col("vec_id").alias("a"), F.col("embedding").alias("x")).join(e.select((F.col("vec_id") - 1).alias("a"), F.col("vec_id").alias("b"), F.col("embedding").alias("y")), "a")


@query("SELECT x.vec_id AS a, y.vec_id AS b, round(pow(list_distance(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 2), 6) AS squared FROM embeddings x JOIN embeddings y ON y.vec_id = x.vec_id + 1")
def l2_distance(spark, folder):
    return _neighbours(spark, folder).select("a", "b", F.round(vectors.squared_distance("x", "y"), 6).alias("squared"))


@query("""WITH s AS (SELECT x.vec_id AS a, list_transform(range(1, 65), lambda i: x.embedding[i]::DOUBLE + y.embedding[i]::DOUBLE) AS v FROM embeddings x JOIN embeddings y ON y.vec_id = x.vec_id + 1)
SELECT a, unnest(range(64))::INTEGER AS d, round(unnest(list_transform(v, lambda e: e / greatest(sqrt(list_dot_product(v, v)), 1e-12))), 6) AS x FROM s""")
def l2_normalize(spark, folder):
    return _neighbours(spark, folder).select("a", F.posexplode(vectors.normalized(vectors.added("x", "y"))).alias("d", "x")).select("a", "d", F.round("x", 6).alias("x"))


@query(f"WITH {_CODEC} SELECT t, d::INTEGER AS d, round(r, 9) AS r FROM lng")
def residuals(spark, folder):
    c = _centroids(spark, folder)
    return codecs.residuals(_coded(spark, folder, c), c)


@query(f"WITH {_IVF} SELECT query_id, qpos, cid, score FROM mat")
def similarity_matrix(spark, folder):
    return maxsim.similarity_matrix(_search_queries(spark, folder), _centroids(spark, folder))


# data model and statistics


@query("SELECT id, coalesce(len(embeddings), -1)::INTEGER AS n, coalesce(len(embeddings) % 64 = 0 AND len(list_filter(embeddings, lambda x: x IS NULL OR isnan(x) OR x < -10 OR x > 10)) = 0, false) AS valid FROM document_embeddings")
def validate_embeddings(spark, folder):
    rows = corpus.checked(_table(spark, folder, "document_embeddings"), DIM, "embeddings")
    return rows.select("id", F.coalesce(F.size("embeddings"), F.lit(-1)).alias("n"), "valid")


@query(f"WITH {_RAG} SELECT doc_id, pos::INTEGER AS pos, round(vec[1], 6) AS first, round(list_sum(vec), 6) AS total FROM rtok WHERE doc_id IN (SELECT doc_id FROM fine)")
def flat_to_docs(spark, folder):
    valid = corpus.checked(_ragged(spark, folder), DIM).where("valid")
    return corpus.unpacked(valid, DIM).select("doc_id", "pos", F.round(F.col("vec")[0], 6).alias("first"), F.round(vectors.total(F.col("vec")), 6).alias("total"))


@query("SELECT id, encoded_at, num_tokens, coalesce(sum(num_tokens) OVER (ORDER BY id, encoded_at ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM document_embeddings")
def running_offsets(spark, folder):
    rows = _table(spark, folder, "document_embeddings").select("id", "encoded_at", "num_tokens")
    return running_total(rows, ["id", "encoded_at"], "num_tokens", "start")


@query("""WITH d AS (SELECT id, any_value(num_tokens) AS n FROM document_embeddings GROUP BY id), k AS (SELECT id, n, (row_number() OVER (ORDER BY id) - 1) // 25000 AS chunk FROM d),
c AS (SELECT chunk, count(*) AS num_passages, sum(n)::BIGINT AS num_embeddings FROM k GROUP BY chunk)
SELECT chunk, num_passages, num_embeddings, coalesce(sum(num_embeddings) OVER (ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS embedding_offset FROM c""")
def chunk_offsets(spark, folder):
    d = _table(spark, folder, "document_embeddings").groupBy("id").agg(F.max("num_tokens").alias("n"))
    chunks = ranked(d, ["id"]).groupBy(F.expr("rank0 div 25000").alias("chunk")).agg(F.count(F.lit(1)).alias("num_passages"), F.sum(F.col("n").cast("long")).alias("num_embeddings"))
    return running_total(chunks, ["chunk"], "num_embeddings", "embedding_offset")


@query("SELECT count(*) AS num_docs, sum(coalesce(num_tokens, 0))::BIGINT AS num_tokens, round(avg(coalesce(num_tokens, 0)), 6) AS avg_doclen, min(coalesce(num_tokens, 0)) AS min_doclen, max(coalesce(num_tokens, 0)) AS max_doclen FROM document_embeddings")
def doc_length_stats(spark, folder):
    return statistics.length_statistics(_table(spark, folder, "document_embeddings"), "num_tokens")


@query("""WITH s AS (SELECT num_tokens AS len, row_number() OVER (ORDER BY num_tokens) - 1 AS r, count(*) OVER () AS n FROM document_embeddings WHERE num_tokens IS NOT NULL)
SELECT DISTINCT len AS stride FROM s WHERE len > 0 AND (r = n - 1 OR r IN (SELECT unnest([least(floor(0.5 * n), n - 1), least(floor(0.75 * n), n - 1), least(floor(0.9 * n), n - 1), least(floor(0.95 * n), n - 1)]) FROM (SELECT count(num_tokens) AS n FROM document_embeddings)))""")
def length_quantiles(spark, folder):
    return statistics.length_quantiles(_table(spark, folder, "document_embeddings"), "num_tokens")


@query("""WITH d AS (SELECT DISTINCT id, centroid_codes AS c FROM quantized_documents WHERE centroid_codes IS NOT NULL)
SELECT id, w::INTEGER AS w, c[w + 1] AS c0, c[w + 2] AS c1, c[w + 3] AS c2 FROM (SELECT id, c, unnest(range(len(c) - 2)) AS w FROM d WHERE len(c) >= 3)""")
def sliding_windows(spark, folder):
    d = _table(spark, folder, "quantized_documents").where("centroid_codes is not null").select("id", "centroid_codes").distinct()
    rows = d.select("id", F.posexplode(vectors.windows("centroid_codes", 3)).alias("w", "x"))
    return rows.select("id", "w", F.col("x")[0].alias("c0"), F.col("x")[1].alias("c1"), F.col("x")[2].alias("c2"))


@query("""WITH d AS (SELECT DISTINCT vec_id // 5 AS doc_id FROM embeddings), r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS rank0, count(*) OVER () AS n FROM d)
SELECT doc_id, rank0 FROM r WHERE rank0 < least(1 + floor(16 * sqrt(120 * n)), n)""")
def sample_prefix(spark, folder):
    d = _tokens(spark, folder).select("doc_id").distinct()
    return statistics.prefix_sample(d, "doc_id", kmeans.sample_size(d.count()))


@query("SELECT vec_id AS t, row_number() OVER (ORDER BY vec_id) - 1 >= count(*) OVER () - round_even(least(0.05 * count(*) OVER (), 50000), 0) AS held_out FROM embeddings")
def holdout_split(spark, folder):
    t = _tokens(spark, folder).select("t")
    n = t.count()
    return statistics.held_out(t, "t", kmeans.holdout_size(n), n)


@query("""SELECT count(*) AS num_docs, pow(2, floor(log2(16 * sqrt(avg(coalesce(num_tokens, 0)) * count(*)))))::BIGINT AS num_partitions,
ceil(count(*) / least(25000, count(*) + 1))::BIGINT AS num_chunks FROM document_embeddings""")
def partition_count(spark, folder):
    s = statistics.length_statistics(_table(spark, folder, "document_embeddings"), "num_tokens").first()
    return spark.createDataFrame([(s["num_docs"], kmeans.partition_count(s["num_docs"], s["avg_doclen"]), chunk_count(s["num_docs"]))], "num_docs long, num_partitions long, num_chunks long")


# k-means and assignment


def _wide(df: DataFrame, key: str = "cid", digits: int = 6) -> DataFrame:
    return df.select(key, F.posexplode("vec").alias("d", "x")).select(key, "d", F.round("x", digits).alias("x"))


@query(f"WITH {_CENT} SELECT cid, unnest(range(64))::INTEGER AS d, round(unnest(vec), 6) AS x FROM cent")
def kmeans_init(spark, folder):
    return _wide(_centroids(spark, folder))


@query(f"WITH {_CENT} SELECT t, cid, round(near, 6) AS near FROM asg")
def kmeans_assign_l2(spark, folder):
    return _coded(spark, folder, _centroids(spark, folder)).select("t", "cid", F.round("near", 6).alias("near"))


@query(f"""WITH {_CENT}, sim AS (SELECT t, cid, round(list_dot_product(k.vec, c.vec), 9) AS s FROM tok k CROSS JOIN cent c)
SELECT t, cid, round(s, 6) AS near FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY s DESC, cid) AS r FROM sim) WHERE r = 1""")
def assign_dot(spark, folder):
    return _coded(spark, folder, _centroids(spark, folder), "dot").select("t", "cid", F.round("near", 6).alias("near"))


def _round_sql(before: str, after: str) -> str:
    return f""",
a{after} AS (SELECT t, cid FROM (SELECT k.t, c.cid, row_number() OVER (PARTITION BY k.t ORDER BY round(pow(list_distance(k.vec, c.vec), 2), 9), c.cid) AS r FROM tok k CROSS JOIN {before} c) WHERE r = 1),
m{after} AS (SELECT cid, d, avg(x) AS x FROM (SELECT a.cid, unnest(range(64)) AS d, unnest(k.vec) AS x FROM a{after} a JOIN tok k USING (t)) GROUP BY ALL),
{after} AS (SELECT cid, list(x ORDER BY d) AS vec FROM m{after} GROUP BY cid UNION ALL SELECT cid, vec FROM {before} WHERE cid NOT IN (SELECT cid FROM m{after}))"""


_ROUNDS = "".join(_round_sql("cent" if i == 1 else f"c{i - 1}", f"c{i}") for i in range(1, 6))


@query(f"WITH {_CENT}{_round_sql('cent', 'c1')} SELECT cid, unnest(range(64))::INTEGER AS d, round(unnest(vec), 6) AS x FROM c1")
def kmeans_one_round(spark, folder):
    return _wide(kmeans.train(_tokens(spark, folder), CENTROIDS, 1))


@query(f"WITH {_CENT}{_ROUNDS} SELECT cid, unnest(range(64))::INTEGER AS d, round(unnest(vec), 6) AS x FROM c5")
def kmeans_five_rounds(spark, folder):
    return _wide(kmeans.train(_tokens(spark, folder), CENTROIDS, 5))


# inverted files


def _postings(spark, folder, centroids):
    return ivf.postings(_coded(spark, folder, centroids))


@query(f"WITH {_IVF} SELECT cid, doc_id FROM post")
def ivf_postings(spark, folder):
    return _postings(spark, folder, _centroids(spark, folder))


@query(f"""WITH {_IVF}, s AS (SELECT cid, count(doc_id) AS n, row_number() OVER (ORDER BY count(doc_id)) - 1 AS r FROM cent LEFT JOIN post USING (cid) GROUP BY cid)
SELECT count(*) AS clusters, count(*) FILTER (n = 0) AS empty_clusters, min(n) AS min_size, min(n) FILTER (r = (SELECT count(*) // 2 FROM cent)) AS median_size, max(n) AS max_size, round(avg(n), 6) AS avg_size FROM s""")
def ivf_cluster_stats(spark, folder):
    c = _centroids(spark, folder)
    return ivf.cluster_statistics(c, _postings(spark, folder, c))


@query(f"WITH {_IVF} SELECT cid, count(*) AS n FROM post GROUP BY cid ORDER BY n DESC, cid LIMIT 10")
def ivf_largest_clusters(spark, folder):
    return ivf.largest_clusters(_postings(spark, folder, _centroids(spark, folder)))


@query(f"WITH {_IVF} SELECT query_id, qpos, cid, score FROM prb")
def ivf_probe(spark, folder):
    return ivf.probed(_search_queries(spark, folder), _centroids(spark, folder), ivf.effective_probes(CENTROIDS))


def _candidates(spark, folder, **more):
    c = _centroids(spark, folder)
    return c, ivf.candidates(ivf.probed(_search_queries(spark, folder), c, PROBES), _postings(spark, folder, c), **more)


@query(f"WITH {_IVF} SELECT query_id, doc_id FROM cand")
def ivf_candidates(spark, folder):
    return _candidates(spark, folder)[1]


_EXACT = _IVF + """, cscore AS (SELECT query_id, doc_id, round(sum(m), 6) AS score FROM (
  SELECT q.query_id, q.qpos, k.doc_id, max(list_dot_product(q.vec, k.vec)) AS m FROM qry q JOIN cand USING (query_id) JOIN tok k ON k.doc_id = cand.doc_id GROUP BY ALL) GROUP BY ALL)"""


@query(f"WITH {_EXACT} {_top('cscore')}")
def ivf_search_topk(spark, folder):
    c = _centroids(spark, folder)
    return search.search_ivf(_search_queries(spark, folder), _docs(spark, folder), c, _postings(spark, folder, c), DIM, PROBES, TOP)


@query(f"WITH {_IVF} SELECT query_id, (SELECT count(*) FROM cand c WHERE c.query_id = p.query_id) AS candidates_searched, count(DISTINCT cid) AS num_clusters_probed FROM prb p GROUP BY query_id")
def ivf_candidate_stats(spark, folder):
    c = _centroids(spark, folder)
    probes = ivf.probed(_search_queries(spark, folder), c, PROBES)
    found = ivf.candidates(probes, _postings(spark, folder, c)).groupBy("query_id").agg(F.count(F.lit(1)).alias("candidates_searched"))
    return found.join(probes.groupBy("query_id").agg(F.countDistinct("cid").alias("num_clusters_probed")), "query_id")


# base: documents whose first token has a label below 8; the others come later, with the cluster of their first token only
_DELTA = _IVF + """,
late AS (SELECT doc_id FROM tok WHERE pos = 0 AND label >= 8),
base AS (SELECT cid, doc_id FROM post WHERE doc_id NOT IN (SELECT doc_id FROM late)),
delta AS (SELECT cid, doc_id FROM asg WHERE pos = 0 AND doc_id IN (SELECT doc_id FROM late))"""


def _base_and_delta(spark, folder):
    c = _centroids(spark, folder)
    coded = cut(_coded(spark, folder, c), "coded")
    late = _tokens(spark, folder).where("pos = 0 and label >= 8").select("doc_id")
    return c, ivf.postings(coded.join(late, "doc_id", "left_anti")), ivf.postings(coded.join(late, "doc_id", "left_semi"), "first_token")


@query(f"WITH {_DELTA} SELECT DISTINCT query_id, doc_id FROM prb JOIN (SELECT * FROM base UNION ALL SELECT * FROM delta) USING (cid)")
def ivf_delta_union(spark, folder):
    c, base, delta = _base_and_delta(spark, folder)
    return ivf.candidates(ivf.probed(_search_queries(spark, folder), c, PROBES), base, delta)


@query(f"WITH {_DELTA} SELECT cid, doc_id FROM base UNION SELECT cid, doc_id FROM delta")
def ivf_compact(spark, folder):
    _, base, delta = _base_and_delta(spark, folder)
    return base.unionByName(delta).distinct()


# codec


@query(f"WITH {_CODEC} SELECT d::INTEGER AS d, avg FROM avgr")
def avg_residual(spark, folder):
    c = _centroids(spark, folder)
    return codecs.average_residual(_coded(spark, folder, c), c)


@query(f"WITH {_CODEC} SELECT d::INTEGER AS d, round(avg(abs(r)), 9) AS avg FROM lng GROUP BY d")
def avg_abs_residual(spark, folder):
    c = _centroids(spark, folder)
    return codecs.average_residual(_coded(spark, folder, c), c, absolute=True)


@query(f"WITH {_CODEC} SELECT d::INTEGER AS d, bucket::INTEGER AS bucket, weight FROM wts")
def bucket_weights(spark, folder):
    trained = _codec(spark, folder)
    rows = [(d, b, float(trained.weights[b, d])) for b in range(16) for d in range(DIM)]
    return spark.createDataFrame(rows, "d int, bucket int, weight double")


@query(f"WITH {_CODEC} SELECT i::INTEGER AS i, cutoff FROM cuts")
def bucket_cutoffs(spark, folder):
    trained = _codec(spark, folder)
    return spark.createDataFrame([(i + 1, float(c)) for i, c in enumerate(trained.cutoffs)], "i int, cutoff double")


def _encoded(spark, folder, trained):
    return codecs.encode(_docs(spark, folder), trained)


_HEXED = _CODEC + """, hexed AS (SELECT doc_id, string_agg(h, '' ORDER BY t) AS residuals FROM (
  SELECT a.doc_id, l.t, string_agg(substr('0123456789ABCDEF', level::INTEGER + 1, 1), '' ORDER BY l.d) AS h FROM lev l JOIN asg a USING (t) GROUP BY a.doc_id, l.t) GROUP BY doc_id)"""


@query(f"WITH {_HEXED} SELECT h.doc_id, string_agg(cid::VARCHAR, ' ' ORDER BY t) AS codes, any_value(residuals) AS residuals, count(*)::INTEGER AS n_tokens FROM hexed h JOIN asg USING (doc_id) GROUP BY h.doc_id")
def quantize_codes(spark, folder):
    rows = _encoded(spark, folder, _codec(spark, folder))
    return rows.select("doc_id", F.array_join(F.col("codes").cast("array<string>"), " ").alias("codes"), F.hex("residuals").alias("residuals"), "n_tokens")


_NIBBLES = """n AS (SELECT id, segment, written_at, list_transform(centroid_codes, lambda c: c % 16) AS c FROM quantized_documents WHERE centroid_codes IS NOT NULL AND len(centroid_codes) > 0)"""


@query(f"""WITH {_NIBBLES} SELECT id, segment, written_at, list_aggregate(list_transform(c, lambda x: substr('0123456789abcdef', x + 1, 1)), 'string_agg', '') || CASE WHEN len(c) % 2 = 1 THEN '0' ELSE '' END AS packed FROM n""")
def pack_nibbles(spark, folder):
    q = _table(spark, folder, "quantized_documents").where("size(centroid_codes) > 0")
    packed = bits.pack_nibbles(F.transform("centroid_codes", lambda c: c % 16))
    return q.select("id", "segment", "written_at", F.lower(F.hex(packed)).alias("packed"))


@query("""WITH r AS (SELECT id, segment, written_at, hex(packed_residuals) AS h FROM quantized_documents WHERE octet_length(packed_residuals) > 0)
SELECT id, segment, written_at, p::INTEGER AS pos, (strpos('0123456789ABCDEF', substr(h, p + 1, 1)) - 1)::INTEGER AS level FROM (SELECT *, unnest(range(length(h))) AS p FROM r)""")
def unpack_nibbles(spark, folder):
    q = _table(spark, folder, "quantized_documents").where("octet_length(packed_residuals) > 0")
    return q.select("id", "segment", "written_at", F.posexplode(bits.unpack_nibbles(F.col("packed_residuals"))).alias("pos", "level"))


@query("""WITH n AS (SELECT id, segment, written_at, list_transform(centroid_codes, lambda c: c % 4) AS c FROM quantized_documents WHERE centroid_codes IS NOT NULL AND len(centroid_codes) > 0),
b AS (SELECT id, segment, written_at, list_aggregate(list_transform(c, lambda x: CASE x WHEN 0 THEN '00' WHEN 1 THEN '10' WHEN 2 THEN '01' ELSE '11' END), 'string_agg', '') AS s FROM n),
f AS (SELECT id, segment, written_at, rpad(s, ((length(s) + 7) // 8 * 8)::INTEGER, '0') AS s FROM b)
SELECT id, segment, written_at, string_agg(lower(printf('%02x', (substr(s, p * 8 + 1, 8))::BIT::INTEGER)), '' ORDER BY p) AS packed FROM (SELECT *, unnest(range(length(s) // 8)) AS p FROM f) GROUP BY ALL""")
def packbits_general(spark, folder):
    q = _table(spark, folder, "quantized_documents").where("size(centroid_codes) > 0")
    return q.select("id", "segment", "written_at", bits.fields_to_hex(F.transform("centroid_codes", lambda c: c % 4), 2).alias("packed"))


@query(f"""WITH {_CODEC}, pair AS (SELECT k.doc_id, unnest(k.vec) AS x, unnest(e.vec) AS y FROM tok k JOIN dec e USING (t))
SELECT doc_id, round(avg((x - y) * (x - y)), 6) AS mse, round(sum(x * y) / sqrt(sum(x * x) * sum(y * y)), 6) AS cosine FROM pair GROUP BY doc_id""")
def decode_reconstruction_error(spark, folder):
    trained = _codec(spark, folder)
    return codecs.reconstruction_error(_docs(spark, folder), codecs.decode(_encoded(spark, folder, trained), trained))


@query("""WITH book AS (SELECT cluster_id, any_value(centroid)::DOUBLE[] AS c FROM ivf_clusters WHERE centroid IS NOT NULL GROUP BY 1),
q AS (SELECT id, any_value(centroid_codes) AS codes, any_value(hex(packed_residuals)) AS h FROM quantized_documents WHERE centroid_codes IS NOT NULL AND octet_length(packed_residuals) = 32 * len(centroid_codes) GROUP BY id),
t AS (SELECT id, h, unnest(range(len(codes))) AS p, unnest(codes) AS cluster_id FROM q),
w AS (SELECT id, p, d, c[d + 1] + avg_residual[d + 1]::DOUBLE + bucket_weights[(strpos('0123456789ABCDEF', substr(h, p * 64 + d + 1, 1)) - 1) * 64 + d + 1]::DOUBLE AS y
  FROM (SELECT t.*, b.c, unnest(range(64)) AS d FROM t JOIN book b USING (cluster_id)) CROSS JOIN codec),
n AS (SELECT id, p, greatest(sqrt(sum(y * y)), 1e-12) AS n FROM w GROUP BY id, p),
e AS (SELECT id, any_value(embeddings)::DOUBLE[] AS flat FROM document_embeddings WHERE len(embeddings) > 0 AND NOT isnan(list_sum(embeddings)) GROUP BY id),
pair AS (SELECT w.id, flat[p * 64 + d + 1] AS x, y / n.n AS y FROM w JOIN n USING (id, p) JOIN e USING (id) WHERE len(flat) = 64 * (SELECT len(codes) FROM q WHERE q.id = w.id))
SELECT id AS doc_id, round(avg((x - y) * (x - y)), 6) AS mse, round(sum(x * y) / sqrt(sum(x * x) * sum(y * y)), 6) AS cosine FROM pair GROUP BY id""")
def decode_stored_documents(spark, folder):
    stored = codecs.stored_codec(_table(spark, folder, "codec"), _table(spark, folder, "ivf_clusters"))
    q = _table(spark, folder, "quantized_documents").where("centroid_codes is not null and octet_length(packed_residuals) = 32 * size(centroid_codes)")
    once = corpus.latest(q.select("id", "centroid_codes", "packed_residuals", "written_at"), "id", "written_at").select(F.col("id").alias("doc_id"), F.col("centroid_codes").alias("codes"), F.col("packed_residuals").alias("residuals"))
    valid = corpus.checked(_ragged(spark, folder), DIM).where("valid and size(flat) > 0")
    return codecs.reconstruction_error(valid, codecs.decode(once, stored))


@query("""WITH m AS (SELECT d, min(x) AS low, max(x) AS high FROM (SELECT unnest(range(64)) AS d, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY d),
l AS (SELECT vec_id, d, floor((x - low) / (high - low) * 15) AS level, low, high FROM (SELECT vec_id, unnest(range(64)) AS d, unnest(embedding)::DOUBLE AS x FROM embeddings) JOIN m USING (d))
SELECT vec_id, d::INTEGER AS d, level::INTEGER AS level, round(level / 15.0 * (high - low) + low, 6) AS x FROM l""")
def legacy_minmax_dequantize(spark, folder):
    rows = _table(spark, folder, "embeddings").select("vec_id", F.posexplode(vectors.doubles("embedding")).alias("d", "x"))
    ends = rows.groupBy("d").agg(F.min("x").alias("low"), F.max("x").alias("high"))
    level = vectors.minmax_level(F.col("x"), F.col("low"), F.col("high"))
    return rows.join(F.broadcast(ends), "d").withColumn("level", level).select("vec_id", "d", "level", F.round(vectors.minmax_value(F.col("level"), F.col("low"), F.col("high")), 6).alias("x"))


# searches


@query(f"""WITH {_CODEC}, s AS (SELECT query_id, doc_id, round(sum(m), 6) AS score FROM (
  SELECT q.query_id, q.qpos, e.doc_id, max(list_dot_product(q.vec, e.vec)) AS m FROM qry q JOIN cand USING (query_id) JOIN dec e ON e.doc_id = cand.doc_id GROUP BY ALL) GROUP BY ALL)
SELECT r.*, (SELECT count(*) FROM cand c WHERE c.query_id = r.query_id) AS candidates_searched, (SELECT count(DISTINCT cid) FROM prb p WHERE p.query_id = r.query_id) AS num_clusters_probed FROM ({_top('s')}) r""")
def quantized_search_topk(spark, folder):
    trained = _codec(spark, folder)
    encoded = cut(_encoded(spark, folder, trained), "encoded")
    return search.search_quantised(_search_queries(spark, folder), encoded, trained, ivf.postings_of_lists(encoded), ivf.effective_probes(CENTROIDS), TOP)


_STAGED = _CODEC + """,
approx AS (SELECT query_id, doc_id, round(sum(m), 6) AS approx FROM (
  SELECT cand.query_id, cand.doc_id, mat.qpos, max(mat.score) AS m FROM cand JOIN post USING (doc_id) JOIN mat ON mat.query_id = cand.query_id AND mat.cid = post.cid GROUP BY ALL) GROUP BY ALL),
prn AS (SELECT query_id, doc_id, approx, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY approx DESC, doc_id) AS rank FROM approx) WHERE rank <= 80)"""


def _approximate(spark, folder):
    c, found = _candidates(spark, folder)
    coded = _coded(spark, folder, c).groupBy("doc_id").agg(F.collect_set("cid").alias("codes"))
    return search.approximate(found, coded, _search_queries(spark, folder), maxsim.collect_matrix(c, "cid"))


@query(f"WITH {_STAGED} SELECT query_id, doc_id, approx FROM approx")
def approx_centroid_scores(spark, folder):
    return _approximate(spark, folder)


@query(f"WITH {_STAGED} SELECT query_id, doc_id, approx, rank::INTEGER AS rank FROM prn")
def prune_stages(spark, folder):
    return search.pruned(_approximate(spark, folder), FULL_SCORES)


@query(f"""WITH {_STAGED}, s AS (SELECT query_id, doc_id, round(sum(m), 6) AS score FROM (
  SELECT q.query_id, q.qpos, e.doc_id, max(list_dot_product(q.vec, e.vec)) AS m FROM qry q JOIN prn USING (query_id) JOIN dec e ON e.doc_id = prn.doc_id GROUP BY ALL) GROUP BY ALL) {_top('s')}""")
def staged_search_topk(spark, folder):
    trained = _codec(spark, folder)
    encoded = cut(_encoded(spark, folder, trained), "encoded")
    return search.search_staged(_search_queries(spark, folder), encoded, trained, ivf.postings_of_lists(encoded), search.SearchParameters(TOP, PROBES, FULL_SCORES, share=0.0))  # as many as the SQL states


def _subset_sql(condition: str) -> str:
    return f"""WITH {_EXACT}, kept AS (SELECT * FROM cscore WHERE doc_id IN ({condition})) {_top('kept')}"""


@query(_subset_sql("SELECT doc_id FROM tok WHERE label = 3"))
def subset_search(spark, folder):
    c = _centroids(spark, folder)
    subset = _tokens(spark, folder).where("label = 3").select("doc_id").distinct()
    return search.search_ivf(_search_queries(spark, folder), _docs(spark, folder), c, _postings(spark, folder, c), DIM, PROBES, TOP, subset=subset)


def _metadata(spark, folder):
    return _table(spark, folder, "documents").select(F.col("doc_id").alias(metadata.KEY), "lang", "source", F.coalesce("n_chars", F.lit(-1)).alias("n_chars"), "kind")


@query(_subset_sql("SELECT doc_id FROM documents WHERE lang ILIKE 'en%' AND n_chars > 300"))
def filtered_search_by_metadata(spark, folder):
    c = _centroids(spark, folder)
    subset = metadata.filtered(_metadata(spark, folder), "lang LIKE ? AND n_chars > ?", ["EN%", 300]).select(F.col(metadata.KEY).alias("doc_id"))
    return search.search_ivf(_search_queries(spark, folder), _docs(spark, folder), c, _postings(spark, folder, c), DIM, PROBES, TOP, subset=subset)


# metadata


@query("SELECT doc_id AS _subset_ FROM documents WHERE n_chars > 500 AND source ILIKE 'shelf%' AND kind IS NOT NULL")
def metadata_where(spark, folder):
    return metadata.where(_metadata(spark, folder), "n_chars > ? AND source LIKE ? AND kind IS NOT NULL", [500, "SHELF%"])


@query("SELECT doc_id AS _subset_, lang, source, coalesce(n_chars, -1) AS n_chars, kind FROM documents WHERE lang = 'fr' OR kind IS NULL")
def metadata_get(spark, folder):
    return metadata.get(_metadata(spark, folder), "lang = ? OR kind IS NULL", ["fr"])


@query("SELECT doc_id AS _subset_, lang, source, coalesce(n_chars, -1) AS n_chars, kind FROM documents WHERE doc_id IN (SELECT paper_id FROM documents UNION SELECT vec_id // 5 FROM embeddings)")
def metadata_get_subset(spark, folder):
    docs = _table(spark, folder, "documents")
    ids = docs.select(F.col("paper_id").alias(metadata.KEY)).union(_tokens(spark, folder).select("doc_id")).where(f"{metadata.KEY} is not null").distinct()
    return metadata.get(_metadata(spark, folder), subset=ids)


@query("""WITH c AS (SELECT c_custkey AS _subset_, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer), n AS (SELECT coalesce(max(_subset_) + 1, 0) AS first FROM c)
SELECT _subset_, name, balance, segment, NULL AS nation FROM c UNION ALL
SELECT first + row_number() OVER (ORDER BY s_suppkey) - 1, s_name, s_acctbal, NULL, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey CROSS JOIN n""")
def metadata_update_schema_evolution(spark, folder):
    c = _table(spark, folder, "customer").select(F.col("c_custkey").alias(metadata.KEY), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    s = _table(spark, folder, "supplier").join(F.broadcast(_table(spark, folder, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    s = s.select(F.col("s_suppkey").alias(metadata.KEY), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"), F.col("n_name").alias("nation"))
    fresh = renumbered(s, [metadata.KEY], metadata.KEY).withColumn(metadata.KEY, F.col(metadata.KEY) + metadata.next_key(c))
    return metadata.extended(c, fresh)


@query("SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS _subset_, c_name AS name, c_acctbal AS balance FROM customer WHERE NOT c_acctbal < 0")
def metadata_delete_resequence(spark, folder):
    c = _table(spark, folder, "customer").select(F.col("c_custkey").alias(metadata.KEY), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    return metadata.deleted(c, c.where("balance < 0").select(metadata.KEY))


# life of an index


@query(f"""WITH {_TOK}, gone AS (SELECT doc_id FROM tok WHERE pos = 0 AND label = 3)
SELECT row_number() OVER (ORDER BY doc_id) - 1 AS doc_idx, doc_id, count(*) AS n_tokens FROM tok WHERE doc_id NOT IN (SELECT doc_id FROM gone) GROUP BY doc_id""")
def index_delete_renumber(spark, folder):
    t = _tokens(spark, folder)
    gone = t.where("pos = 0 and label = 3").select("doc_id")
    left = t.join(gone, "doc_id", "left_anti").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_tokens"))
    return renumbered(left.withColumn("doc_idx", F.col("doc_id")), ["doc_id"], "doc_idx")


_APPENDED = f"""WITH {_TOK}, d AS (SELECT doc_id, count(*) AS n, bool_or(pos = 0 AND label >= 8) AS late FROM tok GROUP BY doc_id), b AS (SELECT count(*) AS n FROM d WHERE NOT late)
SELECT CASE WHEN late THEN (SELECT n FROM b) ELSE 0 END + row_number() OVER (PARTITION BY late ORDER BY doc_id) - 1 AS doc_idx, doc_id, n::INTEGER AS n_tokens FROM d"""


@query(_APPENDED)
def index_update_append(spark, folder):
    docs = _docs(spark, folder)
    late = _tokens(spark, folder).where("pos = 0 and label >= 8").select("doc_id")
    index = VectorIndex(spark, scratch(spark), DIM).create(docs.join(late, "doc_id", "left_anti"), rounds=1, centroids=CENTROIDS)
    index.update(docs.join(late, "doc_id", "left_semi"))
    return index.store.table("docs").select("doc_idx", "doc_id", "n_tokens")


@query("""WITH d AS (SELECT id, any_value(num_tokens) AS n FROM document_embeddings GROUP BY id)
SELECT count(*) AS num_documents, sum(n)::BIGINT AS num_embeddings, round(avg(n), 6) AS avg_doclen, 0.0::DOUBLE AS delta_ratio_percent, 64 AS embedding_dim, (SELECT num_centroids FROM codec) AS num_partitions FROM d""")
def index_info(spark, folder):
    d = _table(spark, folder, "document_embeddings").groupBy("id").agg(F.max("num_tokens").alias("n"))
    codec = _table(spark, folder, "codec").select("embedding_dim", F.col("num_centroids").alias("num_partitions"))
    s = d.agg(F.count(F.lit(1)).alias("num_documents"), F.sum(F.col("n").cast("long")).alias("num_embeddings"), F.round(F.avg("n"), 6).alias("avg_doclen"), F.lit(0.0).alias("delta_ratio_percent"))
    return s.join(F.broadcast(codec))


# evaluation

_JUDGED = _DOTS + """,
first AS (SELECT query_id, min_by(label, qpos) AS label FROM qry GROUP BY query_id),
rel AS (SELECT query_id, doc_id, count(*) AS rel FROM first JOIN tok USING (label) GROUP BY ALL),
run AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM score),
j AS (SELECT run.query_id, run.doc_id, rank, coalesce(rel, 0) AS rel FROM run LEFT JOIN rel USING (query_id, doc_id)),
r AS (SELECT query_id, count(*) AS r FROM rel GROUP BY query_id)"""


def _run_and_qrels(spark, folder):
    q = _search_queries(spark, folder)
    run = maxsim.scores(_docs(spark, folder), q, DIM).withColumnRenamed("query_id", "query")
    first = q.groupBy("query_id").agg(F.min_by("label", "qpos").alias("label"))
    rel = F.broadcast(first).join(_tokens(spark, folder).select("doc_id", "label"), "label").groupBy(F.col("query_id").alias("query"), "doc_id").agg(F.count(F.lit(1)).alias("rel"))
    return cut(run, "run"), cut(rel, "rel")


def _metric(spark, folder, metric):
    run, rel = _run_and_qrels(spark, folder)
    return evaluation.per_query(run, rel, metric).select(F.col("query").alias("query_id"), "value")


@query(f"""WITH {_JUDGED}, ideal AS (SELECT query_id, sum(rel / log2(rk + 1)) AS i FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, doc_id) AS rk FROM rel) WHERE rk <= 10 GROUP BY query_id)
SELECT query_id, round(sum(rel / log2(rank + 1)) / any_value(i), 6) AS value FROM j JOIN ideal USING (query_id) WHERE rank <= 10 GROUP BY query_id""")
def eval_ndcg_at_10(spark, folder):
    return _metric(spark, folder, "ndcg@10")


@query(f"WITH {_JUDGED}, h AS (SELECT query_id, rank, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS nth FROM j WHERE rel > 0) SELECT query_id, round(sum(nth / rank) / any_value(r.r), 6) AS value FROM h JOIN r USING (query_id) GROUP BY query_id")
def eval_map(spark, folder):
    return _metric(spark, folder, "map")


@query(f"WITH {_JUDGED} SELECT query_id, round(count(*) FILTER (j.rel > 0 AND j.rank <= 10) / any_value(r.r), 6) AS value FROM j JOIN r USING (query_id) GROUP BY query_id")
def eval_recall_at_k(spark, folder):
    return _metric(spark, folder, "recall@10")


@query(f"WITH {_JUDGED} SELECT query_id, count(*) FILTER (rel > 0 AND rank <= 10)::DOUBLE AS value FROM j GROUP BY query_id")
def eval_hits_at_k(spark, folder):
    return _metric(spark, folder, "hits@10")


@query("SELECT title AS query, count(*) AS n FROM papers WHERE title IS NOT NULL GROUP BY title HAVING count(*) > 1")
def duplicate_queries(spark, folder):
    return evaluation.duplicate_counts(_table(spark, folder, "papers").where("title is not null").select(F.col("title").alias("query")))


@query(f"WITH {_DOTS}, t AS ({_top('score')}) SELECT t.*, d.kind, d.lang FROM t LEFT JOIN documents d USING (doc_id)")
def results_with_documents(spark, folder):
    found = maxsim.search_exact(_docs(spark, folder), _search_queries(spark, folder), DIM, TOP)
    return evaluation.with_documents(found, _table(spark, folder, "documents").select("doc_id", "kind", "lang")).select("query_id", "rank", "doc_id", "score", "kind", "lang")


# text, records and statistics


@query("""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(trim(regexp_replace(lower(text), '[^A-Za-z0-9_\\s]', ' ', 'g')), '\\s+'), lambda x: x <> '') AS w FROM documents)
SELECT doc_id, (coalesce(len(w), 0) + 2)::INTEGER AS n, md5(list_aggregate(list_concat(['[CLS]'], coalesce(w, []), ['[SEP]']), 'string_agg', ' ')) AS digest FROM w""")
def tokenize_text(spark, folder):
    rows = _table(spark, folder, "documents").select("doc_id", text.tokens("text").alias("w"))
    return rows.select("doc_id", F.size("w").alias("n"), F.md5(F.array_join("w", " ")).alias("digest"))


@query("""SELECT id, ingested_at, trim(concat_ws('. ', nullif(title, ''), nullif(abstract, ''))) AS dotted, trim(concat_ws(' ', nullif(title, ''), nullif(abstract, ''))) AS plain FROM papers""")
def compose_text(spark, folder):
    return _table(spark, folder, "papers").select("id", "ingested_at", text.composed("title", "abstract", sep=". ").alias("dotted"), text.composed("title", "abstract").alias("plain"))


@query(r"SELECT id, ingested_at, trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g')) AS text, regexp_replace('http://archive.invalid/abs/' || arxiv_id, '^.*/abs/', '') AS short_id FROM papers")
def collapse_whitespace(spark, folder):
    return _table(spark, folder, "papers").select("id", "ingested_at", text.collapsed("text").alias("text"), text.after_last(F.concat(F.lit("http://archive.invalid/abs/"), F.col("arxiv_id"))).alias("short_id"))


@query("SELECT count(*) AS num_papers, round(avg(length(abstract)), 6) AS avg_abstract_length, count(DISTINCT year) AS num_years, min(year) AS min_year, max(year) AS max_year, count(DISTINCT venue) AS num_venues FROM papers")
def corpus_statistics(spark, folder):
    return statistics.corpus_statistics(_table(spark, folder, "papers"))


@query("SELECT venue AS value, count(*) AS n FROM papers WHERE venue IS NOT NULL GROUP BY venue ORDER BY n DESC, value LIMIT 5")
def top_venues(spark, folder):
    return statistics.top_values(_table(spark, folder, "papers"), "venue", 5)


@query("SELECT event_type, count(value) AS n, round(avg(value), 6) AS avg_value, round(min(value), 6) AS min_value, round(max(value), 6) AS max_value FROM events GROUP BY event_type")
def timing_stats(spark, folder):
    return statistics.timing_statistics(_table(spark, folder, "events"), "event_type", "value")


@query("""WITH s AS (SELECT sum(num_tokens)::BIGINT AS n FROM document_embeddings)
SELECT n AS tokens, n * 256 AS raw_bytes, n * 33 AS encoded_bytes, round(n * 256 / (n * 33), 6) AS ratio, round((n * 256 - n * 33) / (n * 256) * 100, 6) AS saved_percent FROM s""")
def compression_stats(spark, folder):
    s = _table(spark, folder, "document_embeddings").agg(F.sum(F.col("num_tokens").cast("long")).alias("tokens"))
    return s.select("tokens", *(c.alias(n) for n, c in statistics.compression_statistics(F.col("tokens"), DIM).items()))


@query(f"""WITH {_DOTS}, t AS ({_top('score')})
SELECT query_id, '{{"query_id":' || query_id || ',"passage_ids":[' || string_agg(doc_id::VARCHAR, ',' ORDER BY rank) || '],"scores":[' || string_agg(score::VARCHAR, ',' ORDER BY rank) || ']}}' AS json FROM t GROUP BY query_id""")
def result_json(spark, folder):
    return records.results_as_json(maxsim.search_exact(_docs(spark, folder), _search_queries(spark, folder), DIM, TOP))


@query(f"WITH {_RAG} SELECT doc_id, (len(flat) // 64)::INTEGER AS n_tokens, round(list_sum(flat), 4) AS total FROM rag WHERE len(flat) > 0 AND doc_id IN (SELECT doc_id FROM fine)")
def binary_embeddings_roundtrip(spark, folder):
    docs = corpus.checked(_ragged(spark, folder), DIM).where("valid and size(flat) > 0")
    files = cut(binary.embedding_blobs(docs, DIM), "files")
    ids = files.select("path", F.posexplode("ids").alias("ord", "doc_id"))
    rows = binary.embeddings_of(files).join(ids, ["path", "ord"])
    return rows.select("doc_id", "n_tokens", F.round(vectors.total(vectors.doubles("flat")), 4).alias("total"))


@query(f"WITH {_HEXED} SELECT h.doc_id, string_agg(cid::VARCHAR, ' ' ORDER BY t) AS codes, any_value(residuals) AS residuals, count(*)::INTEGER AS n_tokens FROM hexed h JOIN asg USING (doc_id) GROUP BY h.doc_id")
def index_file_roundtrip(spark, folder):
    trained = _codec(spark, folder)
    files = cut(binary.index_blobs(_encoded(spark, folder, trained), trained), "files")
    rows = binary.index_documents_of(files)
    return rows.select("doc_id", F.array_join(F.col("codes").cast("array<string>"), " ").alias("codes"), F.hex("residuals").alias("residuals"), "n_tokens")


@query(_APPENDED)
def streaming_incremental_add(spark, folder):
    place = scratch(spark)
    docs = _docs(spark, folder)
    late = _tokens(spark, folder).where("pos = 0 and label >= 8").select("doc_id")
    index = VectorIndex(spark, f"{place}/index", DIM).create(docs.join(late, "doc_id", "left_anti"), rounds=1, centroids=CENTROIDS)
    docs.join(late, "doc_id", "left_semi").write.parquet(f"{place}/arriving")
    schema = spark.read.parquet(f"{place}/arriving").schema
    stream = add_stream(index, spark.readStream.schema(schema).parquet(f"{place}/arriving"), f"{place}/checkpoint")
    stream.awaitTermination()
    return index.store.table("docs").select("doc_idx", "doc_id", "n_tokens")


from . import queries_index  # noqa: E402, F401  registers its queries
