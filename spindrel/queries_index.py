"""Queries over built indexes, file formats and the operators that the first module's queries don't reach, each with its SQL.

Indexes are built without rounds of k-means, from the evenly spaced tokens, so that SQL can follow them.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from .functions import bits, text, vectors
from .operators import corpus, encoders, evaluation, ivf, kmeans, maxsim, metadata, search
from .operators.index import VectorIndex
from .plans.lineage import cut, scratch
from .plans.ranks import running_total
from .queries import _CENT, _CODEC, _RAG, _ROUNDS, _RSCORE, CENTROIDS, DIM, TOP, _docs, _ragged, _search_queries, _table, _tokens, _top, _valid_queries, _wide, query
from .sources import binary, records

# built indexes


def _index(spark, folder, **options) -> VectorIndex:
    return VectorIndex(spark, scratch(spark), DIM).create(_docs(spark, folder), rounds=options.pop("rounds", 0), centroids=CENTROIDS, **options)


_PLAIN = _CENT + """,
pc AS (SELECT cid, list_transform(vec, lambda e: e / greatest(sqrt(list_dot_product(vec, vec)), 1e-12)) AS vec FROM cent),
pasg AS (SELECT t, doc_id, cid FROM (SELECT k.t, k.doc_id, c.cid, row_number() OVER (PARTITION BY k.t ORDER BY round(list_dot_product(k.vec, c.vec), 9) DESC, c.cid) AS r FROM tok k CROSS JOIN pc c) WHERE r = 1),
plng AS (SELECT a.t, unnest(range(64)) AS d, unnest(list_transform(range(1, 65), lambda i: round(k.vec[i] - c.vec[i], 9))) AS r FROM pasg a JOIN tok k USING (t) JOIN pc c USING (cid)),
srt AS (SELECT r, row_number() OVER (ORDER BY r) AS k, count(*) OVER () AS n FROM plng),
pcut AS (SELECT i, r AS cutoff FROM (SELECT unnest(range(1, 16)) AS i) JOIN srt ON k = ceil(i / 16.0 * n)),
pwt AS (SELECT b, r AS w FROM (SELECT unnest(range(16)) AS b) JOIN srt ON k = ceil((b + 0.5) / 16.0 * n)),
plev AS (SELECT t, d, count(cutoff) AS level FROM plng LEFT JOIN pcut ON cutoff <= r GROUP BY ALL),
praw AS (SELECT a.doc_id, l.t, l.d, c.vec[l.d + 1] + w.w AS x FROM plev l JOIN pasg a USING (t) JOIN pc c USING (cid) JOIN pwt w ON w.b = l.level),
pdec AS (SELECT doc_id, t, list(x / n ORDER BY d) AS vec FROM praw JOIN (SELECT t, greatest(sqrt(sum(x * x)), 1e-12) AS n FROM praw GROUP BY t) USING (t) GROUP BY doc_id, t)"""


def _plain(spark, folder) -> VectorIndex:
    return _index(spark, folder, codec="plain", held_out=1 << 40)


@query(f"""WITH {_PLAIN}, hx AS (SELECT a.doc_id, l.t, any_value(a.cid) AS cid, string_agg(substr('084C2A6E195D3B7F', level::INTEGER + 1, 1), '' ORDER BY l.d) AS h FROM plev l JOIN pasg a USING (t) GROUP BY a.doc_id, l.t)
SELECT doc_id AS doc_idx, doc_id, string_agg(cid::VARCHAR, ' ' ORDER BY t) AS codes, string_agg(h, '' ORDER BY t) AS residuals, count(*)::INTEGER AS n_tokens, 0::BIGINT AS chunk FROM hx GROUP BY doc_id""")
def index_plain_documents(spark, folder):
    docs = _plain(spark, folder).store.table("docs")
    return docs.select("doc_idx", "doc_id", F.array_join(F.col("codes").cast("array<string>"), " ").alias("codes"), F.hex("residuals").alias("residuals"), "n_tokens", "chunk")


@query(f"WITH {_PLAIN} SELECT DISTINCT cid, doc_id FROM pasg")
def index_plain_postings(spark, folder):
    return _plain(spark, folder).store.table("postings").select("cid", "doc_id")


@query(f"WITH {_PLAIN} SELECT 'cutoff' AS kind, (i - 1)::INTEGER AS i, cutoff AS x FROM pcut UNION ALL SELECT 'weight', b::INTEGER, w FROM pwt")
def index_plain_codec(spark, folder):
    row = _plain(spark, folder).store.table("codec")
    pos = lambda kind, c: row.select(F.lit(kind).alias("kind"), F.posexplode(c).alias("i", "x"))
    return pos("cutoff", "cutoffs").unionByName(pos("weight", "weights"))


_PLAIN_SCORES = _PLAIN + """, pbest AS (SELECT query_id, qpos, e.doc_id, max(list_dot_product(q.vec, e.vec)) AS m FROM qry q CROSS JOIN pdec e GROUP BY ALL),
pscore AS (SELECT query_id, doc_id, round(sum(m), 6) AS score FROM pbest GROUP BY ALL)"""


@query(f"WITH {_PLAIN_SCORES} SELECT query_id, rank, doc_id AS doc_idx, score FROM ({_top('pscore')})")
def index_plain_search(spark, folder):
    return _plain(spark, folder).search(_search_queries(spark, folder), TOP, n_full_scores=1 << 20, n_ivf_probe=CENTROIDS)


_ALLOWED = _CODEC + """, dscore AS (SELECT query_id, doc_id, round(sum(m), 6) AS score FROM (
  SELECT q.query_id, q.qpos, e.doc_id, max(list_dot_product(q.vec, e.vec)) AS m FROM qry q JOIN cand USING (query_id) JOIN dec e ON e.doc_id = cand.doc_id WHERE cand.doc_id % 3 = query_id GROUP BY ALL) GROUP BY ALL)"""


@query(f"WITH {_ALLOWED} SELECT query_id, rank, doc_id AS doc_idx, score FROM ({_top('dscore')})")
def index_subset_per_query(spark, folder):
    docs = _tokens(spark, folder).select("doc_id").distinct()
    allowed = docs.select((F.col("doc_id") % 3).alias("query_id"), "doc_id")
    return _index(spark, folder).search(_search_queries(spark, folder), TOP, n_ivf_probe=4, subset=allowed, staged=False)


_GONE = _CENT + """, gone AS (SELECT doc_id FROM tok WHERE pos = 0 AND label = 3), stay AS (SELECT a.*, dense_rank() OVER (ORDER BY doc_id) - 1 AS doc_idx FROM asg a WHERE doc_id NOT IN (SELECT doc_id FROM gone))"""


def _with_gone(spark, folder) -> VectorIndex:
    index = _index(spark, folder, metadata=[{"place": i} for i in range(_tokens(spark, folder).select("doc_id").distinct().count())])
    index.delete(_tokens(spark, folder).where("pos = 0 and label = 3").select("doc_id"))
    return index


@query(f"WITH {_GONE} SELECT doc_idx, doc_id, string_agg(cid::VARCHAR, ' ' ORDER BY t) AS codes, count(*)::INTEGER AS n_tokens, doc_id AS place FROM stay GROUP BY doc_idx, doc_id")
def index_delete(spark, folder):
    index = _with_gone(spark, folder)
    docs = index.store.table("docs").select("doc_idx", "doc_id", F.array_join(F.col("codes").cast("array<string>"), " ").alias("codes"), "n_tokens")
    return docs.join(index.metadata.withColumnRenamed(metadata.KEY, "doc_idx"), "doc_idx")


@query(f"WITH {_GONE} SELECT DISTINCT cid, doc_idx FROM stay")
def index_delete_postings(spark, folder):
    return _with_gone(spark, folder).store.table("postings").select("cid", F.col("doc_id").alias("doc_idx"))


# base: documents with an even id, whose tokens train; the others come later
_GROWN = """tok AS (SELECT vec_id AS t, vec_id // 5 AS doc_id, embedding::DOUBLE[] AS vec FROM embeddings),
btok AS (SELECT *, row_number() OVER (ORDER BY t) - 1 AS r, count(*) OVER () AS n FROM tok WHERE doc_id % 2 = 0),
cent AS (SELECT cid, vec FROM (SELECT unnest(range(16)) AS cid) JOIN btok ON r = cid * n // 16),
asg AS (SELECT t, doc_id, cid FROM (SELECT k.t, k.doc_id, c.cid, row_number() OVER (PARTITION BY k.t ORDER BY round(pow(list_distance(k.vec, c.vec), 2), 9), c.cid) AS r FROM tok k CROSS JOIN cent c) WHERE r = 1),
num AS (SELECT doc_id, CASE WHEN doc_id % 2 = 1 THEN (SELECT count(DISTINCT doc_id) FROM btok) ELSE 0 END + row_number() OVER (PARTITION BY doc_id % 2 ORDER BY doc_id) - 1 AS doc_idx FROM (SELECT DISTINCT doc_id FROM tok))"""


def _grown(spark, folder) -> VectorIndex:
    docs = _docs(spark, folder)
    index = VectorIndex(spark, scratch(spark), DIM).create(docs.where("doc_id % 2 = 0"), rounds=0, centroids=CENTROIDS)
    index.update(docs.where("doc_id % 2 = 1"))
    index.compact()
    return index


@query(f"WITH {_GROWN} SELECT doc_idx, doc_id, string_agg(cid::VARCHAR, ' ' ORDER BY t) AS codes FROM asg JOIN num USING (doc_id) GROUP BY doc_idx, doc_id")
def index_update_documents(spark, folder):
    return _grown(spark, folder).store.table("docs").select("doc_idx", "doc_id", F.array_join(F.col("codes").cast("array<string>"), " ").alias("codes"))


@query(f"WITH {_GROWN} SELECT DISTINCT cid, doc_idx FROM asg JOIN num USING (doc_id)")
def index_compact_postings(spark, folder):
    return _grown(spark, folder).store.table("postings").select("cid", F.col("doc_id").alias("doc_idx"))


@query("""SELECT count(DISTINCT vec_id // 5) AS num_documents, count(DISTINCT vec_id // 5) AS base_documents, 0 AS pending_deltas, 0.0::DOUBLE AS delta_ratio_percent, 64 AS embedding_dim, 16 AS num_partitions, 4 AS nbits, 1 AS num_chunks,
count(*) AS num_embeddings, 5.0::DOUBLE AS avg_doclen FROM embeddings""")
def index_info_built(spark, folder):
    return _index(spark, folder).info().drop("loaded")


# searches with a query of its own for each document whose id is divisible by 100

_RIVF = _RSCORE + """, ftok AS (SELECT r.*, row_number() OVER (ORDER BY doc_id, pos) - 1 AS t, count(*) OVER () AS n FROM rtok r JOIN fine USING (doc_id)),
rcent AS (SELECT cid, vec FROM (SELECT unnest(range(16)) AS cid) JOIN ftok ON t = cid * n // 16),
rasg AS (SELECT DISTINCT doc_id, cid FROM (SELECT k.doc_id, c.cid, row_number() OVER (PARTITION BY k.t ORDER BY round(pow(list_distance(k.vec, c.vec), 2), 9), c.cid) AS r FROM ftok k CROSS JOIN rcent c) WHERE r = 1),
rprb AS (SELECT DISTINCT query_id, cid FROM (SELECT query_id, cid, row_number() OVER (PARTITION BY query_id, qpos ORDER BY round(list_dot_product(q.vec, c.vec), 6) DESC, cid) AS r FROM rqry q CROSS JOIN rcent c WHERE query_id IN (SELECT doc_id FROM fine)) WHERE r <= 4),
rcand AS (SELECT DISTINCT query_id, doc_id FROM rprb JOIN rasg USING (cid)), rfound AS (SELECT * FROM rscore JOIN rcand USING (query_id, doc_id))"""


@query(f"WITH {_RIVF} {_top('rfound')}")
def ivf_search_documents(spark, folder):
    docs = corpus.checked(_ragged(spark, folder), DIM).where("valid and size(flat) > 0").select("doc_id", "flat")
    tokens = cut(corpus.unpacked(docs, DIM).select(F.struct("doc_id", "pos").alias("t"), "doc_id", "pos", "vec"), "tokens")
    centroids = cut(kmeans.evenly_spaced(tokens, CENTROIDS), "centroids")
    lists = kmeans.assigned(tokens, centroids, keep=["doc_id"]).select("cid", "doc_id").distinct()
    return search.search_ivf(_valid_queries(spark, folder), docs, centroids, lists, DIM, ivf.effective_probes(CENTROIDS), TOP)


@query(f"WITH {_RSCORE} SELECT query_id, doc_id, round(avg(m), 6) AS score FROM rbest GROUP BY ALL")
def maxsim_ragged_average(spark, folder):
    return maxsim.scores(_ragged(spark, folder), _valid_queries(spark, folder), DIM, average=True)


@query("""WITH d AS (SELECT title AS query, row_number() OVER (ORDER BY id, ingested_at) AS query_no FROM papers WHERE title IS NOT NULL), r AS (SELECT query, length(query) AS doc_id FROM d GROUP BY query)
SELECT query_no, query, doc_id FROM d JOIN r USING (query)""")
def duplicate_query_results(spark, folder):
    papers = _table(spark, folder, "papers").where("title is not null")
    asked = running_total(papers.select("id", "ingested_at", F.col("title").alias("query"), F.lit(1).alias("one")), ["id", "ingested_at"], "one", "before").select((F.col("before") + 1).alias("query_no"), "query")
    results = asked.select("query").distinct().withColumn("doc_id", F.length("query").cast("long"))
    return evaluation.with_duplicates(asked, results).select("query_no", "query", "doc_id")


# training


_PICKED = """pick AS (WITH RECURSIVE r(i, s, arr) AS (
  SELECT 0::BIGINT, 123456789::HUGEINT, (SELECT list(t ORDER BY t) FROM tok)
  UNION ALL SELECT i + 1, z, list_transform(arr, lambda x, p: CASE WHEN p = i + 1 THEN arr[j + 1] WHEN p = j + 1 THEN arr[i + 1] ELSE x END)
  FROM (SELECT i, arr, z, i + (z % (len(arr) - i))::BIGINT AS j FROM (SELECT i, arr, (s * 1664525 + 1013904223) % 18446744073709551616::HUGEINT AS z FROM r WHERE i < 128)))
SELECT p AS t, arr[p + 1] AS key FROM (SELECT arr, unnest(range(128)) AS p FROM r WHERE i = 128)),
tk AS (SELECT pick.t, tok.vec FROM pick JOIN tok ON tok.t = pick.key)"""


@query(f"""WITH {_CENT}, {_PICKED}, c0 AS (SELECT c.cid, k.vec FROM (SELECT unnest(range(16)) AS cid) c JOIN (SELECT vec, row_number() OVER (ORDER BY t) - 1 AS r FROM tk) k ON k.r = c.cid * 8),
a1 AS (SELECT t, cid FROM (SELECT k.t, c.cid, row_number() OVER (PARTITION BY k.t ORDER BY round(pow(list_distance(k.vec, c.vec), 2), 9), c.cid) AS r FROM tk k CROSS JOIN c0 c) WHERE r = 1),
m1 AS (SELECT cid, d, avg(x) AS x FROM (SELECT a.cid, unnest(range(64)) AS d, unnest(k.vec) AS x FROM a1 a JOIN tk k USING (t)) GROUP BY ALL),
c1 AS (SELECT cid, list(x ORDER BY d) AS vec FROM m1 GROUP BY cid UNION ALL SELECT cid, vec FROM c0 WHERE cid NOT IN (SELECT cid FROM m1))
SELECT cid, unnest(range(64))::INTEGER AS d, round(unnest(vec), 6) AS x FROM c1""")
def kmeans_subsample(spark, folder):
    return _wide(kmeans.train(_tokens(spark, folder), CENTROIDS, 1, per=8))


@query(f"""WITH {_CENT}{_ROUNDS} SELECT cid, unnest(range(64))::INTEGER AS d, round(unnest(list_transform(vec, lambda e: e / greatest(sqrt(list_dot_product(vec, vec)), 1e-12))), 6) AS x FROM c5""")
def kmeans_normalised(spark, folder):
    return _wide(kmeans.train(_tokens(spark, folder), CENTROIDS, 5, normalise=True))


@query("""WITH b AS (SELECT unnest([1, 2, 4, 8]) AS bits), v AS (SELECT bits, byte, p FROM b, (SELECT unnest(range(256)) AS byte), (SELECT unnest(range(8)) AS p) WHERE p < 8 // bits)
SELECT bits::INTEGER AS bits, byte::INTEGER AS byte, p::INTEGER AS pos, (SELECT sum(((byte >> (7 - (p * bits + k))) & 1) << k) FROM (SELECT unnest(range(8)) AS k) WHERE k < bits)::BIGINT AS value FROM v""")
def byte_tables(spark, folder):
    rows = [(n, byte, pos, int(x)) for n in (1, 2, 4, 8) for byte, held in enumerate(bits.byte_table(n)) for pos, x in enumerate(held)]
    return spark.createDataFrame(rows, "bits int, byte int, pos int, value long")


# encoders


_WORDS = """w AS (SELECT doc_id, least(coalesce(len(list_filter(regexp_split_to_array(trim(regexp_replace(lower(text), '[^A-Za-z0-9_\\s]', ' ', 'g')), '\\s+'), lambda x: x <> '')), 0) + 2, 32) AS n FROM documents)"""


@query(f"WITH {_WORDS} SELECT doc_id, n::INTEGER AS n_tokens, round(n, 4)::DOUBLE AS squares FROM w")
def demonstration_encoder(spark, folder):
    docs = encoders.demonstration_vectors(_table(spark, folder, "documents"), 8)
    return docs.select("doc_id", (F.size("flat") / 8).cast("int").alias("n_tokens"), F.round(F.aggregate("flat", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")), 4).alias("squares"))


@query("SELECT doc_id, len(coalesce(text, ''))::DOUBLE AS length, (CASE WHEN coalesce(text, '') = '' THEN 0 ELSE 1 END)::DOUBLE AS filled FROM documents")
def encode_with_model(spark, folder):
    def load():
        return lambda texts: [np.array([[len(t), bool(t)]]) for t in texts]

    return encoders.encode_texts(_table(spark, folder, "documents"), load).select("doc_id", F.col("flat")[0].cast("double").alias("length"), F.col("flat")[1].cast("double").alias("filled"))


@query(f"WITH {_RAG} SELECT doc_id, (CASE WHEN n <= 2 THEN n ELSE 1 + greatest(1, (n - 1) // 2) END)::INTEGER AS n_tokens, round(vec[1], 6) AS first FROM (SELECT doc_id, len(flat) // 64 AS n, flat AS vec FROM rag WHERE doc_id IN (SELECT doc_id FROM fine))")
def token_pooling(spark, folder):
    valid = corpus.checked(_ragged(spark, folder), DIM).where("valid and size(flat) > 0").select("doc_id", "flat")
    return encoders.pooled(valid, DIM).select("doc_id", (F.size("flat") / DIM).cast("int").alias("n_tokens"), F.round(F.col("flat")[0], 6).alias("first"))


# files and records


def _valid(spark, folder):
    return corpus.checked(_ragged(spark, folder), DIM).where("valid and size(flat) > 0").select("doc_id", "flat")


_BUFFER = f"WITH {_RAG} SELECT doc_id, (len(flat) // 64)::INTEGER AS n_tokens, round(flat[1], 6) AS first, round(flat[-1], 6) AS last, round(list_sum(flat), 4) AS total FROM rag WHERE len(flat) > 0 AND doc_id IN (SELECT doc_id FROM fine)"


@query(_BUFFER)
def flat_buffer_documents(spark, folder):
    docs = _valid(spark, folder).withColumn("num_tokens", (F.size("flat") / DIM).cast("int"))
    placed = running_total(docs, ["doc_id"], "num_tokens", "start")
    values = placed.select((F.col("start") * DIM).alias("i"), vectors.doubles("flat").alias("xs"))
    cutouts = corpus.from_flat_buffer(values, docs.select(F.col("doc_id").alias("ord"), "doc_id", "num_tokens"), DIM)
    return cutouts.select("doc_id", (F.size("flat") / DIM).cast("int").alias("n_tokens"), F.round(F.col("flat")[0], 6).alias("first"), F.round(F.element_at("flat", -1), 6).alias("last"), F.round(vectors.total(F.col("flat")), 4).alias("total"))


@query("SELECT doc_id, 5::INTEGER AS n_tokens, round(sum(list_sum(v)), 4) AS total FROM (SELECT vec_id // 5 AS doc_id, embedding::FLOAT[]::DOUBLE[] AS v FROM embeddings) GROUP BY doc_id")
def uniform_embeddings_roundtrip(spark, folder):
    place = scratch(spark)
    files = cut(binary.embedding_blobs(_docs(spark, folder), DIM, uniform=True), "files")
    binary.write_blobs(files, place)
    ids = files.select(F.col("path").alias("name"), F.posexplode("ids").alias("ord", "doc_id"))
    rows = binary.read_embeddings(spark, place, uniform=True).withColumn("name", F.substring_index("path", "/", -1)).join(ids, ["name", "ord"])
    return rows.select("doc_id", "n_tokens", F.round(vectors.total(vectors.doubles("flat")), 4).alias("total"))


@query("""WITH v AS (SELECT vec_id, unnest(range(64)) AS d, unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (SELECT d, min(x) AS low, max(x) AS high FROM v GROUP BY d)
SELECT vec_id // 5 AS doc_id, 320 AS n, round(sum(floor((x - low) / (high - low) * 15) / 15 * (high::FLOAT::DOUBLE - low::FLOAT::DOUBLE) + low::FLOAT::DOUBLE), 2) AS total FROM v JOIN m USING (d) GROUP BY 1""")
def minmax_index_roundtrip(spark, folder):
    docs = _docs(spark, folder)
    ends = _tokens(spark, folder).select(F.posexplode("vec").alias("d", "x")).groupBy("d").agg(F.min("x").alias("low"), F.max("x").alias("high"))
    place = scratch(spark)
    files = cut(binary.minmax_blobs(docs, ends, DIM), "files")
    binary.write_blobs(files, place)
    ids = files.select(F.col("path").alias("name"), F.posexplode("ids").alias("at", "id"))
    rows = binary.read_minmax_documents(spark, place).withColumn("name", F.substring_index("path", "/", -1)).withColumnRenamed("doc_id", "at").join(ids, ["name", "at"])
    return rows.select(F.col("id").alias("doc_id"), F.size("flat").alias("n"), F.round(vectors.total(F.col("flat")), 2).alias("total"))


def _papers(spark, folder):
    return corpus.latest(_table(spark, folder, "papers").select("id", "title", "abstract", "authors", "venue", "year", "keywords", "arxiv_id", "doi", "ingested_at"), "id", "ingested_at")


_ONCE = "SELECT id, any_value(title) AS title, any_value(abstract) AS abstract, any_value(venue) AS venue, any_value(year) AS year, any_value(len(authors)) AS n_authors FROM papers GROUP BY id"


def _brief(df):
    return df.select("id", "title", "abstract", "venue", "year", F.when(F.col("authors").isNotNull(), F.size("authors")).cast("long").alias("n_authors"))


@query(_ONCE)
def json_lines_papers(spark, folder):
    place = scratch(spark)
    records.write_papers(_papers(spark, folder), f"{place}/good")
    # lines that can't be read are left out
    spark.createDataFrame([("{bad",), ("",), ('{"id": "x", ',)], "value string").write.text(f"{place}/bad")
    return _brief(records.read_paper_lines(spark, f"{place}/*"))


@query(f"{_ONCE} HAVING id % 7 = 0")
def json_array_papers(spark, folder):
    place = scratch(spark)
    some = _papers(spark, folder).where("id % 7 = 0")
    # an object with the records of a group under ``papers``, a file per object
    groups = some.groupBy(F.pmod(F.xxhash64("id"), F.lit(8)).alias("g")).agg(F.to_json(F.struct(F.collect_list(F.struct(*some.columns)).alias("papers"))).alias("value"))
    groups.write.partitionBy("g").text(place)
    return _brief(records.read_papers(spark, f"{place}/*"))


@query("""SELECT doc_id::VARCHAR AS id, trim(concat_ws(' ', nullif(kind, ''), nullif(text, '')), ' ') AS text FROM documents WHERE text IS NOT NULL""")
def beir_documents(spark, folder):
    place = scratch(spark)
    docs = _table(spark, folder, "documents").where("text is not null")
    docs.select(F.col("doc_id").cast("string").alias("_id"), F.col("kind").alias("title"), "text").write.json(f"{place}/corpus.jsonl")
    docs.select(F.col("doc_id").cast("string").alias("_id"), "text").write.json(f"{place}/queries.jsonl")
    docs.select(F.col("doc_id").cast("string").alias("query-id"), F.col("paper_id").cast("string").alias("corpus-id"), F.lit(1).alias("score")).write.csv(f"{place}/qrels/test.tsv", sep="\t", header=True)
    return records.read_beir(spark, place)[0]


@query("SELECT text AS query, p.id::VARCHAR AS doc_id, p.n::INTEGER AS rel FROM documents d JOIN (SELECT id, count(*) AS n FROM papers GROUP BY id) p ON d.paper_id = p.id WHERE d.text <> ''")
def beir_judgements(spark, folder):
    place = scratch(spark)
    docs = _table(spark, folder, "documents").where("text <> ''")
    counts = _table(spark, folder, "papers").groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    docs.select(F.col("doc_id").cast("string").alias("_id"), "text").write.json(f"{place}/queries.jsonl")
    counts.select(F.col("id").cast("string").alias("_id"), F.lit("").alias("title"), F.lit("").alias("text")).write.json(f"{place}/corpus.jsonl")
    marks = docs.join(counts, F.col("paper_id") == F.col("id")).select(F.col("doc_id").cast("string").alias("query-id"), F.col("id").cast("string").alias("corpus-id"), F.col("n").alias("score"))
    marks.write.csv(f"{place}/qrels/test.tsv", sep="\t", header=True)
    return records.read_beir(spark, place)[2]


@query("""SELECT 'x_' || regexp_replace(arxiv_id, '^.*/abs/', '') AS id, count(*) AS n, max(published) AS published FROM papers WHERE arxiv_id <> '' AND published <> '' GROUP BY 1""")
def archive_feed_records(spark, folder):
    place = scratch(spark)
    rows = _table(spark, folder, "papers").where("arxiv_id <> '' and published <> ''")
    entry = F.concat(F.lit("<entry><id>http://a.invalid/abs/"), "arxiv_id", F.lit("</id><title>T\n  x</title><summary> s </summary><published>"), "published", F.lit('</published><category term="c"/></entry>'))
    pages = rows.groupBy(F.pmod(F.xxhash64("arxiv_id"), F.lit(8)).alias("page")).agg(F.concat(F.lit("<feed>"), F.array_join(F.collect_list(entry), ""), F.lit("</feed>")).alias("value"))
    pages.write.partitionBy("page").text(place)
    return records.read_archive_feed(spark, f"{place}/*", "x").groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.max("published").alias("published"))


@query("SELECT i AS id, 'Venue ' AS venue, true AS dated FROM (SELECT unnest(range(100)) AS i)")
def synthetic_papers(spark, folder):
    return records.synthetic_papers(spark, 100).select("id", F.substring("venue", 1, 6).alias("venue"), F.col("year").between(2015, 2024).alias("dated"))


@query("""WITH n AS (SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS k, n_name AS name, n_regionkey AS region FROM nation)
SELECT k AS _subset_, name, region, NULL AS comment FROM n UNION ALL SELECT (SELECT count(*) FROM n) + row_number() OVER (ORDER BY r_regionkey) - 1, r_name, NULL, 'region' FROM region""")
def metadata_from_rows(spark, folder):
    nations = [{"name": r["n_name"], "region": r["n_regionkey"]} for r in _table(spark, folder, "nation").orderBy("n_nationkey").collect()]
    regions = [{"name": r["r_name"], "comment": "region"} for r in _table(spark, folder, "region").orderBy("r_regionkey").collect()]
    return metadata.appended(metadata.from_rows(spark, nations), regions)
