import datetime
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrel.operators import codec as codecs
from spindrel.operators import evaluation, kmeans, maxsim
from spindrel.operators import metadata as meta
from spindrel.operators.index import VectorIndex
from spindrel.plans.store import Store
from spindrel.session import ship
from spindrel.sources import binary, records
from spindrel.streaming.incremental import add_stream

DIM = 16


def documents(spark, n=60, seed=0, first=0, tokens=(3, 8)):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        x = rng.standard_normal((rng.integers(*tokens), DIM))
        rows.append((first + i, (x / np.linalg.norm(x, axis=1, keepdims=True)).ravel().tolist()))
    return spark.createDataFrame(rows, "doc_id long, flat array<double>")


def questions(spark, n=4, seed=5):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame([(q, p, (lambda x: (x / np.linalg.norm(x)).tolist())(rng.standard_normal(DIM))) for q in range(n) for p in range(3)], "query_id long, qpos long, vec array<double>")


@pytest.fixture()
def index(spark, tmp_path):
    return VectorIndex(ship(spark), f"file://{tmp_path}/index", DIM)


def test_shape(spark, tmp_path):
    rng = np.random.default_rng(0)
    docs = spark.createDataFrame([(i, rng.standard_normal(40 * 32).tolist()) for i in range(60)], "doc_id long, flat array<float>")
    queries = spark.createDataFrame([(q, p, rng.standard_normal(32).tolist()) for q in range(6) for p in range(5)], "query_id long, qpos long, vec array<float>")
    index = VectorIndex(ship(spark), f"file://{tmp_path}/i", 32).create(docs, codec="plain", rounds=2, centroids=64)
    found = index.search_lists(queries, top_k=10)
    assert len(found) == 6 and all(len(x) == 10 for x in found)


@pytest.mark.parametrize("kind", ["centred", "plain"])
def test_probing_all_is_brute_force_over_decoded_vectors(spark, index, kind):
    index.create(documents(spark), codec=kind, centroids=12, rounds=2)
    docs = index.store.table("docs").select(F.col("doc_idx").alias("doc_id"), "codes", "residuals")
    decoded = codecs.decode(docs, index.codec())
    queries = questions(spark)
    want = sorted(map(tuple, maxsim.search_exact(decoded, queries, DIM, 5).collect()))
    got = sorted(map(tuple, index.search(queries, top_k=5, n_ivf_probe=12).select("query_id", "rank", F.col("doc_idx").alias("doc_id"), "score").collect()))
    assert got == want


@pytest.mark.parametrize("bits", [1, 2, 4, 8])
def test_more_bits_decode_better(spark, bits):
    docs = documents(spark, 40)
    tokens = docs.select((F.col("doc_id") * 100).alias("t"), F.slice("flat", 1, DIM).alias("vec"))
    book = kmeans.train(tokens, 6, 2, normalise=True)
    trained = codecs.train_plain(tokens, book, bits)
    encoded = codecs.encode(docs, trained, "dot")
    assert encoded.where(f"octet_length(residuals) <> n_tokens * {DIM * bits // 8}").count() == 0
    error = codecs.reconstruction_error(docs, codecs.decode(encoded, trained)).agg(F.avg("mse")).first()[0]
    assert error < {1: 0.06, 2: 0.03, 4: 0.006, 8: 0.003}[bits]


def test_life(spark, index):
    a, b = documents(spark, 40, 1), documents(spark, 6, 2, first=500)
    index.create(a, centroids=8, rounds=1, metadata=[{"name": f"d{i}"} for i in range(40)])
    assert index.update(b.limit(3), [{"name": "new", "extra": 1}] * 3) == 3
    assert index.facts["pending"] == 3 and index.store.has("postings_delta")
    assert index.get("extra = ?", [1]).count() == 3
    before = {r["doc_id"]: r["codes"] for r in index.store.table("docs").collect()}
    assert index.update(b.join(b.limit(3), "doc_id", "left_anti")) == 3  # 6 of 40: compacted
    assert index.facts["pending"] == 0 and not index.store.has("postings_delta")
    rows = index.store.table("docs").orderBy("doc_idx").collect()
    assert [r["doc_idx"] for r in rows] == list(range(46)) and all(r["codes"] == before.get(r["doc_id"], r["codes"]) for r in rows)
    assert index.metadata.count() == 46 and index.get(subset=[45]).first()["name"] is None
    assert index.delete([0, 3, 45]) == 3 and index.delete([]) == 0
    rows = index.store.table("docs").orderBy("doc_idx").collect()
    assert [r["doc_idx"] for r in rows] == list(range(43)) and rows[0]["doc_id"] == 1
    assert [r["_subset_"] for r in index.get().collect()] == list(range(43)) and index.get(subset=0).first()["name"] == "d1"
    listed = index.store.table("postings").select("doc_id").distinct().count()
    assert listed == 43
    with pytest.raises(ValueError):
        index.delete([5, 2])
    assert index.store.table("docs").count() == 43
    info = index.info().first()
    assert info["num_documents"] == 43 and info["pending_deltas"] == 0
    index.store.clean()
    assert len(index.store.versions()) == 1 and index.store.table("docs").count() == 43


def test_subsets(spark, index):
    index.create(documents(spark, 30), centroids=4, rounds=1, metadata=[{"even": i % 2 == 0} for i in range(30)])
    queries = questions(spark, 2)
    assert {r["doc_idx"] for r in index.search(queries, subset=[1, 2, 3], n_ivf_probe=4).collect()} == {1, 2, 3}
    assert index.search(queries, subset=[]).count() == 0
    assert {(r["query_id"], r["doc_idx"]) for r in index.search(queries, subset=[[4], [5, 6]], n_ivf_probe=4).collect()} == {(0, 4), (1, 5), (1, 6)}
    assert {r["doc_idx"] % 2 for r in index.search(queries, subset=index.where("even = ?", [1]), n_ivf_probe=4).collect()} == {0}
    with pytest.raises(ValueError):
        index.search(queries, subset=[[1]])


def test_create_again_replaces_metadata(spark, index):
    index.create(documents(spark, 10), centroids=2, metadata=[{"a": 1}] * 10)
    index.create(documents(spark, 12), centroids=2)
    assert not index.store.has("metadata") and index.store.table("docs").count() == 12
    with pytest.raises(ValueError):
        index.create(documents(spark, 3), metadata=[{}])
    with pytest.raises(FileNotFoundError):
        index.where("a = 1")


def test_stream(spark, index, tmp_path):
    index.create(documents(spark, 20), centroids=4, rounds=1)
    late = documents(spark, 5, 3, first=100)
    late.write.parquet(f"{tmp_path}/in")
    run = lambda: add_stream(index, spark.readStream.schema(late.schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/checkpoint").awaitTermination()
    run()
    assert index.store.table("docs").count() == 25
    documents(spark, 2, 4, first=200).write.mode("append").parquet(f"{tmp_path}/in")
    run()
    run()
    assert index.store.table("docs").count() == 27 and sorted(r["doc_idx"] for r in index.store.table("docs").collect()) == list(range(27))


def test_store_commits(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    with pytest.raises(FileNotFoundError):
        store.table("a")
    store.commit(replace={"a": spark.range(3)})
    store.commit(append={"a": spark.range(3, 5)}, facts={"x": 1})
    assert store.table("a").count() == 5 and store.table("a", 1).count() == 3 and store.manifest()["facts"] == {"x": 1}


# metadata


def test_metadata_trace(spark):
    rows = [{"name": "Alice", "age": 30, "height": 5.5, "join_date": datetime.date(2020, 5, 17)}, {"name": "Bob", "age": 25, "height": 6.0, "join_date": datetime.date(2021, 6, 21), "town": "New York"}]
    m = meta.from_rows(spark, rows)
    assert m.dtypes == [("_subset_", "bigint"), ("name", "string"), ("age", "bigint"), ("height", "double"), ("join_date", "string"), ("town", "string")]
    assert [tuple(r) for r in meta.get(m).collect()] == [(0, "Alice", 30, 5.5, "2020-05-17", None), (1, "Bob", 25, 6.0, "2021-06-21", "New York")]
    ids = lambda m, *a: [r[0] for r in meta.where(m, *a).collect()]
    assert ids(m, "age < ? AND height >= ? AND join_date > ?", (28, 6.0, "2021-01-01")) == [1]
    m = meta.deleted(m, [1])
    assert ids(m, "age < ? AND height >= ?", (28, 6.0)) == [] and ids(m, "age > ?", (28,)) == [0]
    m = meta.appended(m, [{"name": "Charlie", "age": 35, "height": 5.8, "join_date": datetime.date(2019, 3, 15), "first_name": "Charles"}])
    assert ids(m, "age > ?", (28,)) == [0, 1]
    last = meta.get(m, "age > ?", (28,)).collect()[1]
    assert last["_subset_"] == 1 and last["town"] is None and last["first_name"] == "Charles"
    m = meta.deleted(m, [0])
    assert [(r["_subset_"], r["name"]) for r in meta.get(m, "age > ?", (28,)).collect()] == [(0, "Charlie")]


def test_metadata_errors_and_dialect(spark):
    m = meta.from_rows(spark, [{"a": 1, "t": "Abc"}, {"a": None, "t": "xbc", "e": None}])
    assert dict(m.dtypes)["e"] == "binary"
    for bad in ("1a", "a b", "a\n", ""):
        with pytest.raises(ValueError):
            meta.from_rows(spark, [{bad: 1}])
    with pytest.raises(ValueError):
        meta.deleted(m, [1, 0])
    with pytest.raises(TypeError):
        meta.deleted(m, ["x"])
    with pytest.raises(ValueError):
        meta.get(m, "a = 1", subset=[0])
    assert meta.get(m, subset=[]).count() == 0 and meta.deleted(m, []).count() == 2
    assert [r[0] for r in meta.where(m, "t LIKE 'ABC' AND t <> 'a LIKE b'").collect()] == [0]
    for bad in ("a > 1) union select 1", "a = 1; drop table x", "t GLOB 'a*'"):
        with pytest.raises(ValueError):
            meta.where(m, bad)
    assert meta.from_rows(spark, []).count() == 0 and meta.next_key(meta.from_rows(spark, [])) == 0
    grown = meta.appended(m, [{"e": 2.5}])
    assert dict(grown.dtypes)["e"] == "double" and grown.count() == 3


# metrics


def test_metrics_by_hand(spark):
    run = spark.createDataFrame([("q", "d3", 3.0), ("q", "d1", 2.0), ("q", "d2", 1.0), ("other", "d1", 1.0)], "query string, doc_id string, score double")
    qrels = spark.createDataFrame([("q", "d1", 1), ("q", "d2", 1), ("q", "d9", 1), ("empty", "d1", 1)], "query string, doc_id string, rel int")
    value = lambda m: {r["query"]: r["value"] for r in evaluation.per_query(run, qrels, m).collect()}
    assert value("hits@1")["q"] == 0 and value("hits@3")["q"] == 2
    assert value("recall@3") == {"q": 0.666667, "empty": 0.0} and value("map")["q"] == 0.388889 and value("ndcg@10")["q"] == 0.530721
    assert {r["metric"]: r["value"] for r in evaluation.evaluate(run, qrels, ["hits@3"]).collect()} == {"hits@3": 1.0}
    with pytest.raises(ValueError):
        evaluation.per_query(run, qrels, "mrr")


def test_metrics_fixture(spark):
    run = spark.createDataFrame([("query1", "1", 0.9), ("query1", "2", 0.8), ("query2", "3", 0.7), ("query2", "4", 0.6)], "query string, doc_id string, score double")
    qrels = run.select("query", "doc_id", F.lit(1).alias("rel"))
    assert {r["metric"]: r["value"] for r in evaluation.evaluate(run, qrels, ["ndcg@10", "hits@1"]).collect()} == {"ndcg@10": 1.0, "hits@1": 1.0}
    twice = spark.createDataFrame([(0, "query1"), (1, "query2"), (2, "query1")], "query_no int, query string")
    assert evaluation.with_duplicates(twice, run).count() == 6
    assert evaluation.duplicate_counts(twice).first()["n"] == 2


# files


def test_binary_files(spark, tmp_path):
    ship(spark)
    rng = np.random.default_rng(2)
    docs = [rng.standard_normal((n, 4)).astype(np.float32) for n in (2, 0, 5)]
    (tmp_path / "a.bin").write_bytes(binary.write_embeddings(docs))
    got = binary.read_embeddings(spark, f"{tmp_path}/a.bin").orderBy("ord").collect()
    assert [r["n_tokens"] for r in got] == [2, 0, 5] and np.allclose(got[2]["flat"], docs[2].ravel())
    uniform = np.array([2, 3, 4], "<i4").tobytes() + np.arange(24, dtype="<f4").tobytes()
    (tmp_path / "u.bin").write_bytes(uniform)
    assert [r["n_tokens"] for r in binary.read_embeddings(spark, f"{tmp_path}/u.bin", uniform=True).collect()] == [3, 3]
    with pytest.raises(ValueError):
        binary.parse_embeddings(binary.write_embeddings(docs)[:-1])


def test_index_file(spark, tmp_path):
    ship(spark)
    rng = np.random.default_rng(3)
    lists, tokens = [[0, 1], [], [1]], [3, 2]
    rows = [(10 + i, rng.integers(0, 3, t).tolist(), rng.bytes(t * 2)) for i, t in enumerate(tokens)]
    raw = binary.write_index(4, np.ones((3, 4)), lists, np.ones((3, 4)), np.zeros(4), np.linspace(-1, 1, 15), np.ones((16, 4)), rows)
    assert len(raw) == binary.index_size(4, 3, 3, tokens)
    parsed = binary.parse_index(raw)
    assert parsed["lists"] == lists and [(d["doc_id"], d["codes"], d["residuals"]) for d in parsed["docs"]] == rows
    (tmp_path / "i.fpqz").write_bytes(raw)
    assert binary.read_index_documents(spark, f"{tmp_path}/i.fpqz").count() == 2 and binary.read_index_postings(spark, f"{tmp_path}/i.fpqz").count() == 3
    for bad in (b"XXXX" + raw[4:], raw[:4] + b"\x02" + raw[5:]):
        with pytest.raises(ValueError):
            binary.parse_index(bad)
    with pytest.raises(ValueError):
        binary.write_index(4, np.ones((1, 4)), [[]], np.ones((300, 4)), np.zeros(4), np.zeros(15), np.ones((16, 4)), [(1, [256], b"")])


def test_older_index_file(spark, tmp_path):
    ship(spark)
    u4 = lambda *x: np.array(x, "<u4").tobytes()
    f4 = lambda *x: np.array(x, "<f4").tobytes()
    raw = u4(3, 2, 2, 1) + f4(0, 0) + f4(15, 15) + u4(0, 1, 3) + f4(1, 1) + np.array([0, 0], "<u2").tobytes() + u4(2, 0, 1) + bytes([0xA5, 0x21, 0x43])
    (tmp_path / "old.bin").write_bytes(raw)
    got = {r["doc_id"]: r["flat"] for r in binary.read_minmax_documents(spark, f"{tmp_path}/old.bin").collect()}
    assert np.allclose(got[0], [5, 10]) and np.allclose(got[1], [1, 2, 3, 4])


def test_records(spark, tmp_path):
    paper = {"id": 1, "title": "T", "abstract": "A", "authors": ["x"], "venue": "V", "year": 2020, "keywords": [], "arxiv_id": None, "doi": None}
    (tmp_path / "list.json").write_text(json.dumps([paper, paper]))
    (tmp_path / "object.json").write_text(json.dumps({"papers": [paper]}))
    assert records.read_papers(spark, f"{tmp_path}/list.json").count() == 2 and records.read_papers(spark, f"{tmp_path}/object.json").first()["title"] == "T"
    import gzip

    (tmp_path / "lines.jsonl.gz").write_bytes(gzip.compress(("\n".join([json.dumps(paper), "", "{bad", json.dumps(paper)])).encode()))
    assert len(records.read_paper_lines(spark, f"{tmp_path}/lines.jsonl.gz").collect()) == 2
    records.write_papers(records.synthetic_papers(spark, 5), f"{tmp_path}/out")
    assert sorted(map(tuple, records.read_paper_lines(spark, f"{tmp_path}/out").select("id", "title").collect())) == sorted(map(tuple, records.synthetic_papers(spark, 5).select("id", "title").collect()))


def test_beir_folder(spark, tmp_path):
    (tmp_path / "qrels").mkdir()
    (tmp_path / "corpus.jsonl").write_text('{"_id": "d1", "title": "A", "text": "b "}\n{"_id": "d2", "title": "", "text": "c"}\n')
    (tmp_path / "queries.jsonl").write_text('{"_id": "q1", "text": "what"}\n{"_id": "q2", "text": "unjudged"}\n')
    (tmp_path / "qrels" / "test.tsv").write_text("query-id\tcorpus-id\tscore\nq1\td2\t1\n")
    docs, queries, qrels = records.read_beir(spark, str(tmp_path))
    assert {r["id"]: r["text"] for r in docs.collect()} == {"d1": "A b", "d2": "c"}
    assert [r["query"] for r in queries.collect()] == ["what"] and tuple(qrels.first()) == ("what", "d2", 1)


def test_archive_feed(spark, tmp_path):
    (tmp_path / "feed.xml").write_text('<feed><entry><id>http://a.invalid/abs/2501.1</id><title>A\n  title</title><summary> An\nabstract </summary><published>2025-01-01</published><category term="cs.IR"/></entry></feed>')
    row = records.read_archive_feed(spark, f"{tmp_path}/feed.xml", "cs").first()
    assert (row["id"], row["title"], row["abstract"], row["categories"], row["text"]) == ("cs_2501.1", "A title", "An abstract", ["cs.IR"], "A title An abstract")
