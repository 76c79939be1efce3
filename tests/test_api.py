import numpy as np
import pytest

from spindrel import api
from spindrel.functions import bits
from spindrel.operators import corpus, encoders
from spindrel.session import ship


def test_retriever(spark, tmp_path):
    rng = np.random.default_rng(0)
    docs = [rng.standard_normal((rng.integers(4, 9), 16)) for _ in range(40)]
    docs = [d / np.linalg.norm(d, axis=1, keepdims=True) for d in docs]
    index = api.Retriever(f"file://{tmp_path}/index", spark).create(docs, metadata=[{"n": i} for i in range(40)])
    found = index.search([docs[3], docs[7][None]], top_k=5)
    assert [x[0][0] for x in found] == [3, 7] and all(len(x) == 5 for x in found)
    index.update([docs[0] * -1], [{"n": 99}])
    assert index.search([docs[0] * -1], top_k=1)[0][0][0] == 40
    assert api.metadata_where(spark, index.path, "n > ?", [38]) == [39, 40]
    index.delete([0])
    assert index.search([docs[3]], top_k=1)[0][0][0] == 2 and api.metadata_get(spark, index.path, subset=0)[0]["n"] == 1
    assert index.search([docs[3]], subset=[]) == [[]] and len(index.search([docs[3]], subset=[], legacy_empty_subset=True)[0]) == 10


def test_metadata_by_path(spark, tmp_path):
    path = f"file://{tmp_path}/m"
    with pytest.raises(FileNotFoundError):
        api.metadata_where(spark, path, "a = 1")
    with pytest.raises(FileNotFoundError):
        api.metadata_get(spark, path)
    assert api.metadata_create(spark, path, [{"a": 1}, {"a": 2}]) == 2
    assert api.metadata_update(spark, path, [{"a": 3, "b": True}]) == 1
    assert api.metadata_delete(spark, path, [0]) == 1
    assert api.metadata_get(spark, path) == [{"_subset_": 0, "a": 2, "b": None}, {"_subset_": 1, "a": 3, "b": 1}]


def test_kernels():
    q, d = [[1, 0], [0, 1]], [[1, 0], [0.6, 0.8]]
    assert api.maxsim(q, d) == pytest.approx(1.8) and api.maxsim(q, d, normalised=True) == pytest.approx(0.9)
    assert api.maxsim([1, 0, 0, 1], [1, 0, 0.6, 0.8], 2) == pytest.approx(1.8) and api.maxsim(q, np.zeros((0, 2))) == 0
    assert api.maxsim_batch_flat(q, [1, 0, 0.6, 0.8, 0, 1], [2, 1], 2) == pytest.approx([1.8, 1.0])
    assert api.Preloaded([d, [[0, 1]]]).search(q) == pytest.approx([1.8, 1.0])
    with pytest.raises(ValueError):
        api.maxsim_batch_flat(q, [1, 0], [2], 2)


def test_evaluate(spark):
    scores = [[(1, 0.9), (2, 0.8)], [(3, 0.7), (4, 0.6)]]
    qrels = {"query1": {1: 1, 2: 1}, "query2": {3: 1, 4: 1}}
    assert api.evaluate(spark, scores, qrels, ["query1", "query2"], ["ndcg@10", "hits@1"]) == {"ndcg@10": 1.0, "hits@1": 1.0}
    assert api.add_duplicates(["a", "b", "a"], [[1], [2]]) == [[1], [2], [1]]


def test_compute_kmeans(spark):
    rng = np.random.default_rng(1)
    book = api.compute_kmeans(ship(spark), [rng.standard_normal((5, 8)) for _ in range(30)], num_partitions=6)
    assert book.shape == (6, 8) and np.allclose(np.linalg.norm(book, axis=1), 1)


def test_encoders_and_pooling(spark):
    ship(spark)
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["flat"] for r in encoders.encode_texts(df, lambda: lambda texts: [np.ones((len(t.split()), 2)) for t in texts]).collect()}
    assert got == {1: [1.0] * 4, 2: []}
    rows = {r["doc_id"]: r["flat"] for r in encoders.demonstration_vectors(df, 4).collect()}
    assert len(rows[1]) == 16 and len(rows[2]) == 8
    x = np.array([[1, 0], [0, 1], [0, 0.9], [1, 0.1], [0.9, 0.1]], float)
    (row,) = encoders.pooled(corpus.from_arrays(spark, [x]), 2, 2).collect()
    assert len(row["flat"]) == 6 and row["flat"][:2] == [1.0, 0.0]


def test_byte_table():
    assert bits.byte_table(2).shape == (256, 4) and bits.byte_table(2)[0x9C].tolist() == [1, 2, 3, 0]
