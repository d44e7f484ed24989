"""The inverted file through a collection: recall against exact search, writes beside it; sampled clusters and their measures."""

import numpy as np
import pytest

from lodestone.collection import VectorDB
from lodestone.operators import cluster, knn


@pytest.fixture
def db(spark, tmp_path):
    return VectorDB(spark, f"file://{tmp_path}/db")


def clustered(n=1500, dim=16, groups=12, seed=0):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(groups, dim))[rng.integers(0, groups, n)] * 2 + rng.normal(size=(n, dim))


def loaded(db, points, name="v"):
    c = db.collection(name)
    c.add_frame(db.spark.createDataFrame([(i, f"t{i}", '{"odd":%d}' % (i % 2), v.tolist()) for i, v in enumerate(points)], "id long, text string, metadata string, embedding array<double>"))
    return c


@pytest.mark.parametrize("points", [clustered(), np.random.default_rng(1).normal(size=(1500, 8))], ids=["clustered", "uniform"])
def test_recall_against_brute_force(db, points):
    c = loaded(db, points)
    measured = c.build_vector_index(20)
    held = c.store.fact("ivf")
    assert measured >= knn.RECALL and held["probes"] <= 20
    unit = points / np.linalg.norm(points, axis=1)[:, None]
    found = 0
    for i in range(0, 1500, 150):
        got = [r["id"] for r in c.similarity_search(points[i].tolist(), 10, exact=False).collect()]
        best = set(np.argsort(1 - unit @ unit[i], kind="stable")[:10].tolist())
        found += len(best & set(got))
        assert [r["id"] for r in c.similarity_search(points[i].tolist(), 10, exact=True).collect()][0] == i and len(got) == 10
    assert found >= 90


def test_writes_stand_beside_the_index(db):
    points = clustered(300)
    c = loaded(db, points)
    c.build_vector_index(8)
    q = points[5].tolist()
    c.delete_by_ids([5])
    (new,) = c.add_texts(["new"], [{"odd": 1}], [q])
    c.add_texts(["moved"], None, [(-points[7]).tolist()], [7])
    c.update_embeddings([(9, q)])
    c.flush_pending()
    assert {r["id"] for r in c.similarity_search(q, 2, exact=False).collect()} == {new, 9}
    assert [r["id"] for r in c.similarity_search(q, 1, {"odd": 1}, exact=False).collect()] in ([new], [9])
    assert c.similarity_search((-points[7]).tolist(), 1, exact=False).first()["id"] == 7
    assert c.similarity_search(q, 2).first()["text"] in ("new", "t9")  # few documents: exact
    c.build_vector_index(8)
    assert c.store.read("fresh").isEmpty() and {r["id"] for r in c.similarity_search(q, 2, exact=False).collect()} == {new, 9}


def test_many_centroids_go_out_as_a_matrix(spark, monkeypatch):
    points = clustered(200, 6)
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(points)] + [(900, None)], "id long, embedding array<double>")
    table = spark.createDataFrame([(10 * i, v.tolist()) for i, v in enumerate(points[:30])], "label long, centroid array<double>")
    few = sorted(map(tuple, cluster.assign(docs, table).collect()))
    monkeypatch.setattr(cluster, "LITERAL_NUMBERS", 10)
    assert sorted(map(tuple, cluster.assign(docs, table).collect())) == few
    exact = ((points[:, None] - points[None, :30]) ** 2).sum(2)
    assert [r[1] for r in few] == (10 * np.round(exact, 6).argmin(1)).tolist()


def test_sampled_clusters_and_metrics(db):
    points = np.concatenate([np.random.default_rng(2).normal(size=(80, 4)) * 0.1 + c for c in ([5, 0, 0, 0], [0, 5, 0, 0], [0, 0, 5, 0])])
    c = loaded(db, points)
    for algorithm in ("kmeans", "minibatch_kmeans", "hdbscan"):
        labels, _, inertia = c.cluster(3, algorithm, sample_size=90)
        rows = {r["id"]: r["label"] for r in labels.collect()}
        assert len(rows) == 240
        if algorithm == "kmeans":
            assert inertia > 0 and all(len({rows[i] for i in range(a, a + 80)}) == 1 for a in (0, 80, 160))
            got = c.cluster_metrics(labels)
            assert (got["n_documents"], got["n_clusters"], got["n_noise"], sorted(got["sizes"].values())) == (240, 3, 0, [80, 80, 80]) and got["silhouette"] > 0.9
    with pytest.raises(ValueError):
        c.cluster(3, sample_size=0)
