import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import vectors as V
from lodestone.operators import cluster, fusion, keyword, knn

TEXTS = ["apple is red", "banana is yellow", "orange is orange", "grape is purple", "Crème brûlée is an apple dessert", "red apple red grape banana split", "", "yellow is not red but yellow"]


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(0)
    rows = [(i + 1, t, rng.normal(size=4).tolist()) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "id long, text string, embedding array<float>")


@pytest.mark.parametrize("query", ["orange", "apple OR banana", "apple red", "is NOT red", '"red apple"', "ban*", "(apple OR grape) AND red", "^apple", "NEAR(red banana, 2)", "NEAR(apple banana, 1)", "text:creme", "apple + is", "yellow yellow", "nosuchword", "is"])
def test_bm25_agrees_with_fts5(spark, docs, query):
    base = sqlite3.connect(":memory:")
    base.execute("create virtual table f using fts5(text)")
    base.executemany("insert into f(rowid, text) values (?, ?)", [(i + 1, t) for i, t in enumerate(TEXTS)])
    want = {r[0]: r[1] for r in base.execute("select rowid, bm25(f) from f where f match ?", (query,))}
    found = {r["id"]: r["score"] for r in keyword.search(docs, query, 100).collect()}
    assert found.keys() == want.keys()
    for i, score in want.items():
        assert found[i] == pytest.approx(score, abs=1e-9)


@pytest.mark.parametrize("query", ["what's up?", "hello-world", "(apple", "NOT apple", "apple AND", "NEAR(a b"])
def test_malformed_queries(query):
    with pytest.raises(ValueError):
        keyword.parse(query)


def test_batch_agrees_with_single(spark, docs):
    vectors = {r["id"]: r["embedding"] for r in docs.collect()}
    for kind in ("cosine", "l2", "hamming"):
        found = knn.search_batch(docs, [(q, vectors[q]) for q in (1, 4)], 3, kind).orderBy("qid", "rank").collect()
        for q in (1, 4):
            single = knn.search(docs, vectors[q], 3, kind, digits=6).collect()
            assert [(r["id"], pytest.approx(r["distance"], abs=1e-5)) for r in single] == [(r["id"], r["distance"]) for r in found if r["qid"] == q]


def test_k_and_dimension(docs):
    assert knn.search(docs, [1, 0, 0, 0], 0).isEmpty()
    with pytest.raises(ValueError):
        knn.check_dimension([1.0], 4)


def test_mmr_prefers_diversity(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.99, 0.01, 0.0]), (3, [0.0, 1.0, 0.0])], "id long, embedding array<float>")
    assert [r["id"] for r in fusion.mmr(rows, [1, 0, 0], 2, 3, 0.3).orderBy("rank").collect()] == [1, 3]


def test_codecs(spark):
    rows = spark.createDataFrame([(1, [0.5, -0.5, 1.5, 0.0, 0.004, 0.1, 0.2, -0.3, 0.9])], "id long, v array<double>")
    got = rows.select(V.int8_encode(F.col("v")).alias("a"), V.bit_encode(F.col("v")).alias("b"), V.bit_decode(V.bit_encode(F.col("v")), 9).alias("c")).first()
    v = np.array(rows.first()["v"])
    assert list(got["a"]) == np.clip(np.round(v * 127), -128, 127).astype(int).tolist()
    assert list(got["b"]) == np.packbits(v > 0).tolist()
    assert got["c"] == np.where(v > 0, 1.0, -1.0).tolist()


def test_density_clusters():
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.normal(0, 0.1, (30, 2)), rng.normal(5, 0.1, (30, 2)), [[20.0, -20.0]]])
    labels = cluster.density_labels(points, 5)
    assert len(set(labels[:30])) == 1 and len(set(labels[30:60])) == 1 and labels[0] != labels[30] and labels[60] == -1


def test_density_clusters_label_every_row(spark):
    rng = np.random.default_rng(3)
    points = np.concatenate([rng.normal(0, 0.1, (60, 3)), rng.normal(5, 0.1, (50, 3)), rng.uniform(-9, 9, (20, 3)), np.full((15, 3), 2.0)])
    points = points.astype(np.float32).astype(float)
    rows = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)] + [(900, None)], "id long, embedding array<float>")
    want = cluster.density_labels(points, 5)
    for block in (4096, 20):  # one block; eight of them
        found = {r["id"]: r["label"] for r in cluster.hdbscan(rows, 5, block).collect()}
        assert [found[i] for i in range(len(points))] == want.tolist() and len(found) == len(points)
    assert cluster.hdbscan(rows.limit(0)).count() == 0
    assert {r["label"] for r in cluster.hdbscan(rows.where("id < 3")).collect()} == {-1}
    # more rows than the former limit
    many = spark.range(10_050).select("id", F.array((F.col("id") % 3 * 50 + F.rand(1)).cast("float"), F.rand(2).cast("float")).alias("embedding"))
    assert cluster.hdbscan(many).count() == 10_050


def test_density_clusters_shuffle_no_vectors(spark):
    rng = np.random.default_rng(4)
    rows = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(rng.normal(size=(600, 16)))], "id long, embedding array<double>")

    def shuffled():
        context = spark.sparkContext._jsc.sc()
        context.listenerBus().waitUntilEmpty()
        return context.statusStore().executorSummary("driver").totalShuffleWrite()

    before = shuffled()
    assert cluster.hdbscan(rows, 5, 20).count() == 600
    assert shuffled() - before < 600 * 16 * 8  # each vector once for each of 30 blocks, twice over, would be 60 times that


def test_density_clusters_of_ties_copies_and_islands(spark):
    rng = np.random.default_rng(5)
    copies = np.concatenate([np.ones((90, 2)), np.zeros((3, 2)), np.repeat(rng.normal(3, 0.2, (30, 2)), 3, 0)])
    islands = np.concatenate([rng.normal(c, 0.05, (30, 2)) for c in rng.uniform(-900, 900, (8, 2))])
    for points in (copies, islands, rng.integers(0, 10, (300, 2)).astype(float)):
        rows = [(i, p.tolist()) for i, p in enumerate(points)] + [(None, [1.0, 1.0])]  # null comes first
        odd = [(900, [float("nan"), 0.0]), (901, [float("inf"), 0.0]), (902, [None, 0.0]), (903, None)]
        docs = spark.createDataFrame([(rows + odd)[i] for i in rng.permutation(len(rows + odd))], "id long, embedding array<double>")
        found = {r["id"]: r["label"] for r in cluster.hdbscan(docs, 4, 25).collect()}
        want = cluster.density_labels(np.concatenate([[[1.0, 1.0]], points]), 4).tolist()
        assert [found.pop(i) for i in [None, *range(len(points))]] == want and found == {900: -1, 901: -1, 902: -1}


def test_inverted_file_recall(spark):
    rng = np.random.default_rng(2)
    points = rng.normal(size=(400, 8))
    rows = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id long, embedding array<float>")
    index = knn.InvertedFile.train(rows, 8)
    celled = index.assign(rows).cache()
    hits = 0
    for q in range(5):
        near = {r["id"] for r in knn.search(rows, points[q], 5).collect()}
        hits += len(near & {r["id"] for r in index.search(celled, points[q], 5, probes=6).collect()})
    assert hits >= 0.9 * 25


def test_tags_shuffle_counts_of_frequent_terms_only(spark, monkeypatch):
    # each row holds 40 words of its own; repeated and missing ids and few words besides
    texts = [(i % 50 if i % 7 else None, i % 3 - 1, " ".join([f"w{i * j % 13}" for j in range(i % 9)] + [f"own{i}x{j}" for j in range(40)])) for i in range(120)]
    rows = spark.createDataFrame(texts + [(900, 5, "a"), (901, 5, None), (902, 7, "alone here")], "id long, label long, text string")
    kept, write = {}, cluster.materialize
    monkeypatch.setattr(cluster, "materialize", lambda df, label: kept.setdefault(label, write(df, label)))
    few = {r["label"]: r["tags"] for r in cluster.tags(rows, 3, 4).collect()}
    assert kept["tf"].where("label < 5 and term like '%own%'").isEmpty()
    monkeypatch.setattr(cluster, "MAX_SENT_TERMS", -1)  # all terms are counted
    kept.clear()
    assert few == {r["label"]: r["tags"] for r in cluster.tags(rows, 3, 4).collect()} and not kept["tf"].where("label < 5 and term like '%own%'").isEmpty()
    assert few[-1] == "outliers" and few[5] == "cluster_5"
