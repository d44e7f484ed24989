import asyncio

import pytest

from lodestone.collection import Async, VectorDB
from lodestone.sources.store import ConflictError, Store

TEXTS = ["copper kettle on the stove", "granite steps by the harbour", "harbour lights at harbour dusk", "linen curtains in the attic"]
VECTORS = [[0.5, 0, 0, 0], [0, 0.4, 0, 0], [0.3] * 4, [0.7, 0.6, 0.7, 0.6]]
META = [{"room": "kitchen", "visits": 4}, {"room": "quay", "visits": 9}, {"room": "pier", "visits": 7}, {"room": "attic", "visits": 2}]


@pytest.fixture
def db(spark, tmp_path):
    return VectorDB(spark, f"file://{tmp_path}/db")


def test_life_of_a_collection(db):
    c = db.collection()
    assert c.add_texts(TEXTS, META, VECTORS) == [1, 2, 3, 4]
    assert c.count() == 4 and c.dim == 4 and db.list_collections() == ["default"]
    assert c.similarity_search([1, 0, 0, 0], 1).first()["text"] == TEXTS[0]
    assert [r["id"] for r in c.get_documents({"visits": [4, 7]}).collect()] == [1, 3]
    assert c.keyword_search("lights").first()["id"] == 3
    assert {r["id"] for r in c.hybrid_search("granite", 2, query_vector=[1, 0, 0, 0]).collect()} == {1, 2}
    assert c.update_metadata([(1, {"visits": 5}), (1, {"x": True}), (99, {"y": 1})]) == 1
    assert c.get_documents({"visits": 5, "x": True}).first()["id"] == 1
    assert c.increment_metadata(1, {"visits": 0.5}) and c.counter(1, "visits") == 5.5
    assert not c.increment_metadata(99, {"visits": 1}) and c.counter(99, "visits") is None and c.counter(1, "room") == 0.0
    c.add_texts(["slate roof"], None, [[0, 0, 0, 1]], [2])
    assert c.get_documents().where("id = 2").first()["text"] == "slate roof" and c.count() == 4
    assert c.set_parent(2, 1) and c.set_parent(3, 2)
    with pytest.raises(ValueError):
        c.set_parent(1, 3)
    assert [(r["id"], r["depth"]) for r in c.get_descendants(1).collect()] == [(2, 1), (3, 2)]
    assert [r["id"] for r in c.get_ancestors(3).collect()] == [2, 1]
    assert c.delete_by_ids([2, 77]) == 1
    assert c.documents().where("id = 3").first()["parent_id"] is None
    assert [r["kind"] for r in c.read_events().collect()][-1] == "delete"
    assert c.add_texts(["new"], None, [[1, 1, 1, 1]]) == [5]
    with pytest.raises(ValueError):
        c.add_texts(["bad"], None, [[float("nan")] * 4])
    with pytest.raises(ValueError):
        db.collection("default", "l2")
    db.vacuum()
    assert c.count() == 4


def test_edges_ttl_pending(db):
    c = db.collection("x")
    c.add_texts(TEXTS, META, VECTORS)
    c.add_edges([{"src_id": 1, "dst_id": d, "kind": "e", "weight": w} for d, w in ((2, 0.02), (3, 0.4), (4, 0.9))], now=10.0)
    with pytest.raises(ValueError):
        c.add_edges([{"src_id": 1, "dst_id": 2, "kind": "e"}])
    changes = db.spark.createDataFrame([(1, 3, "e", 0.01, 1)] * 200, "src_id long, dst_id long, kind string, dweight double, dhits long")
    c.update_edges(changes)
    edge = c.get_edges(dst=3).first()
    assert edge["hits"] == 200 and edge["weight"] == pytest.approx(2.4)
    assert c.prune_edges(max_weight=0.1) == 1
    c.set_ttl(1, expires_at=5.0)
    c.set_ttl(2, expires_at=6.0, on_expire="callback")
    assert c.sweep(now=100.0) == ([1], [2]) and c.count() == 3 and c.get_edges().isEmpty()
    c.update_embeddings([(2, [0, 0, 0, 1])])
    assert c.pending_size() == 1
    assert c.similarity_search([0, 0, 0, 1], 1).first()["id"] != 2
    assert c.flush_pending() == 1 and c.pending_size() == 0
    assert c.similarity_search([0, 0, 0, 1], 1).first()["id"] == 2


def test_transactions_and_conflicts(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    one, two = (Store(spark, path, {"t": "a int"}) for _ in "ab")
    rows = spark.createDataFrame([(1,)], "a int")
    with one.transaction():
        one.append("t", rows)
        with pytest.raises(RuntimeError):
            with one.transaction():
                one.append("t", rows)
                raise RuntimeError
        assert one.read("t").count() == 1 and two.read("t").count() == 0
    assert two.read("t").count() == 1
    with pytest.raises(ConflictError):
        with one.transaction():
            one.append("t", rows)
            two.change(lambda s: s.append("t", rows))
    assert two.read("t").count() == 2


def test_streaming_batches_and_async(db):
    c = db.collection("s")
    progress = list(c.add_texts_streaming([(f"t{i}", {"i": i}, [float(i), 1.0]) for i in range(5)], batch_size=2))
    assert [(p.batch_num, p.total_batches, p.docs_in_batch) for p in progress] == [(1, None, 2), (2, None, 2), (3, 3, 1)]
    assert asyncio.run(Async(c).count()) == 5
    db.collection("t").add_texts(["u"], None, [[1.0, 1.0]])
    assert [r["collection"] for r in db.search_collections([1.0, 1.0], ["s", "t"], 1).collect()] in (["s"], ["t"])
    with pytest.raises(KeyError):
        db.search_collections([1.0, 1.0], ["none"])
    db.delete_collection("t")
    assert db.list_collections() == ["s"]
