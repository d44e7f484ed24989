"""Writes that touch few rows, commits over several collections, and the keyword index that follows them."""

import time

import pytest
from pyspark.sql import functions as F

from lodestone.collection import VectorDB
from lodestone.operators import lifecycle
from lodestone.sources import store as stores
from lodestone.sources.store import ConflictError, Store


@pytest.fixture
def db(spark, tmp_path):
    return VectorDB(spark, f"file://{tmp_path}/db")


def filled(db, n=30, name="c"):
    c = db.collection(name)
    c.add_texts([f"word{i} common text number {i % 7}" for i in range(n)], [{"n": i} for i in range(n)], [[float(i), 1.0] for i in range(n)])
    return c


def test_changes_write_only_what_changes(db):
    c = filled(db)
    plain = lambda: [s for s in c.store.current()["tables"]["documents"] if isinstance(s, str)]
    deltas = lambda: [s["rows"] for s in c.store.current()["tables"]["documents"] if not isinstance(s, str)]
    first = plain()
    c.update_metadata([(3, {"x": 1}), (4, {"x": 2}), (99, {"x": 3})])
    c.increment_metadata(5, {"n": 2})
    c.set_parent(6, 5)
    c.add_texts(["replaced"], None, [[7.0, 7.0]], [7])
    assert plain() == first and deltas() == [2, 1, 1, 1]
    assert c.delete_by_ids([5]) == 1 and c.count() == 29 and plain() == first
    docs = {r["id"]: r for r in c.documents().collect()}
    assert docs[6]["parent_id"] is None and docs[7]["text"] == "replaced" and docs[3]["metadata"] == '{"n":2,"x":1}' and 5 not in docs
    assert c.add_texts(["five again"], None, [[1.0, 2.0]], [5]) == [5] and c.get_documents_by_ids([5]).first()["text"] == "five again"
    c.store.compact()
    assert deltas() == [] and {r["id"]: r for r in c.documents().collect()}.keys() == docs.keys() | {5}


def test_deltas_are_folded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stores, "FOLD", 3)
    s = Store(spark, f"file://{tmp_path}/s", {"t": "id long, x long"}, {"t": ("id",)})
    rows = lambda *r: spark.createDataFrame(list(r), "id long, x long")
    s.change(lambda w: w.append("t", rows(*((i, 0) for i in range(10)))))
    model = dict.fromkeys(range(10), 0)
    for step in range(12):
        ids = [step % 10, (step * 7) % 12]
        if step % 3 == 2:
            s.change(lambda w: w.drop("t", rows(*((i, None) for i in ids))))
            [model.pop(i, None) for i in ids]
        else:
            s.change(lambda w: w.put("t", rows(*((i, step) for i in dict.fromkeys(ids)))))
            model |= dict.fromkeys(ids, step)
        assert len(s.current()["tables"]["t"]) <= 4
        assert {r["id"]: r["x"] for r in s.read("t").collect()} == model


def test_many_increments_add_up(db):
    c = filled(db, 4)
    assert c.increment_many([(1, {"n": 1, "hits": 2}), (2, {"n": 1}), (1, {"hits": 3}), (77, {"n": 1})]) == 2
    assert c.counter(1, "hits") == 5 and c.counter(1, "n") == 1 and c.counter(2, "n") == 2
    for _ in range(5):
        c.increment_metadata(1, {"hits": 1})
    assert c.counter(1, "hits") == 10
    assert [r["doc_id"] for r in c.read_events(kind="counter").collect()].count(1) == 7


def test_a_transaction_over_collections_counts_as_a_whole(spark, db, tmp_path):
    a, b = filled(db, 3, "a"), filled(db, 3, "b")
    other = VectorDB(spark, f"file://{tmp_path}/db")
    with db.transaction():
        a.delete_by_ids([1])
        b.delete_by_ids([2])
        assert (a.count(), b.count()) == (2, 2) and (other.collection("a").count(), other.collection("b").count()) == (3, 3)
    assert (other.collection("a").count(), other.collection("b").count()) == (2, 2) and other.list_collections() == ["a", "b"]
    with pytest.raises(RuntimeError):
        with db.transaction():
            a.delete_by_ids([2])
            raise RuntimeError
    with pytest.raises(ConflictError):
        with db.transaction():
            a.delete_by_ids([2])
            b.delete_by_ids([1])
            other.collection("b").add_texts(["faster"], None, [[1.0, 1.0]])
    assert (a.count(), b.count()) == (2, 3)


def test_a_transaction_that_never_ends_is_undone(db, monkeypatch):
    monkeypatch.setattr(stores, "PATIENCE", 0.3)
    c = filled(db, 3)
    c.store._begin()
    c.store.set_fact("left", True)
    c.store._publish(c.store._stack[-1], "abandoned")
    c.store._done()
    assert c.store.fact("left") is None and c.count() == 3
    assert c.delete_by_ids([1]) == 1 and c.count() == 2 and c.store.fact("left") is None


def test_edges_and_their_events(db):
    c = filled(db, 4)
    c.add_edges([{"src_id": 1, "dst_id": 2, "kind": "e", "weight": 1.0}, {"src_id": 1, "dst_id": 3, "kind": "e", "weight": 2.0}])
    none = db.spark.createDataFrame([(8, 9, "e", 1.0)], "src_id long, dst_id long, kind string, dweight double")
    assert c.update_edges(none) == 0 and c.read_events(kind="edge_update").isEmpty()
    assert c.update_edges(none.withColumn("src_id", F.lit(1).cast("long")).withColumn("dst_id", F.lit(2).cast("long"))) == 1
    c.upsert_edges([{"src_id": 1, "dst_id": 3, "kind": "e", "weight": 5.0}, {"src_id": 2, "dst_id": 3, "kind": "f"}], now=4.0)
    assert sorted((r["src_id"], r["dst_id"], r["weight"]) for r in c.get_edges().collect()) == [(1, 2, 2.0), (1, 3, 5.0), (2, 3, 0.0)]
    assert c.delete_edge(1, 2, kind="e") == 1 and c.delete_edge(1, 2, kind="e") == 0
    events = c.read_events(kind="edge_delete").collect()
    assert len(events) == 1 and events[0]["payload"] == '{"src": 1, "dst": 2, "kind": "e"}'
    c.add_edges([{"src_id": 1, "dst_id": 2, "kind": "e", "weight": 1.0}])
    assert c.delete_by_ids([1]) == 1 and [(r["src_id"], r["dst_id"]) for r in c.get_edges().collect()] == [(2, 3)]


def test_the_keyword_index_follows_every_write(db):
    c = filled(db)
    queries = ["common", "word3 OR word5", "text NOT number", '"number 3"', "wor*", "NEAR(word4 number, 3)", "^word8", "nothing"]
    plain = lambda q, **k: [(r["id"], round(r["score"], 9)) for r in c.keyword_search(q, 50, **k).collect()]
    before = {q: plain(q) for q in queries}
    assert c.build_keyword_index() == 30 and {q: plain(q) for q in queries} == before
    c.add_texts(["word3 word3 again"], None, [[1.0, 1.0]])
    c.add_texts(["word5 no longer here"], None, [[1.0, 1.0]], [4])
    c.delete_by_ids([2, 9])
    c.update_metadata([(6, {"flag": True})])
    indexed = {q: plain(q) for q in queries}, plain("word*", filter={"flag": True})
    c.store.change(lambda s: s.set_fact("indexed", False))
    assert ({q: plain(q) for q in queries}, plain("word*", filter={"flag": True})) == indexed
    assert c.build_keyword_index() == 29 and {q: plain(q) for q in queries} == indexed[0]


def test_search_leaves_no_files_behind(spark, db):
    root = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    import os

    c = filled(db, 5)
    before = sorted(os.listdir(root))
    assert c.keyword_search("common", 2).count() == 2 and sorted(os.listdir(root)) == before


def test_feed_floor_rebuild_and_ids(spark, db, tmp_path):
    c = filled(db, 6)
    for i in range(4):
        c.append_event("note", i)
    segments = list(c.store.current()["tables"]["events"])
    c.prune_events(3)
    c.store.compact()
    assert [r["seq"] for r in c.read_events().collect()] == [3, 4] and c.last_seq() == 4 and c.store.current()["tables"]["events"] == segments
    with pytest.raises(RuntimeError):
        with c.store.transaction():
            c.append_event("never")
            raise RuntimeError
    from lodestone.streaming import feeds

    stream = feeds.event_stream(spark, f"{c.store.path}/events")
    stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r["seq"] for r in spark.read.schema(stream.schema).parquet(f"{tmp_path}/out").collect()) == [1, 2, 3, 4]
    policy = lifecycle.RebuildPolicy(tombstones=2)
    assert not c.rebuild_if_needed(policy, now=0.0) and c.delete_by_ids([1, 2]) == 2
    assert c.rebuild_if_needed(policy, now=0.0) and not c.suggest_rebuild(policy, now=0.0)
    assert [r["id"] for r in c.list_all_ids().collect()] == [3, 4, 5, 6]
    assert [(r["id"], r["embedding"]) for r in c.get_embeddings_by_ids([4, 1]).collect()] == [(4, [3.0, 1.0])]


def test_background_sweep(db):
    c = filled(db, 3)
    c.set_ttl(1, seconds=-5)
    c.set_ttl(2, seconds=-5, on_expire="callback")
    called = []
    with c.background_sweep(0.1, on_expire=called.extend):
        until = time.time() + 60
        while (c.store._stack or c.count() == 3 or not called) and time.time() < until:
            time.sleep(0.2)
    assert c.count() == 2 and called == [2]
