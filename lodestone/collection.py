"""The database object: collections of documents with text, JSON metadata and vectors, over versioned tables."""

from __future__ import annotations

import asyncio
import json
import threading
import time
from collections.abc import Callable, Iterable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass
from typing import Any, Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import vectors as V
from .functions.filters import predicate
from .operators import cluster, edges, fusion, keyword, knn, lifecycle, mutate, tree
from .schema import BRUTE_FORCE_LIMIT, COLLECTION_NAME, CROSS_K, DOCUMENTS, EDGES, FETCH_K, K, LAMBDA_MULT, RRF_K, SWEEP_LIMIT, Distance, Quantization
from .sources.store import Files, Store, together


#: Ids that go into a predicate; more are joined.
FEW_IDS = 1000


class Embedder(Protocol):
    def __call__(self, texts: list[str]) -> list[list[float]]: ...


@dataclass(frozen=True)
class Progress:
    batch_num: int
    total_batches: int | None
    docs_processed: int
    docs_in_batch: int
    batch_ids: list[int]


class VectorDB:
    """A folder of collections."""

    def __init__(self, spark: SparkSession, path: str, embedder: Embedder | None = None):
        self.spark, self.path, self.embedder = spark, path.rstrip("/"), embedder
        self._open: dict[str, VectorCollection] = {}

    def collection(self, name: str = "default", distance: str = Distance.COSINE, quantization: str = Quantization.FLOAT) -> "VectorCollection":
        if not COLLECTION_NAME.fullmatch(name):
            raise ValueError(f"not a name of a collection: {name!r}")
        config = {"distance": str(Distance(distance)), "quantization": str(Quantization(quantization))}
        if name not in self._open:
            self._open[name] = VectorCollection(self, name, config)
        if self._open[name].config != config:
            raise ValueError(f"{name} is open with another configuration")
        return self._open[name]

    def list_collections(self) -> list[str]:
        names = [n for n in Files(self.spark, self.path).names(self.path) if not n.startswith("tx-")]
        return sorted(names, key=lambda n: (n != "default", n))

    def delete_collection(self, name: str) -> None:
        if not COLLECTION_NAME.fullmatch(name):
            raise ValueError(f"not a name of a collection: {name!r}")
        if name not in self.list_collections():
            raise KeyError(name)
        self._open.pop(name, None)
        Files(self.spark, self.path).delete(f"{self.path}/{name}")

    def search_collections(self, query: str | Sequence[float], collections: Sequence[str] | None = None, k: int = CROSS_K, filter: dict[str, Any] | None = None, *, normalize_scores: bool = True) -> DataFrame:
        names = self.list_collections() if collections is None else list(collections)
        missing = set(names) - set(self.list_collections())
        if missing:
            raise KeyError(sorted(missing))
        opened = [self._open.get(n) or self.collection(n) for n in names]
        if not opened or k <= 0:
            return self.spark.createDataFrame([], "collection string, id long, score double")
        vector = opened[0].vector(query)
        dims = {c.dim for c in opened if c.dim is not None}
        if len(dims) > 1:
            raise ValueError(f"collections differ in dimension: {sorted(dims)}")
        every = None
        for c in opened:
            rows = c.documents().withColumn("collection", F.lit(c.name))
            every = rows if every is None else every.unionByName(rows)
        return fusion.cross_collection(every, vector, None, k, opened[0].metric, predicate(filter, F.col("metadata")), normalize_scores).select("collection", "id", "text", "metadata", "score")

    @contextmanager
    def transaction(self) -> Iterator["VectorDB"]:
        """One transaction over all collections open now: all of its changes count from one moment on, or none does."""
        with together([c.store for c in self._open.values()], self.path):
            yield self

    def vacuum(self) -> None:
        for name in self.list_collections():
            (self._open.get(name) or self.collection(name)).store.vacuum()


class VectorCollection:
    def __init__(self, db: VectorDB, name: str, config: dict[str, str]):
        self.db, self.spark, self.name, self.config = db, db.spark, name, config
        self.store = Store(db.spark, f"{db.path}/{name}", marks=db.path)
        saved = self.store.fact("config")
        if saved is None:
            self.store.change(lambda s: s.set_fact("config", config))
        elif saved != config:
            raise ValueError(f"{name} is stored with another configuration: {saved}")

    # reading

    @property
    def metric(self) -> str:
        return "hamming" if self.config["quantization"] == Quantization.BIT else self.config["distance"]

    @property
    def dim(self) -> int | None:
        return self.store.fact("dim")

    def documents(self) -> DataFrame:
        return self.store.read("documents")

    def count(self) -> int:
        return self.documents().count()

    def get_documents(self, filter: dict[str, Any] | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
        if offset and limit is None:
            raise ValueError("an offset needs a limit")
        out = self.documents().where(predicate(filter, F.col("metadata"))).drop("embedding").orderBy("id")
        return out if limit is None else out.offset(offset).limit(limit)

    def get_documents_by_ids(self, ids: Iterable[int]) -> DataFrame:
        return self._only(self.documents(), ids)

    def get_embeddings_by_ids(self, ids: Iterable[int]) -> DataFrame:
        return self.get_documents_by_ids(ids).where("embedding is not null").select("id", "embedding")

    def list_all_ids(self) -> DataFrame:
        return self.documents().select("id").orderBy("id")

    def _only(self, rows: DataFrame, ids: Iterable[int], column: str = "id") -> DataFrame:
        """Rows of these ids; few ids are a predicate, which prunes row groups."""
        wanted = list(dict.fromkeys(int(i) for i in ids))
        if len(wanted) <= FEW_IDS:
            return rows.where(F.col(column).isin(wanted) if wanted else F.lit(False))
        return rows.join(self._ids(wanted).withColumnRenamed("id", column), column, "left_semi")

    def find_ids_by_texts(self, texts: list[str], limit: int | None = None, offset: int = 0) -> DataFrame:
        out = mutate.matching_ids(self.documents(), texts, None).orderBy("id").offset(offset)
        return out if limit is None else out.limit(limit)

    def find_ids_by_filter(self, filter: dict[str, Any], limit: int | None = None, offset: int = 0) -> DataFrame:
        out = self.documents().where(predicate(filter, F.col("metadata")) if filter else F.lit(False)).select("id").orderBy("id").offset(offset)
        return out if limit is None else out.limit(limit)

    def _ids(self, ids: Iterable[int]) -> DataFrame:
        return self.spark.createDataFrame([(int(i),) for i in dict.fromkeys(ids)], "id long")

    def vector(self, query: str | Sequence[float]) -> list[float]:
        if isinstance(query, str):
            if self.db.embedder is None:
                raise ValueError("a text query needs an embedder")
            query = self.db.embedder([query])[0]
        out = [float(x) for x in query]
        knn.check_dimension(out, self.dim)
        return out

    def similarity_search(self, query: str | Sequence[float], k: int = K, filter: dict[str, Any] | None = None, *, exact: bool | None = None) -> DataFrame:
        """The k nearest documents. ``exact`` False goes by the index where there is one, None does so beyond BRUTE_FORCE_LIMIT documents, True never."""
        vector, where = self.vector(query), predicate(filter, F.col("metadata")) if filter else None
        held = None if exact else self.store.fact("ivf")
        if held is None or (exact is None and held["rows"] <= BRUTE_FORCE_LIMIT):
            return knn.search(self.documents(), vector, k, self.metric, where).drop("embedding")
        index = knn.InvertedFile(held["centroids"], self.metric, held["probes"])
        fresh = self.store.read("fresh")
        known = self.store.read("cells").where(F.col("cell").isin(index.order(vector)[: index.probes])).join(fresh.select("id"), "id", "left_anti")
        rows = known.select("id", "embedding").unionByName(fresh.where("embedding is not null"))
        if where is not None:
            rows = rows.join(self.documents().where(where).select("id"), "id", "left_semi")
        found = knn.search(rows, vector, k, self.metric).drop("embedding")
        return self.documents().drop("embedding").join(F.broadcast(found) if k <= FEW_IDS else found, "id").orderBy("distance", "id")

    def build_vector_index(self, cells: int | None = None, goal: float = knn.RECALL) -> float:
        """An inverted file over all vectors, its cells trained on a bounded sample; how many of them a query looks into is measured against
        exact search on a bounded sample of queries. Later writes stand beside it until it is built again. The recall measured."""
        if self.metric not in ("cosine", "l2"):
            raise ValueError("cells need cosine or l2 distances")

        def work(store: Store) -> float:
            rows = store.read("documents").where("embedding is not null").select("id", "embedding")
            n = rows.count()
            index = knn.InvertedFile.train(rows, cells or max(1, min(cluster.MAX_CENTROIDS, round(n**0.5))), self.metric)
            store.replace("cells", index.assign(rows).repartitionByRange("cell", "id").sortWithinPartitions("cell", "id"))
            store.replace("fresh", store.read("fresh").limit(0))
            recall = index.tune(store.read("cells"), goal=goal)
            store.set_fact("ivf", {"centroids": index.centroids.tolist(), "probes": index.probes, "recall": recall, "rows": n})
            return recall

        return self.store.change(work)

    def _refresh(self, store: Store, rows: DataFrame) -> None:
        """Vectors that changed since the index was built, null for those that are gone."""
        if store.fact("ivf") is not None:
            store.put("fresh", rows.select("id", "embedding"))

    def similarity_search_batch(self, queries: Sequence[str | Sequence[float]], k: int = K, filter: dict[str, Any] | None = None) -> DataFrame:
        found = knn.search_batch(self.documents(), [(i, self.vector(q)) for i, q in enumerate(queries)], k, self.metric, predicate(filter, F.col("metadata")) if filter else None)
        return found.join(self.documents().select("id", "text", "metadata"), "id").orderBy("qid", "rank")

    def keyword_search(self, query: str, k: int = K, filter: dict[str, Any] | None = None) -> DataFrame:
        where = predicate(filter, F.col("metadata")) if filter else None
        if not self.store.fact("indexed"):
            return keyword.search(self.documents(), query, k, where).drop("embedding")
        return keyword.search_index(self.documents(), self.store.read("postings"), self.store.read("lengths"), query, k, where).drop("embedding")

    def build_keyword_index(self) -> int:
        """Index all texts; from then on every write indexes its own texts. The number of documents."""

        def work(store: Store) -> int:
            for table in ("postings", "lengths"):
                if store.read(table).isEmpty():
                    continue
                store.replace(table, store.read(table).limit(0))
            store.set_fact("indexed", True)
            self._index(store, store.read("documents"))
            return store.read("lengths").count()

        return self.store.change(work)

    def _index(self, store: Store, docs: DataFrame) -> None:
        """Postings of new or changed texts. Each write has a stamp; a document's stamp in ``lengths`` tells its postings that count."""
        if not store.fact("indexed"):
            return
        stamp = store.fact("stamp", 0) + 1
        tokens, lengths = keyword.index_rows(docs, stamp)
        store.append("postings", tokens)
        store.put("lengths", lengths) if store.current()["tables"].get("lengths") else store.append("lengths", lengths)
        store.set_fact("stamp", stamp)

    def hybrid_search(self, query: str, k: int = K, filter: dict[str, Any] | None = None, *, query_vector: Sequence[float] | None = None, vector_k: int | None = None, keyword_k: int | None = None, rrf_k: int = RRF_K) -> DataFrame:
        if not query.strip() or k <= 0:
            return self.documents().limit(0).selectExpr("id", "text", "metadata", "0.0D as score")
        vector = self.vector(query if query_vector is None else query_vector)
        found = fusion.hybrid(self.documents(), query, vector, k, self.metric, predicate(filter, F.col("metadata")) if filter else None, vector_k, keyword_k, rrf_k)
        return found.join(self.documents().select("id", "text", "metadata"), "id").orderBy(F.desc("score"), F.col("dense_rank").asc_nulls_last(), "sparse_rank")

    def max_marginal_relevance_search(self, query: str | Sequence[float], k: int = K, fetch_k: int = FETCH_K, lambda_mult: float = LAMBDA_MULT, filter: dict[str, Any] | None = None) -> DataFrame:
        found = fusion.mmr(self.documents(), self.vector(query), k, fetch_k, lambda_mult, self.metric, predicate(filter, F.col("metadata")) if filter else None)
        return found.join(self.documents().select("id", "text", "metadata"), "id").orderBy("rank")

    # writing

    def add_texts(self, texts: Sequence[str], metadatas: Sequence[dict] | None = None, embeddings: Sequence[Sequence[float]] | None = None, ids: Sequence[int | None] | None = None, *, parent_ids: Sequence[int | None] | None = None) -> list[int]:
        """Add or, by id, replace documents; everything is checked before anything is written."""
        texts = list(texts)
        for other in (metadatas, embeddings, ids, parent_ids):
            if other is not None and len(other) != len(texts):
                raise ValueError("the lists differ in length")
        if not texts:
            return []
        if embeddings is None:
            if self.db.embedder is None:
                raise ValueError("embeddings or an embedder are needed")
            embeddings = self.db.embedder(texts)
        vectors = [[float(x) for x in v] for v in embeddings]
        dims = {len(v) for v in vectors}
        if len(dims) > 1 or (self.dim is not None and dims != {self.dim}):
            raise ValueError(f"vectors of {sorted(dims)} components; the collection has {self.dim}")
        if any(x != x or x in (float("inf"), float("-inf")) for v in vectors for x in v):
            raise ValueError("an embedding is not finite")
        given = list(ids) if ids is not None else [None] * len(texts)

        def work(store: Store) -> list[int]:
            last = store.fact("last_id", 0)
            final = []
            for i in given:
                last = max(last, i) if i is not None else last + 1
                final.append(i if i is not None else last)
            rows = {i: (i, t, json.dumps(m or {}, separators=(",", ":")), v, p) for i, t, m, v, p in zip(final, texts, metadatas or [None] * len(texts), vectors, parent_ids or [None] * len(texts))}
            new = self.spark.createDataFrame(list(rows.values()), DOCUMENTS)
            if any(i is not None for i in given):
                store.put("documents", new)
            else:
                store.append("documents", new)
            self._index(store, new)
            self._refresh(store, new)
            store.set_fact("last_id", last)
            store.set_fact("dim", dims.pop() if store.fact("dim") is None else store.fact("dim"))
            return final

        return self.store.change(work)

    def add_frame(self, rows: DataFrame) -> int:
        """Append a table (text, metadata, embedding, parent_id); ids follow the order of text and metadata. For bulk loads.

        Where rows bring their ids they keep them and replace documents of the same id; of equal ids the one with the greatest __seq, if there is one, counts.
        """
        if "embedding" in rows.columns:
            mutate.require_finite(rows)

        def work(store: Store) -> int:
            last, known = store.fact("last_id", 0), bool(store.current()["tables"].get("documents"))
            if "id" in rows.columns:
                new = mutate.latest(rows)
                store.put("documents", new) if known else store.append("documents", new)
            else:
                new = None
                store.append("documents", mutate.assign_ids(rows, last, "text", "metadata"))
            added = store.read("documents").agg(F.max("id"), F.max(F.size("embedding"))).first()
            if store.fact("indexed") or store.fact("ivf") is not None:
                changed = store.read("documents").where(F.col("id") > last) if new is None else store.read("documents").join(new.select("id"), "id", "left_semi")
                self._index(store, changed)
                self._refresh(store, changed)
            store.set_fact("last_id", max(last, added[0] or 0))
            if store.fact("dim") is None and added[1] and added[1] > 0:
                store.set_fact("dim", added[1])
            return new.count() if new is not None else (added[0] or last) - last

        return self.store.change(work)

    def add_texts_streaming(self, items: Iterable[tuple[str, dict | None, Sequence[float] | None]], *, batch_size: int = 1000, on_progress: Callable[[Progress], None] | None = None) -> Iterator[Progress]:
        """Micro-batches of an iterable; the total is known with the last, partial batch."""
        held: list[tuple] = []
        number = done = 0

        def flush(last: bool) -> Progress:
            nonlocal held, number, done
            vectors = None if held[0][2] is None else [x[2] for x in held]
            ids = self.add_texts([x[0] for x in held], [x[1] or {} for x in held], vectors)
            number, done = number + 1, done + len(ids)
            progress = Progress(number, number if last else None, done, len(ids), ids)
            if on_progress:
                on_progress(progress)
            held = []
            return progress

        for text, metadata, vector in items:
            held.append((text, metadata, vector))
            if len(held) >= batch_size:
                yield flush(False)
        if held:
            yield flush(True)

    def _log(self, store: Store, kind: str, doc_ids: DataFrame | None = None, payload: Any = None, now: float | None = None) -> None:
        rows = doc_ids if doc_ids is not None else self.spark.createDataFrame([(None,)], "id long")
        new = rows.select(F.lit(time.time() if now is None else now).alias("ts"), F.lit(kind).alias("kind"), F.col("id").cast("long").alias("doc_id"), F.lit(None if payload is None else json.dumps(payload)).cast("string").alias("payload"))
        last = store.fact("last_seq", 0)
        store.append("events", lifecycle.append_events(self.spark.createDataFrame([], store.schemas["events"]), new, last))
        store.set_fact("last_seq", last + new.count())

    def delete_by_ids(self, ids: Iterable[int]) -> int:
        return self._delete_rows(self._ids(ids))

    def _delete_rows(self, wanted: DataFrame) -> int:

        def work(store: Store) -> int:
            gone = store.read("documents").join(wanted, "id", "left_semi").select("id").cache()
            n = gone.count()
            if n:
                self._log(store, "delete", gone)
                self._cascade(store, gone)
            gone.unpersist()
            return n

        return self.store.change(work)

    def _cascade(self, store: Store, gone: DataFrame) -> None:
        """Drop documents and what belongs to them; children of those that go become roots. Only what changes is written."""
        docs = store.read("documents")
        children = docs.join(gone.withColumnRenamed("id", "parent_id"), "parent_id", "left_semi").join(gone, "id", "left_anti")
        store.put("documents", children.withColumn("parent_id", F.lit(None).cast("long")))
        store.set_fact("tombstones", store.fact("tombstones", 0) + store.drop("documents", gone))
        store.drop("lengths", gone)
        self._refresh(store, gone.withColumn("embedding", F.lit(None).cast("array<float>")))
        by_doc = gone.select(F.col("id").alias("doc_id"))
        for table in ("ttl", "pending"):
            store.drop(table, by_doc)
        held = store.read("edges")
        store.drop("edges", held.join(mutate.delete_edges_of(held, gone), list(store.keys["edges"]), "left_anti"))

    def remove_texts(self, texts: list[str] | None = None, filter: dict[str, Any] | None = None) -> int:
        found = mutate.matching_ids(self.documents(), texts, predicate(filter, F.col("metadata")) if filter else None)
        return self._delete_rows(found)

    def update_metadata(self, patches: Sequence[tuple[int, dict[str, Any]]] | DataFrame) -> int:
        """Merge JSON objects into the metadata of documents: pairs, or a table (id, patch, __seq). How many documents there are."""
        if not isinstance(patches, DataFrame):
            if not patches:
                return 0
            patches = self.spark.createDataFrame([(int(i), json.dumps(p), n) for n, (i, p) in enumerate(patches)], "id long, patch string, __seq long")

        def work(store: Store) -> int:
            some = store.read("documents").join(patches.select("id").distinct(), "id", "left_semi")
            return store.put("documents", mutate.update_metadata(some, patches))

        return self.store.change(work)

    def increment_frame(self, deltas: DataFrame, key: str) -> int:
        """Add the deltas (id, delta) to one number in the metadata; how many documents there are. Logged as one event."""

        def work(store: Store) -> int:
            some = store.read("documents").join(deltas.select("id").distinct(), "id", "left_semi")
            n = store.put("documents", mutate.increment(some, deltas, key))
            if n:
                self._log(store, "counter", payload={"key": key, "n": n})
            return n

        return self.store.change(work)

    def increment_metadata(self, id_: int, deltas: dict[str, float]) -> bool:
        return self.increment_many([(id_, deltas)]) == 1

    def increment_many(self, changes: Sequence[tuple[int, dict[str, float]]]) -> int:
        """Add to numbers in the metadata of documents, in one commit that writes these documents only; how many there are."""
        for _, deltas in changes:
            if not deltas or any(isinstance(d, bool) or not isinstance(d, (int, float)) or d != d or abs(d) == float("inf") for d in deltas.values()):
                raise ValueError("finite increments are needed")
        if not changes:
            return 0

        def work(store: Store) -> int:
            docs = self._only(store.read("documents"), [i for i, _ in changes])
            for key in sorted({k for _, deltas in changes for k in deltas}):
                rows = [(int(i), float(deltas[key])) for i, deltas in changes if key in deltas]
                docs = mutate.increment(docs, self.spark.createDataFrame(rows, "id long, delta double"), key)
            n = store.put("documents", docs)
            if n:
                known = {r[0] for r in docs.select("id").collect()}
                for i, deltas in changes:
                    if i in known:
                        self._log(store, "counter", self._ids([i]), deltas)
            return n

        return self.store.change(work)

    def counter(self, id_: int, key: str, default: float = 0.0) -> float | None:
        row = self.documents().where(F.col("id") == id_).select(mutate.counter_value(F.col("metadata"), key).alias("v")).first()
        return None if row is None else (default if row["v"] is None else row["v"])

    # hierarchy

    def get_children(self, id_: int) -> DataFrame:
        return tree.children(self.documents(), id_)

    def get_parent(self, id_: int) -> DataFrame:
        return tree.parent(self.documents(), id_)

    def get_descendants(self, id_: int, max_depth: int | None = None) -> DataFrame:
        return tree.descendants(self.documents(), id_, max_depth).join(self.documents().drop("embedding"), "id").orderBy("depth", "id")

    def get_ancestors(self, id_: int, max_depth: int | None = None) -> DataFrame:
        return tree.ancestors(self.documents(), id_, max_depth).join(self.documents().drop("embedding"), "id").orderBy("depth")

    def set_parent(self, id_: int, parent_id: int | None) -> bool:
        def work(store: Store) -> bool:
            rows, exists = tree.set_parent(store.read("documents"), id_, parent_id)
            if exists:
                store.put("documents", rows.where(F.col("id") == id_))
            return exists

        return self.store.change(work)

    # edges

    def _edges(self, rows: Sequence[dict[str, Any]], now: float | None) -> DataFrame:
        names = [c.split()[0] for c in EDGES.split(", ")]
        full = [{"last_touch": time.time() if now is None else now} | r | ({"metadata": json.dumps(r["metadata"])} if r.get("metadata") is not None else {}) for r in rows]
        return self.spark.createDataFrame([tuple(r.get(n) if r.get(n) is None or n not in ("weight", "bonus", "last_touch") else float(r[n]) for n in names) for r in full], EDGES)

    def add_edges(self, rows: Sequence[dict[str, Any]], now: float | None = None) -> None:
        new = self._edges([{"weight": 0.0, "hits": 0, "bonus": 0.0} | r for r in rows], now)

        def work(store: Store) -> None:
            edges.insert(store.read("edges"), new, store.read("documents"))  # checks the keys and ends
            store.put("edges", new)
            self._log(store, "edge_add")

        self.store.change(work)

    def _touched(self, store: Store, changes: DataFrame) -> DataFrame:
        return store.read("edges").join(changes.select(*edges.KEY).distinct(), edges.KEY, "left_semi")

    def upsert_edges(self, rows: Sequence[dict[str, Any]], now: float | None = None) -> None:
        new = self._edges(rows, now)
        self.store.change(lambda s: (s.put("edges", edges.upsert(self._touched(s, new), new)), self._log(s, "edge_upsert"))[0])

    def update_edges(self, changes: DataFrame) -> int:
        """Deltas and new values of edges that are there; their number. Nothing is logged where nothing changes."""

        def work(store: Store) -> int:
            n = store.put("edges", edges.update(self._touched(store, changes), changes))
            if n:
                self._log(store, "edge_update", payload={"n": n})
            return n

        return self.store.change(work)

    def delete_edge(self, src_id: int, dst_id: int, *, kind: str = "") -> int:
        """1 if there was such an edge, else 0."""
        key = self.spark.createDataFrame([(int(src_id), int(dst_id), kind)], "src_id long, dst_id long, kind string")

        def work(store: Store) -> int:
            n = store.drop("edges", self._touched(store, key))
            if n:
                self._log(store, "edge_delete", payload={"src": int(src_id), "dst": int(dst_id), "kind": kind})
            return n

        return self.store.change(work)

    def get_edges(self, **constraints: Any) -> DataFrame:
        return edges.get(self.store.read("edges"), **constraints)

    def prune_edges(self, **conditions: Any) -> int:
        def work(store: Store) -> int:
            before = store.read("edges")
            return store.drop("edges", before.join(edges.prune(before, **conditions).select(*edges.KEY), edges.KEY, "left_anti"))

        return self.store.change(work)

    # change feed, expiry, buffered vectors

    def append_event(self, kind: str, doc_id: int | None = None, payload: Any = None) -> int:
        if not isinstance(kind, str) or not kind:
            raise ValueError("an event has a kind")
        self.store.change(lambda s: self._log(s, kind, None if doc_id is None else self._ids([doc_id]), payload))
        return self.store.fact("last_seq", 0)

    def read_events(self, since: int = 0, kind: str | None = None, limit: int | None = None) -> DataFrame:
        return lifecycle.read_events(self.events(), since, kind, limit)

    def events(self) -> DataFrame:
        """The change feed from its floor on."""
        return lifecycle.prune_events(self.store.read("events"), self.store.fact("events_floor", 0))

    def last_seq(self) -> int:
        return lifecycle.last_seq(self.events()).first()[0]

    def prune_events(self, before_seq: int) -> None:
        """Raise the floor. No event is ever written twice, so that whoever follows the files of the feed meets each once."""
        self.store.change(lambda s: s.set_fact("events_floor", max(before_seq, s.fact("events_floor", 0))))

    def set_ttl(self, id_: int, *, expires_at: float | None = None, seconds: float | None = None, on_expire: str = "delete", now: float | None = None) -> None:
        if (expires_at is None) == (seconds is None) or on_expire not in ("delete", "callback"):
            raise ValueError("either expires_at or seconds, and delete or callback")
        at = expires_at if expires_at is not None else (time.time() if now is None else now) + seconds
        new = self.spark.createDataFrame([(int(id_), float(at), on_expire)], "doc_id long, expires_at double, on_expire string")
        self.store.change(lambda s: (s.put("ttl", new), self._log(s, "ttl_set", self._ids([id_])))[0])

    def clear_ttl(self, id_: int) -> None:
        self.store.change(lambda s: s.drop("ttl", self._ids([id_]).withColumnRenamed("id", "doc_id")))

    def sweep(self, now: float | None = None, limit: int = SWEEP_LIMIT) -> tuple[list[int], list[int]]:
        """(deleted, called back): at most ``limit`` due entries, oldest first."""
        at = time.time() if now is None else now

        def work(store: Store) -> tuple[list[int], list[int]]:
            claimed = lifecycle.expired(store.read("ttl"), at, limit).collect()
            if claimed:
                ids = self._ids(r["doc_id"] for r in claimed)
                store.drop("ttl", ids.withColumnRenamed("id", "doc_id"))
                self._log(store, "ttl_expire", ids)
                gone = [r["doc_id"] for r in claimed if r["on_expire"] == "delete"]
                if gone:
                    self._cascade(store, self._ids(gone))
            return [r["doc_id"] for r in claimed if r["on_expire"] == "delete"], [r["doc_id"] for r in claimed if r["on_expire"] != "delete"]

        return self.store.change(work)

    def update_embeddings(self, updates: Sequence[tuple[int, Sequence[float]]], source: str | None = None) -> None:
        """Buffer vectors; searches see them after flush_pending."""
        for _, v in updates:
            knn.check_dimension(v, self.dim)
        new = self.spark.createDataFrame([(int(i), [float(x) for x in v], source, time.time() + n * 1e-6) for n, (i, v) in enumerate(updates)], "doc_id long, embedding array<float>, source string, enqueued_at double")
        mutate.require_finite(new)
        self.store.change(lambda s: (s.put("pending", lifecycle.latest_pending(new)), self._log(s, "pending_enqueue"))[0])

    def blend_toward(self, ids: Sequence[int], centroid: Sequence[float], alpha: float) -> int:
        blended = lifecycle.blend_toward(self.documents(), self.store.read("pending"), F.col("id").isin(list(ids)), V.literal(centroid), alpha).collect()
        if blended:
            self.update_embeddings([(r["doc_id"], r["embedding"]) for r in blended], "blend")
        return len(blended)

    def pending_size(self) -> int:
        return self.store.read("pending").count()

    def flush_pending(self, max_batch: int | None = None) -> int:
        def work(store: Store) -> int:
            batch = lifecycle.list_pending(store.read("pending"), store.read("documents"), max_batch)
            ids = [r[0] for r in batch.select("doc_id").collect()]
            if ids:
                store.put("documents", lifecycle.flush_pending(self._only(store.read("documents"), ids), batch))
                self._refresh(store, self._only(store.read("documents"), ids))
                store.drop("pending", self._ids(ids).withColumnRenamed("id", "doc_id"))
                self._log(store, "pending_flush", payload={"n": len(ids)})
                store.set_fact("flushes", store.fact("flushes", 0) + 1)
            return len(ids)

        return self.store.change(work)

    def suggest_rebuild(self, policy: lifecycle.RebuildPolicy | None = None, now: float | None = None) -> bool:
        age = (time.time() if now is None else now) - self.store.fact("rebuilt_at", 0.0)
        return (policy or lifecycle.RebuildPolicy()).due(self.store.fact("flushes", 0), self.store.fact("tombstones", 0), age)

    def rebuild_if_needed(self, policy: lifecycle.RebuildPolicy | None = None, now: float | None = None) -> bool:
        """Rebuild where the policy says so; whether it did."""
        due = self.suggest_rebuild(policy, now)
        if due:
            self.rebuild_index()
        return due

    @contextmanager
    def background_sweep(self, interval: float = 60.0, limit: int = SWEEP_LIMIT, on_expire: Callable[[list[int]], None] | None = None) -> Iterator[None]:
        """Sweep every ``interval`` seconds in a thread of the driver while the block runs; ids on 'callback' go to ``on_expire``."""
        stop = threading.Event()

        def run() -> None:
            while not stop.wait(interval):
                _, called = self.sweep(limit=limit)
                if called and on_expire:
                    on_expire(called)

        thread = threading.Thread(target=run, daemon=True)
        thread.start()
        try:
            yield
        finally:
            stop.set()
            thread.join()

    def rebuild_index(self) -> int:
        """Rewrite the documents as one segment; the number of vectors."""

        def work(store: Store) -> int:
            store.replace("documents", store.read("documents"))
            store.set_fact("flushes", 0)
            store.set_fact("tombstones", 0)
            store.set_fact("rebuilt_at", time.time())
            self._log(store, "rebuild")
            return store.read("documents").where("embedding is not null").count()

        return self.store.change(work)

    # clusters

    def cluster(self, n_clusters: int | None = None, algorithm: str = "minibatch_kmeans", *, filter: dict[str, Any] | None = None, sample_size: int | None = None, min_cluster_size: int = 5, random_state: int = 0):
        """(assignments, centroids, inertia); density clusters have neither centroids nor inertia.

        With ``sample_size`` only so many documents, drawn by hash, are clustered; all others get the label of the nearest centroid (of
        density clusters, of the nearest cluster's mean), and inertia counts all documents.
        """
        docs = self.documents().where(predicate(filter, F.col("metadata"))).where("embedding is not null")
        if self.metric == "cosine":
            docs = docs.withColumn("embedding", V.l2_normalize(F.col("embedding")))
        if algorithm not in ("hdbscan", "kmeans", "minibatch_kmeans"):
            raise ValueError(f"unknown algorithm {algorithm!r}")
        if algorithm != "hdbscan" and (n_clusters is None or n_clusters < 1):
            raise ValueError("n_clusters is needed")
        if sample_size is not None and sample_size < 1:
            raise ValueError("a sample has one document at least")
        some = docs if sample_size is None else docs.orderBy(F.xxhash64("id", F.lit(random_state)), "id").limit(sample_size)
        if algorithm == "hdbscan":
            labels = cluster.hdbscan(some, min_cluster_size)
            if sample_size is None:
                return labels, None, None
            means = cluster.mean_vectors(some.join(labels.where("label >= 0"), "id"))
            rest = cluster.assign(docs.join(labels.select("id"), "id", "left_anti"), means).select("id", F.coalesce("label", F.lit(-1)).cast(labels.schema["label"].dataType).alias("label"))
            return labels.unionByName(rest), None, None
        if algorithm == "kmeans":
            labels, centroids, inertia = cluster.kmeans(some, n_clusters, random_state)
        else:
            labels, centroids = cluster.minibatch_kmeans(some, n_clusters, seed=random_state)
            inertia = None
        if sample_size is None or not centroids:
            return labels, centroids, inertia
        table = self.spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centroids)], "label long, centroid array<double>")
        every = cluster.assign(docs, table)
        return every.select("id", F.col("label").cast("int").alias("label")), centroids, every.agg(F.sum("distance")).first()[0] if algorithm == "kmeans" else None

    def cluster_metrics(self, assignments: DataFrame) -> dict[str, Any]:
        """Documents, clusters, noise, sizes of the clusters and silhouette (of a bounded sample, as cosine collections measure it on unit vectors)."""
        v = V.l2_normalize(F.col("embedding")) if self.metric == "cosine" else F.col("embedding")
        rows = self.documents().where("embedding is not null").select("id", v.alias("embedding")).join(assignments.select("id", "label"), "id")
        sizes = {r["label"]: r["n"] for r in cluster.summary(rows).collect()}
        kept = [x for x in sizes if x >= 0]
        score = cluster.silhouette(rows.where("label >= 0")).first()["silhouette"] if len(kept) > 1 else None
        return {"n_documents": sum(sizes.values()), "n_clusters": len(kept), "n_noise": sizes.get(-1, 0), "sizes": {k: sizes[k] for k in kept}, "silhouette": score}

    def auto_tag(self, assignments: DataFrame, n_keywords: int = 5, callback: Callable[[list[str]], str] | None = None) -> DataFrame:
        rows = self.documents().select("id", "text").join(assignments.select("id", "label"), "id")
        return cluster.tags(rows, n_keywords) if callback is None else cluster.custom_tags(rows, callback)

    def assign_cluster_metadata(self, assignments: DataFrame, tags: DataFrame | None = None, metadata_key: str = "cluster", tag_key: str = "cluster_tag") -> int:
        rows = assignments.select("id", F.col("label").cast("long").alias("label"))
        if tags is not None:
            rows = rows.join(tags.select(F.col("label").alias("__l"), "tags"), F.col("label") == F.col("__l"), "left")
            text = F.concat(F.lit("{"), F.lit(json.dumps(metadata_key) + ":"), F.col("label").cast("string"), F.when(F.col("tags").isNotNull(), F.concat(F.lit("," + json.dumps(tag_key) + ":"), F.regexp_replace(F.to_json(F.array("tags")), r"^\[|\]$", ""))).otherwise(F.lit("")), F.lit("}"))
        else:
            text = F.concat(F.lit("{" + json.dumps(metadata_key) + ":"), F.col("label").cast("string"), F.lit("}"))
        patches = rows.select("id", text.alias("patch"), F.lit(0).cast("long").alias("__seq"))

        def work(store: Store) -> int:
            some = store.read("documents").join(patches.select("id"), "id", "left_semi")
            return store.put("documents", mutate.update_metadata(some, patches))

        return self.store.change(work)

    def get_cluster_members(self, label: int, metadata_key: str = "cluster") -> DataFrame:
        return self.get_documents({metadata_key: label})

    def save_cluster(self, name: str, centroids: Sequence[Sequence[float]], algorithm: str = "kmeans", metadata: dict | None = None) -> None:
        row = self.spark.createDataFrame([(name, algorithm, len(centroids), [[float(x) for x in c] for c in centroids], time.time(), json.dumps(metadata or {}))], self.store.schemas["clusters"])
        self.store.change(lambda s: s.put("clusters", row))

    def load_cluster(self, name: str):
        return self.store.read("clusters").where(F.col("name") == name).first()

    def list_clusters(self) -> list[str]:
        return [r[0] for r in self.store.read("clusters").select("name").orderBy("name").collect()]

    def delete_cluster(self, name: str) -> bool:
        existed = name in self.list_clusters()
        self.store.change(lambda s: s.drop("clusters", self.spark.createDataFrame([(name,)], "name string")))
        return existed

    def assign_to_cluster(self, name: str, doc_ids: Sequence[int] | None = None, metadata_key: str = "cluster") -> int:
        """Label the given documents, or all without a label, by the nearest stored centroid."""
        saved = self.load_cluster(name)
        if saved is None or not saved["centroids"]:
            raise ValueError(f"no centroids are stored as {name!r}")
        docs = self.documents().where(F.col("embedding").isNotNull())
        docs = docs.join(self._ids(doc_ids), "id", "left_semi") if doc_ids is not None else docs.where(predicate({metadata_key: {"$exists": False}}, F.col("metadata")))
        v = V.l2_normalize(F.col("embedding")) if self.metric == "cosine" else F.col("embedding")
        return self.assign_cluster_metadata(docs.select("id", cluster.nearest_label(v, saved["centroids"]).alias("label")), metadata_key=metadata_key)


class Async:
    """Every method of a database or collection as a coroutine: ``await Async(collection).similarity_search(...)``."""

    def __init__(self, target: Any):
        self._target = target

    def __getattr__(self, name: str):
        found = getattr(self._target, name)
        if not callable(found):
            return found

        async def call(*args: Any, **kwargs: Any):
            out = await asyncio.to_thread(found, *args, **kwargs)
            return Async(out) if isinstance(out, VectorCollection) else out

        return call
