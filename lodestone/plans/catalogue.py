"""Queries over the test tables, one for each operator, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..collection import VectorCollection, VectorDB
from ..functions import text as T
from ..functions import vectors as V
from ..functions.filters import predicate
from ..operators import cluster, edges, fusion, keyword, knn, lifecycle, mutate, tree
from ..streaming import feeds

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
NOW = 1_700_000_000.0


def query(sql: str | None = None, name: str | None = None):
    def add(f: Query) -> Query:
        key = name or f.__name__
        _QUERIES[key] = f
        if sql is not None:
            _SQL[key] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", "lang", "source", "n_chars")


def vector_of(spark: SparkSession, sf: str, id_: int) -> list[float]:
    return list(vectors(spark, sf).where(F.col("id") == id_).first()["embedding"])


# nearest neighbours

_Q0 = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)"
_COS = f"round(list_cosine_distance(embedding::DOUBLE[], {_Q0}), 6) + 0.0"
_L2 = f"round(list_distance(embedding::DOUBLE[], {_Q0}) ** 2, 6)"


def _knn_sql(distance: str, k: int, where: str = "true") -> str:
    return f"SELECT id, distance, CAST(row_number() OVER (ORDER BY distance, id) AS INTEGER) AS rank FROM (SELECT vec_id AS id, {distance} AS distance FROM embeddings WHERE {where}) ORDER BY distance, id LIMIT {k}"


def _ranked(found: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    return found.withColumn("rank", F.row_number().over(Window.orderBy("distance", "id"))).select("id", (F.col("distance") + 0.0).alias("distance"), "rank")


@query(_knn_sql(_COS, 10))
def knn_topk(spark, sf):
    return _ranked(knn.search(vectors(spark, sf), vector_of(spark, sf, 0), 10, "cosine", digits=6))


@query(f"SELECT vec_id AS id, {_COS} AS distance FROM embeddings")
def knn_cosine(spark, sf):
    return vectors(spark, sf).select("id", (F.round(V.cosine_distance(F.col("embedding"), V.literal(vector_of(spark, sf, 0))), 6) + 0.0).alias("distance"))


@query(_knn_sql(_L2, 20))
def knn_l2sq(spark, sf):
    return _ranked(knn.search(vectors(spark, sf), vector_of(spark, sf, 0), 20, "l2", digits=6))


@query("WITH q AS (SELECT generate_subscripts(embedding, 1) i, unnest(embedding) x FROM embeddings WHERE vec_id = 0), e AS (SELECT vec_id id, generate_subscripts(embedding, 1) i, unnest(embedding) x FROM embeddings), d AS (SELECT id, sum(CASE WHEN (e.x > 0) <> (q.x > 0) THEN 1.0 ELSE 0.0 END)::DOUBLE distance FROM e JOIN q USING (i) GROUP BY id) SELECT id, distance, CAST(row_number() OVER (ORDER BY distance, id) AS INTEGER) AS rank FROM d ORDER BY distance, id LIMIT 20")
def knn_hamming(spark, sf):
    return _ranked(knn.search(vectors(spark, sf), vector_of(spark, sf, 0), 20, "hamming"))


@query(_knn_sql(_COS, 10, "label IN (1, 3, 5)"))
def knn_filtered(spark, sf):
    return _ranked(knn.search(vectors(spark, sf), vector_of(spark, sf, 0), 10, "cosine", F.col("label").isin(1, 3, 5), digits=6))


def _batch_sql(n: int, k: int, where: str) -> str:
    return f"WITH d AS (SELECT q.vec_id AS qid, e.vec_id AS id, round(list_cosine_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) + 0.0 AS distance FROM embeddings q, embeddings e WHERE q.vec_id < {n} AND {where}), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY distance, id) AS INTEGER) AS rank FROM d) SELECT qid, id, distance, rank FROM r WHERE rank <= {k}"


def _batch(spark, sf, n: int, where=None) -> DataFrame:
    rows = vectors(spark, sf)
    asked = [(r["id"], r["embedding"]) for r in rows.where(F.col("id") < n).orderBy("id").collect()]
    return knn.search_batch(rows, asked, 10, "cosine", where)


@query(_batch_sql(100, 10, "true"))
def knn_batch(spark, sf):
    return _batch(spark, sf, 100)


@query(_batch_sql(40, 10, "e.label < 4"))
def knn_batch_filtered(spark, sf):
    return _batch(spark, sf, 40, F.col("label") < 4)


@query()
def knn_ann_ivf(spark, sf):
    rows = vectors(spark, sf)
    made = library(spark, rows.select("id", "embedding"))
    made.build_vector_index(16)
    return made.similarity_search(vector_of(spark, sf, 0), 10, exact=False).select("id", "distance")


# codecs

_EACH = "SELECT vec_id AS id, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings"


@query(f"WITH e AS ({_EACH}), n AS (SELECT id, greatest(sqrt(sum((2 * x) * (2 * x))), 1e-12) AS norm FROM e GROUP BY id) SELECT id, CAST(i - 1 AS INTEGER) AS i, round(2 * x / norm, 6) + 0.0 AS x FROM e JOIN n USING (id)")
def l2_normalize(spark, sf):
    doubled = F.transform(V.doubles(F.col("embedding")), lambda x: x * 2)
    return vectors(spark, sf).select("id", F.posexplode(V.l2_normalize(doubled)).alias("i", "x")).select("id", "i", (F.round("x", 6) + 0.0).alias("x"))


@query(f"WITH e AS (SELECT id, i, CASE WHEN id % 5 = 0 THEN 0.0 ELSE 3 * x END AS x FROM ({_EACH})), n AS (SELECT id, sqrt(sum(x * x)) AS norm FROM e GROUP BY id) SELECT id, CAST(i - 1 AS INTEGER) AS i, round(CASE WHEN norm < 1e-12 THEN x ELSE x / norm END, 6) + 0.0 AS x FROM e JOIN n USING (id)")
def normalize_l2(spark, sf):
    scaled = F.transform(V.doubles(F.col("embedding")), lambda x: F.when(F.col("id") % 5 == 0, 0.0).otherwise(x * 3))
    return vectors(spark, sf).select("id", F.posexplode(V.normalize_l2(scaled)).alias("i", "x")).select("id", "i", (F.round("x", 6) + 0.0).alias("x"))


@query(f"WITH e AS ({_EACH}) SELECT id, CAST(i - 1 AS INTEGER) AS i, CAST(greatest(-128, least(127, round_even(x * 127, 0))) AS INTEGER) AS x FROM e")
def quant_int8(spark, sf):
    return vectors(spark, sf).select("id", F.posexplode(V.int8_encode(F.col("embedding"))).alias("i", "x")).select("id", "i", F.col("x").cast("int").alias("x"))


@query(f"WITH e AS ({_EACH}) SELECT id, CAST((i - 1) // 8 AS INTEGER) AS i, CAST(sum(CASE WHEN x > 0 THEN 1 << (7 - (i - 1) % 8) ELSE 0 END) AS INTEGER) AS octet FROM e GROUP BY ALL")
def quant_bit(spark, sf):
    return vectors(spark, sf).select("id", F.posexplode(V.bit_encode(F.col("embedding"))).alias("i", "octet"))


@query()
def quant_f16(spark, sf):
    return vectors(spark, sf).select("id", F.posexplode(V.half_round_trip(F.col("embedding"))).alias("i", "x"))


@query()
def hash_embed(spark, sf):
    return documents(spark, sf).select("id", F.posexplode(V.hash_embedder(16)(F.col("text"))).alias("i", "x"))


# scans

def library(spark, rows: DataFrame) -> VectorCollection:
    """A collection that holds these rows, by their ids."""
    from ..sources.scratch import fresh_path

    made = VectorDB(spark, fresh_path(spark, "db")).collection("rows")
    made.add_frame(rows)
    return made


def described(spark, sf) -> DataFrame:
    """Documents with their language, source and length as metadata."""
    return documents(spark, sf).select("id", "text", F.to_json(F.struct("lang", "source", "n_chars")).alias("metadata"))


@query("SELECT doc_id AS id, lang, n_chars FROM documents WHERE lang = 'en' ORDER BY doc_id LIMIT 50 OFFSET 100")
def scan_paginated(spark, sf):
    page = library(spark, described(spark, sf)).get_documents({"lang": "en"}, limit=50, offset=100)
    return page.select("id", F.get_json_object("metadata", "$.lang").alias("lang"), F.get_json_object("metadata", "$.n_chars").cast("long").alias("n_chars"))


@query("SELECT doc_id AS id, text, lang FROM documents WHERE doc_id IN (3, 5, 8, 13, 100000000)")
def lookup_by_ids(spark, sf):
    found = library(spark, described(spark, sf)).get_documents_by_ids([3, 5, 8, 13, 100000000])
    return found.select("id", "text", F.get_json_object("metadata", "$.lang").alias("lang"))


@query(f"SELECT id, CAST(i - 1 AS INTEGER) AS i, round(x, 6) + 0.0 AS x FROM ({_EACH}) WHERE id IN (2, 4, 499)")
def lookup_embeddings(spark, sf):
    return library(spark, vectors(spark, sf).select("id", "embedding")).get_embeddings_by_ids([2, 4, 499]).select("id", F.posexplode(V.doubles(F.col("embedding"))).alias("i", "x")).select("id", "i", (F.round("x", 6) + 0.0).alias("x"))


@query("SELECT doc_id AS id FROM documents WHERE text IN (SELECT text FROM documents WHERE doc_id < 40) ORDER BY id LIMIT 100")
def find_by_text(spark, sf):
    texts = [r[0] for r in documents(spark, sf).where("id < 40").select("text").collect()]
    return library(spark, described(spark, sf)).find_ids_by_texts(texts, limit=100)


@query("SELECT event_id AS id FROM events WHERE CAST(json_extract(props, '$.k') AS DOUBLE) >= 90 AND event_type = 'click'")
def find_by_filter(spark, sf):
    return table(spark, sf, "events").where(predicate({"k": {"$gte": 90}}, F.col("props")) & (F.col("event_type") == "click")).select(F.col("event_id").alias("id"))


@query("SELECT count(*) AS n FROM documents")
def count_docs(spark, sf):
    return spark.createDataFrame([(library(spark, described(spark, sf)).count(),)], "n long")


@query("SELECT DISTINCT source AS name FROM documents")
def list_collections(spark, sf):
    from ..sources.scratch import fresh_path

    db = VectorDB(spark, fresh_path(spark, "db"))
    for row in documents(spark, sf).select("source").distinct().collect():
        db.collection(row["source"])
    return spark.createDataFrame([(name,) for name in db.list_collections()], "name string")


# the predicate language, over metadata of mixed types

_META = """CASE event_id % 7 WHEN 0 THEN props WHEN 1 THEN '{"k": "' || json_extract_string(props, '$.k') || '"}' WHEN 2 THEN '{"k": true}' WHEN 3 THEN '{"k": null}'
 WHEN 4 THEN '{}' WHEN 5 THEN '{"k": ' || json_extract_string(props, '$.k') || '.5, "a": {"b": ' || json_extract_string(props, '$.k') || '}}' ELSE '{"k": [1, 2]}' END"""
_ROWS = f"(SELECT event_id AS id, {_META} AS m FROM events)"
_NUM = "json_type(m, '$.k') IN ('UBIGINT', 'BIGINT', 'DOUBLE')"
_VAL = "TRY_CAST(json_extract_string(m, '$.k') AS DOUBLE)"
_NUMERIC = f"CASE WHEN {_NUM} THEN {_VAL} WHEN json_type(m, '$.k') = 'BOOLEAN' THEN CASE json_extract_string(m, '$.k') WHEN 'true' THEN 1.0 ELSE 0.0 END END"
_STRING = "CASE WHEN json_type(m, '$.k') = 'VARCHAR' THEN json_extract_string(m, '$.k') END"
_PRESENT = "coalesce(json_type(m, '$.k') <> 'NULL', false)"


def mixed(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    kind = F.col("event_id") % 7
    meta = F.when(kind == 0, F.col("props")).when(kind == 1, F.concat(F.lit('{"k": "'), k, F.lit('"}'))).when(kind == 2, F.lit('{"k": true}')).when(kind == 3, F.lit('{"k": null}')).when(kind == 4, F.lit("{}"))
    meta = meta.when(kind == 5, F.concat(F.lit('{"k": '), k, F.lit('.5, "a": {"b": '), k, F.lit("}}"))).otherwise(F.lit('{"k": [1, 2]}'))
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), meta.alias("m"))


def _filter(name: str, conditions: dict, sql: str) -> None:
    @query(f"SELECT id FROM {_ROWS} WHERE coalesce({sql}, false)", name)
    def run(spark, sf):
        return mixed(spark, sf).where(predicate(conditions, F.col("m"))).select("id")


_filter("filter_eq", {"k": 1}, f"{_NUMERIC} = 1")
_filter("filter_eq_string", {"k": "12"}, f"{_STRING} = '12'")
_filter("filter_eq_bool", {"k": True}, f"{_NUMERIC} = 1")
_filter("filter_nested", {"a.b": {"$gt": 50}}, "TRY_CAST(json_extract_string(m, '$.a.b') AS DOUBLE) > 50")
_filter("filter_list", {"k": [1, 2, "3", 4.5]}, f"{_NUMERIC} IN (1, 2, 4.5) OR {_STRING} = '3'")
_filter("filter_op_eq", {"k": {"$eq": 7}}, f"{_NUMERIC} = 7")
_filter("filter_op_ne", {"k": {"$ne": 7}}, f"NOT {_PRESENT} OR NOT coalesce({_NUMERIC} = 7, false)")
_filter("filter_op_gt", {"k": {"$gt": 90}}, f"{_NUM} AND {_VAL} > 90")
_filter("filter_op_gte", {"k": {"$gte": 90}}, f"{_NUM} AND {_VAL} >= 90")
_filter("filter_op_lt", {"k": {"$lt": 5}}, f"{_NUM} AND {_VAL} < 5")
_filter("filter_op_lte", {"k": {"$lte": 5}}, f"{_NUM} AND {_VAL} <= 5")
_filter("filter_op_in", {"k": {"$in": [3, "5", 7]}}, f"{_NUMERIC} IN (3, 7) OR {_STRING} = '5'")
_filter("filter_op_nin", {"k": {"$nin": [3, "5", 7]}}, f"NOT {_PRESENT} OR NOT (coalesce({_NUMERIC} IN (3, 7), false) OR coalesce({_STRING} = '5', false))")
_filter("filter_op_exists", {"k": {"$exists": True}}, _PRESENT)
_filter("filter_op_missing", {"k": {"$exists": False}}, f"NOT {_PRESENT}")
_filter("filter_op_between", {"k": {"$between": [10, 20]}}, f"{_NUM} AND {_VAL} BETWEEN 10 AND 20")
_filter("filter_multi_op", {"k": {"$gte": 10, "$lt": 20, "$ne": 15}}, f"{_NUM} AND {_VAL} >= 10 AND {_VAL} < 20 AND {_VAL} <> 15")
_filter("filter_tuple", {"k": ("range", 30, 40)}, f"{_NUM} AND {_VAL} BETWEEN 30 AND 40")


@query(f"SELECT id, CASE WHEN {_NUM} THEN {_VAL} ELSE 0.0 END AS value FROM {_ROWS}")
def counter_get(spark, sf):
    return mixed(spark, sf).select("id", F.coalesce(mutate.counter_value(F.col("m"), "k"), F.lit(0.0)).alias("value"))


# keyword search

_TOKENS = "regexp_extract_all(lower(strip_accents(text)), '[\\p{L}\\p{N}]+')"


@query(f"SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({_TOKENS}) AS term FROM documents) GROUP BY term")
def tokenize(spark, sf):
    words = documents(spark, sf).select("id", F.explode(T.tokens(F.col("text"))).alias("term")).groupBy("term", "id").agg(F.count("*").alias("n"))
    return words.groupBy("term").agg(F.sum("n").alias("tf"), F.count("*").alias("df"))


def _bm25_sql(counts: list[str], match: str, where: str = "true", k: int = 20) -> str:
    """counts: SQL for the hits of each phrase in the list t; match: over f0, f1, ..."""
    hits = ", ".join(f"{c} AS f{i}" for i, c in enumerate(counts))
    terms = " + ".join(
        f"CASE WHEN ln((n - df{i} + 0.5) / (df{i} + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df{i} + 0.5) / (df{i} + 0.5)) END * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * d / av))" for i in range(len(counts)) if not counts[i].startswith("/*not*/")
    )
    dfs = ", ".join(f"sum(CASE WHEN f{i} > 0 THEN 1 ELSE 0 END)::DOUBLE AS df{i}" for i in range(len(counts)))
    return f"""WITH t AS (SELECT doc_id AS id, lang, {_TOKENS} AS t FROM documents), c AS (SELECT id, lang, len(t) AS d, {hits} FROM t),
 s AS (SELECT count(*)::DOUBLE AS n, avg(d) AS av, {dfs} FROM c), r AS (SELECT id, round(-({terms}), 6) AS score FROM c, s WHERE ({match}) AND {where})
 SELECT id, score, CAST(row_number() OVER (ORDER BY score, id) AS INTEGER) AS rank FROM r ORDER BY score, id LIMIT {k}"""


def _word(w: str) -> str:
    return f"len(list_filter(t, lambda x: x = '{w}'))"


def _bm25(spark, sf, text: str, where=None, k: int = 20) -> DataFrame:
    from pyspark.sql import Window

    found = keyword.search(documents(spark, sf), text, k, where, digits=6)
    return found.withColumn("rank", F.row_number().over(Window.orderBy("score", "id"))).select("id", "score", "rank")


@query(_bm25_sql([_word("que"), _word("les"), _word("und")], "f0 > 0 OR f1 > 0 OR f2 > 0"))
def bm25_or(spark, sf):
    return _bm25(spark, sf, "que OR les OR und")


@query(_bm25_sql([_word("que"), _word("les")], "f0 > 0 AND f1 > 0"))
def bm25_and(spark, sf):
    return _bm25(spark, sf, "que les")


@query(_bm25_sql([_word("the"), "/*not*/ " + _word("and")], "f0 > 0 AND NOT f1 > 0"))
def bm25_not(spark, sf):
    return _bm25(spark, sf, "the NOT and")


@query(_bm25_sql(["len(list_filter(list_zip(t[1:-2], t[2:]), lambda x: x[1] = 'of' AND x[2] = 'the'))"], "f0 > 0"))
def bm25_phrase(spark, sf):
    return _bm25(spark, sf, '"of the"')


@query(_bm25_sql(["len(list_filter(t, lambda x: starts_with(x, 'reti')))"], "f0 > 0"))
def bm25_prefix(spark, sf):
    return _bm25(spark, sf, "reti*")


@query(_bm25_sql([_word("les"), _word("und")], "f0 > 0 OR f1 > 0", "lang = 'de'"))
def bm25_filtered(spark, sf):
    return _bm25(spark, sf, "les OR und", F.col("lang") == "de")


# fusion

def _both(spark, sf) -> DataFrame:
    return documents(spark, sf).join(vectors(spark, sf), "id")


def _hybrid_sql(where: str) -> str:
    bm = f"""t AS (SELECT b.*, {_TOKENS} AS t FROM b), c AS (SELECT id, label, len(t) AS d, {_word("que")} AS f0, {_word("the")} AS f1 FROM t),
 s AS (SELECT count(*)::DOUBLE AS n, avg(d) AS av, sum((f0 > 0)::INT)::DOUBLE AS df0, sum((f1 > 0)::INT)::DOUBLE AS df1 FROM c),
 k AS (SELECT id, round(-(CASE WHEN ln((n - df0 + 0.5) / (df0 + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df0 + 0.5) / (df0 + 0.5)) END * f0 * 2.2 / (f0 + 1.2 * (0.25 + 0.75 * d / av)) + CASE WHEN ln((n - df1 + 0.5) / (df1 + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df1 + 0.5) / (df1 + 0.5)) END * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * d / av))), 6) AS score FROM c, s WHERE (f0 > 0 OR f1 > 0) AND {where}),
 sp AS (SELECT id, row_number() OVER (ORDER BY score, id) AS r FROM k QUALIFY r <= 10)"""
    return f"""WITH b AS (SELECT doc_id AS id, text, embedding, label FROM documents JOIN embeddings ON doc_id = vec_id), v AS (SELECT id, label, round(list_cosine_distance(embedding::DOUBLE[], {_Q0}), 6) AS distance FROM b),
 dn AS (SELECT id, r FROM (SELECT id, label, row_number() OVER (ORDER BY distance, id) AS r FROM v) WHERE r <= 10 AND {where}), {bm}
 SELECT coalesce(dn.id, sp.id) AS id, round(coalesce(1.0::DOUBLE / (60 + dn.r), 0.0::DOUBLE) + coalesce(1.0::DOUBLE / (60 + sp.r), 0.0::DOUBLE), 6) AS score FROM dn FULL JOIN sp ON dn.id = sp.id ORDER BY score DESC, dn.r NULLS LAST, sp.r NULLS LAST LIMIT 8"""


@query(_hybrid_sql("true"))
def hybrid_rrf(spark, sf):
    return fusion.hybrid(_both(spark, sf), "que OR the", vector_of(spark, sf, 0), 8, digits=6).select("id", "score")


@query(_hybrid_sql("label < 5"))
def hybrid_rrf_filtered(spark, sf):
    return fusion.hybrid(_both(spark, sf), "que OR the", vector_of(spark, sf, 0), 8, where=F.col("label") < 5, digits=6).select("id", "score")


@query(
    f"""WITH c AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, {_COS} AS d FROM embeddings ORDER BY d, vec_id LIMIT 20), p1 AS (SELECT id, v FROM c ORDER BY d, id LIMIT 1),
 p2 AS (SELECT c.id, c.v FROM c, p1 WHERE c.id <> p1.id ORDER BY 0.5 * (1 - d / 2) - 0.5 * list_cosine_similarity(c.v, p1.v) DESC, d, c.id LIMIT 1),
 p3 AS (SELECT c.id, c.v FROM c, p1, p2 WHERE c.id NOT IN (p1.id, p2.id) ORDER BY 0.5 * (1 - d / 2) - 0.5 * greatest(list_cosine_similarity(c.v, p1.v), list_cosine_similarity(c.v, p2.v)) DESC, d, c.id LIMIT 1),
 p4 AS (SELECT c.id, c.v FROM c, p1, p2, p3 WHERE c.id NOT IN (p1.id, p2.id, p3.id) ORDER BY 0.5 * (1 - d / 2) - 0.5 * greatest(list_cosine_similarity(c.v, p1.v), list_cosine_similarity(c.v, p2.v), list_cosine_similarity(c.v, p3.v)) DESC, d, c.id LIMIT 1)
 SELECT id, 1 AS rank FROM p1 UNION ALL SELECT id, 2 FROM p2 UNION ALL SELECT id, 3 FROM p3 UNION ALL SELECT id, 4 FROM p4"""
)
def mmr(spark, sf):
    return fusion.mmr(vectors(spark, sf), vector_of(spark, sf, 0), 4)


def _cross_sql(score: str) -> str:
    return f"""WITH d AS (SELECT label::VARCHAR AS collection, vec_id AS id, round(list_cosine_distance(embedding::DOUBLE[], {_Q0}), 6) + 0.0 AS distance FROM embeddings WHERE label < 6),
 r AS (SELECT *, row_number() OVER (PARTITION BY collection ORDER BY distance, id) AS r FROM d) SELECT collection, id, round({score}, 6) + 0.0 AS score FROM r WHERE r <= 10 ORDER BY score DESC, collection, id LIMIT 10"""


def _cross(spark, sf, normalize: bool) -> DataFrame:
    rows = vectors(spark, sf).withColumn("collection", F.col("label").cast("string"))
    found = fusion.cross_collection(rows, vector_of(spark, sf, 0), ["0", "1", "2", "3", "4", "5"], 10, normalize_scores=normalize, digits=6)
    return found.select("collection", "id", (F.col("score") + 0.0).alias("score"))


@query(_cross_sql("1.0::DOUBLE / (1.0 + distance)"))
def cross_collection(spark, sf):
    return _cross(spark, sf, True)


@query(_cross_sql("-distance"))
def cross_collection_raw(spark, sf):
    return _cross(spark, sf, False)


@query("SELECT event_id AS id, round(1 - value / 100, 6) AS dense_similarity, CASE WHEN value <> 1 THEN round(1.0::DOUBLE / (1.0 - value), 6) END AS keyword_similarity FROM events")
def score_transforms(spark, sf):
    dense, sparse = fusion.score_transforms(F.col("value") / 100, -F.col("value"))
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), dense, sparse).select("id", F.round("dense_similarity", 6).alias("dense_similarity"), F.round("keyword_similarity", 6).alias("keyword_similarity"))


# hierarchy: parent = doc_id div 4

_TREE = "(SELECT doc_id AS id, CASE WHEN doc_id > 0 THEN doc_id // 4 END AS parent_id FROM documents)"


def hierarchy(spark, sf) -> DataFrame:
    return documents(spark, sf).select("id", F.when(F.col("id") > 0, F.floor(F.col("id") / 4)).alias("parent_id"))


@query(f"SELECT id, parent_id FROM {_TREE} WHERE parent_id = 5")
def children(spark, sf):
    return tree.children(hierarchy(spark, sf), 5)


@query(f"SELECT p.id, p.parent_id FROM {_TREE} c JOIN {_TREE} p ON c.parent_id = p.id WHERE c.id = 150")
def parent(spark, sf):
    return tree.parent(hierarchy(spark, sf), 150)


def _down_sql(root: int, cap: int) -> str:
    return f"WITH RECURSIVE t AS {_TREE}, w AS (SELECT id, 1 AS depth FROM t WHERE parent_id = {root} UNION ALL SELECT t.id, w.depth + 1 FROM t JOIN w ON t.parent_id = w.id WHERE w.depth < {cap}) SELECT id, depth FROM w"


@query(_down_sql(2, 100))
def descendants(spark, sf):
    return tree.descendants(hierarchy(spark, sf), 2)


@query(_down_sql(0, 2))
def descendants_depth(spark, sf):
    return tree.descendants(hierarchy(spark, sf), 0, 2)


@query(f"WITH RECURSIVE t AS {_TREE}, w AS (SELECT p.id, p.parent_id, 1 AS depth FROM t c JOIN t p ON c.parent_id = p.id WHERE c.id = 190 UNION ALL SELECT t.id, t.parent_id, w.depth + 1 FROM t JOIN w ON t.id = w.parent_id WHERE w.depth < 100) SELECT id, depth FROM w")
def ancestors(spark, sf):
    return tree.ancestors(hierarchy(spark, sf), 190)


@query(f"WITH RECURSIVE t AS {_TREE}, w AS (SELECT id FROM t WHERE parent_id = 2 UNION ALL SELECT t.id FROM t JOIN w ON t.parent_id = w.id) SELECT 2 AS id, 40 AS parent_id, EXISTS (SELECT * FROM w WHERE id = 40) AS cycle")
def cycle_check(spark, sf):
    return spark.createDataFrame([(2, 40, tree.makes_cycle(hierarchy(spark, sf), 2, 40))], "id int, parent_id int, cycle boolean")


@query(f"SELECT id, CASE WHEN id = 150 THEN 7 ELSE parent_id END AS parent_id FROM {_TREE}")
def set_parent(spark, sf):
    return tree.set_parent(hierarchy(spark, sf), 150, 7)[0]


@query(f"SELECT id, CASE WHEN parent_id % 10 = 3 THEN NULL ELSE parent_id END AS parent_id FROM {_TREE} WHERE id % 10 <> 3")
def orphan_children(spark, sf):
    rows = hierarchy(spark, sf)
    return mutate.delete(rows, rows.where("id % 10 = 3").select("id"))


# edges

_EDGES = "(SELECT o_custkey AS src_id, l_partkey AS dst_id, l_returnflag AS kind, sum(l_discount) AS weight, count(*) AS hits, 0.0::DOUBLE AS bonus, max(epoch(o_orderdate)) AS last_touch FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL)"
_EDGE_COLUMNS = "src_id, dst_id, kind, round(weight, 6) AS weight, hits, round(bonus, 6) AS bonus, last_touch"


def edge_table(spark, sf) -> DataFrame:
    joined = table(spark, sf, "orders").join(table(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.groupBy(F.col("o_custkey").alias("src_id"), F.col("l_partkey").alias("dst_id"), F.col("l_returnflag").alias("kind")).agg(F.sum("l_discount").alias("weight"), F.count("*").alias("hits"), F.lit(0.0).alias("bonus"), F.max(F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1e6).alias("last_touch"))


def graph(spark, sf) -> VectorCollection:
    """A collection that holds the edges, made once."""
    from ..sources.scratch import fresh_path

    made = VectorDB(spark, fresh_path(spark, "db")).collection("graph")
    made.store.change(lambda s: s.append("edges", edge_table(spark, sf)))
    return made


def _edge_rows(rows: DataFrame) -> DataFrame:
    return rows.select("src_id", "dst_id", "kind", F.round("weight", 6).alias("weight"), "hits", F.round("bonus", 6).alias("bonus"), "last_touch")


def _new_edges(spark) -> DataFrame:
    return spark.createDataFrame([(-1, -2, "X", 0.5, 3, 0.1, 5.0), (-1, -3, "X", 0.25, 0, 0.0, 6.0)], "src_id long, dst_id long, kind string, weight double, hits long, bonus double, last_touch double")


@query(f"SELECT {_EDGE_COLUMNS} FROM {_EDGES} UNION ALL VALUES (-1, -2, 'X', 0.5, 3, 0.1, 5.0), (-1, -3, 'X', 0.25, 0, 0.0, 6.0)")
def edges_insert(spark, sf):
    return _edge_rows(edges.insert(edge_table(spark, sf), _new_edges(spark)))


@query(f"WITH e AS {_EDGES}, n AS (SELECT src_id, dst_id, kind, weight + 1 AS weight FROM e WHERE src_id % 7 = 0 UNION ALL VALUES (-5, -6, 'X', NULL)) SELECT coalesce(e.src_id, n.src_id) AS src_id, coalesce(e.dst_id, n.dst_id) AS dst_id, coalesce(e.kind, n.kind) AS kind, round(coalesce(n.weight, e.weight, 0), 6) AS weight, coalesce(e.hits, 0) AS hits, round(coalesce(e.bonus, 0), 6) AS bonus, e.last_touch FROM e FULL JOIN n ON e.src_id = n.src_id AND e.dst_id = n.dst_id AND e.kind = n.kind")
def edges_upsert(spark, sf):
    rows = edge_table(spark, sf)
    new = rows.where("src_id % 7 = 0").select(*edges.KEY, (F.col("weight") + 1).alias("weight")).unionByName(spark.createDataFrame([(-5, -6, "X", None)], "src_id long, dst_id long, kind string, weight double"))
    return _edge_rows(edges.upsert(rows, new))


@query(f"WITH e AS {_EDGES} SELECT src_id, dst_id, kind, round(CASE WHEN dst_id % 3 = 0 THEN weight + 0.3 ELSE weight END, 6) AS weight, CAST(CASE WHEN dst_id % 3 = 0 THEN hits + 2 ELSE hits END AS BIGINT) AS hits, round(CASE WHEN dst_id % 3 = 0 THEN 1.5 ELSE bonus END::DOUBLE, 6) AS bonus, last_touch FROM e")
def edges_delta(spark, sf):
    made = graph(spark, sf)
    some = made.store.read("edges").where("dst_id % 3 = 0").select(*edges.KEY)
    changes = some.select("*", F.lit(0.1).alias("dweight"), F.lit(1).alias("dhits"), F.lit(None).cast("double").alias("bonus")).unionByName(some.select("*", F.lit(0.2).alias("dweight"), F.lit(1).alias("dhits"), F.lit(1.5).alias("bonus")))
    made.update_edges(changes)
    return _edge_rows(made.store.read("edges"))


@query(f"SELECT {_EDGE_COLUMNS} FROM {_EDGES} WHERE kind <> 'R' OR src_id % 2 = 0")
def edges_delete(spark, sf):
    rows = edge_table(spark, sf)
    return _edge_rows(edges.delete(rows, rows.where("kind = 'R' AND src_id % 2 = 1")))


@query(f"SELECT {_EDGE_COLUMNS} FROM {_EDGES} WHERE kind = 'A' ORDER BY last_touch DESC, src_id, dst_id LIMIT 50")
def edges_get(spark, sf):
    return _edge_rows(edges.get(edge_table(spark, sf), kind="A", limit=50))


@query(f"SELECT {_EDGE_COLUMNS} FROM {_EDGES} WHERE weight BETWEEN 0.049 AND 0.071 AND hits >= 1")
def edges_filter(spark, sf):
    return _edge_rows(edges.get(edge_table(spark, sf), where={"weight": {"$between": [0.049, 0.071]}, "hits": (">=", 1)}))


@query(f"SELECT {_EDGE_COLUMNS} FROM {_EDGES} WHERE NOT (kind = 'N' AND weight <= 0.055)")
def edges_prune(spark, sf):
    return _edge_rows(edges.prune(edge_table(spark, sf), kind="N", max_weight=0.055))


# change feed, expiry, buffered vectors

def feed(spark, sf) -> DataFrame:
    return table(spark, sf, "events").select(F.col("event_id").alias("seq"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"), F.col("event_type").alias("kind"), F.col("user_id").alias("doc_id"), F.col("props").alias("payload"))


@query("SELECT event_id AS seq, event_type AS kind, user_id AS doc_id FROM events WHERE event_id > 500 AND event_type = 'click' ORDER BY seq LIMIT 200")
def events_read(spark, sf):
    return lifecycle.read_events(feed(spark, sf), 500, "click", 200).select("seq", "kind", "doc_id")


@query("SELECT coalesce(max(event_id), 0) AS last_seq FROM events")
def events_last_seq(spark, sf):
    return lifecycle.last_seq(feed(spark, sf))


@query("SELECT event_id AS seq, event_type AS kind FROM events WHERE event_id >= 700")
def events_prune(spark, sf):
    return lifecycle.prune_events(feed(spark, sf), 700).select("seq", "kind")


@query("SELECT event_type AS kind, count(*) AS n, max(event_id) AS last FROM events GROUP BY 1")
def event_kinds(spark, sf):
    made = library(spark, spark.createDataFrame([], "id long, text string"))
    made.store.change(lambda s: s.append("events", feed(spark, sf)))
    return made.read_events(-1).groupBy("kind").agg(F.count("*").alias("n"), F.max("seq").alias("last"))


@query()
def events_stream(spark, sf):
    from ..sources.scratch import fresh_path

    source, sink, position = (fresh_path(spark, n) for n in ("feed", "tail", "position"))
    feed(spark, sf).write.parquet(source)
    stream = feeds.event_stream(spark, source, "click")
    stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", position).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(sink)


_TTL = f"(SELECT doc_id, {NOW} + ((doc_id * 37) % 1000) - 400 AS expires_at, CASE WHEN doc_id % 3 = 0 THEN 'callback' ELSE 'delete' END AS on_expire FROM documents)"


def expiry(spark, sf) -> DataFrame:
    return documents(spark, sf).select(F.col("id").alias("doc_id"), (F.lit(NOW) + (F.col("id") * 37) % 1000 - 400).alias("expires_at"), F.when(F.col("id") % 3 == 0, "callback").otherwise("delete").alias("on_expire"))


@query(f"SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN {NOW} ELSE expires_at END::DOUBLE AS expires_at, CASE WHEN doc_id % 5 = 0 THEN 'delete' ELSE on_expire END AS on_expire FROM {_TTL}")
def ttl_set(spark, sf):
    rows = expiry(spark, sf)
    return lifecycle.set_ttl(rows, rows.where("doc_id % 5 = 0").select("doc_id", F.lit(NOW).alias("expires_at"), F.lit("delete").alias("on_expire")))


@query(f"SELECT doc_id, expires_at::DOUBLE AS expires_at, on_expire FROM {_TTL} WHERE expires_at <= {NOW} ORDER BY expires_at, doc_id LIMIT 60")
def ttl_expired(spark, sf):
    return lifecycle.expired(expiry(spark, sf), NOW, 60)


@query(f"WITH c AS (SELECT * FROM {_TTL} WHERE expires_at <= {NOW} ORDER BY expires_at, doc_id LIMIT 60) SELECT 'document' AS what, doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM c WHERE on_expire = 'delete') UNION ALL SELECT 'ttl', doc_id FROM {_TTL} WHERE doc_id NOT IN (SELECT doc_id FROM c) UNION ALL SELECT on_expire, doc_id FROM c")
def ttl_sweep(spark, sf):
    docs, left, claimed = lifecycle.sweep(documents(spark, sf).select("id"), expiry(spark, sf), NOW, 60)
    return docs.select(F.lit("document").alias("what"), "id").unionByName(left.select(F.lit("ttl").alias("what"), F.col("doc_id").alias("id"))).unionByName(claimed.select(F.col("on_expire").alias("what"), F.col("doc_id").alias("id")))


_PENDING = "SELECT vec_id + s AS doc_id, vec_id, s::DOUBLE + vec_id / 1000 AS enqueued_at, 'src' || s AS source FROM embeddings, (VALUES (0), (1), (2)) t(s)"


def pending_log(spark, sf) -> DataFrame:
    rows = vectors(spark, sf).withColumn("s", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    again = rows.unionByName(rows.withColumn("s", F.col("s") + 0).where("s = 1"))
    return again.select((F.col("id") + F.col("s")).alias("doc_id"), F.transform("embedding", lambda x: -x).alias("embedding"), F.concat(F.lit("src"), F.col("s").cast("string")).alias("source"), (F.col("s").cast("double") + F.col("id") / 1000).alias("enqueued_at"))


@query(f"SELECT doc_id, arg_max(source, enqueued_at) AS source, round(max(enqueued_at), 6) AS enqueued_at FROM ({_PENDING}) GROUP BY doc_id")
def pending_latest(spark, sf):
    return lifecycle.latest_pending(pending_log(spark, sf)).select("doc_id", "source", F.round("enqueued_at", 6).alias("enqueued_at"))


@query(f"SELECT doc_id, source FROM (SELECT * FROM ({_PENDING}) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY enqueued_at DESC) = 1) WHERE doc_id IN (SELECT vec_id FROM embeddings) ORDER BY enqueued_at, doc_id LIMIT 100")
def pending_list(spark, sf):
    return lifecycle.list_pending(lifecycle.latest_pending(pending_log(spark, sf)), vectors(spark, sf), 100).select("doc_id", "source")


@query(f"WITH p AS (SELECT * FROM ({_PENDING}) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY enqueued_at DESC) = 1) SELECT e.vec_id AS id, round(list_sum(list_transform(coalesce(list_transform(s.embedding, lambda x: -x), e.embedding), lambda x: x::DOUBLE)), 5) + 0.0 AS total FROM embeddings e LEFT JOIN p ON p.doc_id = e.vec_id LEFT JOIN embeddings s ON s.vec_id = p.vec_id")
def pending_flush(spark, sf):
    flushed = lifecycle.flush_pending(vectors(spark, sf), lifecycle.latest_pending(pending_log(spark, sf)))
    return flushed.select("id", (F.round(F.aggregate(V.doubles(F.col("embedding")), F.lit(0.0), lambda a, x: a + x), 5) + 0.0).alias("total"))


@query(f"WITH e AS ({_EACH}), c AS (SELECT i, x FROM e WHERE id = 0) SELECT e.id AS doc_id, CAST(e.i - 1 AS INTEGER) AS i, round(0.75 * e.x + 0.25 * c.x, 6) + 0.0 AS x FROM e JOIN c USING (i)")
def blend_toward(spark, sf):
    blended = lifecycle.blend_toward(vectors(spark, sf), None, F.lit(True), V.literal(vector_of(spark, sf, 0)), 0.25)
    return blended.select("doc_id", F.posexplode("embedding").alias("i", "x")).select("doc_id", "i", (F.round("x", 6) + 0.0).alias("x"))


# writes

@query("SELECT doc_id + 100000000 AS new_id, row_number() OVER (ORDER BY doc_id) + 5000 AS id FROM documents WHERE lang = 'fr'")
def append_assign_ids(spark, sf):
    return mutate.assign_ids(documents(spark, sf).where("lang = 'fr'").select((F.col("id") + 100000000).alias("new_id")), 5000, "new_id").select("new_id", F.col("id").cast("long").alias("id"))


@query("SELECT doc_id AS id, CASE WHEN doc_id % 4 = 0 THEN 'second' ELSE lang END AS lang FROM documents UNION ALL SELECT -doc_id, 'second' FROM documents WHERE doc_id % 4 = 1")
def upsert_docs(spark, sf):
    docs = documents(spark, sf).select("id", "lang")
    new = docs.where("id % 4 = 0").select("id", F.lit("first").alias("lang"), F.lit(0).alias("__seq"))
    new = new.unionByName(docs.where("id % 4 < 2").select(F.when(F.col("id") % 4 == 0, F.col("id")).otherwise(-F.col("id")).alias("id"), F.lit("second").alias("lang"), F.lit(1).alias("__seq")))
    as_rows = lambda rows: rows.select("id", F.col("lang").alias("text"), *(c for c in ("__seq",) if c in rows.columns))
    made = library(spark, as_rows(docs))
    made.add_frame(as_rows(new))
    return made.documents().select("id", F.col("text").alias("lang"))


@query(f"WITH g AS (SELECT doc_id FROM documents WHERE doc_id % 9 = 0), e AS {_EDGES} SELECT 'document' AS what, count(*) AS n FROM documents WHERE doc_id NOT IN (FROM g) UNION ALL SELECT 'edge', count(*) FROM e WHERE src_id NOT IN (FROM g) AND dst_id NOT IN (FROM g) UNION ALL SELECT 'label', count(*) FROM labels WHERE doc_id NOT IN (FROM g)")
def delete_cascade(spark, sf):
    docs = documents(spark, sf)
    gone = docs.where("id % 9 = 0").select("id")
    n = lambda what, rows: rows.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n")
    return n("document", mutate.delete(docs, gone)).unionByName(n("edge", mutate.delete_edges_of(edge_table(spark, sf), gone))).unionByName(n("label", table(spark, sf, "labels").join(gone.withColumnRenamed("id", "doc_id"), "doc_id", "left_anti")))


@query("SELECT doc_id AS id FROM documents WHERE NOT (text IN (SELECT text FROM documents WHERE doc_id < 3) OR lang = 'es')")
def remove_texts(spark, sf):
    docs = documents(spark, sf)
    texts = [r[0] for r in docs.where("id < 3").select("text").collect()]
    return mutate.delete(docs, mutate.matching_ids(docs, texts, F.col("lang") == "es")).select("id")


@query("""SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN '{"a":"' || event_type || '","k":2}' ELSE replace(props, ' ', '') END AS metadata FROM events""")
def metadata_merge(spark, sf):
    rows = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("props").alias("metadata"), "event_type")
    some = rows.where("id % 3 = 0")
    patches = some.select("id", F.lit('{"k": 1, "a": 0}').alias("patch"), F.lit(0).alias("__seq")).unionByName(some.select("id", F.concat(F.lit('{"k": 2, "a": "'), F.col("event_type"), F.lit('"}')).alias("patch"), F.lit(1).alias("__seq")))
    made = library(spark, rows.select("id", "metadata"))
    made.update_metadata(patches)
    return made.documents().select("id", F.to_json(F.parse_json("metadata")).alias("metadata"))


@query(f"SELECT id, CASE WHEN id % 3 = 0 THEN round(CASE WHEN {_NUM} THEN {_VAL} ELSE 0 END + 0.75, 6) ELSE CASE WHEN {_NUM} THEN {_VAL} END END AS value FROM {_ROWS}")
def counter_increment(spark, sf):
    rows = mixed(spark, sf).withColumnRenamed("m", "metadata")
    some = rows.where("id % 3 = 0")
    deltas = some.select("id", F.lit(0.5).alias("delta")).unionByName(some.select("id", F.lit(0.25).alias("delta")))
    made = library(spark, rows.select("id", "metadata"))
    made.increment_frame(deltas, "k")
    return made.documents().select("id", F.round(mutate.counter_value(F.col("metadata"), "k"), 6).alias("value"))


@query("SELECT vec_id AS id, label::BIGINT AS label FROM embeddings")
def assign_cluster_metadata(spark, sf):
    rows = vectors(spark, sf).withColumn("metadata", F.lit("{}"))
    patches = rows.select("id", F.concat(F.lit('{"cluster":'), F.col("label").cast("string"), F.lit("}")).alias("patch"), F.lit(0).alias("__seq"))
    return mutate.update_metadata(rows, patches).select("id", F.get_json_object("metadata", "$.cluster").cast("long").alias("label"))


@query("SELECT count(*) AS n FROM embeddings WHERE embedding IS NOT NULL")
def rebuild_count(spark, sf):
    return spark.createDataFrame([(library(spark, vectors(spark, sf).select("id", "embedding")).rebuild_index(),)], "n long")


@query("SELECT event_id AS id, (event_id >= 5000 OR user_id >= 5000 OR (value * 100 >= 3600 AND event_id >= 1)) AS due FROM events")
def rebuild_trigger(spark, sf):
    due = lifecycle.RebuildPolicy().due(F.col("event_id"), F.col("user_id"), F.col("value") * 100)
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), due.alias("due"))


@query("SELECT batch_num, count(*) AS docs_in_batch, max(r) AS docs_processed FROM (SELECT row_number() OVER (ORDER BY doc_id) AS r, (r - 1) // 64 + 1 AS batch_num FROM documents) GROUP BY batch_num")
def stream_progress(spark, sf):
    return feeds.progress_of(documents(spark, sf), 64)


# clusters; centroids are the labels' means

_MEANS = f"(SELECT label, i, avg(x) AS c FROM (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY label, i)"
_NEAREST = f"(SELECT id, arg_min(label, (d, label)) AS label, min(d) AS distance FROM (SELECT e.id, m.label, round(sum((x - c) ** 2), 6) AS d FROM ({_EACH}) e JOIN {_MEANS} m USING (i) GROUP BY e.id, m.label) GROUP BY id)"


def centroids(spark, sf) -> DataFrame:
    return cluster.mean_vectors(vectors(spark, sf))


@query(f"SELECT id, label::BIGINT AS label, distance FROM {_NEAREST}")
def assign_centroid(spark, sf):
    return cluster.assign(vectors(spark, sf), centroids(spark, sf))


@query(f"SELECT id, label::BIGINT AS label FROM {_NEAREST} WHERE id % 5 <> 0")
def assign_unassigned(spark, sf):
    rows = vectors(spark, sf)
    unassigned = rows.join(rows.where("id % 5 = 0").select("id"), "id", "left_anti")
    return cluster.assign(unassigned, centroids(spark, sf)).select("id", "label")


@query(f"SELECT n.label::BIGINT AS label, CAST(i - 1 AS INTEGER) AS i, round(avg(x), 5) + 0.0 AS x FROM ({_EACH}) e JOIN {_NEAREST} n USING (id) GROUP BY n.label, i")
def lloyd_step(spark, sf):
    return cluster.lloyd_step(vectors(spark, sf), centroids(spark, sf)).select("label", F.posexplode("centroid").alias("i", "x")).select("label", "i", (F.round("x", 5) + 0.0).alias("x"))


@query(f"SELECT round(sum(distance), 3) AS inertia FROM {_NEAREST}")
def inertia(spark, sf):
    return cluster.inertia(vectors(spark, sf), centroids(spark, sf)).select(F.round("inertia", 3).alias("inertia"))


@query("""WITH d AS (SELECT a.vec_id AS id, a.label, b.label AS other, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d, a.vec_id = b.vec_id AS same FROM embeddings a, embeddings b),
 n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label), m AS (SELECT id, d.label, other, sum(CASE WHEN same THEN 0 ELSE d END) / (CASE WHEN d.label = other THEN any_value(n) - 1 ELSE any_value(n) END) AS m FROM d JOIN n ON n.label = other GROUP BY id, d.label, other),
 ab AS (SELECT id, max(CASE WHEN label = other THEN m END) AS a, min(CASE WHEN label <> other THEN m END) AS b FROM m GROUP BY id) SELECT round(avg((b - a) / greatest(a, b)), 5) AS silhouette FROM ab""")
def silhouette(spark, sf):
    return cluster.silhouette(vectors(spark, sf)).select(F.round("silhouette", 5).alias("silhouette"))


@query("SELECT label, count(*) AS n FROM embeddings GROUP BY label")
def cluster_summary(spark, sf):
    return cluster.summary(vectors(spark, sf))


@query("SELECT vec_id AS id FROM embeddings WHERE label = 3")
def cluster_members(spark, sf):
    rows = vectors(spark, sf)
    made = library(spark, rows.select("id", "embedding", F.lit("{}").alias("metadata")))
    made.assign_cluster_metadata(rows.select("id", "label"))
    return made.get_cluster_members(3).select("id")


@query(f"SELECT label::VARCHAR AS name, count(*) AS dim, round(sum(c), 5) + 0.0 AS total FROM {_MEANS} GROUP BY label")
def cluster_store(spark, sf):
    made = library(spark, spark.createDataFrame([], "id long, text string"))
    for row in centroids(spark, sf).collect():
        made.save_cluster(str(row["label"]), [row["centroid"]])
    centroid = F.col("centroids")[0]
    rows = made.store.read("clusters").where(F.col("name").isin(made.list_clusters()))
    return rows.select("name", F.size(centroid).cast("long").alias("dim"), (F.round(F.aggregate(centroid, F.lit(0.0), lambda a, x: a + x), 5) + 0.0).alias("total"))


@query()
def kmeans(spark, sf):
    return cluster.kmeans(vectors(spark, sf), 8, seed=1)[0]


@query()
def minibatch_kmeans(spark, sf):
    return cluster.minibatch_kmeans(vectors(spark, sf), 8)[0]


@query()
def hdbscan(spark, sf):
    return cluster.hdbscan(vectors(spark, sf))


_STOP = ", ".join(f"'{w}'" for w in cluster.STOP_WORDS)
_TFIDF = f"""WITH r AS (SELECT dense_rank() OVER (ORDER BY lang) - 1 AS label, doc_id, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda w: w NOT IN ({_STOP})) AS w FROM documents),
 t AS (SELECT label, doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM r), f AS (SELECT label, doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
 n AS (SELECT label, count(*) AS n FROM r GROUP BY label), v AS (SELECT label, term, n, count(*) AS df, sum(tf) AS total FROM f JOIN n USING (label) GROUP BY ALL HAVING count(*) <= n * 0.95),
 v2 AS (SELECT label, term, ln((1 + n) / (1 + df)) + 1 AS idf FROM v QUALIFY row_number() OVER (PARTITION BY label ORDER BY total DESC, term) <= 100), x AS (SELECT label, doc_id, term, tf * idf AS x FROM f JOIN v2 USING (label, term)),
 m AS (SELECT label, doc_id, sqrt(sum(x * x)) AS norm FROM x GROUP BY ALL), s AS (SELECT label, term, round(sum(x / norm), 6) AS score FROM x JOIN m USING (label, doc_id) GROUP BY ALL),
 b AS (SELECT label, term, row_number() OVER (PARTITION BY label ORDER BY score DESC, term DESC) AS k FROM s QUALIFY k <= 5) SELECT label, string_agg(term, ', ' ORDER BY k) AS tags FROM b GROUP BY label"""


@query(_TFIDF)
def tfidf_keywords(spark, sf):
    from pyspark.sql import Window

    docs = documents(spark, sf)
    labels = docs.select(F.col("lang").alias("l")).distinct().withColumn("label", F.row_number().over(Window.orderBy(F.col("l").asc_nulls_last())).cast("long") - 1)
    labels = F.broadcast(labels) if labels.count() <= cluster.MAX_SENT_TERMS else labels  # else every pass would shuffle the texts
    return cluster.tags(docs.join(labels, F.col("lang").eqNullSafe(F.col("l"))).drop("l"))


@query("SELECT label::BIGINT AS label, count(*) || ' texts' AS tags FROM embeddings JOIN documents ON vec_id = doc_id GROUP BY label")
def auto_tag(spark, sf):
    return cluster.custom_tags(_both(spark, sf), lambda texts: f"{len(texts)} texts")
