"""Registered queries of the collection engine, each with the SQL it must agree with.

Collections are written from the driver's whole tables into the shared folder: vectors are ``embeddings`` (id = vec_id,
metadata ``{"label": ...}``), texts are ``documents`` (id = doc_id, whole texts, metadata lang, source, n_chars, embedded by a
toy function). Queries and changes go through ``Collection``. The filter language is shown on plain rows as well: events
carry their ``props`` as metadata.
"""

from __future__ import annotations

import functools
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..collection import Collection
from ..functions.numbering import number_rows
from ..functions.vectors import cosine_distance, dot, matrix, normalize, round5
from ..operators import filters, quantize, search
from ..sources.storage import Store, shared_folder

#: Queries of a search: every vector whose id is divisible by this.
EVERY = 100
K = 10
PAIR_DISTANCE = 0.8


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    e = _table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("uid"), F.to_json(F.struct("label")).alias("metadata"), F.col("embedding").alias("vector"))


def texts(spark: SparkSession, sf: str) -> DataFrame:
    d = _table(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("uid"), F.col("text").alias("document"), F.to_json(F.struct("lang", "source", "n_chars")).alias("metadata"))


def events(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "events").select(F.col("event_id").alias("uid"), F.col("props").alias("metadata"))


def _toy_embedder(texts_):
    """Width 8: the length of the text, and ones."""
    return np.array([[len(t), 1, 1, 1, 1, 1, 1, 1] for t in texts_], np.float32)


def _other_embedder(texts_):
    """Width 16: one more than the length, and twos."""
    return np.array([[len(t) + 1, *[2] * 15] for t in texts_], np.float32)


_WRITTEN: dict[tuple, str] = {}


def _stored(spark: SparkSession, sf: str, kind: str, fork: bool = False) -> Collection:
    """The collection of all ``vectors`` or ``texts``, written once a session and table folder. A change works on a fork:
    a new collection whose first generation names the same immutable segments."""
    key = (spark.sparkContext.applicationId, sf, kind)
    embedder = _toy_embedder if kind == "texts" else None
    if key not in _WRITTEN:
        path = f"{shared_folder(spark)}/catalog-{uuid.uuid4().hex}/{kind}"
        col = Collection(spark, path, embedder=embedder)
        rows = texts(spark, sf) if kind == "texts" else vectors(spark, sf)
        col.add_frame(rows.withColumn("id", F.col("uid").cast("string")), order="uid")
        col.flush()
        _WRITTEN[key] = path
    if not fork:
        return Collection(spark, _WRITTEN[key], embedder=embedder)
    path = f"{_WRITTEN[key]}-{uuid.uuid4().hex}"
    Store(spark, path).commit(Store(spark, _WRITTEN[key]).load())
    return Collection(spark, path, embedder=embedder)


def _query_matrix(spark: SparkSession, sf: str) -> tuple[np.ndarray, list[int]]:
    q = vectors(spark, sf).where(F.col("uid") % EVERY == 0).select("uid", "vector").orderBy("uid").toArrow()
    return matrix(q.column("vector")), q.column("uid").to_pylist()


def _shown(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", F.col("rank").cast("long").alias("rank"), "uid", round5(F.col("distance")).alias("distance"))


def _knn(spark, sf, where=None, approximate=False) -> DataFrame:
    q, ids = _query_matrix(spark, sf)
    hits = _stored(spark, sf, "vectors").query_frame(q, K, where=where, approximate=approximate)
    names = F.array(*[F.lit(i) for i in ids])
    return _shown(hits.withColumns({"query_id": F.get(names, F.col("query_id").cast("int")), "uid": F.col("id").cast("long")}))


def q_knn(spark, sf):
    return _knn(spark, sf)


def q_knn_expr(spark, sf):
    rows = vectors(spark, sf)
    return _shown(search.knn_expr(rows, rows.where(F.col("uid") % EVERY == 0).select(F.col("uid").alias("query_id"), "vector"), K))


def q_knn_join(spark, sf):
    """All vectors against all vectors, in blocks."""
    rows = vectors(spark, sf)
    return _shown(search.knn_join(rows, rows.select(F.col("uid").alias("query_id"), "vector"), 3, block_rows=1024, ship_bytes=0))


def q_knn_filter(spark, sf):
    return _knn(spark, sf, {"label": 3})


def q_knn_in(spark, sf):
    return _knn(spark, sf, {"label": {"$in": [1, 2, 7]}})


def q_knn_doc(spark, sf):
    docs = texts(spark, sf)
    rows = vectors(spark, sf)
    q, ids = _query_matrix(spark, sf)
    kept = docs.where(filters.compile_where_document({"$contains": "the"})).select("uid")
    return _shown(search.knn(rows.join(kept, "uid"), q, K, ids))


def q_knn_quantized(spark, sf):
    return _knn(spark, sf, approximate=True)


def q_knn_quantized_filter(spark, sf):
    return _knn(spark, sf, {"label": {"$gte": 5}}, approximate=True)


def q_recall(spark, sf):
    """How many of the true neighbours of all queries the codes found."""
    exact, found = _knn(spark, sf), _knn(spark, sf, approximate=True)
    hits = exact.select("query_id", "uid").join(found.select("query_id", "uid", F.lit(1).alias("hit")), ["query_id", "uid"], "left")
    return hits.agg(F.count(F.lit(1)).alias("n_true"), F.count("hit").alias("n_found"))


def q_pairs(spark, sf):
    return search.candidate_pairs(vectors(spark, sf), PAIR_DISTANCE, 6)


def _as_rows(spark, found) -> DataFrame:
    return spark.createDataFrame(list(zip(found.ids, found.documents, strict=True)), "id string, document string")


def q_get_page(spark, sf):
    return _as_rows(spark, _stored(spark, sf, "texts").get(limit=50, offset=20))


def q_get_ids(spark, sf):
    return _as_rows(spark, _stored(spark, sf, "texts").get(ids=["3", "17", "5", "3", "no such id"]))


def q_get_where(spark, sf):
    return _as_rows(spark, _stored(spark, sf, "texts").get(ids=[str(i) for i in range(0, 200, 2)], where={"lang": "en"}, where_document={"$contains": "The"}))


def _filtered(where, spark, sf):
    return events(spark, sf).where(filters.compile_where(where)).select("uid")


def _filtered_texts(where, spark, sf):
    return texts(spark, sf).where(filters.compile_where(where)).select("uid")


#: Filters on the events' one field, with what they mean in SQL.
EVENT_FILTERS = {
    "q_filter_eq": ({"k": 7}, "k = 7"),
    "q_filter_ne": ({"k": {"$ne": 7}}, "k <> 7"),
    "q_filter_gt": ({"k": {"$gt": 50}}, "k > 50"),
    "q_filter_gte": ({"k": {"$gte": 50}}, "k >= 50"),
    "q_filter_lt": ({"k": {"$lt": 10.5}}, "k < 10.5"),
    "q_filter_lte": ({"k": {"$lte": 10}}, "k <= 10"),
    "q_filter_in": ({"k": {"$in": [1, 2, 3, "4"]}}, "k in (1, 2, 3)"),
    "q_filter_nin": ({"k": {"$nin": [1, 2, 3, "4"]}}, "k not in (1, 2, 3)"),
}
#: Filters on the documents' fields.
TEXT_FILTERS = {
    "q_filter_and": ({"$and": [{"lang": "en"}, {"n_chars": {"$gt": 1000}}]}, "lang = 'en' and n_chars > 1000"),
    "q_filter_or": ({"$or": [{"lang": "fr"}, {}, {"n_chars": {"$lte": 100}}]}, "lang = 'fr' or n_chars <= 100"),
    "q_filter_nested": ({"$and": [{"$or": [{"lang": "de"}, {"lang": "es"}]}, {"source": {"$ne": "src0"}}]}, "lang in ('de', 'es') and source <> 'src0'"),
    "q_filter_implicit_and": ({"lang": "en", "source": "src0"}, "lang = 'en' and source = 'src0'"),
    "q_filter_cross_type": ({"lang": {"$gt": 5}}, "lang is not null"),
}


def q_filter_missing(spark, sf):
    rows = events(spark, sf)
    none = rows.where(filters.compile_where({"absent": {"$ne": 1}})).agg(F.count(F.lit(1)).alias("n_ne"))
    also = rows.where(filters.compile_where({"absent": {"$nin": [1]}})).agg(F.count(F.lit(1)).alias("n_nin"))
    return none.crossJoin(also)


def _contains(needle, spark, sf):
    return texts(spark, sf).where(filters.compile_where_document({"$contains": needle})).select("uid")


def q_count(spark, sf):
    return spark.createDataFrame([(_stored(spark, sf, "texts").count(),)], "n long")


def q_norm(spark, sf):
    unit = vectors(spark, sf).select("uid", normalize(F.transform("vector", lambda x: x * 3)).alias("v"))
    return unit.select("uid", F.round(F.sqrt(dot("v", "v")), 5).alias("norm"), F.round(F.get("v", F.lit(0)), 4).alias("first"))


def q_distance(spark, sf):
    rows = vectors(spark, sf)
    first = rows.where("uid = 0").select(F.col("vector").alias("q"))
    return rows.crossJoin(F.broadcast(first)).select("uid", round5(cosine_distance("vector", "q")).alias("distance"))


def _fresh(spark, sf) -> DataFrame:
    """Every document again, under another id."""
    return texts(spark, sf).select("uid", F.concat(F.lit("n"), "uid").alias("id"), F.concat(F.lit("new "), "document").alias("document"))


def _half(spark, sf) -> DataFrame:
    """Every document with another text: even ones under their own id, odd ones under another."""
    d = _fresh(spark, sf)
    return d.withColumn("id", F.when(F.col("uid") % 2 == 0, F.col("uid").cast("string")).otherwise(F.col("id")))


def _held(col: Collection) -> DataFrame:
    return col.frame().select("uid", "id", "document")


def q_add(spark, sf):
    col = _stored(spark, sf, "texts", fork=True)
    col.add_frame(_fresh(spark, sf), order="uid")
    return _held(col)


def q_upsert(spark, sf):
    col = _stored(spark, sf, "texts", fork=True)
    col.upsert_frame(_half(spark, sf), order="uid")
    return _held(col)


def q_upsert_dedup(spark, sf):
    """Every id twice in a batch: the last one counts."""
    col = _stored(spark, sf, "texts", fork=True)
    batch = _half(spark, sf)
    col.upsert_frame(batch.union(batch.select(F.col("uid") + (1 << 40), "id", F.concat(F.lit("last "), "document"))), order="uid")
    return _held(col)


def q_delete_where(spark, sf):
    col = _stored(spark, sf, "texts", fork=True)
    col.delete(where={"lang": "en"})
    return col.frame().select("uid")


def q_delete_ids(spark, sf):
    col = _stored(spark, sf, "texts", fork=True)
    col.delete(ids=["1", "2", "3"])
    return col.frame().select("uid")


def q_clear(spark, sf):
    """Cleared and filled again: none of the old rows is left, and numbering goes on."""
    col = _stored(spark, sf, "texts", fork=True)
    col.clear()
    col.add_frame(_fresh(spark, sf), order="uid")
    return _held(col)


def q_update_metadata(spark, sf):
    col = _stored(spark, sf, "texts", fork=True)
    col.update_frame(texts(spark, sf).where("uid % 3 = 0").select(F.col("uid").cast("string").alias("id"), F.lit('{"seen":1}').alias("metadata")))
    return col.frame().select("uid", "metadata")


def q_update_document(spark, sf):
    col = _stored(spark, sf, "texts", fork=True)
    col.update_frame(texts(spark, sf).where("uid % 5 = 0").select(F.col("uid").cast("string").alias("id"), F.lit("changed").alias("document")))
    return _held(col)


def q_uid_alloc(spark, sf):
    return number_rows(texts(spark, sf).select(F.col("uid").alias("ordinal")), ["ordinal"], 1000, "new_uid")


def q_reembed(spark, sf):
    """Another embedder and width over all texts; every tenth was emptied before and is dropped."""
    col = _stored(spark, sf, "texts", fork=True)
    col.update_frame(texts(spark, sf).where("uid % 10 = 0").select(F.col("uid").cast("string").alias("id"), F.lit("").alias("document")))
    col.reembed(_other_embedder, skip_empty="drop")
    return col.frame().select("uid", F.size("vector").cast("long").alias("width"), F.round(F.get("vector", F.lit(0)).cast("double"), 4).alias("first"))


def q_health(spark, sf):
    """Of a collection with replaced and deleted rows whose codes are up to date."""
    col = _stored(spark, sf, "texts", fork=True)
    col.upsert_frame(_half(spark, sf), order="uid")
    col.delete(ids=["0"])
    stale = col.health().coherent
    col.flush()
    h = col.health()
    return spark.createDataFrame([(h.doc_count, h.ok, h.quick_check, stale, h.coherent)], "n long, ok boolean, quick_check string, coherent_before boolean, coherent boolean")


def q_fingerprint(spark, sf):
    return quantize.fingerprint(vectors(spark, sf))


def queries() -> dict:
    plain = (
        q_knn, q_knn_expr, q_knn_join, q_knn_filter, q_knn_in, q_knn_doc, q_knn_quantized, q_knn_quantized_filter, q_recall, q_pairs, q_get_page, q_get_ids, q_get_where, q_filter_missing,
        q_count, q_norm, q_distance, q_add, q_upsert, q_upsert_dedup, q_delete_where, q_delete_ids, q_clear, q_update_metadata, q_update_document, q_uid_alloc, q_reembed, q_health, q_fingerprint,
    )
    out = {f.__name__: f for f in plain}
    out |= {name: functools.partial(_filtered, where) for name, (where, _) in EVENT_FILTERS.items()}
    out |= {name: functools.partial(_filtered_texts, where) for name, (where, _) in TEXT_FILTERS.items()}
    return out | {"q_doc_contains": functools.partial(_contains, "The"), "q_doc_contains_escape": functools.partial(_contains, "%")}


_DIST = "round(1 - list_cosine_similarity(q.embedding::double[], e.embedding::double[]), 5) + 0.0"
_FOLD = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


#: Vectors as a collection holds them: at length 1 in single precision.
_UNIT = "(select vec_id, label, list_transform(embedding::double[], lambda x: (x / sqrt(list_dot_product(embedding::double[], embedding::double[])))::float) as embedding from embeddings)"


def _knn_sql(rows: str = "embeddings", where: str = "true", queries: str = f"vec_id % {EVERY} = 0", k: int = K) -> str:
    return f"""
select query_id, rank, uid, distance from (
  select q.vec_id as query_id, e.vec_id as uid, {_DIST} as distance,
    row_number() over (partition by q.vec_id order by 1 - list_cosine_similarity(q.embedding::double[], e.embedding::double[]), e.vec_id) as rank
  from (select * from embeddings where {queries}) as q cross join (select * from {rows} where {where}) as e
) where rank <= {k}"""


_RANKED = "(select doc_id, text, row_number() over (order by doc_id) - 1 as r, count(*) over () as n from documents)"


def _upserted(text: str) -> str:
    """Even documents replaced in place, odd ones added after all others, in their order."""
    return f"""
select r as uid, doc_id::varchar as id, case when doc_id % 2 = 0 then {text} else coalesce(text, '') end as document from {_RANKED}
union all select n + row_number() over (order by doc_id) - 1, 'n' || doc_id, {text} from {_RANKED} where doc_id % 2 <> 0"""


def oracle_sql() -> dict[str, str]:
    contains = f"(select e.* from embeddings e join documents d on d.doc_id = e.vec_id where contains({_FOLD}, 'the'))"
    out = {
        "q_knn": _knn_sql(_UNIT),
        "q_knn_expr": _knn_sql(),
        "q_knn_join": _knn_sql(queries="true", k=3),
        "q_knn_filter": _knn_sql(_UNIT, "label = 3"),
        "q_knn_in": _knn_sql(_UNIT, "label in (1, 2, 7)"),
        "q_knn_doc": _knn_sql(rows=contains),
        "q_knn_quantized": _knn_sql(_UNIT),
        "q_knn_quantized_filter": _knn_sql(_UNIT, "label >= 5"),
        "q_recall": f"select count(*) as n_true, count(*) as n_found from ({_knn_sql()})",
        "q_pairs": f"""
with near as ({_knn_sql(queries="true", k=6)})
select least(query_id, uid) as a, greatest(query_id, uid) as b, min(distance) as distance from near where query_id <> uid and distance <= {PAIR_DISTANCE} group by 1, 2""",
        "q_get_page": "select doc_id::varchar as id, text as document from documents order by doc_id limit 50 offset 20",
        "q_get_ids": "select doc_id::varchar as id, text as document from documents where doc_id in (3, 17, 5)",
        "q_get_where": f"select doc_id::varchar as id, text as document from documents where doc_id < 200 and doc_id % 2 = 0 and lang = 'en' and contains({_FOLD}, 'the')",
        "q_filter_missing": "select 0::bigint as n_ne, 0::bigint as n_nin",
        "q_doc_contains": f"select doc_id as uid from documents where contains({_FOLD}, 'the')",
        "q_doc_contains_escape": "select doc_id as uid from documents where contains(text, '%')",
        "q_count": "select count(*) as n from documents",
        "q_norm": "select vec_id as uid, round(sqrt(list_dot_product(v, v)), 5) as norm, round(v[1], 4) as first from (select vec_id, list_transform(embedding::double[], lambda x: x / sqrt(list_dot_product(embedding::double[], embedding::double[]))) as v from embeddings)",
        "q_distance": f"select e.vec_id as uid, {_DIST} as distance from embeddings e cross join (select * from embeddings where vec_id = 0) as q",
        "q_add": f"select r as uid, doc_id::varchar as id, coalesce(text, '') as document from {_RANKED} union all select n + r, 'n' || doc_id, 'new ' || text from {_RANKED}",
        "q_upsert": _upserted("'new ' || text"),
        "q_upsert_dedup": _upserted("'last new ' || text"),
        "q_delete_where": "select doc_id as uid from documents where lang <> 'en'",
        "q_delete_ids": "select doc_id as uid from documents where doc_id not in (1, 2, 3)",
        "q_clear": f"select n + r as uid, 'n' || doc_id as id, 'new ' || text as document from {_RANKED}",
        "q_update_metadata": """select doc_id as uid, case when doc_id % 3 = 0 then '{"seen":1}' else '{"lang":"' || lang || '","source":"' || source || '","n_chars":' || n_chars || '}' end as metadata from documents""",
        "q_update_document": "select doc_id as uid, doc_id::varchar as id, case when doc_id % 5 = 0 then 'changed' else text end as document from documents",
        "q_uid_alloc": "select doc_id as ordinal, 999 + row_number() over (order by doc_id) as new_uid from documents",
        "q_reembed": "select doc_id as uid, 16::bigint as width, round((n / sqrt(n * n + 60))::float::double, 4) as first from (select doc_id, length(text)::double + 1 as n from documents where doc_id % 10 <> 0 and text <> '')",
        "q_health": "select count(*) + count(*) filter (where doc_id % 2 <> 0) - 1 as n, true as ok, 'ok' as quick_check, false as coherent_before, true as coherent from documents",
    }
    k = "(select event_id as uid, cast(json_extract(props, '$.k') as double) as k from events)"
    out |= {name: f"select uid from {k} where {sql}" for name, (_, sql) in EVENT_FILTERS.items()}
    return out | {name: f"select doc_id as uid from documents where {sql}" for name, (_, sql) in TEXT_FILTERS.items()}
