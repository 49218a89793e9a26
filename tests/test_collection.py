import dataclasses
import os
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

import vectrill
from vectrill import CollectionNotFoundError, CorruptedMetadataError, DimensionMismatchError, WriteConflictError
from vectrill.schema import Manifest
from vectrill.sources.storage import Store

E = np.eye(8, dtype=np.float32)


@pytest.fixture
def db(spark, tmp_path):
    return vectrill.connect(str(tmp_path / "db"), spark)


def axes(db):
    col = db.collection("axes", dim=8)
    d = np.zeros(8)
    d[:2] = 0.9, 0.1
    col.add(ids=list("abcd"), vectors=[E[0], E[1], E[2], d], documents=[f"doc {c}" for c in "abcd"], metadatas=[{"wing": "letters", "room": c} for c in "abcd"])
    return col


def test_query_get_and_projection(db):
    col = axes(db)
    r = col.query(vector=E[0], k=2)
    assert r.ids == ["a", "d"] and abs(r.distances[0]) < 1e-6 and 0 < r.distances[1] < 1
    assert r.documents == ["doc a", "doc d"] and r.metadatas[0] == {"wing": "letters", "room": "a"} and r.vectors is None
    r = col.query(vector=E[0], k=3, where={"room": {"$ne": "a"}}, include=["vectors", "nonsense"])
    assert r.ids[0] == "d" and r.documents == [] and r.distances == [] and len(r.vectors[0]) == 8
    assert col.query(vector=E[0], k=5, where_document={"$contains": "DOC B"}).ids == ["b"]
    assert col.query(vector=E[0], k=0).ids == [] and col.query(vector=E[0], where={"room": "zz"}).ids == []
    g = col.get(ids=["c", "a", "a"], include=["metadatas"])
    assert g.ids == ["a", "c"] and g.documents == [None, None] and g.metadatas[0]["room"] == "a"
    assert col.get(limit=2, offset=1).ids == ["b", "c"] and col.get(offset=2).ids == list("abcd") and col.get(ids=[]).ids == []
    # ids and $or are both required
    assert col.get(ids=["a"], where={"$or": [{"room": "b"}, {"room": "c"}]}).ids == []
    one, two = col.query_batch(vectors=[E[1], -E[0]], k=2)
    assert one.ids == col.query(vector=E[1], k=2).ids and two.ids == col.query(vector=-E[0], k=2).ids


def test_bad_queries(db):
    col = axes(db)
    for bad, kind in ((E[0][:4], DimensionMismatchError), ([], DimensionMismatchError), ([float("nan")] * 8, ValueError), ([float("inf")] * 8, ValueError), (np.zeros(8), ValueError)):
        with pytest.raises(kind):
            col.query(vector=bad)
        with pytest.raises(kind):
            col.query_batch(vectors=[E[0], bad])
    with pytest.raises(ValueError):
        col.query()
    with pytest.raises(ValueError):
        col.query(text="x", vector=E[0])
    empty = db.collection("empty")
    assert [r.ids for r in empty.query_batch(vectors=[E[0], E[1]])] == [[], []] and empty.query(vector=E[0]).ids == []


def test_writes(db):
    col = axes(db)
    with pytest.raises(ValueError):
        col.add(ids=["z", "a"], vectors=[E[3], E[4]])
    with pytest.raises(ValueError):
        col.upsert(ids=["y", "y"], vectors=[E[3], E[4]])
    with pytest.raises(ValueError):
        col.add(ids=["y"], vectors=[[float("nan")] * 8])
    with pytest.raises(ValueError):
        col.add(ids=["y"], vectors=[E[3]], documents=["1", "2"])
    with pytest.raises(DimensionMismatchError):
        col.add(ids=["y"], vectors=[np.ones(16)])
    assert col.count() == 4
    gen = col.store_gen
    col.add(ids=[], vectors=[])
    assert col.store_gen == gen
    col.upsert(ids=["b", "e"], vectors=[E[5] * 3, E[6]], metadatas=[{"n": 1}, None])
    assert col.get().ids == list("abcde")
    g = col.get(ids=["b"], include=["documents", "metadatas", "vectors"])
    assert g.documents == [""] and g.metadatas == [{"n": 1}] and np.allclose(g.vectors[0], E[5])
    assert col.get(ids=["e"]).metadatas == [{}] and col.meta_get("next_uid") == 5
    assert col.query(vector=E[5], k=1).ids == ["b"]


def test_updates(db):
    col = axes(db)
    col.update_metadata(ids=["a", "c"], metadatas=[{"k": 1}, None])
    assert col.get(ids=["a", "b", "c"]).metadatas == [{"k": 1}, {"wing": "letters", "room": "b"}, {}]
    col.update_documents(ids=["a"], documents=["new"])
    assert col.get(ids=["a"]).documents == ["new"] and col.query(vector=E[0], k=1).ids == ["a"]
    for call in (lambda: col.update_metadata(ids=["a", "zz"], metadatas=[{}, {}]), lambda: col.update_documents(ids=["zz"], documents=["x"])):
        with pytest.raises(ValueError):
            call()
    assert col.get(ids=["a"]).metadatas == [{"k": 1}]


def test_delete_and_clear(db):
    col = axes(db)
    gen = col.store_gen
    col.delete(ids=[], where={"room": "a"})
    col.delete(where={"room": "zz"})
    assert col.store_gen == gen and col.count() == 4
    col.delete(ids=["a"])
    col.delete(where={"room": "b"})
    assert col.get().ids == ["c", "d"]
    col.add(ids=["a"], vectors=[E[7]])
    assert col.get().ids == ["c", "d", "a"]
    col.delete()
    assert col.count() == 0
    col.clear()
    col.add(ids=["q"], vectors=[E[0]])
    col.clear()
    col.add(ids=["r"], vectors=[E[0]])
    assert col.count() == 1 and col.dim == 8 and col.meta_get("next_uid") == 7


def test_compact_flush_health_vacuum(db):
    col = axes(db)
    col.upsert(ids=["a"], vectors=[E[3]])
    assert col.health().ok and not col.health().coherent
    before = col.fingerprint().first()
    col.compact()
    assert col.fingerprint().first() == before and len(col.meta_get("segments")) == 1
    col.flush()
    h = col.health()
    assert h.ok and h.coherent and h.doc_count == 4 and h.store_gen == h.index_gen
    assert col.query(vector=E[3], k=1, approximate=True).ids == ["a"]
    assert col.vacuum(keep=1, older_than=0) > 0 and col.get().ids == list("abcd")


def test_catalog(db, tmp_path, monkeypatch, spark):
    assert db.list_collections() == []
    axes(db)
    db.collection("other-1")
    assert db.list_collections() == ["axes", "other-1"]
    for bad in ("/etc/passwd", "../x", "a b", "a.b", "a/b", "a\\b", "", "x" * 129):
        with pytest.raises(ValueError):
            db.collection(bad)
    with pytest.raises(CollectionNotFoundError):
        db.collection("none", create=False)
    with pytest.raises(FileNotFoundError):
        db.ensure_collection("none")
    with pytest.raises(ValueError):
        db.collection("axes", dim=16)
    assert db.collection("axes") is db.collection("axes", dim=8)
    handle = db.collection("axes")
    db.delete_collection("axes")
    assert db.list_collections() == ["other-1"]
    for call in (handle.count, handle.get, lambda: handle.query(vector=E[0]), lambda: handle.add(ids=["n"], vectors=[E[0]])):
        with pytest.raises(CollectionNotFoundError):
            call()
    monkeypatch.chdir(tmp_path)
    moved = vectrill.connect("rel", spark)
    os.mkdir(tmp_path / "else")
    monkeypatch.chdir(tmp_path / "else")
    assert moved.path == str(tmp_path / "rel")
    with db, db.collection("other-1") as c:
        c.add(ids=["x"], vectors=[E[0]])
    assert c.health().coherent


def test_options(db):
    for kind, kw in ((ValueError, {"metric": "l2"}), (DimensionMismatchError, {"dim": 12}), (DimensionMismatchError, {"dim": 1 << 15}), (ValueError, {"dim": 8, "bit_width": 5})):
        with pytest.raises(kind):
            db.collection("opts", **kw)


def test_manifest_checks():
    good = Manifest(dim=8, next_uid=1).dump()
    assert Manifest.load(good).dim == 8
    for bad in (good.replace('"schema_version": 1', '"schema_version": 2'), good.replace('"next_uid": 1', '"next_uid": "x"'), good.replace('"dim": 8', '"dim": null'), "{"):
        with pytest.raises(CorruptedMetadataError):
            Manifest.load(bad)


def test_two_writers_lose_nothing(db, spark):
    col = db.collection("race", dim=8)
    failed = []

    def work(prefix):
        try:
            mine = vectrill.connect(db.path, spark).collection("race")
            for i in range(3):
                mine.add(ids=[f"{prefix}{i}"], vectors=[E[i]])
        except Exception as e:
            failed.append(e)

    threads = [threading.Thread(target=work, args=(p,)) for p in "xy"]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not failed and sorted(col.get().ids) == ["x0", "x1", "x2", "y0", "y1", "y2"] and col.meta_get("next_uid") == 6


def test_conflicts_and_crashes(db, spark):
    col = axes(db)
    store = Store(spark, col.path, lock_timeout=0.1)
    stale = store.load()
    assert store.commit(Manifest(**{**stale.__dict__, "store_gen": stale.store_gen + 1}))
    with pytest.raises(WriteConflictError):
        store.update(lambda m: Manifest(**{**m.__dict__, "store_gen": stale.store_gen + 1}))
    # A crash before the commit leaves files that nothing refers to.
    store.write(spark.range(3).selectExpr("id as uid"), "segments")
    assert col.count() == 4 and col.vacuum(older_than=0) == 1 and col.count() == 4


def test_frames_and_stream(db, spark, tmp_path):
    col = db.collection("frames")
    rows = [(f"i{i}", f"text {i}", '{"n":%d}' % i, np.random.default_rng(i).standard_normal(8).tolist(), i) for i in range(50)]
    df = spark.createDataFrame(rows, "id string, document string, metadata string, vector array<float>, at long")
    col.add_frame(df.repartition(5), "at")
    assert col.count() == 50 and col.get(limit=3).ids == ["i0", "i1", "i2"]
    with pytest.raises(ValueError):
        col.add_frame(df.limit(1), "at")
    with pytest.raises(ValueError):
        col.add_frame(df.limit(1).withColumn("id", df["id"] * 0 if False else df["document"]).union(df.limit(1).withColumn("id", df["document"])), "at")
    late = spark.createDataFrame([("i1", "old", "{}", [1.0] * 8, 1), ("i1", "newest", "{}", [2.0] + [0.0] * 7, 2), ("n", "n", "{}", [1.0] * 8, 3)], df.schema)
    col.upsert_frame(late, "at")
    assert col.count() == 51 and col.get(ids=["i1"]).documents == ["newest"] and col.get().ids[-1] == "n"
    hits = col.query_frame(np.array([rows[9][3]]), 2).orderBy("rank").collect()
    assert hits[0].id == "i9" and hits[0].distance < 1e-6
    late.write.parquet(str(tmp_path / "in"))
    from vectrill.streaming.ingest import stream_upsert

    target = db.collection("streamed")
    stream_upsert(spark.readStream.schema(late.schema).parquet(str(tmp_path / "in")), target, str(tmp_path / "ck"), "at").awaitTermination()
    assert sorted(target.get().ids) == ["i1", "n"] and target.get(ids=["i1"]).documents == ["newest"]


def test_vacuum_leaves_a_write_under_way_alone(db):
    """Files written but not yet committed survive a vacuum; a commit of files that are gone is worked out again."""
    col = db.collection("busy", dim=8)
    col.add(ids=["a"], vectors=[[1.0] + [0.0] * 7])
    store, tries = col._store, []

    def change(current):
        tries.append(store.write(col.frame().withColumn("uid", F.lit(current.next_uid)).withColumn("id", F.lit("b")), "segments"))
        if len(tries) == 1:
            col.vacuum(keep=1)
        elif len(tries) == 2:
            col.vacuum(keep=1, older_than=0)
        return col._next(current, tries[-1], None, next_uid=current.next_uid + 1)

    store.update(change)
    assert len(tries) == 1 and sorted(col.get().ids) == ["a", "b"]
    tries.append("")
    del tries[1:]

    def again(current):
        path = store.write(col.frame().where("id = 'b'").withColumn("uid", F.lit(current.next_uid)).withColumn("id", F.lit("c")), "segments")
        tries.append(path)
        if len(tries) == 2:
            col.vacuum(keep=1, older_than=0)
        return col._next(current, path, None, next_uid=current.next_uid + 1)

    store.update(again)
    assert len(tries) == 3 and sorted(col.get().ids) == ["a", "b", "c"]


def test_stored_codes_serve_filters_and_deletes(db):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((300, 16))
    col = db.collection("coded", dim=16)
    col.add(ids=[f"i{i}" for i in range(200)], vectors=x[:200].tolist(), metadatas=[{"k": i % 3} for i in range(200)])
    col.flush()
    col.upsert(ids=[f"i{i}" for i in range(150, 300)], vectors=x[150:].tolist(), metadatas=[{"k": i % 3} for i in range(150, 300)])
    col.delete(ids=["i7", "i8"])
    col.flush()
    assert col.health().coherent and col._store.codes(col._store.load()).count() == 298
    for where in (None, {"k": 1}):
        want = col.query(vector=x[10].tolist(), k=5, where=where).ids
        assert col.query(vector=x[10].tolist(), k=5, where=where, approximate=True).ids == want
    now = col._store.load()
    wrong = col._store.write(col._store.codes(now).where("uid > 5"), "codes")
    segment = now.segments[0][0]
    col._store.commit(dataclasses.replace(now, store_gen=now.store_gen + 1, index_gen=now.store_gen + 1, codes=now.codes | {segment: wrong}))
    assert not col.health().coherent


def test_update_frame(db, spark):
    col = db.collection("frames", dim=8)
    col.add(ids=["a", "b"], documents=["x", "y"], vectors=[[1.0] + [0.0] * 7] * 2)
    col.update_frame(spark.createDataFrame([("b", "z", '{"n":1}')], "id string, document string, metadata string"))
    got = col.get()
    assert got.documents == ["x", "z"] and got.metadatas == [{}, {"n": 1}] and got.ids == ["a", "b"]
    for bad in ([("c", "z")], [("a", "1"), ("a", "2")]):
        with pytest.raises(ValueError):
            col.update_frame(spark.createDataFrame(bad, "id string, document string"))


def test_flush_merges_small_segments(db, monkeypatch):
    monkeypatch.setattr("vectrill.collection.SMALL_SEGMENTS", 3)
    col = db.collection("many", dim=8)
    for i in range(3):
        col.add(ids=[f"n{i}"], vectors=[E[i]])
    col.upsert(ids=["n0"], vectors=[E[3]])
    col.delete(ids=["n1"])
    old = col.get(include=["vectors"])
    col.flush()
    now = col._store.load()
    assert len(now.segments) == 1 and now.deletes == [] and now.index_gen == now.store_gen and col.health().coherent
    assert col.get(include=["vectors"]).ids == old.ids and np.array_equal(old.vectors, col.get(include=["vectors"]).vectors)
    monkeypatch.setattr("vectrill.collection.SMALL_BYTES", 0)
    for i in range(4):
        col.add(ids=[f"m{i}"], vectors=[E[i]])
    col.flush()
    assert len(col._store.load().segments) == 5 and col.query(vector=E[3], k=2).ids == ["n0", "m3"]
    monkeypatch.undo()
    monkeypatch.setattr("vectrill.collection.SMALL_SEGMENTS", 3)
    col.delete()
    col.flush()
    assert col.count() == 0 and len(col._store.load().segments) == 1 and col.health().ok
