import numpy as np
import pytest

import vectrill
from vectrill import DimensionMismatchError, EmbedderIdentityMismatchError, EmbedderMismatchError, EmbedderRequiredError
from vectrill.operators.embed import identity_of


def _toy(width, name):
    def embed(texts):
        out = np.zeros((len(texts), width), np.float32)
        for i, t in enumerate(texts):
            out[i, 0 if "alpha" in t else 1] = 1
        return out

    embed.__name__ = name
    return embed


small, other, wide = _toy(8, "small"), _toy(8, "other"), _toy(16, "wide")


@pytest.fixture
def db(spark, tmp_path):
    return vectrill.connect(str(tmp_path / "db"), spark)


def test_text_round_trip_and_identity(db, spark):
    col = db.collection("c", embedder=small)
    col.add(ids=["a", "b"], documents=["alpha one", "beta"])
    r = col.query(text="alpha", k=1)
    assert r.ids == ["a"] and abs(r.distances[0]) < 1e-6 and col.embedder_identity == "small"
    again = vectrill.connect(db.path, spark).collection("c", embedder=other)
    with pytest.raises(EmbedderIdentityMismatchError, match="small.*other"):
        again.query(text="x")
    with pytest.raises(EmbedderIdentityMismatchError):
        again.add(ids=["z"], documents=["x"])
    again.add(ids=["z"], vectors=[np.ones(8)])
    bare = vectrill.connect(db.path, spark).collection("c")
    with pytest.raises(EmbedderRequiredError):
        bare.query(text="x")
    with pytest.raises(EmbedderRequiredError):
        bare.add(ids=["y"], documents=["x"])


def test_rows_without_identity_refuse_text(db, spark):
    db.collection("raw").add(ids=["a"], vectors=[np.ones(8)], documents=["alpha"])
    col = vectrill.connect(db.path, spark).collection("raw", embedder=small)
    with pytest.raises(EmbedderMismatchError):
        col.upsert(ids=["b"], documents=["x"])
    col.reembed(small)
    col.upsert(ids=["b"], documents=["x"])
    assert col.count() == 2


def test_identity_names():
    class Kind:
        _embedder_identity = "mine"

    class Plain:
        pass

    assert identity_of(Kind()) == "mine" and identity_of(small) == "small" and identity_of(Plain()).endswith("Plain") and identity_of(None) is None
    k = Kind()
    k._embedder_identity = lambda: "called"
    assert identity_of(k) == "called"


def test_bad_embedders(db):
    with pytest.raises(ValueError):
        db.collection("x", embedder=lambda t: np.ones((1, 8))).add(ids=["a", "b"], documents=["1", "2"])
    with pytest.raises(ValueError):
        db.collection("y", embedder=lambda t: np.full((len(t), 8), np.nan)).add(ids=["a"], documents=["1"])
    with pytest.raises(DimensionMismatchError):
        db.collection("z", embedder=lambda t: np.ones((len(t), 5))).add(ids=["a"], documents=["1"])


def test_reembed(db):
    col = db.collection("r", embedder=small)
    col.add(ids=["a", "b", "c"], documents=["alpha", "", "beta"])
    with pytest.raises(ValueError):
        col.reembed(wide)
    with pytest.raises(ValueError):
        col.reembed(wide, skip_empty="keep")
    with pytest.raises(DimensionMismatchError):
        col.reembed(_toy(5, "five"), skip_empty="drop")
    with pytest.raises(RuntimeError):
        col.reembed(wide, skip_empty="drop", on_progress=_stop)
    assert col.count() == 3 and col.dim == 8 and col.embedder_identity == "small"
    kept = col.reembed(other, skip_empty="keep")
    assert (kept.total_docs, kept.skipped, kept.new_dim) == (3, 1, 8) and col.count() == 3 and col.embedder_identity == "other"
    seen = []
    report = col.reembed(wide, skip_empty="drop", bit_width=3, on_progress=lambda done, total: seen.append((done, total)))
    assert (report.total_docs, report.old_dim, report.new_dim, report.skipped) == (3, 8, 16, 1)
    assert col.get().ids == ["a", "c"] and col.dim == 16 and col.bit_width == 3 and seen == [(0, 3), (3, 3)]
    assert col.query(text="alpha", k=1).ids == ["a"]
    empty = db.collection("none", embedder=small)
    assert empty.reembed(other).total_docs == 0 and empty.embedder_identity == "small"


def _stop(done, total):
    raise RuntimeError("enough")


def test_reembed_stops_between_batches(db, spark):
    col = db.collection("steps", embedder=small)
    col.add(ids=[f"r{i}" for i in range(7)], documents=["" if i == 3 else f"text {i}" for i in range(7)])
    col.delete(ids=["r0"])
    before, seen = col.get(include=["vectors"]).vectors, []

    def stop_late(done, total):
        seen.append((done, total))
        if done >= 3:
            raise KeyError("stop")

    with pytest.raises(KeyError):
        col.reembed(wide, batch_size=2, skip_empty="drop", on_progress=stop_late)
    assert seen[0] == (0, 6) and 3 <= seen[-1][0] < 6 and col.dim == 8
    assert np.array_equal(before, col.get(include=["vectors"]).vectors)
    assert set(col._store.files.names(f"{col.path}/segments")) == {p.rsplit("/", 1)[1] for p, _ in col._store.load().segments}
    seen.clear()
    col.reembed(other, batch_size=2, skip_empty="keep", on_progress=lambda done, total: seen.append((done, total)))
    assert seen[-1] == (6, 6) and [d for d, _ in seen] == sorted({d for d, _ in seen}) and len(seen) == 4
    assert col.get().ids == [f"r{i}" for i in range(1, 7)] and col.embedder_identity == "other"


def test_embedding_a_frame(db, spark):
    col = db.collection("f", embedder=small)
    col.add_frame(spark.createDataFrame([("a", "alpha"), ("b", "beta")], "id string, document string"))
    assert col.query(text="alpha", k=1).ids == ["a"]
