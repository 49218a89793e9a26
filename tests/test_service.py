import json
import threading
import urllib.error
import urllib.request

import numpy as np
import pytest

import vectrill
from vectrill import cli
from vectrill.service import MAX_BODY, Handles, Operations, Service


@pytest.fixture
def operations(spark):
    return Operations(Handles(open_database=lambda p: vectrill.connect(p, spark)))


def test_operations(operations, tmp_path):
    at = {"db_path": str(tmp_path / "db"), "collection": "c"}
    assert operations.count(at) == {"count": 0} and operations.clear(at) == {"count": 0} and operations.candidate_pairs(at) == {"pairs": []}
    assert not (tmp_path / "db" / "c").exists()
    rng = np.random.default_rng(0)
    x = rng.standard_normal((4, 8)).tolist()
    items = [{"id": n, "vector": v, "title": n.upper(), "type": "t"} for n, v in zip("abcd", [x[0], x[1], x[0], x[2]], strict=True)]
    assert operations.upsert(at | {"items": []}) == {"count": 0}
    assert operations.upsert(at | {"items": [*items, items[0] | {"title": "last"}]}) == {"count": 4}
    (pair,) = operations.candidate_pairs(at | {"threshold": 0.01})["pairs"]
    assert pair == {"a": "a", "b": "c", "distance": 0.0, "a_title": "last", "b_title": "C", "a_type": "t", "b_type": "t"}
    assert operations.clear(at) == {"count": 0} and operations.count(at) == {"count": 0}


def test_http(operations, tmp_path):
    server = Service(("127.0.0.1", 0), operations, workers=2)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_address[1]}"

    def call(path, body=None, headers=None):
        data = body if body is None or isinstance(body, bytes) else json.dumps(body).encode()
        try:
            with urllib.request.urlopen(urllib.request.Request(base + path, data, headers or {})) as r:
                return r.status, json.loads(r.read())
        except urllib.error.HTTPError as e:
            return e.code, json.loads(e.read())

    try:
        at = {"db_path": str(tmp_path / "db"), "collection": "c"}
        assert call("/health") == (200, {"status": "ok"}) and call("/ready")[0] == 200
        assert set(operations.routes) <= set(call("/openapi.json")[1]["paths"])
        assert call("/v1/upsert", at | {"items": [{"id": "a", "vector": [1.0] * 8}]}) == (200, {"count": 1})
        for _ in range(5):
            assert call("/v1/count", at) == (200, {"count": 1})
        assert call("/v1/upsert", at | {"items": [{"id": "b", "vector": [1.0] * 16}]})[0] == 400
        assert call("/v1/nothing", {})[0] == 404 and call("/nothing")[0] == 404
        assert call("/v1/count", b"{")[0] == 400 and call("/v1/count", {"db_path": "x"})[1]["error"]["code"] == "MISSING_FIELD"
    finally:
        server.shutdown()
        server.server_close()
    assert operations.post("/v1/count", MAX_BODY + 1, None)[0] == 413 and operations.post("/v1/count", -1, None)[0] == 400


def test_cli(tmp_path, capsys, spark):
    at = ["--db", str(tmp_path / "db"), "--collection", "c"]
    one, two = ",".join(["1"] + ["0"] * 7), ",".join(["0", "1"] + ["0"] * 6)
    cli.main(["add", *at, "--id", "a", "--vector", one, "--document", "first", "--metadata", '{"n":1}'])
    cli.main(["add", *at, "--id", "b", "--vector", two])
    capsys.readouterr()
    cli.main(["count", *at])
    assert json.loads(capsys.readouterr().out) == {"count": 2}
    cli.main(["query", *at, "--vector", one, "--k", "1", "--where", '{"n":1}'])
    (hit,) = json.loads(capsys.readouterr().out)
    assert hit["id"] == "a" and hit["document"] == "first" and hit["metadata"] == {"n": 1} and abs(hit["score"]) < 1e-6
