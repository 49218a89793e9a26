import numpy as np
import pytest
from pyspark.sql import functions as F

from vectrill import candidate_pairs, knn, knn_join, l2_normalize, recall_at_k
from vectrill.operators import quantize, search


@pytest.fixture(scope="module")
def data(spark):
    x = np.random.default_rng(0).standard_normal((400, 16)).astype(np.float32)
    x[7] = x[3] = x[11]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "uid long, vector array<float>").repartition(3).cache()
    return x, rows


def brute(x, q, k):
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    d = 1 - (q / np.linalg.norm(q, axis=1, keepdims=True)) @ u.T
    return [[int(i) for i in np.lexsort((np.arange(len(x)), np.round(row, 12)))[:k]] for row in d]


def lists(df, n):
    out = [[] for _ in range(n)]
    for r in df.orderBy("query_id", "rank").collect():
        out[r.query_id].append(r.uid)
    return out


def test_knn_is_exact_and_breaks_ties_by_uid(data):
    x, rows = data
    q = x[:30].astype(np.float64)
    got = lists(knn(rows, q, 5), 30)
    assert got == brute(x, q, 5)
    assert got[3][:3] == [3, 7, 11]
    assert lists(knn(rows, q[:1], 1000), 1)[0].__len__() == 400
    assert knn(rows, q, 0).count() == 0


def test_knn_join_in_blocks_agrees(spark, data):
    x, rows = data
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x[:50])], "query_id long, vector array<float>")
    want = brute(x, x[:50].astype(np.float64), 4)
    assert lists(knn_join(rows, queries, 4, block_rows=37, ship_bytes=0), 50) == want
    assert lists(knn_join(rows, queries, 4), 50) == want
    assert lists(search.knn_expr(rows, queries.where("query_id < 3"), 4), 3) == want[:3]


def test_pairs(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((10, 8))
    x[5], x[6] = x[0], x[1]
    names = "abcdefghij"
    rows = spark.createDataFrame([(i, names[i], v.tolist()) for i, v in enumerate(x)], "uid long, id string, vector array<float>")
    pairs = candidate_pairs(rows, 1.0, 6, "id").collect()
    assert [(r.a, r.b) for r in pairs[:2]] == [("a", "f"), ("b", "g")]
    assert len({(r.a, r.b) for r in pairs}) == len(pairs) and all(r.a < r.b and r.distance <= 1 for r in pairs)
    assert [r.distance for r in pairs] == sorted(r.distance for r in pairs)


@pytest.mark.parametrize("bits,least", [(4, 0.99), (3, 0.97), (2, 0.8)])
def test_quantized_recall(data, bits, least):
    x, rows = data
    q = x[:40].astype(np.float64)
    exact = knn(rows, q, 10)
    assert recall_at_k(quantize.knn_quantized(rows, q, 10, bits), exact, 10).first()[0] >= least


@pytest.mark.parametrize("bits", [4, 2])
def test_quantized_search_is_exact(spark, bits):
    """Far more near copies than any pool holds, whose codes hardly differ; vectors without direction; codes without angles."""
    rng = np.random.default_rng(6)
    base = rng.standard_normal((20, 64))
    x = np.concatenate([base[i % 20] + 0.05 * rng.standard_normal((1, 64)) for i in range(4000)] + [np.zeros((2, 64)), base[:3], base[:3]]).astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "uid long, vector array<float>").repartition(3)
    q = x[:30].astype(np.float64)
    want = lists(knn(rows, q, 10), 30)
    assert lists(quantize.knn_quantized(rows, q, 10, bits), 30) == want
    assert lists(quantize.knn_quantized(rows, q, 10, bits, pool=50), 30) != want
    bare = quantize.codes(rows, bits).withColumn("angle", F.lit(None).cast("double"))
    assert lists(quantize.knn_quantized(rows, q, 10, bits, coded=bare), 30) == want
    found, share = quantize.possible(quantize.codes(rows.where("uid < 4000"), bits), q, 10, bits)
    assert abs(found.count() / (4000 * 30) - share) < 1e-9 and share < 0.06
    few = rows.where("uid < 4")
    assert lists(quantize.knn_quantized(few, q, 10, bits), 30) == lists(knn(few, q, 10), 30)
    assert quantize.knn_quantized(few.limit(0), q, 10, bits).count() == 0


def test_codes_do_not_depend_on_company():
    x = np.random.default_rng(2).standard_normal((50, 24))
    assert (quantize.encode(x, 4)[10] == quantize.encode(x[10:11], 4)[0]).all()
    assert quantize.encode(x, 3).shape == (50, 32 * 3 // 8)


def test_normalize():
    out = l2_normalize([[3.0, 4.0], [0.0, 0.0]])
    assert out.dtype == np.float32 and np.allclose(out, [[0.6, 0.8], [0, 0]])
    assert l2_normalize([3.0, 4.0]).shape == (1, 2)
    with pytest.raises(ValueError):
        l2_normalize(np.zeros((1, 1, 1)))
