"""Exact nearest neighbours, near-duplicate pairs and recall, as DataFrame plans.

Distances are ``1 - cosine`` in double precision; ties go to the smaller uid.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import cosine_distance, matrix, round5

#: Query matrices up to this size are sent to every task; larger query sets are joined in blocks.
SHIP_BYTES = 32 << 20
BLOCK_ROWS = 4096
_HITS = "query_id long, uid long, distance double"


def _units(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n == 0, 1.0, n)


def best(queries: np.ndarray, rows: np.ndarray, uids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` nearest rows of each query by (distance, uid): query index, uid, distance."""
    k = min(k, len(rows))
    if k == 0 or not len(queries):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    away = 1.0 - queries @ rows.T
    if k < len(rows):
        # Everything up to the k-th distance, so that ties at the border are settled by uid and not by place.
        border = np.partition(away, k - 1, axis=1)[:, k - 1 : k]
        q, r = np.nonzero(away <= border)
    else:
        q, r = np.divmod(np.arange(away.size), len(rows))
    order = np.lexsort((uids[r], away[q, r], q))
    q, r = q[order], r[order]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    q, r = q[place < k], r[place < k]
    return q, uids[r], away[q, r]


def _hits(ids: np.ndarray, found: tuple):
    import pyarrow as pa

    q, uids, away = found
    return pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(uids), pa.array(away.astype(np.float64, copy=False))], ["query_id", "uid", "distance"])


def top(hits: DataFrame, k: int) -> DataFrame:
    """``rank`` from 1 by (distance, uid) for each query, up to ``k``."""
    w = Window.partitionBy("query_id").orderBy("distance", "uid")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def knn(rows: DataFrame, queries, k: int = 10, query_ids: list[int] | None = None) -> DataFrame:
    """``query_id, uid, distance, rank`` of the ``k`` nearest of ``rows`` (uid, vector) to each row of a query matrix.

    The matrix travels with the tasks; every batch of rows is compared by one matrix product and only its best ``k``
    leave the task. Filter ``rows`` first: neighbours are found among the rows given.
    """
    q = _units(np.atleast_2d(np.asarray(queries, np.float64)))
    ids = np.arange(len(q)) if query_ids is None else np.asarray(query_ids, np.int64)
    if k <= 0 or not len(q):
        return rows.sparkSession.createDataFrame([], f"{_HITS}, rank int")
    step = max(1, (8 << 20) // max(1, len(q)))

    def compare(batches):
        for b in batches:
            for i in range(0, b.num_rows, step):
                part = b.slice(i, step)
                yield _hits(ids, best(q, _units(matrix(part.column("vector"))), part.column("uid").to_numpy(), k))

    return top(rows.select("uid", "vector").mapInArrow(compare, _HITS), k)


def knn_expr(rows: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """The same from a ``queries`` DataFrame (query_id, vector) with built-in functions only: every query meets every
    row in the JVM. Meant for a handful of queries."""
    pairs = rows.select("uid", "vector").crossJoin(F.broadcast(queries.select("query_id", F.col("vector").alias("q"))))
    return top(pairs.select("query_id", "uid", cosine_distance("q", "vector").alias("distance")), k)


def knn_join(rows: DataFrame, queries: DataFrame, k: int = 10, block_rows: int = BLOCK_ROWS, ship_bytes: int = SHIP_BYTES) -> DataFrame:
    """``knn`` for a ``queries`` DataFrame (query_id, vector) of any size.

    A query set whose counted size is within ``ship_bytes`` is sent to the tasks. A larger one is cut into blocks, as
    are the rows; every pair of blocks is one matrix product of bounded size.
    """
    n, width = queries.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    if not n or k <= 0:
        return rows.sparkSession.createDataFrame([], f"{_HITS}, rank int")
    if n * (width or 1) * 8 <= ship_bytes:
        q = queries.select("query_id", "vector").orderBy("query_id").toArrow()
        return knn(rows, matrix(q.column("vector")), k, q.column("query_id").to_pylist())
    m = rows.count()
    across, down = max(1, -(-n // block_rows)), max(1, -(-m // block_rows))

    def spread(df, key, own, other, other_n):
        mine = F.pmod(F.xxhash64(key), F.lit(down if own == "i" else across)).cast("int")
        return df.select(key, "vector", mine.alias(own), F.explode(F.sequence(F.lit(0), F.lit(other_n - 1))).alias(other))

    left = spread(rows, "uid", "i", "j", across)
    right = spread(queries, "query_id", "j", "i", down)

    def compare(a, b):
        import pyarrow as pa

        if not a.num_rows or not b.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "uid": pa.array([], pa.int64()), "distance": pa.array([], pa.float64())})
        found = best(_units(matrix(b.column("vector"))), _units(matrix(a.column("vector"))), a.column("uid").to_numpy(), k)
        return pa.Table.from_batches([_hits(b.column("query_id").to_numpy(), found)])

    return top(left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(compare, _HITS), k)


def candidate_pairs(rows: DataFrame, threshold: float = 0.15, k: int = 6, id_col: str = "uid") -> DataFrame:
    """Near-duplicate pairs ``a, b, distance``: each row asks for its ``k`` nearest, itself among them; a pair is kept
    once, in the order of ``id_col``, if either side found the other within ``threshold``. Distances have 5 places."""
    found = knn_join(rows, rows.select(F.col("uid").alias("query_id"), "vector"), k)
    found = found.where((F.col("query_id") != F.col("uid")) & (F.col("distance") <= threshold))
    if id_col != "uid":
        names = rows.select(F.col("uid").alias("u"), F.col(id_col).alias("name"))
        found = found.join(names.toDF("query_id", "qn"), "query_id").join(names.toDF("uid", "un"), "uid")
    else:
        found = found.withColumns({"qn": F.col("query_id"), "un": F.col("uid")})
    pairs = found.groupBy(F.least("qn", "un").alias("a"), F.greatest("qn", "un").alias("b")).agg(F.min("distance").alias("distance"))
    return pairs.withColumn("distance", round5(F.col("distance"))).orderBy("distance", "a", "b")


def recall_at_k(found: DataFrame, exact: DataFrame, k: int) -> DataFrame:
    """One row, ``recall``: the mean share of each query's exact ``k`` neighbours that were found."""
    hits = exact.join(found.select("query_id", "uid", F.lit(1).alias("hit")), ["query_id", "uid"], "left")
    each = hits.groupBy("query_id").agg((F.count("hit") / F.least(F.lit(k), F.count(F.lit(1)))).alias("share"))
    return each.agg(F.avg("share").alias("recall"))


def latency_summary(times: DataFrame, column: str = "ms") -> DataFrame:
    """One row with ``p50``, ``p95`` and ``mean`` of a column of latencies."""
    return times.agg(F.percentile(column, 0.5).alias("p50"), F.percentile(column, 0.95).alias("p95"), F.avg(column).alias("mean"))
