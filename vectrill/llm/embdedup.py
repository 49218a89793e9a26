"""Embedding near-dedup on a robust-pruned flat graph.

Equal vectors are collapsed. Centroids fitted on a bounded sample deal the others to their nearest clusters, several
each, so neighbouring shards overlap; a shard over the size limit is dealt into pairs of blocks. Each shard builds a
graph of pruned neighbour lists, the lists of a vector are united over its shards, and every member is searched for
from its shard's medoid: greedily until the beam settles, then on through everything in range. Pairs count as links
only after an exact check in double precision. Links join vectors into components; within a component all pairs are
counted in blocks, so numbers of links are exact for what was found. A brute-force audit of a sample measures recall
and, if it is short, the overlap is doubled.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import matrix
from ._common import arrow_map, connected_components, cut, only

SAMPLE = 20_000
SHARD = 1_500
BLOCK = 3_000
DEGREE = 24
BEAM = 24
ALPHA = 1.2
AUDIT = 200
TARGET_RECALL = 0.98


def _unit_rows(column) -> np.ndarray:
    x = matrix(column)
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n == 0, 1.0, n)


def centroids(sample: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """Spherical k-means from evenly spaced rows of the sample."""
    c = sample[np.linspace(0, len(sample) - 1, k).astype(int)]
    for _ in range(rounds):
        own = np.argmax(sample @ c.T, axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, sample)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), c)
    return c


def pruned_graph(x: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA, pool: int = 48) -> np.ndarray:
    """Neighbour lists (-1: none). A candidate stays unless one already chosen is ``alpha`` times nearer to it than the
    node is; freed places go to the node that was pruned from the others' lists (reverse edges)."""
    n = len(x)
    pool = min(pool, n - 1)
    out = np.full((n, degree), -1, np.int64)
    if pool < 1:
        return out
    for a in range(0, n, 512):
        sims = x[a : a + 512] @ x.T
        sims[np.arange(len(sims)), np.arange(a, a + len(sims))] = -2
        near = np.argpartition(-sims, pool - 1, axis=1)[:, :pool]
        s = np.take_along_axis(sims, near, 1)
        order = np.argsort(-s, axis=1, kind="stable")
        near, s = np.take_along_axis(near, order, 1), np.take_along_axis(s, order, 1)
        far = 2 - 2 * s
        v = x[near]
        between = 2 - 2 * np.einsum("nkd,njd->nkj", v, v)
        alive = np.ones(near.shape, bool)
        rows = np.arange(len(near))
        for r in range(degree):
            some = alive.any(axis=1)
            if not some.any():
                break
            pick = np.argmax(alive, axis=1)
            out[a + rows[some], r] = near[rows[some], pick[some]]
            alive &= ~(alpha * between[rows, pick] <= far)
            alive[rows, pick] = False
    used = (out >= 0).sum(axis=1)
    source, target = np.nonzero(out >= 0)[0], out[out >= 0]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    place = np.arange(len(target)) - np.searchsorted(target, target) + used[target]
    fits = place < degree
    out[target[fits], place[fits]] = source[fits]
    return out


def _merge_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest label over links, in place of a loop of unions."""
    while True:
        low = np.minimum(labels[a], labels[b])
        new = labels.copy()
        np.minimum.at(new, labels[a], low)
        np.minimum.at(new, labels[b], low)
        new = new[new]
        new = new[new[labels]]
        if (new == labels).all():
            return labels
        labels = new


def search(x: np.ndarray, lists: np.ndarray, threshold: float, beam: int = BEAM) -> np.ndarray:
    """Component labels of the rows of ``x`` under the links found.

    All rows are searched for at once. Greedy phase: from the medoid, each query expands the best node of its beam that
    it hasn't, until none is left. Range phase: the neighbours of every node in range of a query are tried too, as long
    as they aren't in the query's group already.
    """
    n = len(x)
    labels = np.arange(n)
    if n < 2:
        return labels
    medoid = int(np.argmax(x @ x.mean(axis=0)))
    beam = min(beam, n)
    low = x.astype(np.float32)
    queries = np.arange(n)
    ids = np.full((n, beam), -1, np.int64)
    sims = np.full((n, beam), -2.0, np.float32)
    opened = np.zeros((n, beam), bool)
    ids[:, 0], sims[:, 0] = medoid, low @ low[medoid]
    found_a, found_b = [], []
    active = queries
    while len(active):
        closed = np.where((ids[active] >= 0) & ~opened[active], sims[active], -3)
        best = np.argmax(closed, axis=1)
        going = closed[np.arange(len(active)), best] > -3
        active, best = active[going], best[going]
        if not len(active):
            break
        opened[active, best] = True
        nodes = lists[ids[active, best]]
        ok = (nodes >= 0) & ~(nodes[:, :, None] == ids[active][:, None, :]).any(axis=2)
        s = np.einsum("qrd,qd->qr", low[np.maximum(nodes, 0)], low[active])
        s[~ok] = -2
        hit = ok & (s >= threshold - 1e-3) & (nodes != active[:, None])
        if hit.any():
            q, r = np.nonzero(hit)
            found_a.append(active[q])
            found_b.append(nodes[q, r])
        all_ids = np.concatenate([ids[active], np.where(ok, nodes, -1)], axis=1)
        all_sims = np.concatenate([sims[active], s], axis=1)
        all_open = np.concatenate([opened[active], np.zeros(s.shape, bool)], axis=1)
        top = np.argsort(-all_sims, axis=1, kind="stable")[:, :beam]
        ids[active], sims[active], opened[active] = np.take_along_axis(all_ids, top, 1), np.take_along_axis(all_sims, top, 1), np.take_along_axis(all_open, top, 1)
    q, k = np.nonzero((ids >= 0) & (sims >= threshold - 1e-3) & (ids != queries[:, None]))
    found_a.append(q)
    found_b.append(ids[q, k])
    q, k = np.nonzero(lists >= 0)
    found_a.append(q)
    found_b.append(lists[q, k])
    a, b = _checked(x, np.concatenate(found_a), np.concatenate(found_b), threshold)
    while len(a):
        labels = _merge_labels(labels, a, b)
        a, b = np.concatenate([a, b]), np.concatenate([b, a])
        next_a, next_b = np.repeat(a, lists.shape[1]), lists[b].ravel()
        ok = next_b >= 0
        ok[ok] = labels[next_a[ok]] != labels[next_b[ok]]
        a, b = _checked(x, next_a[ok], next_b[ok], threshold)
    return labels


def _checked(x: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs whose cosine in double precision reaches the threshold."""
    pairs = np.unique(np.minimum(a, b) * len(x) + np.maximum(a, b))
    a, b = pairs // len(x), pairs % len(x)
    keep = np.zeros(len(a), bool)
    for i in range(0, len(a), 1 << 15):
        keep[i : i + (1 << 15)] = (x[a[i : i + (1 << 15)]] * x[b[i : i + (1 << 15)]]).sum(axis=1) >= threshold
    keep &= a != b
    return a[keep], b[keep]


def usable(v):
    """A vector that can be compared: not null, all components finite numbers, not all zero."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return v.isNotNull() & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, overlap: int = 2, sample: int = SAMPLE, shard_rows: int = SHARD, block_rows: int = BLOCK, target_recall: float = TARGET_RECALL, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` and ``audit_recall``, one row for each row of the input.

    A null, zero or non-finite vector links with nothing and is its own component; so is a vector of another width
    than the first. Equal vectors are linked. Centroids and the audit use bounded samples (``sample`` and 200 vectors,
    by the smallest hash of the id, and 200 more that have links); every vector is indexed, searched for and counted. ``audit_recall`` is the share of
    the audited vectors' links, by comparison with all vectors, that was found; the overlap is doubled up to 16 while it is below ``target_recall``. Null ids don't name a component
    unless it has no other. An empty table gives an empty table.
    """
    rows = only(vectors, vec_id=id_col, v=vector_col).withColumn("good", usable(F.col("v")))
    width = rows.where("good").select(F.min(F.struct(F.xxhash64("vec_id"), F.size("v").alias("w")))["w"]).first()[0]
    rows = rows.withColumn("good", F.col("good") & F.coalesce(F.size("v") == F.lit(width), F.lit(False)))
    marked = rows.withColumn("key", F.when(F.col("good"), F.xxhash64(F.transform("v", lambda x: x + F.lit(0).cast("float")))))
    # Two vectors with one 64-bit key are told apart by a second hash.
    marked = cut(marked.withColumn("key2", F.when(F.col("good"), F.hash("v"))).select("vec_id", "v", "key", "key2"))
    points = marked.where("key is not null").groupBy("key", "key2").agg(F.min("vec_id").alias("low_id"), F.count(F.lit(1)).alias("times"), F.first("v").alias("v"))
    points = cut(points.withColumn("id", F.xxhash64("key", "key2")))
    n = points.count()
    table = points.orderBy(F.xxhash64("id"), "id").limit(min(sample, n)).select("id", "v").toArrow()
    drawn = table.column("id").to_numpy(), _unit_rows(table.column("v"))
    while True:
        found = _components(points, n, drawn, threshold, overlap, shard_rows, block_rows)
        # Links are rare: vectors that have some are audited besides vectors drawn from all.
        linked = found.where(F.col("links") >= F.col("times")).orderBy(F.xxhash64("id"), "id").limit(AUDIT).select("id").join(points.select("id", "v"), "id").toArrow()
        ids = np.concatenate([drawn[0][:AUDIT], linked.column("id").to_numpy()])
        ids, first = np.unique(ids, return_index=True)
        x = np.concatenate([drawn[1][:AUDIT], _unit_rows(linked.column("v"))])[first] if linked.num_rows else drawn[1][:AUDIT][first]
        recall = _audit(points, found, ids, x, threshold)
        if recall >= target_recall or overlap >= 16:
            break
        overlap *= 2
    lowest = found.groupBy("root").agg(F.min("low_id").alias("component_id"))
    named = found.join(lowest, "root").select("key", "key2", F.col("links").alias("n_links"), "component_id")
    single = marked.where("key is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = marked.where("key is not null").join(named, ["key", "key2"]).select("vec_id", "n_links", "component_id").union(single)
    return out.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"), F.lit(recall).alias("audit_recall"))


def _components(points: DataFrame, n: int, drawn: tuple, threshold: float, overlap: int, shard_rows: int, block_rows: int) -> DataFrame:
    """``points`` with ``root`` (a component's point) and ``links`` (other rows linked directly)."""
    import pyarrow as pa

    k = max(1, min(n // shard_rows, len(drawn[0]) // 4))
    centres = centroids(drawn[1], k) if len(drawn[0]) else np.zeros((1, 1))
    spread = min(overlap, k)

    def deal(b, centres):
        x = _unit_rows(b.column("v"))
        near = np.zeros((len(x), spread), np.int32)
        for a in range(0, len(x), 1024):
            away = -(x[a : a + 1024] @ centres.T)
            near[a : a + 1024] = np.argpartition(away, spread - 1, axis=1)[:, :spread]
        row = pa.array(np.repeat(np.arange(len(x)), spread))
        yield pa.RecordBatch.from_arrays([b.column("id").take(row), b.column("v").take(row), pa.array(near.ravel())], ["id", "v", "cluster"])

    dealt = cut(arrow_map(points.select("id", "v"), deal, "id long, v array<float>, cluster int", centres))
    sizes = dealt.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("id", F.lit("block")), "blocks").cast("int")
    # Every pair of blocks of a large cluster is a shard, so each member meets all others.
    shards = dealt.join(sizes, "cluster").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    shards = shards.select("id", "v", "cluster", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    where = ["cluster", "i", "j"]

    def in_order(table):
        ids = table.column("id").to_numpy()
        order = np.argsort(ids)
        return ids[order], _unit_rows(table.column("v"))[order], order

    def build(table):
        ids, x, _ = in_order(table)
        lists = pruned_graph(x)
        ends = np.concatenate([[0], np.cumsum((lists >= 0).sum(axis=1))]).astype(np.int32)
        return pa.table({"id": pa.array(ids), "near": pa.ListArray.from_arrays(pa.array(ends), pa.array(ids[lists[lists >= 0]]))})

    lists = shards.groupBy(*where).applyInArrow(build, "id long, near array<long>")
    united = lists.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))

    def find(table):
        ids, x, order = in_order(table)
        near = table.column("near").combine_chunks().take(pa.array(order))
        size = near.value_lengths().to_numpy()
        flat = near.flatten().to_numpy()
        at = np.minimum(np.searchsorted(ids, flat), len(ids) - 1)
        inside = ids[at] == flat
        row = np.repeat(np.arange(len(ids)), size)[inside]
        at = at[inside]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        graph = np.full((len(ids), int(place.max()) + 1 if len(place) else 1), -1, np.int64)
        graph[row, place] = at
        labels = search(x, graph, threshold)
        some = labels != np.arange(len(ids))
        return pa.table({"a": pa.array(ids[some]), "b": pa.array(ids[labels[some]])})

    links = shards.join(united, "id").groupBy(*where).applyInArrow(find, "a long, b long")
    parts = cut(connected_components(links).withColumnRenamed("node", "id"))
    # Count the links of each component's members exactly, a pair of blocks at a time.
    members = points.select("id", "v", "times").join(parts, "id")
    sized = parts.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("blocks"))
    members = members.join(sized, "component").withColumn("own", F.pmod(F.xxhash64("id", F.lit("count")), "blocks").cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    # Small components share a task's group.
    members = members.withColumn("bin", F.when(F.col("blocks") == 1, F.pmod("component", F.lit(max(64, n // 500)))).otherwise(F.col("component")))
    members = members.select("bin", "component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "v", "times")

    def count(table):
        component = table.column("component").to_numpy()
        order = np.argsort(component, kind="stable")
        x, ids = _unit_rows(table.column("v")), table.column("id").to_numpy()
        times, own = table.column("times").to_numpy().astype(np.float64), table.column("own").to_numpy()
        crossed = table.column("i")[0].as_py() != table.column("j")[0].as_py()
        near = np.zeros(len(ids), np.int64)
        for g in np.split(order, np.nonzero(np.diff(component[order]))[0] + 1):
            for a in range(0, len(g), 512):
                here = g[a : a + 512]
                close = (x[here] @ x[g].T) >= threshold
                close[np.arange(len(here)), np.arange(a, a + len(here))] = True
                if crossed:
                    close &= own[here][:, None] != own[g][None, :]
                near[here] = close @ times[g]
        return pa.table({"id": pa.array(ids), "near": pa.array(near)})

    counted = members.groupBy("bin", "i", "j").applyInArrow(count, "id long, near long").groupBy("id").agg((F.sum("near") - 1).alias("links"))
    joined = points.drop("v").join(parts, "id", "left").join(counted, "id", "left")
    return cut(joined.select("id", "key", "key2", "low_id", "times", F.coalesce("component", "id").alias("root"), F.coalesce("links", F.col("times") - 1).alias("links")))


def _audit(points: DataFrame, found: DataFrame, ids: np.ndarray, x: np.ndarray, threshold: float) -> float:
    """Links of the drawn points that were found, of all that a comparison with every point finds."""
    import pyarrow as pa

    if not len(ids):
        return 1.0

    def compare(b):
        close = (x @ _unit_rows(b.column("v")).T) >= threshold
        close |= ids[:, None] == b.column("id").to_numpy()[None, :]
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array((close @ b.column("times").to_numpy().astype(np.float64)).astype(np.int64))], ["id", "near"])

    there = dict(map(tuple, arrow_map(points.select("id", "v", "times"), compare, "id long, near long").groupBy("id").agg(F.sum("near") - 1).collect()))
    mine = dict(map(tuple, found.where(F.col("id").isin(ids.tolist())).select("id", "links").collect()))
    total = sum(there.values())
    return sum(min(mine[i], there[i]) for i in there) / total if total else 1.0
