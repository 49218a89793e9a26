"""Sharding by histogram sort.

Rows are ordered by a 64-bit key whose high half hashes the text and whose low half hashes the id, so equal texts stand
together and a group too large for a shard is still cut between its rows. Splitters are found by counting: each round,
every partition counts the exact bytes and rows below a sorted list of candidate boundaries, the sums are compared with
the targets, and the intervals that still hold a target are probed again, until every splitter is within tolerance or
no row is left between its bounds. Only then are the rows exchanged, once.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import arrow_map, cut, only

TOP = 1 << 64


def _counted(keys: DataFrame, probes: list[int]) -> tuple[list[int], list[int]]:
    """Exact bytes and rows below each probe; a partition sends one row a probe interval that it has rows in."""

    def batch(b, bounds):
        import pyarrow as pa

        at = np.searchsorted(bounds, b.column("key").to_numpy().view(np.uint64), side="right")
        size = np.bincount(at, b.column("size").to_numpy().astype(np.float64), len(bounds) + 1)
        rows = np.bincount(at, minlength=len(bounds) + 1)
        some = np.nonzero(rows)[0]
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(size[some].astype(np.int64)), pa.array(rows[some].astype(np.int64))], ["slot", "size", "n"])

    sums = arrow_map(keys.select("key", "size"), batch, "slot int, size long, n long", np.array(probes, np.uint64)).groupBy("slot").agg(F.sum("size"), F.sum("n")).collect()
    size, rows = np.zeros(len(probes) + 1, object), np.zeros(len(probes) + 1, object)
    for slot, s, n in sums:
        size[slot], rows[slot] = s, n
    return list(np.cumsum(size)), list(np.cumsum(rows))


def splitters(keys: DataFrame, n_shards: int, tolerance: float = 0.002, probes_each: int = 48, snap: float = 0.01) -> tuple[list[int], list[tuple[int, int, int]]]:
    """Boundaries between ``n_shards`` shards of near equal bytes, and every ``(key, bytes below, rows below)`` counted.

    A boundary is within ``tolerance`` of a shard's share of its target, or there is at most one row between it and the
    target; to keep equal texts together it may be off by ``snap`` of a share. The driver holds ``(n_shards - 1) * probes_each`` numbers a round, whatever the input.
    """
    size, rows = _counted(keys, [TOP - 1])
    total, n = size[-1], rows[-1]
    goals = [total * i / n_shards for i in range(1, n_shards)]
    slack = tolerance * total / n_shards
    known = {0: (0, 0), TOP: (total, n)}
    low, high = [0] * len(goals), [TOP] * len(goals)

    def settled(i: int) -> bool:
        a, b = known[low[i]], known[high[i]]
        return goals[i] - a[0] <= slack or b[0] - goals[i] <= slack or b[1] - a[1] <= 1 or high[i] - low[i] <= 1

    while open_ := [i for i in range(len(goals)) if not settled(i)]:
        spans = sorted({(low[i], high[i]) for i in open_})
        each = max(probes_each, probes_each * len(goals) // len(spans))
        probes = sorted({a + (b - a) * k // (each + 1) for a, b in spans for k in range(1, each + 1)} - known.keys())
        size, rows = _counted(keys, probes)
        known |= {p: (size[k], rows[k]) for k, p in enumerate(probes)}
        order = sorted(known)
        below = [known[k][0] for k in order]
        for i in open_:
            at = max(1, int(np.searchsorted(np.array(below, np.float64), goals[i], side="left")))
            low[i], high[i] = order[at - 1], order[min(at, len(order) - 1)]
    chosen = [low[i] if goals[i] - known[low[i]][0] <= known[high[i]][0] - goals[i] else high[i] for i in range(len(goals))]
    # A boundary inside a group of equal texts (one high half) moves to the group's nearer end if sizes stay near equal.
    ends = {c: [x for x in (c >> 32 << 32, (c >> 32) + 1 << 32) if x < TOP] for c in chosen}
    if probes := sorted({x for xs in ends.values() for x in xs} - known.keys()):
        size, rows = _counted(keys, probes)
        known |= {p: (size[k], rows[k]) for k, p in enumerate(probes)}
    last = -1
    for i, c in enumerate(chosen):
        near = min(ends[c], key=lambda x: abs(known[x][0] - goals[i]))  # noqa: B023
        if near > last and abs(known[near][0] - goals[i]) <= snap * total / n_shards and near <= min(chosen[i + 1 :], default=TOP):
            chosen[i] = near
        last = chosen[i]
    return chosen, [(k, *known[k]) for k in sorted(known)]


def shard(docs: DataFrame, n_shards: int = 40, tolerance: float = 0.002, part_bytes: int = 64 << 20, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` (and ``text``) by the law ``bytes``.

    ``size`` is the UTF-8 bytes of the text plus 16 (a null text has none); shards have near equal sizes and hold runs
    of the key order, so rows with equal texts share a shard or, where a boundary falls among them, neighbouring ones.
    ``slot`` counts a shard's rows in key order from 0. A shard is sorted in several parts of about ``part_bytes``:
    rows below a part are known from the counts. Null ids and repeated rows (which share a key) are kept; an empty
    table gives an empty table.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    source = only(docs, doc_id=id_col, text=text_col)
    high = F.xxhash64(text).bitwiseAND(F.lit(-(1 << 32)))
    low = F.call_function("shiftrightunsigned", F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(32))
    wide = source.select("doc_id", *["text"] * keep_text, (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), high.bitwiseOR(low).alias("key"))
    keys = cut(wide.select("key", "size")) if keep_text else cut(wide)
    bounds, known = splitters(keys, n_shards, tolerance)
    total = known[-1][1]
    # Further known keys cut shards into parts; taking every one that passes another part_bytes keeps their number small.
    parts, last, fixed = [], 0, set(bounds)
    for key, size, n in known[:-1]:
        if key == 0 or key in fixed or size - last >= min(part_bytes, max(1, total // (4 * n_shards))):
            parts.append((key, n))
            last = size
    starts = np.array([k for k, _ in parts], np.uint64)
    before = np.array([n for _, n in parts], np.int64)
    shard_of = np.searchsorted(np.array(sorted(bounds), np.uint64), starts, side="right")
    first = {}
    for i, s in enumerate(shard_of):
        first.setdefault(int(s), i)
    base = np.array([before[i] - before[first[int(s)]] for i, s in enumerate(shard_of)], np.int64)

    def place(b, starts, shard_of, base):
        import pyarrow as pa

        at = np.searchsorted(starts, b.column("key").to_numpy().view(np.uint64), side="right") - 1
        extra = [pa.array(at.astype(np.int32)), pa.array(shard_of[at].astype(np.int32)), pa.array(base[at])]
        yield pa.RecordBatch.from_arrays([*b.columns, *extra], [*b.schema.names, "part", "shard", "base"])

    rows = wide if keep_text else keys
    schema = T.StructType([*rows.schema.fields, *T.StructType.fromDDL("part int, shard int, base long").fields])
    placed = arrow_map(rows, place, schema, starts, shard_of, base)
    unsigned = F.col("key").bitwiseXOR(F.lit(-(1 << 63)))
    rank = F.row_number().over(W.partitionBy("part").orderBy(unsigned, "doc_id")) - 1
    out = placed.withColumn("slot", F.col("base") + rank.cast("long"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), *["text"] * keep_text)
