"""Two-sided exchange between blocks of documents and hash shards of what they contain.

Counting something in the whole corpus (lines, n-grams) and bringing the counts back to each document would, done row
by row, shuffle every occurrence twice. Here documents are dealt into blocks of bounded size by a hash of the row; each
block sends every shard one packed request with its distinct keys; a shard answers with one packed reply a block.
A key that every document holds is therefore sent once a block, so no shard and no block can become hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import parts_for

BLOCK_BYTES = 6 << 20
REQUEST = "shard int, block int, keys binary, extra binary"


def in_blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES, n_blocks: int | None = None) -> DataFrame:
    """``docs`` (doc_id, text) with a ``block``, one block to a partition; equal rows share a block."""
    n = n_blocks or parts_for(docs.select("doc_id", "text"), block_bytes)
    return docs.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int")).repartition(n, "block")


def ask(blocks: DataFrame, request, answer, reply: str, finish, schema: str, kept: DataFrame | None = None) -> DataFrame:
    """Run one round: ``request(block table) -> [(shard, keys, extra)]`` in each block, ``answer(shard table) -> table``
    with columns ``block`` and ``reply`` in each shard, ``finish(block table, reply table) -> table`` in each block. If rows
    with a ``shard`` are ``kept`` for the shards, it is ``answer(shard table, kept table)``."""
    import pyarrow as pa

    def send(table):
        block = table.column("block")[0].as_py() if table.num_rows else None
        rows = list(request(table))
        return pa.table(
            {
                "shard": pa.array([r[0] for r in rows], pa.int32()),
                "block": pa.array([block] * len(rows), pa.int32()),
                "keys": pa.array([r[1] for r in rows], pa.binary()),
                "extra": pa.array([r[2] for r in rows], pa.binary()),
            }
        )

    requests = blocks.groupBy("block").applyInArrow(send, REQUEST)
    schema_of = f"block int, {reply}"
    if kept is None:
        replies = requests.groupBy("shard").applyInArrow(answer, schema_of)
    else:
        replies = requests.groupBy("shard").cogroup(kept.groupBy("shard")).applyInArrow(answer, schema_of)
    return blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(finish, schema)
