"""Helpers that several training-data operators share."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.storage import shared_folder

#: A word is a maximal run of anything but ASCII white space.
SPACE_CLASS = r"[\x20\x09-\x0D]"
#: Spark's size for what has none is the largest long.
_UNKNOWN = 1 << 60
SPACE_BYTES = b" \t\n\x0b\x0c\r"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's ``spark.checkpoint.dir``; only where none is set, on one machine, a folder of our own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(spark))


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint, so a lost executor costs a re-read and not a re-run."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def input_bytes(df: DataFrame) -> int:
    """Bytes of the files below a plan, from Catalyst's statistics and without a job. Where a source doesn't know its
    size (an RDD or a checkpoint), one aggregate counts the bytes of the text columns."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    if all(x < _UNKNOWN for x in sizes):
        return sum(sizes)
    text = [F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0)).cast("long") for f in df.schema if f.dataType.simpleString() == "string"]
    each = functools.reduce(lambda a, b: a + b, text, F.lit(16).cast("long"))
    return int(df.agg(F.sum(each)).first()[0] or 0)


def parts_for(df: DataFrame, bytes_each: int, least: int = 12) -> int:
    """Partitions of about ``bytes_each``, so their number and not their size follows the input."""
    return int(min(1_000_000, max(least, -(-input_bytes(df) // bytes_each))))


def only(df: DataFrame, **columns: str) -> DataFrame:
    """Select and rename the needed columns, so extra columns with clashing names never meet ours."""
    return df.select(*[df[old].alias(new) for new, old in columns.items()])


def id_and(df: DataFrame, id_col: str, rest: str) -> T.StructType:
    """A result's schema: ``doc_id`` of the input's own type (whatever it and its fields are called), and ``rest``."""
    return T.StructType([T.StructField("doc_id", df.schema[id_col].dataType), *T.StructType.fromDDL(rest).fields])


def arrow_map(df: DataFrame, batch, schema, *args) -> DataFrame:
    """``mapInArrow`` with ``batch(record_batch, *args) -> iterator of record batches``, a few MB at a time."""

    def run(batches):
        for b in batches:
            for piece in slices(b):
                yield from batch(piece, *args)

    return df.mapInArrow(run, schema)


def slices(b, most: int = 8 << 20):
    """Split a batch so that one piece holds at most about ``most`` bytes (or one row)."""
    step = max(1, int(b.num_rows * min(1.0, most / max(1, b.nbytes))))
    for i in range(0, b.num_rows, step):
        yield b.slice(i, step)


def least(*columns: Column) -> Column:
    return functools.reduce(lambda a, b: F.least(a, b), columns)


def connected_components(links: DataFrame) -> DataFrame:
    """Smallest node reachable from every linked node.

    ``links`` has long columns ``a`` and ``b`` (any order, repeats and self links allowed); the result has ``node`` and
    ``component`` for each node of a link. Alternates the large-star and small-star steps of Kiveris et al. (2014):
    every step is a partial-aggregated minimum plus an equi-join that adaptive execution may split, so a node with very
    many links never gathers in one task. Nothing but two numbers a round reaches the driver.
    """
    edges = cut(
        links.where("a <> b and a is not null and b is not null")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    mark = _mark(edges)
    while mark[0]:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        edges = cut(small)
        now = _mark(edges)
        if now == mark:
            break
        mark = now
    members = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return members.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _mark(edges: DataFrame) -> tuple:
    """Count and order-free hash of an edge set; equal marks mean the stars have settled."""
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(h), F.sum(h.cast("decimal(20,0)"))).first())
