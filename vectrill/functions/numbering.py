"""Dense numbers without a single-partition window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def number_rows(df: DataFrame, order: list[str], start: int, name: str) -> DataFrame:
    """Adds ``start, start + 1, ...`` in the given order.

    Range-partitioned and sorted in parallel, then cut with a checkpoint so the order can't change; only one count a
    partition reaches the driver, and each partition gets its offset.
    """
    from ..sources.storage import checkpointed

    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = checkpointed(placed)
    part = F.shiftright("_at", 33).cast("int")
    sizes = dict(map(tuple, placed.groupBy(part.alias("p")).count().collect()))
    offset, so_far = {}, start
    for p in sorted(sizes):
        offset[p] = so_far
        so_far += sizes[p]
    if not offset:
        return placed.withColumn(name, F.lit(0).cast("long")).drop("_at")
    base = F.element_at(F.map_from_arrays(F.array(*[F.lit(p) for p in offset]), F.array(*[F.lit(o).cast("long") for o in offset.values()])), part)
    return placed.withColumn(name, base + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at")
