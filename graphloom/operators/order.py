"""Positions in a total order, counted in parallel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.scratch import materialise

_PARTITION_BITS = 33


def ranked(rows: DataFrame, order: list[str], name: str = "n") -> DataFrame:
    """The rows with their place from 0 in the given order. Rows are dealt to ranges and sorted there; only the ranges'
    sizes, as many as partitions, meet in one place."""
    placed = materialise(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("__id", _PARTITION_BITS).alias("__part")
    sizes = sorted((r["__part"], r["count"]) for r in placed.groupBy(part).count().collect())
    before, offsets = 0, []
    for p, size in sizes:
        offsets.append((p, before))
        before += size
    known = F.broadcast(rows.sparkSession.createDataFrame(offsets, "__part long, __before long"))
    within = F.col("__id").bitwiseAND(F.lit((1 << _PARTITION_BITS) - 1))
    return placed.withColumn("__part", part).join(known, "__part").withColumn(name, within + F.col("__before")).drop("__id", "__part", "__before")
