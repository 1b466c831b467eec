"""Places in a strict upper triangle stored row by row, and byte ranges."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def place(i: Column, j: Column, n: int) -> Column:
    """Place of the pair {i, j}, i and j apart."""
    lo, hi = F.least(i, j).cast("long"), F.greatest(i, j).cast("long")
    return lo * n - F.floor(lo * (lo + 1) / 2).cast("long") + hi - lo - 1


def merged(starts: np.ndarray, sizes: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ascending reads [start, start + size) joined while what lies between is at
    most gap: starts and stops of the joint reads, and the joint read of each."""
    stops = np.maximum.accumulate(starts + sizes) if len(starts) else starts
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] - stops[:-1] > gap
    first = np.flatnonzero(new)
    return starts[first], stops[np.append(first[1:] - 1, len(starts) - 1)] if len(first) else first, np.cumsum(new) - 1


def merge_ranges(offsets: DataFrame, size: int, gap: int, by: list[str] | None = None) -> DataFrame:
    """Column `offset` (by group) -> start, stop: reads of `size` bytes at each
    offset joined while what lies between is at most gap. Groups are files or
    blocks; without any, offsets are cut into groups of 2^30 bytes first, and the
    first and last range of each are joined again: no task sorts all offsets."""
    groups = by or ["__part"]
    rows = offsets.select(*(by or []), F.col("offset").cast("long").alias("start")).distinct()
    if not by:
        rows = rows.withColumn("__part", F.shiftright("start", 30))
    ranges = _joined(rows.withColumn("stop", F.col("start") + size), groups, gap)
    if by:
        return ranges
    # only a part's first and last range can go on in another part
    edges = ranges.groupBy("__part").agg(F.min("start").alias("__first"), F.max("start").alias("__last"))
    marked = ranges.join(edges, "__part").withColumn("edge", F.col("start").isin(F.col("__first"), F.col("__last")))
    inner = marked.where("not edge").select("start", "stop")
    return inner.union(_joined(marked.where("edge").select("start", "stop"), [], gap).select("start", "stop"))


def _joined(rows: DataFrame, groups: list[str], gap: int) -> DataFrame:
    order = W.partitionBy(*groups).orderBy("start")
    before = F.max("stop").over(order.rowsBetween(W.unboundedPreceding, -1))
    marked = rows.withColumn("new", F.when(F.col("start") - before > gap, 1).when(before.isNull(), 1).otherwise(0))
    numbered = marked.withColumn("island", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy(*groups, "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("island")
