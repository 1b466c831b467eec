"""Cells of a stored LD matrix for selected variants.

The store holds upper-triangle cells (i, j, r), i <= j; what it lacks is NaN.
Targets are joined to both ends of the stored cells, so that only stored cells
travel; the grid of pairs is made from the targets' own order afterwards.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .selection import check_distinct

log = logging.getLogger(__name__)

FILLS = ("nan", "zero")


def stored_cells(store: DataFrame, targets: DataFrame) -> DataFrame:
    """a, b (targets' ord, a <= b), r with the sign of swapped alleles."""
    side = lambda s, k: targets.select(F.col("idx").alias(s), F.col("ord").alias(f"o{k}"), F.col("flipped").alias(f"f{k}"))
    met = store.where("i <= j").join(side("i", 1), "i").join(side("j", 2), "j")
    signed = F.col("r") * F.when(F.col("f1") != F.col("f2"), -1.0).otherwise(1.0)
    return met.select(F.least("o1", "o2").alias("a"), F.greatest("o1", "o2").alias("b"), signed.alias("r"))


def extract(store: DataFrame, targets: DataFrame, fill: str = "nan", mirror: bool = False) -> DataFrame:
    """a, b, r for every pair of targets, a <= b (both ways if mirror). Cells
    that the store lacks are NaN, or 0 if fill is zero."""
    if fill not in FILLS:
        raise ValueError(f"fill must be one of {FILLS}")
    check_distinct(targets)
    cells = stored_cells(store, targets)
    ends = targets.select("ord")
    # the result itself has a row per pair: this join makes no more than it returns
    grid = ends.withColumnRenamed("ord", "a").join(ends.withColumnRenamed("ord", "b"), F.col("a") <= F.col("b"))
    empty = F.lit(float("nan") if fill == "nan" else 0.0)
    value = F.coalesce("r", empty)
    if fill == "zero":
        value = F.nanvl(value, F.lit(0.0))
    out = grid.join(cells, ["a", "b"], "left").select("a", "b", value.alias("r"))
    return out.union(out.where("a < b").select(F.col("b").alias("a"), F.col("a").alias("b"), "r")) if mirror else out


def missing_cells(store: DataFrame, targets: DataFrame) -> DataFrame:
    """n_missing: cells of the square matrix of targets that hold no number,
    counted before any fill."""
    n = targets.agg((F.count("*") * F.count("*")).alias("n"))
    have = stored_cells(store, targets).where(~F.isnan("r")).agg(F.coalesce(F.sum(F.when(F.col("a") == F.col("b"), 1).otherwise(2)), F.lit(0)).alias("k"))
    return n.join(have).select((F.col("n") - F.col("k")).cast("long").alias("n_missing"))


def block_pairs(targets: DataFrame, block: int, stored: DataFrame | None = None, n_block_rows: int | None = None) -> DataFrame:
    """bi <= bj: blocks of the grid that hold cells of the targets; only those
    in `stored` (column linear = bi + bj * n_block_rows) if it is given."""
    mine = targets.select(F.floor(F.col("idx") / block).cast("int").alias("b")).distinct()
    pairs = mine.select(F.col("b").alias("bi")).join(mine.select(F.col("b").alias("bj")), F.col("bi") <= F.col("bj"))
    if stored is None:
        return pairs
    return pairs.withColumn("linear", (F.col("bi") + F.col("bj") * n_block_rows).cast("long")).join(stored, "linear", "left_semi").select("bi", "bj")
