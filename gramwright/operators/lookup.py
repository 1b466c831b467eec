"""Values of a stored correlation matrix for lists of variants.

meta has row and rsid (unique); cells are the strict upper triangle i < j, r;
diagonal has i, r and may be None, which stands for ones.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

log = logging.getLogger(__name__)

MISSING = ("raise", "warn", "skip")


def rows_of(request: DataFrame, meta: DataFrame) -> DataFrame:
    """request (ord, rsid) -> ord, rsid, row: -1 if there is none. Repeats stay."""
    return request.join(meta.select("rsid", "row"), "rsid", "left").select("ord", "rsid", F.coalesce("row", F.lit(-1)).alias("row"))


def resolve(request: DataFrame, meta: DataFrame, missing: str = "raise") -> DataFrame:
    if missing not in MISSING:
        raise ValueError(f"missing must be one of {MISSING}")
    found = rows_of(request, meta)
    lost = found.where("row < 0")
    if missing == "raise":
        names = [r["rsid"] for r in lost.orderBy("ord").limit(10).collect()]
        if names:
            raise KeyError(f"rsids not found: {names}")
    elif missing == "warn" and (n := lost.count()):
        log.warning("%d rsids not found", n)
    return found.where("row >= 0")


def submatrix(left: DataFrame, right: DataFrame, cells: DataFrame, diagonal: DataFrame | None = None) -> DataFrame:
    """left, right: ord, row -> a, b (their ords), r in single precision. The
    stored cells are joined to the requested rows at both ends; the grid is
    what is returned."""
    grid = left.select(F.col("ord").alias("a"), F.col("row").alias("x")).crossJoin(right.select(F.col("ord").alias("b"), F.col("row").alias("y")))
    grid = grid.select("a", "b", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"))
    ends = left.select(F.col("row").alias("k")).union(right.select(F.col("row").alias("k"))).distinct()
    near = cells.join(ends.withColumnRenamed("k", "i"), "i", "left_semi").join(ends.withColumnRenamed("k", "j"), "j", "left_semi").select("i", "j", "r")
    out = grid.join(near, ["i", "j"], "left")
    one = F.lit(1.0)
    if diagonal is not None:
        out = out.join(diagonal.select(F.col("i"), F.col("i").alias("j"), F.col("r").alias("d")), ["i", "j"], "left")
        one = F.col("d")
    return out.select("a", "b", F.when(F.col("i") == F.col("j"), one).otherwise(F.col("r")).cast("float").alias("r"))


def columns_of(left: DataFrame, meta: DataFrame, cells: DataFrame, diagonal: DataFrame | None = None) -> DataFrame:
    """All rows of the matrix, at the requested columns."""
    every = meta.select(F.col("row").cast("long").alias("ord"), "row")
    return submatrix(every, left, cells, diagonal)


def pair(cells: DataFrame, i: int, j: int, diagonal: DataFrame | None = None) -> float | None:
    """One value; None if it isn't stored."""
    if i == j and diagonal is None:
        return 1.0
    rows = cells.where((F.col("i") == min(i, j)) & (F.col("j") == max(i, j))) if i != j else diagonal.where(F.col("i") == i)
    found = rows.select("r").first()
    return found["r"] if found else None
