"""Correlations as unsigned codes of 1, 2, 4 or 8 bytes, and back, as columns.

A code is trunc((r + 1) * 2^(8b-2)), held within [0, missing - 1]; `missing` is
the code of r = 2.25 and stands for NaN. Eight-byte codes pass 2^63, so that
they are decimals.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of a code by compression level.
WIDTHS = (1, 2, 4, 8)


def shift(width: int) -> int:
    return 1 << (8 * width - 2)


def missing(width: int) -> int:
    return 13 * shift(width) // 4


def encode(r: Column, width: int) -> Column:
    top, scale = missing(width), shift(width)
    gone = r.isNull() | F.isnan(r)
    if width < 8:
        raw = F.floor(F.least(F.greatest((r + 1) * float(scale), F.lit(0.0)), F.lit(float(top - 1))))
        return F.when(gone, F.lit(top)).otherwise(raw).cast("long")
    # the product is exact in double, but a cast of it to decimal is not: its halves are, as longs
    scaled = F.greatest((r + 1) * float(scale), F.lit(0.0))
    high = F.floor(scaled / float(1 << 32))
    low = F.floor(scaled - high.cast("double") * float(1 << 32))
    raw = (high.cast("decimal(20,0)") * F.lit(str(1 << 32)).cast("decimal(11,0)") + low.cast("decimal(20,0)")).cast("decimal(38,0)")
    return F.when(gone, F.lit(str(top)).cast("decimal(38,0)")).otherwise(F.least(raw, F.lit(str(top - 1)).cast("decimal(38,0)"))).cast("decimal(20,0)")


def decode(code: Column, width: int) -> Column:
    """Single precision, NaN for the missing code."""
    value = code.cast("double") / float(shift(width)) - 1
    return F.when(code == F.lit(str(missing(width))).cast("decimal(20,0)"), F.lit(float("nan"))).otherwise(value).cast("float")
