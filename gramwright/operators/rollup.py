"""Benchmark runs by configuration, against the first one by name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Share above the baseline's median from which a configuration counts as slower.
SLOWER = 1.1


def compare(runs: DataFrame, by: str, seconds: str) -> DataFrame:
    """One row per configuration: spread, change in per cent, and slower."""
    x = F.col(seconds)
    out = runs.groupBy(by).agg(F.count("*").alias("runs"), F.median(x).alias("median"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.min(x).alias("least"), F.max(x).alias("most"))
    base = out.agg(F.min(F.struct(F.col(by), F.col("median").alias("m")))["m"].alias("base"))
    places = lambda c, n=6: (F.round(c, n) + 0.0).alias(c if isinstance(c, str) else "change")
    joined = out.join(F.broadcast(base))
    change = (F.col("median") / F.col("base") - 1) * 100
    return joined.select(by, "runs", places("median"), places("mean"), places("std"), places("least"), places("most"), places(change, 4), (F.col("median") > SLOWER * F.col("base")).alias("slower"))


def changes(before: DataFrame, after: DataFrame, by: list[str], seconds: str = "seconds") -> DataFrame:
    """Medians of two sets of runs by configuration (by), the change in per cent
    and whether it is slower; a configuration that one lacks has nulls."""
    middle = lambda df, name: df.groupBy(*by).agg(F.median(seconds).alias(name))
    met = middle(before, "before").join(middle(after, "after"), by, "full")
    change = F.round((F.col("after") / F.col("before") - 1) * 100, 4) + 0.0
    return met.select(*by, *((F.round(c, 6) + 0.0).alias(c) for c in ("before", "after")), change.alias("change"), (F.col("after") > SLOWER * F.col("before")).alias("slower"))
