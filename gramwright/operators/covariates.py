"""Covariate tables: choice of columns, categorical columns, alignment."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

log = logging.getLogger(__name__)

#: A text column with more distinct values than this many, and than this share of rows, names its rows.
IDENTIFIER_LEAST, IDENTIFIER_SHARE = 100, 0.8


def choose(covariates: DataFrame, id_col: str = "IID", columns: list[str] | None = None) -> DataFrame:
    """sample_id (text) and the columns, in the order asked for."""
    if id_col not in covariates.columns:
        raise ValueError(f"ID column '{id_col}' not found in covariates; available: {covariates.columns}")
    rest = [c for c in covariates.columns if c != id_col]
    lacking = [c for c in columns or [] if c not in rest]
    if lacking:
        raise ValueError(f"Covariate columns not found: {lacking}; available: {rest}")
    return covariates.select(F.col(f"`{id_col}`").alias("sample_id"), *(F.col(f"`{c}`") for c in columns or rest))


def one_hot(covariates: DataFrame, id_col: str = "sample_id") -> DataFrame:
    """Text columns become <column>_<level> columns of 0 and 1, after all others.

    The first level in order is left out where there are two or more; null is 0
    in all. A column that names its rows is dropped. One aggregate counts all
    columns; levels are then collected only of columns that stay.
    """
    texts = [f.name for f in covariates.schema if f.dataType.simpleString() in ("string", "boolean") and f.name != id_col]
    if not texts:
        return covariates
    counted = covariates.agg(F.count("*").alias("n"), *(F.countDistinct(F.col(f"`{c}`")).alias(f"d{k}") for k, c in enumerate(texts))).first()
    keep = [c for k, c in enumerate(texts) if not (counted[f"d{k}"] > IDENTIFIER_LEAST and counted[f"d{k}"] > IDENTIFIER_SHARE * counted["n"])]
    for c in set(texts) - set(keep):
        log.warning("Column %s has a value of its own for nearly every row; dropped", c)
    sets = covariates.agg(*(F.array_sort(F.collect_set(F.col(f"`{c}`").cast("string"))).alias(f"s{k}") for k, c in enumerate(keep))).first() if keep else None
    dummies = []
    for k, c in enumerate(keep):
        levels = sets[f"s{k}"]
        for level in levels[1:] if len(levels) > 1 else levels:
            dummies.append(F.when(F.col(f"`{c}`").cast("string") == level, 1.0).otherwise(0.0).alias(f"{c}_{level}"))
    return covariates.select(*(F.col(f"`{c}`") for c in covariates.columns if c not in texts), *dummies)


def align(samples: DataFrame, covariates: DataFrame) -> DataFrame:
    """Covariates of the samples (sample_id, sample_pos), with sample_pos."""
    lacking = missing_samples(samples, covariates)
    n = lacking.count()
    if n:
        log.warning("%d samples have no covariates", n)
    out = samples.join(covariates, "sample_id")
    if n and not out.limit(1).count():
        raise ValueError("No samples in common between genotypes and covariates")
    return out


def missing_samples(samples: DataFrame, covariates: DataFrame) -> DataFrame:
    return samples.join(covariates, "sample_id", "left_anti")
