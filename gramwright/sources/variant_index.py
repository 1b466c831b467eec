"""Variant indices: Parquet sorted by contig and position."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ESSENTIAL = ("contig", "position", "ref", "alt", "idx")


def from_locus_table(variants: DataFrame, extras: bool = True) -> DataFrame:
    """locus (contig, position), alleles, idx and more -> an index's columns.
    ValueError if any variant hasn't two alleles."""
    if "idx" not in variants.columns:
        raise ValueError("the table has no idx column")
    odd = variants.where(F.size("alleles") != 2).limit(1).count()
    if odd:
        raise ValueError("only variants of two alleles can be indexed; split the others first")
    rest = [c for c in variants.columns if c not in ("locus", "alleles", "idx")] if extras else []
    return variants.select(
        F.col("locus.contig").alias("contig"), F.col("locus.position").alias("position"), F.col("alleles")[0].alias("ref"), F.col("alleles")[1].alias("alt"), "idx", *(F.col(f"`{c}`") for c in rest)
    )


def write(index: DataFrame, path: str) -> None:
    """Range partitions in order, each sorted: row groups' bounds stay narrow,
    and a region's scan skips the others."""
    index.repartitionByRange("contig", "position").sortWithinPartitions("contig", "position").write.mode("overwrite").option("compression", "zstd").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    found = spark.read.parquet(path)
    lacking = [c for c in ESSENTIAL if c not in found.columns]
    if lacking:
        raise ValueError(f"{path} lacks the columns {lacking}")
    return found
