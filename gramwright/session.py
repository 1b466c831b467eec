"""Spark sessions with the settings that this engine relies on."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Needed by the data sources (filters reach the file formats) and for skewed keys.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.python.filterPushdown.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def session(name: str = "gramwright", **more: str) -> SparkSession:
    return SparkSession.builder.appName(name).config(map=SETTINGS | more).getOrCreate()


def settled(df: DataFrame) -> DataFrame:
    """df computed once and read from the checkpoint folder (spark.checkpoint.dir;
    one under the warehouse if that is unset): unlike a cache it is not found
    again by other plans over the same paths, and it outlives executors."""
    spark = df.sparkSession
    if spark.conf.get("spark.checkpoint.dir", None) is None and spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")
    return df.checkpoint()


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share (see settled)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_files"
    return f"{folder.rstrip('/')}/{uuid.uuid4().hex}/{name}"
