"""Correlations as text: a square matrix, or a long list of pairs.

Numbers are written with six places as C's printf does, which Spark's own
formatter does not; that one step is a vectorised Python function. Files of a
job are parts in order: a single file is made by joining them.
"""

from __future__ import annotations

import gzip
import io
import logging
import os
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import settled
from . import files

log = logging.getLogger(__name__)

LONG = "#CHROM\tPOS\tID\tREF\tALT\tCHROM_B\tPOS_B\tID_B\tREF_B\tALT_B\tR"
NUMERIC = "#VAR1\tVAR2\tR"
INFO = ("chrom", "pos", "rsid", "ref", "alt")


def _written(df: DataFrame, name: str = "r") -> DataFrame:
    """Column `name` as text with six places."""
    at = df.columns.index(name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = pa.array(["nan" if x is None else f"{x:.6f}" for x in batch.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays([text if k == at else c for k, c in enumerate(batch.columns)], names=batch.schema.names)

    kinds = [f"`{f.name}` {'string' if f.name == name else f.dataType.simpleString()}" for f in df.schema]
    return df.mapInArrow(run, ", ".join(kinds))


def long_lines(ld: DataFrame, info: DataFrame | None = None) -> DataFrame:
    """i, j, line for the upper triangle with its diagonal; info: variant_idx
    and INFO."""
    rows = _written(ld.select("i", "j", F.col("r").cast("double").alias("r")))
    if info is None:
        return rows.select("i", "j", F.concat_ws("\t", F.col("i").cast("string"), F.col("j").cast("string"), "r").alias("line"))
    text = F.concat_ws("\t", *(F.col(c).cast("string") for c in INFO))
    side = lambda s: info.select(F.col("variant_idx").alias(s), text.alias(f"t{s}"))
    return rows.join(side("i"), "i").join(side("j"), "j").select("i", "j", F.concat_ws("\t", "ti", "tj", "r").alias("line"))


def matrix_lines(ld: DataFrame) -> DataFrame:
    """i, line: rows of the square matrix, from its upper triangle."""
    both = ld.select("i", "j", "r").union(ld.where("i < j").select("j", "i", "r"))
    text = _written(both.select("i", "j", F.col("r").cast("double").alias("r")))
    return text.groupBy("i").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("j", "r"))), lambda x: x["r"]), "\t").alias("line"))


@contextmanager
def _writing(path: str):
    """A text stream to a new file, packed if its name says so."""
    with files.writing(path) as raw:
        if path.endswith((".gz", ".bgz")):
            with gzip.open(raw, "wt", encoding="utf-8") as f:
                yield f
        else:
            with io.TextIOWrapper(raw, "utf-8") as f:
                yield f


def write(ld: DataFrame, path: str, form: str = "matrix", info: DataFrame | None = None) -> None:
    """One text file; .gz and .bgz are compressed. Lines stream through the
    driver in order, a partition at a time."""
    if form not in ("matrix", "long"):
        raise ValueError(f"text is written as matrix or long, not as {form!r}")
    empty = not ld.limit(1).count()
    if form == "long" and info is None and empty:
        raise ValueError("Cannot write zero variants in numeric long format")
    lines = matrix_lines(ld).orderBy("i") if form == "matrix" else long_lines(ld, info).orderBy("i", "j")
    with _writing(path) as f:
        if form == "long":
            f.write((LONG if info is not None else NUMERIC) + "\n")
        for row in lines.select("line").toLocalIterator(prefetchPartitions=True):
            f.write(row["line"] + "\n")
    if form == "matrix" and info is not None:
        with _writing(os.path.splitext(path)[0] + ".index.txt") as f:
            f.writelines(f"{r['rsid']}\n" for r in info.orderBy("variant_idx").select("rsid").toLocalIterator())


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """n, value: numbered lines. Plain files are split by Spark; packed ones
    can't be, and .bgz is read as gzip."""
    from ..operators.selection import numbered

    if path.endswith((".gz", ".bgz")):

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            # one task unpacks the file as it reads it
            for batch in batches:
                for at in batch.column(0).to_pylist():
                    lines, k = files.text_lines(at), 0
                    while some := [x.rstrip("\r\n") for x in islice(lines, 4096)]:
                        yield pa.RecordBatch.from_arrays([pa.array(range(k, k + len(some)), pa.int64()), pa.array(some, pa.string())], names=["n", "value"])
                        k += len(some)

        return spark.createDataFrame([(path,)], "path string").mapInArrow(run, "n long, value string")
    raw = spark.read.text(path).select("value", F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    return numbered(raw, "block", "at", name="n").select("n", "value")


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame | None]:
    """(i, j, r) of the upper triangle, and variant_idx with INFO or None. A
    first line that begins with # tells a long file."""
    first = next(files.text_lines(path), "").strip()
    lines = _lines(spark, path)
    if not first.startswith("#"):
        return _read_matrix(spark, path, lines)
    body = lines.where("n > 0 and value <> ''").select("n", F.split("value", "\t").alias("c"))
    names = first.lstrip("#").split("\t")
    if names == NUMERIC.lstrip("#").split("\t"):
        cells = body.select(F.col("c")[0].cast("int").alias("x"), F.col("c")[1].cast("int").alias("y"), F.col("c")[2].cast("double").alias("r"))
        top = cells.agg(F.max(F.greatest("x", "y"))).first()[0]
        return _filled(spark, cells, 1 if top is None else top + 1), None
    if names != LONG.lstrip("#").split("\t"):
        raise ValueError(f"Unknown columns in {path}: {names}")
    side = lambda k: F.struct(*(F.col("c")[k + m].alias(name) for m, name in enumerate(INFO)))
    cells = body.select("n", side(0).alias("a"), side(5).alias("b"), F.col("c")[10].cast("double").alias("r"))
    from ..operators.selection import numbered

    # left variants in the order of the file, then those only seen on the right
    seen = cells.select(F.lit(0).alias("side"), "n", F.col("a").alias("v")).union(cells.select(F.lit(1), "n", F.col("b")))
    order = numbered(seen.groupBy("v").agg(F.min(F.struct("side", "n")).alias("first")), "first", name="variant_idx")
    order = settled(order.select(F.col("variant_idx").cast("int").alias("variant_idx"), "v"))
    at = lambda s, k: order.select(F.col("v").alias(s), F.col("variant_idx").alias(k))
    known = cells.join(at("a", "x"), "a").join(at("b", "y"), "b").select("x", "y", "r")
    info = order.select("variant_idx", "v.*").withColumn("pos", F.col("pos").cast("int"))
    return _filled(spark, known, order.count()), info


def _filled(spark: SparkSession, cells: DataFrame, n: int) -> DataFrame:
    """All pairs i <= j: unlisted diagonals are 1, other unlisted pairs 0."""
    grid = spark.range(n).select(F.col("id").cast("int").alias("i")).select("i", F.explode(F.sequence("i", F.lit(n - 1))).alias("j"))
    listed = cells.select(F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), "r").dropDuplicates(["i", "j"])
    return grid.join(listed, ["i", "j"], "left").select("i", "j", F.coalesce("r", F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0)).alias("r"))


def _read_matrix(spark: SparkSession, path: str, lines: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    value = F.trim("value")
    cells = F.when(F.contains("value", F.lit("\t")), F.split(value, "\t")).otherwise(F.split(value, r"\s+"))
    rows = lines.where(value != "").select(F.col("n").cast("int").alias("i"), F.posexplode(cells).alias("j", "x"))
    ld = rows.where("i <= j").select("i", "j", F.col("x").cast("double").alias("r"))
    names_at = os.path.splitext(path)[0] + ".index.txt"
    if not files.exists(names_at):
        return ld, None
    names = [x.strip() for x in files.text_lines(names_at)]
    n = rows.agg(F.max("i")).first()[0]
    if len(names) != (0 if n is None else n + 1):
        log.warning("%s has %d names for %s variants; ignored", names_at, len(names), n)
        return ld, None
    return ld, spark.createDataFrame([(k, "", 0, x, "", "") for k, x in enumerate(names)], "variant_idx int, chrom string, pos int, rsid string, ref string, alt string")
