"""Block-matrix stores: a task reads the blocks that hold selected cells."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..codec.blocks import Grid, read_block, write_block
from . import files

#: Selected rows up to which they are sent to every task; beyond, blocks are read whole.
SENT = 1 << 20


def grid_of(path: str, options: dict | None = None) -> tuple[Grid, list[str]]:
    meta = json.loads(files.read_all(f"{path.rstrip('/')}/metadata.json", options))
    stored = meta.get("maybeFiltered")
    return Grid(meta["blockSize"], meta["nRows"], meta["nCols"], None if stored is None else tuple(stored)), meta["partFiles"]


def cells(spark: SparkSession, path: str, targets: DataFrame | None = None, options: dict | None = None) -> DataFrame:
    """i, j, r for the stored cells with i <= j; of the targets' idx if given.
    A block is a row of a small table of parts, which the needed blocks of the
    upper triangle are taken from, and tasks fetch and unpack them."""
    grid, parts = grid_of(path, options)
    root = path.rstrip("/")
    wanted = [(bi, bj, f"{root}/parts/{parts[k]}") for k, bi, bj in grid.parts() if bi <= bj]
    blocks = spark.createDataFrame(wanted, "bi int, bj int, path string") if wanted else spark.createDataFrame([], "bi int, bj int, path string")
    chosen = None
    if targets is not None:
        need = targets.select(F.floor(F.col("idx") / grid.block).cast("int").alias("b")).distinct()
        # a row per row of blocks at most
        small = F.broadcast if grid.block_rows <= SENT else lambda df: df
        blocks = blocks.join(small(need.withColumnRenamed("b", "bi")), "bi", "left_semi").join(small(need.withColumnRenamed("b", "bj")), "bj", "left_semi")
        blocks = blocks.select("bi", "bj", "path")
        if targets.limit(SENT + 1).count() <= SENT:
            chosen = np.unique([r["idx"] for r in targets.select("idx").collect()]).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bi, bj, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = read_block(files.read_all(at, options))
                rows = np.arange(data.shape[0]) + bi * grid.block
                columns = np.arange(data.shape[1]) + bj * grid.block
                if chosen is not None:
                    rows, columns = rows[np.isin(rows, chosen)], columns[np.isin(columns, chosen)]
                part = data[np.ix_(rows - bi * grid.block, columns - bj * grid.block)]
                i, j = np.repeat(rows, len(columns)), np.tile(columns, len(rows))
                keep = i <= j
                yield pa.RecordBatch.from_arrays([pa.array(i[keep]), pa.array(j[keep]), pa.array(part.ravel()[keep], from_pandas=False)], names=["i", "j", "r"])

    n = max(1, min(len(wanted), 4096))
    return blocks.repartition(n, "bi", "bj").mapInArrow(run, "i long, j long, r double")


def write(ld: DataFrame, n: int, path: str, block: int) -> None:
    """The upper triangle (i, j, r) of n variants: blocks that hold any cell are
    stored, with zeros for what they lack. Each task writes the part files of
    its blocks, under the same names if it is run again."""
    root, rows = path.rstrip("/"), -(-n // block)

    def run(table: pa.Table) -> pa.Table:
        number = table.column("number")[0].as_py()
        bi, bj = number % rows, number // rows
        i, j = (table.column(c).to_numpy() for c in ("i", "j"))
        part = np.zeros((min(block, n - bi * block), min(block, n - bj * block)))
        part[i - bi * block, j - bj * block] = table.column("r").to_numpy()
        with files.writing(f"{root}/parts/part-{number:09d}") as f:
            f.write(write_block(part))
        return pa.table({"number": pa.array([number], pa.int64())})

    at = lambda c: F.floor(F.col(c) / block).cast("long")
    cells = ld.where("i <= j").select((at("i") + at("j") * rows).alias("number"), "i", "j", F.col("r").cast("double").alias("r"))
    numbers = sorted(r["number"] for r in cells.groupBy("number").applyInArrow(run, "number long").collect())  # a number per block
    about = {"blockSize": block, "nRows": n, "nCols": n, "maybeFiltered": numbers, "partFiles": [f"part-{k:09d}" for k in numbers]}
    with files.writing(f"{root}/metadata.json") as f:
        f.write(json.dumps(about).encode())
