"""Small text inputs: variant lists, sample files, covariates, projections."""

from __future__ import annotations

import csv
import io
import json
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.projection import Projection
from ..operators.selection import LIST_COLUMNS, check_list, numbered
from . import files

VERSION = "1.0"
#: Bytes of Q that are gathered into one file.
Q_BYTES = 512 << 20


def _numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.text(path).select("value", F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    return numbered(raw, "block", "at", name="n").select("n", "value")


def variant_list(spark: SparkSession, path: str, check: bool = True, lower: bool = False) -> DataFrame:
    """A z-file: ord, LIST_COLUMNS; all text but the position. `lower` takes
    column names in any case, as extraction does."""
    if not files.exists(path):
        raise FileNotFoundError(f"there is no variant list at {path}")
    names = next(files.text_lines(path), "").split()
    names = [x.lower() for x in names] if lower else names
    lacking = [c for c in LIST_COLUMNS if c not in names]
    if lacking:
        raise ValueError(f"the variant list has no column {', '.join(lacking)}")
    words = F.split(F.trim("value"), r"\s+")
    body = _numbered_lines(spark, path).where("n > 0 and trim(value) <> ''")
    rows = body.select((F.col("n") - 1).alias("ord"), *(words[names.index(c)].alias(c) for c in LIST_COLUMNS))
    return check_list(rows) if check else rows.withColumn("position", F.col("position").cast("int"))


def write_list(listed: DataFrame, path: str) -> None:
    """A z-file of a list (ord, LIST_COLUMNS), by ord."""
    with files.writing(path) as f:
        f.write((" ".join(LIST_COLUMNS) + "\n").encode())
        for r in listed.orderBy("ord").select(*LIST_COLUMNS).toLocalIterator():
            f.write((" ".join(str(x) for x in r) + "\n").encode())


def samples(spark: SparkSession, path: str) -> DataFrame:
    """sample_id and sample_pos of a .sample file."""
    body = _numbered_lines(spark, path).where("n > 1 and trim(value) <> ''")
    return body.select(F.split(F.trim("value"), r"\s+")[0].alias("sample_id"), (F.col("n") - 2).alias("sample_pos"))


def covariates(spark: SparkSession, path: str, id_col: str = "IID", columns: list[str] | None = None) -> DataFrame:
    """sample_id as text and the chosen columns; a column whose values are all
    numbers is double, any other text. .csv is comma-separated, others are
    sniffed; .gz and .bgz are read through; Excel needs its reader installed."""
    from ..operators.covariates import choose

    plain = path.removesuffix(".gz").removesuffix(".bgz")
    try:
        if plain.endswith((".xlsx", ".xls")):
            import pandas as pd

            frame = pd.read_excel(path, dtype={id_col: str})
            raw = spark.createDataFrame(frame.astype(object).where(frame.notna(), None).astype(str))
        else:
            head = "".join(islice(files.text_lines(path), 200))
            first = head.splitlines()[0]
            sep = "," if plain.endswith(".csv") else csv.Sniffer().sniff(head, delimiters=",\t ;|").delimiter
            names = next(csv.reader([first], delimiter=sep))
            schema = ", ".join(f"`{n}` string" for n in names)
            if path.endswith(".bgz"):
                # Spark doesn't know the name's end; a list of samples' covariates is small
                raw = spark.createDataFrame(list(csv.reader(files.text_lines(path), delimiter=sep))[1:], schema)
            else:
                raw = spark.read.csv(path, schema=schema, sep=sep, header=True)
    except Exception as e:
        raise ValueError(f"Failed to read covariate file {path}: {e}") from e
    chosen = choose(raw, id_col, columns)
    names = [c for c in chosen.columns if c != "sample_id"]
    if not names:
        return chosen
    gone = lambda c: F.col(f"`{c}`").isin("", "NA", "NaN", "nan", "None", "null")
    odd = chosen.agg(*(F.count_if(F.col(f"`{c}`").isNotNull() & ~gone(c) & F.col(f"`{c}`").try_cast("double").isNull()).alias(f"k{k}") for k, c in enumerate(names))).first()
    values = [(F.when(~gone(c), F.col(f"`{c}`").try_cast("double")) if not odd[f"k{k}"] else F.when(~gone(c), F.col(f"`{c}`"))).alias(c) for k, c in enumerate(names)]
    return chosen.select("sample_id", *values)


def save_projection(p: Projection, path: str) -> str:
    """A folder of Parquet for Q and a JSON file, with .proj added to the name;
    for a name that ends with .npz, one file with arrays, Q gathered on the
    driver if it has no more than Q_BYTES."""
    if path.endswith(".npz"):
        if p.n_samples * len(p.names) * 8 > Q_BYTES:
            raise ValueError("Q is too large for one file; save it as a folder")
        rows = p.q.orderBy("sample_id").toPandas()
        out = io.BytesIO()
        q = np.stack(rows["q"].to_numpy()) if len(rows) else np.zeros((0, len(p.names)))
        np.savez_compressed(out, Q=q, sample_ids=np.array(rows["sample_id"].astype(str), "U"), n_covariates=len(p.names), covariate_names=np.array(p.names, "U"), **{f"metadata_{k}": v for k, v in p.metadata.items()})
        with files.writing(path) as f:
            f.write(out.getvalue())
        return path
    out = path if path.endswith(".proj") else path + ".proj"
    p.q.write.mode("overwrite").parquet(out)
    with files.writing(f"{out}/_about.json") as f:
        f.write(json.dumps({"format_version": VERSION, "names": p.names, "n_samples": p.n_samples, "metadata": p.metadata}).encode())
    return out


def load_projection(spark: SparkSession, path: str) -> Projection:
    """From save_projection's folder, or an .npz with Q, sample_ids and covariate_names."""
    if not path.endswith(".npz"):
        if not files.exists(f"{path}/_about.json"):
            raise FileNotFoundError(f"there is no projection at {path}")
        about = json.loads(files.read_all(f"{path}/_about.json"))
        return Projection(spark.read.parquet(path), about["names"], about["n_samples"], about["metadata"])
    if not files.exists(path):
        raise FileNotFoundError(f"there is no projection at {path}")
    with np.load(io.BytesIO(files.read_all(path)), allow_pickle=False) as z:
        q, ids = z["Q"], [str(x) for x in z["sample_ids"]]
        names = [str(x) for x in z["covariate_names"]] if "covariate_names" in z else [f"c{k}" for k in range(q.shape[1])]
        about = {k.removeprefix("metadata_"): str(z[k]) for k in z.files if k.startswith("metadata_")}
    rows = spark.createDataFrame(list(zip(ids, q.tolist(), strict=True)), "sample_id string, q array<double>")
    return Projection(rows, names, len(ids), about)
