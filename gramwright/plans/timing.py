"""Timed runs of the benchmark's configurations: covariates to a projection,
then genotypes, standardised and adjusted, to a stored matrix."""

from __future__ import annotations

import json
import time
from statistics import median

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators import covariates as cov
from ..operators import projection
from ..session import shared_path
from ..sources import bcor, bgen, files, synthetic, tables
from . import flows


def prepared(spark: SparkSession, n_samples: int, n_variants: int, share: float) -> dict[str, str]:
    """Files of made-up inputs: genotypes, their index, covariates, a list."""
    at = {k: shared_path(spark, k) for k in ("g.bgen", "c.tsv", "v.z", "q", "ld.bcor")}
    ids = [f"SAMPLE_{k:06d}" for k in range(n_samples)]
    rows = synthetic.genotypes(spark, n_samples, n_variants)
    bgen.write(rows, ids, at["g.bgen"])
    tables.write_list(synthetic.variant_list(rows.drop("dosage"), n_variants, share), at["v.z"])
    table = synthetic.covariates(spark, n_samples)
    with files.writing(at["c.tsv"]) as f:
        f.write(("\t".join(table.columns) + "\n").encode())
        for r in table.toLocalIterator():
            f.write(("\t".join(map(str, r)) + "\n").encode())
    return at


def once(spark: SparkSession, at: dict[str, str]) -> float:
    """Seconds of one run over prepared files."""
    began = time.perf_counter()
    stored = tables.save_projection(projection.basis(cov.one_hot(tables.covariates(spark, at["c.tsv"]))), at["q"])
    found = flows.load_and_adjust(spark, at["g.bgen"], projection_file=stored, z_file=at["v.z"], nan_action="mean")
    bcor.write(flows.gram_of(found), found.info, at["ld.bcor"], len(found.samples))
    return time.perf_counter() - began


def measure(spark: SparkSession, name: str, share: float = 0.5, runs: int = 3) -> dict:
    """A configuration's seconds, their median, and variants a second."""
    n_samples, n_variants = synthetic.CONFIGURATIONS[name]
    at = prepared(spark, n_samples, n_variants, share)
    seconds = [once(spark, at) for _ in range(runs)]
    middle = median(seconds)
    return {"config": name, "samples": n_samples, "variants": n_variants, "share": share, "seconds": seconds, "median": middle, "variants_per_s": n_variants * share / middle}


def save(results: list[dict], path: str) -> None:
    with files.writing(path) as f:
        f.write("".join(json.dumps(r) + "\n" for r in results).encode())


def load(spark: SparkSession, path: str):
    """Saved results as rows, a row per run: config, share, run, seconds, median."""
    rows = spark.read.schema("config string, share double, median double, seconds array<double>").json(path)
    return rows.select("config", "share", "median", F.posexplode("seconds").alias("run", "seconds"))
