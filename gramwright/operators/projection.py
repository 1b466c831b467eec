"""Projecting covariates out of standardised variants (Frisch-Waugh-Lovell).

The orthonormal basis comes from a tall-skinny QR: every batch of rows gives a
small triangle, the triangles are factored together, and a sample's row of Q is
its covariates times the inverse. Only triangles of covariates x covariates
reach the driver. Signs of Q's columns may differ from another QR's; what is
projected does not.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

log = logging.getLogger(__name__)

#: Diagonal elements of R up to this are dependent columns; for columns longer
#: than 1, this share of their length, as rounding grows with it.
INDEPENDENT = 1e-10
#: Bytes of Q up to which it is broadcast to joins.
BROADCAST_BYTES = 64 << 20


@dataclass
class Projection:
    """q: sample_id, q array<double>; names of the covariates used, the
    intercept last."""

    q: DataFrame
    names: list[str]
    n_samples: int
    metadata: dict[str, str] = field(default_factory=dict)


def _triangle(x: DataFrame, columns: list[str]) -> tuple[np.ndarray, int]:
    """R of the QR of the columns of x, and the number of rows."""
    n = len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, bad = np.zeros((0, n)), 0, 0
        for batch in batches:
            part = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(n)], 1)
            rows += len(part)
            bad += int(np.isnan(part).any(1).sum())
            held = np.linalg.qr(np.concatenate([held, np.nan_to_num(part)]), mode="r")
        yield pa.RecordBatch.from_pydict({"r": pa.array([held.tobytes()], pa.binary()), "rows": pa.array([rows], pa.int64()), "bad": pa.array([bad], pa.int64())})

    parts = x.select(*(F.col(f"`{c}`").cast("double") for c in columns)).mapInArrow(run, "r binary, rows long, bad long").collect()
    if sum(p["bad"] for p in parts):
        raise ValueError("Covariates contain NaN values")
    stacked = np.concatenate([np.zeros((0, n)), *(np.frombuffer(p["r"]).reshape(-1, n) for p in parts)])
    return np.linalg.qr(stacked, mode="r"), sum(p["rows"] for p in parts)


def basis(covariates: DataFrame) -> Projection:
    """covariates: sample_id and numeric columns (see covariates.one_hot). The
    intercept is added as the last column. Of dependent columns, those that
    come later go."""
    texts = [f.name for f in covariates.schema if f.name not in ("sample_id", "sample_pos") and f.dataType.simpleString() in ("string", "boolean")]
    if texts:
        raise ValueError(f"Covariates must be numeric; encode {texts} first")
    x = covariates.withColumn("intercept", F.lit(1.0))
    names = [c for c in x.columns if c not in ("sample_id", "sample_pos")]
    r, n = _triangle(x, names)
    if n <= len(names):
        raise ValueError(f"Number of samples ({n}) must be greater than number of covariates ({len(names)})")
    sizes = np.linalg.svd(r, compute_uv=False)
    if (sizes > sizes.max() * n * np.finfo(float).eps).sum() < len(names):
        keep = np.abs(np.diag(r)) > INDEPENDENT * np.maximum(1.0, np.linalg.norm(r, axis=0))
        if not keep.any():
            raise ValueError("All covariate columns are linearly dependent")
        log.warning("Covariates are rank deficient: using %d of %d columns", keep.sum(), len(names))
        names = [c for c, k in zip(names, keep, strict=True) if k]
        r, _ = _triangle(x, names)
    inverse = np.linalg.inv(r)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = np.stack([batch.column(k + 1).to_numpy(zero_copy_only=False) for k in range(len(names))], 1) @ inverse
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * len(names)), pa.array(part.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["sample_id", "q"])

    rows = x.select("sample_id", *(F.col(f"`{c}`").cast("double") for c in names))
    kind = covariates.schema["sample_id"].dataType.simpleString()
    return Projection(rows.mapInArrow(run, f"sample_id {kind}, q array<double>"), names, n, {"n_samples": str(n), "n_covariates_used": str(len(names))})


def check_compatible(projection: Projection, samples: DataFrame) -> None:
    """Every sample must have a row of Q."""
    lacking = samples.join(projection.q, "sample_id", "left_anti").limit(10).collect()
    if lacking:
        raise ValueError(f"Samples without a row in the projection: {[r['sample_id'] for r in lacking]}")


def project(z: DataFrame, projection: Projection) -> DataFrame:
    """sample_id, variant_idx, z -> the same, off the projection's basis. Values
    are not scaled again: diagonals of their Gram matrix end up below 1."""
    k = len(projection.names)
    q = projection.q
    if projection.n_samples * k * 8 <= BROADCAST_BYTES:
        q = F.broadcast(q)
    met = z.join(q, "sample_id")
    shares = met.groupBy("variant_idx").agg(F.array(*(F.sum(F.col("q")[c] * F.col("z")) for c in range(k))).alias("c"))
    fitted = F.aggregate(F.zip_with("q", "c", lambda a, b: a * b), F.lit(0.0), lambda t, x: t + x)
    return met.join(shares, "variant_idx").select("sample_id", "variant_idx", (F.col("z") - fitted).alias("z"))


def adjusted_by_sums(z: DataFrame, projection: Projection, ld: DataFrame) -> DataFrame:
    """The adjusted Gram matrix from the plain one: r_ij less the product of the
    two variants' shares in the basis. Residuals are never formed; the matrix
    of shares is variants x covariates."""
    k = len(projection.names)
    met = z.join(projection.q, "sample_id")
    shares = met.groupBy("variant_idx").agg(F.array(*(F.sum(F.col("q")[c] * F.col("z")) for c in range(k))).alias("c"))
    left, right = shares.select(F.col("variant_idx").alias("i"), F.col("c").alias("ci")), shares.select(F.col("variant_idx").alias("j"), F.col("c").alias("cj"))
    both = F.aggregate(F.zip_with("ci", "cj", lambda a, b: a * b), F.lit(0.0), lambda t, x: t + x)
    return ld.join(left, "i").join(right, "j").select("i", "j", (F.col("r") - both).alias("r"))
