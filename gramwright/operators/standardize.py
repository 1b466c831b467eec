"""Missing dosages, centring and scaling, on long rows (sample_id, variant_idx,
dosage) and on variant-major arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NAN_ACTIONS = ("error", "mean", "omit")


def resolve_missing(dosage: DataFrame, action: str = "error") -> DataFrame:
    """Null or NaN dosages: raise, take the variant's mean, or leave out every
    sample that has any."""
    if action not in NAN_ACTIONS:
        raise ValueError(f"nan_action must be one of {NAN_ACTIONS}")
    value = F.when(~F.isnan("dosage"), F.col("dosage"))
    clean = dosage.withColumn("dosage", value)
    if action == "error":
        if clean.where("dosage is null").limit(1).count():
            raise ValueError("Genotypes contain NaN values; choose nan_action 'mean' or 'omit'")
        return clean
    if action == "mean":
        means = clean.groupBy("variant_idx").agg(F.avg("dosage").alias("__mean"))
        return clean.join(means, "variant_idx").withColumn("dosage", F.coalesce("dosage", "__mean")).drop("__mean")
    gone = clean.where("dosage is null").select("sample_id").distinct()
    return clean.join(gone, "sample_id", "left_anti")


def _stats(dosage: DataFrame) -> DataFrame:
    """All that standardising needs, in one aggregate. The variance is updated
    value by value (no difference of large sums), so no second pass is needed."""
    x = F.col("dosage")
    flat = F.min("dosage") == F.max("dosage")
    return dosage.groupBy("variant_idx").agg(F.avg("dosage").alias("mean"), flat.alias("__flat"), F.sqrt(F.var_pop("dosage") * F.count("dosage")).alias("__centred"), F.sqrt(F.sum(x * x)).alias("__raw"))


def _length(length: str) -> Column:
    return F.when(F.col(length) == 0, 1.0).otherwise(F.col(length))


def variant_stats(dosage: DataFrame) -> DataFrame:
    """variant_idx, mean, norm: the norm is the centred column's length, 1 for
    a constant variant."""
    return _stats(dosage).select("variant_idx", "mean", F.when(F.col("__flat"), 1.0).otherwise(_length("__centred")).alias("norm"), "__flat")


def standardize(dosage: DataFrame, center: bool = True, scale: bool = True) -> DataFrame:
    """sample_id, variant_idx, z. A constant variant becomes all zeros when
    centred; NaN spreads over its variant."""
    value = F.col("dosage")
    if center:
        value = F.when(F.col("__flat"), 0.0).otherwise(value - F.col("mean"))
    if scale:
        value = value / _length("__centred" if center else "__raw")
    return dosage.join(_stats(dosage), "variant_idx").select("sample_id", "variant_idx", value.alias("z"))


def standardize_rows(variants: DataFrame, q: np.ndarray | None = None, center: bool = True, scale: bool = True) -> DataFrame:
    """variants has variant_idx and dosage array<double> in one sample order;
    dosage is replaced by z, projected off the orthonormal columns of q if it
    is given. Row by row: nothing is shuffled."""
    sent = variants.sparkSession.sparkContext.broadcast(None if q is None else np.ascontiguousarray(q))
    names = variants.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(names.index("dosage"))
            if not len(rows):
                yield batch
                continue
            g = rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)
            z = standardize_array(g.T, center, scale)[0].T
            if sent.value is not None:
                z = z - (z @ sent.value) @ sent.value.T
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * z.shape[1]), pa.array(np.ascontiguousarray(z).ravel()))
            yield pa.RecordBatch.from_arrays([flat if n == "dosage" else batch.column(i) for i, n in enumerate(names)], names=names)

    return variants.mapInArrow(run, variants.schema)


def standardize_array(g: np.ndarray, center: bool = True, scale: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """samples x variants -> (z, means, norms)."""
    g = np.asarray(g, float)
    means = g.mean(0) if center else np.zeros(g.shape[1])
    z = g - means
    if center:
        z[:, g.min(0) == g.max(0)] = 0.0
    norms = np.sqrt(np.einsum("ij,ij->j", z, z)) if scale else np.ones(g.shape[1])
    norms[norms == 0] = 1.0
    return z / norms, means, norms
