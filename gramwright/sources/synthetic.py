"""Made-up genotypes, covariates and variant lists for benchmarks, by seed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: samples, variants of the benchmark's configurations.
CONFIGURATIONS = {
    "tiny": (500, 500), "small": (1000, 1000), "medium": (5000, 5000), "large": (10_000, 10_000), "xlarge": (50_000, 10_000), "xxlarge": (100_000, 10_000),
    "wide": (10_000, 5000), "tall": (5000, 10_000), "extreme_wide": (20_000, 2000), "extreme_tall": (2000, 20_000),
}


def genotypes(spark: SparkSession, n_samples: int, n_variants: int, seed: int = 42) -> DataFrame:
    """Variant-major rows; each sample's three genotype probabilities are uniform
    on the simplex. A variant's draws depend on the seed and its number alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                p = np.random.default_rng([seed, k]).dirichlet([1.0, 1.0, 1.0], n_samples)
                yield pa.RecordBatch.from_pydict({
                    "variant_idx": pa.array([k], pa.int32()), "rsid": [f"rs{1_000_000 + k}"], "chrom": ["1"], "pos": pa.array([(k + 1) * 1000], pa.int32()),
                    "ref": ["A"], "alt": ["G"], "dosage": pa.array([p[:, 1] + 2 * p[:, 2]], pa.list_(pa.float64())),
                })

    return spark.range(n_variants).mapInArrow(run, "variant_idx int, rsid string, chrom string, pos int, ref string, alt string, dosage array<double>")


def covariates(spark: SparkSession, n_samples: int, components: int = 10, seed: int = 42) -> DataFrame:
    """IID, PC1.., age and sex."""
    columns = [F.randn(seed + k).alias(f"PC{k + 1}") for k in range(components)]
    age = (F.lit(18) + F.rand(seed + components) * 62).alias("age")
    sex = (F.rand(seed + components + 1) < 0.5).cast("int").alias("sex")
    return spark.range(n_samples).select(F.format_string("SAMPLE_%06d", "id").alias("IID"), *columns, age, sex)


def variant_list(genotypes: DataFrame, n_variants: int, share: float) -> DataFrame:
    """A contiguous list of a share of the variants, from the middle."""
    n = max(1, int(n_variants * share))
    first = (n_variants - n) // 2
    rows = genotypes.where((F.col("variant_idx") >= first) & (F.col("variant_idx") < first + n))
    return rows.select((F.col("variant_idx") - first).cast("long").alias("ord"), "rsid", F.col("chrom").alias("chromosome"), F.col("pos").alias("position"), F.col("ref").alias("allele1"), F.col("alt").alias("allele2"))
