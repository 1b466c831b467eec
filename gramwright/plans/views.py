"""Genotype tables derived from the star schema, for queries and their SQL.

dosage: how many of a customer's order lines have each of 16 part groups, at
most 2. An index of variants comes from part; a list of variants from it, some
swapped and some shifted out of reach. The SQL texts say the same for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VARIANTS = 16
BAND = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dosage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines are counted per order first, which needs no customer; zeros are
    filled in by the customer's own row, from a map of what was counted."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", (F.col("l_partkey") % VARIANTS).cast("int").alias("v")).agg(F.count("*").alias("n"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    counted = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey").agg(*(F.sum(F.when(F.col("v") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in range(VARIANTS)))
    wide = table(spark, sf_dir, "customer").select("c_custkey").join(counted, F.col("c_custkey") == F.col("o_custkey"), "left")
    values = F.array(*(F.least(F.coalesce(F.col(f"n{k}"), F.lit(0)), F.lit(2)).cast("double") for k in range(VARIANTS)))
    return wide.select(F.col("c_custkey").alias("sample_id"), F.posexplode(values).alias("variant_idx", "dosage"))


def covariates(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("sample_id"), *columns)


def variant_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = lambda k: F.substring(F.lit("ACGT"), 1 + (F.col("p_size") + k) % 4, F.lit(1))
    return table(spark, sf_dir, "part").select(
        F.floor(1 + F.col("p_partkey") / 100).cast("int").cast("string").alias("contig"), (F.col("p_partkey") * 10 + 10).cast("int").alias("position"),
        base(0).alias("ref"), base(1).alias("alt"), F.col("p_partkey").cast("int").alias("idx"),
    )


def variant_list(index: DataFrame) -> DataFrame:
    """From the first 16 of the index: odd ones swapped, each fifth shifted, each
    seventh left out. ord counts from 1 and follows from idx alone."""
    idx = F.col("idx")
    odd = idx % 2 == 1
    return index.where((idx < VARIANTS) & (idx % 7 != 6)).select(
        (idx + 1 - F.floor((idx + 1) / 7)).cast("int").alias("ord"), F.concat(F.lit("rs"), idx.cast("string")).alias("rsid"), F.col("contig").alias("chromosome"),
        (F.col("position") + F.when(idx % 5 == 4, 1).otherwise(0)).alias("position"), F.when(odd, F.col("alt")).otherwise(F.col("ref")).alias("allele1"), F.when(odd, F.col("ref")).otherwise(F.col("alt")).alias("allele2"),
    )


def whole_list(index: DataFrame) -> DataFrame:
    """The same of the whole index, nothing left out."""
    idx = F.col("idx")
    odd = idx % 2 == 1
    return index.select(
        (idx + 1).cast("int").alias("ord"), F.concat(F.lit("rs"), idx.cast("string")).alias("rsid"), F.col("contig").alias("chromosome"), (F.col("position") + F.when(idx % 5 == 4, 1).otherwise(0)).alias("position"),
        F.when(odd, F.col("alt")).otherwise(F.col("ref")).alias("allele1"), F.when(odd, F.col("ref")).otherwise(F.col("alt")).alias("allele2"),
    )


SQL = {
    "dosage": """dosage as (
  select c.c_custkey as sample_id, v.variant_idx, cast(least(2, coalesce(g.n, 0)) as double) as dosage
  from customer c cross join (select distinct cast(p_partkey % 16 as int) as variant_idx from part) v
  left join (select o_custkey as s, cast(l_partkey % 16 as int) as variant_idx, count(*) as n
             from lineitem join orders on l_orderkey = o_orderkey group by 1, 2) g
    on g.s = c.c_custkey and g.variant_idx = v.variant_idx)""",
    "vindex": """vindex as (
  select cast(cast(1 + floor(p_partkey / 100.0) as int) as varchar) as contig, cast(p_partkey * 10 + 10 as int) as position,
         substr('ACGT', cast(1 + p_size % 4 as int), 1) as ref, substr('ACGT', cast(1 + (p_size + 1) % 4 as int), 1) as alt, cast(p_partkey as int) as idx
  from part)""",
    "zfile": """zfile as (
  select cast(row_number() over (order by idx) as int) as ord, concat('rs', cast(idx as varchar)) as rsid, contig as chromosome,
         case when idx % 5 = 4 then position + 1 else position end as position,
         case when idx % 2 = 0 then ref else alt end as allele1, case when idx % 2 = 0 then alt else ref end as allele2
  from vindex where idx < 16 and idx % 7 <> 6)""",
    "zlist": """zlist as (
  select idx + 1 as ord, concat('rs', cast(idx as varchar)) as rsid, contig as chromosome,
         case when idx % 5 = 4 then position + 1 else position end as position,
         case when idx % 2 = 0 then ref else alt end as allele1, case when idx % 2 = 0 then alt else ref end as allele2
  from vindex)""",
    "std": """std as (
  select sample_id, variant_idx, case when nrm = 0 then cast(0 as double) else gc / nrm end as z
  from (select sample_id, variant_idx, gc, sqrt(sum(gc * gc) over (partition by variant_idx)) as nrm
        from (select sample_id, variant_idx, dosage - avg(dosage) over (partition by variant_idx) as gc from dosage) a) b)""",
    "ld": """ld as (
  select a.variant_idx as i, b.variant_idx as j, sum(a.z * b.z) as r
  from std a join std b on a.sample_id = b.sample_id and a.variant_idx <= b.variant_idx group by 1, 2)""",
    "store": "store as (select i, j, r from ld where j - i <= 8)",
}


def with_views(*names: str) -> str:
    return "with " + ",\n".join(SQL[n] for n in names)
