"""Which variants: regions, index ranges, and variant lists (z-files).

An index has contig, position, ref, alt, idx; a list has ord, rsid, chromosome,
position, allele1 (ref) and allele2 (alt). Chromosomes are compared as text.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.region import Region, parse_region
from ..session import settled

log = logging.getLogger(__name__)

LIST_COLUMNS = ("rsid", "chromosome", "position", "allele1", "allele2")
ON_MISSING = ("warn", "error", "drop")


def in_region(index: DataFrame, region: str | Region) -> DataFrame:
    r = parse_region(region) if isinstance(region, str) else region
    return index.where((F.col("contig") == r.chrom) & F.col("position").between(r.start, r.end))


def in_range(index: DataFrame, start: int, stop: int) -> DataFrame:
    return index.where((F.col("idx") >= start) & (F.col("idx") < stop))


def _target(idx, chrom, pos, ref, alt, rsid, flipped, ord_):
    return [ord_.cast("long").alias("ord"), idx.cast("long").alias("idx"), chrom.alias("chrom"), pos.cast("int").alias("pos"), ref.alias("ref"), alt.alias("alt"), rsid.alias("rsid"), flipped.alias("flipped")]


def region_targets(index: DataFrame, region: str | Region) -> DataFrame:
    """Targets (ord, idx, chrom, pos, ref, alt, rsid, flipped) by ascending idx;
    ord is idx itself, as only its order counts. rsid is chrom:pos:ref:alt."""
    c = F.col
    rsid = F.concat_ws(":", c("contig"), c("position").cast("string"), c("ref"), c("alt"))
    return in_region(index, region).select(*_target(c("idx"), c("contig"), c("position"), c("ref"), c("alt"), rsid, F.lit(False), c("idx")))


def range_targets(index: DataFrame, start: int, stop: int) -> DataFrame:
    c = F.col
    rsid = F.concat(F.lit("idx_"), c("idx").cast("string"))
    return in_range(index, start, stop).select(*_target(c("idx"), c("contig"), c("position"), c("ref"), c("alt"), rsid, F.lit(False), c("idx")))


def placeholder_targets(spark, start: int, stop: int) -> DataFrame:
    """Targets of an index range where there is no index."""
    empty = F.lit("")
    rows = spark.range(start, stop).withColumnRenamed("id", "idx")
    return rows.select(*_target(F.col("idx"), empty, F.lit(0), empty, empty, F.concat(F.lit("idx_"), F.col("idx").cast("string")), F.lit(False), F.col("idx")))


def match(listed: DataFrame, index: DataFrame) -> DataFrame:
    """Listed variants found in the index by locus and alleles; swapped alleles
    match as well and are flipped. Of several, one in the listed orientation
    wins, then the lowest idx. One equi-join on the locus; the choice is a
    partial aggregate, so that loci with many rows need no sort."""
    same = (F.col("v.ref") == F.col("z.allele1")) & (F.col("v.alt") == F.col("z.allele2"))
    swapped = (F.col("v.ref") == F.col("z.allele2")) & (F.col("v.alt") == F.col("z.allele1"))
    locus = (F.col("v.contig") == F.col("z.chromosome")) & (F.col("v.position") == F.col("z.position"))
    met = listed.alias("z").join(index.alias("v"), locus & (same | swapped))
    best = met.groupBy("z.ord").agg(F.min(F.struct((~same).alias("flipped"), F.col("v.idx").alias("idx"))).alias("m"), *(F.first(f"z.{c}").alias(c) for c in LIST_COLUMNS))
    c = F.col
    return best.select(*_target(c("m.idx"), c("chromosome"), c("position"), c("allele1"), c("allele2"), c("rsid"), c("m.flipped"), c("ord")))


def unmatched(listed: DataFrame, targets: DataFrame) -> DataFrame:
    return listed.join(targets.select("ord"), "ord", "left_anti")


def list_targets(listed: DataFrame, index: DataFrame, on_missing: str = "warn") -> DataFrame:
    """match(), after what on_missing says of variants that are not found."""
    if on_missing not in ON_MISSING:
        raise ValueError(f"on_missing must be one of {ON_MISSING}")
    targets = match(listed, index)
    if on_missing != "drop":
        lost = unmatched(listed, targets)
        n = lost.count()
        if n:
            said = f"the matrix lacks {n} of the {listed.count()} listed variants"
            if on_missing == "error":
                raise ValueError(f"{said}: {[r['rsid'] for r in lost.orderBy('ord').limit(10).collect()]}")
            log.warning(said)
    return targets


def exact(listed: DataFrame, variants: DataFrame) -> DataFrame:
    """Variants (chrom, pos, ref, alt, ...) of the list in its orientation,
    with the list's ord: their order from here on."""
    on = (F.col("chrom") == F.col("z.chromosome")) & (F.col("pos") == F.col("z.position")) & (F.col("ref") == F.col("z.allele1")) & (F.col("alt") == F.col("z.allele2"))
    return variants.join(listed.alias("z").select("z.ord", "z.chromosome", "z.position", "z.allele1", "z.allele2"), on).drop("chromosome", "position", "allele1", "allele2")


def check_distinct(targets: DataFrame) -> None:
    twice = targets.groupBy("idx").count().where("count > 1").orderBy("idx").limit(10).collect()
    if twice:
        raise ValueError(f"rows of the matrix asked for more than once: {[r['idx'] for r in twice]}")


# --- variant lists -----------------------------------------------------------


def duplicates(listed: DataFrame) -> DataFrame:
    """One row: rows whose position and alleles occur more than once, rows whose
    position does, and how many rows repeat a position."""
    at = listed.groupBy("position", "allele1", "allele2").agg(F.count("*").alias("n"))
    by_position = at.groupBy("position").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("exact"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return by_position.agg(zero(F.sum("exact")).alias("n_exact"), zero(F.sum(F.when(F.col("n") > 1, F.col("n")))).alias("n_position"), zero(F.sum(F.col("n") - 1)).alias("n_repeats"))


def summary(listed: DataFrame) -> str:
    r = listed.agg(F.count("*").alias("n"), F.min("chromosome").alias("c"), F.min("position").alias("a"), F.max("position").alias("b")).first()
    if not r["n"]:
        return "Empty variant filter"
    return f"Variant filter: {r['n']} variants on chromosome {r['c']} (positions {r['a']:,} - {r['b']:,})"


def faults(listed: DataFrame) -> DataFrame:
    """One row of what check_list looks at: n_rows, n_chromosomes, bad_positions
    (not integers) and unsorted (rows below the row before). Orders are told by
    comparing neighbours' ord, by a join, so that no task holds the whole list."""
    rows = listed.select("ord", "chromosome", F.col("position").cast("string").try_cast("long").alias("p"))
    before = rows.select((F.col("ord") + 1).alias("ord"), F.col("p").alias("q"))
    met = rows.join(before, "ord", "left")
    return met.agg(
        F.count("*").alias("n_rows"), F.countDistinct("chromosome").alias("n_chromosomes"), F.count_if(F.col("p").isNull()).alias("bad_positions"), F.count_if(F.col("q") > F.col("p")).alias("unsorted")
    )


def check_list(listed: DataFrame) -> DataFrame:
    """The list with integer positions; ValueError if it breaks a rule. ord
    must count its rows without gaps."""
    lacking = [c for c in LIST_COLUMNS if c not in listed.columns]
    if lacking:
        raise ValueError(f"the variant list has no column {', '.join(lacking)}")
    f = faults(listed).first()
    if not f["n_rows"]:
        raise ValueError("the variant list is empty")
    if f["n_chromosomes"] > 1:
        raise ValueError("the variant list spans more than one chromosome; split it by chromosome")
    if f["bad_positions"]:
        raise ValueError("the variant list has positions that are no integers")
    if f["unsorted"]:
        raise ValueError("the variant list is out of order: positions must ascend")
    out = listed.withColumn("position", F.col("position").cast("int"))
    d = duplicates(out).first()
    if d["n_exact"]:
        log.warning("%d listed variants share position and alleles with another", d["n_exact"])
    if d["n_position"]:
        log.info("%d listed variants lie at positions that %d rows repeat", d["n_position"], d["n_repeats"])
    return out


def numbered(rows: DataFrame, *order: str, name: str = "ord") -> DataFrame:
    """Rows counted from 0 in an order. Each range partition counts its own, and
    sizes of the partitions before are added: a row per partition meets the
    driver, and no task sees all rows."""
    ranged = rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    ranged = settled(ranged)
    sizes = {r["__part"]: r["count"] for r in ranged.groupBy("__part").count().collect()}
    first, total = {}, 0
    for k in sorted(sizes):
        first[k] = total
        total += sizes[k]
    bases = F.create_map(*(F.lit(x) for kv in (first or {0: 0}).items() for x in kv))
    place = F.row_number().over(W.partitionBy("__part").orderBy(*order)) - 1
    return ranged.withColumn(name, (place + bases[F.col("__part")]).cast("long")).drop("__part")
