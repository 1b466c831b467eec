"""BGEN files through their .bgi index: variants as rows with dosage arrays."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..codec import bgen as codec
from ..functions.region import Region, parse_region
from ..functions.triangle import merged
from ..session import settled
from . import files

SCHEMA = "variant_idx int, rsid string, chrom string, pos int, ref string, alt string, dosage array<double>"
#: Bytes of dosages that a task holds at once, and bytes between two variants read at once.
BATCH_BYTES, GAP = 16 << 20, 1 << 16
#: Listed variants up to which they are looked up in the index; beyond, all its rows are matched.
ASKED = 1 << 20
PLACES = "file_start_position long, size_in_bytes long, chromosome string, position int, rsid string, allele1 string, allele2 string"


def find_index(path: str, index_path: str | None = None) -> str:
    at = index_path or path + ".bgi"
    if not files.exists(at):
        raise FileNotFoundError(f"BGEN index not found: {at}")
    return at


def sample_ids(path: str, sample_path: str | None = None) -> list[str]:
    """From the .sample file (two header lines, first word) or the BGEN itself."""
    if sample_path:
        return [x.split()[0] for k, x in enumerate(files.text_lines(sample_path)) if k > 1 and x.strip()]
    header = header_of(path)
    return codec.read_samples(files.read_range(path, 0, header.offset), header)


def header_of(path: str) -> codec.Header:
    head = files.read_range(path, 0, 1 << 12)
    return codec.read_header(head)


def _index(path: str) -> sqlite3.Connection:
    """The index in memory: it may lie where sqlite can't open it."""
    db = sqlite3.connect(":memory:")
    db.deserialize(files.read_all(path))
    return db


def places(spark: SparkSession, path: str, index_path: str | None = None, region: str | Region | None = None, listed: list[tuple[str, int]] | None = None) -> DataFrame:
    """Where variants lie, from the index; a region, or a list of chromosomes and
    positions, is looked up in it."""
    db = _index(find_index(path, index_path))
    columns = "file_start_position, size_in_bytes, chromosome, position, rsid, allele1, allele2"
    where, values = "", ()
    if region is not None:
        r = parse_region(region) if isinstance(region, str) else region
        where, values = " WHERE chromosome = ? AND position BETWEEN ? AND ?", tuple(r)
    try:
        if listed is not None:
            db.execute("CREATE TEMP TABLE asked (chromosome TEXT, position INT, PRIMARY KEY (chromosome, position)) WITHOUT ROWID")
            db.executemany("INSERT OR IGNORE INTO asked VALUES (?, ?)", listed)
            where += " AND " if where else " WHERE "
            where += "(chromosome, position) IN (SELECT chromosome, position FROM asked)"
        rows = db.execute(f"SELECT {columns} FROM Variant{where} ORDER BY file_start_position", values).fetchall()
    finally:
        db.close()
    return spark.createDataFrame(rows, PLACES)


def read(spark: SparkSession, path: str, index_path: str | None = None, region: str | None = None, listed: DataFrame | None = None, keep: np.ndarray | None = None) -> DataFrame:
    """SCHEMA: variants of the region and of the list, in the list's order or
    the file's; dosages of the samples at the places in `keep`, or of all. Tasks
    read the byte ranges of their own variants."""
    from ..operators.selection import exact, numbered

    asked = None
    if listed is not None and listed.limit(ASKED + 1).count() <= ASKED:
        asked = [(r["chromosome"], r["position"]) for r in listed.select("chromosome", "position").collect()]
    found = places(spark, path, index_path, region, asked)
    if listed is not None:
        named = found.withColumnsRenamed({"chromosome": "chrom", "position": "pos", "allele1": "ref", "allele2": "alt"})
        found = exact(listed, named).withColumnsRenamed({"chrom": "chromosome", "pos": "position", "ref": "allele1", "alt": "allele2"})
    else:
        found = found.withColumn("ord", F.col("file_start_position"))
    rows = numbered(found, "ord", "file_start_position", name="variant_idx").select(F.col("variant_idx").cast("int").alias("variant_idx"), *PLACES.replace(" long", "").replace(" string", "").replace(" int", "").split(", "))
    header = header_of(path)
    most = max(1, BATCH_BYTES // (8 * max(1, header.n_samples if keep is None else len(keep))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # in the order of the file, neighbours by one read, a few variants at a time
            rows = sorted(batch.to_pylist(), key=lambda r: r["file_start_position"])
            for lo in range(0, len(rows), most):
                some = rows[lo : lo + most]
                at, size = (np.array([r[c] for r in some], np.int64) for c in ("file_start_position", "size_in_bytes"))
                starts, stops, which = merged(at, size, GAP)
                out = []
                for k, raw in enumerate(files.read_ranges(path, list(zip(starts.tolist(), stops.tolist(), strict=True)))):
                    for m in np.flatnonzero(which == k):
                        v, _ = codec.read_variant(raw, int(at[m] - starts[k]), header)
                        d = codec.dosages(raw[v.data_at : v.data_at + v.data_length], header)
                        out.append((some[m]["variant_idx"], v.rsid, v.chrom, v.pos, *v.alleles[:2], d if keep is None else d[keep]))
                columns = list(zip(*out, strict=True))
                kinds = [pa.int32(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.float64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k, from_pandas=False) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return rows.mapInArrow(run, SCHEMA)


def write(variants: DataFrame, samples: list[str], path: str) -> None:
    """variants (SCHEMA) as BGEN 1.2 with its index beside it, in the order of
    variant_idx. Tasks pack the variants; their blocks go through the driver to
    the file one after another, as a block's place follows from all before it."""
    n = len(samples)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(names.index("dosage"))
            known = batch.drop_columns(["dosage"])
            out = [codec.write_variant(r["rsid"], r["chrom"], r["pos"], r["ref"], r["alt"], lists[k].values.to_numpy(zero_copy_only=False)) for k, r in enumerate(known.to_pylist())]
            yield pa.RecordBatch.from_arrays([*known.columns, pa.array(out, pa.binary())], names=[*known.schema.names, "block"])

    names = SCHEMA.replace(" int", "").replace(" string", "").replace(" array<double>", "").split(", ")
    # packed once: counting, sorting and reading would each compute the variants again
    blocks = settled(variants.select(*names).mapInArrow(run, SCHEMA.replace("dosage array<double>", "block binary")))
    front = codec.write_front(blocks.count(), samples)
    at, places = len(front), []
    with files.writing(path) as f:
        f.write(front)
        for r in blocks.orderBy("variant_idx").toLocalIterator(prefetchPartitions=True):
            block = bytes(r["block"])
            places.append((r["chrom"], r["pos"], r["rsid"], 2, r["ref"], r["alt"], at, len(block)))
            f.write(block)
            at += len(block)
    db = sqlite3.connect(":memory:")
    db.execute("CREATE TABLE Variant (chromosome TEXT NOT NULL, position INT NOT NULL, rsid TEXT NOT NULL, number_of_alleles INT NOT NULL, allele1 TEXT NOT NULL, allele2 TEXT, file_start_position INT NOT NULL, size_in_bytes INT NOT NULL)")
    db.executemany("INSERT INTO Variant VALUES (?, ?, ?, ?, ?, ?, ?, ?)", places)
    db.execute("CREATE INDEX place ON Variant (chromosome, position)")
    db.commit()
    with files.writing(path + ".bgi") as f:
        f.write(db.serialize())
    db.close()
    if n and not places:
        raise ValueError("a BGEN file needs variants")
