"""The indexed binary store as a data source and a sink.

spark.read.format("bcor").option("table", ...): `corr` is the strict upper
triangle (i, j, r), cut into bands of rows; `diagonal`, `meta`, `header` and
`index` are small. Comparisons of i with constants leave out bands.
"""

from __future__ import annotations

import logging
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from ..codec import bcor as codec
from ..functions import triangle
from ..operators import lookup
from . import files

log = logging.getLogger(__name__)

SCHEMAS = {
    "corr": "i int, j int, r float",
    "diagonal": "i int, r float",
    "meta": "row int, rsid string, position int, chromosome string, allele1 string, allele2 string",
    "header": "n_samples long, n_variants long, compression int, extended boolean, file_size long, has_index boolean",
    "index": "row int, rsid string, meta_start long, meta_end long",
}
#: Codes of a band of rows.
BAND = 1 << 21
#: Meta records of a task.
META_ROWS = 1 << 18
#: Bytes between two asked codes up to which they are read at once.
GAP = 1 << 16
#: Pairs of a stretch of 2^22 bytes of a file are read by one task.
STRETCH_BITS = 22


def header_of(path: str) -> codec.Header:
    return codec.read_header(files.read_range(path, 0, codec.HEADER.size))


def index_of(path: str, header: codec.Header | None = None) -> codec.Index | None:
    """The index beside a store, if there is one that fits it."""
    if not files.exists(path + ".idx"):
        return None
    index = codec.read_index(files.read_all(path + ".idx"))
    if not index.fits(header or header_of(path), files.size(path)):
        log.warning("%s.idx was made for another file; ignored", path)
        return None
    return index


@dataclass
class Band(InputPartition):
    first: int
    last: int


class BcorReader(DataSourceReader):
    def __init__(self, path: str, table: str):
        self.path, self.table = path, table
        self.header = header_of(path)
        self.low, self.high = 0, self.header.n_variants - 1

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds on i; Spark still applies every filter."""
        for f in filters:
            at = getattr(f, "attribute", None)
            if at in (("i",), ("row",)):
                if isinstance(f, EqualTo):
                    self.low, self.high = max(self.low, f.value), min(self.high, f.value)
                elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.low = max(self.low, f.value + isinstance(f, GreaterThan))
                elif isinstance(f, (LessThan, LessThanOrEqual)):
                    self.high = min(self.high, f.value - isinstance(f, LessThan))
            yield f

    def partitions(self) -> list[InputPartition]:
        if self.table == "meta":
            cuts = [*range(max(self.low, 0), min(self.high + 1, self.header.n_variants), META_ROWS), min(self.high + 1, self.header.n_variants)]
            return [Band(a, b) for a, b in zip(cuts, cuts[1:], strict=False)] or [Band(0, 0)]
        if self.table != "corr":
            return [Band(0, self.header.n_variants)]
        n, out, first = self.header.n_variants, [], max(self.low, 0)
        last = min(self.high, n - 2)
        while first <= last:
            stop, codes = first, 0
            while stop <= last and (not codes or codes < BAND):
                codes += n - 1 - stop
                stop += 1
            out.append(Band(first, stop))
            first = stop
        return out or [Band(0, 0)]

    def read(self, part: Band) -> Iterator:
        return getattr(self, f"_{self.table}")(part)

    def _codes(self, start: int, count: int) -> np.ndarray:
        w = self.header.width
        raw = files.read_range(self.path, start, start + count * w)
        if len(raw) < count * w:
            raise ValueError(f"{self.path} is cut off")
        return codec.decode(np.frombuffer(raw, codec.TYPES[self.header.level]), w)

    def _corr(self, part: Band) -> Iterator[pa.RecordBatch]:
        n = self.header.n_variants
        rows = np.arange(part.first, part.last)
        if not len(rows):
            return
        at = rows * n - rows * (rows + 1) // 2
        r = self._codes(self.header.triangle_at + int(at[0]) * self.header.width, int((n - 1 - rows).sum()))
        i = np.repeat(rows, n - 1 - rows)
        j = np.arange(len(i)) - np.repeat(at - at[0], n - 1 - rows) + i + 1
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(r, pa.float32(), from_pandas=False)], names=["i", "j", "r"])

    def _diagonal(self, part: Band) -> Iterator[tuple]:
        n = self.header.n_variants
        values = self._codes(self.header.codes_at, n) if self.header.extended else np.ones(n, np.float32)
        yield from ((k, float(x)) for k, x in enumerate(values))

    def _meta(self, part: Band) -> Iterator[tuple]:
        """With an index, records of the part's rows alone; else all, as only
        each record tells where the next one begins."""
        if part.first == part.last:
            return
        index = index_of(self.path, self.header)
        if index is None:
            block = files.read_range(self.path, codec.HEADER.size, self.header.codes_at)
            records = codec.split_meta(block, self.header.n_variants)[part.first : part.last]
        else:
            lo, hi = int(index.offsets[part.first]), int(index.offsets[part.last])
            records = codec.split_meta(files.read_range(self.path, lo, hi), part.last - part.first)
        for k, record in enumerate(records):
            yield (part.first + k, *codec.read_meta(record)[1:])

    def _header(self, part: Band) -> Iterator[tuple]:
        h = self.header
        yield h.n_samples, h.n_variants, h.level, h.extended, h.file_size, index_of(self.path, h) is not None

    def _index(self, part: Band) -> Iterator[tuple]:
        index = index_of(self.path, self.header)
        if index is None:
            raise RuntimeError(f"{self.path} has no index")
        yield from ((k, x, *index.record_range(k)) for k, x in enumerate(index.rsids))


class BcorWriter(DataSourceArrowWriter):
    """df.write.format("bcor").mode("append"): cells i, j, r of the upper triangle,
    in any order and from any number of tasks. The driver makes the file with
    every code missing; each cell's place follows from i and j, so that tasks
    write to places of their own, and again if they are run again. Options:
    n_variants, n_samples, level, extended (a stored diagonal), and info, a
    tab-separated file with columns rsid, chrom, pos, ref, alt."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.place = files.local(self.path)
        if self.place is None:
            raise ValueError("tasks can't write to places of this file; use write()")
        n, level, extended = int(options["n_variants"]), int(options.get("level", "1")), options.get("extended", "false").lower() == "true"
        names = _info_rows(options["info"]) if "info" in options else [(f"variant_{k}", "1", k + 1, "A", "T") for k in range(n)]
        if len(names) != n:
            raise ValueError(f"{len(names)} variants are named, {n} were announced")
        records = [codec.meta_record(k, *r) for k, r in enumerate(names)]
        self.header = codec.make_header(int(options.get("n_samples", "1000")), n, level, sum(map(len, records)), extended)
        with files.writing(self.path) as f:
            f.write(self.header.pack() + b"".join(records))
            left = (self.header.file_size - self.header.codes_at) // self.header.width
            gone = codec.encode(np.array([np.nan]), self.header.width).tobytes()
            while left:
                some = min(left, BAND)
                f.write(gone * some)
                left -= some

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        n, w = self.header.n_variants, self.header.width
        with open(self.place, "r+b") as f:
            for batch in iterator:
                i, j = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("i", "j"))
                codes = codec.encode(batch.column(batch.schema.get_field_index("r")).to_numpy(zero_copy_only=False).astype(float), w)
                lo, hi = np.minimum(i, j), np.maximum(i, j)
                at = np.where(lo < hi, self.header.triangle_at + (lo * n - lo * (lo + 1) // 2 + hi - lo - 1) * w, self.header.codes_at + lo * w)
                keep = np.flatnonzero((lo < hi) | self.header.extended)
                order = keep[np.argsort(at[keep], kind="stable")]
                at, codes = at[order], codes[order]
                for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(at) != w) + 1):
                    if len(part):
                        f.seek(int(at[part[0]]))
                        f.write(codes[part].tobytes())
        return WriterCommitMessage()

    def commit(self, messages: list) -> None:
        pass

    def abort(self, messages: list) -> None:
        """A store without all its cells is no store."""
        os.remove(self.place)


def _info_rows(path: str) -> list[tuple]:
    lines = (x.rstrip("\n").split("\t") for x in files.text_lines(path))
    names = next(lines)
    at = [names.index(c) for c in ("rsid", "chrom", "pos", "ref", "alt")]
    return [(r[at[0]], r[at[1]], int(r[at[2]]), r[at[3]], r[at[4]]) for r in lines]


class BcorSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bcor"

    def _table(self) -> str:
        table = self.options.get("table", "corr")
        if table not in SCHEMAS:
            raise ValueError(f"table must be one of {sorted(SCHEMAS)}")
        return table

    def schema(self) -> str:
        return SCHEMAS[self._table()]

    def reader(self, schema) -> DataSourceReader:
        return BcorReader(self.options["path"], self._table())

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return BcorWriter(dict(self.options))


def table(spark: SparkSession, path: str, name: str = "corr") -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BcorSource)
    return spark.read.format("bcor").option("table", name).load(path)


def _at_offsets(pairs: DataFrame, path: str, header: codec.Header, gap: int = GAP) -> DataFrame:
    """pairs: a, b, i, j -> a, b, r. Pairs are dealt by the stretch of the file
    that they lie in, and a task reads what its pairs need, near ones at once."""
    w, n = header.width, header.n_variants
    off = F.lit(header.triangle_at) + triangle.place(F.col("i"), F.col("j"), n) * w
    on = F.lit(header.codes_at) + F.col("i").cast("long") * w if header.extended else F.lit(None).cast("long")
    placed = pairs.select("a", "b", F.when(F.col("i") == F.col("j"), on).otherwise(off).alias("offset"))

    def read(table: pa.Table) -> pa.Table:
        offset = table.column("offset")
        r = np.ones(table.num_rows, np.float32)
        stored = np.flatnonzero(offset.is_valid().to_numpy())
        at, back = np.unique(offset.drop_null().to_numpy(), return_inverse=True)
        starts, stops, which = triangle.merged(at, np.full(len(at), w), gap)
        found = np.zeros(len(at), codec.TYPES[header.level])
        for k, raw in enumerate(files.read_ranges(path, list(zip(starts.tolist(), stops.tolist(), strict=True)))):
            mine = which == k
            rows = np.frombuffer(raw, np.uint8)[(at[mine] - starts[k])[:, None] + np.arange(w)]
            found[mine] = np.ascontiguousarray(rows).view(codec.TYPES[header.level])[:, 0]
        r[stored] = codec.decode(found, w)[back]
        return pa.table({"a": table.column("a"), "b": table.column("b"), "r": pa.array(r, from_pandas=False)})

    return placed.groupBy(F.shiftright(F.coalesce("offset", F.lit(0)), STRETCH_BITS).alias("stretch")).applyInArrow(read, "a long, b long, r float")


def read_by_rsid(spark: SparkSession, path: str, rsids: list[str], rsids2: list[str] | None = None, missing: str = "raise") -> tuple[DataFrame, DataFrame]:
    """(a, b, r) for the lists, and the meta rows of the first (with ord). Of the
    store, only its header, the asked records and the asked codes are read; of
    the index beside it, all."""
    header = header_of(path)
    index = index_of(path, header)
    if index is None:
        raise RuntimeError(f"{path} has no index; make one first")
    place = {x: k for k, x in enumerate(index.rsids)}

    def resolved(names: list[str]) -> list[tuple[int, str, int]]:
        if missing not in lookup.MISSING:
            raise ValueError(f"missing must be one of {lookup.MISSING}")
        lost = [x for x in names if x not in place]
        if lost and missing == "raise":
            raise KeyError(f"rsids not found: {lost[:10]}")
        if lost and missing == "warn":
            log.warning("%d rsids not found", len(lost))
        return [(k, x, place[x]) for k, x in enumerate(names) if x in place]

    left = resolved(rsids)
    right = left if rsids2 is None else resolved(rsids2)
    records = records_of(path, index, [row for _, _, row in left])
    asked = lambda rows, name, at: spark.createDataFrame(rows, f"{name} long, rsid string, {at} int").drop("rsid")
    pairs = asked(left, "a", "i").crossJoin(asked(right, "b", "j"))  # the grid that is returned
    meta = spark.createDataFrame([(row, k, name, *records[row]) for k, name, row in left], "row int, ord long, rsid string, position int, chromosome string, allele1 string, allele2 string")
    return _at_offsets(pairs, path, header), meta.orderBy("ord")


def records_of(path: str, index: codec.Index, rows: list[int], gap: int = GAP) -> dict[int, tuple]:
    """(position, chromosome, allele1, allele2) of the rows, by ranged reads."""
    at = np.unique(np.array(rows, np.int64))
    begin, end = index.offsets[at].astype(np.int64), index.offsets[at + 1].astype(np.int64)
    starts, stops, which = triangle.merged(begin, end - begin, gap)
    raw = list(files.read_ranges(path, list(zip(starts.tolist(), stops.tolist(), strict=True))))
    return {int(k): codec.read_meta(raw[w][b - starts[w] : e - starts[w]])[2:] for k, b, e, w in zip(at, begin, end, which, strict=True)}


def full_matrix(spark: SparkSession, path: str) -> DataFrame:
    """i, j, r both ways, with the diagonal."""
    half = table(spark, path)
    return half.union(half.select("j", "i", "r")).union(table(spark, path, "diagonal").select("i", F.col("i").alias("j"), "r"))


def _bands(n: int) -> np.ndarray:
    """First rows of bands of about BAND codes, and n."""
    rows = np.arange(n + 1, dtype=np.int64)
    codes = rows * n - rows * (rows + 1) // 2  # before each row
    return np.unique(np.append(np.searchsorted(codes, np.arange(0, max(codes[-1], 1), BAND), side="right") - 1, n))


def write(ld: DataFrame, info: DataFrame | None, path: str, n_samples: int = 1000, level: int = 1, write_index: bool = True, n_variants: int | None = None) -> None:
    """ld: upper triangle i, j, r (pairs it lacks are NaN); info: variant_idx,
    rsid, chrom, pos, ref, alt, or None for made-up names.

    The place of every code is known beforehand. In a folder that tasks can
    write to (a path, or file:), each task encodes bands of rows and writes them
    to their places, again if it is run again; a store that takes streams alone
    gets the bands through the driver, one after another."""
    if not 0 <= level < 4:
        raise ValueError("compression must be 0, 1, 2 or 3")
    spark = ld.sparkSession
    if info is not None:
        rows = [(r["rsid"], r["chrom"], r["pos"], r["ref"], r["alt"]) for r in info.orderBy("variant_idx").toLocalIterator()]
    else:
        top = ld.agg(F.max("j")).first()[0]
        n = n_variants if n_variants is not None else 0 if top is None else top + 1
        rows = [(f"variant_{k}", "1", k + 1, "A", "T") for k in range(n)]
    n, width = len(rows), codec.WIDTHS[level]
    records = [codec.meta_record(k, *r) for k, r in enumerate(rows)]
    diagonal = np.full(n, np.nan)
    for r in ld.where("i = j").select("i", "r").toLocalIterator():
        diagonal[r["i"]] = r["r"]
    extended = not np.allclose(diagonal, 1.0, rtol=1e-9, atol=1e-9)
    header = codec.make_header(n_samples, n, level, sum(map(len, records)), extended)
    cuts = _bands(n)
    place = files.local(path)

    def run(table: pa.Table) -> pa.Table:
        band = table.column("band")[0].as_py()
        lo, hi = int(cuts[band]), int(cuts[band + 1])
        begin = lambda i: i * n - i * (i + 1) // 2
        values = np.full(begin(hi) - begin(lo), np.nan)
        i, j, r = (table.column(c) for c in ("i", "j", "r"))
        some = i.is_valid().to_numpy()
        i, j = (x.fill_null(0).to_numpy().astype(np.int64)[some] for x in (i, j))
        values[begin(i) - begin(lo) + j - i - 1] = r.to_numpy()[some]
        data = codec.encode(values, width).tobytes()
        if place is not None:
            with open(place, "r+b") as f:
                f.seek(header.triangle_at + begin(lo) * width)
                f.write(data)
            data = b""
        return pa.table({"band": pa.array([band], pa.int32()), "codes": pa.array([data], pa.binary())})

    band = lambda at: F.expr("cast(0 as int)") if len(cuts) <= 2 else sum((F.when(at >= int(c), 1).otherwise(0) for c in cuts[1:-1]), F.lit(0))
    if len(cuts) > 64:  # a list of bands is looked up, not spelt out
        edges = F.array(*(F.lit(int(c)) for c in cuts[1:-1]))
        band = lambda at: F.size(F.filter(edges, lambda c: c <= at))
    every = spark.range(max(len(cuts) - 1, 0)).select(F.col("id").cast("int").alias("band"), F.lit(None).cast("int").alias("i"), F.lit(None).cast("int").alias("j"), F.lit(None).cast("double").alias("r"))
    cells = ld.where("i < j").select(band(F.col("i")).cast("int").alias("band"), "i", "j", F.col("r").cast("double").alias("r"))
    written = cells.union(every).groupBy("band").applyInArrow(run, "band int, codes binary")
    front = header.pack() + b"".join(records) + (codec.encode(diagonal, width).tobytes() if extended else b"")
    if place is not None:
        with files.writing(path) as f:
            f.write(front)
        os.truncate(place, header.file_size)
        if written.where("codes <> X''").count():
            raise RuntimeError("a band was not written")
    else:
        with files.writing(path) as f:
            f.write(front)
            for r in written.orderBy("band").toLocalIterator():
                f.write(bytes(r["codes"]))
    if write_index:
        offsets = np.cumsum([codec.HEADER.size, *map(len, records)]).tolist()
        with files.writing(path + ".idx") as f:
            f.write(codec.make_index([r[0] for r in rows], offsets, header))


def make_index(path: str, force: bool = False) -> str:
    """Writes the index of an existing store."""
    out = path + ".idx"
    if files.exists(out) and not force:
        raise FileExistsError(out)
    header = header_of(path)
    try:
        records = codec.split_meta(files.read_range(path, codec.HEADER.size, header.codes_at), header.n_variants)
    except ValueError as e:
        raise RuntimeError(f"{path}: {e}") from e
    offsets = np.cumsum([codec.HEADER.size, *map(len, records)]).tolist()
    with files.writing(out) as f:
        f.write(codec.make_index([codec.read_meta(r)[1] for r in records], offsets, header))
    return out
