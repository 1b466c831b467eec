"""The indexed binary store of correlations: bytes to values and back.

File: magic (7) | file size u64 | samples u32 | variants u32 | level u8 | place
of the codes u64 | meta records | diagonal codes if the magic is EXTENDED |
codes of the strict upper triangle, row by row. All little-endian.

Meta record: length of what follows u32 | row u32 | rsid u16+ | position u32 |
chromosome u16+ | allele1 u32+ | allele2 u32+ (x+ is a length of that type and
as many bytes of UTF-8).

Index, a file beside it: magic (8) | version u32 | variants u32 | flags u32 |
start of the meta records u32 | file size u64 | place of the codes u64 | rsid
offsets u32[n + 1] | meta offsets u64[n + 1] | rsids.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.quantise import WIDTHS, missing, shift

# Fixed values of the format.
STANDARD, EXTENDED = b"bcor1.1", b"bcor1.x"
HEADER = struct.Struct("<7sQIIBQ")
INDEX_MAGIC, INDEX_VERSION = b"bcoridx1", 1
INDEX_HEADER = struct.Struct("<8sIIIIQQ")
TYPES = ("<u1", "<u2", "<u4", "<u8")


@dataclass(frozen=True)
class Header:
    extended: bool
    file_size: int
    n_samples: int
    n_variants: int
    level: int
    codes_at: int

    @property
    def width(self) -> int:
        return WIDTHS[self.level]

    @property
    def triangle_at(self) -> int:
        return self.codes_at + self.extended * self.n_variants * self.width

    def pack(self) -> bytes:
        return HEADER.pack(EXTENDED if self.extended else STANDARD, self.file_size, self.n_samples, self.n_variants, self.level, self.codes_at)


def make_header(n_samples: int, n_variants: int, level: int, meta_size: int, extended: bool) -> Header:
    if not 0 <= level < len(WIDTHS):
        raise ValueError(f"compression must be 0, 1, 2 or 3, not {level}")
    n_codes = n_variants * (n_variants - 1) // 2 + extended * n_variants
    codes_at = HEADER.size + meta_size
    return Header(extended, codes_at + n_codes * WIDTHS[level], n_samples, n_variants, level, codes_at)


def read_header(data: bytes) -> Header:
    if len(data) < HEADER.size:
        raise ValueError("bcor header is cut off")
    magic, *rest = HEADER.unpack_from(data)
    if magic not in (STANDARD, EXTENDED):
        raise ValueError(f"not a bcor file (magic {magic!r})")
    if rest[3] >= len(WIDTHS):
        raise ValueError(f"unknown bcor compression {rest[3]}")
    return Header(magic == EXTENDED, *rest)


def encode(r: np.ndarray, width: int) -> np.ndarray:
    """Codes: truncated, held below the missing code; NaN is the missing code."""
    r = np.asarray(r, float)
    gone = np.isnan(r)
    scaled = np.maximum((np.where(gone, 0, r) + 1) * float(shift(width)), 0)
    top = missing(width)
    high = scaled >= float(top)
    codes = np.where(high, 0, np.minimum(scaled, float(top - 1) if width < 8 else scaled)).astype(np.uint64)
    codes[high] = top - 1
    codes[gone] = top
    return codes.astype(TYPES[WIDTHS.index(width)])


def decode(codes: np.ndarray, width: int) -> np.ndarray:
    out = np.ldexp(codes.astype(float), -(8 * width - 2)) - 1
    out[codes == missing(width)] = np.nan
    return out.astype(np.float32)


def meta_record(row: int, rsid: str, chrom: str, pos: int, ref: str, alt: str) -> bytes:
    parts = [x.encode() for x in (rsid, chrom, ref, alt)]
    out = struct.pack("<IIH", 20 + sum(map(len, parts)), row, len(parts[0])) + parts[0]
    out += struct.pack("<IH", pos, len(parts[1])) + parts[1]
    return out + b"".join(struct.pack("<I", len(p)) + p for p in parts[2:])


def read_meta(record: bytes) -> tuple[int, str, int, str, str, str]:
    """(row, rsid, position, chromosome, allele1, allele2) of exactly one record."""
    view = memoryview(record)
    if len(view) < 8:
        raise ValueError("bcor meta record is cut off")
    length, row = struct.unpack_from("<II", view)
    if len(view) != length + 4:
        raise ValueError(f"bcor meta record has {len(view)} bytes, not {length + 4}")
    at = 8

    def take(kind: str) -> int:
        nonlocal at
        try:
            (value,) = struct.unpack_from(kind, view, at)
        except struct.error:
            raise ValueError("bcor meta record is cut off") from None
        at += struct.calcsize(kind)
        return value

    def text(kind: str) -> str:
        nonlocal at
        n = take(kind)
        if at + n > len(view):
            raise ValueError("bcor meta record is cut off")
        at += n
        return bytes(view[at - n : at]).decode()

    rsid, pos, chrom, a1, a2 = text("<H"), take("<I"), text("<H"), text("<I"), text("<I")
    if at != len(view):
        raise ValueError(f"bcor meta record has {len(view) - at} bytes too many")
    return row, rsid, pos, chrom, a1, a2


def split_meta(block: bytes, n: int) -> list[bytes]:
    """The n records of the meta block, which they must fill."""
    out, at = [], 0
    for _ in range(n):
        if at + 4 > len(block):
            raise ValueError("bcor meta block is cut off")
        end = at + 4 + struct.unpack_from("<I", block, at)[0]
        out.append(block[at:end])
        at = end
    if at != len(block):
        raise ValueError("bcor meta block doesn't end where the codes begin")
    return out


def meta_offsets(meta: DataFrame) -> DataFrame:
    """row, start, stop of each meta record (row, rsid, chrom, ref, alt) in the
    file. Lengths are summed within stretches of 65536 rows; only the stretches'
    sums meet in one task."""
    sizes = [F.octet_length(c) for c in ("rsid", "chrom", "ref", "alt")]
    length = (F.lit(24) + sizes[0] + sizes[1] + sizes[2] + sizes[3]).cast("long")
    rows = meta.select("row", length.alias("n"), F.shiftright("row", 16).alias("part"))
    base = rows.groupBy("part").agg(F.sum("n").alias("size")).withColumn("base", F.sum("size").over(W.orderBy("part")) - F.col("size")).select("part", "base")
    upto = F.sum("n").over(W.partitionBy("part").orderBy("row").rowsBetween(W.unboundedPreceding, 0))
    placed = rows.withColumn("upto", upto).join(base, "part")
    stop = (F.col("base") + F.col("upto") + HEADER.size).cast("long")
    return placed.select("row", (stop - F.col("n")).alias("start"), stop.alias("stop"))


def make_index(rsids: list[str], offsets: list[int], header: Header) -> bytes:
    """offsets: n + 1 places of meta records, the last where the codes begin."""
    if len(offsets) != len(rsids) + 1:
        raise ValueError("an index needs one offset more than variants")
    if offsets[0] != HEADER.size or offsets[-1] != header.codes_at:
        raise ValueError("meta offsets must begin after the header and end at the codes")
    if any(b < a for a, b in zip(offsets, offsets[1:], strict=False)):
        raise ValueError("meta offsets must not decrease")
    seen: set[str] = set()
    twice = sorted({r for r in rsids if r in seen or seen.add(r)})
    if twice:
        raise ValueError(f"duplicate rsids: {twice[:10]}; an index needs unique ones")
    names = [r.encode() for r in rsids]
    ends = np.concatenate([[0], np.cumsum([len(x) for x in names], dtype=np.int64)])
    if ends[-1] >= 1 << 32:
        raise ValueError("rsids exceed 4 GiB")
    head = INDEX_HEADER.pack(INDEX_MAGIC, INDEX_VERSION, len(rsids), 0, HEADER.size, header.file_size, header.codes_at)
    return head + ends.astype("<u4").tobytes() + np.array(offsets, "<u8").tobytes() + b"".join(names)


@dataclass(frozen=True)
class Index:
    rsids: list[str]
    offsets: np.ndarray
    meta_at: int
    file_size: int
    codes_at: int

    def fits(self, header: Header, size: int) -> bool:
        """Whether it was made for this file as it is on disk."""
        return (len(self.rsids), self.meta_at, self.codes_at, self.file_size) == (header.n_variants, HEADER.size, header.codes_at, size)

    def record_range(self, row: int) -> tuple[int, int]:
        if not 0 <= row < len(self.rsids):
            raise IndexError(row)
        return int(self.offsets[row]), int(self.offsets[row + 1])


def read_index(data: bytes) -> Index:
    if len(data) < INDEX_HEADER.size:
        raise ValueError("bcor index header truncated")
    magic, version, n, _, meta_at, file_size, codes_at = INDEX_HEADER.unpack_from(data)
    if magic != INDEX_MAGIC:
        raise ValueError(f"not a bcor index (magic {magic!r})")
    if version != INDEX_VERSION:
        raise ValueError(f"unsupported bcor index version {version}")
    at = INDEX_HEADER.size
    if len(data) < at + 12 * (n + 1):
        raise ValueError("bcor index is cut off")
    ends = np.frombuffer(data, "<u4", n + 1, at)
    offsets = np.frombuffer(data, "<u8", n + 1, at + 4 * (n + 1))
    names = data[at + 12 * (n + 1) :]
    if ends[0] != 0 or ends[-1] != len(names) or (np.diff(ends.astype(np.int64)) < 0).any():
        raise ValueError("bcor index: rsid offsets don't fit the rsids")
    if offsets[0] != meta_at or offsets[-1] != codes_at or (np.diff(offsets.astype(np.int64)) < 0).any():
        raise ValueError("bcor index: meta offsets don't fit the header")
    try:
        rsids = [names[a:b].decode() for a, b in zip(ends, ends[1:], strict=False)]
    except UnicodeDecodeError as e:
        raise ValueError(f"bcor index: an rsid is not UTF-8 ({e})") from None
    if len(set(rsids)) != n:
        raise ValueError("bcor index has duplicate rsids")
    return Index(rsids, offsets, meta_at, file_size, codes_at)
