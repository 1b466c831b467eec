"""BGEN v1.1 and v1.2: variant blocks to dosages, from the public description
of the format. A dosage is the expected count of the second allele."""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa


@dataclass(frozen=True)
class Header:
    offset: int  # of the first variant block
    n_variants: int
    n_samples: int
    compression: int  # 0 none, 1 zlib, 2 zstd
    layout: int
    has_samples: bool
    header_length: int


@dataclass(frozen=True)
class Variant:
    rsid: str
    chrom: str
    pos: int
    alleles: tuple[str, ...]
    data_at: int
    data_length: int


def read_header(data: bytes) -> Header:
    offset, length, n_variants, n_samples = struct.unpack_from("<IIII", data)
    if data[16:20] not in (b"bgen", b"\0\0\0\0"):
        raise ValueError("not a BGEN file")
    (flags,) = struct.unpack_from("<I", data, length)
    return Header(offset + 4, n_variants, n_samples, flags & 3, flags >> 2 & 15, bool(flags >> 31), length)


def read_samples(data: bytes, header: Header) -> list[str]:
    at = 4 + header.header_length
    if not header.has_samples:
        return [f"sample_{k}" for k in range(header.n_samples)]
    (n,) = struct.unpack_from("<I", data, at + 4)
    at, out = at + 8, []
    for _ in range(n):
        (k,) = struct.unpack_from("<H", data, at)
        out.append(data[at + 2 : at + 2 + k].decode())
        at += 2 + k
    return out


def read_variant(data: bytes, at: int, header: Header) -> tuple[Variant, int]:
    """The identifying part of the block at `at`, and where the next begins."""

    def text(kind: str) -> str:
        nonlocal at
        (k,) = struct.unpack_from(kind, data, at)
        at += struct.calcsize(kind) + k
        return data[at - k : at].decode()

    if header.layout == 1:
        at += 4
    text("<H")
    rsid, chrom = text("<H"), text("<H")
    (pos,) = struct.unpack_from("<I", data, at)
    at += 4
    n_alleles = 2
    if header.layout == 2:
        (n_alleles,) = struct.unpack_from("<H", data, at)
        at += 2
    alleles = tuple(text("<I") for _ in range(n_alleles))
    if header.layout == 1 and header.compression == 0:
        length = 6 * header.n_samples
    else:
        (length,) = struct.unpack_from("<I", data, at)
        at += 4
    return Variant(rsid, chrom, pos, alleles, at, length), at + length


def dosages(block: bytes, header: Header) -> np.ndarray:
    """The probability part of a block -> one dosage per sample, NaN if missing."""
    if header.layout == 1:
        raw = zlib.decompress(block) if header.compression == 1 else block
        p = np.frombuffer(raw, "<u2", 3 * header.n_samples).reshape(-1, 3) / 32768.0
        total = p.sum(1)
        return np.where(total > 0, p[:, 1] + 2 * p[:, 2], np.nan)
    if header.compression:
        (size,) = struct.unpack_from("<I", block)
        raw = zlib.decompress(block[4:]) if header.compression == 1 else pa.Codec("zstd").decompress(block[4:], decompressed_size=size).to_pybytes()
    else:
        raw = block
    n, n_alleles, low, high = struct.unpack_from("<IHBB", raw)
    if n_alleles != 2 or (low, high) != (2, 2):
        raise ValueError("only diploid variants of two alleles are supported")
    ploidy = np.frombuffer(raw, np.uint8, n, 8)
    phased, bits = raw[8 + n], raw[9 + n]
    values = _numbers(raw[10 + n :], bits, 2 * n).reshape(n, 2) / float((1 << bits) - 1)
    out = (1 - values[:, 0]) + (1 - values[:, 1]) if phased else values[:, 1] + 2 * (1 - values[:, 0] - values[:, 1])
    return np.where(ploidy & 0x80, np.nan, out)


def _numbers(raw: bytes, bits: int, n: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(raw, f"<u{bits // 8}", n).astype(float)
    flat = np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little")[: n * bits].reshape(n, bits)
    return flat @ (2.0 ** np.arange(bits))


def write_front(n_variants: int, samples: list[str]) -> bytes:
    """Header and sample block of a version 1.2 file, zlib-packed."""
    names = b"".join(struct.pack("<H", len(x.encode())) + x.encode() for x in samples)
    block = struct.pack("<II", 8 + len(names), len(samples)) + names
    head = struct.pack("<III4sI", 20, n_variants, len(samples), b"bgen", 1 | 2 << 2 | 1 << 31)
    return struct.pack("<I", len(head) + len(block)) + head + block


def write_variant(rsid: str, chrom: str, pos: int, ref: str, alt: str, dosage: np.ndarray) -> bytes:
    """A block with probabilities of 16 bits: of a dosage up to 1, that share is
    heterozygous; beyond, what exceeds 1 has both. Whole dosages are exact."""

    def text(kind: str, x: str) -> bytes:
        return struct.pack(kind, len(x.encode())) + x.encode()

    gone = np.isnan(dosage)
    d = np.where(gone, 0.0, dosage)
    both = np.maximum(d - 1, 0)
    one = d - 2 * both
    p = np.round(np.stack([1 - one - both, one], 1) * 65535).astype("<u2")
    raw = struct.pack("<IHBB", len(d), 2, 2, 2) + np.where(gone, 0x82, 2).astype(np.uint8).tobytes() + bytes([0, 16]) + p.tobytes()
    packed = zlib.compress(raw)
    return text("<H", rsid) + text("<H", rsid) + text("<H", chrom) + struct.pack("<IH", pos, 2) + text("<I", ref) + text("<I", alt) + struct.pack("<II", len(packed) + 4, len(raw)) + packed
