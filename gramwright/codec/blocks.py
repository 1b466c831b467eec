"""Block-matrix files: a grid of blocks of doubles, each an LZ4 part file."""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa


def unpack_frames(raw: bytes) -> bytes:
    """Frames are: length after this field i32 | length unpacked i32 | LZ4 block.
    A length of 0 or less ends the file."""
    codec, out, at = pa.Codec("lz4_raw"), [], 0
    while at + 4 <= len(raw):
        (length,) = struct.unpack_from("<i", raw, at)
        if length <= 0:
            break
        (size,) = struct.unpack_from("<i", raw, at + 4)
        packed = raw[at + 8 : at + 4 + length]
        out.append(codec.decompress(packed, decompressed_size=size).to_pybytes())
        at += 4 + length
    return b"".join(out)


def pack_frames(data: bytes, frame: int = 1 << 16) -> bytes:
    codec, out = pa.Codec("lz4_raw"), []
    for at in range(0, len(data), frame):
        part = data[at : at + frame]
        packed = codec.compress(part).to_pybytes()
        out.append(struct.pack("<ii", len(packed) + 4, len(part)) + packed)
    return b"".join(out)


def read_block(raw: bytes) -> np.ndarray:
    """rows i32 | columns i32 | row-major i8 | doubles."""
    data = unpack_frames(raw)
    rows, columns, by_row = struct.unpack_from("<iib", data)
    return np.frombuffer(data, "<f8", rows * columns, 9).reshape((rows, columns), order="C" if by_row else "F")


def write_block(block: np.ndarray, by_row: bool = False) -> bytes:
    return pack_frames(struct.pack("<iib", *block.shape, by_row) + np.asarray(block, "<f8").tobytes("C" if by_row else "F"))


@dataclass(frozen=True)
class Grid:
    """Blocks are numbered down the columns; `stored` lists those on disk, in
    the order of their part files, or None for all."""

    block: int
    n_rows: int
    n_columns: int
    stored: tuple[int, ...] | None = None

    @property
    def block_rows(self) -> int:
        return -(-self.n_rows // self.block)

    @property
    def block_columns(self) -> int:
        return -(-self.n_columns // self.block)

    def number(self, bi: int, bj: int) -> int:
        return bi + bj * self.block_rows

    def parts(self) -> list[tuple[int, int, int]]:
        """(part file's place, bi, bj) of all stored blocks."""
        numbers = self.stored if self.stored is not None else range(self.block_rows * self.block_columns)
        return [(k, n % self.block_rows, n // self.block_rows) for k, n in enumerate(numbers)]

    def part_of(self, bi: int, bj: int) -> int | None:
        if not (0 <= bi < self.block_rows and 0 <= bj < self.block_columns):
            return None
        n = self.number(bi, bj)
        if self.stored is None:
            return n
        return self.stored.index(n) if n in self.stored else None
