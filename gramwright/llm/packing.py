"""Cost-balanced packing of token ids into sequences of bounded length.

A piece of n ids costs LINEAR * n + QUADRATIC * n * n: attention within the
piece grows with its square. Within a block of documents, full pieces are cut
off long documents first. The rest are taken by descending length, and each
goes to the sequence of lowest cost that still has room for it; one that fits
nowhere whole is cut over the sequences with most room. A block opens just as
many sequences as its ids need, so that at most one sequence's worth of padding
is left per block. Blocks are formed where the documents are read: no shuffle.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .tokens import MEMORY, encoder, vocabulary

CAPACITY = 2048
END = 1
LINEAR = 1.0
QUADRATIC = 1.0 / 2048
#: A block is packed once it has this many ids.
BLOCK_TOKENS = 1 << 20

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def cost(length: np.ndarray | int, linear: float = LINEAR, quadratic: float = QUADRATIC):
    return linear * length + quadratic * length * length


def assign(lengths: np.ndarray, capacity: int = CAPACITY, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int, int]]:
    """Pieces (item, start, length, sequence, offset) that hold each id of each
    item once, no sequence over capacity. Ties go to the earlier item and to
    the lower sequence."""
    pieces = []
    n_full = lengths // capacity
    sequence = 0
    for k in np.flatnonzero(n_full):
        for j in range(n_full[k]):
            pieces.append((int(k), j * capacity, capacity, sequence, 0))
            sequence += 1
    rest = lengths - n_full * capacity
    n = -(-int(rest.sum()) // capacity)
    room, load = np.full(n, capacity, np.int64), np.zeros(n)
    for k in np.argsort(-rest, kind="stable"):
        left, start = int(rest[k]), int(n_full[k]) * capacity
        if not left:
            break
        at = int(np.where(room >= left, load, np.inf).argmin())
        while left:
            if room[at] < min(left, capacity):
                at = int(room.argmax())
            take = min(left, int(room[at]))
            pieces.append((int(k), start, take, sequence + at, int(capacity - room[at])))
            room[at] -= take
            load[at] += cost(take, linear, quadratic)
            start, left = start + take, left - take
    return pieces


def pack(documents: DataFrame, tokenizer: str, end: int = END, capacity: int = CAPACITY, block_tokens: int = BLOCK_TOKENS, with_ids: bool = False, memory: int = MEMORY) -> DataFrame:
    """One row per piece; with_ids adds its ids as little-endian u32.

    Null texts are empty and give the end id alone. Null doc_ids stay null;
    rows with the same doc_id are packed one by one. A sequence_id holds the
    partition, block and sequence, and is unique; it depends on how the input
    is cut into partitions, but not on the run. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, memory)
        last = end.to_bytes(encode.width, "little")
        part, number, size = TaskContext.get().partitionId(), 0, 0
        held: list[tuple[int | None, bytes]] = []

        def emit() -> pa.RecordBatch:
            lengths = np.array([len(x) // encode.width for _, x in held], np.int64)
            rows = assign(lengths, capacity)
            ids = [encode.ids(held[k][1])[a : a + n].astype("<u4").tobytes() for k, a, n, _, _ in rows]
            base = part << 40 | number << 20
            columns = [
                pa.array([held[r[0]][0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()),
                pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array([int(lengths[r[0]]) for r in rows], pa.int64()),
                pa.array([base + r[3] for r in rows], pa.int64()), pa.array([r[4] for r in rows], pa.int64()),
            ]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                columns, names = [*columns, pa.array(ids, pa.binary())], [*names, "ids"]
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.append((doc_id, encode.encode(text or "") + last))
                size += len(held[-1][1]) // encode.width
                if size >= block_tokens:
                    yield emit()
                    held, size, number = [], 0, number + 1
        if held:
            yield emit()

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return common.map_batches(rows, run, SCHEMA + (", ids binary" if with_ids else ""))


def op7(spark, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
