"""Token ids as length-delimited binary records, with an offset index.

A shard is a file of records, one for each document:

    length (u64) | masked checksum of the length (u32) | payload | masked checksum of the payload (u32)

The payload is the doc_id (i64), the bytes of an id (u8) and the ids. A shard's
index is a file of its own with doc_id (i64), offset (u64), length (u64) for
each record, so that records can be read in any order. All numbers are
little-endian. Shards of a run follow each other in ascending doc_id order.
Each attempt of a task writes names of its own, and only those that a finished
task reports are in the manifest: a lost executor leaves nothing that is read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .tokens import encoder, vocabulary

#: Id appended to each document.
END = 2
#: A shard is closed once it has this many bytes.
SHARD_BYTES = 64 << 20

MANIFEST = "part long, shard long, path string, index_path string, n_records long, n_tokens long, n_bytes long"
INDEX = np.dtype([("doc_id", "<i8"), ("offset", "<u8"), ("length", "<u8")])
_HEAD = struct.Struct("<QI")
_FRONT = struct.Struct("<qB")
_CRC = struct.Struct("<I")


def masked(data: bytes) -> int:
    """CRC-32, rotated and shifted so that checksums of checksums stay sound."""
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return length + _CRC.pack(masked(length)) + payload + _CRC.pack(masked(payload))


def unframe(stream) -> Iterator[bytes]:
    """Payloads of a stream of records; raises ValueError on damage."""
    while head := stream.read(_HEAD.size):
        if len(head) < _HEAD.size:
            raise ValueError("a record is cut off")
        length, crc = _HEAD.unpack(head)
        if masked(head[:8]) != crc:
            raise ValueError("a record's length is damaged")
        payload, tail = stream.read(length), stream.read(4)
        if len(payload) < length or len(tail) < 4:
            raise ValueError("a record is cut off")
        if masked(payload) != _CRC.unpack(tail)[0]:
            raise ValueError("a record's payload is damaged")
        yield payload


def parse(payload: bytes) -> tuple[int, np.ndarray]:
    doc_id, width = _FRONT.unpack_from(payload)
    return doc_id, np.frombuffer(payload, f"<u{width}", offset=_FRONT.size)


class ShardWriter:
    def __init__(self, folder: str, part: int, shard: int):
        self.files, at = fs.FileSystem.from_uri(folder)
        self.files.create_dir(at, recursive=True)
        name = f"{part:06d}-{shard:04d}-{uuid.uuid4().hex}"
        self.path, self.index_path = f"{at}/{name}.rec", f"{at}/{name}.idx"
        self.out = self.files.open_output_stream(self.path, compression=None)
        self.rows: list[tuple[int, int, int]] = []
        self.size = self.tokens = 0
        self.place = (part, shard)

    def add(self, doc_id: int, ids: bytes, width: int) -> None:
        record = frame(_FRONT.pack(doc_id, width) + ids)
        self.out.write(record)
        self.rows.append((doc_id, self.size, len(record)))
        self.size += len(record)
        self.tokens += len(ids) // width

    def close(self) -> tuple:
        self.out.close()
        with self.files.open_output_stream(self.index_path, compression=None) as f:
            f.write(np.array(self.rows, INDEX).tobytes())
        return (*self.place, self.path, self.index_path, len(self.rows), self.tokens, self.size)


def write_records(documents: DataFrame, folder: str, tokenizer: str, end: int = END, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Encodes and writes all documents; returns the manifest, a row per shard.

    Null texts are empty and give the end id alone. Rows without a doc_id come
    last, as id NO_ID; rows with the same id, or without one, stay apart, in the
    order of a hash of their texts, and can fill any number of shards. An empty
    table gives an empty manifest. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        last = end.to_bytes(encode.width, "little")
        part, done, open_shard = TaskContext.get().partitionId(), [], None
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if open_shard is None:
                    open_shard = ShardWriter(folder, part, len(done))
                open_shard.add(doc_id, encode.encode(text or "") + last, encode.width)
                if open_shard.size >= shard_bytes:
                    done.append(open_shard.close())
                    open_shard = None
        if open_shard is not None:
            done.append(open_shard.close())
        columns = list(zip(*done, strict=True)) or [()] * 7
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["part", "shard", "path", "index_path", "n_records", "n_tokens", "n_bytes"])

    rows = documents.select(common.doc_key().alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("text_hash", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc_id", "text_hash").sortWithinPartitions("doc_id", "text_hash", "text").drop("text_hash")
    return common.materialise(common.map_batches(ordered, run, MANIFEST), "records-manifest")


def read_records(spark: SparkSession, manifest: DataFrame, folder: str) -> DataFrame:
    """Reads the shards back: doc_id, start (ids of all records before), ids
    (little-endian u32), n_tokens, ids_crc32, and the record's place.

    Only the manifest, a row per shard of SHARD_BYTES, passes the driver.
    """
    rows = manifest.orderBy("part", "shard").select("path", "n_tokens").collect()
    first = np.concatenate([[0], np.cumsum([r["n_tokens"] for r in rows], dtype=np.int64)])
    shards = spark.createDataFrame([(k, r["path"], int(first[k])) for k, r in enumerate(rows)], "shard long, path string, first long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, start in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                with files.open_input_stream(path, compression=None, buffer_size=1 << 20) as f:
                    out: list[tuple] = []
                    for payload in unframe(f):
                        doc_id, ids = parse(payload)
                        out.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        start += len(ids)
                        if len(out) == 10_000:
                            yield _records(out)
                            out = []
                    yield _records(out)

    n = max(1, len(rows))
    found = shards.repartition(n, "shard").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
    return found.withColumn("doc_id", common.id_from_key("doc_id"))


def _records(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_at(folder: str, path: str, index_path: str, order: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """Records of a shard in the given order, through its index."""
    files, _ = fs.FileSystem.from_uri(folder)
    with files.open_input_stream(index_path, compression=None) as f:
        index = np.frombuffer(f.read(), INDEX)
    with files.open_input_file(path) as f:
        for k in order:
            f.seek(int(index[k]["offset"]))
            yield parse(next(unframe(pa.BufferReader(f.read(int(index[k]["length"]))))))


def op2(spark, sf_dir: str) -> DataFrame:
    folder = common.fresh_path(spark, "records")
    if "://" not in folder and not folder.startswith("file:"):
        folder = f"file://{folder}"
    folder = folder.replace("file:/", "file:///", 1) if folder.startswith("file:/") and not folder.startswith("file://") else folder
    manifest = write_records(common.table(spark, sf_dir, "documents"), folder, vocabulary("byte_bpe_50k.json"))
    return read_records(spark, manifest, folder)
