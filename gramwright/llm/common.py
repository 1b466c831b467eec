"""Helpers that the ten text operators share: session settings, tables in the
shared folder, and numpy routines over the bytes of many texts at once."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a missing doc_id: such rows come after all others. A doc_id of this
#: very value is not told apart from a missing one.
NO_ID = 2**63 - 1

#: Bytes of text handled by one numpy pass; a longer text makes a pass alone.
PASS_BYTES = 1 << 18

#: Most bytes of a batch that goes to a Python worker; a longer row makes a batch alone.
BATCH_BYTES = 1 << 20

WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True

_rng = np.random.default_rng(20240611)
BYTE_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_key(col: str = "doc_id") -> Column:
    """The id as a long that is never null (see NO_ID)."""
    return F.coalesce(F.col(col).cast("long"), F.lit(NO_ID))


def id_from_key(col: str) -> Column:
    return F.when(F.col(col) != NO_ID, F.col(col))


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one under the warehouse if unset."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir.rstrip("/")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Rows of a written file, where their number is known to have a bound.
FILE_ROWS = 200_000


def materialise(df: DataFrame, name: str, small: bool = False, rows: int | None = None) -> DataFrame:
    """Writes df in the shared folder and reads it again: lineage is cut, and
    the copy outlives any executor. What is small against what it was read from
    is brought together first: a scan would write a small file from each task.
    rows, a bound on the number of short rows, tells how many files are enough
    after the last shuffle."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    if small:
        df = df.hint("rebalance")
    if rows is not None:
        df = df.coalesce(rows // FILE_ROWS + 1)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.kept_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes what materialise wrote, once nothing reads it any more."""
    for df in tables:
        session = df.sparkSession
        path = session._jvm.org.apache.hadoop.fs.Path(df.kept_at)
        path.getFileSystem(session._jsc.sc().hadoopConfiguration()).delete(path, True)


def bound_batches(spark: SparkSession) -> None:
    """Batches hold BATCH_BYTES at most, not 10,000 rows however long they are.
    A lower bound that the session has stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    digits = spark.conf.get(name).lower().removesuffix("b")
    if not digits.isdigit() or not 0 < int(digits) <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def give_back() -> None:
    """Memory that a worker no longer uses goes back to the system: workers
    stay for later tasks, and would keep the most that any task took."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def give_back_heaps(spark: SparkSession) -> None:
    """Executors collect their garbage, and heap that this frees goes back to the
    system: it would stay as large as the step that used most made it, beside the
    Python workers of later steps. A task per core; what it misses only stays."""
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.expr("reflect('java.lang.System', 'gc')")).collect()


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """df.mapInArrow in batches of bounded size."""
    bound_batches(df.sparkSession)

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return df.mapInArrow(tidied, schema)


def slices(texts: list[bytes], limit: int = PASS_BYTES) -> Iterator[tuple[int, int]]:
    """Index ranges of texts with about limit bytes each."""
    lo = size = 0
    for k, t in enumerate(texts):
        if k > lo and size + len(t) > limit:
            yield lo, k
            lo, size = k, 0
        size += len(t)
    if lo < len(texts):
        yield lo, len(texts)


def utf8(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """Texts as UTF-8; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def word_table(texts: list[bytes], separator: np.ndarray) -> tuple[np.ndarray, ...]:
    """Words of all texts: hash, index of text, start and end byte in the text.

    separator marks, by byte value, what lies between words. Texts are joined
    by a newline, which must be a separator, so that no word crosses texts.
    """
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    inside = ~separator[buf]
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edge[0::2], edge[1::2]
    begin = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    owner = np.searchsorted(begin, starts, side="right") - 1
    if not len(starts):
        return np.zeros(0, np.uint64), owner, starts, ends
    length = ends - starts
    # position of each byte in its word, then a polynomial over it
    at = np.flatnonzero(inside)
    first = np.concatenate([[0], np.cumsum(length)[:-1]])
    place = np.arange(len(at)) - np.repeat(first, length)
    power = np.cumprod(np.full(int(length.max()), _STEP | np.uint64(1), np.uint64))
    value = BYTE_VALUE[buf[at]] * power[place]
    return mix(np.add.reduceat(value, first)), owner, starts - begin[owner], ends - begin[owner]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each place on (for the last n-1 places, of what wraps)."""
    out = words.copy()
    for k in range(1, n):
        out = mix(out * _STEP + np.roll(words, -k))
    return out


def bit_rows(slots: DataFrame) -> DataFrame:
    """A map of the slots in column slot: k and 4 KB of bits, by partial aggregates."""
    at = F.col("slot") + 1
    return slots.groupBy(F.bitmap_bucket_number(at).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))


def bitmap(slots: DataFrame, bits: int) -> np.ndarray:
    """A map of `bits` bits with those of column slot set. Its size is fixed
    whatever the rows are."""
    out = np.zeros(max(bits // 8, 4096), np.uint8)
    for r in bit_rows(slots).toLocalIterator():
        lo = (r["k"] - 1) * 4096
        out[lo : lo + 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out


def in_bitmap(bits: np.ndarray, slot: np.ndarray) -> np.ndarray:
    return (bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1


def doc_slot(column: str, bits: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(bits))


def flagged(rows: DataFrame, key: str, ids: DataFrame, bits: int = 1 << 25, name: str = "hit") -> DataFrame:
    """rows with a column that tells whether their key may be in ids (column doc).
    A map of at most `bits` bits, 4 MB by default, is broadcast as a table of its
    parts; no Python runs. It stops to help, but not to be right, once ids are
    many against its bits."""
    parts = materialise(bit_rows(ids.select(doc_slot("doc", bits).alias("slot"))), "map", rows=bits // 32768)
    placed = rows.withColumn("__slot", doc_slot(key, bits)).withColumn("__k", F.bitmap_bucket_number(F.col("__slot") + 1))
    found = placed.join(F.broadcast(parts.select(F.col("k").alias("__k"), F.col("bits").alias("__bits"))), "__k", "left")
    byte = "cast(conv(hex(substring(__bits, cast(1 + shiftright(__slot & 32767, 3) as int), 1)), 16, 10) as int)"
    return found.withColumn(name, F.expr(f"coalesce({byte} & shiftleft(1, cast(__slot & 7 as int)) <> 0, false)")).drop("__slot", "__k", "__bits")


def split_by(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """row (all columns) and doc (doc_key) of the rows that may be in ids (column
    doc), and of those that surely are not (flagged)."""
    rows = flagged(docs.select(F.struct("*").alias("row"), doc_key(key).alias("doc")), "doc", ids)
    return rows.where("hit").drop("hit"), rows.where("not hit").drop("hit")


def without(docs: DataFrame, gone: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs, all columns, without the rows whose doc_key(key) is in gone (column
    doc). Rows that a map of fixed size rules out stay where they are; only
    the others are joined."""
    may, others = split_by(docs, gone, key)
    # what a join leaves of them are mistakes of the map: few
    return others.select("row.*").unionByName(may.join(gone, "doc", "left_anti").select("row.*").hint("rebalance"))
