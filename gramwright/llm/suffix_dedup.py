"""Verbatim passages that occur before, by prefix doubling over what anchors leave.

A byte is removed if a string of LENGTH bytes over it also starts earlier.
Prefix doubling ranks positions by their first bytes, and by pairs of ranks at
growing offsets by twice as many, until a position is unique or LENGTH bytes are
passed. A row for every position and offset would be tens of times the input, so
that positions are left out first that cannot matter, or whose fate is certain:

1. Each string of LENGTH bytes names one of its ANCHOR-byte grams, the least by
   hash, so that equal strings name equal grams at equal places. Strings in a
   row that name the same gram form a run: about one in thirty-five positions.
   Strings of a gram that occurs once occur once: they are left out.
2. The other runs are sorted by (gram, whole run, position). A run that is not
   the first of its equals is covered whole, and if all runs of a gram are equal,
   the first of them occurs nowhere before. Both are settled.
3. Of the others, the first of each kind is cut by its strings' distance to the
   gram into parts of STEPS[0] strings, which share a core of bytes around it:
   parts are settled by (core, whole part, position) as in 2, and the first of
   each kind that is left is cut on into parts of STEPS[1].
4. The strings of the parts that are left, and the places HALF bytes after them,
   go through prefix doubling. Ranks of QUARTER bytes are hashes. Pairs of ranks
   (at a position, QUARTER further) are sorted with their positions; numbers in
   that order are ranks of HALF bytes. Unique ones end here. The others meet
   with their rank HALF bytes further and are sorted again: every position but
   the first of its pair starts a string that occurs before.

All sorts are range-partitioned with the position as the last key, so that a
passage that a third of all documents share is spread over as many tasks as it
fills. Tasks number what they hold; what crosses their bounds is settled from
one row of notes per task. Steps 2 and 3 compare 128 bits of hashes, step 4 the
hashes of four quarters. Maps of fixed size tell the next scan which positions
can still matter. They only leave out, and past some 10^8 keys they are full and
leave out nothing more; the sorts decide.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import BYTE_VALUE, mix

LENGTH = 100
ANCHOR = 32
#: Strings of a part, and of a part of it.
STEPS = (8, 2)
QUARTER, HALF = LENGTH // 4, LENGTH // 2
#: Bits of each map; fixed, whatever the input.
MAP_BITS = 1 << 27
_PASS = 1 << 18

#: Most rows of a sorted partition, on average.
PART_ROWS = 500_000

GRAMS = "gram long"
ROWS = "k1 long, k2 long, doc long, text_hash long, start int, more int"
ORDER = ["k1", "k2", "doc", "text_hash", "start"]
RESULT = "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"

#: Lengths that names are joined to, each by its beginning's.
_FIRST = {2: 1, 3: 2, 4: 2, 8: 4, 16: 8, 24: 16, 25: 24, 32: 16, 48: 32, 64: 32, 80: 64, 88: 80, 92: 88, 93: 92, 96: 64, 99: 96, 100: 96}
#: A multiplier for each of them.
_BY = {n: np.uint64(k) for n, k in zip(_FIRST, np.random.default_rng(17).integers(1, 2**62, len(_FIRST), dtype=np.uint64) * np.uint64(2) + np.uint64(1), strict=True)}


def joined(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, none of them null, and each one's size: a view."""
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return np.frombuffer(data or b"", np.uint8)[at[0] : at[-1]], np.diff(at)


class Names:
    """Names of the strings at every place of a buffer: powers of two as
    arrays, other lengths joined at the places that are asked for."""

    def __init__(self, buf: np.ndarray):
        self.of = {1: BYTE_VALUE[buf]}
        for n in (2, 4, 8, 16, 32):
            half = self.of[n // 2]
            self.of[n] = half[: len(half) - n // 2] * _BY[n] + half[n // 2 :] if len(half) > n // 2 else half[:0]

    def __call__(self, n: int, at: np.ndarray) -> np.ndarray:
        if n in self.of:
            return self.of[n][at]
        first = _FIRST[n]
        return self(first, at) * _BY[n] + self(n - first, at + first)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of values[i : i + width] for every i."""
    reach, m = 1, values
    while reach * 2 <= width:
        m = np.minimum(m[: len(m) - reach], m[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


class Runs:
    """Runs of texts of the given sizes, joined in buf: gram, whole, text's index,
    first and last place in buf, and the gram's place."""

    def __init__(self, buf: np.ndarray, size: np.ndarray):
        self.begin = np.cumsum(size) - size
        self.names = Names(buf)
        self.at = self.first = self.last = self.owner = np.zeros(0, np.int64)
        if (size >= LENGTH).any():
            self._find(size, len(buf))
        self.gram = mix(self.names(ANCHOR, self.at))

    def name(self) -> None:
        self.whole = self._whole(self.first, self.last, self.at)

    def _find(self, size: np.ndarray, n: int) -> None:
        bits = np.uint64(n.bit_length())
        gram = mix(self.names.of[ANCHOR])
        keyed = (gram >> bits << bits) | np.arange(len(gram), dtype=np.uint64)
        anchor = (_least(keyed, LENGTH - ANCHOR + 1) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        new = np.ones(len(anchor), bool)
        new[1:] = anchor[1:] != anchor[:-1]
        count = np.maximum(size - LENGTH + 1, 0)
        some = count > 0
        inside = np.zeros(len(anchor) + 1, np.int8)
        inside[self.begin[some]] = 1
        np.add.at(inside, self.begin[some] + count[some], -1)
        inside = np.cumsum(inside[:-1]) > 0
        new[self.begin[some]] = True
        self.first = np.flatnonzero(new & inside)
        self.owner = np.searchsorted(self.begin, self.first, side="right") - 1
        end = self.begin[self.owner] + count[self.owner] - 1
        self.last = np.minimum(np.append(self.first[1:] - 1, end[-1:]), end)
        self.at = anchor[self.first]

    def _whole(self, first: np.ndarray, last: np.ndarray, at: np.ndarray) -> np.ndarray:
        place = ((last - first) * 256 + at - first).astype(np.uint64)
        return mix(mix(self.names(LENGTH, first)) * _BY[2] + mix(self.names(LENGTH, last)) * _BY[4] + place)

    def pick(self, keep: np.ndarray) -> None:
        for k in ("gram", "whole", "owner", "first", "last", "at"):
            if hasattr(self, k):
                setattr(self, k, getattr(self, k)[keep])

    def cut(self, step: int) -> None:
        """Into parts of strings whose distance to the gram has the same quotient by step."""
        far, near = (self.at - self.first) // step, (self.at - self.last) // step
        n = far - near + 1
        who = np.repeat(np.arange(len(n)), n)
        k = np.repeat(far, n) - (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
        first, last, at = self.first[who], self.last[who], self.at[who]
        self.first, self.last = np.maximum(first, at - k * step - step + 1), np.minimum(last, at - k * step)
        self.at, self.owner = at, self.owner[who]
        self.gram = mix(mix(self.names(LENGTH - step + 1, at - k * step)) + k.astype(np.uint64))
        self.whole = self._whole(self.first, self.last, at)

    def single(self) -> None:
        """Into single strings, and the places HALF bytes after them, named by
        two quarters each; `last` is past `first` for the strings themselves."""
        n = self.last - self.first + 1
        p = np.unique(np.arange(n.sum()) + np.repeat(self.first - (np.cumsum(n) - n), n))
        every = np.union1d(p, p + HALF)
        self.owner = np.searchsorted(self.begin, every, side="right") - 1
        self.first = self.at = every
        self.last = every + np.isin(every, p, assume_unique=True)
        self.gram, self.whole = mix(self.names(QUARTER, every)), mix(self.names(QUARTER, every + QUARTER))

    def batch(self, doc: np.ndarray, text_hash: np.ndarray) -> pa.RecordBatch:
        start, more = self.first - self.begin[self.owner], self.last - self.first
        columns = [pa.array(self.gram.view(np.int64)), pa.array(self.whole.view(np.int64)), pa.array(doc[self.owner]), pa.array(text_hash[self.owner]), pa.array(start, pa.int32()), pa.array(more, pa.int32())]
        return pa.RecordBatch.from_arrays(columns, names=[*ORDER, "more"])


def _rows(documents: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return documents.select(common.doc_key().alias("doc"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def _scan(rows: DataFrame, grams=None, heads=(), single: bool = False) -> DataFrame:
    """Grams of all runs; or runs, of the grams in a map. heads are maps: of
    runs, of which those it has are cut into parts of STEPS[0] strings, of parts
    to be cut on by STEPS[1], ..., the last one, if single, into single strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, text_hash, sizes = (batch.column(k).to_numpy() for k in (0, 1, 3))
            lo = 0
            while lo < len(doc):
                # texts are unpacked a pass at a time
                hi = max(lo + 1, int(np.searchsorted(np.cumsum(sizes[lo:]), _PASS, side="right")) + lo)
                found, mine = Runs(*joined(batch.column(2).slice(lo, hi - lo))), doc[lo:hi]
                if grams is None:
                    yield pa.RecordBatch.from_arrays([pa.array(found.gram.view(np.int64))], names=["gram"])
                else:
                    found.pick(common.in_bitmap(grams.value, (found.gram & np.uint64(MAP_BITS - 1)).astype(np.int64)))
                    found.name()
                    for k, bits in enumerate(heads):
                        found.pick(common.in_bitmap(bits.value, (found.whole.view(np.int64) ^ mine[found.owner]) & (MAP_BITS - 1)))
                        if single and k + 1 == len(heads):
                            found.single()
                        else:
                            found.cut(STEPS[k])
                    yield found.batch(mine, text_hash[lo:hi])
                lo = hi

    sized = rows.select("doc", "text_hash", "text", F.octet_length("text").cast("long").alias("size"))
    return common.map_batches(sized, run, GRAMS if grams is None else ROWS)


# --- ranks ------------------------------------------------------------------

RANKED = "part int, k2 long, doc long, text_hash long, start int, more int, rank long, first boolean, many boolean, several boolean, edge int, note array<long>"
#: A row's group by k1, or by (k1, k2), is the first or the last of its task.
LEAD1, TAIL1, LEAD2, TAIL2 = 1, 2, 4, 8


def _number(batches: Iterator[pa.RecordBatch], repeats: bool) -> Iterator[pa.RecordBatch]:
    """Ranks of a task's sorted rows, as far as the task can tell, and its note.
    Rows that cannot matter are left out: with repeats, those alone of their
    kind; else those first of the only kind of their k1."""
    table = pa.Table.from_batches(list(batches), pa.schema([(c, pa.int64()) for c in ORDER[:4]] + [("start", pa.int32()), ("more", pa.int32())]))
    n = table.num_rows
    if not n:
        return
    k1, k2, doc, text_hash, start, more = (table.column(c).to_numpy() for c in [*ORDER, "more"])
    changes = lambda x: np.concatenate([[True], x[1:] != x[:-1]])
    new1 = changes(k1)
    new2 = new1 | changes(k2)
    newp = new2 | changes(doc) | changes(text_hash) | changes(start)
    at1, at2 = np.flatnonzero(new1), np.flatnonzero(new2)
    of1, of2 = np.cumsum(new1) - 1, np.cumsum(new2) - 1
    several = np.add.reduceat(new2.astype(np.int64), at1) > 1
    many = np.add.reduceat(newp.astype(np.int64), at2) > 1
    first = np.maximum.accumulate(np.where(newp, np.arange(n), 0)) == at2[of2]
    edge = LEAD1 * (of1 == 0) + TAIL1 * (of1 == of1[-1]) + LEAD2 * (of2 == 0) + TAIL2 * (of2 == of2[-1])
    part = TaskContext.get().partitionId()
    note = [n, k1[0], k2[0], k1[-1], k2[-1], several[0], several[-1], many[0], many[-1], len(at1) == 1, len(at2) == 1, at2[-1]]
    keep = np.flatnonzero((many[of2] if repeats else ~first | several[of1]) | (edge > 0))
    size = len(keep)
    columns = [pa.array(np.full(size, part), pa.int32()), *(pa.array(x[keep], t) for x, t in ((k2, pa.int64()), (doc, pa.int64()), (text_hash, pa.int64()), (start, pa.int32()), (more, pa.int32()), (at2[of2], pa.int64()), (first, pa.bool_()), (many[of2], pa.bool_()), (several[of1], pa.bool_()), (edge, pa.int32())))]
    names = ["part", "k2", "doc", "text_hash", "start", "more", "rank", "first", "many", "several", "edge", "note"]
    yield pa.RecordBatch.from_arrays([*columns, pa.nulls(size, pa.list_(pa.int64()))], names=names)
    nulls = [pa.nulls(1, c.type) for c in columns[1:]]
    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *nulls, pa.array([[int(x) for x in note]], pa.list_(pa.int64()))], names=names)


def across(notes: list[tuple[int, list[int]]]) -> list[tuple]:
    """notes (task, note) in order -> what a task cannot tell alone: task, rows
    before it, whether its first kind began earlier, and for its first and last
    group whether it has several kinds, its first and last kind many positions,
    and the rank of its first kind."""
    before, kind, group = 0, -1, -1
    several: list[bool] = []
    many: list[bool] = []
    rank: list[int] = []
    out, last = [], None
    for part, note in notes:
        n, k1, k2, last1, last2, several_first, several_last, many_first, many_last, one1, one2, at = note
        same1, same2 = last is not None and last[0] == k1, last == (k1, k2)
        if not same1:
            several.append(False)
            group += 1
        if not same2:
            many.append(False)
            rank.append(before)
            kind += 1
        lead1, lead2 = group, kind
        several[group] |= bool(several_first) or same1 and not same2
        many[kind] |= bool(many_first) or same2
        if not one1:
            several.append(bool(several_last))
            group += 1
        if not one2:
            many.append(bool(many_last))
            rank.append(before + at)
            kind += 1
        out.append((part, before, same2, lead1, group, lead2, kind))
        before, last = before + n, (last1, last2)
    return [(part, n, began, several[a], several[b], many[c], many[d], rank[c]) for part, n, began, a, b, c, d in out]


def rerank(rows: DataFrame, name: str, repeats: bool = False) -> DataFrame:
    """Sorts rows (ROWS, written before) by the pair k1, k2 and the position. rank:
    rows before the first of a pair; first: nothing of the pair lies before; many:
    the pair has several positions; several: k1 has several pairs. Rows in which
    all fields are equal count as one position. Rows that cannot matter (_number)
    are left out. Of each task, one row of notes passes the driver."""
    spark = rows.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // PART_ROWS))
    ordered = rows.repartitionByRange(n, *ORDER).sortWithinPartitions(*ORDER)
    found = common.materialise(common.map_batches(ordered, lambda batches: _number(batches, repeats), RANKED), name)
    notes = sorted((r["part"], r["note"]) for r in found.where("note is not null").select("part", "note").collect())
    fixes = spark.createDataFrame(across(notes), "part int, before long, began boolean, several1 boolean, several2 boolean, many1 boolean, many2 boolean, rank1 long")
    on = lambda bit: F.col("edge").bitwiseAND(F.lit(bit)) > 0
    # a row per task
    joined = found.where("note is null").drop("note").join(F.broadcast(fixes), "part")
    return joined.select(
        "k2", "doc", "text_hash", "start", "more", F.when(on(LEAD2), F.col("rank1")).otherwise(F.col("before") + F.col("rank")).alias("rank"),
        (F.col("first") & ~(on(LEAD2) & F.col("began"))).alias("first"),
        (F.col("many") | (on(LEAD2) & F.col("many1")) | (on(TAIL2) & F.col("many2"))).alias("many"),
        (F.col("several") | (on(LEAD1) & F.col("several1")) | (on(TAIL1) & F.col("several2"))).alias("several"),
    )


def _settle(rows: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Step 2, and 3: spans of the rows that occur before, and (slot, doc) the
    first rows of each kind where k1 has several."""
    found = rerank(rows, name)
    heads = found.where("first and several").select(F.pmod(F.col("k2").bitwiseXOR(F.col("doc")), F.lit(MAP_BITS)).alias("slot"), "doc")
    return found.where("not first").select("doc", "text_hash", "start", (F.col("start") + F.col("more") + LENGTH).alias("stop")), heads


def double(rows: DataFrame) -> DataFrame:
    """Step 4: rows (ROWS) by two ranks of QUARTER bytes, `more` set for strings
    and not for the places HALF after them -> spans of the strings that occur
    before."""
    offset = HALF
    found = rerank(rows, "ranks", repeats=True)
    common.discard(rows)
    while offset < LENGTH:
        alive = found.where("many")
        ahead = alive.select("doc", "text_hash", (F.col("start") - offset).alias("start"), F.col("rank").alias("k2")).distinct()
        pairs = alive.where("more > 0").drop("k2").join(ahead, ["doc", "text_hash", "start"])
        pairs = common.materialise(pairs.select(F.col("rank").alias("k1"), "k2", "doc", "text_hash", "start", "more"), "rank-pairs")
        offset *= 2
        found = rerank(pairs, "ranks", repeats=True)
        common.discard(pairs)
    return found.where("not first").select("doc", "text_hash", "start", (F.col("start") + LENGTH).alias("stop"))


def covered_spans(documents: DataFrame) -> DataFrame:
    """doc, text_hash, start, stop: strings that occur before, in bytes."""
    spark = documents.sparkSession
    send = lambda slots: spark.sparkContext.broadcast(common.bitmap(slots, MAP_BITS))
    rows = _rows(documents)
    grams = _scan(rows).groupBy("gram").agg(F.count("*").alias("n")).where("n > 1")
    in_grams = send(grams.select(F.pmod("gram", F.lit(MAP_BITS)).alias("slot")))
    heads, spans = [], []
    for _ in range(len(STEPS) + 1):
        parts = common.materialise(_scan(rows, in_grams, heads), "runs")
        more, left = _settle(parts, "run-ranks")
        common.discard(parts)
        spans.append(more)
        heads.append(send(left))
        # texts without any head have no more to tell
        rows = common.flagged(_rows(documents), "doc", left).where("hit").drop("hit")
    strings = common.materialise(_scan(rows, in_grams, heads, single=True), "strings")
    spans.append(double(strings))
    return reduce(DataFrame.union, spans)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is left of texts (doc, text, spans), all texts of a batch at once."""
    for batch in batches:
        buf, size = joined(batch.column(1))
        begin = np.cumsum(size) - size
        lists = batch.column(2).fill_null([])
        spans, base = lists.flatten(), np.repeat(begin, lists.value_lengths().to_numpy())
        edge = np.bincount(spans.field("start").to_numpy() + base, minlength=len(buf) + 1) - np.bincount(spans.field("stop").to_numpy() + base, minlength=len(buf) + 1)
        gone = np.cumsum(edge[:-1]) > 0
        new = gone.copy()
        new[1:] &= ~gone[:-1]
        new[begin[size > 0]] = gone[begin[size > 0]]
        upto = lambda x: np.concatenate([[0], np.cumsum(x)])
        in_text = lambda x: upto(x)[begin + size] - upto(x)[begin]
        removed, n_spans = in_text(gone), in_text(new)
        rest = memoryview(buf[~gone])
        stop = np.cumsum(size - removed)
        digest = [hashlib.sha256(rest[b - n : b]).hexdigest() for b, n in zip(stop.tolist(), (size - removed).tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(removed), pa.array(n_spans), pa.array(digest, pa.string())], names=["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def remove_repeats(documents: DataFrame) -> DataFrame:
    """doc (key), n_bytes, n_removed, n_spans, kept_sha256: a row per document.

    Null texts are empty, and texts under LENGTH bytes lose nothing. Rows
    without a doc_id come after all others. Rows with the same doc_id, or
    without one, come in the order of a hash of their texts, equal texts at
    once. An empty table gives no rows. Other columns are ignored.
    """
    spans = covered_spans(documents).groupBy("doc", "text_hash").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    spans = common.materialise(spans, "spans")
    may, others = common.split_by(_rows(documents), spans.select("doc"), key="doc")
    touched = common.map_batches(may.select("row.*").join(spans, ["doc", "text_hash"], "left").select("doc", "text", "spans"), _digest, RESULT)
    # nothing goes from the others: they need no Python
    zero = F.lit(0).cast("long")
    return touched.union(others.select("doc", F.octet_length("row.text").cast("long"), zero, zero, F.sha2("row.text", 256)))


def op3(spark, sf_dir: str) -> DataFrame:
    found = remove_repeats(common.table(spark, sf_dir, "documents"))
    return found.select(common.id_from_key("doc").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")
