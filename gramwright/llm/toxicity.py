"""Toxicity by a factorization machine over hashed terms of whole texts.

A text's terms are its words, the first bytes of its words, and pairs of words
that follow each other, all hashed into BUCKETS. The machine adds a weight for
each present term and, for each pair of present terms, the product of their
factors: an insult beside a mention of a group can count for more than both.
Every bucket has a weight and factors. A present term counts as much as its
share among toxic rows departs from chance (Machine.scale), so that thousands
of neutral terms don't drown a few that tell. It is trained on at most SAMPLE
labelled rows that are not held out, taken by the hash of their id, on the
driver, in an order that depends on the ids alone: however documents are dealt
over partitions, the same rows give the same machine. Their terms lie in a file
of the driver's own; it holds those of a step at a time. Every row is scored where
it is read, and only texts go through Python: there is no shuffle of documents.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import BYTE_VALUE, mix, slices

BUCKETS = 1 << 20
#: Bound on labelled rows used for training.
SAMPLE = 16_384
FACTORS = 8
ROUNDS = 4
#: Rows of a step of training.
STEP_ROWS = 256
#: Buckets whose parameters are changed at once: a bound on memory, not on the result.
STEP_BUCKETS = 1 << 14
#: Squared deviations at which a term counts by half.
DOUBT = 40.0
THRESHOLD = 0.3
HELD_OUT = (4, 2)

#: Bytes of a word's start that make a term of their own.
STARTS = (4, 5, 7)

SEPARATOR = np.ones(256, bool)
SEPARATOR[0x61:0x7B] = SEPARATOR[0x80:] = False


def held_out(column: str = "doc_id"):
    n, k = HELD_OUT
    return F.coalesce(F.crc32(F.col(column).cast("string")) % n == k, F.lit(False))


def terms(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all terms of all texts (repeats kept), with the text's index."""
    raw = [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts]
    words, owner, start, end = common.word_table(raw, SEPARATOR)
    if not len(words):
        return np.zeros(0, np.int64), owner
    buf = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    begin = np.concatenate([[0], np.cumsum([len(t) + 1 for t in raw])])[owner] + start
    length = end - start
    step = np.uint64(0x9E3779B97F4A7C15)
    sums, out, who = np.zeros(len(words), np.uint64), [words], [owner]
    power = np.cumprod(np.append(np.uint64(1), np.full(max(STARTS), step, np.uint64)))
    for n in range(1, max(STARTS) + 1):
        more = length >= n
        sums[more] += BYTE_VALUE[buf[begin[more] + n - 1]] * power[n - 1]
        if n in STARTS:
            out.append(mix(sums[more] + np.uint64(n)))
            who.append(owner[more])
    follow = owner[1:] == owner[:-1]
    out.append(mix(words[:-1] * step + words[1:])[follow])
    who.append(owner[1:][follow])
    kinds = [np.full(len(x), k, np.uint64) for k, x in enumerate(out)]
    h = mix(np.concatenate(out) ^ (np.concatenate(kinds) << np.uint64(56)))
    return (h >> np.uint64(44)).astype(np.int64), np.concatenate(who)


def distinct(bucket: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    pair = np.unique(owner * BUCKETS + bucket)
    return pair % BUCKETS, pair // BUCKETS


def distinct_terms(texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Passes over texts: the first text's index, buckets and texts' indices from it on."""
    for lo, hi in slices([t.encode("utf-8", "surrogatepass") for t in texts]):
        yield lo, *distinct(*terms(texts[lo:hi]))


def packed(bucket: np.ndarray) -> bytes:
    """Distinct sorted buckets: how many have each upper part, then the lower 16 bits."""
    return np.bincount(bucket >> 16, minlength=BUCKETS >> 16).astype("<u4").tobytes() + (bucket & 0xFFFF).astype("<u2").tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    n = BUCKETS >> 16
    if not raw:
        return np.zeros(0, np.int32)
    upper = np.repeat(np.arange(n, dtype=np.int32) << 16, np.frombuffer(raw, "<u4", n))
    return upper | np.frombuffer(raw, "<u2", offset=4 * n)


class FileRows(Sequence):
    """Buckets of rows in a file that goes when this does; only rows asked for are in memory."""

    def __init__(self):
        self.file = tempfile.TemporaryFile()  # noqa: SIM115
        self.ends = [0]
        self.order = None

    def append(self, raw: bytes) -> None:
        self.file.write(raw)
        self.ends.append(self.ends[-1] + len(raw))

    def __len__(self) -> int:
        return len(self.ends) - 1

    def __getitem__(self, k):
        if isinstance(k, slice):
            return [self[i] for i in range(*k.indices(len(self)))]
        if not 0 <= k < len(self):
            raise IndexError(k)
        at = k if self.order is None else self.order[k]
        self.file.seek(self.ends[at])
        return unpacked(self.file.read(self.ends[at + 1] - self.ends[at]))


@dataclass
class Machine:
    bias: float
    table: np.ndarray | None  # a bucket's weight and FACTORS factors; None: the bias alone

    def raw(self, bucket: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        """Scores before the sigmoid of n rows, from distinct (bucket, row) pairs."""
        out = np.full(n, self.bias)
        if self.table is None:
            return out
        own = self.table[bucket]
        for f in range(own.shape[1]):
            total = np.bincount(owner, own[:, f], n)
            out += total if not f else 0.5 * (total * total - np.bincount(owner, own[:, f].astype(float) ** 2, n))
        return out

    def score(self, texts: list[str]) -> np.ndarray:
        raw = np.full(len(texts), self.bias)
        for lo, bucket, owner in distinct_terms(texts):
            some = self.raw(bucket, owner, int(owner.max(initial=-1)) + 1)
            raw[lo : lo + len(some)] = some
        return 1 / (1 + np.exp(-np.clip(raw, -35, 35)))


def scale(rows: Sequence[np.ndarray], label: np.ndarray) -> np.ndarray:
    """From 0 to 1 for each bucket: how sure it is that its share among toxic
    rows is not that of all rows."""
    share = (label.sum() + 0.5) / (len(label) + 1)
    toxic, every = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for x, y in zip(rows, label, strict=True):
        every[x] += 1
        toxic[x] += y
    toxic -= every * share
    toxic **= 2
    every *= share
    every *= 1 - share
    every += 0.5
    toxic /= every  # how far apart, squared
    np.add(toxic, DOUBT, out=every)
    return (toxic / every).astype(np.float32)


def fit(rows: Sequence[np.ndarray], label: np.ndarray, rounds: int = ROUNDS, rate: float = 0.3, decay: float = 1e-5) -> Machine:
    """Steps of STEP_ROWS rows on log loss, each bucket's step by its gradients
    so far. rows: the distinct buckets of each; the start is fixed."""
    n = len(label)
    share = (label.sum() + 0.5) / (n + 1)
    bias = float(np.log(share / (1 - share)))
    if not 0 < label.sum() < n:
        return Machine(bias, None)
    known = scale(rows, label)
    params = np.random.default_rng(7).standard_normal((BUCKETS, 1 + FACTORS), dtype=np.float32)
    params *= np.float32(0.1)
    params[:, 0] = 0
    past = np.full(params.shape, 1e-6, np.float32)
    pace = np.array([rate] + [rate / 4] * FACTORS, np.float32)
    for _ in range(rounds):
        for lo in range(0, n, STEP_ROWS):
            some = rows[lo : lo + STEP_ROWS]
            m = len(some)
            owner = np.repeat(np.arange(m), [len(x) for x in some])
            bucket, place = np.unique(np.concatenate(some), return_inverse=True)
            own = params[bucket] * known[bucket, None]
            total = np.stack([np.bincount(owner, own[place, f], m) for f in range(1 + FACTORS)], 1)
            square = np.bincount(owner, (own[:, 1:] ** 2).sum(1)[place], m)
            raw = bias + total[:, 0] + 0.5 * ((total[:, 1:] ** 2).sum(1) - square)
            error = (1 / (1 + np.exp(-np.clip(raw, -35, 35))) - label[lo : lo + m]) / m
            by_term = np.bincount(place, error[owner], len(bucket))
            grad = np.empty(own.shape, np.float32)
            grad[:, 0] = by_term
            for f in range(1, 1 + FACTORS):
                grad[:, f] = np.bincount(place, (error * total[:, f])[owner], len(bucket)) - by_term * own[:, f]
            for k in range(0, len(bucket), STEP_BUCKETS):
                at = bucket[k : k + STEP_BUCKETS]
                g = grad[k : k + STEP_BUCKETS] * known[at, None] + decay * params[at]
                past[at] += g * g
                params[at] -= pace * g / np.sqrt(past[at])
            bias -= rate / 10 * float(error.sum())
    params *= known[:, None]
    return Machine(bias, params)


def train(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """The machine from at most `sample` rows of labels that are not held out.

    Labels without doc_id or toxic are ignored; an id labelled twice counts as
    toxic if any of its labels is; of documents with the same id the text of
    least hash is taken. Without labelled rows, or with one class alone, every
    text gets the same score. The driver gets the distinct buckets, 2 bytes
    each, of at most `sample` texts, a partition at a time, and keeps them in a file.
    """
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out())
        .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
        .orderBy(F.xxhash64(F.lit("sample"), "doc_id"), "doc_id").limit(sample)
    )
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).join(F.broadcast(chosen), "doc_id")
    one = rows.groupBy("doc_id", "toxic").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text"))["text"].alias("text"))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            found = [b""] * len(texts)
            for lo, bucket, owner in distinct_terms(texts):
                bounds = np.searchsorted(owner, np.arange(int(owner.max(initial=-1)) + 2))
                for k in range(len(bounds) - 1):
                    found[lo + k] = packed(bucket[bounds[k] : bounds[k + 1]])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], names=["doc_id", "toxic", "terms"])

    kept = common.materialise(common.map_batches(one, pick, "doc_id long, toxic int, terms binary"), "toxicity-terms")
    rows, ids, label = FileRows(), [], []
    for r in kept.toLocalIterator():
        rows.append(bytes(r["terms"]))
        ids.append(r["doc_id"])
        label.append(r["toxic"])
    common.discard(kept)
    ids = np.array(ids, np.int64)
    rows.order = np.lexsort((ids, mix(ids.view(np.uint64))))
    machine = fit(rows, np.array(label, float)[rows.order])
    common.give_back()  # the driver's own
    return machine


def score(documents: DataFrame, machine: Machine, column: str = "score") -> DataFrame:
    """The documents with a score from 0 to 1; null and empty texts get the
    score of a text without terms. All columns stay; one of the name `column`
    is replaced."""
    common.bound_batches(documents.sparkSession)
    sent = documents.sparkSession.sparkContext.broadcast(machine)  # at most BUCKETS x 9 numbers of 4 bytes

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(sent.value.score([t or "" for t in texts.to_pylist()]), pa.float64())
        common.give_back()

    return documents.withColumn(column, scored(F.col("text").cast("string")))


def op5(spark, sf_dir: str) -> DataFrame:
    documents, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    scored = score(documents.select("doc_id", "text"), train(documents, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
