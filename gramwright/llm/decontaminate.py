"""Benchmark decontamination with suffix arrays over the training documents.

Each task cuts its documents into shards and builds a suffix array of each
shard's words by prefix doubling. Every suffix of every benchmark item is then
binary-searched in it, which gives its longest verbatim match. Where that reaches
a window, all places that share the window are located and their words are hit.
Documents never move: the benchmark does, in blocks of bounded size, of which
the driver holds one at a time, so that there is no shuffle however large the
documents are. One block takes one pass, in which rows stay in the JVM and only
texts go through Python; of further blocks, only the rows that they hit are kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import slices, utf8, word_table

#: Words of a window, for documents to be hit at all.
WINDOW = 8
#: Items that make a document contaminated.
LEAST_ITEMS = 2
#: Bytes of benchmark text sent to the tasks at once; more makes more passes.
BLOCK_BYTES = 8 << 20
#: Bytes of text of a shard; a longer text is a shard of its own.
SHARD_BYTES = 1 << 21

SEPARATOR = np.ones(256, bool)
SEPARATOR[0x30:0x3A] = SEPARATOR[0x61:0x7B] = SEPARATOR[0x80:] = False



def _words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    found, owner, _, _ = word_table([t.lower() for t in texts], SEPARATOR)
    return found, owner


class TestSet:
    """Suffixes of the benchmark items of one block."""

    __test__ = False

    def __init__(self, rows: list[tuple[str, bytes]]):
        self.items = [r[0] for r in rows]
        words, owner = _words([r[1] for r in rows])
        self.words, self.owner = words, owner
        count = np.bincount(owner, minlength=len(rows))
        end = np.cumsum(count)
        self.left = end[owner] - np.arange(len(words))  # words from a suffix's start on
        self.count = count
        self.vocabulary = np.unique(words)
        # a suffix must match at least a window, or the whole of a shorter item
        self.need = np.minimum(WINDOW, count)[owner]
        self.whole = np.arange(len(words)) == (end - count)[owner]
        self.longest = int(count.max(initial=0))


class Shard:
    """Suffix array over the words of some documents, down to a given depth.

    Only suffixes that begin with a word of the test set are kept: no other
    can begin a match. Ranks of 1, 2, 4, ... words come from sorting pairs of
    ranks; doubling ends once the order is strict or the depth is passed.
    """

    def __init__(self, words: np.ndarray, owner: np.ndarray, test: TestSet):
        n = len(words)
        place = np.searchsorted(test.vocabulary, words)
        place[place == len(test.vocabulary)] = 0
        known = test.vocabulary[place] == words if len(test.vocabulary) else np.zeros(n, bool)
        # code of a word: its rank in the vocabulary + 1; 0 for any other word and between documents
        code = np.where(known, place + 1, 0)
        gap = np.flatnonzero(np.diff(owner)) + 1
        self.at = np.arange(n) + np.searchsorted(gap, np.arange(n), side="right")
        self.code = np.zeros(n + len(gap) + 1, np.int64)
        self.code[self.at] = code
        self.word_of = np.zeros(len(self.code), np.int64)
        self.word_of[self.at] = np.arange(n)
        self.suffixes = np.flatnonzero(self.code)
        self._sort(test.longest)

    def _sort(self, depth: int) -> None:
        size, reach = len(self.code), 1
        rank = self.code.copy()
        live = self.suffixes
        while reach < depth and len(live):
            follow = np.zeros(len(live), np.int64)
            ahead = live + reach
            follow[ahead < size] = rank[ahead[ahead < size]]
            pair = rank[live] * (size + 1) + follow
            order = np.argsort(pair, kind="stable")
            step = np.diff(pair[order], prepend=pair[order[:1]]) != 0
            fresh = np.zeros(size, np.int64)
            fresh[live[order]] = np.cumsum(step) + 1
            rank = fresh
            reach *= 2
            if step[1:].all():
                break
        self.array = live[np.argsort(rank[live], kind="stable")]

    def longest(self, test: TestSet) -> np.ndarray:
        """Words of the longest match of each test suffix."""
        code = np.searchsorted(test.vocabulary, test.words) + 1
        every = np.arange(len(code))
        where = self._search(code, test.left, every, upper=False)
        best = np.zeros(len(code), np.int64)
        for near in (where - 1, where):
            ok = (near >= 0) & (near < len(self.array))
            best[ok] = np.maximum(best[ok], self._shared(self.array[near[ok]], every[ok], code, test.left))
        return best

    def places(self, test: TestSet, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and end row of the array whose suffixes share the words that the
        test suffixes `which` need."""
        code = np.searchsorted(test.vocabulary, test.words) + 1
        return self._search(code, test.need, which, upper=False), self._search(code, test.need, which, upper=True)

    def _shared(self, spot: np.ndarray, suffix: np.ndarray, code: np.ndarray, left: np.ndarray) -> np.ndarray:
        """Words that the document suffixes at spot and the test suffixes share."""
        out, going, k = np.zeros(len(spot), np.int64), np.arange(len(spot)), 0
        while len(going):
            s, t = spot[going] + k, suffix[going] + k
            same = (k < left[suffix[going]]) & (s < len(self.code))
            going, s, t = going[same], s[same], t[same]
            going = going[self.code[s] == code[t]]
            out[going] += 1
            k += 1
        return out

    def _search(self, code: np.ndarray, words: np.ndarray, which: np.ndarray, upper: bool) -> np.ndarray:
        """First row of the array whose suffix is not below (above, if upper)
        the first words of each of the test suffixes, as many as words says."""
        low, high = np.zeros(len(which), np.int64), np.full(len(which), len(self.array), np.int64)
        while (active := np.flatnonzero(low < high)).size:
            mid, suffix = (low[active] + high[active]) // 2, which[active]
            spot = self.array[mid]
            same = self._shared(spot, suffix, code, words)
            done = same >= words[suffix]
            ahead = np.minimum(spot + same, len(self.code) - 1)
            below = np.where(done, upper, self.code[ahead] < code[np.minimum(suffix + same, len(code) - 1)])
            low[active[below]] = mid[below] + 1
            high[active[~below]] = mid[~below]
        return low


def _shards(texts: list[bytes], test: TestSet) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, Shard]]:
    for lo, hi in slices(texts, SHARD_BYTES):
        words, owner = _words(texts[lo:hi])
        yield lo, hi, words, owner, Shard(words, owner, test)


def _spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every row of the ranges [low, high), with the index of its range."""
    size = np.maximum(high - low, 0)
    which = np.repeat(np.arange(len(low)), size)
    first = np.cumsum(size) - size
    return np.arange(size.sum()) - first[which] + low[which], which


def _hits(texts: list[bytes], test: TestSet) -> Iterator[tuple[np.ndarray, set[int]]]:
    """For each text: which of its words are hit, and the items with occurring windows."""
    starts = (test.left >= WINDOW) | (test.whole & (test.count[test.owner] < WINDOW))
    for lo, hi, words, owner, shard in _shards(texts, test):
        found = np.flatnonzero(starts & (shard.longest(test) >= test.need))
        low, high = shard.places(test, found)
        hit = np.zeros(len(words) + 1, np.int64)
        # the same window may begin in several items: its matches are walked once
        ranges: dict[tuple[int, int, int], list[int]] = {}
        for s, a, b in zip(found.tolist(), low.tolist(), high.tolist(), strict=True):
            ranges.setdefault((a, b, int(test.need[s])), []).append(int(test.owner[s]))
        items: list[set[int]] = [set() for _ in range(hi - lo)]
        for (a, b, need), who in ranges.items():
            at = shard.word_of[shard.array[a:b]]
            np.add.at(hit, at, 1)
            np.add.at(hit, at + need, -1)
            for d in np.unique(owner[at]):
                items[d].update(who)
        marked = np.cumsum(hit[:-1]) > 0
        bounds = np.searchsorted(owner, np.arange(hi - lo + 1))
        for d in range(hi - lo):
            yield marked[bounds[d] : bounds[d + 1]], items[d]


def blocks(benchmark: DataFrame, limit: int = BLOCK_BYTES) -> Iterator[list[tuple[str, bytes]]]:
    """The benchmark's items with an id, in blocks of at most limit bytes."""
    rows: list[tuple[str, bytes]] = []
    size = 0
    named = benchmark.where(F.col("item_id").isNotNull())
    for r in named.select(F.col("item_id").cast("string").alias("i"), F.col("text").alias("t")).toLocalIterator():
        text = (r["t"] or "").encode("utf-8", "surrogatepass")
        if rows and size + len(text) > limit:
            yield rows
            rows, size = [], 0
        rows.append((r["i"], text))
        size += len(text)
    yield rows


FOUND = "n_words long, n_hit long, mask binary, items array<string>"


def _judge(spark: SparkSession, rows: list[tuple[str, bytes]]) -> tuple[Callable[[Column], Column], Broadcast]:
    """What one block of the benchmark hits in a text, as a column (FOUND)."""
    common.bound_batches(spark)
    sent = spark.sparkContext.broadcast(rows)  # at most BLOCK_BYTES, or one item

    @F.arrow_udf(f"struct<{', '.join(': '.join(c.split()) for c in FOUND.split(', '))}>")
    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        test = TestSet(sent.value)
        for batch in batches:
            found = list(_hits(utf8(batch), test))
            columns = [
                pa.array([len(mask) for mask, _ in found], pa.int64()), pa.array([int(mask.sum()) for mask, _ in found], pa.int64()),
                pa.array([np.packbits(mask).tobytes() if len(who) else None for mask, who in found], pa.binary()), pa.array([[test.items[i] for i in who] for _, who in found], pa.list_(pa.string())),
            ]
            yield pa.StructArray.from_arrays(columns, names=["n_words", "n_hit", "mask", "items"])
        common.give_back()

    return judge, sent


def _marked(masks: pa.Array) -> pa.Array:
    """Words that any of several masks marks."""
    return pa.array([int(np.bitwise_count(reduce(np.bitwise_or, (np.frombuffer(m, np.uint8) for m in some))).sum()) if some else 0 for some in masks.to_pylist()], pa.int64())


def _judged(documents: DataFrame, benchmark: DataFrame, limit: int) -> DataFrame:
    """row (all columns), n_words, n_hit and the distinct sorted items of each row."""
    spark = documents.sparkSession
    parts = blocks(benchmark, limit)
    judge, _ = _judge(spark, next(parts))
    second = next(parts, None)
    text = lambda column: F.col(column).cast("string")
    items = lambda column: F.array_sort(F.array_distinct(F.col(column)))
    if second is None:
        found = documents.select(F.struct("*").alias("row"), judge(text("text")).alias("found"))
        return found.select("row", "found.n_words", "found.n_hit", items("found.items").alias("items"))
    # keys stay the same as the rows are written once
    keyed = common.materialise(documents.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("key")), "keyed-documents")
    hits = []
    for k, rows in enumerate(chain([None, second], parts)):
        if k:
            judge, sent = _judge(spark, rows)
        found = keyed.select("key", judge(text("row.text")).alias("found")).where(F.size("found.items") > 0)
        hits.append(common.materialise(found.select("key", "found.mask", "found.items"), "benchmark-hits"))
        if k:
            sent.unpersist()
    every = reduce(DataFrame.union, hits).groupBy("key").agg(F.collect_list("mask").alias("masks"), F.flatten(F.collect_list("items")).alias("items"))
    every = every.select("key", F.arrow_udf(_marked, "long")("masks").alias("n_hit"), "items")
    judge, _ = _judge(spark, [])
    counted = keyed.select("row", "key", judge(text("row.text"))["n_words"].alias("n_words")).join(every, "key", "left")
    return counted.select("row", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce(items("items"), F.array().cast("array<string>")).alias("items"))


def find_hits(documents: DataFrame, benchmark: DataFrame, least_items: int = LEAST_ITEMS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: words, hit words, items with occurring windows.

    A window is WINDOW consecutive words of an item, or the whole of a shorter
    item that has words. Null or wordless texts have no words and no hits; a
    null doc_id stays null; rows with the same doc_id are judged one by one; an
    empty benchmark hits nothing; items without an id are left out, as they
    can't be named, and items with the same id count once. Other columns of the
    documents are ignored. A benchmark over block_bytes takes a pass per block.
    """
    narrow = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _judged(narrow, benchmark, block_bytes).select(
        "row.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("items") >= least_items).alias("contaminated"), "items"
    )


def remove_contaminated(documents: DataFrame, benchmark: DataFrame, least_items: int = LEAST_ITEMS) -> DataFrame:
    """The documents, all columns kept, without the contaminated ones (as
    find_hits judges them)."""
    return _judged(documents, benchmark, BLOCK_BYTES).where(F.size("items") < least_items).select("row.*")


def longest_matches(documents: DataFrame, benchmark: DataFrame, least: int = WINDOW) -> DataFrame:
    """Longest verbatim match of each item in each document, with its places in
    words: doc_id, item_id, doc_word, item_word, n_words (at least `least`)."""
    parts = list(blocks(benchmark))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests = [TestSet(p) for p in parts]
        for batch in batches:
            texts, ids = utf8(batch.column(1)), batch.column(0).to_pylist()
            out: list[tuple] = []
            for test in tests:
                for lo, _, _, owner, shard in _shards(texts, test):
                    reach = np.flatnonzero(shard.longest(test) >= test.need)
                    rows, suffix = _spread(*shard.places(test, reach))
                    spot, suffix = shard.array[rows], reach[suffix]
                    code = np.searchsorted(test.vocabulary, test.words) + 1
                    size = shard._shared(spot, suffix, code, test.left)
                    best: dict[tuple[int, int], tuple] = {}
                    for p, s, n in zip(shard.word_of[spot].tolist(), suffix.tolist(), size.tolist(), strict=True):
                        key = (int(owner[p]), int(test.owner[s]))
                        if n >= min(least, int(test.count[test.owner[s]])):
                            best[key] = max(best.get(key, (0, 0, 0)), (n, -p, -s))
                    for (d, i), (n, p, s) in best.items():
                        first_doc = int(np.searchsorted(owner, d))
                        first_item = int(np.searchsorted(test.owner, i))
                        out.append((ids[lo + d], test.items[i], -p - first_doc, -s - first_item, n))
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            names = ["doc_id", "item_id", "doc_word", "item_word", "n_words"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    schema = "doc_id long, item_id string, doc_word long, item_word long, n_words long"
    return common.map_batches(documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, schema)


def op8(spark, sf_dir: str) -> DataFrame:
    return find_hits(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark")).drop("items")
