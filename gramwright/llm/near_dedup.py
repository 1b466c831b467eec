"""MinHash near-dedup with odd sketches.

One pass over the documents gives each a digest of its shingle set, MinHash
bands, and an odd sketch: MinHash samples (the least hash in each of BINS bins)
are folded into a bitmap of parities. Two bitmaps' differing bits tell how many
samples differ, precisely so at high similarities. Documents of equal sets form
a class and go on as one. Classes that meet in a band are candidates; those
whose sketches allow the threshold are compared on their full sets.

Buckets are never expanded into pairs. First each member is compared with one
leader, another one in each band; confirmed links join most of a group. Only
buckets that still hold several components are looked at again, in tiles of
bounded size, to which members bring their full sets: sketches of members of
different components are compared by numpy, pairs that may reach the threshold
are confirmed on the spot, and a tile returns no more links than it joins
components. A pair at the threshold is missed by all bands with a chance of
1e-6, and by the sketches with one of 1e-6.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import WHITE, grams, mix, slices, utf8, word_table
from .components import connected

SHINGLE = 5
BANDS, ROWS = 24, 5
BINS, BITS = 512, 1024
#: Least similarity of a link, in hundredths, if the caller names no other.
LINK = 85
#: Bands, and rows of each, for a least similarity: at it, all bands miss with a chance of 1e-6 at most.
BANDING = {85: (BANDS, ROWS), 80: (27, 4)}
#: A pair is dropped if its sketches' similarity is this many deviations under the threshold.
DEVIATIONS = 5
#: Members of a tile's side, and shingles of all of them.
TILE, TILE_SHINGLES = 512, 1 << 19
PARITY = BITS // 64
WIDTH = PARITY + BINS // 64  # parities, then which bins have a sample

_rng = np.random.default_rng(5)
_XOR = _rng.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32)
_MUL = _rng.integers(0, 2**31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)

SIGNATURE = "doc long, n_shingles long, set_a long, set_b long, bands array<long>, sketch array<long>, samples int"


def shingles(texts: list[bytes], n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every text, sorted, with the text's index."""
    words, owner, _, _ = word_table([t.lower() for t in texts], WHITE)
    if not len(words):
        return words, owner
    count = np.bincount(owner, minlength=len(texts))
    last = np.cumsum(count)[owner] - np.arange(len(words))  # words from here to the text's end
    hashes = grams(words, n)
    whole = last >= n
    out, who = [hashes[whole]], [owner[whole]]
    first = np.flatnonzero((last == count[owner]) & (count[owner] < n))
    for k in range(1, n):
        at = first[count[owner[first]] == k]
        out.append(mix(grams(words, k)[at] + np.uint64(k)))
        who.append(owner[at])
    h, o = np.concatenate(out), np.concatenate(who)
    order = np.lexsort((h, o))
    h, o = h[order], o[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    return h[new], o[new]


def signatures(texts: list[bytes], link: int = LINK) -> tuple[np.ndarray, ...]:
    """n_shingles, two digests of the set, bands, sketches, samples; rows of
    texts without words are zero."""
    n = len(texts)
    n_bands, n_rows = BANDING[link]
    h, owner = shingles(texts)
    size = np.bincount(owner, minlength=n)
    digest = np.zeros((2, n), np.uint64)
    bands = np.zeros((n, n_bands), np.uint64)
    sketch = np.zeros((n, WIDTH), np.uint64)
    samples = np.zeros(n, np.int64)
    rows = np.flatnonzero(size)
    if not len(rows):
        return size, digest, bands, sketch, samples
    start = np.searchsorted(owner, rows)
    for k in (0, 1):
        digest[k, rows] = mix(np.add.reduceat(mix(h + np.uint64(k + 1)), start) + size[rows].astype(np.uint64))
    short = (h >> np.uint64(32)).astype(np.uint32)
    for b in range(n_bands):
        key = np.full(len(rows), b + 1, np.uint64)
        for k in range(b * n_rows, (b + 1) * n_rows):
            least = np.minimum.reduceat((short ^ _XOR[k]) * _MUL[k], start)
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + least)
        bands[rows, b] = key
    # hashes ascend within a text: the first of a bin is its least
    place = owner * BINS + (h & np.uint64(BINS - 1)).astype(np.int64)
    place, first = np.unique(place, return_index=True)
    sampled = place // BINS
    samples = np.bincount(sampled, minlength=n)
    bit = (mix(h[first] ^ np.uint64(0xA5A5A5A5A5A5A5A5)) >> np.uint64(54)).astype(np.int64)
    odd = (np.bincount(sampled * BITS + bit, minlength=n * BITS) & 1).astype(np.uint8)
    taken = np.zeros((n, BINS), np.uint8)
    taken.ravel()[place] = 1
    sketch = np.packbits(np.concatenate([odd.reshape(n, BITS), taken], 1), axis=1, bitorder="little").view(np.uint64)
    return size, digest, bands, sketch, samples


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def _lists(x: np.ndarray) -> pa.Array:
    flat = pa.array(_signed(x).ravel())
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), flat)


def _sign(batches: Iterator[pa.RecordBatch], link: int = LINK) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, ids = utf8(batch.column(1)), batch.column(0)
        for lo, hi in slices(texts):
            size, digest, bands, sketch, samples = signatures(texts[lo:hi], link)
            columns = [ids.slice(lo, hi - lo), pa.array(size, pa.int64()), pa.array(_signed(digest[0])), pa.array(_signed(digest[1])), _lists(bands), _lists(sketch), pa.array(samples, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc", "n_shingles", "set_a", "set_b", "bands", "sketch", "samples"])


def shortfall(apart, either, samples, sizes, m, link=LINK):
    """How far, in deviations, a pair's sketches put it under link, by parities
    that differ and bins taken in either. m has log, sqrt, exp, least and
    greatest, of numpy or of columns.

    Samples that differ follow from the parities; the similarity is the share
    of taken bins that agree. It varies as far as samples leave shingles out,
    and by parities that cancel each other.
    """
    (sa, sb), (na, nb) = samples, sizes
    differ = -BITS / 2 * m.log(1 - 2 * m.least(apart, BITS / 2 - 1) / BITS)
    found = (sa + sb - differ) / 2 / either
    left_out = 1 - m.least(sa / na, sb / nb)
    at = m.greatest(sa + sb - 2 * link / 100 * either, 1.0)
    e = m.exp(-4 * at / BITS)
    spread = link / 100 * (1 - link / 100) * left_out / either + (BITS / 4 * (1 - e) - at * e) / e / 4 / (either * either)
    return (link / 100 - found - 1 / either) / m.sqrt(spread + 1e-12)


class _Numpy:
    log, sqrt, exp, least, greatest = np.log, np.sqrt, np.exp, np.minimum, np.maximum


class _Columns:
    log, sqrt, exp = F.log, F.sqrt, F.exp
    least = staticmethod(lambda a, b: F.least(a, b if hasattr(b, "cast") else F.lit(float(b))))
    greatest = staticmethod(lambda a, b: F.greatest(a, b if hasattr(b, "cast") else F.lit(float(b))))


def _near(columns: tuple[str, str], link: int):
    a, b = columns
    bits = lambda xs: F.aggregate(xs, F.lit(0), lambda t, x: t + F.bit_count(x)).cast("double")
    part = lambda s, at, n: F.slice(f"sketch_{s}", at, n)
    apart = bits(F.zip_with(part(a, 1, PARITY), part(b, 1, PARITY), lambda x, y: x.bitwiseXOR(y)))
    either = bits(F.zip_with(part(a, PARITY + 1, WIDTH - PARITY), part(b, PARITY + 1, WIDTH - PARITY), lambda x, y: x.bitwiseOR(y)))
    number = lambda name: (F.col(f"{name}_{a}").cast("double"), F.col(f"{name}_{b}").cast("double"))
    return shortfall(apart, either, number("samples"), number("n_shingles"), _Columns, link) <= DEVIATIONS


def _compare(batches: Iterator[pa.RecordBatch], link: int = LINK) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        left, right = utf8(batch.column(2)), utf8(batch.column(3))
        place: dict[bytes, int] = {}
        for t in (*left, *right):
            place.setdefault(t, len(place))
        texts = list(place)
        sets: list[np.ndarray] = []
        for lo, hi in slices(texts):
            h, owner = shingles(texts[lo:hi])
            bounds = np.searchsorted(owner, np.arange(hi - lo + 1))
            sets += [h[bounds[k] : bounds[k + 1]] for k in range(hi - lo)]
        keep = []
        for k in range(len(a)):
            x, y = sets[place[left[k]]], sets[place[right[k]]]
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * both >= link * (len(x) + len(y) - both) and both > 0)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def texts_of(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """doc and text of the documents in ids. A bitmap of fixed size leaves most
    others out before the join, while ids are few against its size; the join is
    what decides."""
    may, _ = common.split_by(documents.select("doc_id", F.col("text").cast("string").alias("text")), ids)
    return may.select("doc", "row.text").join(ids, "doc")


def confirm(pairs: DataFrame, reps: DataFrame, documents: DataFrame, link: int = LINK) -> DataFrame:
    """Those of the pairs (a, b) that are links: sketches first, then full sets."""
    side = lambda s: reps.select(F.col("doc").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in ("sketch", "samples", "n_shingles")))
    near = pairs.join(side("a"), "a").join(side("b"), "b").where(_near(("a", "b"), link)).select("a", "b")
    near = common.materialise(near, "near-pairs")
    ids = near.select(F.col("a").alias("doc")).union(near.select(F.col("b").alias("doc"))).distinct()
    texts = common.materialise(texts_of(documents, ids), "near-texts", small=True)
    named = lambda s: texts.select(F.col("doc").alias(s), F.col("text").alias(f"text_{s}"))
    both = near.join(named("a"), "a").join(named("b"), "b").select("a", "b", "text_a", "text_b")
    links = common.materialise(common.map_batches(both, lambda batches: _compare(batches, link), "a long, b long").distinct(), "near-links", rows=near.count())
    common.discard(near, texts)
    return links


def _linked(x: np.ndarray, y: np.ndarray, link: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both > 0 and 100 * both >= link * (len(x) + len(y) - both)


def _tile(table: pa.Table, link: int = LINK) -> pa.Table:
    """Links of one tile between components that it has not yet joined, of
    members that were not together in an earlier band."""
    n = table.num_rows
    doc, comp, block, samples = (table.column(c).to_numpy() for c in ("doc", "comp", "block", "samples"))
    wide = lambda c, w: table.column(c).combine_chunks().flatten().to_numpy().reshape(n, w)
    sketch, bands = wide("sketch", WIDTH).view(np.uint64), wide("bands", BANDING[link][0])
    sets = table.column("shingles").combine_chunks()
    size = sets.value_lengths().to_numpy().astype(float)
    held = np.split(sets.flatten().to_numpy().view(np.uint64), np.cumsum(size.astype(int))[:-1])
    samples, band = samples.astype(float), int(table.column("band")[0].as_py())
    i, j = int(table.column("i")[0].as_py()), int(table.column("j")[0].as_py())
    left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
    comp = comp.copy()
    out = []
    for x in left:
        y = right[(comp[right] != comp[x]) & ((doc[right] > doc[x]) if i == j else (doc[right] != doc[x]))]
        if not len(y):
            continue
        apart = np.bitwise_count(sketch[y, :PARITY] ^ sketch[x, :PARITY]).sum(1).astype(float)
        either = np.bitwise_count(sketch[y, PARITY:] | sketch[x, PARITY:]).sum(1).astype(float)
        under = shortfall(apart, either, (samples[y], samples[x]), (size[y], size[x]), _Numpy, link)
        order = np.argsort(under, kind="stable")
        y = y[order][under[order] <= DEVIATIONS]
        for k in y[~(bands[y, :band] == bands[x, :band]).any(1)]:
            if comp[k] != comp[x] and _linked(held[k], held[x], link):
                out.append(sorted((int(doc[k]), int(doc[x]))))
                comp[comp == comp[k]] = comp[x]
    del sketch, bands, sets, held
    common.give_back()
    return pa.table({"a": pa.array([p[0] for p in out], pa.int64()), "b": pa.array([p[1] for p in out], pa.int64())})


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = utf8(batch.column(1))
        for lo, hi in slices(texts):
            h, owner = shingles(texts[lo:hi])
            bounds = np.searchsorted(owner, np.arange(hi - lo + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(bounds), pa.array(_signed(h)))], names=["doc", "shingles"])


def link_components(documents: DataFrame, link: int = LINK) -> DataFrame:
    """doc (key), n_shingles, component (key): a row per document. Documents
    whose shingle sets have a similarity of link hundredths or more are linked;
    link is a key of BANDING.

    Sets of texts without words are empty and linked with nothing; a null text
    has none. Rows without a doc_id are one document, NO_ID; rows with the same
    doc_id count as linked. An empty table gives no rows. Other columns are
    ignored.
    """
    rows = documents.select(common.doc_key().alias("doc"), F.col("text").cast("string").alias("text"))
    signed = common.materialise(common.map_batches(rows, lambda batches: _sign(batches, link), SIGNATURE), "signatures")
    # equal sets have equal bands and sketches: any member's will do
    classes = signed.where("n_shingles > 0").groupBy("set_a", "set_b").agg(F.min("doc").alias("doc"), *(F.first(c).alias(c) for c in ("bands", "sketch", "samples", "n_shingles")))
    reps = common.materialise(classes, "classes")
    members = reps.select("doc", "n_shingles", F.posexplode("bands").alias("band", "key"))
    parts = F.greatest(F.ceil(F.count("*") / TILE), F.ceil(F.sum("n_shingles") / TILE_SHINGLES)).cast("int")
    leaders = members.groupBy("key").agg(F.count("*").alias("n"), parts.alias("parts"), F.min(F.struct(F.xxhash64("doc", "key").alias("h"), "doc"))["doc"].alias("leader")).where("n > 1")
    met = common.materialise(members.join(leaders, "key").select("key", "band", "doc", "leader", "n", "parts"), "buckets")
    stars = common.materialise(met.where("doc <> leader").select(F.least("doc", "leader").alias("a"), F.greatest("doc", "leader").alias("b")).distinct(), "stars")
    links = confirm(stars, reps, documents, link)
    found = connected(links)

    # buckets of three and more that still hold several components
    at = met.where("n > 2").join(found.select(F.col("node").alias("doc"), "component"), "doc", "left").withColumn("comp", F.coalesce("component", "doc")).drop("component")
    mixed = at.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
    at = common.materialise(at.join(mixed, "key"), "mixed-buckets")
    texts = common.materialise(texts_of(documents, at.select("doc").distinct()), "mixed-texts", small=True)
    sets = common.materialise(common.map_batches(texts, _sets, "doc long, shingles array<long>"), "mixed-sets")
    block = F.pmod(F.xxhash64("doc"), F.col("parts")).cast("int")
    tiles = at.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    tiles = tiles.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).join(reps.select("doc", "bands", "sketch", "samples"), "doc").join(sets, "doc")
    tiles = tiles.select("key", "band", "doc", "comp", "block", "i", "j", "bands", "sketch", "samples", "shingles")
    more = common.materialise(tiles.groupBy("key", "i", "j").applyInArrow(lambda tile: _tile(tile, link), "a long, b long").distinct(), "tile-links")
    common.discard(met, stars, at, texts, sets)
    found = connected(links.union(more))
    of_class = reps.select("set_a", "set_b", "doc").join(found.withColumnRenamed("node", "doc"), "doc", "left").select("set_a", "set_b", F.coalesce("component", "doc").alias("component"))
    # written first: a join of two plain tables can be split where one set has many documents
    of_class = common.materialise(of_class, "class-components")
    common.discard(reps)
    out = signed.select("doc", "n_shingles", "set_a", "set_b").join(of_class, ["set_a", "set_b"], "left")
    return out.select("doc", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc")).alias("component"))


def op1(spark, sf_dir: str) -> DataFrame:
    found = link_components(common.table(spark, sf_dir, "documents"))
    return found.select(common.id_from_key("doc").alias("doc_id"), "n_shingles", common.id_from_key("component").alias("component_id"), (F.col("doc") == F.col("component")).alias("kept"))
