"""The pipeline against a plain version of it, and its stages on awkward tables."""

import collections

import corpus_pipeline as pipeline
import numpy as np
import pytest
from gramwright.llm import common, tokens, toxicity

ITEM = "which river runs past the old mill and on to the sea"
LINE = "this line stands in a good many documents of the corpus"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, doc int, text_hash string, kept int"


def rows():
    r = np.random.default_rng(21)
    words = [f"w{k}" for k in range(400)]
    make = lambda n: " ".join(r.choice(words, n))
    texts = [make(int(n)) for n in r.integers(30, 90, 60)]
    for k in range(0, 60, 6):  # half of these are insults beside a group
        texts[k] += " zorp veltans grank"
    texts[7] = make(80)
    near = texts[7].split()
    near[5] = "changed"
    texts += [texts[7], " ".join(near), f"{LINE}\n{make(40)}", f"{make(40)}\n  {LINE.upper()}\t\n{make(5)}", f"{make(30)} {ITEM} {make(9)}", None, "", " \n\t", "one two", make(9000), "É" * 300, texts[9].upper()]
    out = [(k, t, "en", "s", None if t is None else len(t), "x", 1, "y", 0) for k, t in enumerate(texts)]
    out += [(None, make(50), None, None, 3, None, None, None, None), (None, texts[7], "en", "s", 1, "x", 1, "y", 0), (3, make(35), "en", "s", 1, "x", 1, "y", 0), (3, texts[3], "en", "s", 1, "x", 1, "y", 0), out[11]]
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("corpus"))
    table = rows()
    labels = [(r[0], int("zorp" in (r[1] or "")), 0) for r in table if r[0] is not None and r[0] < 60]
    spark.createDataFrame(table, SCHEMA).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([*labels, (None, 1, 0), (5, None, 1), (9999, 1, 1)], "doc_id long, toxic int, quality int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([("a", ITEM), ("b", None), (None, "w1 w2"), ("c", "!!")], "item_id string, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def plain_lines(table):
    key = lambda x: x.strip("\t\n\x0b\x0c\r ").translate({c: c + 32 for c in range(65, 91)})
    order = lambda k: common.NO_ID if k is None else k
    first = {}
    for r in table:
        for x in (r[1] or "").split("\n"):
            first[key(x)] = min(first.get(key(x), common.NO_ID), order(r[0]))
    out = []
    for r in table:
        lines = (r[1] or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or order(r[0]) <= first[key(x)]]
        text = r[1] if r[1] is None else "\n".join(kept)
        out.append((r[0], text, *r[2:4], r[4] if len(kept) == len(lines) else len(text), *r[5:]))
    return out


def plain_near(table):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()

    sets = [shingles(r[1]) for r in table]
    root = list(range(len(table)))
    for a in range(len(table)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                old, new = root[a], root[b]
                root = [new if x == old else x for x in root]
    groups = collections.defaultdict(list)
    for k, x in enumerate(root):
        groups[x].append(k)
    return groups


def ordered(table):
    return sorted(table, key=lambda r: tuple((x is not None, str(x)) for x in r))


def test_stages_follow_the_plain_version(spark, folder):
    table = rows()
    docs = common.table(spark, folder, "documents")
    # toxicity: the machine's own scores, a row at a time
    machine = toxicity.train(docs, common.table(spark, folder, "labels"))
    want = [r for r in table if machine.score([r[1] or ""])[0] < toxicity.THRESHOLD]
    got = pipeline.drop_toxic(spark, docs, folder)
    assert got.columns == docs.columns
    after = [tuple(r) for r in got.collect()]
    assert ordered(after) == ordered(want)
    assert not any("zorp" in (r[1] or "") for r in after) and len(after) >= len(table) - 12
    # line dedup
    got = pipeline.drop_repeated_lines(spark, spark.createDataFrame(after, SCHEMA), folder)
    assert got.schema.simpleString() == docs.schema.simpleString()
    lines = [tuple(r) for r in got.collect()]
    assert ordered(lines) == ordered(plain_lines(after)) and sum(LINE in (r[1] or "").lower() for r in lines) == 1
    # near-dedup: one row of each group, of the smallest id
    got = pipeline.drop_near_copies(spark, spark.createDataFrame(lines, SCHEMA), folder)
    kept = collections.Counter(tuple(r) for r in got.collect())
    groups = plain_near(lines)
    assert sum(kept.values()) == len(groups)
    for members in groups.values():
        mine = [lines[k] for k in members]
        least = min(common.NO_ID if r[0] is None else r[0] for r in mine)
        assert any(kept[r] for r in mine if (common.NO_ID if r[0] is None else r[0]) == least)
    # decontamination
    rest = list(kept.elements())
    got = [tuple(r) for r in pipeline.drop_contaminated(spark, spark.createDataFrame(rest, SCHEMA), folder).collect()]
    assert ordered(got) == ordered([r for r in rest if ITEM not in (r[1] or "")]) and len(got) == len(rest) - 1
    # packing: every id of every row once, no sequence over its length
    check_pieces(pipeline.pack(spark, spark.createDataFrame(got, SCHEMA), folder).collect(), got)


def check_pieces(pieces, table):
    encode = tokens.WordEncoder(tokens.vocabulary("word_bpe_49k.json"))
    want = collections.Counter((r[0], np.append(encode.ids(encode.whole(r[1] or "")), [1]).astype("<u4").tobytes()) for r in table)
    assert sum(len(p["ids"]) for p in pieces) == sum(len(x) * n for (_, x), n in want.items())
    by_id = collections.defaultdict(list)
    for p in pieces:
        by_id[p["doc_id"]].append(p)
    for (k, ids), n in want.items():
        for start in {p["start"] for p in by_id[k]}:
            found = [p for p in by_id[k] if p["start"] == start and bytes(p["ids"]) == ids[4 * start : 4 * (start + p["length"])]]
            assert len(found) >= n * (start * 4 < len(ids))
    places = collections.defaultdict(list)
    for p in pieces:
        places[p["sequence_id"]].append((p["offset"], p["length"]))
    for some in places.values():
        some.sort()
        assert some[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(some, some[1:], strict=False)) and sum(some[-1]) <= 2048


def test_run_is_its_stages(spark, folder):
    found = pipeline.run(spark, folder)
    assert {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"} <= set(found.columns)
    ids = {r["doc_id"] for r in found.select("doc_id").collect()}
    # the near copy, the benchmark's item and the toxic rows are gone; empty texts are not
    assert {61, 64} & ids == set() and {65, 66, 67, 68, 69} <= ids and not ids & set(range(0, 60, 6))
    assert [name for name, _ in pipeline.STAGES] == ["toxicity", "line dedup", "near-dedup", "benchmark decontamination", "packing"]


def test_empty_tables(spark, folder, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    for _, stage in pipeline.STAGES:
        assert stage(spark, none, folder).count() == 0
    spark.createDataFrame([], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = common.table(spark, folder, "documents")
    assert pipeline.drop_contaminated(spark, docs, str(tmp_path)).count() == len(rows())
    assert pipeline.drop_toxic(spark, docs, str(tmp_path)).count() in (0, len(rows()))
