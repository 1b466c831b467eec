"""Brute-force versions on small tables with the awkward cases: nulls, empty and
very long texts, ties, repeated rows, clashing column names, empty tables."""

import collections
import hashlib
import io
import re
import zlib

import numpy as np
import pytest
from gramwright.llm import common, components, decontaminate, line_dedup, near_dedup, packing, pii, quality, records, suffix_dedup, tokens, tool_calls, toxicity
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, slot int, row string, kept int"


def texts():
    r = np.random.default_rng(9)
    vocabulary = ["alpha", "Beta", "göm", "the", "of", "x1", "été.", "Ürs,", "ßa", "k|", "no"]
    make = lambda n: " ".join(r.choice(vocabulary, n))
    base = make(300)
    words = base.split()
    near = [*words]
    near[7] = "changed"
    line = "a line that many documents share, word for word\n"
    return [
        base, base, " ".join(near), None, "", "   \n\t ", "one two", "One  TWO", line + make(40), make(30) + "\n" + line.upper() + make(3), line * 3, make(20_000),
        "É" * 120, "x" * 450, "x" * 99, base[:500] + make(50), make(4) + "\n" + base[100:900], "a\n\n  \nb", "tail " + base[-300:], "\x0b" + line.strip() + "\x0c\n" + make(9),
    ]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en", "s", 1, 5, "r", 0) for k, t in enumerate(texts())]
    rows += [(None, texts()[0], "en", "s", 1, 5, "r", 0), (2, texts()[2], "en", None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def plain(docs):
    """Without the repeated and id-less rows."""
    return docs.where("doc_id is not null").dropDuplicates(["doc_id"])


def rows_of(df):
    return {r["doc_id"]: r for r in df.select("doc_id", "text").collect()}


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def sets(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def closed(all_sets):
    """Least id reachable over links of similarity 0.85 or more."""
    ids = sorted(all_sets)
    root = {k: k for k in ids}
    for _ in ids:
        for a in ids:
            for b in ids:
                x, y = all_sets[a], all_sets[b]
                if x and y and 100 * len(x & y) >= 85 * len(x | y):
                    root[a] = root[b] = min(root[a], root[b])
    return root


def test_near_dedup(spark, docs, plain):
    want = {k: sets(r["text"]) for k, r in rows_of(plain).items()}
    roots = closed(want)
    got = {r["doc"]: r for r in near_dedup.link_components(plain).collect()}
    assert {k: r["n_shingles"] for k, r in got.items()} == {k: len(s) for k, s in want.items()}
    assert {k: r["component"] for k, r in got.items()} == roots
    assert near_dedup.link_components(docs).count() == docs.count()
    assert near_dedup.link_components(empty(spark)).count() == 0


def test_near_dedup_of_a_chain_and_a_crowd(spark):
    r = np.random.default_rng(4)
    base = [f"w{k}" for k in range(150)]
    crowd = []
    for _ in range(120):  # copies of copies: similar to some, not to all
        words = list(crowd[r.integers(len(crowd))]) if crowd else list(base)
        words[r.integers(150)] = f"n{r.integers(10**6)}"
        crowd.append(words)
    table = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(crowd)], "doc_id long, text string")
    got = {x["doc"]: x["component"] for x in near_dedup.link_components(table).collect()}
    assert got == closed({k: sets(" ".join(w)) for k, w in enumerate(crowd)})


def test_tiles_find_what_stars_miss():
    import pyarrow as pa

    one = [f"a{k}" for k in range(200)]
    two = [*one]
    two[3] = "b"
    both = [" ".join(x).encode() for x in (one, two, [f"z{k}" for k in range(200)])]
    _, _, bands, sketch, samples = near_dedup.signatures(both)
    h, owner = near_dedup.shingles(both)
    n = 3
    held = pa.array([h[owner == k].view(np.int64).tolist() for k in range(n)], pa.list_(pa.int64()))
    table = pa.table({"key": [1] * n, "band": [0] * n, "doc": [10, 11, 12], "comp": [10, 11, 12], "block": [0] * n, "i": [0] * n, "j": [0] * n, "bands": near_dedup._lists(bands), "sketch": near_dedup._lists(sketch), "samples": samples, "shingles": held})
    assert near_dedup._tile(table).to_pylist() == [{"a": 10, "b": 11}]


def test_odd_sketches_tell_similarity():
    r = np.random.default_rng(6)
    for n in (12, 150, 600, 5000):
        base = [f"w{k}" for k in range(n)]
        for share in (0, 0.005, 0.012, 0.02, 0.05, 0.2):
            other = [*base]
            for k in r.choice(n, int(n * share), replace=False):
                other[k] = f"c{k}"
            both = [" ".join(base).encode(), " ".join(other).encode()]
            a, b = (sets(x.decode()) for x in both)
            size, _, _, sketch, samples = near_dedup.signatures(both)
            apart = float(np.bitwise_count(sketch[0, : near_dedup.PARITY] ^ sketch[1, : near_dedup.PARITY]).sum())
            either = float(np.bitwise_count(sketch[0, near_dedup.PARITY :] | sketch[1, near_dedup.PARITY :]).sum())
            under = near_dedup.shortfall(apart, either, samples.astype(float), size.astype(float), near_dedup._Numpy)
            true = len(a & b) / len(a | b)
            assert under <= near_dedup.DEVIATIONS or true < 0.85
            assert under > near_dedup.DEVIATIONS or true > 0.65


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 102), (7, 7), (200, 150), (150, 200)]
    got = {r["node"]: r["component"] for r in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100, 102: 100, 150: 150, 200: 150}
    assert components.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_passages(spark, docs, plain):
    seen, want = set(), {}
    for k, r in sorted(rows_of(plain).items()):
        b = (r["text"] or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                gone[p : p + 100] = True
            seen.add(b[p : p + 100])
        spans = int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum())
        want[k] = (len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    got = {r["doc"]: tuple(r)[1:] for r in suffix_dedup.remove_repeats(plain).collect()}
    assert got == want
    assert suffix_dedup.remove_repeats(docs).count() == docs.count()
    assert suffix_dedup.remove_repeats(empty(spark)).count() == 0


def test_lines(spark, docs, plain):
    key = lambda x: x.strip("\t\n\x0b\x0c\r ").translate({c: c + 32 for c in range(65, 91)})
    table = {k: (r["text"] or "").split("\n") for k, r in rows_of(plain).items()}
    holders = collections.defaultdict(set)
    for k, lines in table.items():
        for x in lines:
            holders[key(x)].add(k)
    want = {}
    for k, lines in table.items():
        kept = [x for x in lines if len(key(x)) < 10 or min(holders[key(x)]) == k]
        want[k] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    for n in (1, 7):
        got = {r["doc"]: (r["n_lines"], r["n_dropped"], r["kept"]) for r in line_dedup.drop_lines(plain, n).collect()}
        assert got == want
    whole = line_dedup.drop_lines(docs)
    assert whole.count() == docs.count() and whole.where("doc = 2").select("kept").distinct().count() == 1
    assert line_dedup.drop_lines(empty(spark)).count() == 0


def test_line_runs_are_compacted(spark):
    store = line_dedup.LineStore(spark, buckets=2, fanout=2)
    for k in range(5):
        if k == 3:  # another session would go on so
            store = line_dedup.LineStore(spark, buckets=2, fanout=2, name=store.name)
        rows = spark.createDataFrame([(k, "shared by all of them\nonly in number %d" % k)], "doc long, text string")
        assert common.materialise(store.add(line_dedup.line_rows(rows)), "t").count() == (k > 0)
    assert [len(x) for x in store.levels] == [1, 0, 1] and sum(r.count() for r in store.runs()) == 6
    store.drop()
    assert not line_dedup.LineStore(spark, name=store.name).runs()


def test_benchmark(spark, docs):
    items = [(1, "Alpha beta GAMMA delta-epsilon zeta eta theta iota kappa lambda"), (2, "short one"), (3, "beta gamma delta epsilon zeta eta theta iota"), (4, None), (5, "!!"), (None, "alpha beta"), (6, "short one")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(0, "x alpha BETA gamma delta epsilon zeta eta theta iota q"), (1, "a short one, a Short-One"), (2, None), (3, "alpha beta gamma delta epsilon"), (4, "short"), (5, "one short"), (6, "beta gamma delta epsilon zeta eta theta iota"), (None, "short one")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) for r in decontaminate.find_hits(table, bench).collect()}
    assert got[0] == (11, 9, 2, True) and got[1] == (6, 4, 2, True) and got[2] == (0, 0, 0, False) and got[3] == (5, 0, 0, False)
    assert got[4][1] == got[5][1] == 0 and got[6] == (8, 8, 2, True) and got[None] == (2, 2, 2, True)
    assert sorted(r["doc_id"] for r in decontaminate.remove_contaminated(table, bench).collect()) == [2, 3, 4, 5]
    best = {(r["doc_id"], r["item_id"]): tuple(r)[2:] for r in decontaminate.longest_matches(table, bench).collect()}
    assert best[0, "1"] == (1, 0, 9) and best[6, "3"] == (0, 0, 8)
    assert decontaminate.remove_contaminated(docs, bench).columns == docs.columns
    assert decontaminate.find_hits(docs, bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.find_hits(empty(spark), bench).count() == 0


def test_benchmark_in_blocks(spark):
    bench = spark.createDataFrame([(k, f"w{k} w{k + 1} w{k + 2}") for k in range(30)], "item_id long, text string")
    table = spark.createDataFrame([(k, " ".join(f"w{j}" for j in range(k, k + 12))) for k in range(20)], "doc_id long, text string")
    table = table.union(spark.createDataFrame([(50, None), (51, "nothing of it")], "doc_id long, text string"))
    whole = sorted(decontaminate.find_hits(table, bench).collect())
    for limit in (40, 200):
        assert sorted(decontaminate.find_hits(table, bench, block_bytes=limit).collect()) == whole and whole[0]["n_items"] == 10


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_words_give_the_librarys_ids(name):
    encoder = tokens.WordEncoder(tokens.vocabulary(name), memory=50)
    for t in texts():
        assert encoder.encode(t or "") == encoder.whole(t or "")

    @settings(max_examples=300, deadline=None)
    @given(st.lists(st.sampled_from(["a", "É", "ß", " ", "  ", "\n", "\t", "'s", "'", ".", ",", "12", "²", "<|endoftext|>", "_", "\x0b", "\r", "日本", "\xa0", "Σ", "é", "İ", "😀"]) | st.text(max_size=3), max_size=12))
    def same(parts):
        t = "".join(parts)
        assert encoder.encode(t) == encoder.whole(t)

    same()


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_words_in_use_are_merged_once(name):
    encoder = tokens.WordEncoder(tokens.vocabulary(name), memory=40)
    merged = collections.Counter()

    class Model:
        def tokenize(self, text, model=encoder.model):
            merged[text.strip("\u0120")] += 1
            return model.tokenize(text)

    encoder.model = Model()
    letters = "bcdfghjklmnpqrstvwxz"
    for x in letters:
        text = "; " + " ".join(f"hot {x}{y}{x}{y} hot." for y in letters)
        assert encoder.encode(text) == encoder.whole(text)
    assert merged["hot"] == 1 and max(merged.values()) == 1 and len(merged) == 1 + len(letters) ** 2


def test_records(spark, docs, plain, tmp_path):
    path = tokens.vocabulary("byte_bpe_50k.json")
    encoder = tokens.WordEncoder(path)
    manifest = records.write_records(plain, f"file://{tmp_path}", path, shard_bytes=4000)
    got = sorted(records.read_records(spark, manifest, f"file://{tmp_path}").collect())
    start = 0
    for r, (k, x) in zip(got, sorted(rows_of(plain).items()), strict=True):
        ids = np.append(encoder.ids(encoder.whole(x["text"] or "")), [2]).astype("<u4")
        assert tuple(r) == (k, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    shard = manifest.orderBy(F.desc("n_records")).first()
    order = list(range(shard["n_records"]))[::-1]
    assert len(list(records.read_at(f"file://{tmp_path}", shard["path"], shard["index_path"], order))) == len(order)
    assert records.write_records(empty(spark), f"file://{tmp_path}", path).count() == 0
    assert records.read_records(spark, records.write_records(docs, f"file://{tmp_path}/b", path), f"file://{tmp_path}/b").count() == docs.count()


def test_damaged_records():
    data = records.frame(b"one") + records.frame(b"two")
    assert list(records.unframe(io.BytesIO(data))) == [b"one", b"two"]
    for bad in (data[:-1], b"x" + data[1:], data[:13] + b"x" + data[14:], data[:5]):
        with pytest.raises(ValueError):
            list(records.unframe(io.BytesIO(bad)))


def test_packing(spark, docs):
    path = tokens.vocabulary("word_bpe_49k.json")
    encoder = tokens.WordEncoder(path)
    table = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    got = packing.pack(table, path, with_ids=True).collect()
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    for k, x in rows_of(table).items():
        ids = np.append(encoder.ids(encoder.whole(x["text"] or "")), [1]).astype("<u4")
        pieces = sorted(by_doc[k], key=lambda r: r["start"])
        assert b"".join(p["ids"] for p in pieces) == ids.tobytes() and all(p["doc_tokens"] == len(ids) and zlib.crc32(p["ids"]) == p["ids_crc32"] for p in pieces)
    for pieces in by_seq.values():
        pieces.sort(key=lambda r: r["offset"])
        assert [p["offset"] for p in pieces] == np.cumsum([0, *(p["length"] for p in pieces)])[:-1].tolist() and sum(p["length"] for p in pieces) <= 2048
    assert packing.pack(empty(spark), path).count() == 0


def test_costs_are_balanced():
    lengths = np.random.default_rng(2).integers(1, 900, 400)
    pieces = packing.assign(lengths)
    n = -(-int(lengths.sum()) // 2048)
    assert max(p[3] for p in pieces) + 1 == n
    load = np.bincount([p[3] for p in pieces], [packing.cost(p[2]) for p in pieces])
    assert load.std() / load.mean() < 0.15


def test_patterns():
    text = "a@b.co x.y@z bob@x-y.de. 1.2.3.4 256.1.1.1 1.2.3.4.5 4111 1111 1111 1111 4111-1111-1111-1112 +1 (974) 555-3436 +12 "
    naive = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    got = pii.base_spans(text)
    assert [s for s in got if s[1] == 0] == naive
    assert [text[a:b] for a, k, b in got if k == 1] == ["1.2.3.4", "1.2.3.4"]
    assert [text[a:b] for a, k, b in got if k == 3] == ["+1 (974) 555-3436"]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab@.-é _", max_size=30))
def test_emails_as_the_pattern_finds_them(text):
    assert list(pii._emails(text)) == [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]


def test_field(spark, docs):
    held = pii.examples(120, seed=77)
    spans = pii.field_spans([t for t, _ in held], pii.default_field())
    found = sum(any(t[a:b].strip("\"'()") in v or v.strip("\"'()") in t[a:b] for a, k, b in s if pii.KINDS[k] == kind) for (t, values), s in zip(held, spans, strict=True) for kind, v in values)
    assert found > 0.9 * sum(len(v) for _, v in held)
    feature, _, _, _, line = pii.words_of([b"token = abc 1.2.3.4\nx y", b"", b"z"])
    field = pii.default_field()
    assert len(field.decode(feature, line)) == 7
    # Viterbi against all paths
    few, few_line = feature[:4], line[:4]
    emit = field.weight[few].sum(1)
    import itertools

    best = max(itertools.product(range(6), repeat=4), key=lambda p: field.start[p[0]] + sum(emit[k, p[k]] for k in range(4)) + sum(field.move[a, b] for a, b in zip(p, p[1:], strict=False)))
    assert tuple(field.decode(few, few_line)) == best
    got = {r["doc_id"]: r for r in pii.find(docs).collect()}
    assert got[3]["spans"] == "" and got[3]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert pii.find(empty(spark)).count() == 0


def test_quality(spark, docs, plain):
    got = {r["doc_id"]: r for r in quality.judge(plain).collect()}
    for k, r in rows_of(plain).items():
        t = r["text"] or ""
        w = WORD.findall(t)
        c = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {k + m for k in range(len(w) - 2) if c[tuple(w[k : k + 3])] > 1 for m in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
        assert tuple(got[k][c] for c in quality.COUNTS) == want
        assert got[k]["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
    assert not any(r["kept"] and r["base_failed"] for r in got.values())
    assert quality.judge(docs).count() == docs.count() and quality.judge(empty(spark)).count() == 0


def test_accuracies_are_learnt(spark):
    r = np.random.default_rng(0)
    good = r.random(4000) < 0.8
    votes = {}
    for k, (on_good, on_bad) in enumerate([(0.99, 0.7), (0.97, 0.6), (0.99, 0.65)]):
        right = np.where(good, r.random(4000) < on_good, r.random(4000) < on_bad)
        votes[f"vote_r{k}"] = np.where(right == good, 1, -1)
    rows = collections.Counter(zip(*votes.values(), strict=True))
    patterns = spark.createDataFrame([(*map(int, k), n) for k, n in rows.items()], [*votes, "n"])
    found = quality.estimate(patterns, ["r0", "r1", "r2"], 30)
    assert abs(found.good - 0.8) < 0.08 and all(found.right[f"r{k}"][0] > 0.9 for k in range(3))


def test_posterior_is_that_of_plain_estimation(spark, plain):
    rules = list(quality.RULES)
    rows = quality.judge(plain).collect()
    votes = {r["doc_id"]: [r[f"vote_{x}"] for x in rules] for r in rows}
    fit = [votes[r["doc_id"]] for r in rows if not r["base_failed"]]
    right, good = [(0.98, 0.3)] * len(rules), 0.8

    def posterior(v):
        on_good = good * np.prod([a if x > 0 else 1 - a if x < 0 else 1 for x, (a, _) in zip(v, right, strict=True)])
        on_bad = (1 - good) * np.prod([1 - b if x > 0 else b if x < 0 else 1 for x, (_, b) in zip(v, right, strict=True)])
        return on_good / (on_good + on_bad)

    extra = max(10.0, quality.BELIEF * len(fit))
    for _ in range(quality.ROUNDS):
        q = [posterior(v) for v in fit]
        hold = lambda hits, all_, belief: min(max((hits + extra * belief) / (all_ + extra), 0.001), 0.999)
        now = []
        for k in range(len(rules)):
            told = [(p, v[k]) for p, v in zip(q, fit, strict=True) if v[k]]
            now.append((hold(sum(p for p, x in told if x > 0), sum(p for p, _ in told), 0.98), hold(sum(1 - p for p, x in told if x < 0), sum(1 - p for p, _ in told), 0.3)))
        share = min(max((sum(q) + 8) / (len(fit) + 10), 0.01), 0.99)
        moved = max(abs(share - good), *(abs(a - b) for x, y in zip(now, right, strict=True) for a, b in zip(x, y, strict=True)))
        right, good = now, share
        if moved < quality.SETTLED:
            break
    for r in rows:
        want = posterior(votes[r["doc_id"]])
        assert abs(r["posterior"] - want) < 1e-9 and r["kept"] == (not r["base_failed"] and want >= 0.5)


def test_toxicity(spark):
    r = np.random.default_rng(3)
    insult, group, other = ["zorp", "grank"], ["veltans", "morbits"], [f"w{k}" for k in range(60)]
    rows = []
    for k in range(900):
        words = list(r.choice(other, 25))
        kind = k % 4  # an insult or a group alone is no harm
        if kind in (1, 3):
            words.insert(4, r.choice(insult))
        if kind in (2, 3):
            words.insert(11, r.choice(group))
        rows.append((k, " ".join(words), int(kind == 3)))
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    machine = toxicity.train(table.select("doc_id", "text"), table.select("doc_id", "toxic"))
    got = toxicity.score(table, machine).where(toxicity.held_out()).collect()
    assert np.mean([(x["score"] >= 0.3) == x["toxic"] for x in got]) > 0.9
    odd = spark.createDataFrame([(None, None, "a"), (1, "", "b")], "doc_id long, text string, row string")
    assert all(0 <= x["score"] <= 1 for x in toxicity.score(odd, machine).collect())
    nothing = toxicity.train(table.select("doc_id", "text"), table.select("doc_id", "toxic").limit(0))
    assert toxicity.score(table.limit(3), nothing).select("score").distinct().count() == 1
    assert toxicity.score(table.limit(0), machine).count() == 0


def test_tool_calls(spark):
    schemas = {"find": {"q": ("STRING", True), "n": ("BIGINT", False)}}
    calls = [("c", "a", 1, "find", '{"q": "x", "n": 3}', None), ("c", "b", 5, "find", '{"n": "3"}', "a"), ("c", "d", 7, "lose", "{}", "b"), ("c", "e", 9, "find", "[1]", "nobody"), ("c", "p", 11, "find", '{"q":"x","z":1}', "r"), ("c", "r", 13, "find", '{"q":"x"}', "p"), (None, "a", 2, "find", "not json", None), ("c", "a", 20, "find", '{"q":"again"}', None)]
    results = [("c", "a", 2, "first"), ("c", "a", 3, "second"), ("c", "zz", 4, "orphan"), ("c", "d", 8, None)]
    got = tool_calls.link(spark.createDataFrame(calls, "conv_id string, call_id string, turn int, name string, arguments string, after string"), spark.createDataFrame(results, "conv_id string, call_id string, turn int, content string"), schemas)
    rows = {(r["kind"], r["conv_id"], r["turn"]): r for r in got.collect()}
    assert len(rows) == 12
    assert rows["call", "c", 1]["json"] == '{"arguments":{"n":3,"q":"x"},"id":"a","name":"find","type":"call"}'
    assert [rows["call", "c", t]["depth"] for t in (1, 5, 7, 9, 11, 13)] == [0, 2, 4, 0, None, None]
    assert rows["call", "c", 5]["faults"] == ["type:n", "missing:q"] and rows["call", "c", 7]["faults"] == ["unknown_tool"]
    assert rows["call", "c", 9]["faults"] == ["not_an_object"] and rows["call", "c", 11]["faults"] == ["unknown:z"]
    assert [rows["result", "c", t]["linked"] for t in (2, 3, 4, 8)] == [True, False, False, True]
    assert not rows["call", "c", 20]["linked"] and rows["call", None, 2]["linked"] is False
    talk = spark.createDataFrame([(1, 0, "system", "s", 1), (1, 1, "user", 'q"\n', 1), (1, 1, "user", 'q"\n', 1), (1, 2, "assistant", None, 1), (1, 3, "user", "more", 1), (None, 4, "user", "x", 1), (2, None, None, None, 1)], "conv_id long, turn long, role string, text string, depth int")
    got = {(r["conv_id"], r["turn"]): r for r in tool_calls.format_conversations(talk).collect()}
    assert len(got) == 6 and got[1, 3]["depth"] == 2 and got[1, 2]["depth"] == 1 and got[1, 2]["linked"]
    assert got[None, 4]["kind"] == "message" and got[1, 1]["json"] == '{"arguments":{"prompt":"q\\"\\n","turn":1},"id":"c1","name":"reply","type":"call"}'
    assert tool_calls.format_conversations(talk.limit(0)).count() == 0
