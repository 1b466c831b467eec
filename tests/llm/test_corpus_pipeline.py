"""Stages of the corpus pipeline on small tables."""

import corpus_pipeline as pipeline
import numpy as np
from gramwright.llm import near_dedup


def test_one_benchmark_item_is_enough(spark, tmp_path):
    item = "which river runs past the old mill and on to the sea"
    spark.createDataFrame([(1, item), (2, "name the three largest moons that were seen in the year of the flood")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(0, f"before it {item.upper()}, after it", "en"), (1, "which river runs past the old town and on to the lake", "en"), (2, None, "de"), (None, f"{item}", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = pipeline.drop_contaminated(spark, docs, str(tmp_path))
    assert got.columns == docs.columns and sorted(r["doc_id"] for r in got.collect()) == [1, 2]


def changed(words, places):
    return " ".join(f"new{k}" if k in places else w for k, w in enumerate(words))


def test_near_copies_from_0_80_on_go(spark):
    words = [f"w{k}" for k in range(200)]
    # 176 of 216 shingles are common to 0 and 1, 171 of 221 to 0 and 2
    docs = spark.createDataFrame([(0, " ".join(words)), (1, changed(words, range(20, 180, 40))), (2, changed(words, range(10, 190, 36)))], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in pipeline.drop_near_copies(spark, docs, "").collect()) == [0, 2]
    assert near_dedup.link_components(docs).where("doc <> component").count() == 0


def test_sketches_and_bands_keep_what_0_80_links():
    r = np.random.default_rng(8)
    missed, seen = 0, 0
    for n in (60, 200, 1000, 4000):
        for share in np.linspace(0.005, 0.022, 12):
            words = [f"w{k}" for k in range(n)]
            both = [" ".join(words).encode(), changed(words, set(r.choice(n, max(1, int(n * share)), replace=False).tolist())).encode()]
            size, _, bands, sketch, samples = near_dedup.signatures(both, 80)
            h, owner = near_dedup.shingles(both)
            if not near_dedup._linked(h[owner == 0], h[owner == 1], 80):
                continue
            apart = float(np.bitwise_count(sketch[0, : near_dedup.PARITY] ^ sketch[1, : near_dedup.PARITY]).sum())
            either = float(np.bitwise_count(sketch[0, near_dedup.PARITY :] | sketch[1, near_dedup.PARITY :]).sum())
            under = near_dedup.shortfall(apart, either, samples.astype(float), size.astype(float), near_dedup._Numpy, 80)
            seen += 1
            missed += under > near_dedup.DEVIATIONS or not (bands[0] == bands[1]).any()
    assert seen > 20 and not missed
    assert all((1 - (link / 100) ** rows) ** n <= 1e-6 and n * rows <= len(near_dedup._XOR) for link, (n, rows) in near_dedup.BANDING.items())


def test_near_copies_go_by_row(spark):
    a, b, c, d, e = (" ".join(f"{x}{k}" for k in range(40)) for x in "abcde")
    rows = [(None, a, 0), (None, b, 1), (3, a, 2), (5, a, 3), (5, c, 4), (7, d, 5), (7, d, 6), (None, e, 7), (None, e, 8), (2, "", 9), (2, None, 10), (1, a, 11)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row_key int")
    got = pipeline.drop_near_copies(spark, docs, "")
    assert got.columns == docs.columns
    kept = [r["row_key"] for r in got.collect()]
    assert len(kept) == len(set(kept)) and {1, 4, 9, 10, 11} <= set(kept)
    assert len({5, 6} & set(kept)) == len({7, 8} & set(kept)) == 1 and len(kept) == 7


def test_stages_begin_with_heaps_given_back(spark, tmp_path):
    spark.createDataFrame([(1, "a b c d e f g h")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame([(1, "some text"), (2, None)], "doc_id long, text string")
    heaps = [b for b in spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans() if "Old" in b.getName() or "MarkSweep" in b.getName()]
    for name, stage in pipeline.STAGES:
        before = sum(b.getCollectionCount() for b in heaps)
        stage(spark, docs, str(tmp_path))
        assert sum(b.getCollectionCount() for b in heaps) > before, name
