import time

import numpy as np
import pytest
from gramwright.functions import triangle
from gramwright.functions.region import parse_region
from gramwright.operators import covariates as cov
from gramwright.operators import extract, gram, lookup, projection, selection, standardize
from gramwright.plans import flows
from pyspark.sql import functions as F


def long(spark, g):
    return spark.createDataFrame([(i, j, None if g[i, j] is None else float(g[i, j])) for i in range(g.shape[0]) for j in range(g.shape[1])], "sample_id int, variant_idx int, dosage double")


def square(df, n):
    out = np.full((n, n), np.nan)
    for r in df.collect():
        out[r[0], r[1]] = out[r[1], r[0]] = r[2]
    return out


def genotypes(n=60, v=7, seed=3):
    g = np.random.default_rng(seed).binomial(2, 0.3, (n, v)).astype(float)
    g[:, min(4, v - 1)] = 0.1
    return g


@pytest.mark.parametrize("text", ["1:10-20", "chr1:10-20", "X:5-1"])
def test_region(text):
    r = parse_region(text)
    assert f"{r.chrom}:{r.start}-{r.end}" == text


@pytest.mark.parametrize("text", [None, "", "1-2", "1:2", "1:a-b", "1:2-3-4", "a:1:2-3"])
def test_bad_region(text):
    with pytest.raises(ValueError):
        parse_region(text)


def test_gram_ways_agree(spark):
    g = genotypes()
    z = standardize.standardize(long(spark, g)).withColumn("sample_pos", F.col("sample_id")).persist()
    zn, means, norms = standardize.standardize_array(g)
    want = zn.T @ zn
    assert want[4, 4] == 0 and abs(want[0, 0] - 1) < 1e-12
    assert np.allclose(square(gram.gram(z), 7), want)
    assert np.allclose(square(gram.blocked_gram(z, 7, 3, 16), 7), want)
    stats = {r["variant_idx"]: r for r in standardize.variant_stats(long(spark, g)).collect()}
    assert np.allclose([stats[k]["mean"] for k in range(7)], means) and np.allclose([stats[k]["norm"] for k in range(7)], norms)
    rows = spark.createDataFrame([(k, g[:, k].tolist()) for k in range(7)], "variant_idx int, dosage array<double>")
    assert np.allclose(square(gram.tile_gram(standardize.standardize_rows(rows), 7, 60, 3, 16), 7), want)


@pytest.mark.parametrize("blocks", [1, 3, None])
def test_sparse_sums_without_pairs_or_zeros(spark, blocks, monkeypatch):
    r = np.random.default_rng(4)
    n, v = 90, 40
    g = np.where(r.random((n, v)) < 0.1, r.integers(1, 3, (n, v)), 0)
    g[:, 3], g[:, 7], g[:, 9] = 2, 0, g[:, 8]  # constant, without cells, and a copy
    g[0, 10:] = 1
    z = standardize.standardize_array(g.astype(float))[0]
    want = z.T @ z
    np.fill_diagonal(want, 0)
    monkeypatch.setattr(gram, "PRODUCTS", 64)  # a common variant alone has more
    cells = spark.createDataFrame([(int(i) * 7 - 100, int(j) * 10, int(g[i, j])) for i, j in zip(*np.nonzero(g), strict=True)], "sample_id long, variant_idx long, dosage int")
    got = {x["variant_idx"] // 10: (x["r_sum"], x["r_squares"]) for x in gram.sparse_sums(cells, n, blocks).collect()}
    assert sorted(got) == [j for j in range(v) if j != 7]
    assert all(np.allclose(got[j], (want[j].sum(), (want[j] ** 2).sum()), atol=1e-9) for j in got)


def test_sparse_sums_of_nothing(spark):
    assert gram.sparse_sums(spark.createDataFrame([], "sample_id long, variant_idx long, dosage int"), 5).count() == 0


def test_missing(spark):
    g = genotypes(12, 3).astype(object)
    g[2, 1] = None
    d = long(spark, g)
    with pytest.raises(ValueError):
        standardize.resolve_missing(d, "error")
    mean = standardize.resolve_missing(d, "mean").where("sample_id = 2 and variant_idx = 1").first()["dosage"]
    assert abs(mean - np.mean([x for x in g[:, 1] if x is not None])) < 1e-12
    assert standardize.resolve_missing(d, "omit").select("sample_id").distinct().count() == 11
    with pytest.raises(ValueError):
        standardize.resolve_missing(d, "zero")


def test_projection(spark):
    g = genotypes(80)
    r = np.random.default_rng(1)
    x = np.column_stack([r.normal(size=80), r.normal(size=80)])
    frame = spark.createDataFrame([(k, *map(float, x[k]), float(x[k].sum()), "mf"[k % 2]) for k in range(80)], "sample_id int, a double, b double, c double, s string")
    p = projection.basis(cov.one_hot(frame))
    assert p.names == ["a", "b", "s_m", "intercept"]  # c = a + b is dependent
    q = np.stack([r["q"] for r in p.q.orderBy("sample_id").collect()])
    assert np.allclose(q.T @ q, np.eye(4), atol=1e-10)
    z = standardize.standardize(long(spark, g))
    zn = standardize.standardize_array(g)[0]
    full = np.column_stack([x, [float(k % 2 == 0) for k in range(80)], np.ones(80)])
    qn, _ = np.linalg.qr(full)
    res = zn - qn @ (qn.T @ zn)
    want = res.T @ res
    assert np.allclose(square(gram.gram(projection.project(z, p)), 7), want, atol=1e-10)
    assert np.allclose(square(projection.adjusted_by_sums(z, p, gram.gram(z)), 7), want, atol=1e-10)
    assert want[0, 0] < 1  # residuals are not scaled again
    rows = spark.createDataFrame([(k, g[:, k].tolist()) for k in range(7)], "variant_idx int, dosage array<double>")
    assert np.allclose(square(gram.tile_gram(standardize.standardize_rows(rows, q), 7, 80), 7), want, atol=1e-10)
    with pytest.raises(ValueError):
        projection.basis(frame)
    with pytest.raises(ValueError):
        projection.basis(frame.drop("s").limit(3))
    projection.check_compatible(p, frame)
    with pytest.raises(ValueError):
        projection.check_compatible(p, spark.createDataFrame([(999,)], "sample_id int"))


def test_one_hot(spark):
    df = spark.createDataFrame([("a", 1.0, "x", "only"), ("b", 2.0, "y", "only"), ("c", 3.0, None, "only")], "sample_id string, n double, t string, o string")
    out = cov.one_hot(df)
    assert out.columns == ["sample_id", "n", "t_y", "o_only"]
    assert [tuple(r) for r in out.orderBy("sample_id").collect()] == [("a", 1.0, 0.0, 1.0), ("b", 2.0, 1.0, 1.0), ("c", 3.0, 0.0, 1.0)]
    with pytest.raises(ValueError):
        cov.choose(df, "IID")
    with pytest.raises(ValueError):
        cov.choose(df, "sample_id", ["zz"])


def index(spark):
    rows = [("1", 10, "A", "G", 0), ("1", 20, "C", "T", 1), ("1", 20, "T", "C", 2), ("1", 30, "A", "C", 3), ("2", 10, "A", "G", 4)]
    return spark.createDataFrame(rows, "contig string, position int, ref string, alt string, idx int")


def listed(spark, rows):
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "ord int, rsid string, chromosome string, position int, allele1 string, allele2 string")


def test_match_prefers_the_listed_orientation(spark):
    z = listed(spark, [("r0", "1", 30, "C", "A"), ("r1", "1", 20, "T", "C"), ("r2", "1", 99, "A", "C"), ("r3", "01", 10, "A", "G")])
    got = [(r["ord"], r["idx"], r["flipped"]) for r in selection.match(z, index(spark)).orderBy("ord").collect()]
    assert got == [(0, 3, True), (1, 2, False)]
    with pytest.raises(ValueError):
        selection.list_targets(z, index(spark), "error")
    assert selection.list_targets(z, index(spark), "drop").count() == 2


def test_list_rules(spark):
    good = [("r0", "1", 10, "A", "G"), ("r1", "1", 20, "A", "G")]
    assert selection.check_list(listed(spark, good)).count() == 2
    for bad in ([], [*good, ("r2", "2", 30, "A", "G")], good[::-1]):
        with pytest.raises(ValueError):
            selection.check_list(listed(spark, bad))
    assert selection.summary(listed(spark, good)) == "Variant filter: 2 variants on chromosome 1 (positions 10 - 20)"
    assert selection.summary(listed(spark, [])) == "Empty variant filter"


def test_extract_signs_and_gaps(spark):
    store = spark.createDataFrame([(0, 0, 1.0), (0, 1, 0.5), (1, 1, 1.0), (3, 3, 1.0)], "i int, j int, r double")
    t = spark.createDataFrame([(0, 1, True), (1, 0, False), (2, 3, True)], "ord long, idx long, flipped boolean")
    got = {(r["a"], r["b"]): r["r"] for r in extract.extract(store, t).collect()}
    assert got[0, 1] == -0.5 and got[2, 2] == 1 and np.isnan(got[0, 2]) and len(got) == 6
    assert {(r["a"], r["b"]): r["r"] for r in extract.extract(store, t, "zero", True).collect()}[2, 0] == 0
    assert extract.missing_cells(store, t).first()[0] == 4
    with pytest.raises(ValueError):
        extract.extract(store, t.union(t))


def test_lookup(spark):
    meta = spark.createDataFrame([(k, f"rs{k}") for k in range(4)], "row int, rsid string")
    cells = spark.createDataFrame([(i, j, i + j / 10) for i in range(4) for j in range(i + 1, 4)], "i int, j int, r double")
    ask = spark.createDataFrame([(0, "rs2"), (1, "zz"), (2, "rs0"), (3, "rs2")], "ord long, rsid string")
    with pytest.raises(KeyError):
        lookup.resolve(ask, meta)
    rows = lookup.resolve(ask, meta, "skip")
    got = {(r["a"], r["b"]): r["r"] for r in lookup.submatrix(rows, rows, cells).collect()}
    assert got[0, 3] == 1 and abs(got[0, 2] - 0.2) < 1e-6 and len(got) == 9
    assert lookup.columns_of(rows, meta, cells).count() == 12
    assert lookup.pair(cells, 3, 1) == pytest.approx(1.3) and lookup.pair(cells, 1, 1) == 1


def test_ranges_are_merged(spark):
    r = np.random.default_rng(7)
    at = np.unique(np.concatenate([r.integers(0, 3 << 30, 400), (1 << 30) + np.arange(-300, 300, 7), (2 << 30) + np.arange(-9, 9)]))
    want = []
    for x in at.tolist():
        if want and x - want[-1][1] <= 64:
            want[-1][1] = max(want[-1][1], x + 8)
        else:
            want.append([x, x + 8])
    starts, stops, which = triangle.merged(at, np.full(len(at), 8), 64)
    assert np.array_equal(np.stack([starts, stops], 1), want) and all(starts[w] <= x < stops[w] for x, w in zip(at, which, strict=True))
    got = triangle.merge_ranges(spark.createDataFrame([(int(x),) for x in at], "offset long"), 8, 64).select("start", "stop").collect()
    assert sorted(map(list, got)) == want


def test_means_of_long_rows_take_one_pass(spark):
    """An array's mean is not taken again for each of its elements; a row without values has none."""
    n = 60_000
    d = np.random.default_rng(6).binomial(2, 0.3, (3, n)).astype(float)
    d[0, ::7] = d[1, 5] = d[2] = np.nan
    rows = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(d)], "variant_idx int, dosage array<double>").union(spark.createDataFrame([(3, [None, 1.0, *[2.0] * (n - 2)])], "variant_idx int, dosage array<double>"))
    began = time.monotonic()
    found, keep = flows._resolve(rows, np.arange(n), "mean")
    got = {r["variant_idx"]: np.array(r["dosage"], float) for r in found.collect()}
    took = time.monotonic() - began
    for k in (0, 1):
        assert np.allclose(got[k], np.where(np.isnan(d[k]), np.nanmean(d[k]), d[k]), rtol=0, atol=1e-12)
    assert np.isnan(got[2]).all() and abs(got[3][0] - (2 * n - 3) / (n - 1)) < 1e-12 and len(keep) == n
    assert took < 30
