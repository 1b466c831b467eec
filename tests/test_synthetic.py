import numpy as np
from gramwright.operators import gram, selection, standardize
from gramwright.sources import synthetic


def test_generators_feed_the_engine(spark):
    g = synthetic.genotypes(spark, 30, 12)
    again = {r["variant_idx"]: r["dosage"] for r in synthetic.genotypes(spark, 30, 12).collect()}
    d = {r["variant_idx"]: r["dosage"] for r in g.collect()}
    assert d == again and all(0 <= x <= 2 for v in d.values() for x in v)
    z = standardize.standardize_array(np.array([d[k] for k in range(12)]).T)[0]
    got = {(r["i"], r["j"]): r["r"] for r in gram.tile_gram(standardize.standardize_rows(g), 12, 30, 5, 8).collect()}
    want = z.T @ z
    assert len(got) == 78 and all(abs(want[k] - r) < 1e-10 for k, r in got.items())
    listed = selection.check_list(synthetic.variant_list(g, 12, 0.5))
    assert listed.count() == 6
    assert synthetic.covariates(spark, 5).columns[-2:] == ["age", "sex"]
