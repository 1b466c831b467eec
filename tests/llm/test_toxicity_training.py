"""Training of the toxicity machine, whatever way the documents are dealt out."""

import tracemalloc

import numpy as np
from gramwright.llm import toxicity


def test_partitions_do_not_change_the_machine(spark):
    r = np.random.default_rng(11)
    words = [f"word{k}" for k in range(40)]
    rows = [(k, " ".join([*r.choice(words, 12), *(["zorp"] if k < 100 else [])]), int(k < 100)) for k in range(600)]
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    docs, labels = table.select("doc_id", "text"), table.select("doc_id", "toxic")
    # in order of doc_id, most tasks have no toxic row
    machines = [toxicity.train(docs.repartitionByRange(n, "doc_id"), labels) for n in (1, 8, 400)]
    for other in machines[1:]:
        assert machines[0].bias == other.bias and np.array_equal(machines[0].table, other.table)


def test_repeated_ids_train_once(spark):
    rows = [(k % 300, f"calm words {k % 300}" + " zorp" * (k % 300 < 60), int(k % 300 < 60)) for k in range(900)]
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    many = toxicity.train(table.select("doc_id", "text"), table.select("doc_id", "toxic"))
    once = toxicity.train(table.dropDuplicates(["doc_id"]).select("doc_id", "text"), table.select("doc_id", "toxic"))
    assert np.array_equal(many.table, once.table)


def test_every_term_counts():
    """Terms of toxic and of clean rows alike have weights; terms by chance hardly any."""
    r = np.random.default_rng(5)
    rows, label = [], []
    for k in range(600):
        y = k % 5 == 0
        mine = [10 + k % 3] if y else [20 + k % 3]
        rows.append(np.unique(np.array([*mine, *r.integers(100, 160, 20)])))
        label.append(float(y))
    machine = toxicity.fit(rows, np.array(label))
    assert (machine.table[10:13, 0] > 0).all() and (machine.table[20:23, 0] < 0).all()
    assert abs(machine.table[100:160, 0]).max() < machine.table[10:13, 0].min() / 4


def test_scores_are_the_double_sum():
    r = np.random.default_rng(2)
    machine = toxicity.Machine(-0.3, r.normal(0, 0.2, (toxicity.BUCKETS, 1 + toxicity.FACTORS)).astype(np.float32))
    texts = ["zorp and veltans", "", "one", "Zorp zorp été  x1 the end of it", "\n\t"]
    for t, got in zip(texts, machine.score(texts), strict=True):
        bucket, owner = toxicity.terms([t])
        present = sorted(set(bucket.tolist()))
        want = machine.bias + sum(float(machine.table[b, 0]) for b in present)
        want += sum(float(machine.table[a, 1:].astype(float) @ machine.table[b, 1:].astype(float)) for i, a in enumerate(present) for b in present[:i])
        assert abs(got - 1 / (1 + np.exp(-want))) < 1e-6


def test_driver_holds_a_step_of_rows():
    """Rows in a file give the machine of rows in memory, and little more than the two tables is held."""
    r = np.random.default_rng(9)
    rows = [np.unique(r.integers(0, toxicity.BUCKETS, int(k)).astype(np.int32)) for k in [0, 1, *r.integers(3000, 9000, 510)]]
    rows[7] = np.array([0, 65535, 65536, toxicity.BUCKETS - 1], np.int32)
    label = (np.arange(512) % 3 == 0).astype(float)
    kept = toxicity.FileRows()
    kept.order = r.permutation(512)
    for k in np.argsort(kept.order):
        kept.append(toxicity.packed(rows[k]))
    assert len(kept) == 512 and all(np.array_equal(a, b) for a, b in zip(kept, rows, strict=True))
    one = toxicity.fit(rows, label, 1)
    tracemalloc.start()
    other = toxicity.fit(kept, label, 1)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert one.bias == other.bias and np.array_equal(one.table, other.table)
    step = 256 * 6000 * 4
    assert most < 2 * one.table.nbytes + 4 * toxicity.BUCKETS + 33 * step, (most, step)
