"""Ranks over sorted rows that are cut into tasks anywhere, and rounds of doubling."""

import itertools
import types

import numpy as np
import pyarrow as pa
import pytest
from gramwright.llm import suffix_dedup


@pytest.mark.parametrize("repeats", [False, True])
def test_cuts_do_not_change_ranks(monkeypatch, repeats):
    r = np.random.default_rng(3)
    for trial in range(150):
        n = int(r.integers(1, 40))
        rows = sorted(tuple(int(x) for x in row) for row in zip(r.integers(0, 3, n), r.integers(0, 2 + trial % 3, n), r.integers(0, 4, n), r.integers(0, 2, n), r.integers(0, 3, n), strict=True))
        # equal rows go to one task
        cuts = sorted({0, n, *(int(c) for c in r.integers(0, n + 1, int(r.integers(0, 8))) if 0 < c < n and rows[c] != rows[c - 1])})
        notes, told = [], {}
        for part, (a, b) in enumerate(itertools.pairwise(cuts)):
            monkeypatch.setattr(suffix_dedup, "TaskContext", types.SimpleNamespace(get=lambda part=part: types.SimpleNamespace(partitionId=lambda: part)))
            some = rows[a:b]
            columns = [pa.array([x[k] for x in some], pa.int64() if k < 4 else pa.int32()) for k in range(5)] + [pa.array(range(a, b), pa.int32())]
            batch = pa.RecordBatch.from_arrays(columns, names=[*suffix_dedup.ORDER, "more"])
            for out in suffix_dedup._number(iter([batch.slice(0, 3), batch.slice(3)]), repeats):
                for x in out.to_pylist():
                    if x["note"] is not None:
                        notes.append((part, x["note"]))
                    else:
                        told[x["more"]] = (part, x)
        fixes = {f[0]: f[1:] for f in suffix_dedup.across(notes)}
        for k, row in enumerate(rows):
            kind = [x for x in rows if x[:2] == row[:2]]
            want = (rows.index(kind[0]), row == kind[0], len(set(kind)) > 1, len({x[1] for x in rows if x[0] == row[0]}) > 1)
            if k not in told:  # left out, as nothing depends on it
                assert not want[2] if repeats else want[1] and not want[3]
                continue
            part, x = told[k]
            before, began, several1, several2, many1, many2, rank1 = fixes[part]
            on = lambda bit, x=x: bool(x["edge"] & bit)
            got = (
                rank1 if on(suffix_dedup.LEAD2) else before + x["rank"], x["first"] and not (on(suffix_dedup.LEAD2) and began),
                x["many"] or on(suffix_dedup.LEAD2) and many1 or on(suffix_dedup.TAIL2) and many2, x["several"] or on(suffix_dedup.LEAD1) and several1 or on(suffix_dedup.TAIL1) and several2,
            )
            assert got == want


def test_rounds_of_doubling(spark, monkeypatch):
    """Two rounds, at offsets of 25 and 50 bytes; what is unique by half goes in the first."""
    r = np.random.default_rng(5)
    letters = "abcdefghij"
    make = lambda n: "".join(r.choice(list(letters), n))
    shared, half = make(130), make(60)
    docs = [make(80) + shared + make(70), make(33) + shared + make(90), make(90) + half + make(200), make(120) + half + make(150)]
    sizes = []
    plain = suffix_dedup.rerank
    monkeypatch.setattr(suffix_dedup, "rerank", lambda rows, name, repeats=False: (sizes.append((name, rows.count())), plain(rows, name, repeats))[1])
    table = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = {x["doc"]: x["n_removed"] for x in suffix_dedup.remove_repeats(table).collect()}
    assert got == {0: 0, 1: 130, 2: 0, 3: 0}
    rounds = [n for name, n in sizes if name == "ranks"]
    assert len(rounds) == 2 and rounds[1] <= rounds[0]
