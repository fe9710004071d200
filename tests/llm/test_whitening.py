import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from leakscope.llm import whitening
from leakscope.llm.queries import op12_whitening

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SCHEMA = "vec_id bigint, embedding array<double>"


def plain(rows, components=8):
    """By Python numbers and one covariance: deviations, eigenvalue shares and whitened rows up to their sign."""
    x = [[math.floor(1024 * c) + 100_000 for c in v] for _, v in rows]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    deviations = [sum((n * a - s) ** 2 for a, s in zip(v, sums)) for v in x]
    centred = np.array([[(n * a - s) / n for a, s in zip(v, sums)] for v in x])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    return deviations, values / np.trace(centred.T @ centred / n), centred @ vectors / np.sqrt(values)


def compare(found, rows, components=8):
    deviations, shares, whitened = plain(rows, components)
    assert len(found) == len(rows) * len(shares)
    table = {(r.vec_id, r.component): r for r in found}
    for k, (vec_id, _) in enumerate(rows):
        for c in range(len(shares)):
            row = table[vec_id, c + 1]
            assert (row.n, row.deviation) == (len(rows), deviations[k])
            assert row.explained == pytest.approx(shares[c], rel=1e-9)
            assert abs(row.whitened) == pytest.approx(abs(whitened[k, c]), rel=1e-6, abs=1e-7)
    signs = {c: {np.sign(table[i, c + 1].whitened * whitened[k, c]) for k, (i, _) in enumerate(rows) if abs(whitened[k, c]) > 1e-3} for c in range(len(shares))}
    assert all(len(s) == 1 for s in signs.values())
    assert {r.identity_error for r in found}.pop() < 1e-9


@pytest.mark.parametrize("high", [1, 2, 1000, 2**21, 2**40, 2**63 - 1])
def test_sliced_products_are_exact(high):
    values = np.random.default_rng(1).integers(0, high, (3, 130), dtype=np.uint64)
    exact = values.astype(object) @ values.T.astype(object)
    assert (whitening.sliced_products(values) == exact).all()


def test_whitening_equals_the_plain_way(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=12) * np.arange(1, 13)).tolist()) for i in range(300)]
    found = whitening.whiten(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    compare(found, rows)
    assert [f.name for f in whitening.whiten(spark.createDataFrame(rows, SCHEMA)).schema][:3] == ["vec_id", "component", "n"]


def test_awkward_vectors(spark):
    good = [(1, [0.5, 1.0]), (2, [-0.25, 3.0]), (2, [-0.25, 3.0]), (None, [2.0, -1.0])]
    bad = [(4, None), (5, []), (6, [1.0]), (7, [None, 1.0]), (8, [float("nan"), 1.0]), (9, [float("inf"), 1.0]), (10, [1.0, 2.0, 3.0])]
    table = spark.createDataFrame(good + bad, SCHEMA).withColumns({c: F.lit(0) for c in ("n", "whitened", "component", "i", "at")})
    found = whitening.whiten(table).collect()
    assert len(found) == 4 * 2 and {r.n for r in found} == {4}
    assert sorted({r.vec_id for r in found}, key=str) == [1, 2, None]
    assert len({r.deviation for r in found if r.vec_id == 2}) == 1


def test_entries_of_any_size(spark):
    rows = [(1, [1e300, 1.0]), (2, [-3e30, 0.0]), (3, [1e15, -97.0])]
    found = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert all(r.deviation is None or r.deviation > 0 for r in found) and {r.n for r in found} == {3}
    wide = [(i, [2.0**30 * i, 2.0**28 * (i * i % 7)]) for i in range(9)]
    compare(whitening.whiten(spark.createDataFrame(wide, SCHEMA)).collect(), wide)


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(1, [1.0]), (2, [1.0])], [(1, None)], [(1, [])]])
def test_without_spread_no_rows(spark, rows):
    assert whitening.whiten(spark.createDataFrame(rows, SCHEMA)).count() == 0


def test_directions_without_spread_are_no_components(spark):
    rows = [(i, [float(i % 5), 2.0 * (i % 5), 1.0, float(i % 3)]) for i in range(60)]
    found = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.component for r in found} == {1, 2}
    compare(found, rows, 2)


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
def test_query_equals_the_plain_way(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/embeddings.parquet").select("vec_id", "embedding").collect()]
    compare(op12_whitening(spark, SF_DIR).collect(), rows)
