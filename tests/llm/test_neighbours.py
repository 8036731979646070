from pathlib import Path

import numpy as np
import pytest

from entspark.llm import neighbours as N

from .conftest import rows

SF = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(ids, x, k):
    out = {}
    for i in range(len(ids)):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        d[i] = np.inf
        out[ids[i]] = [int(ids[j]) for j in sorted(range(len(ids)), key=lambda j: (round(d[j], 9), ids[j]))[:k] if np.isfinite(d[j])]
    return out


@pytest.mark.parametrize("cell,ask", [(50, 40), (100_000, 65_536)])
def test_recall_of_every_row(spark, monkeypatch, cell, ask):
    monkeypatch.setattr(N, "CELL_ROWS", cell)
    monkeypatch.setattr(N, "ASK_ROWS", ask)
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(12, 24))
    x = (centres[rng.integers(0, 12, 700)] + 0.4 * rng.normal(size=(700, 24))).astype(np.float32).astype(float)
    frame = spark.createDataFrame([(k, [float(v) for v in r], 0) for k, r in enumerate(x)], SCHEMA)
    got = {}
    for r in N.nearest(frame).collect():
        got.setdefault(r.vec_id, set()).add(r.neighbour_id)
    want = brute(np.arange(700), x, 10)
    assert all(len(v) == 10 for v in got.values()) and len(got) == 700
    assert sum(len(got[i] & set(want[i])) for i in want) >= 0.95 * 7_000


def test_the_test_stops_search():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(60, 32)) * 10
    x = centres[rng.integers(0, 60, 6_000)] + rng.normal(size=(6_000, 32)) * 0.1
    y = x @ N.directions(32)
    seen = 0
    add = N.Best.add

    def counted(self, query, d2, ident):
        nonlocal seen
        seen += len(query)
        add(self, query, d2, ident)

    N.Best.add = counted
    try:
        N.Cell(np.arange(6_000), x, y).search(np.arange(6_000), x, y, 10)
    finally:
        N.Best.add = add
    assert seen < 0.1 * 6_000**2


def test_chi_square():
    assert abs(N.chi2_quantile(0.95) - 15.507) < 1e-3 and abs(float(N.chi2_cdf(7.344)) - 0.5) < 1e-3
    d = N.directions(40)
    rng = np.random.default_rng(3)
    v = rng.normal(size=(4_000, 40))
    ratio = ((v @ d) ** 2).sum(1) / (v**2).sum(1)
    assert abs(ratio.mean() / N.M - 1) < 0.5


def test_defined_results(spark):
    data = [(1, [0.0, 0.0], 0), (2, [0.0, 0.0], 0), (3, [0.0, 1.0], 0), (3, [0.0, 1.0], 0), (4, [0.0, -1.0], None), (5, None, 0), (6, [], 0), (7, [1.0, None], 0), (8, [float("nan"), 1.0], 0), (9, [1.0], 0), (None, [1.0, 1.0], 0)]
    frame = spark.createDataFrame(data, SCHEMA)
    out = rows(N.nearest(frame, 2))
    assert out == [(1, 1, 2, 0.0), (1, 2, 3, 1.0), (2, 1, 1, 0.0), (2, 2, 3, 1.0), (3, 1, 1, 1.0), (3, 2, 2, 1.0), (4, 1, 1, 1.0), (4, 2, 2, 1.0)]
    clash = frame.selectExpr("*", "1 AS cell", "2 AS v", "3 AS rank", "4 AS neighbour_id", "5 AS d2", "6 AS ask")
    assert rows(N.nearest(clash, 2)) == out
    assert rows(N.nearest(spark.createDataFrame([], SCHEMA))) == []
    assert rows(N.nearest(spark.createDataFrame([(1, [1.0, 2.0], 0)], SCHEMA))) == []
    assert rows(N.nearest(frame, 2, asking="vec_id % 2 = 0")) == [r for r in out if r[0] % 2 == 0]
    assert rows(N.nearest(frame.selectExpr("vec_id", "cast(embedding AS array<double>) AS embedding"), 2)) == out


def test_a_hot_vector(spark, monkeypatch):
    """Of a vector that a third of all rows has, the least ids are the nearest, whatever the cells hold."""
    monkeypatch.setattr(N, "CELL_ROWS", 64)
    frame = spark.createDataFrame([(k, [1.0, 1.0] if k % 3 == 0 else [float(k), 2.0], 0) for k in range(900)], SCHEMA)
    got = {}
    for r in N.nearest(frame, 3).filter("vec_id % 3 = 0").collect():
        got.setdefault(r.vec_id, []).append((r.rank, r.neighbour_id, r.distance))
    assert len(got) == 300
    for i, own in got.items():
        assert sorted(own) == [(n + 1, j, 0.0) for n, j in enumerate([j for j in (0, 3, 6, 9) if j != i][:3])]


@pytest.mark.skipif(not Path(SF).exists(), reason="the tables aren't here")
def test_the_query_against_brute_force(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in table]), np.array([r.embedding for r in table], float)
    got = {}
    for r in N.query(spark, SF).collect():
        got.setdefault(r.vec_id, {})[r.rank] = r.neighbour_id
    assert set(got) == {int(i) for i in ids if i % 50 == 0} and all(sorted(v) == list(range(1, 11)) for v in got.values())
    want = brute(ids, x, 10)
    assert sum(len(set(got[i].values()) & set(want[i])) for i in got) >= 0.9 * 10 * len(got)
