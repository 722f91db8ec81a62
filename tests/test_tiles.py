"""All pairs and nearest vectors, tile by tile, against one matrix."""

import numpy as np
import pytest

from lexloom.operators import clusters as K
from lexloom.operators import graph as G
from lexloom.operators import tiles as T


@pytest.fixture(scope="module")
def some(spark):
    """300 vectors of three clusters, one small; 60 equal ones, a null and a zero one."""
    r = np.random.default_rng(3)
    v = r.normal(size=(300, 9))
    v[100:160], v[7] = v[100], 0
    rows = [(f"v{i:03d}", 2 if i >= 290 else i % 2, None if i == 5 else x.tolist()) for i, x in enumerate(v)]
    n = np.linalg.norm(v, axis=1)[:, None]
    return spark.createDataFrame(rows, "id string, label int, vector array<double>"), rows, v / np.where(n > 0, n, 1)


@pytest.mark.parametrize("rows, few", [(16, 3), (1024, 64), (1024, 1000)])
def test_all_pairs_of_a_cluster(monkeypatch, some, rows, few):
    df, given, u = some
    monkeypatch.setattr(T.cluster_pairs, "__defaults__", (rows, few))
    edges = G.similar_edges(df)[0]
    assert (few < 1000) == ("FlatMapGroupsInArrow" in edges._jdf.queryExecution().executedPlan().toString())
    got = {(e.source, e.target): e.weight for e in edges.collect()}
    want = {(given[i][0], given[j][0]): None if 5 in (i, j) else float(u[i] @ u[j]) for i in range(300) for j in range(i + 1, 300) if given[i][1] == given[j][1]}
    assert got.keys() == want.keys() and all((got[k] is None) == (w is None) and (w is None or abs(got[k] - w) < 1e-12) for k, w in want.items())


@pytest.mark.parametrize("few, rows, cells", [(10_000, 4096, 4_000_000), (10_000, 4096, 200), (10, 40, 500)])
def test_nearest_by_blocks(monkeypatch, some, few, rows, cells):
    df, given, u = some
    monkeypatch.setattr(T.nearest, "__defaults__", (few, rows))
    monkeypatch.setattr(T.top, "__defaults__", (cells,))
    got = {}
    for x in K.nearest(df.where("label = 0"), df, 70).collect():
        got.setdefault(x.query_id, []).append((x.rank, x.id, x.score))
    s = np.array([[(a * b).sum() for b in u] for a in u])
    for i in range(0, 290, 2):
        order = sorted((j for j in range(300) if j != i), key=lambda j: (j == 5, -s[i, j], j))[:70]
        assert [(n, x) for n, x, _ in sorted(got[given[i][0]])] == [(n, given[j][0]) for n, j in enumerate(order, 1)]
    assert len(got) == 145
