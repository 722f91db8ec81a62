import numpy as np
import pytest

from lexloom.operators import clusters as K

from .test_operators import greedy_linkage


@pytest.mark.parametrize("many, tile", [(0, 11), (12, 4096)])
def test_rounds_of_merges_are_the_greedy_ones(spark, monkeypatch, many, tile):
    """All rows, or all but the last twelve clusters, are merged in rounds by tiles; two rows are equal and one is alone."""
    monkeypatch.setattr(K.merge_rounds, "__defaults__", (many, tile))
    r = np.random.default_rng(9)
    v = np.concatenate([h + r.normal(size=(8, 7)) * s for h, s in zip(r.normal(size=(5, 7)), (0.1, 0.3, 0.6, 0.9, 1.2), strict=True)] + [-np.ones((1, 7)) * 3])
    v[1] = v[0]
    u = v / np.linalg.norm(v, axis=1)[:, None]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vector array<double>")
    for threshold in (0.3, 0.62):
        got = {}
        for row in K.cluster(df, threshold).collect():
            got.setdefault(row.label, set()).add(row.id)
        assert {frozenset(x) for x in got.values()} == greedy_linkage(1 - u @ u.T, threshold) and all(k == min(x) for k, x in got.items())
