import random
import zlib

import numpy as np
import pytest

from lexloom.llm import language_id as L

from .test_models import SYLLABLES, text_of


def test_every_labelled_row_calibrates(spark):
    """Temperature and limits are those of all labelled rows, by brute force; also of a language with few, and in any
    partitions. A language with no text but an empty one has no model and stops nothing."""
    r = random.Random(8)
    rows = [(i, text_of(r, x := r.choice(sorted(SYLLABLES)), r.randint(1, 6)), x) for i in range(6_000)]
    rows += [(7_000 + i, "zu po " * (i + 1) + text_of(r, "aa", i), "dd") for i in range(8)] + [(8_000 + i, "", "ee") for i in range(4)] + [(9_000, "12", "aa")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.train(docs.repartition(3))
    fit = [(t, x) for i, t, x in rows if zlib.crc32(str(i).encode()) % 4 != 2 and any(c.isalpha() for c in t)]
    assert len(fit) > 4_000 and model.langs == ["aa", "bb", "cc", "dd"]
    entropy, own = model.entropies([t for t, _ in fit])[0], np.array([model.langs.index(x) for _, x in fit])
    mine = entropy[np.arange(len(fit)), own]
    assert 4 < (own == 3).sum() <= 8
    assert model.calibration["limits"] == pytest.approx([mine[own == j].mean() + L.SPREAD * mine[own == j].std() + L.SLACK for j in range(4)], abs=1e-6)
    loss = []
    for t in L.TEMPERATURES:
        p = np.exp(-(entropy - entropy.min(axis=1, keepdims=True)) / t)
        p = (p / p.sum(axis=1, keepdims=True))[np.arange(len(fit)), own]
        loss.append(-np.log(np.maximum(p, 1e-12)).mean() - np.log(np.maximum(1 - p, 1e-12)).mean() / (2 * len(fit)))
    assert model.calibration["temperature"] == L.TEMPERATURES[np.argmin(loss)]
    assert L.train(docs.repartition(7)).calibration == model.calibration
