"""Nearest neighbours of very long, very short and uneven vectors, over several homes, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terralith.llm import neighbours


@pytest.mark.parametrize("scale", ["1e25", "1e-25", "1e150", "uneven", "wide ids"])
def test_recall_at_any_scale(spark, monkeypatch, scale):
    monkeypatch.setattr(neighbours, "HOME_NODES", 120)
    r = np.random.default_rng(4)
    x = r.normal(size=(400, 16))
    if scale == "uneven":
        x *= 10.0 ** r.uniform(-12, 6, size=(400, 1))
    elif scale != "wide ids":
        x *= float(scale)
    ids = np.arange(400) * (20 if scale != "wide ids" else 20 * 10**15) - (0 if scale != "wide ids" else 4 * 10**18)
    x[7], x[9] = 0, x[8]
    df = spark.createDataFrame([(int(i), [float(c) for c in v]) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>").repartition(3)
    got: dict[int, list] = {}
    for row in neighbours.nearest(df, F.col("vec_id") % 80 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(row.query_id, []).append(row)
    recall = []
    for q in range(0, 400, 4) if scale != "wide ids" else [k for k in range(400) if ids[k] % 80 == 0 and k != 7]:
        s = x @ x[q]
        s[[q, 7]] = -np.inf
        rows = got[int(ids[q])]
        assert [r.rank for r in rows] == list(range(1, 21)) and all(np.isclose(r.score, s[int(np.flatnonzero(ids == r.vec_id)[0])], rtol=1e-9, atol=0) or abs(r.score) < 1e-9 * np.abs(s[np.isfinite(s)]).max() for r in rows)
        recall.append(len({r.vec_id for r in rows} & set(ids[np.argsort(-s, kind="stable")[:20]].tolist())) / 20)
    assert np.mean(recall) >= 0.95, (np.mean(recall), min(recall))
