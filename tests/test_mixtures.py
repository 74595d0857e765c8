"""Mixtures by statistics against the same steps on whole matrices."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.operators import mixtures


def whole(ids, order, x, most, rounds):
    """One group in memory: {(id, cluster): p} of the best number of clusters."""
    n, d = x.shape
    first = x[np.argsort(order, kind="stable")]
    best = None
    for k in range(2, min(most, n - 1) + 1):
        mix, mean, var = np.full(k, 1 / k), first[:k].copy(), np.tile(np.maximum(x.var(axis=0), 1e-6) + 1e-6, (k, 1))
        for step in range(rounds + 1):
            logp = np.log(mix) - 0.5 * (np.log(2 * np.pi * var).sum(1) + ((x[:, None] - mean) ** 2 / var).sum(2))
            top = logp.max(1, keepdims=True)
            like = top[:, 0] + np.log(np.exp(logp - top).sum(1))
            r = np.exp(logp - like[:, None])
            if step < rounds:
                nk = r.sum(0) + 1e-9
                mean, mix = (r.T @ x) / nk[:, None], nk / n
                var = np.maximum((r.T @ x**2) / nk[:, None] - mean**2, 1e-6)
        bic = round(-2 * like.sum() + (2 * k * d + k - 1) * np.log(n), 6)
        if best is None or bic < best[0]:
            best = bic, r
    r = best[1]
    i, c = np.nonzero((r >= 0.3) | (r == r.max(1, keepdims=True)))
    return {(ids[a], int(b)): r[a, b] for a, b in zip(i, c)}


def test_clusters_are_those_of_whole_matrices(spark, monkeypatch):
    monkeypatch.setattr(mixtures, "BLOCK", 16)  # several blocks a group
    monkeypatch.setattr(mixtures, "TOLERANCE", -1.0)  # all rounds
    rng = np.random.default_rng(0)
    rows = []
    for g, (n, k) in enumerate([(60, 3), (25, 2), (5, 2), (3, 1), (1, 1)]):
        rows += [(f"g{g}", 100 * g + j, [float(v) for v in rng.normal(size=3) + 6 * np.eye(3)[j % k]]) for j in range(n)]
    d = spark.createDataFrame([*rows, (None, 999, [1.0, 1.0, 1.0]), ("g0", 998, None)], "doc string, id long, embedding array<double>").withColumn("g", F.lit("clash"))
    got = mixtures.mixture_clusters(d, "doc", most=4, rounds=4).collect()
    order = {r.id: r.h for r in d.select("id", F.xxhash64("id").alias("h")).collect()}
    for g in ("g0", "g1", "g2"):
        mine = [(i, v) for x, i, v in rows if x == g]
        want = whole([i for i, _ in mine], [order[i] for i, _ in mine], np.array([v for _, v in mine]), 4, 4)
        have = {(r.id, r.cluster): r.p for r in got if r.doc == g}
        assert set(have) == set(want)
        assert all(have[k] == pytest.approx(want[k], abs=1e-4) for k in want)
    assert {(r.doc, r.id, r.cluster, r.p) for r in got if r.doc in ("g3", "g4")} == {(x, i, 0, 1.0) for x, i, _ in rows if x in ("g3", "g4")}
    assert {r.id for r in got} == {i for _, i, _ in rows}


def test_no_rows_no_clusters(spark):
    d = spark.createDataFrame([], "doc long, id long, embedding array<double>")
    assert mixtures.mixture_clusters(d, "doc", rounds=1).collect() == []
