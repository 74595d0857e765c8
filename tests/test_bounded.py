"""Interval joins, refined percentiles and upserts against plain Python."""

import math
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.operators import blocks, ingest, intervals, operations


def test_points_meet_every_interval_around_them_once(spark):
    rng = np.random.default_rng(2)
    spans = [(int(k), int(rng.integers(0, 3)), int(a), int(a + rng.choice([0, 1, 2, 7, 64, 1000, 10**12]))) for k, a in enumerate(rng.integers(-50, 2000, 150))] + [(900, 0, None, 5), (901, 0, 5, None), (902, 0, 9, 3), (903, 1, 2**61, 2**61 + 3)]
    points = [(int(k), int(rng.integers(0, 3)), int(p)) for k, p in enumerate(rng.integers(-60, 2100, 200))] + [(901, 1, None), (902, 1, 2**61 + 2)]
    i = spark.createDataFrame(spans, "i long, k int, start long, end long")
    p = spark.createDataFrame(points, "p long, k int, at long")
    got = [(r.p, r.i) for r in intervals.enclosing(p, i, ["k"]).collect()]
    want = {(a, b) for a, ka, at in points for b, kb, s, e in spans if ka == kb and None not in (at, s, e) and s <= at < e}
    assert len(got) == len(want) and set(got) == want
    assert intervals.enclosing(p, i.limit(0), ["k"]).collect() == []


def test_many_cells_of_a_small_file_are_not_sent_through_the_driver(spark, tmp_path):
    """A planner judges by the file, which holds few bytes for many cells."""
    spark.range(10_000).select(F.col("id").alias("i"), F.lit(1).alias("k"), F.lit(1).cast("long").alias("start"), F.lit(2**20 - 1).alias("end")).write.parquet(str(tmp_path / "i"))
    i, p = spark.read.parquet(str(tmp_path / "i")), spark.range(3).select(F.col("id").alias("p"), F.lit(1).alias("k"), (F.col("id") * 2**19).alias("at"))
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    found = intervals.enclosing(p, i, ["k"])
    assert "Broadcast" not in plan(found)
    assert found.groupBy("p").count().collect() == [(1, 10_000)]
    # what no point can be in is no cell
    near = intervals.enclosing(p.where("p = 1"), i, ["k"])
    assert "BroadcastHashJoin" in plan(near) and near.count() == 10_000
    assert intervals.enclosing(p.where("p = 0"), i, ["k"]).count() == 0 and intervals.enclosing(p.limit(0), i, ["k"]).count() == 0


@pytest.mark.parametrize("ps", [(0.5, 0.95), (0.0, 0.1, 1.0)])
def test_refined_percentiles_are_nearest_ranks(spark, ps):
    rng = np.random.default_rng(3)
    values = {"a": rng.normal(size=500).tolist(), "b": [1.0] * 50, "c": [float(10**k) for k in range(-20, 20)] * 2, "d": [3.5], None: [1e300, -1e300, 0.0, 5e-324]}
    d = spark.createDataFrame([(g, v) for g, vs in values.items() for v in vs] + [("a", None), ("e", None)], "g string, v double").withColumn("n", F.lit("clash"))
    got = {r.g: tuple(r)[1:] for r in operations.refined_percentiles(d, "v", ps, ("g",)).collect()}
    for g, vs in values.items():
        assert got[g] == (len(vs), *(sorted(vs)[max(1, math.ceil(p * len(vs) - 1e-9)) - 1] for p in ps))
    assert got["e"] == (0, *([None] * len(ps)))
    assert operations.refined_percentiles(d, "v", ps).head()["n"] == sum(map(len, values.values()))


def test_bad_rows_come_back_and_good_ones_load(spark):
    old = spark.createDataFrame([(1, 10, "x"), (2, 20, "y")], "id long, v long, note string")
    new = spark.createDataFrame([(2, "21", 1), (2, "22", 3), (2, "23", 2), (3, "oops", 1), (None, "5", 1), (4, "-1", 1), (None, "bad", 9), (5, None, 1)], "id long, v string, seq long")
    merged, bad = ingest.checked_upsert(old, new, ["id"], F.col("seq"), {"NEGATIVE": ~F.coalesce(F.col("v").startswith("-"), F.lit(False))}, {"v": "long"})
    assert {(r.id, r.v) for r in merged.collect()} == {(1, 10), (2, 22), (5, None)} and merged.schema["v"].dataType.simpleString() == "bigint"
    assert sorted((str(r.id), r.v, tuple(r.errors)) for r in bad.collect()) == [("3", "oops", ("NOT_LONG: v",)), ("4", "-1", ("NEGATIVE",)), ("None", "5", ("NULL_KEY: id",)), ("None", "bad", ("NULL_KEY: id", "NOT_LONG: v"))]
    twice = spark.createDataFrame([(2, 1, "a"), (2, 1, "a"), (3, 1, "b")], old.schema)
    assert sorted(r.id for r in ingest.merge_rows(old, twice, ["id"]).collect()) == [1, 2, 3]


def test_a_product_of_full_blocks_is_made_in_parts():
    """A block of queries times one of rows of 64 components was 268 MB, and as much again for the cut."""
    rng = np.random.default_rng(5)
    x, q = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (rng.normal(size=(16_384, 64)), rng.normal(size=(2_048, 64))))
    tracemalloc.start()
    got = [(int(a), int(b)) for part in blocks.best_pairs(x, q, 1, 0.3) for a, b in zip(part[0], part[1], strict=True)]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 64 << 20
    best = [(k, int((x @ v).argmax())) for k, v in enumerate(q)]
    assert got == [(k, b) for k, b in best if x[b] @ q[k] >= 0.3 - blocks.SLOP]
