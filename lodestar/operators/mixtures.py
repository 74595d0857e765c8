"""Diagonal Gaussian mixtures of all groups and all numbers of clusters at once, by aggregated sufficient statistics.

Rows are packed once into blocks of at most BLOCK vectors of one group. A round joins each block with its group's
parameters, takes the block's responsibilities and their weighted sums, and adds those up by group; so neither memory nor a
task grows with a group, and the driver sees one number a round.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar import storage

#: Vectors of a block.
BLOCK = 1024
#: Least variance of a component, and its addition to a group's own at the start.
LEAST_VARIANCE = 1e-6
#: Rounds end when no group's likelihood grew by this share.
TOLERANCE = 1e-6


def _blocks(rows: DataFrame) -> DataFrame:
    """(g, n, ids, x): each group's vectors end to end, in blocks; groups of any size are cut by hash."""
    sizes = rows.groupBy("g").agg(F.count("*").alias("n"))
    cut = rows.join(sizes, "g").withColumn("part", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") * 2 / BLOCK).cast("long")))
    return cut.groupBy("g", "n", "part").agg(F.sort_array(F.collect_list(F.struct("id", "x"))).alias("v")).select("g", "n", F.col("v.id").alias("ids"), F.flatten("v.x").alias("x"))


def _log_densities(x: np.ndarray, mix: np.ndarray, mean: np.ndarray, var: np.ndarray) -> np.ndarray:
    """log(mix * density) of each row and component, by products of matrices."""
    far = (x * x) @ (1 / var).T - 2 * x @ (mean / var).T + (mean * mean / var).sum(axis=1)
    return np.log(mix) - 0.5 * (np.log(2 * np.pi * var).sum(axis=1) + far)


def _responsibilities(x: np.ndarray, mix, mean, var) -> tuple[np.ndarray, float]:
    logp = _log_densities(x, mix, mean, var)
    top = logp.max(axis=1, keepdims=True)
    like = top[:, 0] + np.log(np.exp(logp - top).sum(axis=1))
    return np.exp(logp - like[:, None]), float(like.sum())


def _models(row: dict, d: int):
    """(k, mix, mean, var) of a group's models."""
    for m in row["models"]:
        k = m["k"]
        yield k, np.array(m["mix"]), np.array(m["mean"]).reshape(k, d), np.array(m["var"]).reshape(k, d)


def _statistics(blocks: DataFrame, g_type: str) -> DataFrame:
    """(g, k, c, n, like, i, sx, sxx) of each block, model and component; like counts once, with component 0."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                x = np.array(row["x"]).reshape(len(row["ids"]), -1)
                for k, mix, mean, var in _models(row, x.shape[1]):
                    r, like = _responsibilities(x, mix, mean, var)
                    yield pa.RecordBatch.from_pydict(
                        {"g": pa.array([row["g"]] * k, g_arrow), "k": pa.array([k] * k, pa.int32()), "c": pa.array(range(k), pa.int32()), "n": r.sum(axis=0), "like": [like] + [0.0] * (k - 1), "sx": pa.array((r.T @ x).tolist(), pa.list_(pa.float64())), "sxx": pa.array((r.T @ (x * x)).tolist(), pa.list_(pa.float64()))}
                    )

    g_arrow = pa.int64() if g_type == "bigint" else pa.int32() if g_type == "int" else pa.string()
    parts = blocks.mapInArrow(run, f"g {g_type}, k int, c int, n double, like double, sx array<double>, sxx array<double>")
    flat = parts.select("g", "k", "c", "n", "like", F.posexplode(F.arrays_zip("sx", "sxx")).alias("i", "s"))
    once = lambda c: F.sum(F.when(F.col("i") == 0, F.col(c)).otherwise(0.0))
    sums = flat.groupBy("g", "k", "c", "i").agg(F.sum("s.sx").alias("sx"), F.sum("s.sxx").alias("sxx"), once("n").alias("n"), once("like").alias("like"))
    return sums.groupBy("g", "k", "c").agg(F.sum("n").alias("n"), F.sum("like").alias("like"), F.sort_array(F.collect_list(F.struct("i", "sx", "sxx"))).alias("s"))


def _updated(stats: DataFrame) -> DataFrame:
    """(g, k, like, mix, mean, var) of statistics: the next parameters, and the likelihood of the last ones."""
    share = F.col("n") + F.lit(1e-9)
    mean = F.transform("s", lambda e: e["sx"] / share)
    var = F.transform("s", lambda e: F.greatest(e["sxx"] / share - (e["sx"] / share) * (e["sx"] / share), F.lit(LEAST_VARIANCE)))
    c = stats.select("g", "k", "c", "n", "like", mean.alias("mean"), var.alias("var"))
    parts = F.sort_array(F.collect_list(F.struct("c", "n", "mean", "var")))
    m = c.groupBy("g", "k").agg(F.sum("like").alias("like"), F.sum("n").alias("all"), parts.alias("p"))
    return m.select("g", "k", "like", F.transform("p", lambda e: (e["n"] + 1e-9) / F.col("all")).alias("mix"), F.flatten("p.mean").alias("mean"), F.flatten("p.var").alias("var"))


def _with_models(blocks: DataFrame, models: DataFrame) -> DataFrame:
    packed = models.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("k", "mix", "mean", "var"))).alias("models"))
    return blocks.join(packed, "g")


def mixture_clusters(vectors: DataFrame, group: str, id_col: str = "id", vec_col: str = "embedding", most: int = 10, least_p: float = 0.3, rounds: int = 12) -> DataFrame:
    """(group, id, cluster, p): soft clusters of each group, their number 2..most chosen by BIC; members with
    p >= least_p, or the likeliest cluster.

    Components start at the group's rows of smallest hash of the id, with the group's own variances. A group of fewer than
    four rows is one cluster; the number of clusters stays below its rows. Rows without a group or a vector are left out;
    ids are unique in their group, vectors of a group equally long.
    """
    g_type = vectors.schema[group].dataType.simpleString()
    if g_type not in ("bigint", "int", "string"):
        raise ValueError(f"groups of type {g_type}")
    rows = storage.kept(vectors.where(F.col(group).isNotNull() & (F.size(vec_col) > 0)).select(F.col(group).alias("g"), F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("x")), "vectors")
    blocks = storage.kept(_blocks(rows), "blocks")
    few = blocks.where("n < 4").select("g", F.explode("ids").alias("id"), F.lit(0).alias("cluster"), F.lit(1.0).alias("p"))
    blocks = blocks.where("n >= 4")
    one = blocks.select("g", F.lit(1).alias("k"), F.array(F.lit(1.0)).alias("mix"), F.transform(F.slice("x", 1, (F.size("x") / F.size("ids")).cast("int")), lambda v: F.lit(0.0)).alias("mean")).distinct().withColumn("var", F.transform("mean", lambda v: F.lit(1.0)))
    spread = _updated(_statistics(_with_models(blocks, one), g_type)).select("g", F.transform("var", lambda v: v + LEAST_VARIANCE).alias("spread"))
    sized = rows.join(blocks.select("g", "n").distinct(), "g")
    first = sized.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy(F.xxhash64("id"), "id"))).where(F.col("r") <= most)
    seeds = first.groupBy("g").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("r", "x"))).alias("v")).join(spread, "g")
    k = F.explode(F.sequence(F.lit(2), F.least(F.lit(most), F.col("n") - 1).cast("int")))
    begin = seeds.select("g", k.alias("k"), "v", "spread").select("g", "k", F.array_repeat(F.lit(1.0) / F.col("k"), F.col("k")).alias("mix"), F.flatten(F.slice(F.col("v.x"), F.lit(1), F.col("k"))).alias("mean"), F.flatten(F.array_repeat("spread", F.col("k"))).alias("var"))
    models, last = storage.kept(begin.withColumn("like", F.lit(None).cast("double")).select("g", "k", "like", "mix", "mean", "var"), "models"), None
    for _ in range(rounds):
        after = storage.kept(_updated(_statistics(_with_models(blocks, models), g_type)), "models")
        was = models.select("g", "k", F.col("like").alias("was"))
        grew = after.join(was, ["g", "k"]).where(F.col("was").isNull() | (F.col("like") - F.col("was") > TOLERANCE * F.abs("was")))
        models, last = after, grew.isEmpty()
        if last:
            break
    scored = _statistics(_with_models(blocks, models), g_type).groupBy("g", "k").agg(F.sum("like").alias("like"), F.first(F.size("s")).alias("d"))
    bic = scored.join(blocks.select("g", "n").distinct(), "g").select("g", "k", F.round(-2 * F.col("like") + (2 * F.col("k") * F.col("d") + F.col("k") - 1) * F.log("n"), 6).alias("bic"))
    best = bic.groupBy("g").agg(F.min(F.struct("bic", "k")).alias("b")).select("g", F.col("b.k").alias("k"))
    chosen = storage.kept(models.join(best, ["g", "k"]), "chosen")

    def members(batches):
        for batch in batches:
            for row in batch.to_pylist():
                x = np.array(row["x"]).reshape(len(row["ids"]), -1)
                for _, mix, mean, var in _models(row, x.shape[1]):
                    r, _ = _responsibilities(x, mix, mean, var)
                    i, c = np.nonzero((r >= least_p) | (r == r.max(axis=1, keepdims=True)))
                    yield pa.RecordBatch.from_pydict({"g": pa.array([row["g"]] * len(i), pa.int64() if g_type == "bigint" else pa.int32() if g_type == "int" else pa.string()), "id": pa.array(np.array(row["ids"])[i], pa.int64()), "cluster": pa.array(c.astype(np.int32)), "p": np.round(r[i, c], 6)})

    found = _with_models(blocks, chosen).mapInArrow(members, f"g {g_type}, id long, cluster int, p double")
    return found.unionByName(few).withColumnRenamed("g", group)
