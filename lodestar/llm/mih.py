"""Approximate nearest neighbours by multi-index hashing over learned rotated binary codes.

Vectors are centred, rotated by iterative quantisation and cut to signs; several rotations give a code of
BITS bits. Codes are split into substrings of SUBSTRING bits, each with an index of its own. Every code within
a Hamming radius r of a query's agrees with it to within floor(r / m), or a bit less in later substrings, in
some substring (pigeonhole); probing those index entries retrieves all of them, and many beyond. What is
retrieved and within a second, wider radius of the whole code is reranked in double precision. Both radii are
learned on the fit's sample: the narrowest probes that reach the wished recall.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.llm.common import map_arrow, stream_arrow, written

#: Rows of smallest hash that rotations and radii are learned from: the documented bound of the fit.
SAMPLE = 8192
BITS, SUBSTRING = 1024, 16
ITERATIONS = 25
#: Recall on the sample that probing and the whole code's radius are learned for.
RECALL, WITHIN = 0.94, 0.995
#: Vectors of an index block, queries of a probe block; a block is one row.
BLOCK, PROBES = 32768, 1024


class Codes:
    """Learned rotations, the radius that probing guarantees, and the whole code's radius."""

    def __init__(self, x: np.ndarray, k: int, bits: int = BITS, recall: float = RECALL, seed: int = 7):
        self.dim = x.shape[1]
        self.center = x.mean(axis=0) if len(x) else np.zeros(self.dim)
        rng = np.random.Generator(np.random.PCG64(seed))
        y = self._unit(x)
        parts = []
        while sum(p.shape[1] for p in parts) < bits:
            r, _ = np.linalg.qr(rng.standard_normal((self.dim, self.dim)))
            for _ in range(ITERATIONS if len(y) >= self.dim else 0):
                u, _, vt = np.linalg.svd(y.T @ np.where(y @ r >= 0, 1.0, -1.0))
                r = u @ vt
            parts.append(r)
        self.rotation = np.concatenate(parts, 1)[:, :bits]
        self.bits = bits
        self.m = bits // SUBSTRING
        self.radius, self.within = self._learned(x, k, recall)

    def _unit(self, x):
        return x - self.center

    def code(self, x: np.ndarray) -> np.ndarray:
        """Rows of bits / 8 bytes."""
        out = [np.packbits(self._unit(x[lo : lo + 4096]) @ self.rotation >= 0, axis=1) for lo in range(0, len(x), 4096)]
        return np.concatenate(out) if out else np.zeros((0, self.bits // 8), np.uint8)

    def _learned(self, x, k, recall) -> tuple[int, int]:
        """(radius of the probes, radius of the whole code) on the sample's own neighbours."""
        if len(x) < 2:
            return self.bits, self.bits
        q = x[: min(512, len(x))]
        c = self.code(x)
        score = q @ x.T
        score[np.arange(len(q)), np.arange(len(q))] = -np.inf
        n = min(k, len(x) - 1)
        near = np.argpartition(-score, n - 1, axis=1)[:, :n]
        apart = substrings(c)[: len(q), None, :] ^ substrings(c)[near]
        apart = np.bitwise_count(apart).astype(np.int64)  # by substring
        # the least radius whose probes reach a neighbour: m * distance + place of the best substring
        reach = (apart * self.m + np.arange(self.m)).min(axis=2)
        probes = int(np.quantile(reach, recall, method="higher"))
        return probes, int(np.quantile(apart.sum(axis=2), WITHIN, method="higher"))


def substrings(codes: np.ndarray) -> np.ndarray:
    """Codes as rows of 16-bit numbers."""
    return np.ascontiguousarray(codes).view(np.uint16)


def substring_radii(radius: int, m: int) -> list[int]:
    """The Hamming radius to probe in each substring; -1: none. A code within radius is within one of them.

    With radius = m * s + a, at distance s in each of the first a + 1 substrings and s - 1 in the others a
    code that is missed everywhere would be (a + 1) * (s + 1) + (m - a - 1) * s > radius bits away.
    """
    s, a = divmod(radius, m)
    return [s if k <= a else s - 1 for k in range(m)]


def _masks(r: int) -> np.ndarray:
    """All differences of at most r bits of a substring."""
    every = np.arange(1 << SUBSTRING, dtype=np.uint32)
    return every[np.bitwise_count(every) <= r]


class Index:
    """The codes of a block, with an inverted index for each substring."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        sub = substrings(codes)
        n, m = sub.shape
        self.order = np.empty((m, n), np.int32)
        self.start = np.zeros((m, (1 << SUBSTRING) + 1), np.int32)
        for j in range(m):
            self.order[j] = np.argsort(sub[:, j], kind="stable")
            self.start[j, 1:] = np.cumsum(np.bincount(sub[:, j], minlength=1 << SUBSTRING))
        self.wide = np.ascontiguousarray(codes).view(np.uint64)
        self.probes: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _plan(self, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(substring, difference) of each probe."""
        if radius not in self.probes:
            m = len(self.order)
            radii = substring_radii(radius, m)
            masks = {r: _masks(r) for r in set(radii) if r >= 0}
            parts = [(np.full(len(masks[r]), j), masks[r]) for j, r in enumerate(radii) if r >= 0]
            self.probes[radius] = np.concatenate([a for a, _ in parts]), np.concatenate([b for _, b in parts])
        return self.probes[radius]

    def probed(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows that share a probed entry with the code: all within the radius, and others."""
        at, mask = self._plan(radius)
        keys = substrings(code[None])[0][at] ^ mask
        lo, hi = self.start[at, keys], self.start[at, keys + 1]
        some = np.flatnonzero(hi > lo)
        lo, size = lo[some].astype(np.int64), (hi - lo)[some].astype(np.int64)
        n = self.order.shape[1]
        flat = np.arange(int(size.sum())) + np.repeat(lo + at[some] * n - np.concatenate(([0], np.cumsum(size)[:-1])), size)
        hit = np.zeros(n, bool)
        hit[self.order.ravel()[flat]] = True
        return np.flatnonzero(hit)

    def within(self, code: np.ndarray, radius: int, most: int) -> np.ndarray:
        """Probed rows within most bits of the whole code."""
        rows = self.probed(code, radius)
        return rows[np.bitwise_count(self.wide[rows] ^ np.ascontiguousarray(code).view(np.uint64)).sum(axis=1, dtype=np.int64) <= most]


def sound_vectors(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v array<double>) of vectors that aren't null, empty, zero or with a null or non-finite component."""
    v = F.col("v")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & fine & F.exists(v, lambda x: x != 0))


def nearest(rows: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", sample: int = SAMPLE, bits: int = BITS, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): the k vectors of largest inner product found for each query.

    Queries are the rows whose id is divisible by every; a row isn't its own candidate. Equal vectors are
    searched once; of each only the k + 1 smallest ids can be answers. Ties go to the smaller id. A query that
    finds fewer than k + 1 different vectors is asked again over all codes, so none comes short. Rows with a
    null id or an unsound vector take no part, nor do vectors of another length than the commonest (of equally
    common ones the shortest); rows that repeat an id come as separate candidates only if their vectors differ.
    Other columns are ignored.
    """
    spark = rows.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    v = sound_vectors(rows, id_col, vec_col)
    length = v.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").head()
    if length is None:
        return spark.createDataFrame([], schema)
    dim = length["dim"]
    v = v.where(F.size("v") == dim)
    took = v.select("v").orderBy(F.xxhash64("v"), "v").limit(sample).toArrow().column("v").to_pylist()
    fit = Codes(np.array(list(dict.fromkeys(map(tuple, took)))), k, bits, recall)
    held = spark.sparkContext.broadcast(fit)

    def packed(batch):
        x = np.array(batch.column("v").to_pylist(), np.float64).reshape(-1, dim)
        return pa.RecordBatch.from_arrays([batch.column("id"), pa.array([r.tobytes() for r in x], pa.binary())], ["id", "x"])

    ids = map_arrow(v, packed, "id long, x binary").distinct()
    w = Window.partitionBy("x").orderBy("id")
    ids = written(ids.withColumn("c", F.xxhash64("x")), "vectors")
    # the ids of a class that can be answers, and one row for each class
    answers = written(ids.withColumn("j", F.row_number().over(w)).where(F.col("j") <= k + 1), "answers")
    base = answers.where("j = 1")
    count = base.count()
    blocks = max(1, -(-count // BLOCK))
    base = base.withColumn("block", F.pmod("c", F.lit(blocks)).cast("int"))
    ask = written(ids.where(F.col("id") % every == 0).groupBy("x").agg(F.min("id").alias("q")), "ask")

    def block_rows(table, names):
        return pa.table({names[0]: table.column(0).slice(0, 1), names[1]: pa.array([table.column(1).to_numpy().astype("<i8").tobytes()], pa.binary()), names[2]: pa.array([b"".join(table.column(2).to_pylist())], pa.binary())})

    vb = base.select("block", "id", "x").groupBy("block").applyInArrow(lambda t: block_rows(t, ("block", "ids", "xs")), "block int, ids binary, xs binary")

    def found(asking: DataFrame, probing: bool) -> DataFrame:
        """(q, id, score): each asking vector's k + 1 best of what its probes retrieve, or of all codes, by block."""
        probes = max(1, -(-asking.count() // PROBES))
        qb = asking.withColumn("probe", F.pmod(F.xxhash64("q"), F.lit(probes)).cast("int"))
        qb = qb.select("probe", "q", "x").groupBy("probe").applyInArrow(lambda t: block_rows(t, ("probe", "qs", "qx")), "probe int, qs binary, qx binary")
        qb = qb.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

        def searched(batches):
            fit = held.value
            last = None
            for b in batches:
                for qs, qx, block, vi, vx in zip(*(b.column(n) for n in ("qs", "qx", "block", "ids", "xs"))):
                    if last is None or last[0] != block.as_py():
                        last = None  # before the next is built
                        x = np.frombuffer(vx.as_py(), np.float64).reshape(-1, dim)
                        last = block.as_py(), np.frombuffer(vi.as_py(), np.int64), x, Index(fit.code(x)) if probing else None
                    _, own, x, index = last
                    q, qv = np.frombuffer(qs.as_py(), np.int64), np.frombuffer(qx.as_py(), np.float64).reshape(-1, dim)
                    codes = fit.code(qv)
                    out = []
                    for i in range(len(q)):
                        near = index.within(codes[i], fit.radius, fit.within) if probing else np.arange(len(own))
                        score = x[near] @ qv[i]
                        if len(near) > 2 * k + 2:  # the block's own k + 1 best classes, with all ties of the last
                            low = np.partition(score, len(score) - k - 1)[len(score) - k - 1]
                            keep = score >= low
                            near, score = near[keep], score[keep]
                            if len(near) > 2 * k + 2:
                                o = np.lexsort((own[near], -score))[: k + 1]
                                near, score = near[o], score[o]
                        out.append((np.full(len(near), q[i]), own[near], score))
                    a, c, s = (np.concatenate(z) for z in zip(*out))
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(c), pa.array(s)], ["q", "id", "score"])

        pairs = qb.join(vb, "block").select("qs", "qx", "block", "ids", "xs").sortWithinPartitions("block")
        pairs = stream_arrow(pairs, searched, "q long, id long, score double")
        r = pairs.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.col("id"))))
        return written(r.where(F.col("r") <= k + 1), "best")

    best = found(ask, True)
    full = best.groupBy("q").count().where(F.col("count") >= min(k + 1, count)).select("q")
    short = written(ask.join(full, "q", "left_anti"), "short")
    if not short.isEmpty():
        best = best.join(full, "q", "left_semi").unionByName(found(short, False))
    # classes to ids, at most (k + 1) * (k + 1) for a class of queries
    near = best.select("q", F.col("id").alias("rep"), "score")
    first = base.select(F.col("id").alias("rep"), "x")
    named = near.join(first, "rep").join(answers.select("x", F.col("id").alias("vec_id")), "x").select("q", "vec_id", "score")
    top = named.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).where(F.col("r") <= k + 1)
    lists = top.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("r", "vec_id", "score"))).alias("found"))
    asked = ids.where(F.col("id") % every == 0).select(F.col("id").alias("query_id"), "x").join(ask.select("x", "q"), "x").select("query_id", "q").distinct()
    own = asked.join(lists, "q").select("query_id", F.slice(F.filter("found", lambda z: z["vec_id"] != F.col("query_id")), 1, k).alias("found"))
    return own.select("query_id", F.posexplode("found").alias("p", "z")).select("query_id", (F.col("p") + 1).alias("rank"), F.col("z.vec_id").alias("vec_id"), F.col("z.score").alias("score"))
