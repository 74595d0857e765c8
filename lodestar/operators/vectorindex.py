"""An exact vector index: cells around learned centres, pruned by the triangle inequality on the unit sphere.

Angles obey the triangle inequality: a row whose angle to its cell's centre is a, lies at least |angle(query, centre) - a|
from a query. Cells are visited best first; once n rows are found, only cells, and within them only rows, whose bound
reaches the last one are read. Results are those of a scan, whatever the centres.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar import storage
from lodestar.functions.vector import norm, similarity
from lodestar.operators.search import top

#: Rows that centres are learned from at most, and rounds of that.
SAMPLE, ROUNDS = 20_000, 10
#: Similarities are rounded to six decimals: a bound this much nearer can't lose a row.
SLOP = 2e-6
#: Components of all centres and of a sample at most, 32 MB of doubles.
COMPONENTS = 1 << 22


def learned_centres(rows: DataFrame, cells: int, sample: int = SAMPLE, seed: int = 7) -> np.ndarray:
    """Unit centres of `cells` cells by spherical k-means on at most `sample` rows of smallest hash of the id."""
    sound = rows.where((F.size("embedding") > 0) & (norm(F.col("embedding")) > 0)).select("id", "embedding")
    width = sound.select(F.max(F.size("embedding"))).head()[0] or 1
    few = sound.where(F.size("embedding") == width).orderBy(F.xxhash64("id"), "id").limit(min(sample, COMPONENTS // width)).select("embedding").toArrow()
    x = np.array(few.column(0).to_pylist(), float).reshape(-1, width)
    if not len(x):
        return np.ones((1, 1))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c = x[np.random.default_rng(seed).choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(ROUNDS):
        own = (x @ c.T).argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        length = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(length > 1e-9, total / np.maximum(length, 1e-9), c)
    return c


def _placed(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """Rows with their cell and their angle to its centre; rows that can't be compared get cell -1."""
    import pyarrow as pa

    schema = T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("angle", T.DoubleType())])
    width = centres.shape[1]

    def run(batches):
        for batch in batches:
            cell, angle = np.full(batch.num_rows, -1, np.int32), np.zeros(batch.num_rows)
            vectors = batch.column("embedding")
            for lo in range(0, batch.num_rows, 4096):
                part = vectors.slice(lo, 4096).to_pylist()
                at = [k for k, v in enumerate(part) if v is not None and len(v) == width and all(y is not None for y in v)]
                x = np.array([part[k] for k in at], float).reshape(-1, width)
                length = np.linalg.norm(x, axis=1) if len(x) else np.zeros(0)
                ok = (length > 0) & np.isfinite(length)
                at, x = np.array(at, int)[ok], x[ok] / length[ok, None]
                if not len(x):
                    continue
                s = x @ centres.T
                cell[lo + at] = s.argmax(axis=1)
                angle[lo + at] = np.arccos(np.clip(s.max(axis=1), -1, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(angle)], [*batch.schema.names, "cell", "angle"])

    return rows.mapInArrow(run, schema)


def _store(rows: DataFrame, path: str, touched: list[int]) -> None:
    placed = rows.repartitionByRange("cell", "angle").sortWithinPartitions("cell", "angle")
    storage.replace_folders(placed, f"{path}/rows", "cell", touched)
    spark = rows.sparkSession
    facts = spark.read.parquet(f"{path}/rows").groupBy("cell").agg(F.count("*").alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high"))
    storage.kept(facts.coalesce(1), "cells").write.mode("overwrite").parquet(f"{path}/cells")


def write_vector_index(rows: DataFrame, path: str, cells: int = 256, sample: int = SAMPLE) -> None:
    """Write the index of rows(id, embedding, ...); other columns are kept with the rows and can be filtered on."""
    spark = rows.sparkSession
    centres = learned_centres(rows, cells, sample)
    table = [(k, [float(y) for y in c]) for k, c in enumerate(centres)]
    spark.createDataFrame(table, "cell int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")
    _store(_placed(rows, centres), path, [])


class VectorIndex:
    """Reads an index. share: the part of the cells' rows whose cell the last search read; visited: (cells read, cells)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.reload()

    def reload(self) -> None:
        centres = sorted((r.cell, r.centre) for r in self.spark.read.parquet(f"{self.path}/centres").collect())
        self.centres = np.array([c for _, c in centres])
        # one row a cell, as many as were learned
        self.cells = {r.cell: (r.n, r.low, r.high) for r in self.spark.read.parquet(f"{self.path}/cells").collect()}
        self.rows = self.spark.read.parquet(f"{self.path}/rows")
        self.visited, self.share = (0, len(self.cells)), 0.0

    def _bounds(self, query: Sequence[float]) -> list[tuple[float, int, float]]:
        """(greatest similarity a row can have, cell, angle of the query to the centre), best first."""
        q = np.array(query, float)
        if len(q) != self.centres.shape[1] or not np.linalg.norm(q) > 0:
            return []
        to = np.arccos(np.clip(self.centres @ (q / np.linalg.norm(q)), -1, 1))
        out = []
        for cell, (_, low, high) in self.cells.items():
            if cell >= 0:
                least = max(0.0, low - to[cell], to[cell] - high)
                out.append((math.cos(least), cell, float(to[cell])))
        return sorted(out, reverse=True)

    def _in(self, some: list[tuple[float, int, float]], reach: float) -> Column:
        """Rows of some cells that can be as near as an angle."""
        ok = F.lit(False)
        for _, cell, to in some:
            ok = ok | ((F.col("cell") == cell) & F.col("angle").between(to - reach, to + reach))
        return F.col("cell").isin([c for _, c, _ in some]) & ok

    def hits(self, query: Sequence[float], n: int = 40, threshold: float = 0.25, inclusive: bool = False, where: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        """What search.vector_hits finds: rows with similarity above the threshold, the n best, ties to smaller ids.

        where: takes the rows that may be found, by their own columns (a tenant, a scope). Cells are read in batches that grow fourfold;
        the n-th similarity found so far, or the threshold, bounds what is read next.
        """
        n = max(1, int(n))
        order = [b for b in self._bounds(query) if b[0] >= threshold - SLOP]
        s = F.col("similarity")
        fits = s >= threshold if inclusive else s > threshold
        rows = self.rows if where is None else where(self.rows)
        found = rows.limit(0).withColumn("similarity", F.lit(0.0))
        floor, at, size, read = threshold, 0, 2, []
        while at < len(order) and order[at][0] >= floor - SLOP:
            batch = [b for b in order[at : at + size] if b[0] >= floor - SLOP]
            reach = math.acos(max(-1.0, min(1.0, floor - SLOP))) + 1e-7
            near = rows.where(self._in(batch, reach)).withColumn("similarity", similarity(F.col("embedding"), query)).where(fits)
            found = storage.kept(top(found.unionByName(near), n, F.desc("similarity"), F.col("id")), "near")
            read += batch
            at, size = at + size, size * 4
            worst = found.agg(F.count("*").alias("n"), F.min("similarity").alias("s")).head()
            if worst["n"] == n:
                floor = max(floor, worst["s"])
        self.visited = len(read), len(self.cells)
        total = sum(c[0] for c in self.cells.values())
        self.share = sum(self.cells[c][0] for _, c, _ in read) / total if total else 0.0
        return found.drop("cell", "angle").orderBy(F.desc("similarity"), "id")

    def replace(self, rows: DataFrame, gone: Column) -> None:
        """Rows that `gone` tells of go, new rows come: only their cells are written again. The centres stay."""
        fresh = storage.kept(_placed(rows, self.centres), "fresh")
        old = [r.cell for r in self.rows.where(gone).select("cell").distinct().collect()]
        touched = sorted({*old, *(r.cell for r in fresh.select("cell").distinct().collect())})
        stay = self.rows.where(F.col("cell").isin(touched) & ~F.coalesce(gone, F.lit(False)))
        _store(storage.kept(stay.unionByName(fresh, allowMissingColumns=True), "cells"), self.path, touched)
        self.reload()
