"""Points in intervals by equi-joins: an interval is a few cells of a binary hierarchy, a point lies in one cell a level."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar import storage

#: Cells that are sent to all tasks at most, and the greatest long.
SENT, MOST = 100_000, (1 << 63) - 1


def _cells(start: Column, end: Column) -> Column:
    """The largest cells (level, cell) that make up [start, end): two a level at most, none twice."""

    def at(level):
        # rounded up and down by shifts, which are exact for any long
        lo = -F.call_function("shiftright", -start, level)
        hi = F.call_function("shiftright", end, level)
        odd = lambda x: F.pmod(x, F.lit(2)) == 1
        left = F.when((lo < hi) & odd(lo), F.struct(level.alias("level"), lo.alias("cell")))
        right = F.when((lo < hi) & odd(hi), F.struct(level.alias("level"), (hi - 1).alias("cell")))
        return F.array(left, right)

    levels = F.sequence(F.lit(0), F.floor(F.log2((end - start).cast("double"))).cast("int") + 1)
    return F.array_distinct(F.filter(F.flatten(F.transform(levels, at)), lambda c: c.isNotNull()))


def enclosing(points: DataFrame, intervals: DataFrame, keys: Sequence[str], at: str = "at", start: str = "start", end: str = "end") -> DataFrame:
    """points and intervals of equal keys joined where start <= at < end; each pair comes once, nested intervals all.

    Intervals are cut to the points' range first; those outside it go. Points are copied once for each level that intervals
    have, intervals into at most two cells a level, so rows grow with the logarithm of lengths and every match is a key's.
    Up to SENT cells are sent to all tasks, more are shuffled and sorted. Null bounds and empty intervals hold nothing.
    Positions are longs; columns other than the keys must not clash.
    """
    low, high = points.agg(F.min(F.col(at).cast("long")), F.max(F.col(at).cast("long"))).head()
    if low is None:
        return points.join(intervals.where("false"), list(keys))
    s, e = F.greatest(F.col(start).cast("long"), F.lit(low)), F.least(F.col(end).cast("long"), F.lit(min(high, MOST - 1) + 1))
    some = intervals.where(F.col(start).isNotNull() & F.col(end).isNotNull() & (s < e))
    cells = some.withColumn("__c", F.explode(_cells(s, e))).select("*", F.col("__c.level").alias("__level"), F.col("__c.cell").alias("__cell")).drop("__c")
    # a planner takes cells for as few as their intervals: they are counted, not guessed
    cells = storage.kept(cells, "cells")
    found = cells.groupBy("__level").agg(F.count("*").alias("n")).collect()  # 64 numbers at most
    levels = sorted(r["__level"] for r in found)
    if not levels:
        return points.join(intervals.where("false"), list(keys))
    p = points.where(F.col(at).isNotNull()).withColumn("__level", F.explode(F.array(*map(F.lit, levels))))
    p = p.withColumn("__cell", F.call_function("shiftright", F.col(at).cast("long"), F.col("__level")))
    cells = F.broadcast(cells) if sum(r["n"] for r in found) <= SENT else cells.hint("merge")
    return p.join(cells, [*keys, "__level", "__cell"]).drop("__level", "__cell")
