"""Mixing sources to target weights by entropy balancing.

Every document starts with rate 1. Of all rates up to the limit that meet each source's token target, those
nearest to 1 in relative entropy are exponentially tilted: rate = min(limit, exp(lambda_source * size / scale)).
lambda minimises the convex dual; Newton steps for all sources run together, each one aggregation over the
(source, size) histogram. Rates become copies from large sizes to small, each size making up for the rounding
of those before, so a source's words miss their target by about a small document.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.llm.common import written

#: Relative miss of a source's target at which Newton's iteration ends, and steps at most.
TOLERANCE, STEPS = 1e-9, 80
#: Bytes up to which a table is broadcast. Beyond, the join shuffles, each key in SALTS parts. The plan changes, not the result.
BROADCAST_BYTES, SALTS = 16 << 20, 32
#: Documents of one source and size that one task ranks.
RANKED = 512


def ranked_sources(sizes: DataFrame) -> DataFrame:
    """sizes with a rank from 0 by source's code points, null last, without gathering rows in one task."""
    spark = sizes.sparkSession
    order = [F.col("source").isNull().cast("int"), F.encode(F.coalesce("source", F.lit("")), "UTF-8")]
    placed = written(sizes.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "sources")
    counts = {r["part"]: r["count"] for r in placed.groupBy("part").count().collect()}
    before, offsets = 0, []
    for p in sorted(counts):
        offsets.append((p, before))
        before += counts[p]
    base = spark.createDataFrame(offsets, "part int, before long")
    w = Window.partitionBy("part").orderBy(*order)
    return placed.join(F.broadcast(base), "part").withColumn("rank", F.row_number().over(w) - 1 + F.col("before")).drop("part", "before")


def token_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, limit: float = 2.0) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources take the weights in turn by rank and share that part of all words; no target is above limit
    times its source's size: what is above is shared again by weight among the others until none is.
    """
    w = F.array(*(F.lit(float(x)) for x in weights))
    held = written(ranked_sources(sizes).withColumn("weight", F.element_at(w, (F.pmod("rank", F.lit(len(weights))) + 1).cast("int"))).withColumn("most", F.lit(limit) * F.col("source_size")), "weighted")
    pool = share * float(held.agg(F.sum("source_size")).head()[0] or 0)
    level = 0.0  # words for a weight of 1; capped sources have most <= level * weight
    while True:
        at = F.col("most") <= F.lit(level) * F.col("weight")
        r = held.agg(F.sum(F.when(at, F.col("most"))).alias("full"), F.sum(F.when(~at, F.col("weight"))).alias("open")).head()
        if not r["open"]:
            break
        after = (pool - (r["full"] or 0.0)) / r["open"]
        if after <= level * (1 + 1e-12):
            break
        level = after
    return held.select("source", "source_size", F.least("most", F.lit(level) * F.col("weight")).alias("target"))


def tilted_rates(hist: DataFrame, targets: DataFrame, limit: float = 2.0) -> DataFrame:
    """(source, size, n, rate) from the histogram (source, size, n): the entropy-balanced rate of each size.

    The dual's gradient for a source is sum(n * size * rate) - target, increasing in lambda, so Newton is
    kept within a shrinking bracket. Sources without words, or whose target is the limit, need no steps.
    """
    h = written(hist, "histogram")
    wide = lambda c: c.cast("decimal(38,0)")
    scale = h.groupBy("source").agg((F.sum(wide(wide(F.col("n")) * F.col("size") * F.col("size"))).cast("double") / F.greatest(F.sum(F.col("n") * F.col("size")), F.lit(1))).alias("scale"))
    scale = scale.withColumnRenamed("source", "s")
    state = targets.select("source", "target", "source_size").join(scale, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    state = state.withColumn("x", F.log(F.least(F.lit(limit), F.greatest(F.col("target") / F.greatest("source_size", F.lit(1)), F.lit(1e-12))))).withColumn("lo", F.lit(-1e9)).withColumn("hi", F.lit(1e9))
    state = state.withColumn("ended", (F.col("source_size") <= 0) | (F.col("target") >= F.lit(limit) * F.col("source_size")))
    state = state.withColumn("x", F.when(F.col("source_size") <= 0, 0.0).when(F.col("ended"), 1e9).otherwise(F.col("x")))
    state = written(state, "dual")
    z = F.col("size") / F.greatest("scale", F.lit(1e-9))
    tilt = F.when(F.col("x") * z >= F.log(F.lit(limit)), F.lit(limit)).otherwise(F.exp(F.col("x") * z))
    few = _small(state, "source")
    for _ in range(STEPS):
        live = state.where("not ended")
        if live.isEmpty():
            break
        j = h.withColumnRenamed("source", "s").join(F.broadcast(live) if few else live, F.col("s").eqNullSafe(F.col("source")))
        rate = tilt
        mass = F.col("n") * F.col("size")
        # sums of decimals are the same in any order, so every run takes the same steps
        exact = lambda c: F.sum(c.cast("decimal(38,12)")).cast("double")
        g = j.groupBy("source").agg(exact(mass * rate).alias("got"), exact(F.when(rate < limit, mass * z * rate).otherwise(0.0)).alias("slope"))
        j2 = state.join(g.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
        miss = F.col("got") - F.col("target")
        lo = F.when(miss < 0, F.col("x")).otherwise(F.col("lo"))
        hi = F.when(miss > 0, F.col("x")).otherwise(F.col("hi"))
        step = F.col("x") - miss / F.greatest("slope", F.lit(1e-300))
        mid = F.when(lo <= -1e9, F.col("x") - F.abs("x") - 1).when(hi >= 1e9, F.col("x") + F.abs("x") + 1).otherwise((lo + hi) / 2)
        good = (step > lo) & (step < hi) & (F.col("slope") > 0)
        done = F.col("got").isNotNull() & (F.abs(miss) <= F.lit(TOLERANCE) * F.col("target") + 1e-9)
        state = written(j2.select("source", "target", "source_size", "scale", F.when(F.col("ended") | done, F.col("x")).when(good, step).otherwise(mid).alias("x"), F.when(F.col("ended"), F.col("lo")).otherwise(lo).alias("lo"), F.when(F.col("ended"), F.col("hi")).otherwise(hi).alias("hi"), (F.col("ended") | done).alias("ended")), "dual")
    s = state.withColumnRenamed("source", "s")
    return h.join(s, F.col("source").eqNullSafe(F.col("s"))).select("source", "size", "n", F.round(tilt, 9).alias("rate"))


def _small(df: DataFrame, *texts: str) -> bool:
    """Whether a table may be broadcast: at most BROADCAST_BYTES, by the lengths of its texts and 80 bytes a row."""
    each = sum((F.coalesce(F.octet_length(t), F.lit(0)) for t in texts), F.lit(80)).cast("long")
    return (df.agg(F.sum(each)).head()[0] or 0) <= BROADCAST_BYTES


def _quotas(table: pa.Table, limit: int) -> pa.Table:
    """Copies of a source's sizes, a row for each different size: from large to small, each size takes what
    brings the words taken so far nearest to the words its rates stand for, so only the smallest sizes'
    rounding remains."""
    table = table.sort_by([("size", "descending")])
    quota, owed = [], 0.0
    for size, n, rate in zip(*(table.column(c).to_pylist() for c in ("size", "n", "rate"))):
        owed += size * n * rate
        q = min(n * limit, max(0, round(owed / size))) if size else 0
        owed -= q * size
        quota.append(q)
    cols = [table.column("source"), table.column("size"), table.column("n"), table.column("rate"), pa.array(quota, pa.int64()), table.column("source_size"), table.column("target")]
    return pa.table(cols, names=["hs", "hz", "n", "rate", "quota", "source_size", "target"])


def mix_documents(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, limit: int = 2, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_col: str | None = None) -> DataFrame:
    """(doc_id, source, size, source_size, target, rate, copies, taken) for every row, after row_col where it is given.

    size: words [^\\x20\\x09-\\x0D]+ of the text (null: 0). Null sources are a source of their own, last.
    A document comes 0 to limit times; one of size 0 is not taken. The same input gives the same copies:
    rounding follows (size, hash of id and text), not the rows' order; fully equal rows share their
    copies in any order. Other columns are ignored.
    """
    key = [F.col(row_col)] if row_col else []
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), F.coalesce(F.regexp_count(F.col(text_col), F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long").alias("size"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("tie"), *key)
    d = written(d, "sizes")
    hist = d.groupBy("source", "size").agg(F.count("*").alias("n"))
    targets = written(token_targets(d.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, float(limit)), "targets")
    rates = tilted_rates(hist, targets, float(limit))
    t = targets.withColumnRenamed("source", "ts")
    joined = rates.join(t, F.col("source").eqNullSafe(F.col("ts"))).select("source", "size", "n", "rate", "source_size", "target")
    rows = written(joined.groupBy("source").applyInArrow(lambda x: _quotas(x, limit), "hs string, hz long, n long, rate double, quota long, source_size long, target double"), "quotas")
    same = F.col("source").eqNullSafe(F.col("hs")) & (F.col("size") == F.col("hz"))
    if _small(rows, "hs"):
        j = d.join(F.broadcast(rows), same)
    else:
        salted = rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
        j = d.join(salted, same & (F.pmod(F.xxhash64("tie", "doc_id"), F.lit(SALTS)) == F.col("salt"))).drop("salt")
    j = j.withColumn("sub", F.pmod("tie", F.ceil(F.col("n") / RANKED)).cast("long"))
    # a document's place among those of its source and size, in two levels
    c = j.groupBy("source", "size", "sub").agg(F.count("*").alias("held"))
    c = c.withColumn("ahead", F.sum("held").over(Window.partitionBy("source", "size").orderBy("sub").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("held"))
    c = c.where("ahead > 0").select(F.col("source").alias("cs"), F.col("size").alias("cz"), F.col("sub").alias("cb"), "ahead")
    j = j.withColumn("k", F.row_number().over(Window.partitionBy("source", "size", "sub").orderBy("tie", "doc_id", *key)))
    j = j.join(c, F.col("source").eqNullSafe(F.col("cs")) & (F.col("size") == F.col("cz")) & (F.col("sub") == F.col("cb")), "left")
    place = F.col("k") + F.coalesce("ahead", F.lit(0))
    each = F.floor(F.col("quota") / F.col("n"))
    copies = (each + F.when(place <= F.col("quota") - each * F.col("n"), 1).otherwise(0)).cast("int")
    return j.select(*key, "doc_id", "source", "size", "source_size", "target", "rate", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))
