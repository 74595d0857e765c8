"""A stated set of queries against all rows, multiplied block by block.

Rows and queries of one dimension are packed into blocks of bounded bytes. Every block of queries meets every block of
rows once, by block number; a meeting is a product of matrices that keeps each query's best rows. A row's similarity to a
block of queries is at most what the angles to the block's mean allow, so most rows of far blocks are never multiplied.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar import storage

#: Bytes of a block of rows and of queries, and similarities that are computed together unless a query has more.
ROW_BYTES, QUERY_BYTES, PRODUCT = 8 << 20, 1 << 20, 1 << 20
#: Similarities are rounded to six decimals afterwards; what rounding could lift stays.
SLOP = 1e-6


def _packed(df: DataFrame, id_col: str, vec_col: str, most: int, name: str) -> DataFrame:
    """(w, block, ids, x): vectors of dimension w end to end, those without null parts or of length 0 left out."""
    v = df.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("x"))
    # nulls compare as unknown, NaN and infinity have no finite square sum
    squares = F.aggregate("x", F.lit(0.0), lambda s, y: s + y * y)
    v = v.where((F.size("x") > 0) & ~F.exists("x", lambda y: y.isNull()) & (squares > 0) & (squares < float("inf"))).withColumn("w", F.size("x"))
    v = storage.kept(v, name)
    counts = v.groupBy("w").agg(F.count("*").alias("n"))
    # filled to three quarters on average, so that hashing's unevenness stays near the bound
    parts = F.ceil(F.col("n") * F.col("w") * 8 / (0.75 * most)).cast("long")
    placed = v.join(F.broadcast(counts), "w").withColumn("block", F.pmod(F.xxhash64("id"), parts))
    return placed.groupBy("w", "block").agg(F.collect_list("id").alias("ids"), F.flatten(F.collect_list("x")).alias("x"))


def best_pairs(x: np.ndarray, q: np.ndarray, n: int, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, row, similarity) of unit vectors: each query's n best rows above the threshold and those as near as the last,
    some queries at a time, so that a product of small vectors takes no more memory than one of large ones."""
    centre = q.sum(axis=0)
    length = np.linalg.norm(centre)
    if length > 0:  # rows that no query of the block can be near enough to
        wide = np.arccos(np.clip((q @ (centre / length)).min(), -1, 1))
        to = np.arccos(np.clip(x @ (centre / length), -1, 1))
        near = np.flatnonzero(np.cos(np.maximum(0.0, to - wide)) >= threshold - SLOP)
    else:
        near = np.arange(len(x))
    if not len(near):
        return
    rows = x if len(near) == len(x) else x[near]
    step = max(1, PRODUCT // len(near))
    for lo in range(0, len(q), step):
        s = q[lo : lo + step] @ rows.T
        if s.shape[1] > n:
            least = np.partition(s, s.shape[1] - n, axis=1)[:, -n][:, None] - SLOP
        else:
            least = np.full((len(s), 1), -2.0)
        a, b = np.nonzero((s >= least) & (s >= threshold - SLOP))
        if len(a):
            yield lo + a, near[b], s[a, b]


def block_topk(rows: DataFrame, queries: DataFrame, n: int, threshold: float) -> DataFrame:
    """(query_id, id, similarity) with each query's n most similar rows above the threshold, and those as near as the last
    of them in a block. rows: (id, embedding), queries: (query_id, query). Ties are for the caller to break."""
    schema = T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField("id", rows.schema["id"].dataType), T.StructField("similarity", T.DoubleType())])
    r = storage.kept(_packed(rows, "id", "embedding", ROW_BYTES, "rows"), "row_blocks")
    q = storage.kept(_packed(queries, "query_id", "query", QUERY_BYTES, "queries"), "query_blocks")
    blocks = r.groupBy("w").agg(F.max("block").alias("last"))
    sent = q.select("w", F.col("ids").alias("q_ids"), F.col("x").alias("q")).join(F.broadcast(blocks), "w").select("w", "q_ids", "q", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("block"))
    # a merge holds one key's rows of its right side: one block of rows, not all queries
    pairs = sent.join(r.hint("merge"), ["w", "block"]).select("ids", "x", "q_ids", "q")

    def unit(flat: pa.ListScalar, count: int) -> np.ndarray:
        x = flat.values.to_numpy(zero_copy_only=False).reshape(count, -1)
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                ids, q_ids = batch.column("ids")[k].values, batch.column("q_ids")[k].values
                x, q = unit(batch.column("x")[k], len(ids)), unit(batch.column("q")[k], len(q_ids))
                for a, b, similar in best_pairs(x, q, n, threshold):
                    yield pa.RecordBatch.from_arrays([q_ids.take(pa.array(a)), ids.take(pa.array(b)), pa.array(similar)], ["query_id", "id", "similarity"])

    return pairs.mapInArrow(run, schema).withColumn("similarity", F.round("similarity", 6))
