"""Hybrid retrieval from the full-text and vector indexes: what search.hybrid finds by scanning the chunks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.operators import search
from lodestar.operators.textindex import TextIndex
from lodestar.operators.vectorindex import VectorIndex


def hybrid(texts: TextIndex, vectors: VectorIndex, chunks: DataFrame, query: Sequence[float], text: str, n: int = 40, threshold: float = 0.25, k: int = 60, vector: float = 0.7, words: float = 0.3, tenant=None, scopes: Sequence[str] = ()) -> DataFrame:
    """(id, score, similarity) as search.hybrid has them.

    Each channel's n best rows come from its index; what may be found is told by the chunks' tenant and scope columns, so
    contents are read only where the query names an identifier, whose literal matches no index of words holds.
    """
    text = text.strip()
    w = search.channel_weights(text, vector, words)
    narrow = tenant is not None or bool(scopes)
    mine = lambda rows: search.scoped(rows, tenant, scopes)
    allowed = mine(chunks).select("id") if narrow else None
    lists = [("vector", w["vector"], vectors.hits(query, n, threshold, where=mine if narrow else None).select("id", F.col("similarity").alias("value")))]
    if text:
        for name, stemmed in (("text", True), ("exact", False)):
            lists.append((name, w[name], texts.hits(text, n, stemmed, allowed).select("id", F.col("text_rank").alias("value"))))
        if search.IDENTIFIER.search(text):
            lists.append(("literal", w["literal"], search.literal_hits(mine(chunks), text, n).select("id", F.col("text_rank").alias("value"))))
    rows = reduce(lambda a, b: a.unionByName(b), (d.withColumn("__c", F.lit(name)) for name, _, d in lists))
    value = lambda name: F.max(F.when(F.col("__c") == name, F.col("value")))
    rows = rows.groupBy("id").agg(*(value(name).alias(name) for name, _, _ in lists))
    fused = search.fused_channels(rows, [(name, weight, F.col(name)) for name, weight, _ in lists], n, k)
    return search.top(fused.select("id", "score", "similarity"), n, F.desc("score"), F.desc("similarity"), F.col("id"))
