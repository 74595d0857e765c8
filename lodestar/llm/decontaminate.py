"""Benchmark decontamination: token windows of documents met with a broadcast set of the benchmark's windows.

DataFrame functions only. A text's words and windows stay in one whole-stage pipeline from the scan to the broadcast
hash join; only windows that are found, and verified word by word, are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import dropped, written

#: Words of a window; an item of fewer words is one window.
WIDTH = 10
#: Bytes of a broadcast set of windows (a window's words and 100 bytes besides). A larger benchmark goes in several.
SET_BYTES = 48 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# A word after lower-casing, and before it.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CASED_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text, A-Z in lower case; none of a null."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def text_key(text: Column) -> Column:
    """What equal texts share, and no others."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def _window(at: Column | str, m: Column | str) -> Column:
    return F.slice("__w", F.col(at) + 1, F.col(m))


def _hash(window: Column) -> Column:
    return F.xxhash64(window)


def benchmark_windows(items: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """Written tables of the benchmark's distinct windows (wid, m, h, gram) and of their items (wid, item_id)."""
    w = items.select("item_id", words(F.col("text")).alias("__w")).where("size(__w) > 0")
    w = w.select("item_id", "__w", F.least(F.size("__w"), F.lit(width)).alias("m"))
    w = w.select("item_id", "__w", "m", F.explode(F.sequence(F.lit(0), F.size("__w") - F.col("m"))).alias("at"))
    grams = written(w.select("item_id", "m", F.array_join(_window("at", "m"), " ").alias("gram"), _hash(_window("at", "m")).alias("h")).distinct(), "grams")
    sets = written(grams.select("m", "h", "gram").distinct().withColumn("wid", F.monotonically_increasing_id()), "windows")
    of = written(grams.where("item_id IS NOT NULL").join(sets, ["m", "h", "gram"]).select("wid", "item_id"), "items")
    dropped(grams)
    return sets, of


def _parts(sets: DataFrame, most: int) -> tuple[int, list[int]]:
    """How many parts (by hash) keep every set of windows within the bytes, and the lengths of windows."""
    cost = F.octet_length("gram") + 100
    total = sets.agg(F.sum(cost).alias("b"), F.collect_set("m").alias("m")).head()
    n = max(1, -(-(total.b or 0) // most))
    while n > 1:
        sizes = sets.groupBy(F.pmod("h", F.lit(n)).alias("p")).agg(F.sum(cost).alias("b"), F.count("*").alias("n"))
        if sizes.where((F.col("b") > most) & (F.col("n") > 1)).isEmpty() or n > 1 << 16:
            break
        n *= 2
    return n, sorted(total.m)


def window_hits(docs: DataFrame, sets: DataFrame, most: int = SET_BYTES) -> DataFrame:
    """(k, at, m, wid) of every place in docs(text) where a window stands, by the text's key; equal texts once."""
    n, lengths = _parts(sets, most)
    base = docs.select(text_key(F.col("text")).alias("k"), words(F.col("text")).alias("__w"))
    if not lengths:
        return base.select("k", F.lit(0).alias("at"), F.lit(0).alias("m"), F.lit(0).cast("long").alias("wid")).where("false")
    # no condition on the words alone: it would be pushed below and take the words out of the text again
    spots = base.select("k", "__w", F.explode(F.sequence(F.lit(0), F.greatest(F.size("__w") - min(lengths), F.lit(0)))).alias("at"))
    spots = spots.withColumn("m", F.lit(lengths[0]) if len(lengths) == 1 else F.explode(F.array(*map(F.lit, lengths))))
    spots = spots.where(F.col("at") + F.col("m") <= F.size("__w")).withColumn("h", _hash(_window("at", "m")))
    out = None
    for p in range(n):
        part = sets.where(F.pmod("h", F.lit(n)) == p) if n > 1 else sets
        part = F.broadcast(part.select(F.col("h").alias("__h"), "gram", "wid"))
        # a range of one value: as an equality the words would be a join key, put together at every place
        same = F.array_join(_window("at", "m"), " ").between(F.col("gram"), F.col("gram"))
        found = spots.join(part, (F.col("h") == F.col("__h")) & same).select("k", "at", "m", "wid")
        out = found if out is None else out.unionAll(found)
    return out


def contamination(docs: DataFrame, items: DataFrame, *, width: int = WIDTH, most: int = SET_BYTES) -> DataFrame:
    """(k, spans, n_hit, n_items, items_sha256) of each different text of docs(text) that holds a window of items(item_id, text).

    spans are the covered words, as disjoint (s, e). Items without an id cover words but aren't counted; rows of one id are
    one item.
    """
    sets, of = benchmark_windows(items, width)
    hits = written(window_hits(docs, sets, most).distinct(), "hits")
    ids = F.array_sort(F.collect_set(F.col("item_id").cast("string")))
    named = hits.select("k", "wid").distinct().join(of, "wid").groupBy("k").agg(ids.alias("ids"))
    named = named.select("k", F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join("ids", ","), 256).alias("items_sha256"))
    before = "PARTITION BY k ORDER BY at, at + m ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    ends = hits.groupBy("k", "at").agg(F.max("m").alias("m")).withColumn("until", F.expr(f"max(at + m) OVER ({before})"))
    begins = (F.col("until").isNull() | (F.col("at") > F.col("until"))).cast("int")
    runs = ends.withColumn("begins", begins).withColumn("run", F.expr("sum(begins) OVER (PARTITION BY k ORDER BY at ROWS UNBOUNDED PRECEDING)"))
    spans = runs.groupBy("k", "run").agg(F.min("at").alias("s"), F.max(F.col("at") + F.col("m")).alias("e"))
    spans = spans.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("spans"), F.sum(F.col("e") - F.col("s")).alias("n_hit"))
    return spans.join(named, "k", "left")


def scan_documents(docs: DataFrame, items: DataFrame, *, width: int = WIDTH, most: int = SET_BYTES) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every row of docs(doc_id, text).

    A word is hit if it lies in any occurrence of an item's window of `width` words (an item of fewer words is one
    window; one without words none). items_sha256 is of the sorted ids of items with a window in the text, so that of
    the empty string where there are none. Null and empty texts have no words; repeated rows are told each.
    Equal texts are searched once after map-side grouping; a text that fills a third of the rows joins its result in
    parts (adaptive skew join), as what is joined holds no texts.
    """
    found = written(contamination(docs, items, width=width, most=most).drop("spans"), "contaminated").withColumnRenamed("k", "__k")
    rows = docs.select("doc_id", F.size(words(F.col("text"))).cast("long").alias("n_words"), text_key(F.col("text")).alias("k"))
    zero = F.lit(0).cast("long")
    return rows.join(found, F.col("k") == F.col("__k"), "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
    )


def decontaminated(docs: DataFrame, items: DataFrame, *, remove: str = "spans", share: float = 0.0, width: int = WIDTH, most: int = SET_BYTES) -> DataFrame:
    """docs(text, ...) without the benchmark: all columns stay.

    remove="documents": rows go whose hit words are more than `share` of their words. remove="spans": covered words go
    from the text, each with what stands between it and the word before. Rows without hits stay byte for byte.
    """
    if remove not in ("spans", "documents"):
        raise ValueError("remove is spans or documents")
    found = written(contamination(docs, items, width=width, most=most).select(F.col("k").alias("__k"), F.col("spans").alias("__spans"), F.col("n_hit").alias("__hit")), "contaminated")
    rows = docs.join(found, text_key(F.col("text")) == F.col("__k"), "left")
    if remove == "documents":
        kept = F.col("__hit").isNull() | (F.col("__hit") <= F.size(words(F.col("text"))) * F.lit(share))
        return rows.where(kept).select(*docs.columns)
    return rows.withColumn("text", F.when(F.col("__spans").isNull(), F.col("text")).otherwise(_without(F.col("text"), F.col("__spans")))).select(*docs.columns)


def _without(text: Column, spans: Column) -> Column:
    """A text without some word spans: units of a word and what stands before it are kept or go."""
    found = F.regexp_extract_all(text, F.lit(CASED_WORD), F.lit(0))
    gaps = F.split(text, CASED_WORD, -1)

    def cut(parts):
        units, end = parts["units"], parts["end"]
        n = F.size(units)
        starts = F.concat(F.array(F.lit(0)), F.transform(spans, lambda x: x["e"]))
        stops = F.concat(F.transform(spans, lambda x: x["s"]), F.array(n))
        kept = F.zip_with(starts, stops, lambda a, b: F.array_join(F.slice(units, a + 1, b - a), ""))
        return F.concat(F.array_join(kept, ""), end)

    units = F.zip_with(gaps, found, lambda g, w: F.concat(g, F.coalesce(w, F.lit(""))))
    whole = F.struct(F.slice(units, 1, F.size(found)).alias("units"), F.element_at(gaps, -1).alias("end"))
    return F.transform(F.array(whole), cut)[0]
