"""An inverted index of texts: positional postings by term, read by impact.

A posting is a word's places in one text with their number (its impact) and that of all words of its stem there. Every task
turns its own texts into blocks: up to BLOCK postings of one word, by falling impact, each block with its greatest numbers.
Texts aren't taken apart by a shuffle, so an index costs no disk beside itself. A query reads the blocks of its own words,
or of its stems' words, whose impact can still matter, as predicates on the folder, the word or stem and the block's
maximum that reach the scan. The index is a table of its own with folders by a hash of the source, so that a reload
replaces the folders of its sources.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar import storage
from lodestar.functions.fulltext import TextQuery, match, stem_text, text_query
from lodestar.functions.text import tokens
from lodestar.operators.search import top

#: Postings of a block.
BLOCK = 256
#: Words of the texts that are turned into blocks together, unless one text has more.
WORDS = 1 << 20
#: How many times the wanted rows a first read should hold by a histogram of impacts.
SLACK = 4
#: Greatest share of a rank that one minimal cover of n terms adds; a place begins at most n minimal covers.
COVER = 0.1

EXACT, STEM = "w", "s"
#: The columns of a kind: which tells the term of a block, its greatest number, and a posting's number.
COLUMNS = {EXACT: ("term", "most", "impact"), STEM: ("stem", "most_stem", "stem_impact")}


def _runs(*sorted_by: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    n = len(sorted_by[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for x in sorted_by:
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def _packed(texts: pa.RecordBatch, schema: pa.Schema) -> pa.RecordBatch | None:
    """Blocks of the texts (bucket, id, words), none without words."""
    texts = texts.take(pc.sort_indices(texts.column("id")))
    lists = texts.column("words")
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    code, vocabulary = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
    if not len(code):
        return None
    text = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(code)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    # postings: runs of a text's word; a stable sort leaves its places in order
    order = np.argsort(text * len(vocabulary) + code, kind="stable")
    text, code, place = text[order], code[order], place[order]
    first = _runs(text, code)
    impact = np.diff(np.append(first, len(code)))
    text, code = text[first], code[first]
    stems = pa.array([stem_text(w) for w in vocabulary.to_pylist()]).dictionary_encode()
    _, same = np.unique(text * len(stems.dictionary) + stems.indices.to_numpy(zero_copy_only=False)[code], return_inverse=True)
    stem_impact = np.bincount(same, impact).astype(np.int64)[same]
    # blocks: at most BLOCK of a folder's word, by falling impact
    bucket = texts.column("bucket").to_numpy(zero_copy_only=False)[text]
    by = np.lexsort((text, -impact, code, bucket))
    bucket, code, text, impact, stem_impact, first = (x[by] for x in (bucket, code, text, impact, stem_impact, first))
    begin = _runs(bucket, code)
    turn = np.arange(len(code)) - np.repeat(begin, np.diff(np.append(begin, len(code))))
    begin = np.flatnonzero(turn % BLOCK == 0)
    ends = np.cumsum(impact)
    at = np.repeat(first - (ends - impact), impact) + np.arange(ends[-1])
    places = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(place[at], pa.int32()))
    item = schema.field("postings").type.value_type
    one = [pa.array(impact, pa.int32()), pa.array(stem_impact, pa.int32()), texts.column("id").take(pa.array(text)), places]
    postings = pa.ListArray.from_arrays(pa.array(np.append(begin, len(code)), pa.int32()), pa.StructArray.from_arrays(one, fields=[item.field(k).with_type(x.type) for k, x in enumerate(one)]))
    word = pa.array(code[begin])
    columns = [pa.array(bucket[begin], pa.int32()), stems.take(word).cast(pa.string()), vocabulary.take(word), pa.array(impact[begin], pa.int32()), pa.array(np.maximum.reduceat(stem_impact, begin), pa.int32()), postings]
    return pa.RecordBatch.from_arrays(columns, ["bucket", "stem", "term", "most", "most_stem", "postings"])


def blocks(chunks: DataFrame) -> DataFrame:
    """(bucket, stem, term, most, most_stem, postings) of chunks(bucket, id, content): blocks of a word's postings (impact,
    stem_impact, id, places) by falling impact. Each task makes its own, a frequent word has some in every task."""
    from pyspark.sql.pandas.types import to_arrow_schema

    posting = T.StructType([T.StructField("impact", T.IntegerType()), T.StructField("stem_impact", T.IntegerType()), T.StructField("id", chunks.schema["id"].dataType), T.StructField("places", T.ArrayType(T.IntegerType()))])
    schema = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("stem", T.StringType()), T.StructField("term", T.StringType()), T.StructField("most", T.IntegerType()), T.StructField("most_stem", T.IntegerType()), T.StructField("postings", T.ArrayType(posting))])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.fill_null(pc.list_value_length(batch.column("words")), 0).to_numpy(zero_copy_only=False)
            for at in np.split(np.arange(batch.num_rows), _runs(np.cumsum(sizes) // WORDS)[1:]):
                made = _packed(batch.slice(at[0], len(at)), arrow) if len(at) else None
                if made is not None:
                    yield made

    return chunks.select("bucket", "id", tokens(F.col("content")).alias("words")).mapInArrow(run, schema)


def write_text_index(chunks: DataFrame, path: str, touched: list[int] | None = None) -> None:
    """Write the index of chunks(bucket, id, content), or replace the folders that they are in (and those `touched`).

    path/blocks holds the postings, each file by stem and word. Null and empty texts have no postings; ids should be unique.
    """
    made = blocks(chunks)
    if touched:  # read again to see which folders are left
        made = storage.kept(made, "blocks")
    storage.replace_folders(made.sortWithinPartitions("bucket", "stem", "term", F.desc("most")), f"{path}/blocks", "bucket", touched or [], "zstd")


def _terms(query: TextQuery) -> tuple[list[list[str]], list[str]]:
    """The words or stems of each alternative, and those that must not occur."""
    return [list(dict.fromkeys(w for g in a for w in g)) for a in query.alternatives], list(dict.fromkeys(w for g in query.excluded for w in g))


def _least_impact(floor: float, n: int) -> int:
    """The impact below which no text with a rank of floor can be, for an alternative of n terms: its rarest term's
    places begin or end at most n minimal covers each."""
    return max(1, math.ceil(floor / (COVER * n) - 1e-6))


class TextIndex:
    """Reads an index. read: how many postings the last search took from it, of how many its terms have."""

    def __init__(self, spark: SparkSession, path: str):
        self.blocks = spark.read.parquet(f"{path}/blocks")
        self.read: tuple[int, int] = (0, 0)

    def _postings(self, need: dict[str, int], kind: str) -> DataFrame:
        """(id, term, places) of the words' or stems' postings of the impacts needed; whole blocks below it aren't read."""
        term, most, number = COLUMNS[kind]
        at = reduce(lambda a, b: a | b, ((F.col(term) == t) & (F.col(most) >= k) for t, k in need.items()))
        rows = self.blocks.where(F.col(term).isin(list(need)) & at).select(F.col(term).alias("term"), F.explode("postings").alias("x"))
        fits = reduce(lambda a, b: a | b, ((F.col("term") == t) & (F.col(f"x.{number}") >= k) for t, k in need.items()))
        return rows.where(fits).select("x.id", "term", "x.places")

    def _found(self, query: TextQuery, stemmed: bool, floor: float, allowed: DataFrame | None) -> DataFrame:
        """(id, text_rank) of every text with a rank of floor or more (and some others)."""
        alternatives, excluded = _terms(query)
        need: dict[str, int] = {}
        for terms in alternatives:
            for t in terms:
                need[t] = min(need.get(t, 1 << 30), _least_impact(floor, len(terms)))
        need.update(dict.fromkeys(excluded, 1))
        words, _, ranked = match(query)
        number = F.coalesce(*(F.when(F.col("term") == w, k) for k, w in enumerate(words, 1)))
        rows = self._postings(need, STEM if stemmed else EXACT)
        if allowed is not None:
            rows = rows.join(allowed.select("id"), "id", "left_semi")
        hits = rows.select("id", F.transform("places", lambda p: F.struct(p.alias("p"), number.alias("t"))).alias("hits")).groupBy("id").agg(F.array_sort(F.flatten(F.collect_list("hits"))).alias("hits"))
        # some alternative has all its terms here
        held = F.array_distinct(F.transform("hits", lambda x: x["t"]))
        whole = reduce(lambda a, b: a | b, (F.size(F.array_intersect(held, F.array(*(F.lit(words.index(w) + 1) for w in dict.fromkeys(w for g in a for w in g))))) == len({w for g in a for w in g}) for a in query.alternatives))
        gaps = F.transform("hits", lambda x, i: F.struct(x["t"].alias("t"), (x["p"] - F.coalesce(F.get(F.col("hits"), i - 1)["p"], F.lit(-1)) - 1).alias("g")))
        rank = F.element_at(F.transform(F.array(gaps), ranked), 1)
        return hits.where(whole).select("id", F.explode(F.array_compact(F.array(rank))).alias("text_rank"))

    def _floor(self, query: TextQuery, stemmed: bool, n: int) -> float:
        """The rank to search down to first: where the rarest term of some alternative still has SLACK * n postings by a
        histogram of impacts; 0 if that leaves out too few."""
        alternatives, _ = _terms(query)
        every = sorted({t for a in alternatives for t in a})
        counts: dict[str, list[tuple[int, int]]] = {}
        term, _, number = COLUMNS[STEM if stemmed else EXACT]
        # a column of the terms' blocks beside their places
        numbers = self.blocks.where(F.col(term).isin(every)).select(F.col(term).alias("term"), F.explode(f"postings.{number}").alias("impact"))
        for r in numbers.groupBy("term", "impact").agg(F.count("*").alias("n")).collect():
            counts.setdefault(r["term"], []).append((r["impact"], r["n"]))
        best = 0.0
        for terms in alternatives:
            levels = []
            for t in terms:
                total, level = 0, 1
                for impact, many in sorted(counts.get(t, ()), reverse=True):
                    total += many
                    if total >= SLACK * n:
                        level = impact
                        break
                levels.append(level)
            best = max(best, COVER * (min(levels) if len(levels) == 1 else min(levels) - 1))
        self._counts = {t: sum(m for _, m in c) for t, c in counts.items()}
        self._levels = counts
        return best if best > COVER else 0.0

    def hits(self, text: str, n: int = 40, stemmed: bool = False, allowed: DataFrame | None = None) -> DataFrame:
        """(id, text_rank): the n texts of highest rank, as search.text_hits finds them; allowed(id): only among these.

        A try finds every text of a rank not below its floor, and of others some, no rank too high. If the n-th found is below
        the floor, its rank is the last try's floor; if fewer than n are found, 0 is.
        """
        query, n = text_query(text, stemmed), max(1, int(n))
        if not query.alternatives:
            return self.blocks.select(F.explode("postings.id").alias("id"), F.lit(0.0).alias("text_rank")).limit(0)
        find = lambda floor: top(self._found(query, stemmed, floor, allowed), n, F.desc("text_rank"), F.col("id"))
        floor = self._floor(query, stemmed, n)
        found = find(floor)
        if floor > 0:
            found = storage.kept(found, "hits")
            last = found.agg(F.count("*").alias("n"), F.min("text_rank").alias("rank")).head()
            if last["n"] < n or last["rank"] < floor:
                floor = last["rank"] if last["n"] == n else 0.0
                found = find(floor)
        self._account(query, floor)
        return found

    def _account(self, query: TextQuery, floor: float) -> None:
        alternatives, _ = _terms(query)
        need = {t: _least_impact(floor, len(a)) for a in alternatives for t in a}
        self.read = sum(m for t, k in need.items() for i, m in self._levels.get(t, ()) if i >= k), sum(self._counts.get(t, 0) for t in need)


def with_buckets(chunks: DataFrame, buckets: int, source: str = "source_id") -> DataFrame:
    """Chunks with the folder of their source."""
    return chunks.withColumn("bucket", F.pmod(F.xxhash64(F.col(source).cast("string")), F.lit(buckets)).cast("int"))
