"""Retrieval channels and their fusion. Every channel is cut to its top rows before ranks are numbered, so
that no window sees the whole table."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.functions.fulltext import cover_rank, cover_ranks, text_query
from lodestar.functions.text import same_scope, term_rank
from lodestar.functions.vector import similarity

# What names an identifier, and what makes a query clause-heavy with the weights it then gets.
IDENTIFIER = re.compile(r"[A-Za-z]+[-./]?[0-9]+|[0-9]+[A-Za-z]+|iso\s*[0-9]{3,5}|cl[aá]usula\s*[0-9]+(?:\.[0-9]+)*", re.I)
CLAUSE_HEAVY = re.compile(r"\b(?:cl[aá]usula|clause|numeral|apartado|secci[oó]n|standard|scope)\b", re.I)
CLAUSE_WEIGHTS = (0.55, 0.75)
#: Queries of a batch that are sent to all tasks at most, and their bytes; more are multiplied in blocks.
BATCH, BATCH_BYTES = 1000, 8 << 20


def require_tenant(tenant) -> None:
    if tenant is None:
        raise ValueError("TENANT_REQUIRED")


def in_scopes(scopes: Sequence[str]) -> Column | None:
    """Whether a row's scope equals or contains a requested one, a standard in any of its spellings; None without any."""
    terms = sorted({s.strip().lower() for s in scopes if s and s.strip()})
    if not terms:
        return None
    s = F.lower(F.trim("scope"))
    return F.coalesce((s != "") & (same_scope(F.col("scope"), terms) | reduce(lambda a, b: a | b, [s.contains(t) for t in terms])), F.lit(False))


def scoped(chunks: DataFrame, tenant=None, scopes: Sequence[str] = (), include_global: bool = True) -> DataFrame:
    """Rows of a tenant (and global ones) whose scope equals or contains a requested scope; rows without a
    scope go if one is requested."""
    out = chunks
    if tenant is not None:
        own = F.col("tenant_id") == F.lit(tenant)
        out = out.where(own | F.coalesce(F.col("is_global"), F.lit(False)) if include_global and "is_global" in chunks.columns else own)
    mine = in_scopes(scopes)
    return out if mine is None else out.where(mine)


def top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n rows, at least one asked for."""
    return df.orderBy(*order).limit(max(1, int(n)))


def vector_hits(chunks: DataFrame, query: Sequence[float], n: int = 40, threshold: float = 0.25, inclusive: bool = False) -> DataFrame:
    """chunks with similarity above the threshold, the n best."""
    hit = chunks.withColumn("similarity", similarity(F.col("embedding"), query))
    s = F.col("similarity")
    return top(hit.where(s >= threshold if inclusive else s > threshold), n, F.desc("similarity"), F.col("id"))


def text_hits(chunks: DataFrame, text: str, n: int = 40, stemmed: bool = False) -> DataFrame:
    """Chunks that match a search-box text, the n of highest cover density."""
    return top(_having(chunks, "text_rank", cover_rank(F.col("content"), text_query(text, stemmed), stemmed)), n, F.desc("text_rank"), F.col("id"))


def _having(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a costly value, rows without it left out. A filter on the value would have it computed again, and
    pushed below joins into a scan's few tasks; a generator computes it once, where it stands."""
    return df.select("*", F.explode(F.array_compact(F.array(value))).alias(name))


def words_hits(chunks: DataFrame, text: str, n: int = 40) -> DataFrame:
    """Chunks that hold every word of the text, the n of highest saturated term frequency."""
    terms = list(dict.fromkeys(re.findall("[0-9a-zà-öø-ÿ]+", text.lower())))
    return top(_having(chunks, "text_rank", term_rank(F.col("content"), terms)), n, F.desc("text_rank"), F.col("id"))


def literal_match(text: str, *columns: Column) -> Column:
    """Whether any of the columns holds the text itself in any case; a blank text matches nothing."""
    t = text.strip().lower()
    return reduce(lambda a, b: a | b, (F.lower(F.coalesce(c, F.lit(""))).contains(t) for c in columns)) if t else F.lit(False)


def literal_hits(chunks: DataFrame, text: str, n: int = 40) -> DataFrame:
    """Chunks that hold the text itself in content, context or scope, at rank 1.0, ordered by id."""
    columns = [F.col(c) for c in ("content", "semantic_context", "scope") if c in chunks.columns]
    return top(chunks.where(literal_match(text, *columns)).withColumn("text_rank", F.lit(1.0)), n, F.col("id"))


def ranked(hits: DataFrame, channel: str, weight: float, *order: Column) -> DataFrame:
    """(id, channel, weight, rank) of a channel's hits."""
    w = Window.orderBy(*order)
    return hits.select("id", F.lit(channel).alias("channel"), F.lit(float(weight)).alias("weight"), F.row_number().over(w).alias("rank"))


def rrf(lists: Sequence[DataFrame], k: int = 60) -> DataFrame:
    """(id, score) of ranked lists: sum of weight / (k + rank). One shuffle instead of a chain of full joins."""
    every = reduce(lambda a, b: a.unionByName(b), lists)
    return every.groupBy("id").agg(F.round(F.sum(F.col("weight") / (F.lit(float(k)) + F.col("rank"))), 6).alias("score"))


def channel_weights(text: str, vector: float = 0.7, words: float = 0.3) -> dict[str, float]:
    """Weights of the channels: exact and literal matches count more if the query names an identifier."""
    vector, words = max(0.0, vector), max(0.0, words)
    if IDENTIFIER.search(text):
        return {"vector": vector, "text": min(words, 0.2), "exact": max(0.45, words * 1.6), "literal": 0.35}
    return {"vector": vector, "text": words, "exact": min(words, 0.2), "literal": 0.05}


def clause_weights(text: str, vector: float = 0.7, words: float = 0.3) -> tuple[float, float]:
    """(vector, words) weights: a clause-heavy query leans on words."""
    return CLAUSE_WEIGHTS if CLAUSE_HEAVY.search(text) else (vector, words)


def fused_channels(rows: DataFrame, channels: Sequence[tuple[str, float, Column]], n: int, k: int = 60, keys: Sequence[str] = ("id",)) -> DataFrame:
    """(keys..., score, similarity, <channel>...) of channels (name, weight, value): each channel's n best by value
    and id are ranked, the ranks fused, and the values kept; similarity is the greatest. keys: id last.

    The rows are read once, whatever the number of channels: each row offers an entry for each channel it has a
    value in, and every task cuts a channel to n rows before anything is shuffled.
    """
    entries = F.filter(F.array(*(F.struct(F.lit(c).alias("channel"), F.lit(float(w)).alias("weight"), v.cast("double").alias("value")) for c, w, v in channels)), lambda x: x["value"].isNotNull())
    e = rows.select(*keys, F.explode(entries).alias("e")).select(*keys, "e.*")
    w = Window.partitionBy(*keys[:-1], "channel").orderBy(F.desc("value"), keys[-1])
    e = e.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max(1, int(n)))
    value = lambda c: F.max(F.when(F.col("channel") == c, F.col("value")))
    return e.groupBy(*keys).agg(F.round(F.sum(F.col("weight") / (F.lit(float(k)) + F.col("rank"))), 6).alias("score"), F.greatest(F.max("value"), F.lit(0.0)).alias("similarity"), *(value(c).alias(c) for c, _, _ in channels))


def hybrid(chunks: DataFrame, query: Sequence[float], text: str, n: int = 40, threshold: float = 0.25, k: int = 60, vector: float = 0.7, words: float = 0.3, tenant=None, scopes: Sequence[str] = (), fallback: bool = False) -> DataFrame:
    """(id, score, similarity): vector, stemmed text, exact text and, for identifiers, literal channels fused over
    the scoped chunks. similarity is the greatest value of a row's channels; a literal match counts 1.

    fallback: each requested scope is ranked for itself and gives its quota of rows (fan_out_quota), n rows if it is the
    only one; where none of them has any, chunks of other scopes are found. One pass ranks all.
    """
    text = text.strip()
    wanted = [s for s in dict.fromkeys(scopes) if s and s.strip()] if fallback else []
    c = scoped(chunks, tenant, () if fallback else scopes)
    c = c.withColumn("__far", F.coalesce(*(F.when(in_scopes([s]), k) for k, s in enumerate(wanted)), F.lit(len(wanted))))
    w = channel_weights(text, vector, words)
    c = c.withColumn("__sim", similarity(F.col("embedding"), query))
    channels = [("vector", w["vector"], F.when(F.col("__sim") > threshold, F.col("__sim")))]
    if text:
        # both text channels share one pass over the words
        c = c.withColumn("__rank", cover_ranks(F.col("content"), text=(text_query(text, True), True), exact=(text_query(text), False)))
        channels += [("text", w["text"], F.col("__rank.text")), ("exact", w["exact"], F.col("__rank.exact"))]
        if IDENTIFIER.search(text):
            columns = [F.col(x) for x in ("content", "semantic_context", "scope") if x in c.columns]
            channels.append(("literal", w["literal"], F.when(literal_match(text, *columns), 1.0)))
    order = (F.desc("score"), F.desc("similarity"), F.col("id"))
    if not wanted:
        return top(fused_channels(c, channels, n, k).select("id", "score", "similarity"), n, *order)
    # a few rows for each scope and channel from here on
    each = fan_out_quota(n, len(wanted)) if len(wanted) > 1 else n
    found = fused_channels(c, channels, n, k, ("__far", "id"))
    found = found.withColumn("__near", F.min("__far").over(Window.partitionBy())).withColumn("__turn", F.row_number().over(Window.partitionBy("__far").orderBy(*order)))
    found = found.where(((F.col("__far") < len(wanted)) & (F.col("__turn") <= each)) | ((F.col("__near") == len(wanted)) & (F.col("__turn") <= n)))
    return found.select("id", "score", "similarity").orderBy(*order)


def batch_hybrid(chunks: DataFrame, queries: Sequence[tuple[str, Sequence[float]]], n: int, threshold: float, k: int = 60) -> DataFrame:
    """(query_id, id, similarity, text_rank, score): for each of a request's few queries (text, vector), numbered
    from 1, the n best of vector and text channels of 2n rows each. One pass over the chunks for all queries."""
    if not queries or n <= 0:
        return chunks.sparkSession.createDataFrame([], "query_id int, id long, similarity double, text_rank double, score double")
    asked = []
    chunks = chunks.withColumn("__rank", cover_ranks(F.col("content"), **{f"q{i}": (text_query(t, True), True) for i, (t, _) in enumerate(queries, 1)}))
    for i, (_, v) in enumerate(queries, 1):
        s, rank = similarity(F.col("embedding"), v), F.col(f"__rank.q{i}")
        asked.append(F.struct(F.lit(i).alias("query_id"), F.when(s > threshold, s).alias("sim"), rank.alias("rank")))
    rows = chunks.select("id", F.explode(F.filter(F.array(*asked), lambda x: x["sim"].isNotNull() | x["rank"].isNotNull())).alias("x")).select("x.query_id", "id", "x.sim", "x.rank")
    fused = fused_channels(rows, [("sim", 1.0, F.col("sim")), ("rank", 1.0, F.col("rank"))], 2 * n, k, ("query_id", "id"))
    r = fused.withColumn("rn", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("rn") <= n)
    return r.select("query_id", "id", F.coalesce("sim", F.lit(0.0)).alias("similarity"), F.coalesce("rank", F.lit(0.0)).alias("text_rank"), "score")


def under_path(path: Column, prefix: str | None) -> Column:
    """Whether a dotted path is the prefix or below it; no prefix takes all."""
    return F.lit(True) if not prefix else (path == prefix) | path.startswith(prefix + ".")


def hierarchical(chunks: DataFrame, query: Sequence[float], text: str, n: int, threshold: float, prefix: str | None = None) -> DataFrame:
    """batch_hybrid of one query over the chunks of a subtree of paths."""
    return batch_hybrid(chunks.where(under_path(F.col("path"), prefix)), [(text, query)], n, threshold).drop("query_id")


def scoped_vectors(chunks: DataFrame, query: Sequence[float], n: int, threshold: float, prefix: str | None) -> DataFrame:
    """The n vectors nearest to a query below a path."""
    return vector_hits(chunks.where(under_path(F.col("path"), prefix)), query, n, threshold)


def filtered_vectors(chunks: DataFrame, query: Sequence[float], n: int, threshold: float, tenant, source_ids: Sequence = (), **equal) -> DataFrame:
    """Vector search over a tenant's and global rows with optional filters: sources and columns that equal a value."""
    c = scoped(chunks, tenant)
    c = c.where(F.col("source_id").isin(list(source_ids))) if source_ids else c
    for name, value in equal.items():
        c = c.where(F.col(name) == F.lit(value))
    return vector_hits(c, query, n, threshold)


def summary_hits(summaries: DataFrame, query: Sequence[float], tenant, n: int = 5, threshold: float = 0.4) -> DataFrame:
    """A tenant's summaries above the leaves."""
    require_tenant(tenant)
    return vector_hits(scoped(summaries, tenant, include_global=False).where("level > 0"), query, n, threshold)


def entity_hits(entities: DataFrame, query: Sequence[float], tenant, n: int = 8, threshold: float = 0.72) -> DataFrame:
    """A tenant's entities at or above the threshold."""
    require_tenant(tenant)
    return vector_hits(scoped(entities, tenant, include_global=False), query, n, threshold, inclusive=True)


def community_hits(communities: DataFrame, query: Sequence[float], tenant, level: int = 0, n: int = 5, threshold: float = 0.25) -> DataFrame:
    """A tenant's communities of one level at or above the threshold."""
    require_tenant(tenant)
    return vector_hits(scoped(communities, tenant, include_global=False).where(F.col("level") == level), query, n, threshold, inclusive=True)


def inspect_document(chunks: DataFrame, query: Sequence[float], text: str, n: int, threshold: float, source_id) -> DataFrame:
    """(id, score, vector, text) over one document's chunks that either channel has; ranks of both are fused."""
    s = similarity(F.col("embedding"), query)
    one = chunks.where(F.col("source_id") == F.lit(source_id))
    f = fused_channels(one, [("vector", 1.0, F.when(s > threshold, s)), ("text", 1.0, cover_rank(F.col("content"), text_query(text, True), True))], 2 * n)
    return top(f.select("id", "score", "vector", "text"), n, F.desc("score"), F.col("id"))


def select_anchors(entities: DataFrame, names: Sequence[str], vector_found: DataFrame, n: int = 8) -> DataFrame:
    """(id, name, similarity): entities of exactly these names in any case; only where there is none, those that
    vectors found. At most n."""
    wanted = [x.strip().lower() for x in names if x.strip()]
    exact = entities.where(F.lower(F.trim("name")).isin(wanted)).select("id", "name", F.lit(1.0).alias("similarity"), F.lit(0).alias("step"))
    near = vector_found.select("id", "name", "similarity", F.lit(1).alias("step"))
    few = top(exact, n, F.col("id")).unionByName(top(near, n, F.desc("similarity"), F.col("id")))
    least = F.min("step").over(Window.partitionBy())
    return top(few.withColumn("least", least).where("step = least"), n, F.desc("similarity"), F.col("id")).select("id", "name", "similarity")


def layered_rrf(chunks: DataFrame, query: Sequence[float], layer: Column, n: int, threshold: float, k: int = 60) -> DataFrame:
    """(id, layer, score): ranks are numbered within each layer's own best n."""
    s = chunks.select("id", layer.alias("layer"), similarity(F.col("embedding"), query).alias("similarity")).where(F.col("similarity") > threshold)
    r = s.withColumn("rank", F.row_number().over(Window.partitionBy("layer").orderBy(F.desc("similarity"), F.col("id")))).where(F.col("rank") <= n)
    return r.groupBy("id", "layer").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 6).alias("score"))


def weighted_sum(chunks: DataFrame, query: Sequence[float], text: str, n: int, vector: float = 0.7, words: float = 0.3) -> DataFrame:
    """(id, score): vector * similarity + words * min(text rank, 1) over chunks with either."""
    terms = list(dict.fromkeys(re.findall("[0-9a-zà-öø-ÿ]+", text.lower())))
    s, r = similarity(F.col("embedding"), query), term_rank(F.col("content"), terms)
    both = _having(chunks.select("id", "embedding", "content"), "x", F.transform(F.array(F.struct(s.alias("sim"), r.alias("rank"))), lambda x: F.when(x["sim"].isNotNull() | x["rank"].isNotNull(), x))[0])
    score = F.round(vector * F.coalesce("x.sim", F.lit(0.0)) + words * F.least(F.coalesce("x.rank", F.lit(0.0)), F.lit(1.0)), 6)
    return top(both.select("id", score.alias("score")), n, F.desc("score"), F.col("id"))


def batch_vector_topk(chunks: DataFrame, queries: DataFrame, n: int, threshold: float) -> DataFrame:
    """(query_id, rank, id, similarity): each query's n best above the threshold. queries: (query_id, query), any number.

    Few queries are sent to all tasks, and norms taken once for a row and a query; more are multiplied with the rows in
    blocks (see blocks.block_topk). Either way each task cuts a query to n rows.
    """
    from lodestar.functions.vector import dot, norm
    from lodestar.operators.blocks import block_topk

    size = queries.limit(BATCH + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("query")), F.lit(0)).alias("x")).head()
    if size["n"] > BATCH or size["x"] * 8 > BATCH_BYTES:
        s = block_topk(chunks, queries, n, threshold)
    else:
        unit = lambda c: F.when(c.isNotNull() & (norm(c) > 0), norm(c))
        c = chunks.select("id", "embedding", unit(F.col("embedding")).alias("length")).where("length is not null")
        q = queries.select("query_id", "query", unit(F.col("query")).alias("q_length")).where("q_length is not null")
        pairs = c.join(F.broadcast(q), F.size("embedding") == F.size("query"))
        s = pairs.select("query_id", "id", F.round(dot(F.col("embedding"), F.col("query")) / (F.col("length") * F.col("q_length")), 6).alias("similarity"))
    s = s.where(F.col("similarity") > threshold)
    r = s.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), F.col("id"))))
    return r.where(F.col("rank") <= n).select("query_id", "rank", "id", "similarity")


def scope_quota(hits: DataFrame, scope: Column, per_scope: int, *order: Column) -> DataFrame:
    """Each scope's best rows up to a quota, in one pass."""
    r = hits.withColumn("__scope", scope).withColumn("__rank", F.row_number().over(Window.partitionBy("__scope").orderBy(*order)))
    return r.where(F.col("__rank") <= per_scope).drop("__scope", "__rank")


def fan_out_quota(fetch_k: int, scopes: int) -> int:
    return max(10, min(20, fetch_k // max(1, scopes)))


def keyset_page(df: DataFrame, size: int, after: tuple[float, int] | None = None, score: str = "score", id_col: str = "id") -> DataFrame:
    """The page behind a cursor in descending score, ascending id; has_more tells of rows behind it."""
    size = max(1, min(500, size))
    if after is not None:
        s, i = after
        df = df.where((F.col(score) < F.lit(s)) | ((F.col(score) == F.lit(s)) & (F.col(id_col) > F.lit(i))))
    t = top(df, size + 1, F.desc(score), F.col(id_col))
    r = t.withColumn("__n", F.row_number().over(Window.orderBy(F.desc(score), F.col(id_col))))
    more = F.max("__n").over(Window.partitionBy()) > size
    return r.withColumn("has_more", more).where(F.col("__n") <= size).drop("__n")


def union_boost(text_rows: DataFrame, visual_rows: DataFrame, query: Sequence[float], word: str, n: int, threshold: float, hydrate: float = 0.35) -> DataFrame:
    """(id, kind, score, payload): text and visual rows together; a keyword adds 0.3 to 0.7 of a text row's
    similarity, 0.4 to 0.6 of a visual row's; a visual row's payload comes only from similarity hydrate on."""
    has = F.lower("content").contains(word.lower())
    s = similarity(F.col("embedding"), query)
    t = text_rows.withColumn("sim", s).where(F.col("sim") >= threshold)
    t = t.select("id", F.lit("text").alias("kind"), F.round(0.7 * F.col("sim") + F.when(has, 0.3).otherwise(0.0), 6).alias("score"), F.lit(None).cast("string").alias("payload"))
    v = visual_rows.withColumn("sim", s).where((F.col("sim") >= threshold) | has)
    v = v.select("id", F.lit("visual").alias("kind"), F.round(0.6 * F.coalesce("sim", F.lit(0.0)) + F.when(has, 0.4).otherwise(0.0), 6).alias("score"), F.when(F.col("sim") >= hydrate, F.left("content", F.lit(40))).alias("payload"))
    return top(t.unionByName(v), n, F.desc_nulls_last("score"), F.col("kind"), F.col("id"))


def union_plain(text_rows: DataFrame, visual_rows: DataFrame, query: Sequence[float], n: int, threshold: float, hydrate: float = 0.35) -> DataFrame:
    """(id, kind, score, payload): text and visual rows by similarity alone."""
    s = similarity(F.col("embedding"), query)
    none = F.lit(None).cast("string")
    t = text_rows.select("id", F.lit("text").alias("kind"), s.alias("score"), none.alias("payload"))
    v = visual_rows.select("id", F.lit("visual").alias("kind"), s.alias("score"), F.when(s >= hydrate, F.left("content", F.lit(40))).alias("payload"))
    return top(t.unionByName(v).where(F.col("score") >= threshold), n, F.desc("score"), F.col("kind"), F.col("id"))


def scope_mode(mode: str, tenant, owner: Column, tenant_col: Column, is_global: Column) -> Column:
    """Which rows a scope mode lets through; an unknown mode lets none."""
    own = tenant_col == F.lit(tenant)
    modes = {"global": is_global, "institution": own & ~is_global, "private": owner & ~is_global, "hybrid_institution": is_global | own, "hybrid_private": is_global | owner}
    return modes.get(mode, F.lit(False))


def novelty_pages(ranks: DataFrame, page: int, target: int, least: float = 0.1) -> DataFrame:
    """Pages of a ranked list (rank, key) until one brings under least new keys or target keys are seen."""
    p = ranks.withColumn("page", F.floor((F.col("rank") - 1) / page))
    first = p.groupBy("key").agg(F.min("page").alias("page")).groupBy("page").agg(F.count("*").alias("fresh"))
    full = p.groupBy("page").agg(F.count("*").alias("rows")).join(first, "page", "left").select("page", "rows", F.coalesce("fresh", F.lit(0)).alias("fresh"))
    w = Window.orderBy("page")
    seen = full.withColumn("seen", F.sum("fresh").over(w)).withColumn("stop", (F.col("fresh") / F.col("rows") < least) | (F.col("seen") >= target))
    before = F.coalesce(F.max(F.col("stop").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return seen.withColumn("__b", before).where("__b = 0").select("page", "rows", "fresh", "seen")
