"""Fusion, reranking and policies over hit tables (id, content, similarity, score, scope, ...)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.functions.text import clean_content, content_key, same_scope, scope_name_key, standard_key, structural_only

# Authority weights of roles and tasks.
BALANCED = {"administrative": 1.0, "constitution": 1.0, "policy": 1.0, "canonical": 1.0, "supplementary": 1.0}
STRICT = {"administrative": 3.0, "constitution": 3.0, "policy": 2.0, "canonical": 1.0, "supplementary": 0.0}
CREATIVE = {"administrative": 1.0, "constitution": 1.0, "policy": 1.2, "canonical": 1.5, "supplementary": 2.0}
PEDAGOGICAL = {"administrative": 1.5, "constitution": 1.5, "policy": 1.2, "canonical": 2.0, "supplementary": 1.0}
INTEGRITY = {"administrative": 4.0, "constitution": 4.0, "policy": 2.0, "canonical": 1.5, "supplementary": 0.1}
# Boosts and floors of the gravity rerank.
LAYER_BOOST = {"personal": 1.15, "tenant": 1.08}
CONSTITUTIONAL_BOOST, SUMMARY_BOOST, SCORE_FLOOR, HEADING_FLOOR = 3.0, 1.4, 0.10, 0.15


def rrf_merge(lists: DataFrame, k: int = 60, top_k: int = 10) -> DataFrame:
    """(id, score, first_seen) of (list_no, pos, id): sum of 1 / (k + pos) with pos from 1; ties keep the order
    in which ids were first seen."""
    seq = F.struct("list_no", "pos")
    g = lists.groupBy("id").agg(F.round(F.sum(1.0 / (k + F.col("pos"))), 6).alias("score"), F.min(seq).alias("first_seen"))
    return g.orderBy(F.desc("score"), "first_seen", "id").limit(top_k)


def first_by(df: DataFrame, key: Column, *order: Column) -> DataFrame:
    """The first row of each key in an explicit order; blank keys go."""
    w = Window.partitionBy("__key").orderBy(*order)
    d = df.withColumn("__key", key).where("__key is not null and __key <> ''")
    return d.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r", "__key")


def dedupe_content(df: DataFrame, content: str = "content", score: str = "score", id_col: str = "id") -> DataFrame:
    """The best row of each normalised content."""
    return first_by(df, content_key(F.col(content)), F.desc(score), F.col(id_col))


def identity_key(id_col: Column, content: Column) -> Column:
    """The id, or the first 120 characters where it is blank."""
    return F.coalesce(F.nullif(id_col.cast("string"), F.lit("")), F.left(content, F.lit(120)))


def min_score(df: DataFrame, least: float, space: Column) -> DataFrame:
    """Rows of at least a score; fused scores are of another scale and pass."""
    return df.where(space.isin("rrf", "mixed") | (F.coalesce("similarity", "score") >= least))


def drop_structure(df: DataFrame, content: str = "content", eligible: Column | None = None, is_toc: Column | None = None, is_frontmatter: Column | None = None) -> DataFrame:
    """Content cleaned; structural rows and rows without content go."""
    no = F.lit(None).cast("boolean")
    kept = df.where(~structural_only(F.col(content), no if eligible is None else eligible, no if is_toc is None else is_toc, no if is_frontmatter is None else is_frontmatter))
    return kept.withColumn(content, clean_content(F.col(content))).where(F.col(content) != "")


def metadata_filter(df: DataFrame, wanted: Mapping[str, object]) -> DataFrame:
    """Rows whose columns equal a value or are among a list."""
    for k, v in wanted.items():
        df = df.where(F.col(k).isin(list(v)) if isinstance(v, (list, tuple, set)) else F.col(k) == F.lit(v))
    return df


def time_range(df: DataFrame, column: str, start=None, end=None) -> DataFrame:
    """Rows of an inclusive range of times in UTC."""
    if start is not None:
        df = df.where(F.col(column) >= F.lit(start).cast("timestamp_ntz"))
    return df if end is None else df.where(F.col(column) <= F.lit(end).cast("timestamp_ntz"))


def scope_or_all(df: DataFrame, matches: Column) -> DataFrame:
    """Matching rows, or all rows where none matches. One aggregate row decides."""
    some = df.agg(F.max(F.coalesce(matches, F.lit(False)).cast("int")).alias("__some"))
    return df.join(F.broadcast(some), F.lit(True)).where((F.coalesce("__some", F.lit(0)) == 0) | matches).drop("__some")


def stamp_tenant(df: DataFrame, tenant) -> DataFrame:
    return df.withColumn("tenant_id", F.coalesce("tenant_id", F.lit(tenant)))


def verify_isolation(df: DataFrame, tenant) -> DataFrame:
    """df, failing as a whole on a row of another tenant or one without owner that isn't global."""
    leak = ~F.coalesce(F.col("is_global"), F.lit(False)) & ~F.col("tenant_id").eqNullSafe(F.lit(tenant))
    # a filter stays in every plan, whatever columns are asked for; a nondeterministic one also stays where it
    # is, behind the scope's filters and joins
    here = F.spark_partition_id() >= 0
    return df.where(F.when(here & leak, F.raise_error(F.lit("TENANT_LEAK")).cast("boolean")).otherwise(F.lit(True)))


def scope_penalty(df: DataFrame, requested: Sequence[str], factor: float = 0.25) -> DataFrame:
    """Scores of rows with another scope than requested times 1 - factor; rows without scope stay. A standard is the
    same in any spelling."""
    away = (F.coalesce("scope", F.lit("")) != "") & ~same_scope(F.col("scope"), requested) if requested else F.lit(False)
    return df.withColumn("scope_penalized", away).withColumn("score", F.when(away, F.col("score") * (1 - factor)).otherwise(F.col("score")))


def penalty_ratio(df: DataFrame, requested: Sequence[str]) -> DataFrame:
    """The share of penalised rows among those with a scope, 0 without any."""
    r = F.avg(F.when(F.coalesce("scope", F.lit("")) != "", (~same_scope(F.col("scope"), requested)).cast("double")))
    return df.agg(F.round(F.coalesce(r, F.lit(0.0)), 4).alias("penalty_ratio"))


def stratify(df: DataFrame, requested: Sequence[str], n: int) -> DataFrame:
    """Rows taken in turn from the requested scopes, best first, then the others."""
    order = F.array_position(F.array(*(F.lit(scope_name_key(s)) for s in requested)), standard_key(F.col("scope")))
    bucket = F.when(F.coalesce(order, F.lit(0)) == 0, F.lit(len(requested) + 1)).otherwise(order)
    w = Window.partitionBy("bucket").orderBy(F.desc("score"), "id")
    r = df.withColumn("bucket", bucket).withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= n)
    other = (F.col("bucket") > len(requested)).cast("int")
    return r.orderBy(other, "turn", "bucket", "id").limit(n)


def gravity_rerank(df: DataFrame, weights: Mapping[str, float] = BALANCED, exclude_zero: bool = True, n: int = 10, heading_boost: Column | None = None, floor: float = SCORE_FLOOR) -> DataFrame:
    """df(id, similarity, authority, source_layer, is_constitutional, is_summary) reordered by authority, layer
    and structure; scores scaled to 0..1; the n best."""
    heading = F.lit(1.0) if heading_boost is None else heading_boost
    weight = F.coalesce(F.create_map(*(F.lit(x) for kv in weights.items() for x in kv))[F.col("authority")], F.lit(1.0))
    layer = F.coalesce(F.create_map(*(F.lit(x) for kv in LAYER_BOOST.items() for x in kv))[F.col("source_layer")], F.lit(1.0))
    special = F.coalesce("is_constitutional", F.lit(False)) | F.coalesce("is_summary", F.lit(False))
    d = df.withColumn("__h", heading).withColumn("__w", weight)
    if exclude_zero:
        d = d.where((F.col("__w") != 0) | special)
    d = d.where((F.coalesce("similarity", F.lit(0.0)) >= floor) | (F.col("__h") > 1))
    base = F.when(F.col("__h") > 1, F.greatest(F.coalesce("similarity", F.lit(0.0)), F.lit(HEADING_FLOOR))).otherwise(F.col("similarity"))
    boost = F.col("__w") * layer * F.when(F.coalesce("is_constitutional", F.lit(False)), CONSTITUTIONAL_BOOST).otherwise(1.0) * F.when(F.coalesce("is_summary", F.lit(False)), SUMMARY_BOOST).otherwise(1.0) * F.col("__h")
    d = d.withColumn("raw", F.round(base * boost, 6)).drop("__h", "__w")
    ends = d.agg(F.max("raw").alias("__hi"), F.min("raw").alias("__lo"))
    best = d.orderBy(F.desc("raw"), "id").limit(n)
    scaled = F.when(F.col("__hi") > F.col("__lo"), F.round((F.col("raw") - F.col("__lo")) / (F.col("__hi") - F.col("__lo")), 6)).otherwise(1.0)
    return best.join(F.broadcast(ends), F.lit(True)).withColumn("score", scaled).drop("__hi", "__lo")


def heading_boost(content: Column, anchors: Sequence[str]) -> Column:
    """5 for the first anchor in the SECTION_PATH, 3 for one in the first 400 characters, in anchor order."""
    path = F.trim(F.regexp_extract(content, r"SECTION_PATH:\s*(.+?)(?:\n|$)", 1))
    body = F.lower(F.left(content, F.lit(400)))
    out = F.lit(1.0)
    for a in reversed(list(anchors)):
        out = F.when(path.contains(a), 5.0).when(body.contains(a.lower()), 3.0).otherwise(out)
    return out


def late_fusion(df: DataFrame, quotas: Mapping[str, int], k: int) -> DataFrame:
    """Rows of (source, id, pos) by source quotas in the quotas' order, then the overflow in that order; an id
    counts once, where it comes first. Every task cuts a source to its first k rows before anything is sorted as a whole."""
    names = list(quotas)
    place = F.array_position(F.array(*(F.lit(s) for s in names)), F.col("source"))
    quota = F.create_map(*(F.lit(x) for kv in quotas.items() for x in kv))[F.col("source")]
    d = df.withColumn("place", place).where("place > 0")
    d = first_by(d, F.col("id").cast("string"), F.col("place"), F.col("pos"))
    d = d.withColumn("turn", F.row_number().over(Window.partitionBy("source").orderBy("pos", "id"))).where(F.col("turn") <= max(1, k))
    phase = (F.col("turn") > quota).cast("int")
    return d.withColumn("phase", phase).orderBy("phase", "place", "turn").limit(k)


def external_rerank(df: DataFrame, relevance: Column, structural: Column, floor: float = 0.15) -> DataFrame:
    """Rows by an outside relevance; below the floor they go; structural rows get at least 0.3 times their boost."""
    s = F.when(structural > 1, F.greatest(relevance, F.lit(0.3)) * structural).otherwise(relevance)
    return df.withColumn("score", F.round(s, 6)).where(F.col("score") >= floor)


def lexical_relevance(words: Column, query_words: Sequence[str]) -> Column:
    """The offline stand-in for a cross-encoder: the share of query words in a text."""
    q = F.array(*(F.lit(w) for w in query_words))
    return F.size(F.array_intersect(words, q)) / F.lit(max(1, len(set(query_words))))


def missing(df: DataFrame, column: str, requested: Sequence[str]) -> DataFrame:
    """Which requested values no row has."""
    have = df.agg(F.collect_set(F.when(F.col(column).isin(list(requested)), F.col(column))).alias("have"))
    return have.select(F.array_except(F.array(*(F.lit(x) for x in requested)), "have").alias("missing"))


def strict_scope(df: DataFrame, requested: Sequence[str]) -> DataFrame:
    """After the penalty: only rows of a requested scope, or all where there is none. No request keeps all."""
    return scope_or_all(df, same_scope(F.col("scope"), requested)) if requested else df


def normalized_rows(df: DataFrame) -> DataFrame:
    """Rows of (id, content, metadata, similarity, score, source_layer, source_type), whatever of them is there,
    with their kinds and defaults; source_id comes from the metadata (a map)."""
    have = set(df.columns)
    text = lambda c, d: F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit(d)) if c in have else F.lit(d)
    number = lambda c: F.coalesce(F.try_to_number(F.col(c), F.lit("S9999999999D999999999")).cast("double"), F.lit(0.0)) if c in have and dict(df.dtypes)[c] == "string" else F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in have else F.lit(0.0)
    meta = F.coalesce(F.col("metadata"), F.create_map().cast("map<string,string>")) if "metadata" in have else F.create_map().cast("map<string,string>")
    return df.select(text("id", "").alias("id"), text("content", "").alias("content"), meta.alias("metadata"), number("similarity").alias("similarity"), number("score").alias("score"), text("source_layer", "hybrid").alias("source_layer"), text("source_type", "content_chunk").alias("source_type"), F.try_element_at(meta, F.lit("source_id")).alias("source_id"))


def retrieval_items(rows: DataFrame) -> DataFrame:
    """(source, content, score, metadata) of rows with content: score falls back to similarity, a blank id to the
    row's source; the fields that tell a row's trace and owner join its metadata (a map)."""
    have = set(rows.columns)
    trace = [c for c in ("source_layer", "source_type", "similarity", "scope_penalized", "tenant_id", "institution_id", "id") if c in have]
    more = F.map_filter(F.create_map(*(x for c in trace for x in (F.lit(c), F.col(c).cast("string")))), lambda k, v: v.isNotNull())
    meta = F.coalesce(F.col("metadata"), F.create_map().cast("map<string,string>")) if "metadata" in have else F.create_map().cast("map<string,string>")
    # a field of the row goes before the metadata's own
    merged = F.map_concat(F.map_filter(meta, lambda k, v: ~F.array_contains(F.map_keys(more), k)), more)
    source = F.coalesce(F.nullif(F.col("id").cast("string"), F.lit("")), *([F.col("source").cast("string")] if "source" in have else []), F.lit("R"))
    score = F.coalesce(F.nullif(F.col("score").cast("double"), F.lit(0.0)), F.col("similarity").cast("double"), F.lit(0.0))
    return rows.where(F.trim(F.coalesce("content", F.lit(""))) != "").select(source.alias("source"), F.trim("content").alias("content"), score.alias("score"), merged.alias("metadata"))


# Metadata that filters ask for at the top level.
FILTER_KEYS = ("source_standard", "clause_id", "scope", "chunk_role", "doc_section_type", "is_toc", "is_frontmatter", "is_normative_body", "retrieval_eligible", "structure_eligible")


def persistence_rows(chunks: DataFrame) -> DataFrame:
    """Chunks as rows of the chunk store: either spelling of a column's name is taken, owners fall back to the
    metadata (a map), whose filter keys are lifted beside the nested original."""
    have = set(chunks.columns)

    def either(kind, default, *names):
        found = [F.col(c).cast(kind) for c in names if c in have]
        return F.coalesce(*found, F.lit(default).cast(kind)) if default is not None else F.coalesce(*found) if found else F.lit(None).cast(kind)

    meta = F.coalesce(F.col("metadata"), F.create_map().cast("map<string,string>")) if "metadata" in have else F.create_map().cast("map<string,string>")
    own = lambda name, *names: F.coalesce(F.nullif(either("string", None, *names), F.lit("")), F.try_element_at(meta, F.lit(name))).alias(name)
    lifted = F.map_filter(meta, lambda k, v: k.isin(*FILTER_KEYS))
    return chunks.select(
        either("string", None, "id", "chunkId", "chunk_id").alias("id"), either("string", None, "sourceId", "source_id").alias("source_id"), either("string", "", "content").alias("content"),
        either("int", 0, "chunkIndex", "chunk_index").alias("chunk_index"), either("int", 1, "filePageNumber", "file_page_number").alias("file_page_number"),
        F.struct(F.struct(meta.alias("metadata"), F.lit("content_chunk").alias("source_layer")).alias("row"), lifted.alias("filters")).alias("metadata"),
        own("institution_id", "institutionId", "institution_id"), own("collection_id", "collectionId", "collection_id"), either("boolean", False, "isGlobal", "is_global").alias("is_global"), either("string", None, "semanticContext", "semantic_context").alias("semantic_context"),
    )


def missing_clauses(df: DataFrame, column: str, requested: Sequence[str], least: int) -> DataFrame:
    """Which requested clauses no row has in its array, told only if at least so many are missing. A least of 0 tells none."""
    wanted = [c.strip() for c in dict.fromkeys(requested) if c.strip()]
    if least <= 0 or not wanted:
        return df.sparkSession.createDataFrame([([],)], "missing array<string>")
    lack = [F.when(~F.coalesce(F.max(F.array_contains(column, c)), F.lit(False)), F.lit(c)) for c in wanted]
    gone = df.agg(F.array_compact(F.array(*lack)).alias("gone"))
    return gone.select(F.when(F.size("gone") >= least, F.col("gone")).otherwise(F.array().cast("array<string>")).alias("missing"))


def reranked_first(df: DataFrame, relevance: Column, structural: Column, k: int, candidates: int = 50) -> DataFrame:
    """The best candidates by an outside relevance, lifted by their structural boost, then all others in their
    order. relevance is null for a row that the outside model left out; place tells the order from 1."""
    before = Window.orderBy(F.desc("score"), "id")
    d = top_rows(df, candidates + k).withColumn("__at", F.row_number().over(before))
    s = F.when(structural > 1, F.greatest(relevance, F.lit(0.3)) * structural).otherwise(relevance)
    d = d.withColumn("relevance", F.when((F.col("__at") <= candidates) & relevance.isNotNull(), F.round(s, 6)))
    w = Window.orderBy(F.col("relevance").isNull(), F.desc("relevance"), "__at")
    return d.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).drop("__at")


def top_rows(df: DataFrame, n: int) -> DataFrame:
    return df.orderBy(F.desc("score"), "id").limit(n)
