"""Queries of fusion, reranking, filtering and coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.catalog import query
from lodestar.functions import text as X
from lodestar.operators import policy as P
from lodestar.plans import binding as B


@query("rrf_merge", "WITH l AS (SELECT l_suppkey AS list_no, l_linenumber AS pos, l_partkey AS id FROM lineitem), g AS (SELECT id, round(sum(1.0 / (60 + pos)), 6) AS score, min((list_no, pos)) AS f FROM l GROUP BY id) SELECT id, score FROM g ORDER BY score DESC, f, id LIMIT 50")
def rrf_merge(spark, sf):
    l = B.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("list_no"), F.col("l_linenumber").alias("pos"), F.col("l_partkey").alias("id"))
    return P.rrf_merge(l, 60, 50).select("id", "score")


@query("min_score_bypass", f"WITH {B.HITS} SELECT id, score FROM h WHERE space = 'F' OR similarity >= 0.7")
def min_score_bypass(spark, sf):
    return P.min_score(B.hits(spark, sf), 0.7, F.when(F.col("space") == "F", "rrf").otherwise("cosine")).select("id", "score")


@query("scope_penalty", f"WITH {B.HITS} SELECT id, scope NOT IN ('s1', 's2') AS scope_penalized, CASE WHEN scope IN ('s1', 's2') THEN score ELSE score * 0.75 END AS score FROM h")
def scope_penalty(spark, sf):
    return P.scope_penalty(B.hits(spark, sf), ["s1", "s2"]).select("id", "scope_penalized", "score")


@query("scope_penalty_ratio", f"WITH {B.HITS} SELECT round(avg(CASE WHEN scope IN ('s1', 's2') THEN 0.0 ELSE 1.0 END), 4) AS penalty_ratio FROM h")
def scope_penalty_ratio(spark, sf):
    return P.penalty_ratio(B.hits(spark, sf), ["s1", "s2"])


@query("round_robin_stratify", f"WITH {B.HITS}, b AS (SELECT id, scope, score, CASE scope WHEN 's3' THEN 1 WHEN 's1' THEN 2 ELSE 3 END AS bucket FROM h), r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY score DESC, id) AS turn FROM b) SELECT id, scope, score, turn::INT AS turn FROM r ORDER BY (bucket > 2)::INT, turn, bucket, id LIMIT 30")
def round_robin_stratify(spark, sf):
    return P.stratify(B.hits(spark, sf), ["s3", "s1"], 30).select("id", "scope", "score", "turn")


@query(
    "gravity_rerank",
    f"""WITH {B.HITS}, w AS (SELECT *, CASE authority WHEN 'administrative' THEN 3.0 WHEN 'constitution' THEN 3.0 WHEN 'policy' THEN 2.0 WHEN 'canonical' THEN 1.0 ELSE 0.0 END AS wt FROM h),
    r AS (SELECT id, round(similarity * (wt * CASE source_layer WHEN 'personal' THEN 1.15 WHEN 'tenant' THEN 1.08 ELSE 1.0 END * CASE WHEN is_constitutional THEN 3.0 ELSE 1.0 END * CASE WHEN is_summary THEN 1.4 ELSE 1.0 END), 6) AS raw FROM w WHERE (wt <> 0 OR is_constitutional OR is_summary) AND similarity >= 0.1)
    SELECT id, raw, round((raw - (SELECT min(raw) FROM r)) / ((SELECT max(raw) FROM r) - (SELECT min(raw) FROM r)), 6) AS score FROM r ORDER BY raw DESC, id LIMIT 15""",
)
def gravity_rerank(spark, sf):
    return P.gravity_rerank(B.hits(spark, sf), P.STRICT, True, 15).select("id", "raw", "score")


@query("late_fusion_quota", "WITH d AS (SELECT ['chunks', 'graph', 'summary'][(l_linenumber % 3 + 1)::INT] AS source, l_partkey AS id, l_orderkey * 10 + l_linenumber AS pos FROM lineitem), p AS (SELECT *, CASE source WHEN 'chunks' THEN 1 WHEN 'graph' THEN 2 ELSE 3 END AS place FROM d), o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY place, pos) AS r FROM p) WHERE r = 1), t AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY pos, id) AS turn FROM o) SELECT source, id, turn::INT AS turn FROM t ORDER BY (turn > CASE source WHEN 'chunks' THEN 3 WHEN 'graph' THEN 2 ELSE 1 END)::INT, place, turn LIMIT 12")
def late_fusion_quota(spark, sf):
    names = F.array(F.lit("chunks"), F.lit("graph"), F.lit("summary"))
    d = B.table(spark, sf, "lineitem").select(F.element_at(names, (F.col("l_linenumber") % 3 + 1).cast("int")).alias("source"), F.col("l_partkey").alias("id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"))
    return P.late_fusion(d, {"chunks": 3, "graph": 2, "summary": 1}, 12).select("source", "id", "turn")


@query("dedupe_md5", "WITH k AS (SELECT doc_id AS id, n_chars AS score, md5(lower(regexp_replace(trim(coalesce(text, '')), '\\s+', ' ', 'g'))) AS key FROM documents) SELECT id, score FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, id) AS r FROM k) WHERE r = 1")
def dedupe_md5(spark, sf):
    d = B.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), F.col("n_chars").alias("score"))
    return P.dedupe_content(d).select("id", "score")


@query("coverage_missing", f"WITH {B.HITS} SELECT string_agg(x, ',' ORDER BY x) AS missing FROM (VALUES ('s0'), ('s1'), ('x1'), ('x2')) t(x) WHERE x NOT IN (SELECT scope FROM h)")
def coverage_missing(spark, sf):
    return P.missing(B.hits(spark, sf), "scope", ["s0", "s1", "x1", "x2"]).select(F.array_join(F.sort_array("missing"), ",").alias("missing"))


@query("scope_filter_fallback", f"WITH {B.HITS} SELECT 'absent' AS asked, count(*) AS n, round(sum(score), 4) AS total FROM h UNION ALL SELECT 's2', count(*), round(sum(score), 4) FROM h WHERE scope = 's2'")
def scope_filter_fallback(spark, sf):
    h = B.hits(spark, sf)
    total = lambda s: P.scope_or_all(h, F.col("scope") == s).agg(F.lit(s).alias("asked"), F.count("*").alias("n"), F.round(F.sum("score"), 4).alias("total"))
    return total("absent").unionByName(total("s2"))


@query("layer_histogram", f"WITH {B.HITS} SELECT source_layer, count(*) AS n FROM h GROUP BY source_layer")
def layer_histogram(spark, sf):
    return B.hits(spark, sf).groupBy("source_layer").agg(F.count("*").alias("n"))


@query("lexical_rerank", "WITH d AS (SELECT doc_id AS id, len(list_distinct(list_filter(regexp_extract_all(lower(coalesce(text, '')), '[0-9a-zà-öø-ÿ]+'), lambda x: x IN ('mit', 'license', 'the')))) / 3.0 AS r FROM documents) SELECT id, round(r, 6) AS score FROM d WHERE round(r, 6) >= 0.15")
def lexical_rerank(spark, sf):
    d = B.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    r = P.lexical_relevance(X.tokens(F.col("text")), ["mit", "license", "the"])
    return P.external_rerank(d, r, F.lit(1.0)).select("id", "score")
