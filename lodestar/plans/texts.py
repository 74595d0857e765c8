"""Queries of text functions and ingestion."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.catalog import query
from lodestar.functions import identity as D
from lodestar.functions import text as X
from lodestar.functions import vector as V
from lodestar.operators import ingest as I
from lodestar.plans import binding as B

_NUMBERED = "WITH d AS (SELECT doc_id, coalesce(text, '') || ' clause 4.' || (doc_id % 9) || '.2 of ISO ' || (9000 + doc_id % 5) || ':2015 and 4.' || (doc_id % 9) || '.2' AS text FROM documents)"


def _numbered(spark, sf):
    d = B.table(spark, sf, "documents")
    s = lambda x: x.cast("string")
    return d.select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit(" clause 4."), s(F.col("doc_id") % 9), F.lit(".2 of ISO "), s(9000 + F.col("doc_id") % 5), F.lit(":2015 and 4."), s(F.col("doc_id") % 9), F.lit(".2")).alias("text"))


@query("clause_refs", _NUMBERED + r" SELECT doc_id, len(list_distinct(regexp_extract_all(text, '\b\d+(?:\.\d+)+\b'))) AS n, list_contains(regexp_extract_all(text, '\b\d+(?:\.\d+)+\b'), '4.' || (doc_id % 9) || '.2') AS has_own FROM d")
def clause_refs(spark, sf):
    d = _numbered(spark, sf).withColumn("refs", X.clause_refs(F.col("text")))
    return d.select("doc_id", F.size("refs").cast("long").alias("n"), F.array_contains("refs", F.concat(F.lit("4."), (F.col("doc_id") % 9).cast("string"), F.lit(".2"))).alias("has_own"))


@query("standards", _NUMBERED + r" SELECT doc_id, 'ISO ' || regexp_extract_all(text, '(?i)\bISO\s*[-:]?\s*(\d{4,5})(?::\s*\d{4})?\b', 1)[1] AS standard FROM d")
def standards(spark, sf):
    return _numbered(spark, sf).select("doc_id", F.element_at(X.standards(F.col("text")), 1).alias("standard"))


@query("enriched_prefix", _NUMBERED + r" SELECT doc_id, length('[CLAUSE_ID: ' || regexp_extract(text, '(?i)\b(?:cl[aá]usula\s*)?(\d+(?:\.\d+)+)\b', 1) || ']' || chr(10) || text) AS n FROM d WHERE NOT starts_with(text, '[') AND NOT regexp_matches(text, '(?i)(Ejercicio|Problema|Actividad|Teorema|Lema|Corolario|Proposición|Definición|Ejemplo|Sección|Figura|Imagen|Gráfico)\s+\d')")
def enriched_prefix(spark, sf):
    d = _numbered(spark, sf).where("not startswith(text, '[')").where(~F.col("text").rlike(r"(?i)(Ejercicio|Problema|Actividad|Teorema|Lema|Corolario|Proposición|Definición|Ejemplo|Sección|Figura|Imagen|Gráfico)\s+\d"))
    return d.select("doc_id", F.length(X.tag_prefix(F.col("text"))).cast("long").alias("n"))


@query("chunk_roles", "WITH d AS (SELECT doc_id, coalesce(text, '') AS t, lower(coalesce(text, '')) AS l FROM documents) SELECT CASE WHEN regexp_matches(l, 'all rights reserved|reservados los derechos|copyright|prólogo|prologo|foreword|isbn') AND length(l) <= 2200 THEN 'frontmatter' WHEN regexp_matches(l, 'table of contents|indice|índice|contenido|contents') THEN 'toc' ELSE 'normative_body' END AS role, count(*) AS n FROM d GROUP BY 1")
def chunk_roles(spark, sf):
    return B.table(spark, sf, "documents").groupBy(X.chunk_role(F.col("text")).alias("role")).agg(F.count("*").alias("n"))


@query("fixed_windows", "SELECT doc_id, u.s::BIGINT AS start, length(substr(text, u.s::INT + 1, 1000)) AS n FROM documents, unnest(range(0, greatest(length(text) - 200, 1), 800)) u(s) WHERE length(text) > 0")
def fixed_windows(spark, sf):
    w = I.window_chunks(B.table(spark, sf, "documents"), 1000, 200)
    return w.select("doc_id", F.col("start").cast("long").alias("start"), F.length("content").cast("long").alias("n"))


@query(
    "repeated_lines",
    """WITH d AS (SELECT source AS doc, doc_id AS page, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS l FROM documents WHERE text IS NOT NULL),
    e AS (SELECT doc, page, unnest(list_concat(l[1:2], l[greatest(len(l) - 1, 1):])) AS line FROM d WHERE len(l) > 0),
    n AS (SELECT DISTINCT doc, page, lower(regexp_replace(regexp_replace(line, '\\d+', '#', 'g'), '\\s+', ' ', 'g')) AS line FROM e),
    t AS (SELECT source AS doc, count(DISTINCT doc_id) AS total FROM documents WHERE text IS NOT NULL GROUP BY source)
    SELECT doc, line, count(*) AS pages FROM n JOIN t USING (doc) GROUP BY doc, line, total HAVING count(*) >= greatest(2, ceil(total * 0.05))""",
)
def repeated_lines(spark, sf):
    p = B.table(spark, sf, "documents").where("text is not null").select(F.col("source").alias("doc"), F.col("doc_id").alias("page"), "text")
    return I.repeated_lines(p, 0.05)


@query("page_of_offset", "WITH p AS (SELECT l_orderkey AS doc, l_linenumber AS page, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber)::BIGINT - l_quantity::BIGINT AS start FROM lineitem), o AS (SELECT o_orderkey AS doc, (o_orderkey * 13 % 200)::BIGINT AS pos FROM orders) SELECT o.doc, o.pos, max(p.page)::BIGINT AS page FROM o LEFT JOIN p ON p.doc = o.doc AND p.start <= o.pos GROUP BY o.doc, o.pos")
def page_of_offset(spark, sf):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber")
    p = B.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").cast("long").alias("page"), (F.sum("l_quantity").over(w).cast("long") - F.col("l_quantity").cast("long")).alias("start"))
    o = B.table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc"), (F.col("o_orderkey") * 13 % 200).cast("long").alias("pos"))
    return I.page_of_offset(p, o)


@query("nearest_page", "WITH t AS (SELECT o_orderkey AS task, o_custkey AS doc, o_orderkey % 60 AS wanted FROM orders), p AS (SELECT DISTINCT l_partkey AS doc, l_quantity::BIGINT AS page FROM lineitem) SELECT task, arg_min(page, (CASE WHEN page = wanted THEN 0 WHEN page < wanted THEN 1 ELSE 2 END, abs(page - wanted))) AS page FROM t LEFT JOIN p USING (doc) GROUP BY task")
def nearest_page(spark, sf):
    t = B.table(spark, sf, "orders").select(F.col("o_orderkey").alias("task"), F.col("o_custkey").alias("doc"), (F.col("o_orderkey") % 60).alias("wanted"))
    p = B.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("doc"), F.col("l_quantity").cast("long").alias("page")).distinct()
    return I.nearest_page(t, p)


@query("token_estimate", "SELECT doc_id, greatest(1, (length(coalesce(text, '')) + 3) // 4)::BIGINT AS tokens FROM documents")
def token_estimate(spark, sf):
    return B.table(spark, sf, "documents").select("doc_id", X.token_estimate(F.col("text")).alias("tokens"))


@query("authority_levels", "SELECT p_partkey, CASE WHEN regexp_matches(t, 'rubric|rubrica|evaluation|evaluacion|reglamento|integridad|integrity|grading|calificacion') THEN 'constitution' WHEN regexp_matches(t, 'policy|procedimiento|procedure|programa|admin|calendario|calendar|guia|guide|estructura|structure|horario') THEN 'policy' WHEN regexp_matches(t, 'standard|norma|manual|reference|spec|policy-manual|oficial|official|aprobado|approved') THEN 'canonical' ELSE 'supplementary' END AS level FROM (SELECT p_partkey, lower(p_type || ' ' || p_name || CASE WHEN p_size % 4 = 0 THEN ' Guide' ELSE '' END) AS t FROM part)")
def authority_levels(spark, sf):
    p = B.table(spark, sf, "part")
    return p.select("p_partkey", X.authority(F.col("p_type"), F.col("p_name"), F.when(F.col("p_size") % 4 == 0, "Guide")).alias("level"))


@query("clean_content", "WITH l AS (SELECT page_id, list_filter(list_transform(string_split_regex(coalesce(html, ''), '\\r\\n|\\r|\\n'), lambda x: trim(x, ' ')), lambda x: x <> '' AND NOT regexp_matches(x, '^[|\\s:+=_-]+$')) AS l FROM pages) SELECT page_id, md5(array_to_string(list_filter(list_transform(l, lambda x: trim(regexp_replace(regexp_replace(x, '\\[([^\\]]*)\\]\\([^)]*\\)', '\\1', 'g'), '\\s+', ' ', 'g'), ' ')), lambda x: x <> ''), chr(10))) AS digest FROM l")
def clean_content(spark, sf):
    return B.table(spark, sf, "pages").select("page_id", F.md5(X.clean_content(F.col("html"))).alias("digest"))


@query("safe_filenames", "SELECT c_custkey, regexp_replace(regexp_replace(c_name || ' (' || c_mktsegment || ').pdf', '[^a-zA-Z0-9._-]+', '-', 'g'), '^-+|-+$', '', 'g') AS name FROM customer")
def safe_filenames(spark, sf):
    return B.table(spark, sf, "customer").select("c_custkey", X.safe_filename(F.concat("c_name", F.lit(" ("), "c_mktsegment", F.lit(").pdf"))).alias("name"))


@query("mean_vectors", "SELECT label, k AS component, round(avg(x), 5) AS mean FROM (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding)))::INT AS k FROM embeddings) GROUP BY 1, 2")
def mean_vectors(spark, sf):
    m = V.mean_vectors(B.table(spark, sf, "embeddings"), ["label"])
    return m.select("label", F.posexplode("mean").alias("component", "mean")).withColumn("mean", F.round("mean", 5))


@query("normalized_embeddings", "SELECT vec_id, len(embedding)::INT AS dims, round(embedding[1]::DOUBLE, 5) AS first FROM embeddings")
def normalized_embeddings(spark, sf):
    e = B.table(spark, sf, "embeddings").select("vec_id", F.to_json("embedding").alias("raw"))
    return e.select("vec_id", V.parse_embedding(F.col("raw")).alias("v")).select("vec_id", F.size("v").alias("dims"), F.round(F.element_at("v", 1), 5).alias("first"))


@query("visual_routing", "WITH p AS (SELECT l_orderkey AS doc, l_linenumber AS page, CASE WHEN l_tax > 0.02 THEN 2 ELSE 0 END + CASE WHEN l_quantity > 20 THEN 2 ELSE 0 END AS score FROM lineitem), b AS (SELECT *, least(12, greatest(1, floor(count(*) OVER (PARTITION BY doc) * 0.35))) AS budget, sum((score >= 3)::INT) OVER (PARTITION BY doc ORDER BY page) AS used FROM p) SELECT doc, page, score, score >= 3 AND used <= budget AS visual FROM b")
def visual_routing(spark, sf):
    l = B.table(spark, sf, "lineitem")
    p = l.select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("page"), F.when(F.col("l_tax") > 0.02, 1).otherwise(0).alias("images"), F.col("l_quantity").alias("drawings"), F.lit(0).alias("table_lines"), F.lit(500).alias("chars"))
    return I.visual_routing(p)


@query("document_chunks")
def document_chunks(spark, sf):
    return I.chunked(B.table(spark, sf, "documents")).select("doc_id", "chunk_index", "heading", "role", F.length("content").alias("n_chars"))


@query("section_refs", "SELECT l_orderkey, 'L' || l_linenumber || ':' || l_quantity::INT || ':' || l_returnflag AS ref FROM lineitem")
def section_refs(spark, sf):
    l = B.table(spark, sf, "lineitem")
    return l.select("l_orderkey", D.section_ref(F.col("l_linenumber"), F.col("l_quantity").cast("int"), F.col("l_returnflag")).alias("ref"))


@query("parent_context", "SELECT doc_id, length('[PARENT_CONTEXT]' || chr(10) || 'DOC_TITLE: ' || source || chr(10) || 'TOTAL_SECTIONS: 3' || chr(10) || 'SECTION_PATH: [none]' || chr(10) || '[/PARENT_CONTEXT]' || chr(10) || chr(10) || text) AS n FROM documents WHERE text IS NOT NULL")
def parent_context(spark, sf):
    d = B.table(spark, sf, "documents").where("text is not null")
    return d.select("doc_id", F.length(D.parent_context(F.col("text"), F.lit(""), F.col("source"), F.lit(3))).cast("long").alias("n"))


@query("hash_slots", "SELECT c_custkey, ('0x' || substr(sha1(lower(c_mktsegment)), 1, 8))::BIGINT % 128 AS slot FROM customer")
def hash_slots(spark, sf):
    c = B.table(spark, sf, "customer")
    e = D.hash_embedding(F.col("c_mktsegment"))
    return c.select("c_custkey", (F.array_position(e, F.lit(1.0)) - 1).alias("slot"))


@query("section_tree", "WITH t AS (SELECT l_orderkey AS doc, l_linenumber AS ord, min(1 + l_partkey % 3) AS level, min(l_suppkey) AS page FROM lineitem GROUP BY 1, 2) SELECT doc, ord, lead(page) OVER (PARTITION BY doc ORDER BY ord) AS end_page, (SELECT max(p.ord) FROM t p WHERE p.doc = t.doc AND p.ord < t.ord AND p.level < t.level) AS parent_ord FROM t")
def section_tree(spark, sf):
    from lodestar.operators.graph import document_sections

    t = B.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("ord")).agg(F.min(1 + F.col("l_partkey") % 3).alias("level"), F.min("l_suppkey").alias("page"))
    return document_sections(t).select("doc", "ord", "end_page", "parent_ord")
