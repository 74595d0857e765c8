"""Queries of vector, text and hybrid retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.catalog import ORACLES, query
from lodestar.functions import fulltext as FT
from lodestar.operators import blocks as BL
from lodestar.operators import indexed
from lodestar.operators import search as S
from lodestar.plans import binding as B

_TOK = "regexp_extract_all(lower(coalesce(content, '')), '[0-9a-zà-öø-ÿ]+')"
_TF = lambda t: f"len(list_filter(tok, lambda x: x = '{t}'))"


def _rank(terms):
    total = " + ".join(f"round({_TF(t)} / ({_TF(t)} + 1.2), 6)" for t in terms)
    every = " AND ".join(f"{_TF(t)} > 0" for t in terms)
    return f"CASE WHEN {every} THEN round({total}, 6) END"


def _covers(name: str, terms: list[str], source: str = "c", stemmed: bool = False) -> str:
    """CTEs that end in name(id, rank): cover density of all terms over the source's (id, content)."""
    w = f"CASE WHEN length(regexp_replace(w, '{FT.ENDING}', '')) >= {FT.STEM_LETTERS} THEN regexp_replace(w, '{FT.ENDING}', '') ELSE w END" if stemmed else "w"
    some = ", ".join(f"'{t}'" for t in terms)
    last = lambda v, x: ", ".join(f"max(CASE WHEN w = '{t}' THEN {v} END) OVER o AS {x}{k}" for k, t in enumerate(terms))
    least = lambda x: f"least({', '.join(f'{x}{k}' for k in range(len(terms)))})"
    every = " AND ".join(f"l{k} IS NOT NULL" for k in range(len(terms)))
    over = "(PARTITION BY id ORDER BY p ROWS UNBOUNDED PRECEDING)"
    return f"""{name}_w AS (SELECT id, unnest(tok) AS w, unnest(range(len(tok))) AS p FROM (SELECT id, {_TOK} AS tok FROM {source})),
    {name}_h AS (SELECT id, p, w, row_number() OVER (PARTITION BY id ORDER BY p) AS e FROM (SELECT id, p, {w} AS w FROM {name}_w) WHERE w IN ({some})),
    {name}_l AS (SELECT id, p, e, {last('p', 'l')}, {last('e', 'e')} FROM {name}_h WINDOW o AS {over}),
    {name}_c AS (SELECT id, p, e, {least('l')} AS b, {least('e')} AS f FROM {name}_l WHERE {every}),
    {name}_d AS (SELECT *, max(b) OVER (PARTITION BY id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM {name}_c),
    {name} AS (SELECT id, round(sum(0.1 / (1 + (p - b) - (e - f))), 6) AS rank FROM {name}_d WHERE before IS NULL OR b > before GROUP BY id)"""


_WORDS = ["the", "of", "and"]


@query("vector_topk", f"WITH {B.VECTORS} SELECT id, {B.SIM} AS similarity FROM v, q WHERE {B.SIM} > 0.1 ORDER BY similarity DESC, id LIMIT 25")
def vector_topk(spark, sf):
    return S.vector_hits(B.vectors(spark, sf), B.query_vector(spark, sf), 25, 0.1).select("id", "similarity")


@query("vector_threshold_scoped", f"WITH {B.VECTORS} SELECT id, scope, {B.SIM} AS similarity FROM v, q WHERE {B.SIM} >= 0.05 AND (tenant_id = 1 OR is_global) AND (scope = 'scope-1' OR contains(scope, 'scope-1') OR scope = 'scope-0' OR contains(scope, 'scope-0')) ORDER BY similarity DESC, id LIMIT 30")
def vector_threshold_scoped(spark, sf):
    c = S.scoped(B.vectors(spark, sf), 1, ["scope-1", "scope-0"])
    return S.vector_hits(c, B.query_vector(spark, sf), 30, 0.05, inclusive=True).select("id", "scope", "similarity")


@query("text_rank_topk", f"WITH {B.CHUNKS}, {_covers('r', _WORDS)} SELECT id, rank AS text_rank FROM r ORDER BY text_rank DESC, id LIMIT 40")
def text_rank_topk(spark, sf):
    return S.text_hits(B.chunks(spark, sf), B.QUERY_TEXT, 40).select("id", "text_rank")


@query("stemmed_rank", f"WITH c AS (SELECT doc_id AS id, text AS content FROM documents), {_covers('r', [FT.stem_text(w) for w in ('licenses', 'apaches')], stemmed=True)} SELECT id, rank AS text_rank FROM r ORDER BY text_rank DESC, id LIMIT 40")
def stemmed_rank(spark, sf):
    d = B.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    return S.text_hits(d, "de los licenses apaches", 40, stemmed=True).select("id", "text_rank")


_TEXTS = "c AS (SELECT doc_id AS id, text AS content FROM documents)"


@query("search_box", f"WITH {_TEXTS}, {_covers('x', ['apache', 'license'])}, {_covers('y', ['of', 'the'])}, t AS (SELECT id, ' ' || array_to_string({_TOK}, ' ') || ' ' AS line FROM c) SELECT id, greatest(CASE WHEN contains(line, ' apache license ') THEN x.rank END, y.rank) AS text_rank FROM t LEFT JOIN x USING (id) LEFT JOIN y USING (id) WHERE (contains(line, ' apache license ') OR y.rank IS NOT NULL) AND NOT contains(line, ' mit ') ORDER BY 2 DESC, 1 LIMIT 60")
def search_box(spark, sf):
    d = B.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    return S.text_hits(d, '"Apache License" or of the -mit', 60).select("id", "text_rank")


@query("term_frequency_topk", f"WITH {B.CHUNKS}, t AS (SELECT id, {_TOK} AS tok FROM c) SELECT id, {_rank(_WORDS)} AS text_rank FROM t WHERE {_rank(_WORDS)} IS NOT NULL ORDER BY text_rank DESC, id LIMIT 40")
def term_frequency_topk(spark, sf):
    return S.words_hits(B.chunks(spark, sf), B.QUERY_TEXT, 40).select("id", "text_rank")


@query("literal_match", "SELECT doc_id AS id FROM documents WHERE contains(lower(text), 'apache license') ORDER BY doc_id LIMIT 40")
def literal_match(spark, sf):
    d = B.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    return S.literal_hits(d, "Apache License", 40).select("id")


def _fused(channels, n, extra=""):
    """CTE f(id, score, similarity): channels (CTE, value column, weight) of n rows each fused by ranks."""
    rows = " UNION ALL ".join(f"SELECT id, v, {w} / (60 + row_number() OVER (ORDER BY v DESC, id)) AS s FROM (SELECT id, {v} AS v FROM {t} ORDER BY v DESC, id LIMIT {n})" for t, v, w in channels)
    return f"u AS ({rows}), f AS (SELECT id, round(sum(s), 6) AS score, greatest(max(v), 0.0) AS similarity FROM u GROUP BY id)"


_HYBRID = f"""WITH {B.CHUNKS}, vh AS (SELECT id, {B.SIM} AS sim FROM c, q WHERE {B.SIM} > 0.0), {_covers('es', _WORDS, stemmed=True)}, {_covers('ex', _WORDS)},
{_fused([('vh', 'sim', 0.7), ('es', 'rank', 0.3), ('ex', 'rank', 0.2)], 40)}
SELECT id, score, similarity FROM f ORDER BY score DESC, similarity DESC, id LIMIT 40"""


@query("hybrid_rrf", _HYBRID)
def hybrid_rrf(spark, sf):
    return S.hybrid(B.chunks(spark, sf), B.query_vector(spark, sf), B.QUERY_TEXT, 40, 0.0)


_IDENTIFIED = f"""WITH {B.CHUNKS}, vh AS (SELECT id, {B.SIM} AS sim FROM c, q WHERE {B.SIM} > 0.0), {_covers('es', ['mit2', '0'], stemmed=True)}, {_covers('ex', ['mit2', '0'])},
li AS (SELECT id, 1.0 AS one FROM c WHERE contains(lower(coalesce(content, '')), 'mit2.0') OR contains(lower(coalesce(scope, '')), 'mit2.0')),
{_fused([('vh', 'sim', 0.7), ('es', 'rank', 0.2), ('ex', 'rank', 0.48), ('li', 'one', 0.35)], 40)}
SELECT id, score, similarity FROM f ORDER BY score DESC, similarity DESC, id LIMIT 40"""


@query("hybrid_identifier", _IDENTIFIED)
def hybrid_identifier(spark, sf):
    return S.hybrid(B.chunks(spark, sf), B.query_vector(spark, sf), "mit2.0", 40, 0.0)


_SECURE = f"""WITH {B.CHUNKS}, m AS (SELECT * FROM c WHERE tenant_id = 1 OR is_global), vh AS (SELECT id, {B.SIM} AS sim FROM m, q WHERE {B.SIM} > 0.0), {_covers('th', ['the'], 'm')},
{_fused([('vh', 'sim', 1.0), ('th', 'rank', 1.0)], 20)} SELECT id, score FROM f ORDER BY score DESC, id LIMIT 10"""


@query("tenant_secure_rrf", _SECURE)
def tenant_secure_rrf(spark, sf):
    S.require_tenant(1)
    c = S.scoped(B.chunks(spark, sf), 1)
    sim = S.similarity(F.col("embedding"), B.query_vector(spark, sf))
    rank = S.cover_rank(F.col("content"), S.text_query("the"))
    fused = S.fused_channels(c, [("vector", 1.0, F.when(sim > 0.0, sim)), ("text", 1.0, rank)], 20)
    return S.top(fused.select("id", "score"), 10, F.desc("score"), F.col("id"))


@query("layered_rrf", f"WITH {B.VECTORS}, s AS (SELECT id, ['tenant', 'global', 'personal'][(label % 3 + 1)::INT] AS layer, {B.SIM} AS s FROM v, q), r AS (SELECT *, row_number() OVER (PARTITION BY layer ORDER BY s DESC, id) AS rank FROM s WHERE s > 0.0) SELECT id, layer, round(sum(1.0 / (60 + rank)), 6) AS score FROM r WHERE rank <= 15 GROUP BY id, layer")
def layered_rrf(spark, sf):
    layer = F.element_at(F.array(F.lit("tenant"), F.lit("global"), F.lit("personal")), (F.col("label") % 3 + 1).cast("int"))
    return S.layered_rrf(B.vectors(spark, sf), B.query_vector(spark, sf), layer, 15, 0.0)


@query("weighted_hybrid", f"WITH {B.CHUNKS}, t AS (SELECT id, embedding, {_TOK} AS tok FROM c), s AS (SELECT id, {B.SIM} AS sim, {_rank(['the', 'of', 'and'])} AS r FROM t, q) SELECT id, round(0.7 * coalesce(sim, 0) + 0.3 * least(coalesce(r, 0), 1.0), 6) AS score FROM s WHERE sim IS NOT NULL OR r IS NOT NULL ORDER BY score DESC, id LIMIT 30")
def weighted_hybrid(spark, sf):
    return S.weighted_sum(B.chunks(spark, sf), B.query_vector(spark, sf), B.QUERY_TEXT, 30)


@query("batch_topk_per_query", f"WITH {B.VECTORS}, qs AS (SELECT id AS query_id, embedding AS qe2 FROM v WHERE id < 8), s AS (SELECT query_id, id, round(list_cosine_similarity(embedding, qe2), 6) AS similarity FROM v, qs), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM s WHERE similarity > 0.1) SELECT query_id, rank::INT AS rank, id, similarity FROM r WHERE rank <= 10")
def batch_topk_per_query(spark, sf):
    v = B.vectors(spark, sf)
    return S.batch_vector_topk(v, v.where("id < 8").select(F.col("id").alias("query_id"), F.col("embedding").alias("query")), 10, 0.1)


@query("block_topk_per_query", f"WITH {B.VECTORS}, s AS (SELECT a.id AS query_id, b.id, round(list_cosine_similarity(a.embedding, b.embedding), 6) AS similarity FROM v a, v b), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM s WHERE similarity > 0.1) SELECT query_id, rank::INT AS rank, id, similarity FROM r WHERE rank <= 5")
def block_topk_per_query(spark, sf):
    """Every vector asks for its nearest ones."""
    v = B.vectors(spark, sf)
    q = v.select(F.col("id").alias("query_id"), F.col("embedding").alias("query"))
    hits = BL.block_topk(v, q, 5, 0.1).where("similarity > 0.1")
    r = hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")))
    return r.where("rank <= 5").select("query_id", "rank", "id", "similarity")


@query("keyset_page", f"WITH {B.VECTORS}, s AS (SELECT id, {B.SIM} AS score FROM v, q), p AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS n FROM s WHERE score < 0.25 OR (score = 0.25 AND id > 10)) SELECT id, score, (SELECT count(*) FROM p) > 20 AS has_more FROM p WHERE n <= 20")
def keyset_page(spark, sf):
    s = B.vectors(spark, sf).select("id", S.similarity(F.col("embedding"), B.query_vector(spark, sf)).alias("score"))
    return S.keyset_page(s, 20, (0.25, 10))


@query("union_boost", f"WITH {B.CHUNKS}, s AS (SELECT id, content, label, {B.SIM} AS sim, contains(lower(content), 'license') AS has FROM c, q) SELECT * FROM (SELECT id, 'text' AS kind, round(0.7 * sim + CASE WHEN has THEN 0.3 ELSE 0.0 END, 6) AS score, NULL::VARCHAR AS payload FROM s WHERE label % 2 = 0 AND sim >= 0.05 UNION ALL SELECT id, 'visual', round(0.6 * coalesce(sim, 0) + CASE WHEN has THEN 0.4 ELSE 0.0 END, 6), CASE WHEN sim >= 0.35 THEN left(content, 40) END FROM s WHERE label % 2 = 1 AND (sim >= 0.05 OR has)) ORDER BY score DESC NULLS LAST, kind, id LIMIT 30")
def union_boost(spark, sf):
    c = B.chunks(spark, sf)
    return S.union_boost(c.where("label % 2 = 0"), c.where("label % 2 = 1"), B.query_vector(spark, sf), "license", 30, 0.05)


_MODES = {"global": "is_global", "institution": "tenant_id = 1 AND NOT is_global", "private": "label = 5 AND NOT is_global", "hybrid_institution": "is_global OR tenant_id = 1", "hybrid_private": "is_global OR label = 5", "other": "false"}


@query("scope_mode_case", f"WITH {B.VECTORS} " + " UNION ALL ".join(f"SELECT '{k}' AS mode, count(*) AS n, sum(id)::BIGINT AS ids FROM v WHERE {p}" for k, p in _MODES.items()))
def scope_mode_case(spark, sf):
    v = B.vectors(spark, sf)
    let = {m: S.scope_mode(m, 1, F.col("label") == 5, F.col("tenant_id"), F.col("is_global")) for m in _MODES}
    sums = v.agg(F.array(*(F.struct(F.lit(m).alias("mode"), F.count_if(p).alias("n"), F.sum(F.when(p, F.col("id"))).alias("ids")) for m, p in let.items())).alias("x"))
    return sums.select(F.inline("x"))


@query("scope_quota", f"WITH {B.VECTORS}, s AS (SELECT id, scope, {B.SIM} AS similarity FROM v, q), r AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY similarity DESC, id) AS n FROM s) SELECT id, scope, similarity FROM r WHERE n <= 10")
def scope_quota(spark, sf):
    v = B.vectors(spark, sf).select("id", "scope", S.similarity(F.col("embedding"), B.query_vector(spark, sf)).alias("similarity"))
    return S.scope_quota(v, F.col("scope"), S.fan_out_quota(40, 10), F.desc("similarity"), F.col("id"))


@query("anchor_best_of_many", f"WITH {B.VECTORS}, qs AS (SELECT embedding AS qe2 FROM v WHERE id IN (1, 2, 3)) SELECT id, max(round(list_cosine_similarity(embedding, qe2), 6)) AS score FROM v, qs GROUP BY id HAVING score >= 0.2 ORDER BY score DESC, id LIMIT 12")
def anchor_best_of_many(spark, sf):
    v = B.vectors(spark, sf)
    qs = [[float(x) for x in r[0]] for r in v.where("id in (1, 2, 3)").select("embedding").collect()]
    best = F.greatest(*(S.similarity(F.col("embedding"), q) for q in qs)) if len(qs) > 1 else S.similarity(F.col("embedding"), qs[0])
    return S.top(v.select("id", best.alias("score")).where("score >= 0.2"), 12, F.desc("score"), F.col("id"))


@query("novelty_paging", "WITH r AS (SELECT row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS rank, o_custkey AS key FROM orders), p AS (SELECT *, (rank - 1) // 40 AS page FROM r), f AS (SELECT page, count(*) AS fresh FROM (SELECT key, min(page) AS page FROM p GROUP BY key) GROUP BY page), a AS (SELECT p.page, count(*) AS rows, coalesce(any_value(f.fresh), 0) AS fresh FROM p LEFT JOIN f USING (page) GROUP BY p.page), s AS (SELECT *, sum(fresh) OVER (ORDER BY page)::BIGINT AS seen FROM a), b AS (SELECT *, coalesce(max(CASE WHEN fresh / rows < 0.1 OR seen >= 120 THEN 1 ELSE 0 END) OVER (ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped FROM s) SELECT page, rows, fresh, seen FROM b WHERE stopped = 0")
def novelty_paging(spark, sf):
    from pyspark.sql.window import Window

    o = B.table(spark, sf, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(4000)
    r = o.select(F.row_number().over(Window.orderBy(F.desc("o_orderdate"), "o_orderkey")).alias("rank"), F.col("o_custkey").alias("key"))
    return S.novelty_pages(r, 40, 120)


_QUERIES = [("the and", 0), ("", 1), ("of license", 2)]


@query(
    "batch_hybrid",
    f"WITH {B.CHUNKS}, "
    + ", ".join(_covers(f"k{i}", [FT.stem_text(w) for w in t.split()], stemmed=True) for i, (t, _) in enumerate(_QUERIES, 1) if t)
    + ", s AS ("
    + " UNION ALL ".join(f"SELECT {i} AS query_id, id, round(list_cosine_similarity(embedding, (SELECT embedding FROM v WHERE id = {x})), 6) AS sim FROM c" for i, (_, x) in enumerate(_QUERIES, 1))
    + "), k AS ("
    + " UNION ALL ".join(f"SELECT {i} AS query_id, id, rank FROM k{i}" for i, (t, _) in enumerate(_QUERIES, 1) if t)
    + """), a AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS r FROM s WHERE sim > 0.05), b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank DESC, id) AS r FROM k),
    f AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.id, b.id) AS id, sim, rank, round(coalesce(1.0 / (60 + a.r), 0) + coalesce(1.0 / (60 + b.r), 0), 6) AS score FROM (SELECT * FROM a WHERE r <= 20) a FULL JOIN (SELECT * FROM b WHERE r <= 20) b ON a.query_id = b.query_id AND a.id = b.id)
    SELECT query_id, id, coalesce(sim, 0.0) AS similarity, coalesce(rank, 0.0) AS text_rank, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rn FROM f) WHERE rn <= 10""",
)
def batch_hybrid(spark, sf):
    return S.batch_hybrid(B.chunks(spark, sf), [(t, B.query_vector(spark, sf, x)) for t, x in _QUERIES], 10, 0.05)


_PATHS = "'root.' || (label % 3) || '.' || label"


def _paths(spark, sf):
    return B.chunks(spark, sf).withColumn("path", F.concat(F.lit("root."), (F.col("label") % 3).cast("string"), F.lit("."), F.col("label").cast("string")))


@query("hierarchical_search", f"WITH {B.CHUNKS}, m AS (SELECT * FROM c WHERE {_PATHS} = 'root.1' OR starts_with({_PATHS}, 'root.1.')), vh AS (SELECT id, {B.SIM} AS sim FROM m, q WHERE {B.SIM} > 0.0), {_covers('th', ['the'], 'm', stemmed=True)}, {_fused([('vh', 'sim', 1.0), ('th', 'rank', 1.0)], 30)} SELECT f.id, coalesce(a.v, 0.0) AS similarity, coalesce(b.v, 0.0) AS text_rank, score FROM f LEFT JOIN (SELECT id, sim AS v FROM vh ORDER BY v DESC, id LIMIT 30) a USING (id) LEFT JOIN (SELECT id, rank AS v FROM th ORDER BY v DESC, id LIMIT 30) b USING (id) ORDER BY score DESC, id LIMIT 15")
def hierarchical_search(spark, sf):
    return S.hierarchical(_paths(spark, sf), B.query_vector(spark, sf), "the", 15, 0.0, "root.1")


@query("scoped_subtree_vectors", f"WITH {B.CHUNKS} SELECT id, {B.SIM} AS similarity FROM c, q WHERE ({_PATHS} = 'root.2' OR starts_with({_PATHS}, 'root.2.')) AND {B.SIM} > 0.0 ORDER BY similarity DESC, id LIMIT 20")
def scoped_subtree_vectors(spark, sf):
    return S.scoped_vectors(_paths(spark, sf), B.query_vector(spark, sf), 20, 0.0, "root.2").select("id", "similarity")


@query("filtered_vectors", f"WITH {B.VECTORS} SELECT id, {B.SIM} AS similarity FROM v, q WHERE (tenant_id = 1 OR is_global) AND label IN (0, 1, 5) AND id % 2 = 1 AND {B.SIM} > -0.5 ORDER BY similarity DESC, id LIMIT 25")
def filtered_vectors(spark, sf):
    v = B.vectors(spark, sf).withColumn("source_id", F.col("label")).withColumn("user_id", F.col("id") % 2)
    return S.filtered_vectors(v, B.query_vector(spark, sf), 25, -0.5, 1, [0, 1, 5], user_id=1).select("id", "similarity")


@query("summary_search", f"WITH {B.VECTORS} SELECT id, {B.SIM} AS similarity FROM v, q WHERE tenant_id = 1 AND id % 3 > 0 AND {B.SIM} > 0.05 ORDER BY similarity DESC, id LIMIT 5")
def summary_search(spark, sf):
    return S.summary_hits(B.vectors(spark, sf).withColumn("level", F.col("id") % 3), B.query_vector(spark, sf), 1, 5, 0.05).select("id", "similarity")


@query("entity_search", f"WITH {B.VECTORS} SELECT id, {B.SIM} AS similarity FROM v, q WHERE tenant_id = 1 AND {B.SIM} >= 0.1 ORDER BY similarity DESC, id LIMIT 8")
def entity_search(spark, sf):
    return S.entity_hits(B.vectors(spark, sf), B.query_vector(spark, sf), 1, 8, 0.1).select("id", "similarity")


@query("community_search", f"WITH {B.VECTORS} SELECT id, {B.SIM} AS similarity FROM v, q WHERE tenant_id = 2 AND id % 2 = 0 AND {B.SIM} >= 0.0 ORDER BY similarity DESC, id LIMIT 5")
def community_search(spark, sf):
    return S.community_hits(B.vectors(spark, sf).withColumn("level", F.col("id") % 2), B.query_vector(spark, sf), 2, 0, 5, 0.0).select("id", "similarity")


@query("inspect_document", f"WITH {B.CHUNKS}, m AS (SELECT * FROM c WHERE label = 3), vh AS (SELECT id, {B.SIM} AS sim FROM m, q WHERE {B.SIM} > 0.0), {_covers('th', ['the'], 'm', stemmed=True)}, {_fused([('vh', 'sim', 1.0), ('th', 'rank', 1.0)], 40)} SELECT f.id, score, a.v AS vector, b.v AS text FROM f LEFT JOIN (SELECT id, sim AS v FROM vh ORDER BY v DESC, id LIMIT 40) a USING (id) LEFT JOIN (SELECT id, rank AS v FROM th ORDER BY v DESC, id LIMIT 40) b USING (id) ORDER BY score DESC, id LIMIT 20")
def inspect_document(spark, sf):
    return S.inspect_document(B.chunks(spark, sf).withColumn("source_id", F.col("label")), B.query_vector(spark, sf), "the", 20, 0.0, 3)


@query("context_without_boosts", f"WITH {B.CHUNKS}, s AS (SELECT id, label, left(content, 40) AS payload, {B.SIM} AS sim FROM c, q) SELECT id, CASE WHEN label % 2 = 0 THEN 'text' ELSE 'visual' END AS kind, sim AS score, CASE WHEN label % 2 = 1 AND sim >= 0.35 THEN payload END AS payload FROM s WHERE sim >= 0.05 ORDER BY score DESC, kind, id LIMIT 30")
def context_without_boosts(spark, sf):
    c = B.chunks(spark, sf)
    return S.union_plain(c.where("label % 2 = 0"), c.where("label % 2 = 1"), B.query_vector(spark, sf), 30, 0.05)


@query("anchor_selection", "SELECT p_partkey AS id, p_name AS name, 1.0::DOUBLE AS similarity FROM part WHERE lower(trim(p_name)) = lower(trim((SELECT p_name FROM part WHERE p_partkey = 7))) ORDER BY 1 LIMIT 8")
def anchor_selection(spark, sf):
    p = B.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    near = p.select("id", "name", F.lit(0.8).alias("similarity"))
    return S.select_anchors(p, [p.where("id = 7").head().name.upper()], near)


@query("anchor_fallback", "SELECT p_partkey AS id, p_name AS name, round(p_size / 50.0, 4) AS similarity FROM part WHERE p_size >= 40 ORDER BY 3 DESC, 1 LIMIT 8")
def anchor_fallback(spark, sf):
    p = B.table(spark, sf, "part")
    near = p.where("p_size >= 40").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.round(F.col("p_size") / 50.0, 4).alias("similarity"))
    return S.select_anchors(p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")), ["no such name"], near)


# The same results from the indexes, against the SQL of the scans.


@query("text_index_topk", ORACLES["text_rank_topk"])
def text_index_topk(spark, sf):
    return B.text_index(spark, sf).hits(B.QUERY_TEXT, 40)


@query("text_index_box", ORACLES["search_box"])
def text_index_box(spark, sf):
    return B.text_index(spark, sf).hits('"Apache License" or of the -mit', 60)


@query("text_index_stems", ORACLES["stemmed_rank"])
def text_index_stems(spark, sf):
    return B.text_index(spark, sf).hits("de los licenses apaches", 40, stemmed=True)


@query("vector_index_topk", ORACLES["vector_topk"])
def vector_index_topk(spark, sf):
    return B.vector_index(spark, sf).hits(B.query_vector(spark, sf), 25, 0.1).select("id", "similarity")


@query("hybrid_index_rrf", ORACLES["hybrid_rrf"])
def hybrid_index_rrf(spark, sf):
    return indexed.hybrid(B.text_index(spark, sf), B.chunk_vector_index(spark, sf), B.chunks(spark, sf), B.query_vector(spark, sf), B.QUERY_TEXT, 40, 0.0)


@query("hybrid_index_identifier", ORACLES["hybrid_identifier"])
def hybrid_index_identifier(spark, sf):
    return indexed.hybrid(B.text_index(spark, sf), B.chunk_vector_index(spark, sf), B.chunks(spark, sf), B.query_vector(spark, sf), "mit2.0", 40, 0.0)
