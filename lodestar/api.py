"""The engine's entry points: grounded and comprehensive search, explanation, ingestion, batch views."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.functions.text import CLAUSE, tokens
from lodestar.operators import graph, ingest, policy, search

# Limits of a request and the filter keys that callers may not set.
LIMITS = {"k": (1, 100), "fetch_k": (1, 400), "hops": (0, 4), "queries": (1, 8), "rrf_k": (1, 500), "top_n": (1, 50)}
RESERVED = ("tenant_id", "institution_id", "is_global")
_STANDARD = re.compile(r"\bISO\s*[-:]?\s*(\d{4,5})\b", re.I)
_CLAUSE = re.compile(CLAUSE)
_CLAUSE_WORD = re.compile(r"\b(?:cl[aá]usula|clause|numeral|apartado|secci[oó]n)\b", re.I)


def limited(**values: int) -> dict[str, int]:
    """The values, each within its limit, or an error."""
    for k, v in values.items():
        low, high = LIMITS[k]
        if not low <= v <= high:
            raise ValueError(f"{k} must be {low}..{high}")
    return values


def checked_filters(filters: dict | None, allowed: Sequence[str]) -> dict:
    """Filters on allowed keys with scalar values or lists of them."""
    for k, v in (filters or {}).items():
        if k in RESERVED:
            raise ValueError(f"RESERVED_FILTER: {k}")
        if k not in allowed:
            raise ValueError(f"UNKNOWN_FILTER: {k}")
        if not all(isinstance(x, (str, int, float, bool)) for x in (v if isinstance(v, (list, tuple, set)) else [v])):
            raise ValueError(f"SCALAR_FILTER: {k}")
    return dict(filters or {})


@dataclass
class Scope:
    """What a query asks for: standards, clauses, and whether it is ambiguous (a clause without a standard)."""

    standards: list[str]
    clauses: list[str]
    ambiguous: bool


def validate_scope(text: str) -> Scope:
    s = list(dict.fromkeys(f"ISO {x}" for x in _STANDARD.findall(text or "")))
    c = list(dict.fromkeys(_CLAUSE.findall(text or "")))
    return Scope(s, c, bool(c or _CLAUSE_WORD.search(text or "")) and not s)


def clause_near_standard(text: str, standard: str, before: int = 80, after: int = 120) -> str | None:
    """The one clause that stands near a standard's first mention, None if there are several or none."""
    m = re.search(re.escape(standard.strip()), text, re.I) if standard.strip() else None
    if m is None:
        return None
    near = list(dict.fromkeys(_CLAUSE.findall(text[max(0, m.start() - before) : m.end() + after])))
    return near[0] if len(near) == 1 else None


def resolved_filters(text: str, tenant=None, given: dict | None = None) -> dict:
    """Filters of a query: a given standard before those that its words name, and the only clause near a lone standard.
    A tenant, or global rows without one. Several standards come as source_standards, one as source_standard."""
    given = dict(given or {})
    standards = [given["source_standard"]] if given.get("source_standard") else list(given.get("source_standards") or validate_scope(text).standards)
    out: dict = {"tenant_id": tenant} if tenant is not None else {"is_global": True}
    if len(standards) == 1:
        out["source_standard"] = standards[0]
        clause = given.get("clause_id") or clause_near_standard(text, standards[0])
        if clause:
            out["clause_id"] = clause
    elif standards:
        out["source_standards"] = standards
    return out


def suggested_scopes(text: str, keywords: dict[str, Sequence[str]]) -> list[str]:
    """Scopes one of whose keywords the text holds, in the map's order."""
    low = text.strip().lower()
    return [s for s, words in keywords.items() if any(w.lower() in low for w in words)]


def expanded(text: str, hints: Sequence[dict] = ()) -> str:
    """The query with the expansions of hints whose term it holds."""
    low, more = text.lower(), []
    for h in hints:
        if h.get("term", "").lower() in low and h.get("term"):
            more += [x for x in h.get("expand_to", ()) if x.lower() not in low and x not in more]
    return " ".join([text, *more])


@dataclass
class Request:
    text: str
    vector: Sequence[float]
    tenant: object
    k: int = 10
    fetch_k: int = 40
    rrf_k: int = 60
    scopes: Sequence[str] = ()
    filters: dict = field(default_factory=dict)
    penalty: float = 0.25
    least: float | None = None
    #: An inclusive range of times in UTC, of one of TIME_FIELDS.
    since: object = None
    until: object = None
    time_field: str = "created_at"
    #: Only rows of a requested scope, where there are any, after the penalty.
    strict: bool = False


#: Columns that a request's time range may be about.
TIME_FIELDS = ("created_at", "updated_at")


def requested_scopes(request: Request) -> list[str]:
    """A request's own scopes, or its filters' standards, or those that its words name."""
    found = resolved_filters(request.text, request.tenant, {k: v for k, v in request.filters.items() if k.startswith("source_standard")})
    return list(request.scopes) or list(found.get("source_standards") or ([found["source_standard"]] if "source_standard" in found else []))


def _candidates(chunks: DataFrame, request: Request) -> DataFrame:
    """Chunks that a request's filters, clause and time range let through. The clause counts where chunks have one."""
    search.require_tenant(request.tenant)
    limited(k=request.k, fetch_k=request.fetch_k, rrf_k=request.rrf_k)
    if request.time_field not in TIME_FIELDS:
        raise ValueError(f"UNKNOWN_TIME_FIELD: {request.time_field}")
    c = policy.metadata_filter(chunks, checked_filters(request.filters, chunks.columns))
    scopes = requested_scopes(request)
    clause = resolved_filters(request.text, request.tenant, {"source_standard": scopes[0]}).get("clause_id") if len(scopes) == 1 else None
    if clause and "clause_id" in chunks.columns and "clause_id" not in request.filters:
        c = policy.scope_or_all(c, F.coalesce(F.col("clause_id") == clause, F.lit(False)))
    return policy.time_range(c, request.time_field, request.since, request.until)


def search_grounded(chunks: DataFrame, request: Request) -> DataFrame:
    """Hybrid retrieval of a tenant's chunks, penalised by scope, deduplicated by content, spread over scopes,
    and checked against leaks. Columns: id, content, score, similarity, scope, tenant_id, is_global.

    Scopes that are asked for come before ranks: chunks of others are found only where none of theirs is.
    """
    c = _candidates(chunks, request)
    scopes = requested_scopes(request)
    found = search.hybrid(c, request.vector, request.text, request.fetch_k, 0.25, request.rrf_k, tenant=request.tenant, scopes=scopes, fallback=True)
    # payloads join the few ranked ids only
    rows = c.select("id", "content", "scope", "tenant_id", "is_global").join(F.broadcast(found), "id")
    rows = policy.drop_structure(rows)
    rows = policy.scope_penalty(rows, scopes, request.penalty) if scopes else rows
    if request.strict:
        rows = policy.strict_scope(rows, scopes)
    if request.least is not None:
        rows = policy.min_score(rows, request.least, F.lit("rrf"))
    rows = policy.dedupe_content(rows)
    rows = policy.verify_isolation(rows, request.tenant)
    return policy.stratify(rows, scopes, request.k) if scopes else search.top(rows, request.k, F.desc("score"), F.col("id"))


def fingerprint(request: Request) -> str:
    """What makes a sub-query a duplicate: its standard and clause, or else its words."""
    standard = str(request.filters.get("source_standard") or (request.scopes[0] if len(request.scopes) == 1 else "")).strip().upper()
    clause = str(request.filters.get("clause_id") or "").strip()
    return f"scope_clause::{standard}::{clause}" if standard and clause else "query::" + " ".join(request.text.lower().split())


def _branches(chunks: DataFrame, requests: Sequence[Request]) -> DataFrame:
    """(list_no, pos, id, ratio) of each request's results; ratio: the share of them penalised by scope."""
    lists = None
    for n, r in enumerate(requests):
        one = search_grounded(chunks, r)
        away = F.col("scope_penalized").cast("double") if requested_scopes(r) else F.lit(0.0)
        one = one.select(F.lit(n).alias("list_no"), F.row_number().over(Window.orderBy(F.desc("score"), "id")).alias("pos"), "id", away.alias("away"))
        lists = one if lists is None else lists.unionByName(one)
    return lists.withColumn("ratio", F.avg("away").over(Window.partitionBy("list_no"))).drop("away")


def search_many(chunks: DataFrame, requests: Sequence[Request], k: int = 10, rrf_k: int = 60, drop_at: float = 0.95) -> DataFrame:
    """Several queries in one plan, duplicates run once, branches whose rows are penalised to drop_at or more left
    out, the others merged by reciprocal ranks. A row of another tenant fails the whole."""
    limited(queries=len(requests), rrf_k=rrf_k)
    once = list({fingerprint(r): r for r in reversed(requests)}.values())[::-1]
    return policy.rrf_merge(_branches(chunks, once).where(F.col("ratio") < drop_at), rrf_k, k)


def branch_report(chunks: DataFrame, requests: Sequence[Request], drop_at: float = 0.95) -> DataFrame:
    """(branch, status, items) of each request: ok, SUBQUERY_OUT_OF_SCOPE or SUBQUERY_SKIPPED_DUPLICATE."""
    seen: dict[str, int] = {}
    first = [seen.setdefault(fingerprint(r), k) == k for k, r in enumerate(requests)]
    ran = [k for k, f in enumerate(first) if f]
    rows = _branches(chunks, [requests[k] for k in ran]).groupBy("list_no").agg(F.count("*").alias("n"), F.max("ratio").alias("ratio"))
    names = chunks.sparkSession.createDataFrame([(k, ran.index(k) if first[k] else None) for k in range(len(requests))], "branch int, list_no int")
    out = F.coalesce(F.col("ratio") >= drop_at, F.lit(False))
    status = F.when(F.col("list_no").isNull(), "SUBQUERY_SKIPPED_DUPLICATE").when(out, "SUBQUERY_OUT_OF_SCOPE").otherwise("ok")
    return names.join(rows, "list_no", "left").select("branch", status.alias("status"), F.when(status == "ok", F.coalesce("n", F.lit(0))).otherwise(0).alias("items"))


def execute_plan(chunks: DataFrame, requests: Sequence[Request], sequential: bool = False, k: int = 10, branches: int = 2, stop_at: float = 0.8) -> DataFrame:
    """(id, score): at most so many sub-queries, then the query itself (the last request). One after the other,
    a branch whose rows are penalised to stop_at or more is the last one; the query always counts. One plan: which
    branches count is decided within it."""
    *subs, query = requests
    subs = subs[: max(1, branches)]
    if not sequential:
        return search_many(chunks, [*subs, query], k).select("id", "score")
    rows = _branches(chunks, [*subs, query])
    ended = rows.where((F.col("list_no") < len(subs)) & (F.col("ratio") >= stop_at)).agg(F.min("list_no").alias("ended"))
    counts = (F.col("list_no") == len(subs)) | (F.col("list_no") <= F.coalesce("ended", F.lit(len(subs))))
    return policy.rrf_merge(rows.join(F.broadcast(ended), F.lit(True)).where(counts), 60, k).select("id", "score")


def query_mode(text: str, anchors: int) -> str:
    """SPECIFIC, GENERAL or HYBRID by named anchors and broad wording."""
    broad = bool(re.search(r"\b(resumen|general|overview|summary|compare|compara|todos|all)\b", text, re.I))
    return "HYBRID" if broad and anchors else "GENERAL" if broad or not anchors else "SPECIFIC"


def search_comprehensive(chunks: DataFrame, edges: DataFrame, summaries: DataFrame, request: Request, hops: int = 2) -> DataFrame:
    """Chunks, graph neighbours and summaries by quotas 3, 2, 1. summaries: (id, embedding, children, tenant_id).

    Only the tenant's summaries are searched. Graph neighbours and summaries' leaves count only as chunks that the tenant
    may see; every row of all three passes the leak check.
    """
    limited(hops=hops)
    if "tenant_id" not in summaries.columns:
        raise ValueError("TENANT_REQUIRED: summaries without an owner")
    owned = chunks.select(F.col("id").alias("__id"), "tenant_id", "is_global")
    mine = search.scoped(owned, request.tenant)
    visible = lambda d: d.join(mine, F.col("id") == F.col("__id")).drop("__id")
    base = search_grounded(chunks, request).select("id", "score", "tenant_id", "is_global")
    place = lambda d, s: d.select(F.lit(s).alias("source"), F.col("id").cast("long").alias("id"), F.row_number().over(Window.orderBy(F.desc("score"), "id")).alias("pos"), "score", "tenant_id", "is_global")
    # a walk goes over chunks that the tenant may see, so that others lend no score either
    seen = mine.select("__id")
    walk = edges.join(seen.withColumnRenamed("__id", "src"), "src", "left_semi").join(seen.withColumnRenamed("__id", "dst"), "dst", "left_semi")
    near = visible(graph.multi_hop(base.limit(12).select(F.col("id").alias("node"), "score"), walk, hops, n=40).where("hop > 0").select(F.col("node").alias("id"), "score"))
    own = search.scoped(summaries, request.tenant, include_global=False)
    top = search.vector_hits(own, request.vector, 5, 0.25, inclusive=True)
    below = graph.tree_leaves(top.select("id"), own.select("id", "children")).join(top.select(F.col("id").alias("root"), "similarity"), "root")
    leaves = visible(below.groupBy(F.col("leaf").alias("id")).agg(F.max("similarity").alias("score")))
    rows = place(base, "chunks").unionByName(place(near, "graph")).unionByName(place(leaves, "summary"))
    rows = policy.verify_isolation(rows, request.tenant).drop("tenant_id", "is_global")
    return policy.late_fusion(rows, {"chunks": 3, "graph": 2, "summary": 1}, request.k)


def explain(chunks: DataFrame, request: Request) -> DataFrame:
    """Each result with the parts of its score, the way it came, the filters it met and the query's words it holds."""
    words = F.array(*(F.lit(w) for w in dict.fromkeys(re.findall("[0-9a-zà-öø-ÿ]+", request.text.lower()))))
    r = search_grounded(chunks, request)
    way = F.concat_ws(">", F.lit("hybrid"), F.when(F.col("scope_penalized"), "scope_penalty") if requested_scopes(request) else F.lit(None).cast("string"), F.lit("stratified" if requested_scopes(request) else "ranked"))
    met = F.array(*(F.lit(x) for x in sorted(request.filters))).cast("array<string>")
    return r.select("id", "scope", F.struct("score", "similarity").alias("parts"), way.alias("path"), met.alias("filters"), F.array_intersect(tokens(F.col("content")), words).alias("matched"))


def ingest_documents(docs: DataFrame, path: str, most: int = 1500) -> DataFrame:
    """Clean, split, enrich and load documents; sources at hand replace what they had."""
    c = ingest.chunked(docs, most).withColumn("source_id", F.col("doc_id"))
    ingest.load_chunks(c, path)
    return docs.sparkSession.read.parquet(path)


def truncated(text: Column, most: int) -> Column:
    """A text of at most so many characters: cut at its last paragraph, line, sentence or word, and marked."""
    head = F.left(text, F.lit(most))
    last = lambda sep: F.when(head.contains(sep), F.length(head) - F.length(F.substring_index(head, sep, -1)) - len(sep))
    cut = F.coalesce(last("\n\n"), last("\n"), last(". ") + 1, last(".\n") + 1)
    cut = F.when(cut > 0, cut).when(last(" ") > 0, last(" ")).otherwise(F.lit(most))
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.rtrim(F.left(head, cut)), F.lit("\n[...]")))


def context(hits: DataFrame, most: int = 12000, each: int = 2000, rows: int = 50) -> DataFrame:
    """(context, citations): the best hits' contents behind their ids, each cut at a boundary and the whole too, and
    the ids in order, each once."""
    h = search.top(hits.where(F.trim(F.coalesce("content", F.lit(""))) != ""), rows, F.desc("score"), F.col("id"))
    line = F.concat(F.lit("["), F.col("id").cast("string"), F.lit("]: "), truncated(F.col("content"), each))
    g = h.agg(F.sort_array(F.collect_list(F.struct(F.negative("score").alias("s"), F.col("id").alias("id"), line.alias("line")))).alias("x"))
    whole = F.array_join(F.transform("x", lambda x: x["line"]), "\n\n---\n\n")
    return g.select(truncated(whole, most).alias("context"), F.array_distinct(F.transform("x", lambda x: x["id"])).alias("citations"))
