"""Operators on small cases: exact orders, ties, nulls, empty tables, tenants, cycles."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lodestar import api
from lodestar.functions import text as X
from lodestar.functions import vector as V
from lodestar.operators import graph, ingest, operations, policy, search
from lodestar.sources import readers


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x")).alias("y")).head()[0]


def test_rrf_merge_order_and_first_seen_ties(spark):
    rows = [(1, 1, "doc-1"), (1, 2, "doc-2"), (2, 1, "doc-3"), (2, 2, "doc-1")]
    d = spark.createDataFrame(rows, "list_no int, pos int, id string")
    assert [r.id for r in policy.rrf_merge(d, 60, 10).collect()] == ["doc-1", "doc-3", "doc-2"]
    assert [r.id for r in policy.rrf_merge(d, 60, 2).collect()] == ["doc-1", "doc-3"]
    assert policy.rrf_merge(d.limit(0)).collect() == []


def test_min_score_lets_fused_scores_pass(spark):
    d = spark.createDataFrame([("a", 0.9, "cosine"), ("b", 0.5, "cosine"), ("c", 0.01, "rrf")], "id string, score double, space string").withColumn("similarity", F.lit(None).cast("double"))
    assert {r.id for r in policy.min_score(d, 0.7, F.col("space")).collect()} == {"a", "c"}


def test_structure_is_dropped_and_noise_cleaned(spark):
    d = spark.createDataFrame([(1, "|----|----|\n[Texto](http://x)  con   espacios"), (2, "Indice\n4.1 Contexto ........ 3"), (3, "   ")], "id int, content string")
    assert [tuple(r) for r in policy.drop_structure(d).collect()] == [(1, "Texto con espacios")]


def test_isolation_fails_closed(spark):
    good = spark.createDataFrame([(1, 7, False), (2, None, True)], "id int, tenant_id int, is_global boolean")
    assert policy.verify_isolation(good, 7).count() == 2
    for tenant, shared in ((8, False), (None, False)):
        bad = spark.createDataFrame([(1, tenant, shared)], "id int, tenant_id int, is_global boolean")
        with pytest.raises(Exception, match="TENANT_LEAK"):
            policy.verify_isolation(bad, 7).collect()
    with pytest.raises(ValueError, match="TENANT_REQUIRED"):
        search.require_tenant(None)


def test_cosine_guards(spark):
    rows = [([1.0, 0.0], [1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), (None, [1.0, 0.0]), ([1.0], [1.0, 0.0])]
    d = spark.createDataFrame(rows, "a array<double>, b array<double>")
    assert [r.s for r in d.select(V.cosine(F.col("a"), F.col("b"), -1.0).alias("s")).collect()] == [1.0, -1.0, -1.0, -1.0]


def test_parse_embedding(spark):
    assert one(spark, V.parse_embedding, "[1, 2.5]") == [1.0, 2.5]
    assert one(spark, V.parse_embedding, "1,2") == [1.0, 2.0]
    assert one(spark, V.parse_embedding, "1,x") is None


def test_text_functions(spark):
    assert one(spark, X.clause_refs, "see 4.1 and 4.1.2, again 4.1") == ["4.1", "4.1.2"]
    assert one(spark, X.standards, "ISO 9001:2015, iso-14001, ISO 9001") == ["ISO 9001", "ISO 14001"]
    assert one(spark, X.worker_stage, "Visual Anchor done with error") == "VISUAL"
    assert one(spark, X.safe_filename, "Año (1).pdf") == "Ano-1-.pdf"
    assert one(spark, X.tag_prefix, "Ejemplo 3.1 aquí").startswith("[EXAMPLE_ID: 3.1]")
    assert one(spark, X.token_estimate, "") == 1
    assert one(spark, X.chunk_role, "nada") == "normative_body"


def test_stratify_takes_turns(spark):
    rows = [(1, "a", 0.9), (2, "a", 0.8), (3, "b", 0.1), (4, "z", 0.99)]
    d = spark.createDataFrame(rows, "id int, scope string, score double")
    assert [r.id for r in policy.stratify(d, ["a", "b"], 4).collect()] == [1, 3, 2, 4]


def test_multi_hop_on_a_cycle(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "src long, dst long")
    a = spark.createDataFrame([(1, 1.0)], "node long, score double")
    assert [(r.node, r.hop) for r in graph.multi_hop(a, e, 4).collect()] == [(1, 0), (2, 1), (3, 1)]


def test_entities_merge_without_case(spark):
    old = spark.createDataFrame([("Acme", "maker", 2.0)], "name string, description string, weight double")
    new = spark.createDataFrame([(1, "ACME", "of things", 50.0), (2, "Other", None, 50.0), (3, " ", "x", 1.0)], "seq int, name string, description string, weight double")
    r = {x.name_key: x for x in graph.merge_entities(old, new).collect()}
    assert set(r) == {"acme", "other"}
    assert r["acme"].description == "maker of things" and r["acme"].weight == 3.0 and r["other"].weight == 10.0


def test_sections_have_parents(spark):
    t = spark.createDataFrame([(1, 1, 1, "A", 1), (1, 2, 2, "B", 2), (1, 3, 3, "C", 3), (1, 4, 2, "D", 5)], "doc int, ord int, level int, title string, page int")
    r = {x.title: (x.parent_ord, x.end_page) for x in graph.document_sections(t).collect()}
    assert r == {"A": (None, 2), "B": (1, 3), "C": (2, 5), "D": (1, None)}


def test_headings_split_and_pack():
    out = ingest.split_headings("# A\n" + "x" * 200 + "\n## B\n" + "y" * 200, 150)
    assert out[0][0].startswith("A (part 1") and out[-1][0].startswith("A > B")
    assert ingest.pack_paragraphs("a\n\nb\n\nc", 4) == ["a\n\nb", "c"]
    assert ingest.pack_paragraphs("", 4) == []
    toc = [f"{k} Title {k}" for k in range(1, 11)] + ["text"] * 40
    assert ingest.strip_toc_block("\n".join(toc)) == "\n".join(["text"] * 40)


def test_progress_and_stall(spark):
    b = spark.createDataFrame([(1, 2, dt.datetime(2024, 1, 1))], "batch_id int, total_files int, created_at timestamp")
    d = spark.createDataFrame([(1, 1, "processing", "RAPTOR")], "batch_id int, doc_id int, status string, stage string")
    r = operations.batch_progress(b, d).head()
    assert r.progress == 38.5 and r.status == "processing"
    ev = spark.createDataFrame([(1, dt.datetime(2024, 1, 1, 0, 0, 0))], "batch_id int, ts timestamp")
    at = lambda s: F.lit(f"2024-01-01 00:{s}").cast("timestamp")
    assert operations.stalled(b, ev, at("03:00")).head().stalled is False
    assert operations.stalled(b, ev, at("03:01")).head().stalled is True
    none = operations.batch_progress(b.withColumn("total_files", F.lit(0)), d.limit(0)).head()
    assert none.progress == 0.0


def test_idempotent_load(spark, tmp_path):
    p = str(tmp_path / "chunks")
    docs = spark.createDataFrame([(1, "uno dos"), (2, "tres")], "doc_id long, text string")
    assert api.ingest_documents(docs, p).count() == 2
    assert api.ingest_documents(docs.where("doc_id = 1").withColumn("text", F.lit("otro")), p).orderBy("doc_id").select("content").collect()[0][0] == "otro"
    assert spark.read.parquet(p).count() == 2


def test_grounded_search(spark):
    rows = [(1, "alpha beta", [1.0, 0.0], "s1", 1, False), (2, "Alpha  beta", [1.0, 0.1], "s2", 1, False), (3, "alpha beta gamma", [0.9, 0.0], "s1", 2, False), (4, "alpha beta shared", [0.5, 0.5], "s3", 9, True)]
    c = spark.createDataFrame(rows, "id long, content string, embedding array<double>, scope string, tenant_id int, is_global boolean")
    q = api.Request("alpha beta", [1.0, 0.0], 1, k=5)
    got = {r.id for r in api.search_grounded(c, q).collect()}
    assert 3 not in got and 4 in got and len(got & {1, 2}) == 1
    with pytest.raises(ValueError, match="TENANT_REQUIRED"):
        api.search_grounded(c, api.Request("x", [1.0, 0.0], None))
    with pytest.raises(ValueError):
        api.search_grounded(c, api.Request("x", [1.0, 0.0], 1, k=500))
    with pytest.raises(ValueError, match="RESERVED"):
        api.search_grounded(c, api.Request("x", [1.0, 0.0], 1, filters={"tenant_id": 2}))
    assert api.explain(c, q).count() == len(got)
    assert api.search_many(c, [q, q]).count() == len(got)
    e = spark.createDataFrame([(1, 4), (4, 8)], "src long, dst long")
    c = c.unionByName(spark.createDataFrame([(8, "far", [0.0, -1.0], "s1", 1, False), (101, "leaf", [0.0, -1.0], "s1", 1, False)], c.schema))
    s = spark.createDataFrame([(100, [1.0, 0.0], [101], 1)], "id long, embedding array<double>, children array<long>, tenant_id int")
    assert {r.source for r in api.search_comprehensive(c, e, s, q).collect()} >= {"chunks", "graph", "summary"}


def test_scope_validation():
    assert api.validate_scope("ISO 9001 clause 4.1").ambiguous is False
    assert api.validate_scope("que dice la cláusula 4.1").ambiguous is True
    assert "economia circular" in api.expanded("requisitos de ec", [{"term": "ec", "expand_to": ["economia circular"]}])


def test_sources(spark, tmp_path):
    (tmp_path / "a.md").write_text("# T\nbody")
    (tmp_path / "b.html").write_text("<p>hi</p>")
    assert readers.dispatch(spark, "PRE_PROCESSED", str(tmp_path / "a.md")).head().text == "# T\nbody"
    assert readers.dispatch(spark, "FAST_CONTENT", str(tmp_path / "b.html")).head().text == "hi"
    assert readers.binary_files(spark, str(tmp_path), lambda b: b.decode().upper(), "*.md").head().text == "# T\nBODY"
    with pytest.raises(ValueError, match="UNKNOWN_STRATEGY"):
        readers.dispatch(spark, "x", "y")
