"""Record keeping, grounding and evaluation on small cases."""

import pytest
from pyspark.sql import functions as F

from lodestar.operators import graph, ingest, knowledge, policy, records, search


def one(spark, expr, **values):
    d = spark.createDataFrame([tuple(values.values())], list(values))
    return d.select(expr.alias("y")).head()[0]


def test_insert_at_checks_bounds(spark):
    a = F.col("a")
    assert one(spark, records.insert_at(a, F.lit(1), F.lit(9)), a=[1, 2]) == [1, 9, 2]
    with pytest.raises(Exception, match="OUT_OF_BOUNDS"):
        one(spark, records.insert_at(a, F.lit(5), F.lit(9)), a=[1, 2])


def test_markdown_rows(spark):
    assert one(spark, records.markdown_rows(F.col("t")), t="| a | b |\n|---|---|\n| 1 | 2 |") == [["a", "b"], ["1", "2"]]


def test_query_entities(spark):
    assert one(spark, records.query_entities(F.col("t")), t="does Acme Corp own Beta?") == ["Acme Corp", "Beta"]
    assert one(spark, records.query_entities(F.col("t")), t="x" * 90) == ["x" * 80]


def test_anchor_token(spark):
    t = lambda text, ctx: one(spark, ingest.anchor_token(F.col("t"), F.col("c"), F.lit(7)), t=text, c=ctx)
    assert t("a {{visual}} b", "x") == "a <<VISUAL_ANCHOR:7>> b"
    assert t("see fig here", "fig") == "see fig <<VISUAL_ANCHOR:7>> here"
    assert t("none", "fig").endswith("\n<<VISUAL_ANCHOR:7>>")


def test_grounding_and_mounts(spark):
    e = spark.createDataFrame([("a", 0.5), ("b", 0.9), ("c", 0.1)], "entity string, score double")
    p = spark.createDataFrame([("a", 1), ("b", 1)], "entity string, chunk long")
    r = {x.id: (x.similarity, x.reasoning) for x in knowledge.ground_entities(e, p).collect()}
    assert r == {"1": (0.9, "b,a"), "graph:c": (0.1, "c")}
    docs = spark.createDataFrame([(1, "L1"), (1, "math"), (2, "L1"), (2, "rubric"), (3, "math")], "doc long, tag string")
    kinds = spark.createDataFrame([("n", "L1", "math")], "node string, level_tag string, subject_tag string")
    assert {(x.doc, x.node) for x in knowledge.auto_mounts(docs, kinds).collect()} == {(1, "n"), (2, "n")}


def test_summary_tree_shrinks(spark):
    rows = [(1, k, f"text {k}", [float(k % 3), float(k)], f"s{k % 4}") for k in range(12)]
    c = spark.createDataFrame(rows, "doc long, id long, content string, embedding array<double>, section string")
    t = knowledge.summary_tree(c, F.col("section"), 2, 3).toPandas()
    assert (t[t.level == 1].children.map(len) == 3).all() and len(t[t.level == 1]) == 4
    links = knowledge.summary_links(spark.createDataFrame(t[["id", "children"]]))
    assert links.where("relation = 'SUMMARIZES'").count() == links.where("relation = 'HAS_SUMMARY'").count()


def test_refusals_and_fallback(spark):
    assert one(spark, knowledge.looks_like_refusal(F.col("t")), t="Lo siento, no puedo") is True
    s = one(spark, knowledge.extractive_summary(F.col("t")), t="w " * 900)
    assert len(s.summary) <= 800 and len(s.title.split()) == 10


def test_fallbacks_and_penalties(spark):
    d = spark.createDataFrame([(1, "a", 1.0), (2, None, 1.0), (3, "b", 1.0)], "id int, scope string, score double")
    assert policy.scope_or_all(d, F.col("scope") == "zz").count() == 3
    assert policy.scope_or_all(d, F.col("scope") == "a").count() == 1
    assert {r.id: r.score for r in policy.scope_penalty(d, ["a"]).collect()} == {1: 1.0, 2: 1.0, 3: 0.75}
    assert policy.penalty_ratio(d, ["a"]).head()[0] == 0.5


def test_heading_boost(spark):
    b = policy.heading_boost(F.col("t"), ["5 Lid", "liderazgo"])
    assert one(spark, b, t="SECTION_PATH: 5 Liderazgo\nx") == 5.0
    assert one(spark, b, t="El liderazgo") == 3.0
    assert one(spark, b, t="otro") == 1.0


def test_communities_split_cliques(spark):
    e = [(a, b, 1.0) for a in range(4) for b in range(a)] + [(a, b, 1.0) for a in range(10, 14) for b in range(10, a)]
    got = {r.node: r.community for r in graph.label_communities(spark.createDataFrame(e, "src long, dst long, weight double")).collect()}
    assert len({got[k] for k in range(4)}) == 1 and len({got[k] for k in range(10, 14)}) == 1 and got[0] != got[10]


def test_empty_channels(spark):
    c = spark.createDataFrame([], "id long, content string, embedding array<double>, scope string, tenant_id int, is_global boolean")
    assert search.hybrid(c, [1.0, 0.0], "x", tenant=1).collect() == []


def test_weights_follow_identifiers():
    plain, ident = search.channel_weights("what is quality"), search.channel_weights("ISO 9001 4.1")
    assert plain["literal"] == 0.05 and ident["literal"] == 0.35 and ident["exact"] > plain["exact"] and ident["text"] <= 0.2
