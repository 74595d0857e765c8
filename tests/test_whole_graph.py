"""Community queries take the whole graph."""

from lodestar import catalog
from lodestar.plans import binding as B


def test_communities_label_every_node(spark, sf):
    want = {x for r in B.edges(spark, sf).collect() for x in (r.src, r.dst)}
    assert max(want) >= 100
    assert {r.node for r in catalog.QUERIES["communities"](spark, sf).collect()} == want
    named = {r.c_custkey for r in B.table(spark, sf, "customer").select("c_custkey").collect()} & want
    assert sum(r["size"] for r in catalog.QUERIES["community_summaries"](spark, sf).collect()) == len(named)
