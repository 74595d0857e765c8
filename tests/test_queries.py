"""Every registered query against its SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from lodestar import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, float):
        return float(f"{v:.6g}")
    return v


def rows(names, data):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(r[k]) for k in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    cur = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    mine, theirs = rows(df.columns, df.collect()), rows(names, cur.fetchall())
    assert len(mine) == len(theirs)
    for a, b in zip(mine, theirs):
        for x, y in zip(a, b):
            assert x == y or (isinstance(x, (int, float)) and isinstance(y, (int, float)) and math.isclose(x, y, rel_tol=1e-5)) or str(x) == str(y)


def test_queries_without_sql_keep_their_invariants(spark):
    c = catalog.QUERIES["communities"](spark, SF)
    assert c.count() == c.select("node").distinct().count()
    g = catalog.QUERIES["gmm_clusters"](spark, SF).toPandas()
    assert (g.p > 0).all() and g.id.nunique() == spark.read.parquet(f"{SF}/embeddings.parquet").count()
    d = catalog.QUERIES["document_chunks"](spark, SF)
    assert d.groupBy("doc_id", "chunk_index").count().where("count > 1").isEmpty()
