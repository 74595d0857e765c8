import hashlib
import math
import re
import uuid
from collections import Counter

from pyspark.sql import functions as F

from lodestar import api
from lodestar.functions import identity as D

NS = uuid.UUID("6ba7b810-9dad-11d1-80b4-00c04fd430c8")


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x")).alias("y")).head()[0]


def test_uuid5_is_the_standard_one(spark):
    for name in ("", "abc", "ñandú", "x" * 300):
        assert one(spark, lambda c: D.uuid5(str(NS), c), name) == str(uuid.uuid5(NS, name))
    a, b = (one(spark, lambda c: D.entity_id(str(NS), F.lit(1), c), x) for x in ("Ácme", " acme "))
    assert a == b


def embed(text):
    v = [0.0] * 128
    for w, n in Counter(re.findall(D.WORDS, text.lower())).items():
        v[int(hashlib.sha1(w.encode()).hexdigest()[:8], 16) % 128] += n
    length = math.sqrt(sum(x * x for x in v)) or 1.0
    return [x / length for x in v]


def test_hash_embedding_and_authority(spark):
    for text in ("norma oficial manual", "policy guia", "", "rubric grading rubric", "extra annex"):
        assert all(math.isclose(a, b, abs_tol=1e-12) for a, b in zip(one(spark, D.hash_embedding, text), embed(text)))
        if text:
            want = max(D.PROTOTYPES, key=lambda k: round(sum(a * b for a, b in zip(embed(text), embed(D.PROTOTYPES[k]))), 9))
            assert one(spark, D.authority_by_embedding, text) == want
    assert one(spark, D.authority_by_embedding, " ") is None


def test_times(spark):
    assert str(one(spark, D.utc_time, "2024-01-02T03:04:05Z")) == "2024-01-02 03:04:05"
    assert one(spark, D.utc_time, "no time") is None


def test_modes_and_plans(spark):
    assert [api.query_mode("resumen general", 0), api.query_mode("overview of Acme", 1), api.query_mode("clause", 2)] == ["GENERAL", "HYBRID", "SPECIFIC"]
    c = spark.createDataFrame([(1, "alpha", [1.0, 0.0], "s1", 1, False), (2, "beta", [0.9, 0.1], "s2", 1, False)], "id long, content string, embedding array<double>, scope string, tenant_id int, is_global boolean")
    q = api.Request("alpha", [1.0, 0.0], 1)
    s = api.Request("beta", [0.9, 0.1], 1, scopes=["zz"])
    assert {r.id for r in api.execute_plan(c, [s, q, q]).collect()} == {1, 2}
    assert {r.id for r in api.execute_plan(c, [s, q], sequential=True).collect()} == {1, 2}
