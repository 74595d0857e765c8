"""The full-text and vector indexes against scans of the same rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.operators import indexed, ingest, search
from lodestar.operators.textindex import TextIndex, blocks, write_text_index
from lodestar.operators.vectorindex import VectorIndex, write_vector_index

WORDS = ["red", "blue", "green", "licencia", "licencias", "iso", "9001", "x"]


def pairs(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture(scope="module")
def chunks(spark):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(400):
        n = int(rng.integers(0, 60))
        text = " ".join(rng.choice(WORDS, n, p=[0.3, 0.2, 0.15, 0.05, 0.05, 0.05, 0.05, 0.15])) if k % 40 else (None if k % 80 else "")
        v = [float(x) for x in (rng.normal(size=6) * 0.1 + np.eye(6)[k % 6])]
        rows.append((k, f"s{k % 7}", text, None if k % 50 == 7 else [0.0] * 6 if k % 50 == 8 else v[:5] if k % 50 == 9 else v, k % 2, k % 11 == 0, ["ISO 9001", "ISO 14001", ""][k % 3]))
    return spark.createDataFrame(rows, "id long, source_id string, content string, embedding array<double>, tenant_id int, is_global boolean, scope string")


@pytest.fixture(scope="module")
def texts(spark, chunks, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("texts"))
    write_text_index(ingest.with_buckets(chunks, 4), path)
    return TextIndex(spark, path)


@pytest.fixture(scope="module")
def vectors(spark, chunks, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("vectors"))
    write_vector_index(chunks.drop("content"), path, 24)
    return VectorIndex(spark, path)


@pytest.mark.parametrize("stemmed", [False, True])
@pytest.mark.parametrize("text", ["red", "red blue", '"red blue" -green', "iso 9001 or licencias x", "licencia", "red red blue green x iso", "-red", "absent", "red absent or blue", '"blue red blue"'])
@pytest.mark.parametrize("n", [1, 9, 1000])
def test_text_index_finds_what_a_scan_finds(texts, chunks, text, n, stemmed):
    assert pairs(texts.hits(text, n, stemmed)) == pairs(search.text_hits(chunks, text, n, stemmed).select("id", "text_rank"))
    read, held = texts.read
    assert read <= held


def test_few_postings_are_read_for_few_rows(spark, tmp_path):
    """Impacts fall steeply in real texts: most postings can't be among the first."""
    rows = [(k, 0, "word " * (1 + 2000 // (k + 1)) + f"other{k % 50}") for k in range(2000)]
    d = spark.createDataFrame(rows, "id long, bucket int, content string")
    write_text_index(d, str(tmp_path / "t"))
    index = TextIndex(spark, str(tmp_path / "t"))
    assert pairs(index.hits("word", 5)) == pairs(search.text_hits(d, "word", 5).select("id", "text_rank"))
    assert index.read[0] * 10 <= index.read[1]
    assert index.hits("other7", 100).count() == 40 and index.read[1] == 40  # 2,000 texts, 40 postings


def test_an_index_is_built_without_a_shuffle_of_its_words(spark, chunks, tmp_path):
    """Words taken apart by shuffles were several times the texts on disk; stems beside words doubled the postings."""
    made = blocks(ingest.with_buckets(chunks, 4))
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    held = made.select("term", "stem", F.explode("postings").alias("x")).select("term", "stem", "x.*")
    words = chunks.select("id", F.explode(F.expr("split(content, ' ')")).alias("term")).where("term <> ''").groupBy("id", "term").count()
    assert held.count() == words.count()
    assert held.where("impact <> size(places)").count() == 0
    sums = held.groupBy("id", "stem").agg(F.sum("impact").alias("n"), F.min("stem_impact").alias("a"), F.max("stem_impact").alias("b"))
    assert sums.where("n <> a or n <> b").count() == 0
    write_text_index(ingest.with_buckets(chunks, 4), str(tmp_path / "t"))
    assert sorted(p.name for p in (tmp_path / "t").iterdir()) == ["blocks"]


def test_blocks_hold_a_frequent_word_in_parts_of_falling_impact(spark):
    rows = spark.createDataFrame([(k, 0, "word " * (1 + k % 5)) for k in range(1000)], "id long, bucket int, content string").coalesce(1)
    made = blocks(rows).select("most", "postings.impact", "postings.id").collect()
    assert sorted(len(r["id"]) for r in made) == [232, 256, 256, 256] and sorted(k for r in made for k in r["id"]) == list(range(1000))
    assert all(r["impact"] == sorted(r["impact"], reverse=True) and r["most"] == r["impact"][0] for r in made)


def test_only_allowed_texts_are_found(texts, chunks):
    some = chunks.where("tenant_id = 1")
    assert pairs(texts.hits("red", 7, allowed=some)) == pairs(search.text_hits(some, "red", 7).select("id", "text_rank"))


@pytest.mark.parametrize("n, threshold, inclusive", [(5, 0.25, False), (40, -1.0, True), (1, 0.9, False), (1000, 0.2, True), (3, 2.0, False)])
def test_vector_index_finds_what_a_scan_finds(vectors, chunks, n, threshold, inclusive):
    for q in ([1.0, 0, 0, 0, 0, 0], [0.3, 0.2, -0.5, 0.1, 0.9, 0.0], [-1.0] * 6):
        want = search.vector_hits(chunks, q, n, threshold, inclusive).select("id", "similarity")
        assert pairs(vectors.hits(q, n, threshold, inclusive).select("id", "similarity")) == pairs(want)
    assert vectors.hits([0.0] * 6, n).count() == 0 and vectors.hits([1.0], n).count() == 0


def test_near_queries_read_few_cells(vectors):
    vectors.hits([1.0, 0, 0, 0, 0, 0], 5)
    assert vectors.share < 0.5 and vectors.visited[0] < vectors.visited[1]


def test_filters_hold_before_the_best_are_taken(vectors, chunks):
    q = [1.0, 0, 0, 0, 0, 0]
    mine = lambda d: search.scoped(d, 1, ["iso 9001"], include_global=False)
    assert pairs(vectors.hits(q, 6, 0.0, where=mine).select("id", "similarity")) == pairs(search.vector_hits(mine(chunks), q, 6, 0.0).select("id", "similarity"))


@pytest.mark.parametrize("text", ["red blue", "iso 9001", ""])
@pytest.mark.parametrize("limits", [{}, {"tenant": 1}, {"tenant": 0, "scopes": ["iso 9001"]}])
def test_hybrid_from_indexes(texts, vectors, chunks, text, limits):
    q = [0.5, 0.5, 0, 0, 0, 0.1]
    assert pairs(indexed.hybrid(texts, vectors, chunks, q, text, 15, **limits)) == pairs(search.hybrid(chunks, q, text, 15, **limits))


def test_a_reload_replaces_postings_and_cells(spark, chunks, tmp_path):
    table, index, cells = (str(tmp_path / x) for x in ("chunks", "texts", "vectors"))
    mine = chunks.where("tenant_id = 1").withColumn("eligible", F.lit(True))
    ingest.load_chunks(mine, table, index)
    write_vector_index(spark.read.parquet(table).drop("content"), cells, 12)
    new = mine.where("source_id = 's1'").withColumn("id", F.col("id") + 1000).withColumn("content", F.concat(F.lit("zebra "), "content")).limit(3)
    ingest.load_chunks(new, table, index)
    VectorIndex(spark, cells).replace(new.drop("content"), F.col("source_id") == "s1")
    now = spark.read.parquet(table)
    assert now.where("source_id = 's1'").count() == new.where("size(embedding) > 0").count()
    for text in ("zebra", "red", "blue red"):
        assert pairs(TextIndex(spark, index).hits(text, 50)) == pairs(search.text_hits(now, text, 50).select("id", "text_rank"))
    got = VectorIndex(spark, cells).hits([0, 1.0, 0, 0, 0, 0], 50, 0.0).select("id", "similarity")
    kept = now.where("source_id <> 's1'").drop("content", "bucket").unionByName(new.drop("content"))
    assert pairs(got) == pairs(search.vector_hits(kept, [0, 1.0, 0, 0, 0, 0], 50, 0.0).select("id", "similarity"))
