"""How the provided tables play the engine's roles, in DataFrames and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar import storage
from lodestar.operators.textindex import TextIndex, with_buckets, write_text_index
from lodestar.operators.vectorindex import VectorIndex, write_vector_index
from lodestar.session import table

QUERY_TEXT = "the of and"


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Chunk vectors: tenant, layer and scope come from the label."""
    e = table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("id"), "embedding", "label", (F.col("label") % 4).alias("tenant_id"), F.concat(F.lit("scope-"), F.col("label").cast("string")).alias("scope"), (F.col("label") == 0).alias("is_global"))


VECTORS = "v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS embedding, label, label % 4 AS tenant_id, 'scope-' || label AS scope, label = 0 AS is_global FROM embeddings), q AS (SELECT embedding AS qe FROM v WHERE id = 0)"


def query_vector(spark: SparkSession, sf: str, vec_id: int = 0) -> list[float]:
    return [float(x) for x in table(spark, sf, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").head()[0]]


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Text chunks with vectors: every document with the vector of its number, counted round by their number.

    Both tables grow with the corpus, so they meet by a shuffle; a broadcast of small vectors would leave the texts
    in as few tasks as their file has row groups.
    """
    v = vectors(spark, sf).drop("scope").withColumnRenamed("id", "vec").hint("shuffle_hash")
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), "lang", F.col("source").alias("scope"))
    return d.join(v, F.col("id") % table(spark, sf, "embeddings").count() == F.col("vec")).drop("vec")


CHUNKS = VECTORS + ", c AS (SELECT d.doc_id AS id, v.embedding, v.label, v.tenant_id, v.is_global, d.text AS content, d.lang, d.source AS scope FROM documents d JOIN v ON d.doc_id % (SELECT count(*) FROM embeddings) = v.id)"
SIM = "round(list_cosine_similarity(embedding, qe), 6)"


def edges(spark: SparkSession, sf: str) -> DataFrame:
    """A directed graph of customers and their orders' parts: two orders of the same day follow each other."""
    o = table(spark, sf, "orders")
    return o.select((F.col("o_custkey") % 300).alias("src"), ((F.col("o_custkey") * 7 + F.col("o_orderkey")) % 300).alias("dst"), F.substring("o_orderpriority", 1, 1).alias("relation"), F.round((F.col("o_orderkey") % 10) / 10.0, 1).alias("weight")).where("src <> dst").groupBy("src", "dst").agg(F.min("relation").alias("relation"), F.max("weight").alias("weight"))


EDGES = "g AS (SELECT src, dst, min(relation) AS relation, max(weight) AS weight FROM (SELECT o_custkey % 300 AS src, (o_custkey * 7 + o_orderkey) % 300 AS dst, substr(o_orderpriority, 1, 1) AS relation, round((o_orderkey % 10) / 10.0, 1) AS weight FROM orders) WHERE src <> dst GROUP BY src, dst)"


def hits(spark: SparkSession, sf: str) -> DataFrame:
    """A hit table: every order as a row with scope, authority and structure."""
    o = table(spark, sf, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"), F.round(F.col("o_totalprice") % 1000 / 1000, 6).alias("similarity"), F.round(F.col("o_totalprice") % 1000 / 1000, 6).alias("score"),
        F.concat(F.lit("s"), (F.col("o_custkey") % 5).cast("string")).alias("scope"), F.element_at(F.array(*map(F.lit, ("administrative", "constitution", "policy", "canonical", "supplementary"))), (F.col("o_orderkey") / 5 % 5 + 1).cast("int")).alias("authority"),
        F.element_at(F.array(*map(F.lit, ("global", "tenant", "personal"))), (F.col("o_custkey") % 3 + 1).cast("int")).alias("source_layer"), (F.col("o_orderkey") % 35 == 0).alias("is_constitutional"), (F.col("o_orderkey") % 55 == 0).alias("is_summary"), F.col("o_orderstatus").alias("space"),
    )


HITS = """h AS (SELECT o_orderkey AS id, round(o_totalprice % 1000 / 1000, 6) AS similarity, round(o_totalprice % 1000 / 1000, 6) AS score,
    's' || (o_custkey % 5) AS scope, ['administrative', 'constitution', 'policy', 'canonical', 'supplementary'][((o_orderkey // 5) % 5 + 1)::INT] AS authority,
    ['global', 'tenant', 'personal'][(o_custkey % 3 + 1)::INT] AS source_layer, o_orderkey % 35 = 0 AS is_constitutional, o_orderkey % 55 = 0 AS is_summary, o_orderstatus AS space
    FROM orders)"""


#: Indexes of the chunks, by application and folder of the tables: built by the first query that asks for them.
_indexes: dict[tuple[str, str, str], str] = {}


def _index(spark: SparkSession, sf: str, kind: str, write) -> str:
    key = (spark.sparkContext.applicationId, sf, kind)
    if key not in _indexes:
        path = storage.new_path(spark, kind)
        write(path)
        _indexes[key] = path
    return _indexes[key]


def text_index(spark: SparkSession, sf: str) -> TextIndex:
    """The full-text index of all chunks, in folders by their scope."""
    c = chunks(spark, sf).select("id", "content", "scope")
    return TextIndex(spark, _index(spark, sf, "texts", lambda path: write_text_index(with_buckets(c, 8, "scope"), path)))


def vector_index(spark: SparkSession, sf: str) -> VectorIndex:
    """The vector index of all vectors."""
    return VectorIndex(spark, _index(spark, sf, "vectors", lambda path: write_vector_index(vectors(spark, sf), path, 64)))


def chunk_vector_index(spark: SparkSession, sf: str) -> VectorIndex:
    """The vector index of all chunks."""
    c = chunks(spark, sf).drop("content")
    return VectorIndex(spark, _index(spark, sf, "chunk_vectors", lambda path: write_vector_index(c, path, 64)))
