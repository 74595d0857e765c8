"""Summary trees, community summaries and their links into the graph. Models are injected; offline stand-ins ship."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar import storage
from lodestar.functions.vector import mean_vectors
from lodestar.operators.mixtures import mixture_clusters

# Phrases that tell a refusal, lengths of the extractive fallback.
REFUSALS = "i cannot|i can't|no puedo|lo siento|as an ai|unable to"
SUMMARY_CHARS, TITLE_WORDS = 800, 10


def extractive_summary(text: Column) -> Column:
    """(title, summary) from a text's own beginning: the offline stand-in for a summariser."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.struct(F.array_join(F.slice(F.split(flat, " "), 1, TITLE_WORDS), " ").alias("title"), F.left(flat, F.lit(SUMMARY_CHARS)).alias("summary"))


def looks_like_refusal(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit(""))).rlike(REFUSALS)


def summary_level(nodes: DataFrame, group: Column, level: int, summarise: Callable[[Column], Column] = extractive_summary, parts: int = 50) -> DataFrame:
    """Nodes (doc, id, content, embedding) joined into one summary node for each document and group:
    (doc, id, level, children, title, content, embedding). A summariser reads the first `parts` members by id (a model's
    window); every task cuts a group to them before texts are gathered. Vectors are averaged by component sums over all
    members."""
    g = nodes.withColumn("__g", group).where("__g is not null")
    first = g.select("doc", "__g", "id", "content", F.row_number().over(Window.partitionBy("doc", "__g").orderBy("id")).alias("__r")).where(F.col("__r") <= parts)
    lines = F.transform(F.sort_array(F.collect_list(F.struct("id", "content"))), lambda x: x["content"])
    texts = first.groupBy("doc", "__g").agg(F.array_join(lines, "\n").alias("text"))
    members = g.groupBy("doc", "__g").agg(F.sort_array(F.collect_set("id")).alias("children"))
    means = mean_vectors(g, ["doc", "__g"]).withColumnRenamed("mean", "embedding")
    s = members.join(texts, ["doc", "__g"]).join(means, ["doc", "__g"], "left").withColumn("s", summarise(F.col("text")))
    ident = F.concat(F.lit(f"L{level}:"), F.substring(F.sha1(F.concat_ws("|", F.col("doc").cast("string"), F.lit(str(level)), F.col("__g").cast("string"))), 1, 16))
    return s.select("doc", ident.alias("id"), F.lit(level).alias("level"), "children", "s.title", F.col("s.summary").alias("content"), "embedding")


def summary_tree(chunks: DataFrame, section: Column, depth: int = 3, most: int = 10, keep: Callable[[DataFrame], DataFrame] = lambda x: storage.kept(x, "level")) -> DataFrame:
    """Levels of summaries over each document's chunks: by section first, then by Gaussian clusters, until a
    document has one node. keep writes a level where lineage should end."""
    base = chunks.select("doc", F.col("id").cast("string").alias("id"), "content", "embedding", section.alias("__section"))
    front = keep(summary_level(base, F.col("__section"), 1))
    out = front
    for level in range(2, depth + 1):
        many = front.groupBy("doc").agg(F.count("*").alias("n")).where("n > 1").select("doc")
        part = front.join(many, "doc", "left_semi")
        numbered = part.withColumn("num", F.xxhash64("id"))
        c = mixture_clusters(numbered.select("doc", F.col("num").alias("id"), "embedding"), "doc", most=most)
        joined = numbered.join(c.select(F.col("doc").alias("__d"), F.col("id").alias("__i"), "cluster"), (F.col("doc") == F.col("__d")) & (F.col("num") == F.col("__i")))
        front = keep(summary_level(joined.select("doc", "id", "content", "embedding", "cluster"), F.col("cluster"), level))
        out = out.unionByName(front)
    return out


def summary_links(tree: DataFrame) -> DataFrame:
    """(src, dst, relation): a summary summarises its children, and they have it as summary."""
    e = tree.select(F.col("id").alias("s"), F.explode("children").alias("c"))
    return e.select(F.col("s").alias("src"), F.col("c").alias("dst"), F.lit("SUMMARIZES").alias("relation")).unionByName(e.select(F.col("c").alias("src"), F.col("s").alias("dst"), F.lit("HAS_SUMMARY").alias("relation")))


def community_summaries(labels: DataFrame, names: DataFrame, most: int = 30) -> DataFrame:
    """(community, members, size, summary) from (node, community) and (node, name)."""
    j = labels.join(names, "node")
    g = j.groupBy("community").agg(F.sort_array(F.collect_set("node")).alias("members"), F.sort_array(F.collect_set("name")).alias("names"))
    return g.select("community", "members", F.size("members").alias("size"), F.array_join(F.slice("names", 1, most), ", ").alias("summary"))


def ground_entities(entities: DataFrame, provenance: DataFrame, reasons: int = 3) -> DataFrame:
    """Chunks behind entities (entity, score): (id, similarity = best score, reasoning = first entities); entities
    without a chunk come as rows of their own, `graph:<entity>`."""
    j = entities.join(provenance, "entity")
    hit = j.groupBy(F.col("chunk").cast("string").alias("id")).agg(F.max("score").alias("similarity"), F.array_join(F.transform(F.slice(F.sort_array(F.collect_list(F.struct(F.negative("score").alias("s"), F.col("entity").cast("string").alias("e")))), 1, reasons), lambda x: x["e"]), ",").alias("reasoning"))
    lone = entities.join(provenance.select("entity"), "entity", "left_anti").select(F.concat(F.lit("graph:"), F.col("entity").cast("string")).alias("id"), F.col("score").alias("similarity"), F.col("entity").cast("string").alias("reasoning"))
    return hit.unionByName(lone)


def auto_mounts(docs: DataFrame, kinds: DataFrame) -> DataFrame:
    """(doc, node): documents mounted where a level and a subject both hold, rubrics and transversal ones anywhere
    of their level; each pair once. docs: (doc, tag); kinds: (node, level_tag, subject_tag)."""
    level = docs.select("doc", F.col("tag").alias("level_tag"))
    subject = docs.select(F.col("doc").alias("d2"), F.col("tag").alias("subject_tag"))
    both = kinds.join(level, "level_tag").join(subject, "subject_tag").where("doc = d2").select("doc", "node")
    free = kinds.join(level, "level_tag").join(docs.where("tag in ('rubric', 'transversal')").select("doc").distinct(), "doc", "left_semi").select("doc", "node")
    return both.unionByName(free).distinct()
