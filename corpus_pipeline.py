"""A training corpus from documents: language ID, near-duplicate removal, PII surrogates, mixing, tokens.

A stage's result must be written before the next stage is called, as run() and any caller of STAGES does: the next
one deletes the helper tables that the result is read from.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.bpe import bpe_encode
from lodestar.llm.common import drop_tables, dropped, tables_written, written
from lodestar.llm.jaccard import jaccard_components
from lodestar.llm.langid import dictionaries, identify
from lodestar.llm.mixing import mix_documents
from lodestar.llm.surrogates import replace_pii

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


#: Marks of the tables that the stage before wrote for itself.
_before = [0, 0]


def _stage(f: Callable[[SparkSession, DataFrame, str], DataFrame]):
    """A stage that first deletes the helper tables of the one before: its result is written by then."""

    @wraps(f)
    def run(spark, docs, sf_dir):
        drop_tables(spark, *_before)
        first = tables_written()
        out = f(spark, docs, sf_dir)
        _before[:] = first, tables_written()
        return out

    return run


@_stage
def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a margin; und and narrow ones go. lang becomes the one told."""
    found = identify(docs.select(*COLUMNS), dictionaries(docs), keep=True)
    return found.where(~F.col("rejected")).withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def _keyed(docs: DataFrame) -> DataFrame:
    """The rows with a key of their own, written once: doc_id may be null or repeated."""
    return written(docs.select(*COLUMNS).withColumn("__row", F.monotonically_increasing_id()), "rows")


@_stage
def keep_one_of_alike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of rows whose five-word shingles are similar to 0.8 or more, the row of smallest doc_id.

    A row with a null id stays only if its component names no id; among equal ids a hash of the row decides.
    Rows without shingles are like nothing and stay.
    """
    rows = _keyed(docs)
    found = jaccard_components(rows, width=5, percent=80, id_col="__row").select(F.col("doc_id").alias("__row"), "component_id")
    place = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", F.xxhash64(*COLUMNS).alias("tie"), "__row")
    best = rows.select("__row", place.alias("place")).join(found, "__row").groupBy("component_id").agg(F.min("place").alias("place"))
    return rows.join(best.select(F.col("place.__row").alias("__row")), "__row", "left_semi").select(*COLUMNS)


@_stage
def replace_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data as surrogates; n_chars follows the new text."""
    return replace_pii(docs.select(*COLUMNS), count_col=None).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


@_stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each row as the mix takes."""
    rows = _keyed(docs)
    copies = mix_documents(rows, row_col="__row").where("copies > 0").select("__row", "copies")
    return rows.join(copies, "__row").select(*COLUMNS, F.explode(F.sequence(F.lit(1), "copies")).alias("__copy")).drop("__copy")


@_stage
def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids) of each row."""
    return bpe_encode(docs).select("doc_id", "n_tokens", "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", keep_identified),
    ("ngram_jaccard", keep_one_of_alike),
    ("pii_surrogates", replace_private),
    ("mix_sources", mix_sources),
    ("bpe", to_tokens),
]
#: No SQL states compression sizes, Newton's rates or BPE; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage's result is written and read again; the one before is then deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
            dropped(held)
            held = docs
    return docs
