"""Sources: what documents are read from, by strategy. Only Spark's readers touch paths."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.text import strip_markup


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """(source_id, text) of plain text or markdown files, each whole."""
    d = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source_id"), F.col("value").alias("text"))
    return d


def html_files(spark: SparkSession, path: str) -> DataFrame:
    """(source_id, text) of HTML files without markup."""
    return text_files(spark, path).withColumn("text", strip_markup(F.col("text"), 1 << 30))


def binary_files(spark: SparkSession, path: str, extract: Callable[[bytes], str], glob: str = "*") -> DataFrame:
    """(source_id, text) of files through an injected extractor (PDF libraries are a port)."""
    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return x.map(extract)

    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select(F.col("path").alias("source_id"), run("content").alias("text"))


def parquet_rows(spark: SparkSession, path: str, columns: list[str] | None = None, where: str | None = None, order: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """A filtered scan: filters and columns reach the files."""
    d = spark.read.parquet(path)
    d = d.where(where) if where else d
    d = d.select(*columns) if columns else d
    d = d.orderBy(*order) if order else d
    return d.limit(limit) if limit is not None else d


def by_ids(df: DataFrame, ids: list, id_col: str = "id") -> DataFrame:
    """The rows of a request's ids."""
    return df.where(F.col(id_col).isin(list(dict.fromkeys(ids))))


#: Strategies by name; register() adds others.
STRATEGIES: dict[str, Callable[..., DataFrame]] = {"PRE_PROCESSED": text_files, "FAST_CONTENT": html_files, "CONTENT": html_files}


def register(name: str, f: Callable[..., DataFrame]) -> None:
    STRATEGIES[name] = f


def dispatch(spark: SparkSession, strategy: str, path: str, **options) -> DataFrame:
    if strategy not in STRATEGIES:
        raise ValueError(f"UNKNOWN_STRATEGY: {strategy}")
    return STRATEGIES[strategy](spark, path, **options)
