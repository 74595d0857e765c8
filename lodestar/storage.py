"""Tables that the engine writes for itself: in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: The cluster's setting of the shared folder.
SHARED = "spark.checkpoint.dir"
_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one on a local master, the default file system's elsewhere, if unset."""
    found = spark.conf.get(SHARED, None) or _own.get(spark.sparkContext.applicationId)
    if not found:
        local = spark.sparkContext.master.split("[")[0] == "local"
        found = _own[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="lodestar-") if local else "lodestar-shared"
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/lodestar-{uuid.uuid4().hex}/{name}"


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.delete(p, True)


def kept(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table of the shared folder: lineage ends there, and a lost executor costs nothing."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def replace_folders(df: DataFrame, path: str, key: str, touched: list[int], codec: str = "snappy") -> None:
    """Write df's folders by key anew, and delete those of `touched` that no row is left for, once the write is done."""
    spark = df.sparkSession
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", codec).partitionBy(key).parquet(path)
    left = {r[0] for r in df.select(key).distinct().collect()} if touched else set()
    for b in set(touched) - left:
        delete(spark, f"{path}/{key}={b}")
