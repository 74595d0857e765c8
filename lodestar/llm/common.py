"""Helpers of the training-data operators: shared storage and Arrow text access."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import tempfile
import uuid
import weakref
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_DIR = "spark.checkpoint.dir"


#: Folders of applications whose setting is unset, by application.
_own: dict[str, str] = {}
#: Where written tables lie, while the DataFrame lives.
_paths: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, with its file system's scheme: the cluster's setting.

    Where it is unset, a temporary folder on a local master, and the session's default file system elsewhere.
    """
    found = spark.conf.get(CHECKPOINT_DIR, None) or _own.get(spark.sparkContext.applicationId)
    if not found:
        local = spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"
        found = "file://" + tempfile.mkdtemp(prefix="lodestar-") if local else "lodestar-shared"
        _own[spark.sparkContext.applicationId] = found
    return qualified(spark, found)


def qualified(spark: SparkSession, path: str) -> str:
    """A path with the scheme and authority of the file system that Spark takes it for."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.makeQualified(p).toString().rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver's Python ends."""
    path = f"{shared_dir(spark)}/lodestar-{uuid.uuid4().hex}/{name}"
    atexit.register(remove_path, spark, path.rpartition("/")[0])
    return path


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a path through Hadoop; silent only once the session has gone, when there is no one to ask."""
    if spark.sparkContext._jsc is None:
        return
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: lineage ends there and a lost executor costs nothing."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    _log.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


#: Paths of written tables, in order.
_log: list[str] = []


def tables_written() -> int:
    """How many tables were written so far: a mark for drop_tables."""
    return len(_log)


def drop_tables(spark: SparkSession, first: int, last: int) -> None:
    """Delete the tables written between two marks, once nothing reads them any more."""
    for k in range(first, last):
        remove_path(spark, _log[k])


def dropped(*tables: DataFrame | None) -> None:
    """Delete written tables that nothing reads any more."""
    for t in tables:
        if t is not None and (path := _paths.pop(t, None)):
            remove_path(t.sparkSession, path)


def release_shuffles(spark: SparkSession) -> None:
    """Let go of the shuffle files of ended plans: Spark deletes them once the driver has collected the plans, which a
    driver with room left may not do for half an hour."""
    gc.collect()
    spark._jvm.System.gc()


#: Bytes of an Arrow batch at most, so that a worker's memory doesn't grow with the length of texts.
BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Lower the bytes of the session's Arrow batches to the bound; a smaller setting stays. The setting is read when
    a plan runs, so it holds for the session from then on."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key)
    now = int(now[:-1] if now.endswith("b") else now) if now.rstrip("b").lstrip("-").isdigit() else 0
    if now <= 0 or now > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def text_chunks(column: pa.Array, size: int):
    """(first row, UTF-8 bytes, offsets) of runs of rows of about size bytes; a null text has length 0."""
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    _, offs, data = column.buffers()
    wide = pa.types.is_large_string(column.type)
    o = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    lo = 0
    while lo < n:
        hi = min(n, max(lo + 1, int(np.searchsorted(o, o[lo] + size, side="right")) - 1))
        raw = data.slice(int(o[lo]), int(o[hi] - o[lo])).to_pybytes() if data is not None else b""
        yield lo, raw, o[lo : hi + 1] - o[lo]
        lo = hi


#: What an operator keeps in a worker between tasks, with the function that frees it.
_resident: dict[str, Callable[[], None]] = {}


def resident(name: str, free: Callable[[], None]) -> None:
    """Tell that this worker keeps something large for later tasks of one operator."""
    _resident[name] = free


def release_others(name: str | None) -> None:
    """Free what other operators keep in this worker: workers serve one stage after the other."""
    gone = [k for k in _resident if k != name]
    for k in gone:
        _resident.pop(k)()
    if gone:
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(AttributeError, OSError):  # where the C library can't
            ctypes.CDLL(None).malloc_trim(0)


def stream_arrow(df: DataFrame, run, schema, keeps: str | None = None, rows: int | None = None) -> DataFrame:
    """mapInArrow over bounded batches. keeps: the name under which its tasks keep something in the worker; rows:
    how many rows the function sees at once, where its results are far larger than its input."""
    bounded_batches(df.sparkSession)

    def alone(batches):
        release_others(keeps)
        parts = batches if rows is None else (b.slice(lo, rows) for b in batches for lo in range(0, max(1, b.num_rows), rows))
        yield from run(parts)

    return df.mapInArrow(alone, schema)


def map_arrow(df: DataFrame, f, schema, keeps: str | None = None, rows: int | None = None) -> DataFrame:
    """stream_arrow with a function from one RecordBatch to one."""

    def run(batches):
        for b in batches:
            yield f(b)

    return stream_arrow(df, run, schema, keeps, rows)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Bits of a filter of hashes, 64 MB at most.
FILTER_BITS = (1 << 20, 1 << 29)


def wanted_filter(nodes: DataFrame, count: int) -> np.ndarray:
    """A Bloom filter (3 probes) of nodes(h long), 16 bits each up to FILTER_BITS; it only lets some others pass."""
    bits = min(max(1 << int(np.ceil(np.log2(max(count, 1) * 16))), FILTER_BITS[0]), FILTER_BITS[1])
    part = 1 << 16  # bits a row holds

    def one(batch):
        h = batch.column("h").to_numpy().astype(np.int64).view(np.uint64)
        at = np.unique(np.concatenate([mix(h + np.uint64(k * 0x9E3779B97F4A7C15 % 2**64)) & np.uint64(bits - 1) for k in range(3)]).astype(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(at // part), pa.array(at % part)], ["k", "at"])

    def packed(table):
        m = np.zeros(part, np.uint8)
        m[table.column("at").to_numpy()] = 1
        return pa.table({"k": table.column("k").slice(0, 1), "bits": pa.array([np.packbits(m).tobytes()], pa.binary())})

    rows = map_arrow(nodes.select("h"), one, "k long, at long").distinct().groupBy("k").applyInArrow(packed, "k long, bits binary").toArrow()
    out = np.zeros(bits // 8, np.uint8)
    for k, b in zip(rows.column("k").to_pylist(), rows.column("bits").to_pylist()):
        out[k * part // 8 : (k + 1) * part // 8] = np.frombuffer(b, np.uint8)
    return out


def passes(h: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Whether each hash may be in a filter."""
    ok = np.ones(len(h), bool)
    for k in range(3):
        at = mix(h.view(np.uint64) + np.uint64(k * 0x9E3779B97F4A7C15 % 2**64)) & np.uint64(len(bits) * 8 - 1)
        ok &= (bits[(at >> np.uint64(3)).astype(np.int64)] >> (7 - (at & np.uint64(7)).astype(np.uint8))) & 1 == 1
    return ok


def numbered(df: DataFrame, *order: str, name: str, into: str) -> tuple[DataFrame, DataFrame]:
    """The rows with their place (from 0) in the order of some columns, nulls first, and the table that they are read from.

    A range-partitioned sort writes them; the driver sees one count for each partition. A sort key that many rows share
    is split over partitions by the rows' own numbers.
    """
    spark = df.sparkSession
    own = df.withColumn("__tie", F.monotonically_increasing_id())
    keys = [*order, "__tie"]
    rows = written(own.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id()).drop("__tie"), name)
    part = F.shiftright("__at", 33)
    counts = sorted((r.p, r.n) for r in rows.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    offsets, total = [], 0
    for p, n in counts:
        offsets.append((p, total))
        total += n
    small = F.broadcast(spark.createDataFrame(offsets, "__p long, __offset long"))
    within = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.join(small, part == F.col("__p")).withColumn(into, F.col("__offset") + within).drop("__at", "__p", "__offset"), rows
