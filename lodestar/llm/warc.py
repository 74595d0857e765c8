"""WARC archives: monolithic gzip files normalised to one member for each record, with sidecar offset indexes.

Archives are written by executors into a folder that all share, each under a name of its own that is moved
into place whole; a rerun task writes another file, and only files that the index table names are read.
"""

from __future__ import annotations

import hashlib
import io
import json
import os
import re
import uuid
import zlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import map_arrow, passes, qualified, shared_path, stream_arrow, wanted_filter, written

#: Uncompressed bytes from which a new archive begins; a record is never split.
ARCHIVE_BYTES = 32 << 20
#: Payloads shorter than this are stored whole even if repeated.
REVISIT_BYTES = 100
#: Repeated payloads up to which their first holders are sent to all tasks, about 9 MB. The plan changes, not the result.
FEW = 100_000
#: Equal rows that one task makes again from a group.
REPEATS = 4096
#: Bytes of a record's head; what is longer isn't one.
HEAD_BYTES = 1 << 20
_CHUNK = 1 << 18


class Store:
    """Files of a shared folder by a URI with its scheme: file: directly, other file systems through pyarrow."""

    def __init__(self, uri: str, create: bool = True):
        if uri.startswith(("file:", "/")):
            self.fs, self.root = None, "/" + uri.removeprefix("file:").lstrip("/")
            if create:
                os.makedirs(self.root, exist_ok=True)
        else:
            from pyarrow import fs

            self.fs, self.root = fs.FileSystem.from_uri(uri)

    def create(self, name: str):
        return open(f"{self.root}/{name}", "wb") if self.fs is None else self.fs.open_output_stream(f"{self.root}/{name}", compression=None)

    def open(self, name: str):
        return open(f"{self.root}/{name}", "rb") if self.fs is None else self.fs.open_input_file(f"{self.root}/{name}")

    def move(self, a: str, b: str) -> None:
        if self.fs is None:
            os.replace(f"{self.root}/{a}", f"{self.root}/{b}")
        else:
            self.fs.move(f"{self.root}/{a}", f"{self.root}/{b}")

    def delete(self, name: str) -> None:
        if self.fs is None:
            os.remove(f"{self.root}/{name}")
        else:
            self.fs.delete_file(f"{self.root}/{name}")


def record(kind: str, uri: str, page_id: int | None, payload: bytes, digest: str, length: int, refers_to: int | None) -> bytes:
    """One WARC/1.1 record. A revisit has no body; the full payload's length and digest are in headers."""
    body = payload if kind == "response" else b""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:lodestar:page:{'null' if page_id is None else page_id}>", f"WARC-Target-URI: {_line(uri)}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {length}"]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:lodestar:page:{refers_to}>"]
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def _line(x: str) -> str:
    """A header value on one line."""
    return "".join(c if c.isprintable() else "".join(f"%{b:02X}" for b in c.encode()) for c in x)


class Cut(ValueError):
    """An archive that ends, or stops being one, within a record or a gzip member."""


def inflated(f):
    """Chunks of a gzip file, of one member or many. What isn't gzip after a whole member raises Cut, as does an
    unfinished member, once all that could be inflated has been given; zero padding at the end is none of it."""
    d, fresh = zlib.decompressobj(31), True
    while raw := f.read(_CHUNK):
        while raw:
            if fresh and not (raw := raw.lstrip(b"\0")):
                break
            fresh = False
            try:
                out = d.decompress(raw, _CHUNK * 4)
            except zlib.error as e:
                raise Cut(f"not gzip: {e}") from e
            if out:
                yield out
            if d.eof:
                raw, d, fresh = d.unused_data, zlib.decompressobj(31), True
            else:
                raw = d.unconsumed_tail
    if out := d.flush():
        yield out
    if not fresh:
        raise Cut("the last gzip member is cut short")


_HEAD_END = re.compile(rb"\r?\n\r?\n")
_BLANKS = re.compile(rb"[\r\n]*")


class Headers(dict):
    """Header fields by lower-case name; looked up in any case."""

    def __getitem__(self, name: str) -> str:
        return super().__getitem__(name.lower())

    def get(self, name: str, default=None):
        return super().get(name.lower(), default)


def headers(raw: bytes) -> Headers:
    """The fields of a record's head: any case, any space around the colon, folded lines joined; of a repeated field the
    first counts. Bytes that aren't UTF-8 are read as Latin-1."""
    try:
        text = raw.decode("utf-8")
    except UnicodeDecodeError:
        text = raw.decode("latin-1")
    lines: list[str] = []
    for x in text.replace("\r\n", "\n").split("\n"):
        if x[:1] in (" ", "\t") and len(lines) > 1:
            lines[-1] += " " + x.strip()
        else:
            lines.append(x)
    if not lines[0].upper().startswith("WARC/"):
        raise Cut("no WARC record begins here")
    out = Headers()
    for x in lines[1:]:
        name, colon, value = x.partition(":")
        if colon:
            out.setdefault(name.strip().lower(), value.strip())
    return out


def records(chunks):
    """(headers, record bytes, body offset) of each record of a WARC stream, held one at a time.

    Lines may end in a line feed alone, and any number of blank lines may stand between records; a record's bytes
    are given with its own. Raises Cut at a record that is cut short.
    """
    held = bytearray()
    chunks = iter(chunks)

    def fill(n):
        while len(held) < n:
            x = next(chunks, None)
            if x is None:
                return False
            held.extend(x)
        return True

    while fill(1):
        del held[: _BLANKS.match(held).end()]
        if not held:
            continue
        seen = 0
        while not (end := _HEAD_END.search(held, seen)):
            seen = max(0, len(held) - 3)
            if seen > HEAD_BYTES:
                raise Cut("no WARC record's head ends here")
            if not fill(len(held) + 1):
                raise Cut("a WARC record is cut short")
        head = headers(bytes(held[: end.start()]))
        n = head.get("Content-Length", "")
        if not (n.isascii() and n.isdigit()):
            raise Cut("a WARC record without a length")
        total = end.end() + int(n)
        if not fill(total):
            raise Cut("a WARC record is cut short")
        fill(total + 4)
        total += min(_BLANKS.match(held, total).end() - total, 4)
        yield head, bytes(held[:total]), end.end()
        del held[:total]


def _digest(head: Headers, raw: bytes, body: int) -> str:
    """The payload digest that a record states, else that of its block."""
    return head.get("WARC-Payload-Digest") or "sha256:" + hashlib.sha256(raw[body : body + int(head["Content-Length"])]).hexdigest()


def normalise(source, target, level: int = 6):
    """Rewrite a monolithic gzip WARC so that each record is a member of its own.

    Inflates the stream once. Yields the offset index's entries (offset, length, record id, type, digest); an id or a
    type that a record lacks is None, a digest is then that of its block.
    """
    at = 0
    for head, raw, body in records(inflated(source)):
        z = zlib.compressobj(level, zlib.DEFLATED, 31)
        member = z.compress(raw) + z.flush()
        target.write(member)
        yield at, len(member), head.get("WARC-Record-ID"), head.get("WARC-Type"), _digest(head, raw, body)
        at += len(member)


def read_member(f, offset: int, length: int):
    """(headers, body) of the record at an index entry."""
    f.seek(offset)
    raw = zlib.decompress(f.read(length), 31)
    head, full, body = next(records([raw]))
    return head, full[body : body + int(head["Content-Length"])]


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write (page_id, url, payload, digest, n, kind, refers_to) as monolithic archives, normalise each, and
    return its offset index (archive, offset, length); the sidecar file beside it holds the same."""

    def run(batches):
        store = Store(folder)
        name = z = out = None
        size = 0

        def closed():
            out.write(z.flush())
            out.close()
            rows = []
            with store.open(f"{name}.tmp") as src, store.create(f"{name}.warc.tmp") as dst:
                rows = list(normalise(src, dst))
            with store.create(f"{name}.idx.tmp") as side:
                for r in rows:
                    side.write((json.dumps(r) + "\n").encode())
            store.move(f"{name}.idx.tmp", f"{name}.idx")
            store.move(f"{name}.warc.tmp", f"{name}.warc.gz")
            store.delete(f"{name}.tmp")
            return pa.RecordBatch.from_arrays([pa.array([f"{name}.warc.gz"] * len(rows), pa.string()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], ["archive", "offset", "length"])

        for b in batches:
            for page, url, payload, digest, n, kind, ref in zip(*(b.column(k).to_pylist() for k in ("page_id", "url", "payload", "digest", "n", "kind", "refers_to"))):
                if out is None:
                    name, size = uuid.uuid4().hex, 0
                    out, z = store.create(f"{name}.tmp"), zlib.compressobj(1, zlib.DEFLATED, 31)
                raw = record(kind, url or "", page, payload, digest, n, ref)
                out.write(z.compress(raw))
                size += len(raw)
                if size >= ARCHIVE_BYTES:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    cols = ["page_id", "url", "payload", "digest", "n", "kind", "refers_to"]
    return stream_arrow(pages.select(cols), run, "archive string, offset long, length long")


def read_archives(index: DataFrame, folder: str) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, body_digest) of every indexed record."""

    def number(x):
        x = x.rpartition(":")[2].rstrip(">")
        return None if x == "null" else int(x)

    def one(b):
        store, rows, name, f = Store(folder), [], None, None
        for archive, at, n in zip(*(b.column(k).to_pylist() for k in ("archive", "offset", "length"))):
            if archive != name:
                if f is not None:
                    f.close()
                name, f = archive, store.open(archive)
            head, body = read_member(f, at, n)
            kind = head["WARC-Type"]
            rows.append((number(head["WARC-Record-ID"]), head["WARC-Target-URI"], int(head["X-Payload-Length"]), head["WARC-Payload-Digest"][7:], kind, number(head["WARC-Refers-To"]) if kind == "revisit" else None, hashlib.sha256(body).hexdigest() if kind == "response" else None, len(body)))
        if f is not None:
            f.close()
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        cols = list(zip(*rows)) if rows else [[] for _ in kinds]
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "body_digest", "body_bytes"])

    return map_arrow(index.select("archive", "offset", "length"), one, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, body_digest string, body_bytes long")


def normalise_archives(files: DataFrame, path_col: str = "path", folder: str | None = None) -> DataFrame:
    """Normalise existing gzip WARC files, by whomever they were written: a row for each record of the new archives.

    files holds their paths as URIs, each read once by one task and never held whole (a record is). Returns source, archive,
    offset, length, record_id, record_type, payload_digest, error. A file that ends within a record, or goes on
    with what isn't gzip, gives all its whole records and one more row with the reason in error and nulls
    elsewhere; so does a file that can't be opened. An empty file gives none. Null paths are passed over; a
    repeated path is normalised each time that it is there. Other columns are ignored. The archives stand once the
    result has been written.
    """
    spark = files.sparkSession
    folder = qualified(spark, folder) if folder else shared_path(spark, "warc")
    names = ["source", "archive", "offset", "length", "record_id", "record_type", "payload_digest", "error"]

    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64()] + [pa.string()] * 4

    def table(rows):
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)], names)

    def one(out, path):
        home, _, leaf = path.rpartition("/")
        name, rows, error, n = uuid.uuid4().hex, [], None, 0
        try:
            src = Store(home, create=False).open(leaf)
        except OSError as e:
            yield table([(path, *[None] * 6, str(e))])
            return
        with src, out.create(f"{name}.warc.tmp") as dst, out.create(f"{name}.idx.tmp") as side:
            entries = normalise(src, dst)
            while True:
                try:
                    r = next(entries, None)
                except (Cut, OSError) as e:
                    error = str(e)
                    break
                if r is None:
                    break
                n += 1
                side.write((json.dumps(r) + "\n").encode())
                rows.append((path, f"{name}.warc.gz", *r, None))
                if len(rows) == 4096:
                    yield table(rows)
                    rows = []
        if n:
            out.move(f"{name}.idx.tmp", f"{name}.idx")
            out.move(f"{name}.warc.tmp", f"{name}.warc.gz")
        else:
            out.delete(f"{name}.idx.tmp")
            out.delete(f"{name}.warc.tmp")
        if error is not None:
            rows.append((path, *[None] * 6, error))
        if rows:
            yield table(rows)

    def run(batches):
        out = Store(folder)
        for b in batches:
            for path in b.column("path").to_pylist():
                yield from one(out, path)

    paths = files.select(F.col(path_col).alias("path")).where("path is not null").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return stream_arrow(paths, run, "source string, archive string, offset long, length long, record_id string, record_type string, payload_digest string, error string")


def archived(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", folder: str | None = None) -> DataFrame:
    """Write every page as a WARC record, then read all archives back.

    Of pages with equal payloads of REVISIT_BYTES or more, that of smallest page_id is a response and the
    others are revisits that refer to it; of rows that repeat such an id the smallest url decides, then any one
    of them, as they are equal. Null ids sort last; a group of null ids only has no one to refer to and is all
    responses. A null html is empty, a null url too. Other columns are ignored. A response's stored body must
    have the digest its header says.
    """
    spark = pages.sparkSession
    folder = qualified(spark, folder) if folder else shared_path(spark, "warc")
    p = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8").alias("payload"))
    p = p.withColumn("n", F.octet_length("payload").cast("long")).withColumn("digest", F.sha2("payload", 256))
    # first holders of repeated payloads; only digests, ids and urls are shuffled
    same = p.where(F.col("n") >= REVISIT_BYTES).groupBy("digest", "page_id", "url").agg(F.count("*").alias("c"))
    first = same.groupBy("digest").agg(F.min(F.struct(F.col("page_id").isNull(), "page_id", "url", "c")).alias("x"), F.sum("c").alias("all"))
    first = first.where("all > 1 and x.page_id is not null").select(F.col("digest").alias("fd"), F.col("x.page_id").alias("first"), F.col("x.url").alias("first_url"), F.col("x.c").alias("times"))
    first = written(first, "first")
    count = first.count()
    if count <= FEW:
        j = p.join(F.broadcast(first), p["digest"] == F.col("fd"), "left")
    else:
        # payloads that surely come once stay where they are; the filter is of bounded size
        bits = spark.sparkContext.broadcast(wanted_filter(first.select(F.xxhash64("fd").alias("h")), count))

        @F.pandas_udf("boolean")
        def maybe(h: pd.Series) -> pd.Series:
            return pd.Series(passes(h.to_numpy(), bits.value))

        again = maybe(F.xxhash64("digest"))
        once = p.where(~again).select("*", F.lit(None).cast("string").alias("fd"), F.lit(None).cast("long").alias("first"), F.lit(None).cast("string").alias("first_url"), F.lit(None).cast("long").alias("times"))
        j = once.unionByName(p.where(again).join(first, F.col("digest") == F.col("fd"), "left"))
    leads = F.col("page_id").eqNullSafe(F.col("first")) & (F.col("url") == F.col("first_url"))
    known = F.col("first").isNotNull()
    j = j.withColumn("kind", F.when(known & ~leads, "revisit").otherwise("response")).withColumn("refers_to", F.when(known & ~leads, F.col("first")))
    # rows that are equal in id, url and payload: of each group one is the response
    alike = known & leads & (F.col("times") > 1)
    cols = ["page_id", "url", "payload", "digest", "n", "kind", "refers_to"]
    one = j.where(alike).groupBy("page_id", "url", "digest").agg(F.first("payload").alias("payload"), F.first("n").alias("n"), F.first("times").alias("times"))
    # in blocks, so that no task makes all rows of a page that comes often; only the response carries the payload
    one = one.select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col("times") - 1) / REPEATS))).alias("b")).withColumn("payload", F.when(F.col("b") == 0, F.col("payload")))
    one = one.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "page_id", "url", "digest", "b")
    one = one.select("*", F.explode(F.sequence(F.col("b") * REPEATS + 1, F.least((F.col("b") + 1) * REPEATS, F.col("times")))).alias("k"))
    one = one.withColumn("payload", F.when(F.col("k") == 1, F.col("payload"))).withColumn("kind", F.when(F.col("k") == 1, "response").otherwise("revisit")).withColumn("refers_to", F.when(F.col("k") > 1, F.col("page_id")))
    rows = j.where(~F.coalesce(alike, F.lit(False))).select(cols)
    rows = rows.unionByName(one.select(cols)) if not first.where("times > 1").isEmpty() else rows
    index = written(write_archives(rows, folder), "index")
    back = read_archives(index, folder)
    sound = F.when((F.col("record_type") == "response") & ((F.col("body_digest") != F.col("payload_digest")) | (F.col("body_bytes") != F.col("payload_bytes"))), F.raise_error(F.concat(F.lit("a stored payload differs: page "), F.col("page_id")))).otherwise(F.col("payload_digest"))
    return back.select("page_id", "url", "payload_bytes", sound.alias("payload_digest"), "record_type", "refers_to")
