"""Language identification by compression: the language whose zstandard dictionary makes a text smallest.

A dictionary holds a language's words, frequent ones last; whole passages would make any copy of them look
like the language they were seen in. Every piece is compressed behind a pad that ends all dictionaries alike:
it costs a few bytes, and keeps pieces that hardly shrink from being stored raw at the same size for all.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from lodestar.llm.common import map_arrow, stream_arrow, written

#: Training rows of a language, each read whole: the documented bound of the fit.
SAMPLE_ROWS = 2000
#: Candidates by hash for each row of the sample.
OVERSAMPLE = 4
#: Bytes of a language's dictionary.
DICT_BYTES = 96 << 10
LEVEL, MIN_MATCH = 6, 3
#: A text is compressed in pieces of so many characters, so that it is told by the dictionary, not by itself.
PIECE = 1024
#: Margins below this are rejected.
MARGIN = 0.004
_PAD = "".join(hashlib.sha256(bytes([k])).hexdigest() for k in range(8)).encode()
_OTHER = regex.compile(r"[^\p{L}\p{M}]+")
_LETTER = regex.compile(r"\p{L}")


def plain(text: str) -> str:
    """Lower case, each run of anything but letters and marks as one space."""
    return _OTHER.sub(" ", text.lower()).strip()


def dictionaries(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """A raw-content dictionary for each language of the labelled rows.

    Of each language the SAMPLE_ROWS different texts of smallest hash with a letter are taken, or all if there
    are fewer. Nothing but text and label is read; rows without either teach nothing, nor do texts without a
    letter. No labelled rows: no languages.
    """
    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text rlike '\\\\p{L}'")
    # different texts of each language, so that copies don't narrow the range below
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text")).alias("n")).collect()}
    if not counts:
        return {}
    # a hash range that holds a few times the sample, so that no task gathers candidates by the input's size
    spread = 1 << 32
    h = F.pmod(F.xxhash64("text"), F.lit(spread))
    edge = F.create_map(*(x for k, n in sorted(counts.items()) for x in (F.lit(k), F.lit(min(spread, spread * OVERSAMPLE * SAMPLE_ROWS // max(n, 1))).cast("long"))))[F.col("lang")]
    near = rows.where(h < edge).select("lang", h.alias("h"), F.xxhash64("text").alias("x")).distinct()
    w = Window.partitionBy("lang").orderBy("h", "x")
    last = near.withColumn("k", F.row_number().over(w)).where(F.col("k") <= SAMPLE_ROWS).groupBy("lang").agg(F.max(F.struct("h", "x")).alias("last")).collect()
    if not last:
        return {}
    # the sampled texts are counted where they are, whole; only counts leave the executors
    cut = F.create_map(*(y for r in last for y in (F.lit(r["lang"]), F.struct(F.lit(r["last"]["h"]).cast("long").alias("h"), F.lit(r["last"]["x"]).cast("long").alias("x")))))[F.col("lang")]
    took = rows.where((h < edge) & (F.struct(h.alias("h"), F.xxhash64("text").alias("x")) <= cut)).distinct()
    words = stream_arrow(took, _counted, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words = written(words.withColumn("place", F.substring(F.md5(F.encode("word", "UTF-8")), 1, 2)), "words")
    size: dict[str, int] = {}
    least: dict[str, tuple[int, str]] = {}
    levels = words.groupBy("lang", "n", "place").agg(F.sum(F.octet_length("word") + 1).alias("bytes")).collect()
    for r in sorted(levels, key=lambda r: (r["n"], r["place"]), reverse=True):
        if size.get(r["lang"], 0) <= DICT_BYTES:
            size[r["lang"]] = size.get(r["lang"], 0) + r["bytes"]
            least[r["lang"]] = (r["n"], r["place"])
    if not least:
        return {}
    low = F.create_map(*(y for k, (n, p) in least.items() for y in (F.lit(k), F.struct(F.lit(n).cast("long").alias("n"), F.lit(p).alias("place")))))[F.col("lang")]
    held: dict[str, list] = {}
    for r in words.where(F.struct("n", "place") >= low).select("lang", "word", "n").toArrow().to_pylist():
        held.setdefault(r["lang"], []).append((r["word"], r["n"]))
    order = lambda x: (x[1], hashlib.md5(x[0].encode()).digest())
    return {k: _joined([w.encode() for w, _ in sorted(c, key=order)]) for k, c in held.items()}


def _joined(words: list[bytes]) -> bytes:
    """The last words that DICT_BYTES hold, whole; one that alone is longer is left out."""
    out, size = [], 0
    for w in reversed(words):
        if size + len(w) + 1 <= DICT_BYTES:
            out.append(w)
            size += len(w) + 1
    return b" ".join(reversed(out))


def _counted(batches):
    """(lang, word, texts of the batch that hold it) of whole texts."""
    for b in batches:
        held = Counter()
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
            held.update((lang, w) for w in set(plain(text).split()))
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in held], pa.string()), pa.array([w for _, w in held], pa.string()), pa.array(list(held.values()), pa.int64())], ["lang", "word", "n"])


class Classifier:
    def __init__(self, raw: dict[str, bytes]):
        self.langs = sorted(raw)
        self.coders = []
        for k in [*self.langs, None]:  # the last knows no language
            d = zstandard.ZstdCompressionDict((b"" if k is None else raw[k]) + _PAD, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            params = zstandard.ZstdCompressionParameters.from_level(LEVEL, window_log=18, min_match=MIN_MATCH, write_content_size=0, write_checksum=0, write_dict_id=0)
            d.precompute_compress(compression_params=params)
            self.coders.append(zstandard.ZstdCompressor(dict_data=d, compression_params=params))

    def sizes(self, text: str) -> list[int] | None:
        """Compressed bytes of the whole text by language, and without any if one only is known; None without a letter."""
        if not _LETTER.search(text):
            return None
        t = plain(text)
        raw = [_PAD + t[k : k + PIECE].encode() for k in range(0, len(t), PIECE)]
        return [sum(len(c.compress(r)) for r in raw) for c in (self.coders[:-1] if len(self.langs) > 1 else self.coders)]

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, margin between the best size and the next as a share of the next); `und`, 0 without a letter.

        A lone language is held against no dictionary at all.
        """
        found = self.sizes(text) if text and self.langs else None
        if found is None:
            return "und", 0.0
        if len(self.langs) == 1:
            return self.langs[0], max(0.0, (found[1] - found[0]) / found[1])
        ranked = sorted(zip(found, self.langs))
        return ranked[0][1], (ranked[1][0] - ranked[0][0]) / ranked[1][0]


def identify(docs: DataFrame, raw: dict[str, bytes], margin: float = MARGIN, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) of every whole text; with keep, after the input's own columns.

    A null text or one without a letter is `und`, score 0 and rejected; ties go to the first language by
    code point. Kept columns of the same names as results are replaced.
    """
    held: list[Classifier] = []
    out = [("lang_pred", pa.string(), "string"), ("score", pa.float64(), "double"), ("rejected", pa.bool_(), "boolean")]
    own = text_col
    if not keep:
        src, own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("__text")), "__text"
    elif text_col in {x[0] for x in out}:
        src, own = docs.withColumn("__text", F.col(text_col)).drop(*(x[0] for x in out)), "__text"
    else:
        src = docs.drop(*(x[0] for x in out))
    passed = [c for c in src.columns if c != "__text"]

    def one(batch):
        if not held:
            held.append(Classifier(raw))
        langs, scores = [], []
        for x in batch.column(own):
            a, s = held[0].predict(x.as_py())
            langs.append(a)
            scores.append(s)
        new = [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array([a == "und" or s < margin for a, s in zip(langs, scores)], pa.bool_())]
        return pa.RecordBatch.from_arrays([*(batch.column(n) for n in passed), *new], [*passed, *(x[0] for x in out)])

    schema = StructType([f for f in src.schema.fields if f.name != "__text"])
    for name, _, kind in out:
        schema = schema.add(name, kind)
    return map_arrow(src, one, schema)
