"""Phrase collocations: frequent words as ids, phrases as fixed-width keys, counted by a range-partitioned sort.

Every place of a text gives one key, the ids of up to four words that follow in its piece. Sorted, the places that begin
with a phrase stand together, so one sort counts the phrases of two, three and four words at once as runs of equal
prefixes. Keys lie in blobs of sorted runs, sixteen bytes a key; Spark moves and places blobs, numpy sorts them.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import dropped, numbered, resident, stream_arrow, written

#: Words of a phrase at most; the least count of a candidate.
WIDEST = 4
LEAST = 30
#: Phrases kept for a language.
KEPT = 2000
#: Words of the dictionary that all tasks get, the most frequent ones of at most WORD_BYTES; other words are joined.
HEAD = 1 << 19
WORD_BYTES = 64
#: Distinct words and keys gathered before they are handed on, keys of a blob, bytes of a text cut into words at once.
FLUSH_WORDS, FLUSH, BLOB, SLICE = 1 << 17, 1 << 18, 1 << 13, 1 << 20
#: Keys of a range of the sort; samples of keys and
#: ranges at most (ranges of more keys beyond 34 thousand million keys).
RANGE_KEYS = 1 << 19
SAMPLES, RANGES = 1 << 18, 1 << 16

# What ends a piece, what parts words. 0xFF is in no UTF-8 text and stands for the end of a piece.
ENDS = b".,;:!?\n\x0b\x0c\r"
_BREAK = 0xFF
_TABLE = bytes(_BREAK if c in ENDS else c + 32 if 65 <= c <= 90 else c for c in range(256))
_AS_SPACES = bytes(32 if c in ENDS else c + 32 if 65 <= c <= 90 else c for c in range(256))


_GAP = re.compile(rb"[ \t\xff]")


def _slices(raw: bytes):
    """A text in parts that end where a word does, so that no list holds all words of a very long one."""
    at = 0
    while at < len(raw):
        end = _GAP.search(raw, at + SLICE) if at + SLICE < len(raw) else None
        stop = end.start() if end else len(raw)
        yield raw[at:stop]
        at = stop


def _lang(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))


def word_counts(docs: DataFrame, least: int) -> DataFrame:
    """(lang, word, f) of words with f of at least `least`, and of word null: all words of the language."""

    def run(batches):
        held: Counter = Counter()
        total: Counter = Counter()

        def flush():
            keys = [*held, *((g, None) for g in total)]
            counts = [*held.values(), *total.values()]
            words = pa.array([w for _, w in keys], pa.binary()).cast(pa.string())
            out = pa.RecordBatch.from_arrays([pa.array([g for g, _ in keys], pa.string()), words, pa.array(counts, pa.int64())], ["lang", "word", "c"])
            held.clear()
            total.clear()
            return out

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary())):
                total[lang] += 0
                for part in _slices(text.as_py().translate(_AS_SPACES)):
                    found = part.split()
                    total[lang] += len(found)
                    for w, c in Counter(found).items():
                        held[lang, w] += c
                    if len(held) >= FLUSH_WORDS:
                        yield flush()
        if total:
            yield flush()

    counted = stream_arrow(_lang(docs), run, "lang string, word string, c long").groupBy("lang", "word").agg(F.sum("c").alias("f"))
    return counted.where(F.col("word").isNull() | (F.col("f") >= least))


_head: dict = {}


def _ids(sent) -> dict[str, dict[bytes, int]]:
    """The broadcast dictionary as this worker's maps, one for each language."""
    name, broadcast = sent
    if _head.get("of") != name:
        _head.clear()
        t = pa.ipc.open_stream(broadcast.value).read_all()
        maps: dict = defaultdict(dict)
        for g, w, k in zip(t.column("lang").to_pylist(), t.column("word").cast(pa.binary()).to_pylist(), t.column("id").to_pylist()):
            maps[g][w] = k
        _head.update({"of": name, "maps": maps})
        resident("collocations", _head.clear)
    return _head["maps"]


def _sent(dictionary: DataFrame, head: int):
    """The broadcast head of the dictionary with a name of its own, and whether words are left besides it."""
    rows = dictionary.where(F.octet_length("word") <= WORD_BYTES).orderBy(F.desc("f"), "id").limit(head).select("lang", "word", "id").toArrow()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as out:
        out.write_table(rows)
    sent = dictionary.sparkSession.sparkContext.broadcast(sink.getvalue().to_pybytes())
    return (uuid.uuid4().hex, sent), dictionary.count() > rows.num_rows


def _with_rest(texts: DataFrame, dictionary: DataFrame, sent) -> DataFrame:
    """texts with `rest`, the ids of their words that are frequent but not in the broadcast head: joined, by text."""

    def run(batches):
        maps = _ids(sent)
        for batch in batches:
            for lang, text, k in zip(*(batch.column(c).to_pylist() for c in ("lang", "text", "k"))):
                known = maps.get(lang, {})
                left = [w for w in set(text.encode().translate(_AS_SPACES).split()) if w not in known]
                if left:
                    yield pa.RecordBatch.from_arrays([pa.array([k] * len(left), pa.binary()), pa.array([lang] * len(left)), pa.array(left, pa.binary()).cast(pa.string())], ["k", "lang", "word"])

    keyed = texts.withColumn("k", F.unhex(F.sha2(F.concat("lang", F.lit("\n"), "text"), 256)))
    missing = stream_arrow(keyed, run, "k binary, lang string, word string", keeps="collocations").distinct()
    found = missing.join(dictionary.select("lang", "word", "id"), ["lang", "word"]).groupBy("k").agg(F.collect_list(F.struct("word", "id")).alias("rest"))
    return keyed.join(found, "k", "left").select("lang", "text", "rest")


def _keys(ids: np.ndarray) -> np.ndarray:
    """(high, low) keys of the places where two known words stand together; an id of 0 ends a phrase."""
    a = np.concatenate([ids, np.zeros(3, np.uint64)])
    at = np.flatnonzero((a[:-1] > 0) & (a[1:] > 0))
    third = a[at + 2]
    fourth = np.where(third > 0, a[np.minimum(at + 3, len(a) - 1)], 0)
    return np.stack([a[at] << np.uint64(32) | a[at + 1], third << np.uint64(32) | fourth])


def _runs(keys: np.ndarray, counts: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with their counts."""
    order = np.lexsort((keys[1], keys[0]))
    keys = keys[:, order]
    if not keys.shape[1]:
        return keys, np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(axis=0)]))
    c = np.diff(first, append=keys.shape[1]) if counts is None else np.add.reduceat(counts[order], first)
    return keys[:, first], c.astype(np.int64)


def _blob(keys: np.ndarray) -> bytes:
    return np.ascontiguousarray(keys.T.astype(">u8")).tobytes()


def _unblob(raw) -> np.ndarray:
    return np.frombuffer(raw, ">u8").reshape(-1, 2).T.astype(np.uint64)


def place_keys(docs: DataFrame, dictionary: DataFrame, head: int) -> DataFrame:
    """(keys, counts, n): blobs of sorted distinct keys of places, with how often each came. Blobs are small rows, since
    readers and writers of tables hold many rows at once."""
    sent, more = _sent(dictionary, head)
    texts = _lang(docs)
    if more:
        texts = _with_rest(texts, dictionary, sent)

    def run(batches):
        maps = _ids(sent)
        held, size = [], 0

        def flush():
            keys, counts = _runs(np.concatenate(held, axis=1), None)
            held.clear()
            for lo in range(0, len(counts), BLOB):
                c = counts[lo : lo + BLOB]
                yield pa.RecordBatch.from_pydict({"keys": pa.array([_blob(keys[:, lo : lo + BLOB])], pa.binary()), "counts": pa.array([c.astype(">i8").tobytes()], pa.binary()), "n": pa.array([len(c)], pa.int64())})

        for batch in batches:
            rest = batch.column("rest").to_pylist() if more else [None] * batch.num_rows
            for lang, text, extra in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()), rest):
                known = maps.get(lang, {})
                if extra:
                    known = _Both({x["word"].encode(): x["id"] for x in extra}, known)
                ids = []
                for part in _slices(text.as_py().translate(_TABLE)):
                    found = part.replace(b"\xff", b" \xff ").split()
                    ids.append(np.fromiter((known.get(w, 0) for w in found), np.uint64, len(found)))
                if not ids:
                    continue
                keys = _keys(np.concatenate(ids))
                for lo in range(0, keys.shape[1], FLUSH):
                    held.append(keys[:, lo : lo + FLUSH])
                    size += held[-1].shape[1]
                    if size >= FLUSH:
                        yield from flush()
                        size = 0
        if size:
            yield from flush()

    return stream_arrow(texts, run, "keys binary, counts binary, n long", keeps="collocations")


class _Both:
    """Two maps as one."""

    def __init__(self, first: dict, then: dict):
        self.first, self.then = first, then

    def get(self, word: bytes, default: int) -> int:
        return self.first.get(word) or self.then.get(word, default)


def _splitters(blobs: DataFrame, range_keys: int) -> np.ndarray:
    """Keys that part the sorted keys into ranges of about range_keys, from an even sample of SAMPLES keys at most
    and one a blob."""
    total = blobs.agg(F.sum("n")).head()[0] or 0
    ranges = min(RANGES, -(-total // range_keys))
    if ranges <= 1:
        return np.zeros((2, 0), np.uint64)
    step = max(1, total // SAMPLES)

    def run(batches):
        seen = 0
        for batch in batches:
            for raw in batch.column("keys").to_pylist():
                keys = _unblob(raw)
                picked = keys[:, (-seen) % step :: step]
                seen += keys.shape[1]
                yield pa.RecordBatch.from_pydict({"keys": pa.array([_blob(picked)], pa.binary())})

    raw = b"".join(stream_arrow(blobs.select("keys"), run, "keys binary").toArrow().column("keys").to_pylist())
    keys = _unblob(raw)
    keys = keys[:, np.lexsort((keys[1], keys[0]))]
    return np.unique(keys[:, np.arange(1, ranges) * keys.shape[1] // ranges], axis=1)


def _bound(keys: np.ndarray, high: int, low: int) -> int:
    """How many sorted keys are below one."""
    lo, hi = np.searchsorted(keys[0], high, "left"), np.searchsorted(keys[0], high, "right")
    return int(lo + np.searchsorted(keys[1, lo:hi], low, "left"))


def phrase_counts(blobs: DataFrame, least: int, range_keys: int) -> DataFrame:
    """(phrase, f) of every phrase of two words and more with f of at least `least`; a phrase is its ids, 4 bytes each.

    Every range of keys is one group: blobs are cut at the ranges' ends, so a group holds about range_keys keys. Each
    task has added equal keys up, so a key that fills a third of all places comes once a blob. Runs that reach a
    range's ends may go on in the next; their parts are added afterwards.
    """
    split = _splitters(blobs, range_keys)

    def cut(batches):
        for batch in batches:
            for raw, c in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist()):
                keys, counts = _unblob(raw), np.frombuffer(c, ">i8")
                at = [0, *(_bound(keys, h, l) for h, l in split.T), keys.shape[1]]
                for p in range(len(at) - 1):
                    lo, hi = at[p], at[p + 1]
                    if hi > lo:
                        yield pa.RecordBatch.from_pydict({"part": pa.array([p], pa.int64()), "keys": pa.array([_blob(keys[:, lo:hi])], pa.binary()), "counts": pa.array([counts[lo:hi].tobytes()], pa.binary())})

    def count(table: pa.Table) -> pa.Table:
        keys = np.concatenate([_unblob(r) for r in table.column("keys").to_pylist()], axis=1)
        counts = np.concatenate([np.frombuffer(r, ">i8") for r in table.column("counts").to_pylist()]).astype(np.int64)
        keys, counts = _runs(keys, counts)
        half = np.uint64(32)
        # whether a key begins with other words than the one before: two, three, all four of them
        two = keys[0, 1:] != keys[0, :-1]
        three = two | (keys[1, 1:] >> half != keys[1, :-1] >> half)
        whole = {2: None, 3: keys[1] >> half > 0, 4: keys[1] & np.uint64(0xFFFFFFFF) > 0}
        phrases, f = [], []
        for width, new in ((2, two), (3, three), (4, np.ones(len(two), bool))):
            first = np.flatnonzero(np.concatenate([[True], new]))
            c = np.add.reduceat(counts, first)
            keep = c >= least
            keep[[0, -1]] = True
            if whole[width] is not None:
                keep &= whole[width][first]
            raw = _blob(keys[:, first[keep]])
            phrases += [raw[k : k + 4 * width] for k in range(0, len(raw), 16)]
            f.append(c[keep])
        return pa.table({"phrase": pa.array(phrases, pa.binary()), "f": pa.array(np.concatenate(f), pa.int64())})

    parts = stream_arrow(blobs.select("keys", "counts"), cut, "part long, keys binary, counts binary").groupBy("part").applyInArrow(count, "phrase binary, f long")
    return parts.groupBy("phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= least)


def _some(phrase: Column, first: int, n: Column | int) -> Column:
    return F.substring(phrase, 4 * first + 1, 4 * n if isinstance(n, int) else n)


def _score(a: Column, both: Column) -> Column:
    """floor(2000000 a / (l + r)) in decimals: the product may pass 64 bits."""
    return F.floor(F.lit(2000000).cast("decimal(7,0)") * a.cast("decimal(19,0)") / both.cast("decimal(20,0)")).cast("long")


def collocations(docs: DataFrame, *, least: int = LEAST, kept: int = KEPT, head: int = HEAD, range_keys: int = RANGE_KEYS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's first `kept` phrases of docs(lang, text).

    Lower-cased A-Z, pieces end at .,;:!? and line ends, words at spaces and tabs. A phrase of two to four words that
    comes a >= `least` times in pieces (overlaps count) scores floor(2000000 a / (l + r)) for the cut of least score (the
    first of equals), l and r being how often its parts come. It goes if its words stand together within a longer
    candidate that comes at least 0.8 times as often. n counts the language's words. Order: score and a descending,
    phrase ascending by bytes. Null languages are `und` (one language with texts so labelled), null and empty texts have
    no words; repeated rows count again.

    The broadcast dictionary has `head` words at most; frequent words beyond it get their ids by a join. A word of
    fewer than `least` occurrences ends a phrase, as no phrase with it can be a candidate.
    """
    counted = written(word_counts(docs, least), "words")
    n_words = counted.where("word IS NULL").select("lang", F.col("f").alias("n"))
    numbers, held = numbered(counted.where("word IS NOT NULL"), "lang", "word", name="numbers", into="at")
    dictionary = written(numbers.select("lang", "word", "f", (F.col("at") + 1).alias("id")), "dictionary")
    dropped(held)
    blobs = written(place_keys(docs, dictionary, head), "keys")
    phrases = written(phrase_counts(blobs, least, range_keys), "phrases")
    dropped(blobs)

    key = F.unhex(F.lpad(F.hex("id"), 8, "0"))
    known = phrases.unionAll(dictionary.select(key.alias("phrase"), "f"))
    width = F.octet_length("phrase") / 4
    cuts = phrases.select("phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), width.cast("int") - 1)).alias("k"))
    cuts = cuts.select("phrase", "a", "k", F.expr("substring(phrase, 1, 4 * k)").alias("left"), F.expr("substring(phrase, 4 * k + 1)").alias("right"))
    l = known.select(F.col("phrase").alias("left"), F.col("f").alias("l"))
    r = known.select(F.col("phrase").alias("right"), F.col("f").alias("r"))
    scored = cuts.join(l, "left").join(r, "right").withColumn("score", _score(F.col("a"), F.col("l") + F.col("r")))
    best = scored.groupBy("phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    inner = phrases.where(width > 2).select("phrase", "f", F.explode(F.expr("flatten(transform(sequence(2, cast(octet_length(phrase) / 4 AS int) - 1), m -> transform(sequence(0, cast(octet_length(phrase) / 4 AS int) - m), i -> substring(phrase, 4 * i + 1, 4 * m))))")).alias("part"))
    longer = inner.groupBy(F.col("part").alias("phrase")).agg(F.max("f").alias("longer"))
    covered = F.col("longer").cast("decimal(19,0)") * 5 >= F.col("a").cast("decimal(19,0)") * 4
    alone = best.join(longer, "phrase", "left").where(F.coalesce(~covered, F.lit(True)))

    # the language is that of the first word; the words are fetched for those that can be among the first
    first = dictionary.select(F.col("id").alias("__id"), "lang")
    told = alone.withColumn("__id", F.conv(F.hex(_some(F.col("phrase"), 0, 1)), 16, 10).cast("long")).join(first, "__id").select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    near = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    front = written(told.withColumn("__r", F.rank().over(near)).where(F.col("__r") <= kept).drop("__r"), "front")
    ids = front.select("phrase", F.posexplode(F.expr("transform(sequence(0, cast(octet_length(phrase) / 4 AS int) - 1), i -> cast(conv(hex(substring(phrase, 4 * i + 1, 4)), 16, 10) AS long))")).alias("at", "id"))
    spelt = ids.join(dictionary.select("id", "word"), "id").groupBy("phrase").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("w"))
    spelt = spelt.select("phrase", F.array_join(F.col("w.word"), " ").alias("text"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "text")
    out = front.join(spelt, "phrase").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= kept).join(n_words, "lang")
    return out.select("lang", F.col("rank").cast("long").alias("rank"), F.col("text").alias("phrase"), "a", "l", "r", "n", "score")
