"""Exact n-gram Jaccard self-join by set-relation skipping.

Postings of each text's prefix (its rarest shingles) meet by shingle. Index lists are ordered by set
size and cut into the blocks a size can reach; whole blocks are skipped, and entries whose positions
leave too little behind are passed over. A list's least edited set becomes the pivot its other members
vote for; a member is stored as its difference from the pivot, and the answers among members come
incrementally from the pivot's: |a & b| = |L| - |a- | b-| + |a+ & b+|. Only candidate pairs whose
members chose different pivots are compared set by set. Nothing is capped: sizes of helper tables
(frequent shingles, the membership filter) bound memory only, not results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import dropped, map_arrow, mix, passes, release_shuffles, stream_arrow, wanted_filter, written
from lodestar.llm.components import connected_components
from lodestar.llm.shingles import CHUNK, batch_sets, shingle_sets

#: Entries of the frequent-shingle table; more only means a less even order of shingles.
FREQUENT = 1 << 18
#: Occurrences within one partition from which a shingle is reported.
LOCAL_COUNT = 6
#: A pivot's members handled at once, by number and by bytes of their sets.
MEMBERS, PART_BYTES = 512, 8 << 20
#: Entries of a part of a list whose texts are compared.
LIST = 8192
#: Rows of a batch that Python hands to Spark.
ROWS = 200_000
#: Pairs whose sets are held at once.
PAIRS = 200


def _class_hash(s: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set, 0 for an empty one."""
    out = []
    for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
        m = mix(s ^ np.uint64(salt))
        c = np.concatenate((np.zeros(1, np.uint64), np.cumsum(m, dtype=np.uint64)))
        h = mix(c[at[1:]] - c[at[:-1]] + np.diff(at).astype(np.uint64))
        out.append(np.where(np.diff(at) > 0, h, np.uint64(0)).view(np.int64))
    return out[0], out[1]


def _sets(batch: pa.RecordBatch, width: int):
    """Yields (first row, set hashes, offsets, class hashes) over a batch's column of texts."""
    for lo, s, at in batch_sets(batch.column("text"), width):
        yield lo, s, at, _class_hash(s, at)


def classes(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n, h1, h2) for each row: size and 128-bit identity of its shingle set."""

    def one(batch):
        n, a, b = [], [], []
        for _, _, at, (h1, h2) in _sets(batch, width):
            n.append(np.diff(at))
            a.append(h1)
            b.append(h2)
        cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(cat(n), pa.int64()), pa.array(cat(a), pa.int64()), pa.array(cat(b), pa.int64())], ["doc_id", "n", "h1", "h2"])

    return map_arrow(docs.select("doc_id", "text"), one, "doc_id long, n long, h1 long, h2 long")


def frequent(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that some partition holds often, ascending, with a class of their frequency.

    Any order of shingles gives the same join; this one puts frequent shingles last so that index lists
    stay short. At most FREQUENT entries reach the driver.
    """

    def run(batches):
        held: list[np.ndarray] = []
        n, seen = 0, set()

        def many(parts):
            u, c = np.unique(np.concatenate(parts), return_counts=True)
            u, c = u[c >= LOCAL_COUNT], c[c >= LOCAL_COUNT]
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(c.astype(np.int64))], ["g", "c"])

        for b in batches:
            for _, s, at, (h1, _) in _sets(b, width):
                fresh = [k for k, h in enumerate(h1.tolist()) if not (h in seen or seen.add(h))]  # copies count once
                for k in fresh:
                    held.append(s[at[k] : at[k + 1]])
                    n += len(held[-1])
                if n > 1_000_000:
                    yield many(held)
                    held, n = [], 0
        if held:
            yield many(held)

    rows = stream_arrow(docs.select("text"), run, "g long, c long").groupBy("g").agg(F.sum("c").alias("c")).where("c >= 16").orderBy(F.desc("c"), "g").limit(FREQUENT).toArrow()
    g = rows.column("g").to_numpy().astype(np.int64).view(np.uint64)
    k = np.log2(np.maximum(rows.column("c").to_numpy().astype(np.float64), 1)).astype(np.uint64)
    order = np.argsort(g)
    return g[order], k[order]


def _in_order(s: np.ndarray, often: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """A sorted set in the join's order: rare shingles by hash, then frequent ones by class and hash."""
    g, k = often
    if not len(g) or not len(s):
        return s
    i = np.minimum(np.searchsorted(g, s), len(g) - 1)
    hit = g[i] == s
    if not hit.any():
        return s
    f = s[hit]
    return np.concatenate((s[~hit], f[np.lexsort((f, k[i[hit]]))]))


def meets(n):
    """Prefix shingles that a set of n elements asks a partner to share."""
    return 1 + n // 30


def prefix_length(n: int, percent: int) -> int:
    """Two linked sets share, in their prefixes of this length, as many shingles as the smaller one asks for."""
    return n - (percent * n + 99) // 100 + meets(n)


_POST = np.dtype([("g", "<u8"), ("h", "<i8"), ("n", "<i4"), ("i", "<i4")])


_ENTRY = "g long, h long, n int, i int"
_TYPES = {"g": pa.int64(), "h": pa.int64(), "n": pa.int32(), "i": pa.int32(), "pivot": pa.int64()}


def _batch(columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, _TYPES[k]) for k, v in columns.items()], list(columns))


def postings(docs: DataFrame, width: int, percent: int, often: Broadcast) -> DataFrame:
    """(g, h, n, i): each text's prefix, an entry for each shingle with its place; copies within a partition come once."""

    def run(batches):
        held, n, seen = [], 0, set()

        def dealt():
            g, size, h, count = zip(*held)
            count = np.array(count)
            place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            return _batch({"g": np.concatenate(g).view(np.int64), "h": np.repeat(np.array(h, np.int64), count), "n": np.repeat(np.array(size, np.int32), count), "i": place.astype(np.int32)})

        for batch in batches:
            for _, s, at, (h1, _) in _sets(batch, width):
                for k, h in enumerate(h1.tolist()):
                    size = int(at[k + 1] - at[k])
                    if not size or h in seen:
                        continue
                    seen.add(h)
                    t = _in_order(s[at[k] : at[k + 1]], often.value)[: prefix_length(size, percent)].copy()
                    held.append((t, size, h, len(t)))
                    n += len(t)
                    if n > ROWS:
                        yield dealt()
                        held, n = [], 0
        if held:
            yield dealt()

    return stream_arrow(docs.select("text"), run, _ENTRY)


def _shared(batches, once: bool):
    """Of rows (g, h, n, i) ordered by g, those whose g another row has, as columns; streams, however long a list is.

    once: rows are ordered by (g, h) and repeated ones come once.
    """
    last = None  # the last row, whose list may go on
    company = False  # whether a row before it has its g
    for b in batches:
        if not b.num_rows:
            continue
        p = {k: b.column(k).to_numpy(zero_copy_only=False) for k in ("g", "h", "n", "i")}
        if last is not None:
            p = {k: np.concatenate((last[k], v)) for k, v in p.items()}
        if once:
            new = np.concatenate(([True], (p["g"][1:] != p["g"][:-1]) | (p["h"][1:] != p["h"][:-1])))
            p = {k: v[new] for k, v in p.items()}
        same = p["g"][1:] == p["g"][:-1]
        keep = np.concatenate(([company], same[:-1])) | same if len(same) else np.zeros(0, bool)
        yield {k: v[:-1][keep] for k, v in p.items()}
        company = bool(same[-1]) if len(same) else company
        last = {k: v[-1:].copy() for k, v in p.items()}
    if last is not None and company:
        yield last


def _dealt(rows: DataFrame, parts: int, *order: str) -> DataFrame:
    """Rows dealt by g into parts, each part in order."""
    return rows.repartition(parts, "g").sortWithinPartitions(*order)


def index_lists(posts: DataFrame, parts: int) -> DataFrame:
    """(g, h, n, i): entries of lists with two texts or more."""

    def run(batches):
        for p in _shared(batches, True):
            yield _batch(p)

    return stream_arrow(_dealt(posts, parts, "g", "h"), run, _ENTRY)


def trimmed_lists(lists: DataFrame, percent: int, parts: int) -> DataFrame:
    """(g, h, n, i, pivot): lists without texts that meet too few others, and each list's least edited text.

    A linked set of n elements has at least meets(percent % of n) entries in lists of two or more.
    """
    least = F.lit(1) + F.floor(F.ceil(F.col("n") * percent / 100) / 30)
    enough = lists.groupBy("h").agg(F.count("*").alias("c"), F.first("n").alias("n")).where(F.col("c") >= least).select("h")

    def run(batches):
        last = (None, None)
        for p in _shared(batches, False):
            if not len(p["g"]):
                continue
            starts = np.flatnonzero(np.concatenate(([True], p["g"][1:] != p["g"][:-1])))
            best = p["h"][starts].copy()
            if p["g"][0] == last[0]:
                best[0] = last[1]
            p["pivot"] = np.repeat(best, np.diff(starts, append=len(p["g"])))
            last = (p["g"][-1], best[-1])
            yield _batch(p)

    kept = lists.join(enough, "h", "left_semi").select("g", "h", "n", "i")
    return stream_arrow(_dealt(kept, parts, "g", "i", "n", "h"), run, _ENTRY + ", pivot long")


def unpacked(rows: pa.Array, sizes: np.ndarray, width: int) -> list[np.ndarray]:
    """The sets of set_rows' column s. A row of 8 bytes an element is the set, any other its text."""
    sets: list = [None] * len(rows)
    coder, texts, held = zstandard.ZstdDecompressor(), [], 0

    def read():
        s, at, _ = shingle_sets(b"".join(t for _, t in texts), np.cumsum([0, *(len(t) for _, t in texts)]), width)
        for j, (k, _) in enumerate(texts):
            sets[k] = s[at[j] : at[j + 1]]

    for k, x in enumerate(rows):
        x = x.as_buffer()
        if x.size == 8 * sizes[k]:
            sets[k] = np.frombuffer(x, np.uint64)
            continue
        texts.append((k, coder.decompress(x)))
        held += len(texts[-1][1])
        if held > CHUNK:
            read()
            texts, held = [], 0
    if texts:
        read()
    return sets


def set_rows(docs: DataFrame, width: int, bits: Broadcast) -> DataFrame:
    """(h, n, s): the sets of texts that pass the filter: the compressed text, or the packed ascending hashes where
    those are no longer. Hashes don't compress, so a text takes about a third of its set."""

    def run(batches):
        seen, coder = set(), zstandard.ZstdCompressor()
        for batch in batches:
            h, n, s = [], [], []
            texts = batch.column("text")
            for lo, g, at, (h1, _) in _sets(batch, width):
                for k in np.flatnonzero(passes(h1, bits.value) & (np.diff(at) > 0)):
                    x = int(h1[k])
                    if x not in seen:
                        seen.add(x)
                        h.append(x)
                        n.append(int(at[k + 1] - at[k]))
                        text = coder.compress(texts[lo + int(k)].as_buffer())
                        s.append(text if len(text) < 8 * n[-1] else g[at[k] : at[k + 1]].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(n, pa.int32()), pa.array(s, pa.binary())], ["h", "n", "s"])

    return stream_arrow(docs.select("text"), run, "h long, n int, s binary")


def _enough(shared, n, m, percent):
    """Whether sets of n and m elements with so many shared ones link."""
    return 100 * shared >= percent * (n + m - shared)


class _Union:
    def __init__(self, n):
        self.up = list(range(n))

    def root(self, x):
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, x, y):
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)


def group_links(pivot: np.ndarray, sets: list[np.ndarray], block: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that span the components among a pivot's members, from their differences to the pivot.

    Members that link with the pivot are joined through it; the others are compared with all. block: where
    it holds both 0 and 1, only members of 1 ask, and only those of 0 answer.
    """
    m = len(sets)
    size = np.array([len(x) for x in sets], np.int64)
    words = (len(pivot) + 63) // 64
    hits, plus = [], []
    for x in sets:
        at = np.minimum(np.searchsorted(pivot, x), len(pivot) - 1)
        hit = pivot[at] == x
        hits.append(at[hit])
        plus.append(x[~hit])
    shared = size - np.array([len(x) for x in plus], np.int64)
    linked = _enough(shared, size, len(pivot), percent)
    find = _Union(m + 1)
    links = []
    for k in np.flatnonzero(linked):
        find.join(int(k), m)
        links.append((int(k), m))
    two = bool((block == 1).any() and (block == 0).any())
    loose = np.flatnonzero(~linked & (block == 1) if two else ~linked).tolist()
    if not loose:
        return links
    lost = np.zeros((m, words), np.uint64)
    for k, at in enumerate(hits):
        has = np.zeros(words * 64, np.uint8)
        has[: len(pivot)] = 1
        has[at] = 0
        lost[k] = np.packbits(has, bitorder="little").view(np.uint64)
    # which members share what the pivot lacks
    who = np.repeat(np.arange(m), [len(x) for x in plus])
    what = np.concatenate(plus)
    order = np.lexsort((who, what))
    who, what = who[order], what[order]
    starts = np.flatnonzero(np.concatenate(([True], what[1:] != what[:-1]))) if len(what) else np.zeros(0, np.int64)
    ends = np.append(starts[1:], len(what)) if len(what) else starts
    by_size = np.argsort(size, kind="stable")
    ordered = size[by_size]
    index: dict[int, list[int]] = {}
    for a, b in zip(starts, ends):
        if b - a > 1:
            for q in who[a:b]:
                index.setdefault(int(q), []).append(int(a))
    end_of = dict(zip(starts.tolist(), ends.tolist()))
    for k in loose:
        n = int(size[k])
        lo, hi = np.searchsorted(ordered, -(-percent * n // 100)), np.searchsorted(ordered, n * 100 // percent, side="right")
        near = by_size[lo:hi]  # blocks of sizes out of reach are skipped
        if two:
            near = near[block[near] == 0]
        near = near[near != k]
        if not len(near):
            continue
        gone = np.bitwise_count(lost[near] | lost[k]).sum(axis=1).astype(np.int64)
        kept = len(pivot) - gone
        most = kept + np.minimum(size[near] - shared[near], len(plus[k]))
        ok = _enough(most, n, size[near], percent)
        maybe, kept = near[ok], kept[ok]
        if not len(maybe):
            continue
        extra = np.zeros(m, np.int64)
        for a in index.get(k, ()):
            extra[who[a : end_of[a]]] += 1
        for j in maybe[_enough(kept + extra[maybe], n, size[maybe], percent)].tolist():
            if find.root(j) != find.root(k):
                find.join(j, k)
                links.append((k, j))
    return links


def _members(groups: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b, loose=false) within each group of (pivot, ask, blk, h, n, s, asks), and (member, pivot, true) of
    each asking member that doesn't link with its pivot."""

    def one(table):
        h = table.column("h").to_numpy()
        piv = table.column("pivot")[0].as_py()
        sets = unpacked(table.column("s"), table.column("n").to_numpy(), width)
        asks = table.column("asks").to_numpy()
        at = int(np.flatnonzero(h == piv)[0])
        rest = np.flatnonzero(h != piv)
        rest = rest[np.lexsort((asks[rest], h[rest]))]
        rest = rest[np.concatenate(([True], (h[rest][1:] != h[rest][:-1]) | (asks[rest][1:] != asks[rest][:-1])))[: len(rest)]]
        names = np.append(h[rest], piv)
        found = group_links(sets[at], [sets[k] for k in rest], asks[rest], percent)
        a, b = (np.array(x, np.int64) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
        a, b = names[a], names[b]
        tied = np.isin(names[:-1], a[b == piv])
        out = names[:-1][~tied & ((asks[rest] == 1) | (asks[rest] == 0).all())]
        return pa.table({"a": np.concatenate((a, out)), "b": np.concatenate((b, np.full(len(out), piv, np.int64))), "loose": np.repeat([False, True], [len(a), len(out)])})

    return groups.groupBy("pivot", "ask", "blk").applyInArrow(one, "a long, b long, loose boolean")


def within_groups(chosen: DataFrame, sets: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) among the members of each pivot.

    A group goes to its pivot in parts of MEMBERS texts or PART_BYTES, so its cost is linear; only members
    that don't link with their pivot are asked about the other parts.
    """
    groups = chosen.groupBy("pivot").agg(F.count("*").alias("m"), F.sum("n").alias("bytes"))
    groups = groups.select("pivot", F.greatest(F.ceil(F.col("m") / MEMBERS), F.ceil(F.col("bytes") * 8 / PART_BYTES)).cast("int").alias("parts"))
    groups = written(groups, "groups")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    part = lambda n: F.pmod(F.xxhash64("h", F.lit(n)), F.col(n)).cast("int")
    shape = ["pivot", "ask", "blk", "h", "asks"]
    own = groups.select("pivot", F.lit(0).alias("ask"), every("parts").alias("blk"), F.col("pivot").alias("h"), F.lit(0).alias("asks"))
    placed = chosen.join(groups, "pivot").select("pivot", F.lit(0).alias("ask"), part("parts").alias("blk"), "h", F.lit(0).alias("asks"))
    with_sets = lambda x: x.join(sets.select("h", "n", "s"), "h").select(*shape, "n", "s")
    found = written(_members(with_sets(placed.unionByName(own.select(*shape))), width, percent), "within")
    links = found.where("not loose").select("a", "b")
    split = groups.where("parts > 1")
    loose = written(found.where("loose").select(F.col("a").alias("h"), F.col("b").alias("pivot")).join(split, "pivot"), "loose")
    if loose.isEmpty():
        dropped(groups, loose)
        return links
    asked = loose.groupBy("pivot", "parts").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("asks"))
    owns = asked.select("pivot", every("asks").alias("ask"), "parts").select("pivot", "ask", every("parts").alias("blk"), F.col("pivot").alias("h"), F.lit(0).alias("asks"))
    asking = loose.join(asked.select("pivot", "asks"), "pivot").select("pivot", part("asks").alias("ask"), every("parts").alias("blk"), "h", F.lit(1).alias("asks"))
    answer = chosen.join(asked, "pivot").select("pivot", every("asks").alias("ask"), part("parts").alias("blk"), "h", F.lit(0).alias("asks"))
    more = _members(with_sets(answer.unionByName(asking).unionByName(owns)), width, percent).where("not loose and a <> b").select("a", "b")
    more = written(more, "more")
    dropped(groups, loose)
    return links.unionByName(more)


def _cross_pairs(known: DataFrame, percent: int, parts: int) -> DataFrame:
    """Candidate pairs (a, b): texts that share enough prefix shingles, chose different pivots and aren't yet in one component.

    Lists of one component end here. Others are cut into parts of LIST entries by text, and each pair of parts
    is a group of its own.
    """
    spread = known.groupBy("g").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("c")).where("lo < hi").select("g", "c")
    # few lists hold several components: their table is small, and only their entries go on
    mixed = known.join(written(spread, "spread"), "g")
    mixed = mixed.withColumn("parts", F.ceil(F.col("c") / LIST).cast("int")).withColumn("p", F.pmod(F.xxhash64("h"), "parts").cast("int"))
    q = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    mixed = mixed.select("g", "h", "n", "i", "pivot", "comp", "p", q.alias("q")).withColumn("x", F.least("p", "q")).withColumn("y", F.greatest("p", "q"))
    names = ("g", "x", "y", "h", "n", "i", "pivot", "comp", "p")

    def pairs_of(p):
        out = []
        cut = np.flatnonzero(np.concatenate(([True], (p["g"][1:] != p["g"][:-1]) | (p["x"][1:] != p["x"][:-1]) | (p["y"][1:] != p["y"][:-1]))))
        for lo, hi in zip(cut.tolist(), np.append(cut[1:], len(p["g"])).tolist()):
            c, n, i, h, v, own = (p[k][lo:hi] for k in ("comp", "n", "i", "h", "pivot", "p"))
            if (c == c[0]).all():
                continue
            apart = p["x"][lo] != p["y"][lo]
            reach = np.searchsorted(n, n * 100 // percent, side="right")
            for k in range(hi - lo - 1):
                j = slice(k + 1, int(reach[k]))  # later blocks are too large
                need = -(-percent * (n[k] + n[j]) // (100 + percent))
                # at most the shingles before both places, this one and those after both
                ok = (c[j] != c[k]) & (v[j] != v[k]) & (np.minimum(i[k], i[j]) + np.minimum(n[k] - i[k], n[j] - i[j]) >= need)
                if apart:
                    ok &= own[j] != own[k]
                if ok.any():
                    o = h[j][ok]
                    out.append(np.stack((np.minimum(o, h[k]), np.maximum(o, h[k]), np.minimum(n[j][ok], n[k])), 1))
                    if sum(map(len, out[-64:])) > ROWS:
                        yield out
                        out = []
        yield out

    def run(batches):
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            p = {k: b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in names}
            if held is not None:
                p = {k: np.concatenate((held[k], v)) for k, v in p.items()}
            key = (p["g"] != p["g"][-1]) | (p["x"] != p["x"][-1]) | (p["y"] != p["y"][-1])
            lo = int(np.flatnonzero(key)[-1]) + 1 if key.any() else 0
            held = {k: v[lo:].copy() for k, v in p.items()}
            if lo:
                yield from counted({k: v[:lo] for k, v in p.items()})
        if held is not None:
            yield from counted(held)

    def counted(p):
        for out in pairs_of(p):
            if out:
                pairs, times = np.unique(np.concatenate(out), axis=0, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(pairs[:, 2]), pa.array(times.astype(np.int64))], ["a", "b", "n", "c"])

    dealt = mixed.select(*names).repartition(parts, "g", "x", "y").sortWithinPartitions("g", "x", "y", "n", "i", "h")
    found = stream_arrow(dealt, run, "a long, b long, n long, c long")
    return found.groupBy("a", "b").agg(F.sum("c").alias("c"), F.first("n").alias("n")).where(F.col("c") >= 1 + F.floor(F.col("n") / 30)).select("a", "b")


def _verified(pairs: DataFrame, sets: DataFrame, width: int, percent: int) -> DataFrame:
    """Of pairs (a, b), those whose sets link."""
    x = pairs.join(sets.select(F.col("h").alias("a"), F.col("n").alias("na"), F.col("s").alias("sa")), "a").join(sets.select(F.col("h").alias("b"), F.col("n").alias("nb"), F.col("s").alias("sb")), "b")

    def one(batch):
        keep = []
        for x, y in zip(*(unpacked(batch.column(s), batch.column(n).to_numpy(), width) for s, n in (("sa", "na"), ("sb", "nb")))):
            at = np.minimum(np.searchsorted(x, y), len(x) - 1)
            keep.append(bool(_enough(int((x[at] == y).sum()), len(x), len(y), percent)))
        return pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return map_arrow(x.select("a", "b", "na", "sa", "nb", "sb"), one, "a long, b long", rows=PAIRS)


def links(docs: DataFrame, keys: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) between text classes that span every component of the join's graph."""
    spark = docs.sparkSession
    total = keys.agg(F.sum("n")).head()[0] or 0
    # a part's entries take about 32 MB
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(total * (100 - percent) / 100 * 32 / 32e6) + 1)
    often = spark.sparkContext.broadcast(frequent(docs, width))
    entries = written(index_lists(postings(docs, width, percent, often), parts), "entries")
    release_shuffles(spark)
    lists = written(trimmed_lists(entries, percent, parts), "lists")
    dropped(entries)
    release_shuffles(spark)
    votes = lists.where("h <> pivot").groupBy("h", "pivot").agg(F.count("*").alias("count"), F.first("n").alias("n"))
    chosen = votes.groupBy("h").agg(F.max(F.struct("count", F.negative("pivot").alias("neg"))).alias("x"), F.first("n").alias("n")).select("h", F.negative("x.neg").alias("pivot"), "n")
    chosen = written(chosen, "chosen")
    nodes = written(lists.select("h").distinct(), "nodes")
    count = nodes.count()
    if not count:
        return spark.createDataFrame([], "a long, b long")
    bits = spark.sparkContext.broadcast(wanted_filter(nodes, count))
    sets = written(set_rows(docs, width, bits).dropDuplicates(["h"]), "sets")
    release_shuffles(spark)
    within = within_groups(chosen, sets, width, percent)
    comp = connected_components(within).select(F.col("node").alias("h"), F.col("root").alias("comp"))
    label = chosen.join(comp, "h", "full").select("h", F.coalesce("pivot", "h").alias("pivot"), F.coalesce("comp", "h").alias("comp"))
    label = written(label, "label")
    known = lists.select("g", "h", "n", "i").join(label, "h", "left").select("g", "h", "n", "i", F.coalesce("pivot", "h").alias("pivot"), F.coalesce("comp", "h").alias("comp"))
    known = written(known, "known")
    dropped(lists, chosen, nodes, label)
    release_shuffles(spark)
    across = written(_cross_pairs(known, percent, parts), "across")
    dropped(known)
    return within.unionByName(_verified(across, sets, width, percent))


def jaccard_components(docs: DataFrame, width: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, class_hi, class_lo) for every row of docs.

    Rows link when 100 * shared >= percent * joint over their distinct word shingles; component_id is the
    smallest id reachable. A null or empty text has no shingles, links with nothing and is its own
    component; equal texts are one class; repeated rows come out as often as they went in; a row with a
    null id counts for its class but cannot name a component. Other columns are ignored.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    keys = written(classes(docs, width), "classes")
    solid = keys.where("n > 0")
    low = solid.groupBy("h1", "h2").agg(F.min("doc_id").alias("low"))
    edges = links(docs, keys, width, percent)
    comp = connected_components(edges).select(F.col("node").alias("h1"), "root")
    grouped = low.join(comp, "h1", "left").withColumn("root", F.coalesce("root", "h1"))
    best = grouped.groupBy("root").agg(F.min("low").alias("component_id"))
    # only what a text alone does not tell: classes whose component starts elsewhere, or with copies
    told = grouped.join(best, "root").select("h1", "h2", "component_id")
    return keys.join(told, ["h1", "h2"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.col("h1").alias("class_hi"), F.col("h2").alias("class_lo"))
