"""The n-gram Jaccard join against all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.llm import jaccard, registry
from lodestar.llm.components import connected_components

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def shingles(text, width):
    import re

    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(LOWER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)])


def brute(rows, width, percent):
    sets = [shingles(t, width) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            i = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * i >= percent * (len(sets[a]) + len(sets[b]) - i):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    low = {}
    for k, (d, _) in enumerate(rows):
        if d is not None:
            low[root(k)] = min(low.get(root(k), d), d)
    return [(d, len(sets[k]), low.get(root(k))) for k, (d, _) in enumerate(rows)]


def made(seed=3):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    rows, n = [], 0
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([5, 12, 40, 90, 200]))]
        for _ in range(rng.choice([1, 3, 12])):
            t = list(base)
            for _ in range(rng.randint(0, max(1, len(t) // 25))):
                t[rng.randrange(len(t))] = rng.choice(words)
            rows.append((n * 3 % 1000, " ".join(t)))
            n += 1
    rows += [(900, None), (901, ""), (902, " \t\n"), (903, "One two"), (904, "one  TWO"), (905, "one"), (906, "ONE"), (907, "ünï çödé ß"), (908, "ünï çödé ß")]
    rows += [(3, rows[1][1]), (3, rows[1][1]), (None, rows[2][1]), (910, "x " * 3000), (911, "x " * 3100), (912, "a" * 100_000)]
    return rows


@pytest.mark.parametrize("width,percent", [(4, 85), (5, 80)])
def test_components_match_all_pairs(spark, width, percent):
    rows = made()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("h1", F.lit("clash")).withColumn("n", F.lit(None).cast("int")).repartition(5)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs, width, percent).collect()), key=str)
    assert got == sorted(brute(rows, width, percent), key=str)


def test_groups_and_lists_in_parts(spark, monkeypatch):
    """A hot group of near copies, loose members among them, and lists cut into parts."""
    rng = random.Random(5)
    words = [f"w{k}" for k in range(300)]
    base = [rng.choice(words) for _ in range(60)]
    rows = []
    for k in range(90):
        t = list(base)
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            t[rng.randrange(60)] = rng.choice(words)
        rows.append((k, " ".join(t)))
    monkeypatch.setattr(jaccard, "MEMBERS", 7)
    monkeypatch.setattr(jaccard, "LIST", 5)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs).collect())
    assert got == sorted(brute(rows, 4, 85)) and len({c for *_, c in got}) > 3


@pytest.mark.parametrize("once", [True, False])
def test_lists_stream_in_any_batches(once):
    """Rows in company by brute force, whatever the batches' edges."""
    import pyarrow as pa

    rng = random.Random(11)
    for _ in range(200):
        rows = sorted((rng.randint(0, 6), rng.randint(0, 4), 9, k % 3) for k in range(rng.randint(0, 25)))
        left = [r for k, r in enumerate(rows) if not once or k == 0 or r[:2] != rows[k - 1][:2]]
        want = [r for r in left if sum(x[0] == r[0] for x in left) > 1]
        batches, at = [], 0
        while at < len(rows):
            n = rng.randint(0, 5)
            part = rows[at : at + n]
            at += n
            cols = list(zip(*part)) if part else [[], [], [], []]
            batches.append(pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32())], ["g", "h", "n", "i"]))
        got = [r for p in jaccard._shared(iter(batches), once) for r in zip(*(p[k].tolist() for k in ("g", "h", "n", "i")))]
        assert got == want


def test_empty_table(spark):
    assert jaccard.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_group_links_find_what_all_pairs_find():
    rng = np.random.default_rng(1)
    pivot = np.sort(rng.choice(10**6, 150, replace=False).astype(np.uint64))
    sets = []
    for k in range(60):
        keep = rng.random(150) > rng.choice([0.02, 0.1, 0.2])
        extra = rng.choice([7_000_000 + x for x in range(60)], rng.integers(0, 25), replace=False).astype(np.uint64)
        sets.append(np.sort(np.concatenate((pivot[keep], extra))))
    links = jaccard.group_links(pivot, sets, np.zeros(60, int), 85)
    every = [*map(lambda s: set(s.tolist()), sets), set(pivot.tolist())]

    def parts(pairs):
        up = list(range(61))

        def root(x):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in pairs:
            up[root(a)] = root(b)
        return {frozenset(y for y in range(61) if root(y) == root(x)) for x in range(61)}

    want = [(a, b) for a in range(61) for b in range(a) if 100 * len(every[a] & every[b]) >= 85 * len(every[a] | every[b])]
    assert parts(links) == parts(want)


def test_components_of_chains_and_stars(spark):
    e = [(k, k + 1) for k in range(1, 40)] + [(100, k) for k in range(101, 140)] + [(7, 7), (500, 500), (None, 3)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(e, "a long, b long")).collect()}
    assert all(got[k] == 1 for k in range(1, 41)) and all(got[k] == 100 for k in range(100, 140)) and got[500] == 500


def test_query(spark, sf):
    r = registry.QUERIES["op10_ngram_jaccard"](spark, sf).toPandas()
    rows = [(x.doc_id, x.text) for x in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, r[["doc_id", "n_shingles", "component_id"]].to_numpy().tolist())) == sorted(brute(rows, 4, 85))


def test_words_built_to_collide_in_polynomials_are_told_apart(spark):
    """A Thue-Morse word of 1,024 letters and its complement have equal polynomials modulo 2^64, whatever the base."""
    word = "".join("ab"[bin(k).count("1") % 2] for k in range(1024))
    docs = spark.createDataFrame([(1, word), (2, word.translate(str.maketrans("ab", "ba"))), (3, word.upper()), (4, "a"), (5, "a\x00")], "doc_id long, text string")
    from lodestar.llm.jaccard import jaccard_components

    assert {r.doc_id: r.component_id for r in jaccard_components(docs).collect()} == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5}


def test_sets_travel_as_texts_where_those_are_shorter(spark):
    rng = random.Random(11)
    prose = [" ".join(rng.choice(("the", "Law", "of", "çödé", "rates", "and")) + str(rng.randrange(90)) for _ in range(n)) for n in (5, 400, 3000)]
    texts = [*prose, None, "", "one two", "y" * 50_000, "z " * 9000, "v w " * 400_000 + "end", " ".join(str(rng.random()) for _ in range(300))]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    every = spark.sparkContext.broadcast(np.full(1 << 17, 255, np.uint8))
    rows = jaccard.set_rows(docs, 4, every).toArrow().combine_chunks()
    n, s = rows.column("n").to_numpy(), rows.column("s").combine_chunks()
    kept = [t for t in texts if t]  # no two have equal sets
    want = [x for t in kept for x in [jaccard.shingle_sets(t.encode(), np.array([0, len(t.encode())]), 4)[0]]]
    assert n.tolist() == [len(shingles(t, 4)) for t in kept] == [len(x) for x in want]
    got = jaccard.unpacked(s, n, 4)
    assert all(np.array_equal(a, b) for a, b in zip(got, want))
    held = [len(x.as_py()) for x in s]
    assert all(b <= 8 * k for b, k in zip(held, n)) and held[0] == 8 * n[0]
    assert held[2] < 0.5 * 8 * n[2]
