"""Merkle manifest, benchmark decontamination and collocations against brute force."""

import re
from collections import Counter
from hashlib import sha256
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from lodestar.llm import collocations, decontaminate, merkle

SF = "/root/testdata/sf0.001"
LOWERED = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def lowered(text):
    return (text or "").encode().translate(LOWERED).decode()


# manifest


def digest(text):
    return sha256(text.encode()).hexdigest()


def leaf(row, text):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)))


def climbed(nodes):
    paths, own = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for x, k in enumerate(own):
            lo = k - k % 16
            paths[x].append(("".join(nodes[lo:k]), "".join(nodes[k + 1 : lo + 16])))
            own[x] = k // 16
        nodes = [digest("".join(nodes[k : k + 16])) for k in range(0, len(nodes), 16)]
    return nodes[0], paths


def manifest(rows):
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    order = sorted(by, key=lambda g: (g is not None, (g or "").encode()))
    trees = []
    for g in order:
        by[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
        trees.append(climbed([leaf(r, r[4]) for r in by[g]]))
    root, tops = climbed([t[0] for t in trees])
    out = []
    for g, (subroot, paths), top in zip(order, trees, tops):
        for r, path in zip(by[g], paths):
            own = node = leaf(r, r[4])
            if r[0] is not None and crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                node = leaf(r, lowered(r[4]))
            for a, b in path + top:
                node = digest(a + node + b)
            out.append((r[0], own, subroot, root, digest("".join(a + b for a, b in path + top)), node, node == root))
    return sorted(out, key=repr)


def told(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


@pytest.mark.parametrize("block, top", [(4096, 1 << 16), (16, 20), (16, 3), (256, 4)])
def test_manifest_against_brute_force(spark, block, top):
    """One tier of blocks, several, and tiers over the sources themselves."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = manifest([tuple(r) for r in docs.select(*FIELDS).collect()])
    assert told(merkle.merkle_manifest(docs, merkle.tampered_text(), block=block, top=top)) == want


def test_manifest_of_odd_rows(spark):
    rows = [(None,) * 5] * 20 + [(k % 7, "a", None, 3, "Abc é") for k in range(300)] + [(5, "b", "en", 1, ""), (5, "ä", "en", 1, "X" * 100000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").withColumn("leaf", F.lit(1)).withColumn("g", F.lit(2))
    want = manifest(rows)
    assert told(merkle.merkle_manifest(docs, merkle.tampered_text())) == want
    assert told(merkle.merkle_manifest(docs, merkle.tampered_text(), block=16, top=2)) == want
    assert merkle.merkle_manifest(docs.limit(0)).collect() == []
    assert merkle.merkle_manifest(docs).where("NOT verified").isEmpty()


def test_upper_tree_folds_to_its_root():
    nodes = [(g, i, digest(f"{g} {i}")) for g in range(37) for i in range(1 + g * 7 % 50)]
    tree = merkle.UpperTree(nodes, True)
    assert len({merkle._fold(d, tree.path(g, i)) for g, i, d in nodes}) == 1


# decontamination


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))


def scanned(docs, items, width=10):
    grams = {}
    for item, text in items:
        w = words(text)
        m = min(len(w), width)
        for i in range(len(w) - m + 1 if w else 0):
            grams.setdefault(tuple(w[i : i + m]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for m in {len(g) for g in grams}:
            for i in range(len(w) - m + 1):
                if (g := tuple(w[i : i + m])) in grams:
                    hit.update(range(i, i + m))
                    found |= grams[g] - {None}
        ids = ",".join(sorted(map(str, found)))
        out.append((doc, len(w), len(hit), len(found), digest(ids), bool(hit)))
    return sorted(out, key=repr)


ITEMS = [(1, "one two three four five six seven eight nine ten eleven"), (2, "Short ITEM"), (3, "two, three: four five six seven eight nine ten eleven twelve"), (4, None), (5, "..."), (10, "short item"), (None, "nameless words here"), (2, "Short ITEM")]
DOCS = [
    (1, "Zero one two three four five six seven eight nine ten eleven twelve thirteen"), (2, "a SHORT-item, a short item; nameless words here"), (3, None), (4, ""), (4, ""), (None, "short  item"), (6, "shorts item short"),
    (7, "one two three four five six seven eight nine"), (8, " ".join(["filler"] * 50000 + ["short", "item"])), (9, "éone two three four five six seven eight nine ten eleven"),
]


@pytest.mark.parametrize("most", [decontaminate.SET_BYTES, 150])
def test_scan_of_odd_texts(spark, most):
    """One broadcast set, and several where the benchmark is beyond the bound."""
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").withColumn("k", F.lit("x")).withColumn("n_hit", F.lit(1))
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("h", F.lit(3))
    assert told(decontaminate.scan_documents(docs, items, most=most)) == scanned(DOCS, ITEMS)
    assert told(decontaminate.scan_documents(docs, items.limit(0))) == scanned(DOCS, [])
    assert decontaminate.scan_documents(docs.limit(0), items).collect() == []


def test_scan_of_the_corpus(spark):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    want = scanned([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in items.collect()])
    got = decontaminate.scan_documents(docs, items)
    assert told(got) == want and any(r[-1] for r in want)
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()


def test_spans_and_documents_go(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").withColumn("extra", F.lit(1))
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    cut = {r.doc_id: r.text for r in decontaminate.decontaminated(docs, items).collect()}
    assert cut[1] == "Zero thirteen" and cut[2] == "a, a" and cut[None] == "" and cut[7] == DOCS[7][1] and cut[3] is None
    assert cut[9] == DOCS[9][1].removesuffix(" two three four five six seven eight nine ten eleven")
    again = decontaminate.scan_documents(decontaminate.decontaminated(docs, items), items)
    assert again.where("contaminated").isEmpty()
    kept = decontaminate.decontaminated(docs, items, remove="documents")
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["3", "4", "4", "6", "7"] and kept.columns == docs.columns
    loose = decontaminate.decontaminated(docs, items, remove="documents", share=0.01)
    assert loose.where("doc_id = 8").count() == 1
    with pytest.raises(ValueError):
        decontaminate.decontaminated(docs, items, remove="words")


# collocations


def ranked(docs, least=30, kept=2000):
    f, n = Counter(), Counter()
    for lang, text in docs:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\n-\r]", lowered(text)):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for m in range(1, 5):
                for i in range(len(w) - m + 1):
                    f[lang, tuple(w[i : i + m])] += 1
    found = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    gone = {(g, p[i : i + m]) for (g, p), a in found.items() for m in range(2, len(p)) for i in range(len(p) - m + 1) if 100 * a >= 80 * f[g, p[i : i + m]]}
    by = {}
    for (g, p), a in found.items():
        if (g, p) not in gone:
            score, k = min((2000000 * a // (f[g, p[:k]] + f[g, p[k:]]), k) for k in range(1, len(p)))
            by.setdefault(g, []).append((-score, -a, " ".join(p).encode(), f[g, p[:k]], f[g, p[k:]]))
    return sorted(((g, i + 1, x[2].decode(), -x[1], x[3], x[4], n[g], -x[0]) for g, v in by.items() for i, x in enumerate(sorted(v)[:kept])), key=repr)


PHRASES = [
    ("en", "New York, new york! the the the the the. a\tb\x0bc d e\r\nf"), (None, "x y z w v"), ("und", "x y z w v"), ("en", None), ("en", ""), ("fr", "Été à Été à; été à\x01 b"), ("fr", "a\x01 b a b"), ("en", "in New York the city of new york"), ("en", "q" * 100000 + " r"),
]


@pytest.mark.parametrize("limits", [{}, {"head": 3, "range_keys": 7}, {"kept": 3}, {"kept": 1, "head": 0}])
def test_phrases_of_odd_texts(spark, limits):
    """Ties, pieces, null languages, words beyond the broadcast dictionary, many ranges of few keys."""
    rows = PHRASES * 3
    docs = spark.createDataFrame(rows, "lang string, text string").withColumn("f", F.lit(1)).withColumn("word", F.lit("w"))
    assert told(collocations.collocations(docs, least=3, **limits)) == ranked(rows, 3, limits.get("kept", 2000))
    assert collocations.collocations(docs.limit(0), **limits).collect() == []


def test_phrases_of_the_corpus(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.lang, r.text) for r in docs.collect()]
    assert told(collocations.collocations(docs, least=5, head=100, range_keys=3000)) == ranked(rows, 5)


def test_scores_pass_64_bits(spark):
    a, both = 30 * 10**12, 61 * 10**12
    got = spark.range(1).select(collocations._score(F.lit(a).cast("long"), F.lit(both).cast("long"))).head()[0]
    assert got == 2000000 * a // both
