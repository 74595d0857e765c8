"""BPE, WAV, language ID and license scans against libraries and brute force."""

import hashlib
import io
import random
import wave
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.llm import bpe, langid, licenses, registry, wavprint

ODD = [None, "", " ", "İstanbul ΣΑΣ", "don't I'LL it's'", "x\x1cy\x1f z", "a<|endoftext|>b <|startoftext|>", "日本語 １２３ ½", "é ﬁ", "🙂👩‍👩‍👧", "z" * 5000, "\x00\x01a", "''s 'S"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.public_path("word_bpe_49k.json"))


def odd(spark):
    return spark.createDataFrame([(k, t) for k, t in enumerate(ODD)] + [(None, "ab"), (1, "")], "doc_id long, text string").withColumn("ids", F.lit("clash"))


def test_bpe_is_the_library(spark, library, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(odd(spark).drop("ids"))
    got = {(r.doc_id, r.n_tokens, tuple(r.ids), r.decoded) for r in bpe.bpe_encode(docs).collect()}
    for r in docs.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert (r.doc_id, len(ids), tuple(ids), library.decode(ids, skip_special_tokens=False)) in got


def test_bpe_on_random_words(library):
    b = bpe.vocabulary(bpe.public_path("word_bpe_49k.json"))
    rng, vocab = random.Random(5), sorted(library.get_vocab())
    for k in range(3000):
        w = "".join(rng.choice("abcdehilnorstu") for _ in range(rng.randint(1, 14))) if k % 2 else "".join(rng.choice(vocab).replace("</w>", "") for _ in range(3))
        if "<|" not in w:
            assert b.encode(w) == library.encode(w, add_special_tokens=False).ids
    assert b.decode(b.encode("hello world")) == library.decode(library.encode("hello world", add_special_tokens=False).ids, skip_special_tokens=False)


def test_words_at_once_match_words_alone(library, monkeypatch):
    """Short words go through arrays; caches that turn over and pair slots that clash change nothing."""
    monkeypatch.setattr(bpe, "CACHE", 40)
    monkeypatch.setattr(bpe, "SLOTS", 16)
    monkeypatch.setattr(bpe, "LETTERS", 500)
    b, rng = bpe.WordBpe(bpe.public_path("word_bpe_49k.json")), random.Random(8)
    short = ["".join(rng.choice(["e", "t", "ing", "tion", "é", "ß", "un", "x", "日", "9", "'s", "."]) for _ in range(rng.randint(1, 9))) for _ in range(800)]
    assert [np.frombuffer(x, np.int32).tolist() for x in b.words(short)] == [b.word(x) for x in short] and b.words([]) == []
    alone = bpe.WordBpe.word
    monkeypatch.setattr(bpe.WordBpe, "word", lambda self, piece: alone(self, piece) if len(piece) > 16 else pytest.fail(piece))
    texts = [x or "" for x in ODD] + ["", *(rng.choice([" ", "\n", "\u2003", "  ", "\x85"]).join(rng.choices(short, k=30)) for _ in range(40)), "é" * 17, "."]
    for _ in range(2):
        for text, (ids, decoded) in zip(texts, b.encoded(texts), strict=True):
            want = library.encode(text, add_special_tokens=False).ids
            assert ids.tolist() == want and decoded == library.decode(want, skip_special_tokens=False) and b.digits(ids) == " ".join(map(str, want))
    assert len(b.memory.old) < 40 + len(short) and len(b.memory.new) < 40


def test_vocabularies_do_not_mix(tmp_path):
    """Two vocabularies in one worker: the second's ids don't hang on the first's pairs."""
    import json

    from tokenizers import Tokenizer

    path = bpe.public_path("word_bpe_49k.json")
    spec = json.load(open(path, encoding="utf-8"))
    merges = spec["model"]["merges"]
    spec["model"]["merges"] = merges[:2000]
    other = tmp_path / "other.json"
    other.write_text(json.dumps(spec), encoding="utf-8")
    text = "some ordinary words with several different endings and beginnings for the merges"
    bpe.vocabulary(path).encode(text)
    assert bpe.vocabulary(str(other)).encode(text) == bpe.WordBpe(str(other)).encode(text)
    assert bpe.WordBpe(str(other))._pairs is not bpe.vocabulary(path)._pairs
    assert bpe.vocabulary(str(other)).encode(text) == Tokenizer.from_file(str(other)).encode(text, add_special_tokens=False).ids
    spec["model"]["merges"] = merges[300:2000][::-1] + merges[:300]
    other.write_text(json.dumps(spec), encoding="utf-8")
    with pytest.raises(ValueError, match="order"):
        bpe.WordBpe(str(other))


def test_bpe_query(spark, library, sf):
    for r in registry.QUERIES["op4_bpe_prefix_dp"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), "doc_id").limit(50).collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_media_round_trip(spark):
    got = wavprint.text_media(odd(spark)).collect()
    assert len(got) == len(ODD) + 2
    texts = {**dict(enumerate(ODD)), None: "ab"}
    for r in got:
        raw = (texts[r.doc_id] or "").encode()
        with wave.open(io.BytesIO(bytes(r.media))) as w:
            assert (w.getnchannels(), w.getsampwidth()) == (1, 1)
            back = w.readframes(w.getnframes())
        assert back == raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]))
        assert r.media_bytes == len(r.media) and r.media_sha256 == hashlib.sha256(bytes(r.media)).hexdigest()


def test_peaks_and_pairs_by_definition():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 256, 256 * 40 + 13, dtype=np.uint8).tobytes()
    bins, keep = wavprint.spectral_peaks(x)
    s = np.frombuffer(x, np.uint8).astype(np.float32) - 128
    assert len(bins) == -(-len(x) // 128) and (wavprint._HANN > 0).all()
    for f in range(len(bins)):
        frame = s[f * 128 : f * 128 + 256]
        p = np.abs(np.fft.rfft(np.pad(frame, (0, 256 - len(frame))) * wavprint._HANN)) ** 2
        for b, (lo, hi) in enumerate(zip(wavprint.BANDS, wavprint.BANDS[1:])):
            assert np.isclose(p[bins[f, b]], p[lo:hi].max(), rtol=1e-3)
    t, c = wavprint.fingerprints(x)
    want = sorted((f, int(bins[f, p]) << 16 | int(bins[f + g, q]) << 8 | g) for g in range(1, 4) for f in range(len(bins) - g) for p in range(5) for q in range(5) if keep[f, p] and keep[f + g, q])
    assert list(zip(t.tolist(), c.tolist())) == want
    assert wavprint.fingerprints(bytes(64))[0].size == 0


def test_slabs_change_nothing(monkeypatch):
    x = np.random.default_rng(3).integers(0, 256, 256 * 50, dtype=np.uint8).tobytes()
    whole, prints = wavprint.spectral_peaks(x), wavprint.fingerprints(x)
    monkeypatch.setattr(wavprint, "SLAB", 7)
    assert all((a == b).all() for a, b in zip(whole, wavprint.spectral_peaks(x)))
    assert all((a == b).all() for a, b in zip(prints, wavprint.fingerprints(x)))


def test_bytes_at_frame_edges_reach_the_feature():
    x = bytearray(np.random.default_rng(4).integers(90, 120, 256 * 40, dtype=np.uint8).tobytes())
    before = wavprint.fingerprints(bytes(x))[1].tobytes()
    x[::256] = bytes([255]) * 40  # only where frames of 256 begin
    assert wavprint.fingerprints(bytes(x))[1].tobytes() != before


def test_media_query_returns_its_arrays(spark, sf):
    r = registry.QUERIES["op3_wav_fingerprints"](spark, sf).orderBy(F.desc("n_bytes")).head()
    assert len(r.times) == len(r.codes) > 0
    assert hashlib.sha256(np.array(r.times, "<i4").tobytes() + np.array(r.codes, "<i4").tobytes()).hexdigest() == r.feature


def test_language_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    r = registry.QUERIES["op5_language_id"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out and lang is not null")
    assert r.where("lang = lang_pred").count() / r.count() >= 0.97
    assert r.where("rejected").count() / r.count() < 0.02


def test_language_edges(spark):
    train = spark.createDataFrame([(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (3, None, "de"), (4, "x", None), (5, "12", "xx")], "doc_id long, text string, lang string")
    raw = langid.dictionaries(train)
    assert set(raw) == {"en", "de"}
    got = {r.doc_id: r for r in langid.identify(odd(spark).withColumnRenamed("ids", "score"), raw, keep=True).collect()}
    assert got[0].lang_pred == got[1].lang_pred == "und" and got[0].rejected and got[0].score == 0.0
    assert langid.identify(odd(spark), {}).where("lang_pred <> 'und'").count() == 0
    assert langid.identify(odd(spark).limit(0), raw).count() == 0
    assert langid.Classifier(raw).predict("the dog and the cat")[0] == "en"


def test_dictionaries_read_whole_texts(spark, monkeypatch):
    rows = [(1, "the cat " * 300 + "zebra", "en"), (2, "the dog " * 300 + "zebra", "en"), (3, "der hund " * 300 + "nashorn", "de"), (4, "der hund", "de")]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    raw = langid.dictionaries(train)
    assert set(raw["en"].split()) == {b"the", b"cat", b"dog", b"zebra"} and set(raw["de"].split()) == {b"der", b"hund", b"nashorn"}
    texts = [" ".join(f"w{a}{b}" for a in "abcdefgh" for b in "ijklmnop"[: k + 1]).replace("w", "wort") for k in range(8)]
    many = spark.createDataFrame([(k, t, "de") for k, t in enumerate(texts)], train.schema)
    counts = {}
    for t in texts:
        for x in set(langid.plain(t).split()):
            counts[x] = counts.get(x, 0) + 1
    want = " ".join(sorted(counts, key=lambda x: (counts[x], hashlib.md5(x.encode()).digest()))).encode()
    assert langid.dictionaries(many)["de"] == want
    monkeypatch.setattr(langid, "DICT_BYTES", 100)
    assert langid.dictionaries(many)["de"] == want[-100:].split(b" ", 1)[1]  # a word is never cut


def test_copies_do_not_hide_a_language(spark):
    """Rows far beyond the sample, nearly all of them copies: every language is learned from its different texts."""
    german = [f"der hund und die katze nummer {w} gehen nach hause" for w in "eins zwei drei vier acht neun zehn elf".split()]
    train = spark.range(400_000).select(F.element_at(F.array(*map(F.lit, german)), (F.col("id") % 8 + 1).cast("int")).alias("text"), F.lit("de").alias("lang"))
    train = train.unionByName(spark.range(500).select(F.concat(F.lit("the dog and the cat walk home "), F.col("id")).alias("text"), F.lit("en").alias("lang")))
    raw = langid.dictionaries(train)
    assert set(raw) == {"de", "en"} and b"katze" in raw["de"].split()
    assert langid.Classifier(raw).predict("der hund und die katze")[0] == "de"


def test_marks_are_no_letters_and_lone_languages_can_reject(spark):
    c = langid.Classifier({"de": b"der hund und die katze"})
    assert c.predict("\u0301\u0302 12")[0] == "und"
    assert c.predict("der hund und die katze")[1] > langid.MARGIN > c.predict("zxqv jkwp")[1]


def test_identify_is_the_classifier(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    c = langid.Classifier(raw := langid.dictionaries(docs))
    want = {r.doc_id: c.predict(r.text) for r in docs.collect()}
    got = langid.identify(docs, raw).collect()
    assert len(got) == docs.count()
    for r in got:
        assert (r.lang_pred, r.score) == want[r.doc_id] and r.rejected == (r.lang_pred == "und" or r.score < langid.MARGIN)


def brute_scan(text):
    import re

    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    base = [(k, l) for p, l in licenses.PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
    return len(w), sorted(base)


def test_license_places(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(odd(spark).drop("ids"))
    extra = spark.createDataFrame([(-1, "MIT license mit License; Apache  LICENSE general\npublic license"), (-2, "mit"), (-3, "xmit license")], "doc_id long, text string")
    rows = docs.unionByName(extra)
    got = {(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in licenses.scan_licenses(rows).collect()}
    for r in rows.collect():
        n, base = brute_scan(r.text)
        at = [k for k, _ in base]
        assert (r.doc_id, n, len(at), min(at, default=None), max(at, default=None), ",".join(sorted({l for _, l in base}))) in got


@pytest.mark.parametrize("text,label,hit", [("This work is licensed under the GNU General Public License, version 3.", "gpl-3.0-reference", True), ("licensed under the General Public License version 2", "gpl-3.0-reference", False), ("Licensed under the Apache License, Version 2.0.", "apache-2.0-reference", True), ("Licensed under an Apache License, Version 2.0.", "apache-2.0-reference", False), ("Released under the MIT License.", "mit-reference", True), ("Copyright 2020 Some Body and others. All rights reserved", "all-rights-reserved", True), ("Copyright a b c d e f g h i. All rights reserved", "all-rights-reserved", False), ("Licensed under CC BY-NC 4.0.", "cc-by-nc-reference", True)])
def test_templates(text, label, hit):
    r = licenses.Scanner().scan("before " + text + " after")
    assert (label in {l for *_, l in r["spans"]}) is hit


DISCLAIMERS = {
    "mit-text": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "bsd": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
}
MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
BSD2 = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
BSD3 = BSD2 + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "


@pytest.mark.parametrize("text,want", [(MIT, set()), (MIT + DISCLAIMERS["mit-text"], {"mit-text"}), (MIT + DISCLAIMERS["mit-text"].replace("NO EVENT", "ANY EVENT"), set()), (BSD2, set()), (BSD2 + DISCLAIMERS["bsd"], {"bsd-2-clause-text"}), (BSD3 + DISCLAIMERS["bsd"], {"bsd-3-clause-text"}), (BSD3, set())])
def test_full_texts_need_their_last_word(text, want):
    assert {l for *_, l in licenses.Scanner().scan("Copyright 2020 A B\n" + text)["spans"]} == want


def test_template_markup():
    a = licenses.Automaton("alpha <<optional>>beta <<any:2>> gamma<<end>> delta")
    w = str.split
    assert a.match(w("alpha delta"), 0) == 2
    assert a.match(w("alpha beta gamma delta"), 0) == 4
    assert a.match(w("alpha beta x y gamma delta"), 0) == 6
    assert a.match(w("alpha beta x y z gamma delta"), 0) == -1
    assert a.match(w("alpha beta delta"), 0) == -1


def as_regex(template):
    """A template as a pattern over words that each end in a space: an independent reading of the markup."""
    import re

    out, at = "", 0
    for m in re.finditer(r"<<(optional|either|or|end|any:\d+)>>", template):
        out += "".join(re.escape(w) + " " for w in licenses.words(template[at : m.start()]))
        at = m.end()
        kind = m[1]
        out += {"optional": "(?:(?:", "either": "(?:(?!)|(?:", "or": ")|(?:"}.get(kind, "")
        if kind.startswith("any"):
            out += rf"(?:\S+ ){{0,{kind[4:]}}}"
        if kind == "end":
            out += "END"
    out += "".join(re.escape(w) + " " for w in licenses.words(template[at:]))
    # an optional's end may be empty, an either's not
    parts, opened = re.split(r"(\(\?:\(\?:|\(\?:\(\?!\)\|\(\?:|END)", out), []
    for k, x in enumerate(parts):
        if x == "(?:(?:":
            opened.append("))?")
        elif x == "(?:(?!)|(?:":
            opened.append("))")
        elif x == "END":
            parts[k] = opened.pop()
    return re.compile(r"(?<!\S)" + "".join(parts))


def test_template_labels_against_patterns(spark, sf):
    texts = [r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    rng = random.Random(8)
    import re

    for label, template in licenses.TEMPLATES.items():
        plain = re.sub(r"<<any:\d+>>", "the software", re.sub(r"<<or>>.*?<<end>>", "<<end>>", template))
        plain = re.sub(r"<<\w+>>", "", plain)
        texts += [plain, "Copyright 2020. " + plain + " And more.", " ".join(w for w in plain.split() if rng.random() > 0.02)]
    every = {k: as_regex(t) for k, t in licenses.TEMPLATES.items()}
    scanner = licenses.Scanner()
    hit = 0
    for t in texts:
        line = "".join(w + " " for w in licenses.words(t))
        want = {k for k, p in every.items() if p.search(line)}
        assert {l for *_, l in scanner.scan(t)["spans"]} == want, t[:200]
        hit += len(want)
    assert hit >= 2 * len(every)


def test_templates_may_begin_with_any_words():
    s = licenses.Scanner({}, {"x": "<<any:2>> grants rights"})
    assert [(a, b) for a, b, _ in s.scan("the owner grants rights")["spans"]] == [(0, 4), (1, 4), (2, 4)]


def test_typographic_signs_are_no_words_of_templates():
    mit = MIT + DISCLAIMERS["mit-text"]
    curly = mit.replace('"Software"', "\u201cSoftware\u201d").replace('"AS IS"', "\u201cAS IS\u201d")
    s = licenses.Scanner()
    for text in (mit, curly, curly.replace(" ", "\u00a0", 5), curly.replace("free of charge", "free \u2013 of \u2014 charge")):
        r = s.scan("\u00a9 2020 A B " + text)
        assert "mit-text" in {l for *_, l in r["spans"]}, text[:60]
    w = licenses.words("\u00a9 2020 " + curly)
    (a, b, _), = (x for x in s.scan("\u00a9 2020 " + curly)["spans"] if x[2] == "mit-text")
    assert w[a] == "permission" and licenses.template_words(w[b - 1 : b])[0] == ["software"]
    # base phrases keep the contract's words: a quote is a letter of its word
    assert s.scan("the \u201cmit license\u201d")["base"] == [] and s.scan("the \u201cx\u201d mit license")["base"] == [(2, "mit")]
    # words of other scripts count as they are, marks included
    assert {l for *_, l in s.scan("Copyright \u00a9 \u0930\u093e\u092e. All rights reserved")["spans"]} == {"all-rights-reserved"}
    assert s.scan("\u2014 \u201d")["n_words"] == 2 and s.scan("\u2014 \u201d")["spans"] == []
