"""Exact BPE encoding by per-prefix dynamic programming, and decoding.

For every prefix of a word exactly one token can end its encoding: of the tokens that a suffix automaton
finds ending there, the one whose start is a prefix that ends in a compatible token. Two tokens are
compatible if merging their joined symbols never crosses the seam. Back-pointers from the whole word give
the ids without running merges.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import map_arrow, resident

#: White space as the vocabulary's normaliser sees it (fixed values), but the space itself.
_SPACES = "[\\t-\\r\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"
#: The same for ASCII texts, with the lower case of letters.
_ASCII = {x: 32 for x in range(9, 14)} | {x: x + 32 for x in range(65, 91)}
#: Words, and pieces of words, of a generation kept with their encodings in each worker; the last two generations stay.
CACHE = 50_000
#: Texts encoded at once, by number and by letters; pieces of so many bytes go word by word.
ROWS, LETTERS, LONG = 250, 1 << 18, 64
#: Pairs of tokens whose compatibility a worker remembers; a power of two of them in arrays.
PAIRS, SLOTS = 100_000, 1 << 18
_MULT = np.uint64(0x9E3779B97F4A7C15)


def byte_letters() -> list[str]:
    """The printable stand-in of each byte that byte-level vocabularies use."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 0
    for b in plain:
        out[b] = chr(b)
    for b in range(256):
        if not out[b]:
            out[b] = chr(256 + extra)
            extra += 1
    return out


class SuffixAutomaton:
    """All substrings of the tokens; walking a word, the state after each symbol is its longest suffix in it."""

    def __init__(self):
        self.step: list[dict] = [{}]
        self.link, self.size = [-1], [0]

    def _state(self, size, step, link):
        self.step.append(step)
        self.size.append(size)
        self.link.append(link)
        return len(self.size) - 1

    def add(self, symbols) -> None:
        last = 0
        for c in symbols:
            last = self._extend(last, c)

    def _extend(self, last, c):
        step, link, size = self.step, self.link, self.size
        q = step[last].get(c)
        if q is not None:
            if size[q] == size[last] + 1:
                return q
            copy = self._state(size[last] + 1, dict(step[q]), link[q])
            link[q] = copy
            p = last
            while p != -1 and step[p].get(c) == q:
                step[p][c] = copy
                p = link[p]
            return copy
        new, p = self._state(size[last] + 1, {}, 0), last
        while p != -1 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p != -1:
            q = step[p][c]
            if size[q] == size[p] + 1:
                link[new] = q
            else:
                copy = self._state(size[p] + 1, dict(step[q]), link[q])
                while p != -1 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        return new


class Memory:
    """Values by key; the last two generations of CACHE keys stay."""

    def __init__(self):
        self.new, self.old = {}, {}

    def found(self, keys) -> tuple[dict, list]:
        """(values of known keys, the other keys)."""
        known, missing, new, old = {}, [], self.new, self.old
        for k in keys:
            v = new.get(k)
            if v is None:
                v = old.get(k)
                if v is None:
                    missing.append(k)
                    continue
                new[k] = v
            known[k] = v
        return known, missing

    def keep(self, values: dict) -> None:
        self.new.update((k, v) for k, v in values.items() if len(k) <= 64)
        if len(self.new) >= CACHE:
            self.new, self.old = {}, self.new


class Table:
    """int64 keys to int32 values in arrays, looked up many at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, (2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.full(1 << bits, -1, np.int32)
        at, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = todo[self.keys[at[todo]] == -1]
            self.keys[at[free]] = keys[free]
            placed = self.keys[at[todo]] == keys[todo]
            self.values[at[todo[placed]]] = values[todo[placed]]
            todo = todo[~placed]
            at[todo] = (at[todo] + 1) & self.mask

    def _slot(self, keys):
        return (keys.view(np.uint64) * _MULT >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values, -1 where there is none."""
        at = self._slot(keys)
        held = self.keys[at]
        out = np.where(held == keys, self.values[at], -1)
        todo = np.flatnonzero((held != keys) & (held != -1))
        while len(todo):
            at[todo] = (at[todo] + 1) & self.mask
            held = self.keys[at[todo]]
            hit = held == keys[todo]
            out[todo[hit]] = self.values[at[todo[hit]]]
            todo = todo[~hit & (held != -1)]
        return out


class WordBpe:
    """A word-end BPE vocabulary of the tokenizers JSON format (byte letters, lower case, `</w>` at word ends).

    Its merges must be in the order in which they were learned, a token's parts before it.
    """

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        vocab: dict[str, int] = model["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.text = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.letters = byte_letters()
        merges = [tuple(x if isinstance(x, list) else x.split(" ")) for x in model["merges"]]
        self.rank = {(vocab[a], vocab[b]): r for r, (a, b) in enumerate(merges)}
        self.parts: dict[int, tuple[int, int]] = {}
        for a, b in merges:
            self.parts.setdefault(vocab[a + b], (vocab[a], vocab[b]))
        self.born = {t: self.rank[p] for t, p in self.parts.items()}
        if any(self.born.get(x, -1) > r for (a, b), r in self.rank.items() for x in (a, b)):
            raise ValueError("merges aren't in the order in which they were learned")
        self.alone = {}  # symbol -> token of one symbol
        for x in self.letters:
            for s in (x, x + self.end):
                if s in vocab:
                    self.alone[s] = vocab[s]
        self._left: dict[int, list] = {}
        self._right: dict[int, list] = {}
        self._fits: dict[int, bool] = {}
        self._pairs: dict[int, bool] = {}
        symbols = {}
        for t in sorted(self.parts, key=self.born.get):
            a, b = self.parts[t]
            symbols[t] = symbols.get(a, (a,)) + symbols.get(b, (b,))
        usable = {t: s for t, s in symbols.items() if self._whole(t)}
        self.longest = max(map(len, usable.values()), default=1)
        # the automaton's states of which tokens are suffixes, by the way of suffix links
        sam = SuffixAutomaton()
        for s in sorted(usable.values()):
            sam.add(s)
        ends: dict[int, list] = {}
        for t, s in [*usable.items(), *((x, (x,)) for x in self.alone.values())]:
            state = 0
            for c in s:
                state = sam.step[state].get(c)
                if state is None:
                    break
            else:
                ends.setdefault(state, []).append((len(s), t))
        self.sam, own = sam, ends
        self.ending: list[tuple] = [()] * len(sam.size)
        for v in sorted(range(1, len(sam.size)), key=sam.size.__getitem__):
            up = self.ending[sam.link[v]]
            self.ending[v] = tuple(sorted(own[v], reverse=True)) + up if v in own else up
        self.matches = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        self.space = regex.compile(_SPACES)
        most = max(self.text) + 1
        self.names, self.tokens = np.array([str(i) for i in range(most)], object), np.array([self.text.get(i) for i in range(most)], object)
        self.inner = [self.alone.get(x, -1) for x in self.letters]
        self.final = [self.alone.get(x + self.end, -1) for x in self.letters]
        self._arrays()
        self.pieces = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\p{L}\p{N}]+")
        self.memory = Memory()  # ids, as int32, of a piece or of all pieces between two spaces

    # pair compatibility

    def _spine(self, token: int, side: int) -> list[tuple[int, int, int]]:
        """(piece, rank at which it arises, rank at which it is merged away) at a token's seam side, base first."""
        held = (self._left, self._right)[side]
        if token not in held:
            line, t = [token], token
            while t in self.parts:
                t = self.parts[t][side]
                line.append(t)
            line.reverse()
            born = [self.born.get(t, -1) for t in line]
            held[token] = [(t, b, d) for t, b, d in zip(line, born, [*born[1:], 1 << 60])]
        return held[token]

    def _crosses(self, a: int, b: int, own: int = -1) -> bool:
        """Whether a merge joins symbols of both sides of the seam between tokens a and b; own: a merge that may.

        The earliest possible crossing decides; at equal rank the leftmost merge goes first.
        """
        rank = self.rank
        for x, born_x, gone_x in self._spine(a, 1):
            for y, born_y, gone_y in self._spine(b, 0):
                m = rank.get((x, y))
                if m is not None and m != own and m > born_x and m > born_y and m < gone_x and m <= gone_y:
                    return True
        return False

    def _whole(self, token: int) -> bool:
        """Whether a token's own symbols encode to it."""
        if token not in self._fits:
            a, b = self.parts[token]
            fits = all(x not in self.parts or self._whole(x) for x in (a, b))
            self._fits[token] = fits and not self._crosses(a, b, self.rank[(a, b)])
        return self._fits[token]

    # encoding

    def _arrays(self) -> None:
        """The automaton for many words at once: symbols are bytes, those that end a word 256 on."""
        sam = self.sam
        self.single = np.array(self.inner + self.final, np.int32)
        symbol = {x: k for k, x in enumerate(self.single.tolist())}
        # read into arrays one by one: a worker's memory doesn't shrink again
        keys = np.fromiter((v << 9 | symbol[c] for v, step in enumerate(sam.step) for c in step), np.int64)
        self.steps = Table(keys, np.fromiter((to for step in sam.step for to in step.values()), np.int32))
        self.links, self.sizes = np.array(sam.link, np.int32), np.array(sam.size, np.int32)
        self.choice = np.concatenate(([0], np.cumsum(np.fromiter(map(len, self.ending), np.int64))))  # a state's tokens, longest first
        self.choice_size = np.fromiter((n for e in self.ending for n, _ in e), np.int32)
        self.choice_token = np.fromiter((x for e in self.ending for _, x in e), np.int32)
        self.pair_key, self.pair_crosses = np.full(SLOTS, -1, np.int64), np.zeros(SLOTS, bool)

    def _cross(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """_crosses of many pairs; a slot remembers its last pair."""
        key = a.astype(np.int64) << 32 | b
        at = (key.view(np.uint64) * _MULT >> np.uint64(20)).astype(np.int64) & (SLOTS - 1)
        out = self.pair_crosses[at]
        new = np.flatnonzero(self.pair_key[at] != key)
        if len(new):
            asked, back = np.unique(key[new], return_inverse=True)
            out[new] = np.array([self._crosses(k >> 32, k & 0xFFFFFFFF) for k in asked.tolist()], bool)[back]
            self.pair_key[at[new]], self.pair_crosses[at[new]] = key[new], out[new]
        return out

    def words(self, pieces: list[str]) -> list[bytes]:
        """The ids of each piece as int32: word() for many, all their prefixes of one length at a time."""
        raw = [p.encode("utf-8") for p in pieces]
        length = np.array([len(x) for x in raw], np.int64)
        order = np.argsort(-length, kind="stable")
        length = length[order]
        start = np.cumsum(length) - length
        symbol = np.frombuffer(b"".join([raw[k] for k in order]), np.uint8).astype(np.int64)
        symbol[start + length - 1] += 256
        single = self.single[symbol]
        if (single < 0).any():
            raise KeyError("bytes without a token")
        base = start + np.arange(len(raw))  # a word has a place before its first symbol
        last = np.full(len(symbol) + len(raw), -1, np.int32)
        size = np.zeros(len(last), np.int32)
        states, helds = np.zeros(len(raw), np.int64), np.zeros(len(raw), np.int64)
        for i in range(1, int(length[0]) + 1 if len(raw) else 0):
            m = int(np.searchsorted(-length, -i, side="right"))
            state, held, c = states[:m], helds[:m], symbol[start[:m] + i - 1]
            live = np.arange(m)
            while len(live):
                to = self.steps.get(state[live] << 9 | c[live])
                ok = to >= 0
                state[live[ok]] = to[ok]
                held[live[ok]] += 1
                live = live[~ok]
                root = state[live] == 0
                held[live[root]] = 0
                live = live[~root]
                state[live] = self.links[state[live]]
                held[live] = self.sizes[state[live]]
            token, took = single[start[:m] + i - 1], np.ones(m, np.int32)  # unless a longer token fits
            k, end, left = self.choice[state], self.choice[state + 1], np.arange(m)
            while len(left := left[k[left] < end[left]]):
                t, n = self.choice_token[k[left]], self.choice_size[k[left]]
                fits = n <= held[left]  # of the state, but not all of it may be here
                ask = np.flatnonzero(fits & (n < i))
                fits[ask] = ~self._cross(last[base[left[ask]] + i - n[ask]], t[ask])
                token[left[fits]], took[left[fits]] = t[fits], n[fits]
                left = left[~fits]
                k[left] += 1
            last[base[:m] + i], size[base[:m] + i] = token, took
        at, who, tokens, owners = length.copy(), np.arange(len(raw)), [], []
        while len(who):
            place = base[who] + at[who]
            tokens.append(last[place])
            owners.append(who)
            at[who] -= size[place]
            who = who[at[who] > 0]
        owner = np.concatenate([np.zeros(0, np.int64), *owners])
        step = np.repeat(np.arange(len(owners)), [len(x) for x in owners])
        ids = np.concatenate([np.zeros(0, np.int32), *tokens])[np.lexsort((-step, owner))].tobytes()
        ends = (4 * np.cumsum(np.bincount(owner, minlength=len(raw)))).tolist()
        out: list = [None] * len(raw)
        for k, lo, hi in zip(order.tolist(), [0, *ends], ends):
            out[k] = ids[lo:hi]
        return out

    def word(self, piece: str) -> list[int]:
        """The ids of one piece."""
        raw = piece.encode("utf-8")
        s = [self.inner[b] for b in raw]
        s[-1] = self.final[raw[-1]]
        if -1 in s:
            raise KeyError(piece)
        n = len(s)
        step, ending, reach, pairs = self.sam.step, self.ending, self.sam.size, self._pairs
        last = [-1] * (n + 1)
        size = [0] * (n + 1)
        state, held, link = 0, 0, self.sam.link
        for i in range(1, n + 1):
            c = s[i - 1]
            while state and c not in step[state]:
                state = link[state]
                held = reach[state]
            state = step[state].get(c, 0)
            held = held + 1 if state else 0
            for length, t in ending[state]:
                if length > held:
                    continue  # of the state, but not all of it is here
                if length < i:
                    key = last[i - length] << 32 | t
                    crosses = pairs.get(key)
                    if crosses is None:
                        crosses = self._pair(key)
                    if crosses:
                        continue
                last[i], size[i] = t, length
                break
            else:
                last[i], size[i] = c, 1  # a symbol no merge knows
        out, i = [], n
        while i:
            out.append(last[i])
            i -= size[i]
        return out[::-1]

    def _pair(self, key: int) -> bool:
        if len(self._pairs) > PAIRS:
            self._pairs.clear()
        found = self._pairs[key] = self._crosses(key >> 32, key & 0xFFFFFFFF)
        return found

    def _looked_up(self, words: set[str]) -> dict[str, bytes]:
        """The ids of each word without spaces. A piece alone is a word of one piece."""
        found, missing = self.memory.found(words)
        alone, several = [], {}
        for w in missing:
            if w.isascii() and w.isalpha() or len(x := self.pieces.findall(w)) == 1:
                alone.append(w)
            else:
                several[w] = x
        parts, unknown = self.memory.found({p for x in several.values() for p in x} - words)
        alone += unknown
        short = [p for p in alone if len(p) * 4 <= LONG]
        fresh = dict(zip(short, self.words(short)))
        fresh |= {p: np.array(self.word(p), np.int32).tobytes() for p in alone if len(p) * 4 > LONG}
        found |= fresh
        parts |= found
        made = {w: b"".join([parts[p] for p in x]) for w, x in several.items()}
        found |= made
        self.memory.keep(fresh)
        self.memory.keep(made)
        return found

    def _sections(self, text: str):
        """(special token or None, plain text) in order."""
        at = 0
        for m in self.matches.finditer(text):
            yield None, text[at : m.start()]
            yield m.group(), ""
            at = m.end()
        yield None, text[at:]

    def normal(self, text: str) -> str:
        """NFC, white space to spaces, lower case letter by letter; runs of spaces stay, they only part pieces."""
        if text.isascii():
            return text.translate(_ASCII)
        return self.space.sub(" ", unicodedata.normalize("NFC", text)).replace("Σ", "σ").lower()

    def encoded(self, texts: list[str]):
        """Yields (ids as int32, decoded text) of each whole text."""
        held, letters = [], 0
        for text in texts:
            # no piece reaches over a space, so words are looked up whole
            parts = [(special, [w for w in self.normal(plain).split(" ") if w]) for special, plain in (self._sections(text) if "<|" in text else ((None, text),))]
            held.append(parts)
            letters += len(text)
            if letters > LETTERS:
                yield from self._joined(held)
                held, letters = [], 0
        yield from self._joined(held)

    def _joined(self, texts: list[list]):
        found = self._looked_up({w for parts in texts for _, words in parts for w in words})
        for parts in texts:
            out = []
            for special, words in parts:
                if special:
                    out.append(np.array([self.special[special]], np.int32).tobytes())
                out += map(found.__getitem__, words)
            ids = np.frombuffer(b"".join(out), np.int32)
            yield ids, " ".join(self.tokens[ids].tolist())

    def digits(self, ids: np.ndarray) -> str:
        """Decimal ids joined by a space."""
        return " ".join(self.names[ids].tolist())

    def encode(self, text: str) -> list[int]:
        return next(self.encoded([text]))[0].tolist()

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by a space, as a vocabulary without a decoder has it; unknown ids are passed over."""
        return " ".join(self.text[i] for i in ids if i in self.text)


_held: dict[str, WordBpe] = {}


def vocabulary(path: str) -> WordBpe:
    """One per worker and path."""
    if path not in _held:
        _held[path] = WordBpe(path)
        resident("bpe", _held.clear)
    return _held[path]


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def bpe_encode(docs: DataFrame, vocab: str = "word_bpe_49k.json", id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids array<int>, decoded string) of every whole text, or with digests
    (doc_id, n_tokens, ids_sha256, decoded_sha256).

    vocab is a file of the public tokenizers, found on each executor, or a path. A null text is encoded as
    empty (no ids). Rows come out as often as they went in; other columns are ignored.
    """
    schema = "doc_id long, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string")

    def one(batch):
        bpe = vocabulary(vocab if "/" in vocab else public_path(vocab))
        n, a, b = [], [], []
        for ids, words in bpe.encoded([x or "" for x in batch.column("text").to_pylist()]):
            n.append(len(ids))
            if digests:
                a.append(hashlib.sha256(bpe.digits(ids).encode()).hexdigest())
                b.append(hashlib.sha256(words.encode()).hexdigest())
            else:
                a.append(ids)
                b.append(words)
        if digests:
            first = pa.array(a, pa.string())
        else:
            ends = pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32))
            first = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.int32), *a])))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), first, pa.array(b, pa.string())], [x.split()[0] for x in schema.split(", ")])

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), one, schema, keeps="bpe", rows=ROWS)
