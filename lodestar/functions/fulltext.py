"""Full-text matching and cover-density ranks as column expressions.

A query is a search-box text: words that must all occur, "phrases", alternatives joined by `or`, and -words that
must not occur. The rank sums 0.1 / (1 + other words inside) over the minimal covers, runs of words that hold every
term of the alternative and no shorter run that does.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestar.functions.text import WORD, tokens

# Words that a stemmed query passes over, and endings that stemming takes off, longest first.
STOP_WORDS = ("a", "al", "como", "con", "de", "del", "el", "en", "es", "la", "las", "lo", "los", "no", "o", "para", "por", "que", "se", "su", "un", "una", "y")
ENDING = "(?:aciones|mente|ación|idades|idad|iones|ando|endo|ados|adas|idos|idas|ado|ada|ido|ida|ión|es|as|os|s|a|e|o)$"
#: Letters that a stem keeps at least.
STEM_LETTERS = 3


def stem(word: Column) -> Column:
    """A word without its ending, unless too little stays."""
    bare = F.regexp_replace(word, ENDING, "")
    return F.when(F.length(bare) >= STEM_LETTERS, bare).otherwise(word)


def stem_text(word: str) -> str:
    bare = re.sub(ENDING, "", word)
    return bare if len(bare) >= STEM_LETTERS else word


@dataclass(frozen=True)
class TextQuery:
    """Alternatives of which one must match, each of groups of consecutive words that must all occur, and words that must not."""

    alternatives: tuple[tuple[tuple[str, ...], ...], ...]
    excluded: tuple[tuple[str, ...], ...]

    @property
    def terms(self) -> list[str]:
        return list(dict.fromkeys(w for a in self.alternatives for g in a for w in g))


def text_query(text: str, stemmed: bool = False) -> TextQuery:
    """A search-box text as alternatives and exclusions; stop words of a stemmed query go."""
    found, excluded, now = [], [], []
    for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|([^\s"]+))', text.lower()):
        if word == "or" and not minus:
            found.append(now)
            now = []
            continue
        ws = re.findall("[0-9a-zà-öø-ÿ]+", phrase or word)
        ws = [stem_text(w) for w in ws if w not in STOP_WORDS] if stemmed else ws
        if ws and minus:
            excluded.append(tuple(ws))
        elif ws:
            now.append(tuple(ws))
    found.append(now)
    return TextQuery(tuple(tuple(dict.fromkeys(a)) for a in found if a), tuple(excluded))


def _numbers(terms: list[str], stemmed: bool):
    """The term number from 1 of a word, 0 for others. A stem begins its word, so that only words that begin with
    a term are stemmed."""

    def one(w):
        out = None
        for k, t in enumerate(terms, 1):
            mine = w.startswith(t) & (stem(w) == t) if stemmed else w == t
            out = F.when(mine, k) if out is None else out.when(mine, k)
        return out.otherwise(0)

    return one


def _all_words(text: Column) -> Column:
    """(words passed over since the last one, word) of every word."""
    return F.transform(tokens(text), lambda w: F.struct(F.lit(0).alias("g"), w.alias("w")))


def _some_words(text: Column, terms: list[str]) -> Column:
    """(words passed over since the last one, word) of the words that begin with a term. What stands between them
    is only counted, so that the array is as long as there are hits."""
    letter = WORD[:-1]
    hit = f"(?<!{letter})(?:{'|'.join(sorted(terms, key=len, reverse=True))}){letter}*"
    low = F.lower(F.coalesce(text, F.lit("")))
    between = F.transform(F.split(low, hit, -1), lambda x: F.regexp_count(x, F.lit(WORD)))
    return F.filter(F.zip_with(between, F.regexp_extract_all(low, F.lit(hit), F.lit(0)), lambda g, w: F.struct(g.alias("g"), w.alias("w"))), lambda x: x["w"].isNotNull())


def _covers(hits: Column, wanted: list[int]) -> Column:
    """The rank of one alternative over hits (t, g): a single pass that remembers each term's last place."""
    n = len(wanted)
    zero = F.struct(*(F.lit(-1).alias(f"l{k}") for k in range(n)), *(F.lit(-1).alias(f"e{k}") for k in range(n)), F.lit(0).alias("at"), F.lit(0).alias("seen"), F.lit(-1).alias("from_"), F.lit(0.0).alias("rank"))

    def step(acc, x):
        place = acc["at"] + x["g"]
        mine = [x["t"] == t for t in wanted]
        some = reduce(lambda a, b: a | b, mine)
        seen = acc["seen"] + F.when(some, 1).otherwise(0)
        last = [F.when(m, place).otherwise(acc[f"l{k}"]) for k, m in enumerate(mine)]
        entry = [F.when(m, seen).otherwise(acc[f"e{k}"]) for k, m in enumerate(mine)]
        begin = F.least(*last) if n > 1 else last[0]
        first = F.least(*entry) if n > 1 else entry[0]
        ends = some & (begin >= 0) & (begin > acc["from_"])
        noise = (place - begin) - (seen - first)
        return F.struct(*(c.alias(f"l{k}") for k, c in enumerate(last)), *(c.alias(f"e{k}") for k, c in enumerate(entry)), (place + 1).alias("at"), seen.alias("seen"), F.when(ends, begin).otherwise(acc["from_"]).alias("from_"), F.when(ends, acc["rank"] + F.lit(0.1) / (F.lit(1) + noise)).otherwise(acc["rank"]).alias("rank"))

    return F.aggregate(hits, zero, step, lambda acc: acc["rank"])


def _consecutive(hits: Column, numbers: list[int]) -> Column:
    """Whether the numbered terms stand one after the other somewhere."""

    def follows(i, k):
        x = F.get(hits, i + k)
        return F.coalesce((x["t"] == numbers[k]) & (x["g"] == 0), F.lit(False))

    at = F.transform(hits, lambda x, i: F.when(x["t"] == numbers[0], i))
    return F.exists(at, lambda i: i.isNotNull() & reduce(lambda a, b: a & b, (follows(i, k) for k in range(1, len(numbers)))))


def match(query: TextQuery):
    """(terms, whether a lower-case text may match, the rank of its words), or None for a query without words."""
    terms = list(dict.fromkeys([*query.terms, *(w for g in query.excluded for w in g)]))
    number = {t: k for k, t in enumerate(terms, 1)}

    def may(low):
        return reduce(lambda a, b: a | b, (reduce(lambda a, b: a & b, (low.contains(w) for g in a for w in g)) for a in query.alternatives))

    def ranked(hits):
        held = lambda g: F.exists(hits, lambda x: x["t"] == number[g[0]]) if len(g) == 1 else _consecutive(hits, [number[w] for w in g])
        out = []
        for a in query.alternatives:
            every = reduce(lambda x, y: x & y, (held(g) for g in a))
            wanted = list(dict.fromkeys(number[w] for g in a for w in g))
            out.append(F.when(every, F.round(_covers(hits, wanted), 6)))
        best = F.greatest(*out) if len(out) > 1 else out[0]
        for g in query.excluded:
            best = F.when(~held(g), best)
        return best

    return terms, may, ranked


def _once(value: Column, f) -> Column:
    """f of a value that is computed once: a one-element array binds it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def cover_ranks(text: Column, /, **queries: tuple[TextQuery, bool]) -> Column:
    """A struct of the ranks of a text by (query, stemmed) for each name, null where it doesn't match: the best
    alternative's. A text is cut into words once for all queries, and not at all if it lacks their terms."""
    low = F.lower(F.coalesce(text, F.lit("")))
    matches = {n: (match(q), stemmed) for n, (q, stemmed) in queries.items() if q.alternatives}
    none = F.lit(None).cast("double")
    if not matches:
        return F.struct(*(none.alias(n) for n in queries))
    phrases = any(len(g) > 1 for q, _ in queries.values() for g in (*q.excluded, *(g for a in q.alternatives for g in a)))
    terms = list(dict.fromkeys(t for m, _ in matches.values() for t in m[0]))

    def ranks(words):
        out = []
        for n in queries:
            if n not in matches:
                out.append(none.alias(n))
                continue
            (own, _, ranked), stemmed = matches[n]
            number = _numbers(own, stemmed)
            hits = F.transform(words, lambda x: F.struct(number(x["w"]).alias("t"), x["g"].alias("g")))
            out.append(_once(hits, ranked).alias(n))
        return F.struct(*out)

    may = reduce(lambda a, b: a | b, (m[1](low) for m, _ in matches.values()))
    return F.when(may, _once(_all_words(text) if phrases else _some_words(text, terms), ranks)).otherwise(F.struct(*(none.alias(n) for n in queries)))


def cover_rank(text: Column, query: TextQuery, stemmed: bool = False) -> Column:
    """The rank of a text by one query, null unless it matches."""
    return cover_ranks(text, rank=(query, stemmed))["rank"]
