"""Deterministic identities, hash embeddings, times and context blocks."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

DIM = 128
# Prototypes of authority levels, and the words of a hash embedding.
PROTOTYPES = {
    "constitution": "rubric integrity grading hard constraint reglamento evaluacion",
    "policy": "policy procedimiento guia calendario admin schedule",
    "canonical": "standard norma manual oficial approved reference",
    "supplementary": "supplementary note annex support extra",
}
WORDS = "[a-zA-Z0-9áéíóúñ]+"


def uuid5(namespace: str, name: Column) -> Column:
    """The name-based UUID (version 5) of a text in a namespace given as hexadecimal UUID."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    part = lambda a, n: F.substring(h, a, n)
    variant = F.lower(F.conv((F.conv(part(17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)) + 8).cast("string"), 10, 16))
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12))


def entity_id(namespace: str, tenant: Column, name: Column) -> Column:
    """A tenant's entity by its name without case and accents."""
    flat = F.translate(F.lower(F.trim(name)), "áéíóúñ", "aeioun")
    return uuid5(namespace, F.concat(tenant.cast("string"), F.lit(":"), flat))


def _slots(words: Column) -> Column:
    return F.transform(words, lambda w: F.pmod(F.conv(F.substring(F.sha1(w), 1, 8), 16, 10).cast("long"), F.lit(DIM)).cast("int"))


def _prototype(text: str) -> dict[int, float]:
    out: dict[int, float] = {}
    for w in re.findall(WORDS, text.lower()):
        k = int(hashlib.sha1(w.encode()).hexdigest()[:8], 16) % DIM
        out[k] = out.get(k, 0.0) + 1.0
    return out


def hash_embedding(text: Column) -> Column:
    """The normalised counts of hashed words in 128 slots."""
    slots = _slots(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORDS), F.lit(0)))
    # one-element arrays bind a value that lambdas use often
    once = lambda value, f: F.element_at(F.transform(F.array(value), f), 1)
    counts = once(slots, lambda s: F.transform(F.sequence(F.lit(0), F.lit(DIM - 1)), lambda k: F.size(F.filter(s, lambda x: x == k)).cast("double")))
    length = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, x: a + x * x))
    scaled = lambda c, n: F.transform(c, lambda x: F.when(n > 0, x / n).otherwise(0.0))
    return once(counts, lambda c: once(length(c), lambda n: scaled(c, n)))


def authority_by_embedding(text: Column) -> Column:
    """The authority level whose prototype is nearest; earlier ones win ties."""
    slots = _slots(F.regexp_extract_all(F.lower(text), F.lit(WORDS), F.lit(0)))
    best, top = F.lit(None).cast("string"), F.lit(-1.0)
    for level, words in PROTOTYPES.items():
        p = _prototype(words)
        norm = sum(v * v for v in p.values()) ** 0.5
        table = F.create_map(*(F.lit(x) for kv in p.items() for x in kv))
        score = F.round(_sum(slots, table) / norm, 9)
        best, top = F.when(score > top, level).otherwise(best), F.greatest(score, top)
    return F.when(F.length(F.trim(text)) > 0, best)


def _sum(slots: Column, table: Column) -> Column:
    return F.aggregate(slots, F.lit(0.0), lambda a, s: a + F.coalesce(table[s], F.lit(0.0)))


def utc_time(text: Column) -> Column:
    """An ISO 8601 time in UTC, null if it is none."""
    return F.try_to_timestamp(F.regexp_replace(F.trim(text), "Z$", "+00:00"))


def parent_context(content: Column, heading: Column, title: Column, sections: Column) -> Column:
    """Content behind a block that tells its document and place."""
    block = F.concat(F.lit("DOC_TITLE: "), F.coalesce(title, F.lit("")), F.lit("\nTOTAL_SECTIONS: "), sections.cast("string"))
    place = F.coalesce(F.nullif(heading, F.lit("")), F.lit("[none]"))
    return F.concat(F.lit("[PARENT_CONTEXT]\n"), block, F.lit("\nSECTION_PATH: "), place, F.lit("\n[/PARENT_CONTEXT]\n\n"), content)


def section_ref(level: Column, page: Column, title: Column) -> Column:
    return F.concat(F.lit("L"), level.cast("string"), F.lit(":"), page.cast("string"), F.lit(":"), title)


def inline_fallback(content: Column, kind: Column, description: Column) -> Column:
    """Content with a visual's description in place of a node of its own."""
    return F.concat(content, F.lit("\n\n[VISUAL "), F.upper(kind), F.lit("]\n"), F.coalesce(description, F.lit("")))
