"""Text expressions: tokens, references, roles, cleaning. Patterns state the domain's fixed values."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = "[0-9a-zà-öø-ÿ]+"
# References to clauses and standards.
CLAUSE = r"\b\d+(?:\.\d+)+\b"
STANDARD = r"(?i)\bISO\s*[-:]?\s*(\d{4,5})(?::\s*\d{4})?\b"
# Tag patterns of the metadata enrichment, in order.
TAGS = {
    "exercise_id": r"(?i)(?:Ejercicio|Problema|Actividad)\s+(\d+(?:\.\d+)?)",
    "theorem_id": r"(?i)(?:Teorema|Lema|Corolario|Proposición)\s+(\d+(?:\.\d+)?)",
    "definition_id": r"(?i)(?:Definición)\s+(\d+(?:\.\d+)?)",
    "example_id": r"(?i)(?:Ejemplo)\s+(\d+(?:\.\d+)?)",
    "section_id": r"(?i)(?:Sección)\s+(\d+(?:\.\d+)?)",
    "figure_id": r"(?i)(?:Figura|Imagen|Gráfico)\s+(\d+(?:\.\d+)?)",
    "clause_id": r"(?i)\b(?:cl[aá]usula\s*)?(\d+(?:\.\d+)+)\b",
}
# Authority rules in the order of their priority.
AUTHORITY_RULES = (
    ("constitution", "rubric|rubrica|evaluation|evaluacion|reglamento|integridad|integrity|grading|calificacion"),
    ("policy", "policy|procedimiento|procedure|programa|admin|calendario|calendar|guia|guide|estructura|structure|horario"),
    ("canonical", "standard|norma|manual|reference|spec|policy-manual|oficial|official|aprobado|approved"),
)
# What tells a table of contents and front matter.
DOT_LEADER = r"(?m)^.*\.{4,}\s*\d+\s*$"
TOC_KEYWORDS = "table of contents|indice|índice|contenido|contents"
FRONTMATTER = "all rights reserved|reservados los derechos|copyright|prólogo|prologo|foreword|isbn"


def tokens(text: Column) -> Column:
    """Lower-case words, in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def term_rank(text: Column, terms: list[str]) -> Column:
    """Saturated frequencies of all terms in a text, null unless every term occurs.

    Each term is counted by one pattern between word edges, so that no array of words is built; texts that
    lack a term are told by a substring search.
    """
    if not terms:
        return F.lit(None).cast("double")
    low = F.lower(F.coalesce(text, F.lit("")))
    letter = WORD[:-1]
    count = lambda t: F.regexp_count(low, F.lit(f"(?<!{letter}){t}(?!{letter})"))
    may = low.contains(terms[0])
    for t in terms[1:]:
        may = may & low.contains(t)

    def score(tf):
        part = [F.round(tf[k] / (tf[k] + F.lit(1.2)), 6) for k in range(len(terms))]
        return F.when(F.forall(tf, lambda n: n > 0), F.round(sum(part, F.lit(0.0)), 6))

    # a one-element array binds the counts
    return F.when(may, F.element_at(F.transform(F.array(F.array(*map(count, terms))), score), 1))


def clause_refs(text: Column) -> Column:
    """Clause references like 4.1.2, each once, in order."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(CLAUSE), F.lit(0)))


def standards(text: Column) -> Column:
    """Standards in canonical form, each once, in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(STANDARD), F.lit(1)), lambda x: F.concat(F.lit("ISO "), x)))


def scope_key(value: Column) -> Column:
    """Upper case with everything but letters and digits as hyphens."""
    return F.regexp_replace(F.upper(F.trim(value)), "[^A-Z0-9]+", "-")


def tags(text: Column) -> Column:
    """A struct of the enrichment's tag values, null where a tag doesn't occur."""
    return F.struct(*(F.nullif(F.regexp_extract(text, p, 1), F.lit("")).alias(k) for k, p in TAGS.items()))


def tag_prefix(text: Column) -> Column:
    """The text behind a line of its tags, unless it has none or starts with one."""
    found = [F.when(F.regexp_extract(text, p, 1) != "", F.concat(F.lit(f"[{k.upper()}: "), F.regexp_extract(text, p, 1), F.lit("]"))) for k, p in TAGS.items()]
    line = F.concat_ws(" ", *found)
    return F.when((line != "") & ~text.startswith("["), F.concat(line, F.lit("\n"), text)).otherwise(text)


def chunk_role(text: Column) -> Column:
    """frontmatter, toc or normative_body."""
    low = F.lower(F.coalesce(text, F.lit("")))
    dots = F.regexp_count(F.coalesce(text, F.lit("")), F.lit(DOT_LEADER))
    refs = F.regexp_count(F.coalesce(text, F.lit("")), F.lit(CLAUSE))
    front = low.rlike(FRONTMATTER) & (F.length(low) <= 2200)
    toc = low.rlike(TOC_KEYWORDS) | (dots >= 2) | ((dots >= 1) & (refs >= 6))
    return F.when(front, "frontmatter").when(toc, "toc").otherwise("normative_body")


def structural_only(text: Column, eligible: Column, is_toc: Column, is_frontmatter: Column) -> Column:
    """Whether a row is structure rather than content."""
    dots = F.regexp_count(F.coalesce(text, F.lit("")), F.lit(DOT_LEADER))
    marked = (~F.coalesce(eligible, F.lit(True))) | F.coalesce(is_toc, F.lit(False)) | F.coalesce(is_frontmatter, F.lit(False))
    return marked | (dots >= 2) | ((dots >= 1) & F.lower(F.coalesce(text, F.lit(""))).rlike(TOC_KEYWORDS))


def clean_content(text: Column) -> Column:
    """Lines without table borders, links unwrapped, white space collapsed, empty lines dropped."""
    lines = F.split(F.coalesce(text, F.lit("")), r"\r\n|\r|\n", -1)
    tidy = F.transform(lines, lambda x: F.trim(x))
    kept = F.filter(tidy, lambda x: (x != "") & ~x.rlike(r"^[|\s:+=_-]+$"))
    flat = F.transform(kept, lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"\[([^\]]*)\]\([^)]*\)", "$1"), r"\s+", " ")))
    return F.array_join(F.filter(flat, lambda x: x != ""), "\n")


#: Phrases that a print repeats on lines of their own, in lower case without accents. Callers pass their own.
PRINT_PHRASES = ("norma internacional", "norma", "internacional", "traduccion oficial", "official translation", "traduction officielle", "numero de referencia")
#: What opens a notice of rights (both must be on a line), and the addresses that such a notice ends with.
_RESERVES = (r"\breserv", r"\b(?:derech|rights|droits)")
_ADDRESS = r"(?:\S+@\S+|\b(?:https?://|www\.)\S+)"


def _plain(line: Column) -> Column:
    return F.translate(F.lower(line), "áàâäéèêëíìîïóòôöúùûüñç", "aaaaeeeeiiiioooouuuunc")


def _numbering(lines: Column) -> Column:
    """The places of lines that number pages: lone numbers next in value to the lone number before or after them, and
    lone lower-case Roman numerals where there are several."""
    place = F.transform(lines, lambda x, i: F.struct(i.alias("i"), F.trim(x).alias("x")))
    figures = F.filter(place, lambda p: p["x"].rlike(r"^\d{1,5}$"))
    romans = F.filter(place, lambda p: p["x"].rlike("^[ivxlcdm]{1,8}$"))
    value = lambda ps, k: F.get(ps, k)["x"].cast("int")

    def in_run(ps):
        near = lambda k: F.coalesce(value(ps, k) - value(ps, k - 1) == 1, F.lit(False))
        return F.filter(F.transform(ps, lambda p, k: F.when(near(k) | near(k + 1), p["i"])), lambda i: i.isNotNull())

    runs = F.element_at(F.transform(F.array(figures), in_run), 1)
    return F.concat(runs, F.when(F.size(romans) > 1, F.transform(romans, lambda p: p["i"])).otherwise(F.array().cast("array<int>")))


def strip_boilerplate(text: Column, phrases: Sequence[str] = PRINT_PHRASES) -> Column:
    """A print's repeated furniture removed and the gaps closed.

    Lines go that hold nothing but `phrases`, references to standards and punctuation, and those that number pages (see
    _numbering). A copyright sign takes the rest of its line with it. A notice of rights goes from the line that opens
    it to the last address of its paragraph, or that line alone.
    """
    opens = "".join(f"(?=[^\n]*{w})" for w in _RESERVES)
    bare = F.regexp_replace(text, "©[^\n]*", "")
    bare = F.regexp_replace(bare, rf"(?im)^{opens}(?:[^\n]+\n)*[^\n]*{_ADDRESS}[ \t]*", "")
    bare = F.regexp_replace(bare, rf"(?im)^{opens}[^\n]*$", "")
    known = "|".join(sorted((re.escape(p) for p in phrases), key=len, reverse=True))

    def tidy(lines):
        numbers = _numbering(lines)
        rest = lambda x: F.regexp_replace(F.regexp_replace(_plain(x), rf"\biso\s*[-:]?\s*\d{{4,5}}(?::\d{{4}})?", ""), rf"\b(?:{known})\b" if known else "$^", "")
        furniture = lambda x: x.rlike(r"\p{L}") & ~rest(x).rlike(r"\p{L}")
        kept = F.transform(lines, lambda x, i: F.when(~F.array_contains(numbers, i) & ~furniture(x), x))
        return F.array_join(F.filter(kept, lambda x: x.isNotNull()), "\n")

    lines = F.element_at(F.transform(F.array(F.split(bare, "\n", -1)), tidy), 1)
    return F.trim(F.regexp_replace(lines, r"\n{3,}", "\n\n"))


def standard_key(scope: Column) -> Column:
    """One spelling of a standard's number ("ISO 14001:2015", "iso14001", "14001"), other scopes in lower case."""
    low = F.lower(F.trim(scope))
    number = F.regexp_extract(low, r"^(?:iso\s*[-:/]?\s*)?(\d{4,5})(?:\s*:\s*\d{4})?$", 1)
    return F.when(number != "", F.concat(F.lit("iso "), number)).otherwise(low)


def scope_name_key(scope: str) -> str:
    """standard_key of a plain text."""
    low = scope.strip().lower()
    m = re.fullmatch(r"(?:iso\s*[-:/]?\s*)?(\d{4,5})(?:\s*:\s*\d{4})?", low)
    return f"iso {m[1]}" if m else low


def same_scope(scope: Column, requested: Sequence[str]) -> Column:
    """Whether a scope is one of those requested, in any of their spellings."""
    return F.coalesce(standard_key(scope).isin(sorted({scope_name_key(x) for x in requested})), F.lit(False))


def authority(*parts: Column) -> Column:
    """The authority level of a document by the first rule whose keywords occur in path, type or name."""
    text = F.lower(F.concat_ws(" ", *parts))
    out = F.lit("supplementary")
    for level, words in reversed(AUTHORITY_RULES):
        out = F.when(text.rlike(words), level).otherwise(out)
    return out


def content_key(text: Column) -> Column:
    """Hash of the text in lower case with white space collapsed."""
    return F.md5(F.lower(F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), r"\s+", " ")))


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor((F.length(F.coalesce(text, F.lit(""))) + 3) / 4)).cast("long")


def safe_filename(name: Column) -> Column:
    """Accents removed, anything but letters, digits, dot, underscore and hyphen as a hyphen."""
    plain = F.translate(name, "áàâäãåéèêëíìîïóòôöõúùûüñçÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÑÇ", "aaaaaaeeeeiiiiooooouuuuncAAAAAAEEEEIIIIOOOOOUUUUNC")
    return F.regexp_replace(F.regexp_replace(plain, r"[^a-zA-Z0-9._-]+", "-"), r"^-+|-+$", "")


def strip_markup(text: Column, most: int = 2000) -> Column:
    """Tags removed, markup characters escaped, at most so many characters."""
    bare = F.regexp_replace(text, r"<[^>]*>", "")
    esc = F.replace(F.replace(F.replace(bare, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.left(F.trim(esc), F.lit(most))


def fixed_windows(text: Column, width: int, overlap: int = 0) -> Column:
    """Array of (start, content) of windows of a fixed width."""
    step = width - overlap
    n = F.length(text)
    starts = F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - overlap - 1, F.lit(0)), F.lit(step))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.struct(s.alias("start"), F.substring(text, s + 1, F.lit(width)).alias("content")))


def worker_stage(message: Column) -> Column:
    """The worker stage that a message tells, by the first keyword in this order (fixed values)."""
    m = F.lower(F.coalesce(message, F.lit("")))
    rules = (("RAPTOR", "raptor"), ("GRAPH", "grafo|graph"), ("VISUAL", "visual"), ("PERSIST", "persist"), ("INGEST", "dispatch|ingestion|procesamiento"), ("ERROR", "error"), ("DONE", "exitoso|success"))
    out = F.lit("OTHER")
    for stage, words in reversed(rules):
        out = F.when(m.rlike(words), stage).otherwise(out)
    return out


def transient_error(message: Column) -> Column:
    """Whether an error message tells of something worth retrying."""
    return F.lower(F.coalesce(message, F.lit(""))).rlike("timeout|timed out|connection|temporarily|rate limit|429|502|503|504|reset by peer|unavailable")


def json_kind(raw: Column, path: str) -> Column:
    """What kind of value a JSON text holds at a path: object, array, string, boolean, number, null; none without one."""
    v = F.try_variant_get(F.try_parse_json(raw), path, "variant")
    kind = F.schema_of_variant(v)
    return F.when(v.isNull(), "none").when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean").when(kind == "VOID", "null").otherwise("number")


def json_holds(raw: Column, path: str, value) -> Column:
    """Whether a JSON text holds a scalar value at a path."""
    kind = "boolean" if isinstance(value, bool) else "long" if isinstance(value, int) else "double" if isinstance(value, float) else "string"
    return F.coalesce(F.try_variant_get(F.try_parse_json(raw), path, kind) == F.lit(value), F.lit(False))
