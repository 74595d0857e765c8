"""Ingestion: cleaning, splitting, enrichment and idempotent loading of documents."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar import storage
from lodestar.functions.text import chunk_role, clause_refs, standards, strip_boilerplate, tag_prefix, tags
from lodestar.operators.textindex import with_buckets, write_text_index

#: Folders of a chunk table at least, and rows that a folder and a task of it should have.
BUCKETS, ROWS = 64, 200_000
PIECES = "array<struct<heading:string,content:string>>"
_HEADING = re.compile(r"^(#{1,6})\s+(.+?)\s*$")
_CLAUSE_LINE = re.compile(r"^\s*\d+(?:\.\d+)*\s+\S.{0,120}?(?:\.{2,}\s*\d+|\s\d+)?\s*$")


def pack_paragraphs(text: str, most: int) -> list[str]:
    """Paragraphs joined up to a size; a longer one is cut at line ends, then at its size."""
    out, held = [], ""
    for p in re.split(r"\n\s*\n", text or ""):
        p = p.strip()
        if not p:
            continue
        pieces = [p] if len(p) <= most else _cut(p, most)
        for x in pieces:
            if held and len(held) + 2 + len(x) > most:
                out.append(held)
                held = x
            else:
                held = f"{held}\n\n{x}" if held else x
    return out + [held] if held else out


def _cut(text: str, most: int) -> list[str]:
    out, rest = [], text
    while len(rest) > most:
        at = rest.rfind("\n", 1, most)
        at = at if at > 0 else most
        out.append(rest[:at].strip())
        rest = rest[at:].strip()
    return [x for x in [*out, rest] if x]


def split_headings(text: str, most: int, least: int = 150) -> list[tuple[str, str]]:
    """(heading path, content) of markdown sections; short sections join the next, long ones are parted."""
    stack: list[tuple[int, str]] = []
    sections: list[tuple[str, str]] = []
    held: list[str] = []

    def close():
        body = "\n".join(held).strip()
        held.clear()
        if body:
            sections.append((" > ".join(t for _, t in stack), body))

    for line in (text or "").splitlines():
        if m := _HEADING.match(line):
            close()
            level = len(m[1])
            while stack and stack[-1][0] >= level:
                stack.pop()
            stack.append((level, m[2]))
        else:
            held.append(line)
    close()
    merged: list[tuple[str, str]] = []
    carry = ""
    for k, (path, body) in enumerate(sections):
        body = f"{carry}\n\n{body}" if carry else body
        carry = ""
        if len(body) < least and k + 1 < len(sections):
            carry = body
            continue
        merged.append((path, body))
    out = []
    for path, body in merged:
        parts = pack_paragraphs(body, most)
        out += [(path if len(parts) == 1 else f"{path} (part {i})".strip(), p) for i, p in enumerate(parts, 1)]
    return out


def strip_toc_block(text: str, run: int = 8, least_lines: int = 30) -> str:
    """A dense run of clause-like lines in the first quarter of a long document removed."""
    lines = (text or "").split("\n")
    if len(lines) < least_lines:
        return text or ""
    edge = max(1, len(lines) // 4)
    best, start = (0, 0), None
    for k in range(edge + 1):
        hit = k < edge and bool(_CLAUSE_LINE.match(lines[k]))
        if hit and start is None:
            start = k
        if not hit and start is not None:
            if k - start > best[1] - best[0]:
                best = (start, k)
            start = None
    return "\n".join(lines[: best[0]] + lines[best[1] :]) if best[1] - best[0] >= run else text


def splitter(split: Callable[[str], list[tuple[str, str]]]):
    """A pandas UDF from texts to pieces."""

    @F.pandas_udf(PIECES)
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"heading": h, "content": c} for h, c in split(t or "")])

    return run


def chunked(docs: DataFrame, most: int = 1500, headings: bool = True) -> DataFrame:
    """(doc_id, chunk_index, heading, content, role, eligible, standards, clauses, tags) of cleaned documents."""

    def split(t):
        t = strip_toc_block(t)
        return split_headings(t, most) if headings and re.search(r"(?m)^#{1,6}\s", t) else [("", p) for p in pack_paragraphs(t, most)]

    clean = docs.select("doc_id", strip_boilerplate(F.coalesce("text", F.lit(""))).alias("__text"))
    d = clean.select("doc_id", F.posexplode(splitter(split)(F.col("__text"))).alias("chunk_index", "piece")).select("doc_id", "chunk_index", "piece.*")
    return enriched(d)


def enriched(chunks: DataFrame) -> DataFrame:
    """Chunks with their role, references and tags; content carries its tag line."""
    c = F.col("content")
    return chunks.withColumns({"role": chunk_role(c), "standards": standards(c), "clauses": F.slice(clause_refs(c), 1, 20), "tags": tags(c)}).withColumn("eligible", F.col("role") == "normative_body").withColumn("content", tag_prefix(c))


def window_chunks(docs: DataFrame, width: int, overlap: int = 0, text: str = "text") -> DataFrame:
    """(doc_id, start, content): overlapping windows of a fixed width."""
    from lodestar.functions.text import fixed_windows

    return docs.select("doc_id", F.explode(fixed_windows(F.col(text), width, overlap)).alias("w")).select("doc_id", "w.start", "w.content")


def repeated_lines(pages: DataFrame, share: float = 0.35, least: int = 2, edge: int = 2) -> DataFrame:
    """(doc, line, pages): first and last lines that recur, digits as #, on enough of a document's pages.
    pages: (doc, page, text)."""
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    ends = F.array_distinct(F.concat(F.slice("lines", 1, edge), F.slice("lines", F.greatest(F.size("lines") - edge + 1, F.lit(1)), edge)))
    norm = F.lower(F.regexp_replace(F.regexp_replace("line", r"\d+", "#"), r"\s+", " "))
    p = pages.withColumn("lines", lines)
    total = p.groupBy("doc").agg(F.countDistinct("page").alias("total"))
    seen = p.where(F.size("lines") > 0).select("doc", "page", F.explode(ends).alias("line")).select("doc", "page", norm.alias("line")).distinct().groupBy("doc", "line").agg(F.count("*").alias("pages"))
    return seen.join(total, "doc").where(F.col("pages") >= F.greatest(F.lit(least), F.ceil(F.col("total") * share))).select("doc", "line", "pages")


def page_of_offset(spans: DataFrame, offsets: DataFrame) -> DataFrame:
    """offsets (doc, pos) with the page whose start is the last one not behind them: an as-of join in one window."""
    u = spans.select("doc", F.col("start").alias("at"), F.lit(0).alias("kind"), "page", F.lit(None).cast("long").alias("pos")).unionByName(offsets.select("doc", F.col("pos").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("page"), F.col("pos").cast("long").alias("pos")))
    w = Window.partitionBy("doc").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return u.withColumn("page", F.last("page", ignorenulls=True).over(w)).where("kind = 1").select("doc", "pos", "page")


def nearest_page(tasks: DataFrame, pages: DataFrame) -> DataFrame:
    """(task, page): the exact page, else the nearest lower, else the nearest higher. tasks: (task, doc, wanted)."""
    j = tasks.join(pages, "doc", "left")
    rank = F.when(F.col("page") == F.col("wanted"), 0).when(F.col("page") < F.col("wanted"), 1).otherwise(2)
    return j.groupBy("task").agg(F.min_by("page", F.struct(rank.alias("a"), F.abs(F.col("page") - F.col("wanted")).alias("b"))).alias("page"))


def _buckets(new: DataFrame, path: str) -> int:
    """How many folders a chunk table has: decided by its first load, kept beside it."""
    spark = new.sparkSession
    if storage.exists(spark, f"{path}.folders"):
        return spark.read.parquet(f"{path}.folders").head()[0]
    n = 1
    while n * ROWS < new.count():
        n *= 2
    spark.range(1).select(F.lit(max(n, BUCKETS)).alias("n")).write.parquet(f"{path}.folders")
    return max(n, BUCKETS)


def load_chunks(chunks: DataFrame, path: str, index: str | None = None) -> None:
    """Replace the chunks of the sources at hand and leave others. Rows that are eligible but have no embedding
    are left out, and a source of which none is left loses its old rows too; no row at all is an error, as is a
    row of another tenant than the first. index: the full-text index of the table, whose folders are replaced too.

    Sources are dealt into folders by hash, as many as the first load has rows for (BUCKETS at least); only folders of
    sources at hand are rewritten, each by as many tasks as it has ROWS, from a table beside them. Folders that lose
    all rows are deleted once the others are written.
    """
    spark, path = chunks.sparkSession, path.rstrip("/")
    fit = (~F.col("eligible") | (F.size("embedding") > 0)) if "embedding" in chunks.columns else F.lit(True)
    new = storage.kept(chunks.withColumn("__fit", fit), "load")
    tenants = F.count_distinct("tenant_id") if "tenant_id" in chunks.columns else F.lit(1)
    facts = new.agg(F.count_if("__fit").alias("rows"), tenants.alias("tenants")).head()
    if not facts["rows"]:
        raise ValueError("NO_CHUNKS: no row is fit to be loaded")
    if facts["tenants"] > 1:
        raise ValueError("TENANT_MISMATCH: chunks of several tenants")
    held = storage.exists(spark, path)
    new = with_buckets(new, _buckets(new, path))
    at = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # no more than there are folders
    whole = new.where("__fit").drop("__fit")
    if held:
        old = spark.read.parquet(path).where(F.col("bucket").isin(at)).join(new.select("source_id").distinct(), "source_id", "left_anti")
        whole = whole.unionByName(old, allowMissingColumns=True)
    whole = storage.kept(whole, "whole")
    sizes = whole.groupBy("bucket").agg(F.ceil(F.count("*") / ROWS).cast("int").alias("__tasks"))
    spread = whole.join(F.broadcast(sizes), "bucket").withColumn("__part", F.pmod(F.xxhash64(F.monotonically_increasing_id()), "__tasks"))
    storage.replace_folders(spread.repartition("bucket", "__part").drop("__tasks", "__part"), path, "bucket", at)
    if index:
        write_text_index(whole, index, at)


def merge_rows(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Upsert: new rows replace old ones of the same keys; repeated new ones come once (see checked_upsert for an order)."""
    return checked_upsert(old, new, keys, F.lit(0), {})[0]


def checked_upsert(old: DataFrame, new: DataFrame, keys: list[str], order: Column, rules: dict[str, Column], types: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(merged, rejected) of an upsert in which a bad row doesn't keep the good ones out.

    A row is bad if a key is null, a rule (a condition by its error's name) doesn't hold, or a column can't be cast to its
    type; it comes out of rejected with all its errors, as it came. Good rows replace old ones of their keys; among
    repeated keys the last by `order` wins, equal ones by a hash of the row. New rows are read once.
    """
    types = types or {}
    tests = {f"NULL_KEY: {k}": F.col(k).isNotNull() for k in keys} | rules
    tests |= {f"NOT_{t.upper()}: {c}": F.col(c).isNull() | F.col(c).try_cast(t).isNotNull() for c, t in types.items()}
    errors = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in tests.items()))) if tests else F.array().cast("array<string>")
    turn = F.struct(order.alias("o"), F.xxhash64(*new.columns).alias("h"))
    checked = storage.kept(new.withColumns({"__errors": errors, "__turn": turn}), "upsert")
    good = checked.where(F.size("__errors") == 0)
    last = good.groupBy(*keys).agg(F.max_by(F.struct(*new.columns), "__turn").alias("x")).select("x.*")
    last = last.withColumns({c: F.col(c).cast(t) for c, t in types.items()})
    merged = old.join(last.select(*keys), keys, "left_anti").unionByName(last, allowMissingColumns=True)
    return merged, checked.where(F.size("__errors") > 0).select(*new.columns, F.col("__errors").alias("errors"))


def anchor_token(text: Column, context: Column, node: Column) -> Column:
    """The text with a visual node's anchor behind its context, at a placeholder, or at the end."""
    mark = F.concat(F.lit("<<VISUAL_ANCHOR:"), node.cast("string"), F.lit(">>"))
    return F.when(text.contains("{{visual}}"), F.replace(text, F.lit("{{visual}}"), mark)).when(F.length(context) > 0, F.when(text.contains(context), F.replace(text, context, F.concat(context, F.lit(" "), mark))).otherwise(F.concat(text, F.lit("\n"), mark))).otherwise(F.concat(text, F.lit("\n"), mark))


def visual_routing(pages: DataFrame, threshold: int = 3, ratio: float = 0.35, most: int = 12) -> DataFrame:
    """(doc, page, score, visual): pages that look visual, in page order, within the document's budget."""
    score = F.when(F.col("images") > 0, 2).otherwise(0) + F.when(F.col("drawings") > 20, 2).otherwise(0) + F.when(F.col("table_lines") > 10, 1).otherwise(0) + F.when(F.col("chars") < 200, 1).otherwise(0)
    p = pages.withColumn("score", score)
    w = Window.partitionBy("doc")
    budget = F.least(F.lit(most), F.greatest(F.lit(1), F.floor(F.count("*").over(w) * ratio)))
    used = F.sum(F.when(F.col("score") >= threshold, 1).otherwise(0)).over(w.orderBy("page"))
    return p.select("doc", "page", "score", ((F.col("score") >= threshold) & (used <= budget)).alias("visual"))


def blank_line_spans(text: Column) -> Column:
    """Array of (start, end) of the parts between blank lines, empty ones left out."""
    t = F.coalesce(text, F.lit(""))
    gap = r"\n\s*\n"
    gaps = F.transform(F.regexp_extract_all(t, F.lit(gap), F.lit(0)), lambda g: F.length(g))
    parts = F.transform(F.split(t, gap, -1), lambda p: F.length(p))
    none = F.array().cast("array<struct<start:int,end:int>>")
    spans = F.aggregate(
        F.zip_with(parts, gaps, lambda p, g: F.struct(p.alias("p"), F.coalesce(g, F.lit(0)).alias("g"))),
        F.struct(F.lit(0).alias("at"), none.alias("out")),
        lambda acc, x: F.struct((acc["at"] + x["p"] + x["g"]).alias("at"), F.when(x["p"] > 0, F.concat(acc["out"], F.array(F.struct(acc["at"].alias("start"), (acc["at"] + x["p"]).alias("end"))))).otherwise(acc["out"]).alias("out")),
        lambda acc: acc["out"],
    )
    return spans


def section_of_page(toc: DataFrame, pages: DataFrame) -> DataFrame:
    """pages (doc, pos) with the title of the last TOC entry (doc, ord, title, page) that starts on or before them."""
    first = toc.groupBy("doc", "page").agg(F.max_by("title", F.struct("ord", "title")).alias("title"))
    u = first.select("doc", F.col("page").cast("long").alias("at"), F.lit(0).alias("kind"), "title").unionByName(pages.select("doc", F.col("pos").cast("long").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("string").alias("title")))
    w = Window.partitionBy("doc").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return u.withColumn("title", F.last("title", ignorenulls=True).over(w)).where("kind = 1").select("doc", F.col("at").alias("pos"), "title")


# Fixed value: the share of a page's height that its head and its foot take.
MARGIN = 0.08


def cropped_pages(blocks: DataFrame, margin: float = MARGIN) -> DataFrame:
    """(doc, page, text) of text blocks (doc, page, ord, top, bottom, height, text): those that lie in the page's head
    or foot go, the others are joined in order. A page of which nothing stays has an empty text."""
    inside = (F.col("bottom") > F.col("height") * margin) & (F.col("top") < F.col("height") * (1 - margin)) & (F.trim(F.coalesce("text", F.lit(""))) != "")
    line = F.when(inside, F.struct("ord", F.trim("text").alias("text")))
    return blocks.groupBy("doc", "page").agg(F.array_join(F.transform(F.sort_array(F.collect_list(line)), lambda x: x["text"]), "\n").alias("text"))


def page_map(pages: DataFrame, gap: int = 2) -> DataFrame:
    """(doc, page, start, end): where each page (doc, page, text) stands in its document's text, pages joined by a gap."""
    w = Window.partitionBy("doc").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    size = F.length("text")
    start = F.coalesce(F.sum(size + gap).over(w), F.lit(0))
    return pages.select("doc", "page", start.cast("long").alias("start"), (start + size).cast("long").alias("end"))


def page_breadcrumbs(chunks: DataFrame, spans: DataFrame, toc: DataFrame) -> DataFrame:
    """chunks (doc, pos, ...) with their page and the title of the section it stands in: two as-of joins."""
    at = chunks.select("doc", F.col("pos").cast("long").alias("pos")).distinct()
    paged = page_of_offset(spans.select("doc", "page", "start"), at)
    titled = section_of_page(toc, paged.where("page is not null").select("doc", F.col("page").alias("pos")).distinct()).select("doc", F.col("pos").alias("page"), F.col("title").alias("breadcrumb"))
    return chunks.join(paged, ["doc", "pos"], "left").join(titled, ["doc", "page"], "left")
