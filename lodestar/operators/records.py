"""Record keeping: collections, batches, tenants, traces, caches, attempts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def delete_collection(chunks: DataFrame, collection) -> tuple[DataFrame, DataFrame]:
    """(chunks that stay, counts of what went)."""
    gone = F.col("collection_id").eqNullSafe(F.lit(collection))
    return chunks.where(~gone), chunks.agg(F.count_if(gone).alias("deleted_chunks"), F.count_distinct(F.when(gone, F.col("source_id"))).alias("deleted_documents"))


def add_files(batch_files: DataFrame, incoming: DataFrame, limit: int) -> DataFrame:
    """Files (batch_id, filename) that a batch takes: known names are passed over, no more than its limit."""
    from pyspark.sql.window import Window

    new = incoming.dropDuplicates(["batch_id", "filename"]).join(batch_files.select("batch_id", "filename"), ["batch_id", "filename"], "left_anti")
    held = batch_files.groupBy("batch_id").agg(F.count("*").alias("held"))
    r = new.withColumn("turn", F.row_number().over(Window.partitionBy("batch_id").orderBy("filename"))).join(held, "batch_id", "left")
    return r.where(F.col("turn") + F.coalesce("held", F.lit(0)) <= limit).select("batch_id", "filename")


def tenants(df: DataFrame, column: str = "tenant_id", limit: int = 1000) -> DataFrame:
    return df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column).limit(max(1, min(1000, limit)))


def traces_citing(traces: DataFrame, node) -> DataFrame:
    """(trace_id, excerpts) of traces whose citations (node_id, excerpt) name a node."""
    hit = F.filter("citations", lambda c: c["node_id"] == F.lit(node))
    return traces.withColumn("__hit", hit).where(F.size("__hit") > 0).select("trace_id", F.array_join(F.transform("__hit", lambda c: c["excerpt"]), " | ").alias("excerpts"))


def golden_traces(traces: DataFrame, now: Column, days: int, limit: int, least: int = 4) -> DataFrame:
    """Well rated recent traces, newest first."""
    return traces.where((F.col("feedback") >= least) & (F.col("created_at") >= now - F.make_dt_interval(F.lit(days)))).orderBy(F.desc("created_at"), "trace_id").limit(limit)


def retrieval_trace(hits: DataFrame, query: str, chars: int = 100, most: int = 100) -> DataFrame:
    """One audit row: ids and scores of the best hits in order, and snippets."""
    rows = F.sort_array(F.collect_list(F.struct(F.negative("score").alias("s"), "id", F.left("content", F.lit(chars)).alias("snippet"))))
    return hits.orderBy(F.desc("score"), "id").limit(most).agg(rows.alias("r")).select(F.lit(query).alias("query"), F.transform("r", lambda x: x["id"]).alias("ids"), F.transform("r", lambda x: F.negative(x["s"])).alias("scores"), F.transform("r", lambda x: x["snippet"]).alias("snippets"))


def cached(requests: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """Requests with what a cache has for their key; hit tells."""
    return requests.join(cache.dropDuplicates(keys).withColumn("__hit", F.lit(True)), keys, "left").withColumn("hit", F.coalesce("__hit", F.lit(False))).drop("__hit")


def budget_left(usage: DataFrame, day: Column, limit: int) -> DataFrame:
    """(tenant_id, used, allowed) of a day's calls."""
    return usage.where(F.to_date("ts") == day).groupBy("tenant_id").agg(F.count("*").alias("used")).withColumn("allowed", F.col("used") < limit)


def visual_tasks(tasks: DataFrame, least: int) -> DataFrame:
    """Image tasks (image_hash, kind, size, page) without small images, each (hash, kind) once, on its first page."""
    return tasks.where(F.col("size") >= least).groupBy("image_hash", "kind").agg(F.min("page").alias("page"))


def illegal_transitions(before: DataFrame, after: DataFrame, key: str, frozen: tuple[str, ...]) -> DataFrame:
    """Rows of ended records whose frozen columns changed: what an immutability guard refuses."""
    a = after.select(F.col(key), *(F.col(c).alias(f"__new_{c}") for c in frozen))
    changed = [~F.col(c).eqNullSafe(F.col(f"__new_{c}")) for c in frozen]
    any_changed = changed[0]
    for c in changed[1:]:
        any_changed = any_changed | c
    return before.where("status in ('completed', 'F')").join(a, key).where(any_changed).select(key)


def insert_at(array: Column, position: Column, value: Column) -> Column:
    """An element inserted at a place from 0, failing out of bounds."""
    ok = (position >= 0) & (position <= F.size(array))
    return F.when(ok, F.array_insert(array, position + 1, value)).otherwise(F.raise_error(F.lit("OUT_OF_BOUNDS")))


def query_entities(text: Column, most: int = 8) -> Column:
    """Capitalised phrases of a question, or its first 80 characters."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b[A-ZÁÉÍÓÚÑ][\p{L}]+(?: [A-ZÁÉÍÓÚÑ][\p{L}]+)*"), F.lit(0)))
    return F.when(F.size(found) > 0, F.slice(found, 1, most)).otherwise(F.array(F.left(text, F.lit(80))))


def prompt_context(hits: DataFrame, summary: Column) -> DataFrame:
    """The best hit's content behind the global summary."""
    return hits.agg(F.max_by("content", F.struct("similarity", F.negative("id"))).alias("best")).select(F.concat_ws("\n\n", summary, F.col("best")).alias("context"))


def markdown_rows(table: Column) -> Column:
    """The cells of a markdown table's rows, separators left out."""
    lines = F.filter(F.transform(F.split(table, "\n"), lambda x: F.trim(x)), lambda x: x.startswith("|") & ~x.rlike(r"^[|\s:\-]+$"))
    return F.transform(lines, lambda x: F.transform(F.split(F.regexp_replace(x, r"^\||\|$", ""), r"\|", -1), lambda c: F.trim(c)))


def context_recall(retrieved: Column, expected: Column) -> Column:
    """The share of expected ids retrieved, 1 if none is expected."""
    return F.when(F.size(expected) == 0, 1.0).otherwise(F.size(F.array_intersect(F.array_distinct(retrieved), expected)) / F.size(F.array_distinct(expected)))


def faithfulness(answer: Column, context: Column) -> Column:
    """The share of an answer's longer words that its context holds."""
    from lodestar.functions.text import tokens

    long_words = lambda c: F.array_distinct(F.filter(tokens(c), lambda w: F.length(w) > 3))
    a = long_words(answer)
    return F.when(F.size(a) == 0, 0.0).otherwise(F.size(F.array_intersect(a, long_words(context))) / F.size(a))


def fresh_cache(cache: DataFrame, keys: list[str], now: Column, ttl_seconds: int, capacity: int) -> DataFrame:
    """What a cache (keys..., used_at) keeps: entries young enough, each key's latest, the most recently used up to its capacity."""
    young = cache.where(F.unix_timestamp(now) - F.unix_timestamp("used_at") <= ttl_seconds)
    rest = [c for c in cache.columns if c not in (*keys, "used_at")]
    last = young.groupBy(*keys).agg(F.max("used_at").alias("used_at"), *(F.max_by(c, "used_at").alias(c) for c in rest))
    return last.orderBy(F.desc("used_at"), *keys).limit(capacity)


def retried(docs: DataFrame, doc_ids) -> DataFrame:
    """docs with the given ones back in the queue and their retry count one higher."""
    again = F.col("doc_id").isin(list(doc_ids))
    return docs.withColumn("retry_count", F.when(again, F.coalesce("retry_count", F.lit(0)) + 1).otherwise(F.col("retry_count"))).withColumn("status", F.when(again, "queued").otherwise(F.col("status")))


def active_attempt(attempts: DataFrame, assignments: DataFrame, exam, learner) -> DataFrame:
    """The learner's attempt at an exam in progress, if the exam is assigned to them."""
    mine = attempts.where((F.col("exam_id") == F.lit(exam)) & (F.col("learner_id") == F.lit(learner)) & (F.col("status") == "IN_PROGRESS"))
    return mine.join(assignments.select("exam_id", F.col("student_id").alias("learner_id")).distinct(), ["exam_id", "learner_id"], "left_semi").orderBy("attempt_id").limit(1)


def with_attempts(attempts: DataFrame, requests: DataFrame, assignments: DataFrame) -> DataFrame:
    """attempts with one more for each request (attempt_id, exam_id, learner_id): only where the exam is assigned
    and no attempt is in progress; of several requests for one, that of smallest attempt_id."""
    allowed = requests.join(assignments.select("exam_id", F.col("student_id").alias("learner_id")).distinct(), ["exam_id", "learner_id"], "left_semi")
    idle = allowed.join(attempts.where("status = 'IN_PROGRESS'").select("exam_id", "learner_id"), ["exam_id", "learner_id"], "left_anti")
    new = idle.groupBy("exam_id", "learner_id").agg(F.min("attempt_id").alias("attempt_id")).withColumn("status", F.lit("IN_PROGRESS"))
    return attempts.unionByName(new, allowMissingColumns=True)


def sealed_batches(batches: DataFrame, files: DataFrame) -> DataFrame:
    """batches (batch_id, total_files, auto_seal, sealed) with those sealed that have all their files."""
    n = files.select("batch_id", "filename").distinct().groupBy("batch_id").agg(F.count("*").alias("__n"))
    full = F.col("auto_seal") & (F.col("total_files") > 0) & (F.coalesce("__n", F.lit(0)) >= F.col("total_files"))
    return batches.join(n, "batch_id", "left").withColumn("sealed", F.coalesce("sealed", F.lit(False)) | full).drop("__n")
