"""Batches, jobs and events: progress, stalls, queues, retries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar import storage

from lodestar.functions.text import worker_stage

# The share of work done at each stage, terminal states, seconds of a stall.
STAGE_WEIGHTS = {"INGEST": 0.15, "PERSIST": 0.35, "VISUAL": 0.55, "RAPTOR": 0.72, "GRAPH": 0.88, "DONE": 1.0, "ERROR": 1.0, "OTHER": 0.25, "QUEUED": 0.05}
SUCCESS, FAILED = ("success", "processed", "completed", "ready"), ("failed", "error", "dead_letter")
STALL_SECONDS, STALE_SECONDS, RETRIES = 180, 900, 3
DOCS_PER_MINUTE = 10


def latest_event(events: DataFrame, key: str = "doc_id") -> DataFrame:
    """Each document's last event by (ts, event_id)."""
    rest = [c for c in events.columns if c != key]
    return events.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct("ts", "event_id")).alias("x")).select(key, "x.*")


def doc_progress(status: Column, stage: Column) -> Column:
    s = F.lower(F.trim(F.coalesce(status, F.lit(""))))
    weights = F.create_map(*(F.lit(x) for kv in STAGE_WEIGHTS.items() for x in kv))
    name = F.upper(F.trim(F.coalesce(stage, F.lit(""))))
    name = F.when(name == "", "OTHER").otherwise(name)
    return F.when(s.isin(*SUCCESS, *FAILED), 1.0).when(s.isin("queued", "pending", "pending_ingestion"), STAGE_WEIGHTS["QUEUED"]).otherwise(F.coalesce(weights[name], F.lit(STAGE_WEIGHTS["OTHER"])))


def batch_progress(batches: DataFrame, docs: DataFrame) -> DataFrame:
    """(batch_id, total, done, failed, progress, status): a batch's files that aren't there yet count as queued."""
    s = F.lower(F.trim("status"))
    g = docs.groupBy("batch_id").agg(F.count("*").alias("n"), F.count_if(s.isin(*SUCCESS)).alias("done"), F.count_if(s.isin(*FAILED)).alias("failed"), F.sum(doc_progress(F.col("status"), F.col("stage"))).alias("work"))
    j = batches.join(g, "batch_id", "left").select("batch_id", F.greatest(F.coalesce("total_files", F.lit(0)), F.coalesce("n", F.lit(0))).alias("total"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("done", F.lit(0)).alias("done"), F.coalesce("failed", F.lit(0)).alias("failed"), F.coalesce("work", F.lit(0.0)).alias("work"))
    progress = F.when(F.col("total") > 0, F.round((F.col("work") + (F.col("total") - F.col("n")) * STAGE_WEIGHTS["QUEUED"]) / F.col("total") * 100, 1)).otherwise(0.0)
    return j.select("batch_id", "total", "done", "failed", progress.alias("progress"), batch_status(F.col("total"), F.col("done"), F.col("failed")).alias("status"))


def batch_status(total: Column, done: Column, failed: Column) -> Column:
    ended = (total > 0) & (done + failed >= total)
    return F.when(ended & (failed == 0), "completed").when(ended & (done == 0), "failed").when(ended, "partial").otherwise("processing")


def stalled(batches: DataFrame, events: DataFrame, now: Column, seconds: int = STALL_SECONDS) -> DataFrame:
    """(batch_id, last_event, stalled): open batches without an event for longer than the limit."""
    last = events.groupBy("batch_id").agg(F.max("ts").alias("last_event"))
    gap = F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(F.coalesce("last_event", "created_at").cast("timestamp"))
    return batches.join(last, "batch_id", "left").select("batch_id", "last_event", (gap > seconds).alias("stalled"))


def stage_counts(events: DataFrame, message: str = "message") -> DataFrame:
    return events.select(worker_stage(F.col(message)).alias("stage")).groupBy("stage").agg(F.count("*").alias("events"))


def dequeue(jobs: DataFrame, per_type: int = 1) -> DataFrame:
    """The oldest pending jobs of each type."""
    w = Window.partitionBy("job_type").orderBy("created_at", "job_id")
    return jobs.where("status = 'pending'").withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= per_type).drop("__r")


def enqueue(candidates: DataFrame, jobs: DataFrame) -> DataFrame:
    """Candidates (job_type, doc_id, ...) once each, without an active job."""
    active = jobs.where("status in ('pending', 'processing')").select("job_type", "doc_id")
    return candidates.dropDuplicates(["job_type", "doc_id"]).join(active, ["job_type", "doc_id"], "left_anti")


def requeue_stale(jobs: DataFrame, now: Column, seconds: int = STALE_SECONDS) -> DataFrame:
    """jobs with those in processing whose heartbeat is too old back in pending."""
    old = (F.col("status") == "processing") & (F.unix_timestamp("updated_at") < F.unix_timestamp(now) - seconds)
    return jobs.withColumn("status", F.when(old, "pending").otherwise(F.col("status")))


def retry_action(retries: Column, limit: int = RETRIES) -> Column:
    return F.when(retries >= limit, "dead_letter").otherwise("retry")


def queue_depth(jobs: DataFrame, now: Column, workers: int = 4, per_minute: int = DOCS_PER_MINUTE, limit: int = 500) -> DataFrame:
    """(job_type, pending, oldest_wait, eta_seconds, accepts) of the queue."""
    wait = F.unix_timestamp(now) - F.unix_timestamp(F.min(F.when(F.col("status") == "pending", F.col("created_at"))))
    pending = F.count_if(F.col("status") == "pending")
    return jobs.groupBy("job_type").agg(pending.alias("pending"), F.coalesce(F.greatest(wait, F.lit(0)), F.lit(0)).alias("oldest_wait")).withColumn("eta_seconds", F.ceil(F.col("pending") / (per_minute * workers) * 60)).withColumn("accepts", F.col("pending") < limit)


#: Rows up to which a percentile's values are held in one buffer, and bins of a refining pass beyond.
HELD, BINS = 1_000_000, 1024


def percentiles(df: DataFrame, value: str, ps: tuple[float, ...] = (0.5, 0.95), by: tuple[str, ...] = ()) -> DataFrame:
    """Nearest-rank percentiles: the value at place ceil(p * n). Beyond HELD rows by refinement, see refined_percentiles."""
    if df.select(F.count(value)).head()[0] > HELD:
        return refined_percentiles(df, value, ps, by)
    aggs = [F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY `{value}`)").alias(f"p{round(p * 100)}") for p in ps]
    return df.groupBy(*by).agg(F.count(value).alias("n"), *aggs)


def refined_percentiles(df: DataFrame, value: str, ps: tuple[float, ...] = (0.5, 0.95), by: tuple[str, ...] = ()) -> DataFrame:
    """percentiles of groups of any size, exactly: passes of counts narrow the range that holds each place.

    A pass counts the values of a range in BINS bins of equal width and keeps the bin that the place falls into, with its own
    least and greatest value; a range of one value ends. So a group costs BINS rows a pass, however many values it has, and
    passes grow with the logarithm of the range over the values' spacing. Null values don't count; groups without others
    have n of 0 and null percentiles.
    """
    keys = [f"__b{k}" for k in range(len(by))]
    v = storage.kept(df.select(*(F.col(c).alias(k) for c, k in zip(by, keys)), F.col(value).cast("double").alias("__v")), "values")
    known = v.groupBy(*keys).agg(F.count("__v").alias("n"), F.min("__v").alias("lo"), F.max("__v").alias("hi"))
    # floats of p * n just above a whole number are that number
    place = lambda p: F.greatest(F.lit(1), F.ceil(F.lit(p) * F.col("n") - 1e-9)).cast("long")
    open_ = storage.kept(known.withColumn("x", F.explode(F.array(*(F.struct(F.lit(k).alias("p"), place(p).alias("place")) for k, p in enumerate(ps))))).select(*keys, "n", "lo", "hi", "x.p", "x.place"), "places")
    done = open_.where("lo IS NULL OR lo = hi")
    open_ = open_.where("lo < hi")
    same = lambda a, b: reduce(lambda x, y: x & y, (a[k].eqNullSafe(b[k]) for k in keys), F.lit(True))
    while not open_.isEmpty():
        o = open_.select(*(F.col(k).alias(k) for k in keys), "n", "lo", "hi", "p", "place").alias("o")
        x = v.alias("v").join(o, same({k: F.col(f"v.{k}") for k in keys}, {k: F.col(f"o.{k}") for k in keys}) & F.col("__v").between(F.col("lo"), F.col("hi")))
        bin_ = F.least(F.floor((F.col("__v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS), F.lit(BINS - 1))
        c = x.select(*(F.col(f"o.{k}").alias(k) for k in keys), "n", "p", "place", bin_.alias("bin"), "__v").groupBy(*keys, "n", "p", "place", "bin").agg(F.count("*").alias("c"), F.min("__v").alias("lo"), F.max("__v").alias("hi"))
        run = F.sum("c").over(Window.partitionBy(*keys, "p").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        hit = c.withColumn("upto", run).where((F.col("upto") >= F.col("place")) & (F.col("upto") - F.col("c") < F.col("place")))
        step = storage.kept(hit.select(*keys, "n", "lo", "hi", "p", (F.col("place") - (F.col("upto") - F.col("c"))).alias("place")), "places")
        done = done.unionByName(step.where("lo = hi"))
        open_ = step.where("lo < hi")
    cols = [F.max(F.when(F.col("p") == k, F.col("lo"))).cast(df.schema[value].dataType).alias(f"p{round(p * 100)}") for k, p in enumerate(ps)]
    return done.groupBy(*keys, "n").agg(*cols).select(*(F.col(k).alias(c) for c, k in zip(by, keys)), "n", *(f"p{round(p * 100)}" for p in ps))


def event_tail(events: DataFrame, size: int, after: tuple[str, int] | None = None) -> DataFrame:
    """The next events behind a cursor (ts, event_id), in order."""
    size = max(1, min(500, size))
    if after is not None:
        events = events.where(F.struct("ts", "event_id") > F.struct(F.lit(after[0]).cast("timestamp_ntz"), F.lit(after[1]).cast("long")))
    return events.orderBy("ts", "event_id").limit(size)


def conversation_window(turns: DataFrame, n: int = 6) -> DataFrame:
    """(conv_id, context): each conversation's last n turns with text, as lines `ROLE: text`."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    t = turns.where(F.trim(F.coalesce("text", F.lit(""))) != "").withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n)
    line = F.concat(F.upper("role"), F.lit(": "), F.trim("text"))
    return t.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"]), "\n").alias("context"))


def visual_accounting(docs: DataFrame, refs: int = 20) -> DataFrame:
    """Sums of visual work by batch, and the first few documents that had any; each batch is cut to them before
    they are gathered."""
    sums = docs.groupBy("batch_id").agg(F.sum("images").alias("images"), F.count_if(F.col("images") > 0).alias("docs_with_images"))
    w = Window.partitionBy("batch_id").orderBy("doc_id")
    few = docs.where("images > 0").select("batch_id", "doc_id").distinct().withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= refs)
    few = few.groupBy("batch_id").agg(F.sort_array(F.collect_list("doc_id")).alias("refs"))
    return sums.join(few, "batch_id", "left").withColumn("refs", F.coalesce("refs", F.array().cast(few.schema["refs"].dataType)))


def hit_ratio(df: DataFrame, hit: Column) -> DataFrame:
    return df.agg(F.round(F.coalesce(F.try_divide(F.count_if(hit).cast("double"), F.count("*").cast("double")), F.lit(0.0)), 4).alias("ratio"))


def dominant_stage(counts: DataFrame) -> DataFrame:
    """The stage of most events of (stage, events); of equal ones the first by name."""
    return counts.agg(F.min_by("stage", F.struct(F.negative("events"), "stage")).alias("stage"), F.sum("events").alias("events"))


def event_page(events: DataFrame, size: int, after: tuple[str, int] | None = None) -> DataFrame:
    """event_tail with has_more, which tells of events behind the page."""
    size = max(1, min(500, size))
    t = event_tail(events, size, after) if size == 500 else event_tail(events, size + 1, after)
    w = Window.orderBy("ts", "event_id")
    t = t.withColumn("__n", F.row_number().over(w))
    return t.withColumn("has_more", F.max("__n").over(Window.partitionBy()) > size).where(F.col("__n") <= size).drop("__n")


def claimed(jobs: DataFrame, worker: str, now: Column, per_type: int = 1) -> DataFrame:
    """jobs with the oldest pending ones of each type taken by a worker: in processing, locked now."""
    took = dequeue(jobs, per_type).select("job_id").withColumn("__took", F.lit(True))
    j = jobs.join(took, "job_id", "left")
    mine = F.coalesce("__took", F.lit(False))
    return j.withColumn("status", F.when(mine, "processing").otherwise(F.col("status"))).withColumn("worker", F.when(mine, F.lit(worker))).withColumn("updated_at", F.when(mine, now).otherwise(F.col("updated_at"))).drop("__took")


def startable(jobs: DataFrame, per_tenant: int) -> DataFrame:
    """Pending jobs that a tenant's free slots admit, oldest first; a document with a job in processing waits, and of
    several of one document the oldest goes."""
    busy = jobs.where("status = 'processing'")
    used = busy.groupBy("tenant_id").agg(F.count("*").alias("used"))
    open_ = jobs.where("status = 'pending'").join(busy.select("doc_id").distinct(), "doc_id", "left_anti")
    first = open_.withColumn("__d", F.row_number().over(Window.partitionBy("doc_id").orderBy("created_at", "job_id"))).where("__d = 1").drop("__d")
    turn = F.row_number().over(Window.partitionBy("tenant_id").orderBy("created_at", "job_id"))
    return first.withColumn("turn", turn).join(used, "tenant_id", "left").where(F.col("turn") + F.coalesce("used", F.lit(0)) <= per_tenant).drop("turn", "used")


def due_tenants(tenants: DataFrame, jobs: DataFrame, job_type: str, now: Column, seconds: int) -> DataFrame:
    """Tenants whose last job of a type is older than the interval (or was never), and that have none active."""
    j = jobs.where(F.col("job_type") == job_type).groupBy("tenant_id").agg(F.max("created_at").alias("last"), F.count_if(F.col("status").isin("pending", "processing")).alias("active"))
    old = F.col("last").isNull() | (F.unix_timestamp(now) - F.unix_timestamp("last") >= seconds)
    return tenants.select("tenant_id").distinct().join(j, "tenant_id", "left").where(old & (F.coalesce("active", F.lit(0)) == 0)).select("tenant_id")
