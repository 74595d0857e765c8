from pyspark.sql import functions as F

from lodestar.streaming import jobs


def source(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/events.parquet")
    e.repartition(3).write.parquet(str(tmp_path / "in"))
    return e, jobs.event_stream(spark, str(tmp_path / "in"), e.schema)


def test_windowed_counts_match_batch(spark, sf, tmp_path):
    e, s = source(spark, sf, tmp_path)
    jobs.run_once(jobs.windowed_counts(s, late="1000 days"), str(tmp_path / "out"), str(tmp_path / "cp"))
    q = jobs.windowed_counts(s, late="1000 days").writeStream.format("memory").queryName("wc").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("wc").agg(F.sum("events")).head()[0] == e.count()


def test_idempotency_and_states(spark, sf, tmp_path):
    e, s = source(spark, sf, tmp_path)
    q = jobs.once(s, ["event_id"], "1000 days").writeStream.format("memory").queryName("once").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("once").count() == e.count()
    q = jobs.job_states(s).writeStream.format("memory").queryName("states").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.table("states").where("status <> 'stale'")
    assert got.count() > 0 and got.agg(F.max("events")).head()[0] <= e.groupBy("user_id").count().agg(F.max("count")).head()[0]
