from pyspark.sql import functions as F

from sitewise.plans.queries import QUERIES
from sitewise.streaming import events


def test_stream_matches_batch(spark, sf_dir, tmp_path):
    table = spark.read.parquet(f"{sf_dir}/events.parquet")
    table.coalesce(1).write.parquet(str(tmp_path / "in"))
    got = events.tumbling(events.read_stream(spark, str(tmp_path / "in"), table.schema))
    q = got.writeStream.outputMode("complete").format("memory").queryName("tumbling").start()
    q.processAllAvailable()
    q.stop()
    rows = {(r.window_start, r.event_type, r.n) for r in spark.table("tumbling").collect()}
    want = QUERIES["events_tumbling"](spark, sf_dir).withColumn("window_start", F.col("window_start").cast("timestamp"))
    assert rows == {(r.window_start, r.event_type, r.n) for r in want.collect()}


def test_sessions(spark, sf_dir, tmp_path):
    table = spark.read.parquet(f"{sf_dir}/events.parquet")
    table.coalesce(1).write.parquet(str(tmp_path / "in"))
    got = events.sessions(events.read_stream(spark, str(tmp_path / "in"), table.schema))
    q = got.writeStream.outputMode("append").format("memory").queryName("sessions").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("sessions").agg(F.sum("n")).first()[0] <= table.count()
