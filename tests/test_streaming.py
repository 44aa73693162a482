from pyspark.sql import functions as F

from statloom.streaming.stats import windowed


def test_a_stream_gives_what_the_table_gives(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("other", F.col("value") * 2 + F.col("user_id") % 5)
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = windowed(stream, "ts", "6 hours", "value", "other", late="3650 days").writeStream.format("memory").queryName("w").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    want = {r["start"]: r for r in windowed(events, "ts", "6 hours", "value", "other").collect()}
    got = spark.table("w").collect()
    assert len(got) == len(want)
    for r in got:
        assert r["n"] == want[r["start"]]["n"] and abs(r["mean"] - want[r["start"]]["mean"]) < 1e-9
        assert r["slope"] is None or abs(r["slope"] - want[r["start"]]["slope"]) < 1e-6
