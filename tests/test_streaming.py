from pyspark.sql import functions as F

from reelframe.streaming import sessions


def test_sessions_in_batch_and_stream_agree(spark, tmp_path):
    rows = spark.createDataFrame([("u", 0), ("u", 3600), ("u", 40000), ("v", 5), ("u", 200000), ("v", 200000)], "k string, s long").select("k", F.timestamp_seconds("s").alias("ts"))
    batch = {tuple(r) for r in sessions.pause_sessions(rows, "k", "ts").collect()}
    assert {(r[0], r[3]) for r in batch if r[0] == "u"} == {("u", 2), ("u", 1)} and len(batch) == 5
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = sessions.pause_sessions(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "k", "ts")
    q = stream.writeStream.format("memory").queryName("sess").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    done = {tuple(r) for r in spark.sql("select * from sess").collect()}
    assert done == {r for r in batch if r[1].day == 1}  # what the watermark has passed


def test_spacing_keeps_its_state_until_the_watermark_passes(spark, tmp_path):
    src, day = tmp_path / "in", 86_400_000
    schema, base = "k string, t long", 1_700_000_000_000
    batch = lambda *rows: spark.createDataFrame([(k, base + t) for k, t in rows], schema).coalesce(1).write.mode("append").parquet(str(src))
    batch(("a", 0), ("a", 4), ("a", 12), ("b", 1))
    stream = sessions.spaced(spark.readStream.schema(schema).parquet(str(src)), "k", "t", 10)
    q = stream.writeStream.format("memory").queryName("spaced").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        for more in ([("a", 15), ("a", 22)], [("c", day)], [("c", day + 4), ("c", day + 11)]):
            q.processAllAvailable()
            batch(*more)
        q.processAllAvailable()
        state = q.lastProgress["stateOperators"][0]["numRowsTotal"]
    finally:
        q.stop()
    got = sorted((r.k, r.t - base) for r in spark.sql("select * from spaced").collect())
    assert got == [("a", 0), ("a", 12), ("a", 22), ("b", 1), ("c", day), ("c", day + 11)] and state == 1
