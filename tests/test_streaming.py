from pyspark.sql import functions as F

from plankton.streaming import events as ev

SF = "/root/testdata/sf0.001"


def test_stream_agrees_with_the_stored_table(spark, tmp_path):
    stored = spark.read.parquet(f"{SF}/events.parquet")
    for i in range(3):
        stored.where(f"event_id % 3 = {i}").coalesce(1).write.parquet(f"{tmp_path}/w{i}")
    import glob
    import os
    import shutil

    os.makedirs(f"{tmp_path}/in")
    for i, p in enumerate(sorted(glob.glob(f"{tmp_path}/w*/part-*.parquet"))):
        shutil.copy(p, f"{tmp_path}/in/events{i}.parquet")
    stream = ev.windowed(ev.read_events(spark, f"{tmp_path}/in", stored.schema), n=F.count(F.lit(1)))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("plankton_hours").start()
    q.processAllAvailable()
    q.stop()
    want = sorted(map(tuple, ev.windowed(stored, n=F.count(F.lit(1))).collect()))
    assert sorted(map(tuple, spark.table("plankton_hours").collect())) == want
