from pyspark.sql import functions as F

from entspark import streaming as S


def test_refresh_by_micro_batch(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "path string, content string, ts timestamp"
    put = lambda rows: spark.createDataFrame(rows, "path string, content string, s int").select("path", "content", F.timestamp_seconds("s").alias("ts")).coalesce(1).write.mode("append").parquet(source)
    put([("a.py", "def f():\n    pass\n", 1), ("b.json", '{"k": 1}', 1)])
    run = lambda: S.refresh_entities(spark.readStream.schema(schema).parquet(source), out, str(tmp_path / "cp")).awaitTermination()
    run()
    names = lambda: sorted(r.name for r in spark.read.parquet(S.current_version(spark, out)).collect())
    assert names() == ["f", "k"]
    put([("a.py", "def g():\n    pass\n", 3), ("a.py", "def h():\n    pass\n", 2), ("b.json", None, 4)])
    run()
    assert names() == ["g"]


def test_windows_on_a_stream(spark, tmp_path):
    source = str(tmp_path / "ev")
    spark.createDataFrame([("a", 0), ("a", 30), ("b", 3_600), ("a", 90_000)], "k string, s int").select("k", F.timestamp_seconds("s").alias("ts")).coalesce(1).write.parquet(source)
    q = S.to_memory(S.windowed_hotspots(spark.readStream.schema("k string, ts timestamp").parquet(source), ["k"], "1 hour"), "windows")
    q.processAllAvailable()
    q.stop()
    assert sorted((r.k, r.change_count) for r in spark.table("windows").collect()) == [("a", 2), ("b", 1)]
