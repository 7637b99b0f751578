"""Streams give what the batch operators give."""

from pyspark.sql import functions as F

from seqengine.streaming import running


def finish(query):
    query.processAllAvailable()
    query.stop()


def source(spark, path, rows, schema):
    """A stream that reads one file a batch, in order of name."""
    for k, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{path}/b={k}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/b=*")


def test_running_best_over_batches(spark, tmp_path):
    rows = [[("r", 0, 0.5), ("r", 1, 0.4)], [("r", 2, 0.4), ("r", 3, 0.3), ("s", 0, 9.0)]]
    stream = source(spark, str(tmp_path / "in"), rows, "run string, epoch int, loss double")
    finish(running.running_best(stream, "run", "epoch", "loss").writeStream.format("memory").queryName("best").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").start())
    got = {(r["run"], r["epoch"]): r["is_best"] for r in spark.sql("SELECT * FROM best").collect()}
    assert got == {("r", 0): True, ("r", 1): True, ("r", 2): False, ("r", 3): True, ("s", 0): True}


def test_collapse_over_batches(spark, tmp_path):
    rows = [[("a", 0, "x"), ("a", 1, "x")], [("a", 2, "x"), ("a", 3, "y"), ("b", 0, "y")]]
    stream = source(spark, str(tmp_path / "in"), rows, "id string, t int, token string")
    finish(running.collapse(stream, "id", "t", "token").writeStream.format("memory").queryName("frames").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").start())
    assert sorted(map(tuple, spark.sql("SELECT * FROM frames").collect())) == [("a", 0, "x"), ("a", 3, "y"), ("b", 0, "y")]


def test_windows_and_resumable_batches(spark, tmp_path):
    rows = [[("2024-01-01 00:00:01", "a", 1.0), ("2024-01-01 00:00:30", "a", 3.0)], [("2024-01-01 01:00:00", "a", 5.0)]]
    typed = lambda s: s.withColumn("ts", F.to_timestamp("ts"))
    stream = typed(source(spark, str(tmp_path / "in"), rows, "ts string, k string, v double"))
    out = running.windowed_mean(stream, "ts", "v", "k", "1 minute", "1 minute")
    finish(out.writeStream.format("memory").queryName("means").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").start())
    assert [(r["n"], r["mean"]) for r in spark.sql("SELECT * FROM means").collect()] == [(2, 2.0)]
    seen = []
    for _ in range(2):  # the second start finds nothing new
        query = running.each_batch(stream, lambda df, n: seen.append(df.count()), str(tmp_path / "d"))
        query.awaitTermination()
    assert sum(seen) == 3


def test_every(spark):
    assert [r[0] for r in running.every(spark.range(7), "id", 3).collect()] == [0, 3, 6]
