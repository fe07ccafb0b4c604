"""The progress state by itself and in a stream that arrives in two batches."""

from cuelattice.streaming import tasks


def test_advance():
    assert tasks.advance(None, [("running", 30), ("running", 10), ("completed", 60), ("running", 5)]) == ("completed", 100.0, 3)
    assert tasks.advance(("failed", 20.0, 4), [("running", 90)]) == ("failed", 20.0, 4)


def test_progress_stream(spark, tmp_path):
    schema = "task_id string, seq long, status string, progress double"
    source = str(tmp_path / "in")
    spark.createDataFrame([("a", 1, "running", 30.0), ("b", 2, "running", 10.0), ("a", 3, "running", 20.0)], schema).coalesce(1).write.mode("append").parquet(source)
    stream = tasks.progress(spark.readStream.schema(schema).parquet(source))
    query = stream.writeStream.outputMode("update").format("memory").queryName("progress_test").option("checkpointLocation", str(tmp_path / "state")).start()
    query.processAllAvailable()
    spark.createDataFrame([("a", 4, "completed", 1.0), ("a", 5, "running", 2.0), ("b", 6, "failed", 5.0)], schema).coalesce(1).write.mode("append").parquet(source)
    query.processAllAvailable()
    query.stop()
    rows = {(r.task_id, r.revision): (r.status, r.progress) for r in spark.table("progress_test").collect()}
    assert rows == {("a", 2): ("running", 30.0), ("b", 1): ("running", 10.0), ("a", 3): ("completed", 100.0), ("b", 2): ("failed", 10.0)}
