"""Streaming windows agree with the batch run of the same code."""

from loomline.streaming.windows import sessions, sliding_counts, timed


def test_stream_equals_batch(spark, tmp_path):
    batch = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    batch.repartition(2).write.parquet(str(tmp_path / "in"))
    for k, op in enumerate((sliding_counts, sessions)):
        stream = timed(spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in")))
        q = op(stream).writeStream.outputMode("complete").format("memory").queryName(f"out{k}").trigger(availableNow=True).start()
        q.awaitTermination(120)
        want = op(timed(batch))
        got = spark.table(f"out{k}")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
