"""Streams give what the same rows give as one batch."""

from corpusmill.streaming import updates

SCHEMA = "key string, ts int, value int"


def test_hot_updates(spark, tmp_path):
    source, log = tmp_path / "in", str(tmp_path / "log")
    whole = [("a", 1, 1), ("b", 1, 2), ("a", 3, 3), ("a", 2, 4), ("c", 1, 5), ("b", 1, 6), (None, 1, 7)]
    for k in range(0, len(whole), 3):
        spark.createDataFrame(whole[k : k + 3], SCHEMA).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(SCHEMA).parquet(str(source))
        updates.log_updates(stream, log, str(tmp_path / "ck")).awaitTermination(120)
    expected = [("a", 3, 3), ("b", 1, 6), ("c", 1, 5)]  # of ties the later batch
    assert sorted(map(tuple, updates.current(spark, log, "key", "ts").collect())) == expected
    updates.compact(spark, log, str(tmp_path / "log2"), "key", "ts")
    assert sorted(map(tuple, updates.current(spark, str(tmp_path / "log2"), "key", "ts").collect())) == expected
    got = updates.touches(spark.createDataFrame(whole, SCHEMA), "key", "ts").filter("key = 'a'").first()
    assert tuple(got) == ("a", 3, 3)


def test_session_state(spark, tmp_path):
    schema, source = "conv long, turn int, text string", tmp_path / "turns"
    rows = [(1, 0, "x"), (1, 2, None), (2, 0, "q"), (1, 1, "y"), (1, 3, "w"), (2, 1, "r"), (None, 0, "s")]
    seen = {}

    def keep(batch, _):
        seen.update({r["session"]: tuple(r)[1:] for r in batch.collect()})

    for k in range(0, len(rows), 3):
        spark.createDataFrame(rows[k : k + 3], schema).coalesce(1).write.mode("append").parquet(str(source))
        stream = updates.session_state(spark.readStream.schema(schema).parquet(str(source)), "conv", 2)
        stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination(120)
    assert seen == {"1": (4, [2, 3], ["", "w"]), "2": (2, [0, 1], ["q", "r"])}
