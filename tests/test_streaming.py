from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lectern.streaming import watching

T0 = datetime(2024, 1, 1)
SEEN = [("a", 1, 0, 0), ("a", 1, 0, 1), ("a", 1, 0, 3), ("a", 1, 0, 4), ("b", 1, 0, 0), ("b", 2, 0, 3), ("b", 2, 0, 4), ("c", 5, 0, 0), ("c", 5, 0, 2)]


def frame(spark):
    made = [(p, s, T0 + timedelta(seconds=c), T0 + timedelta(seconds=o)) for p, s, c, o in SEEN]
    return spark.createDataFrame(made, watching.OBSERVED)


def streamed(spark, tmp_path, build, name):
    for k, batch in enumerate((F.col("observed_at") < T0 + timedelta(seconds=3), F.col("observed_at") >= T0 + timedelta(seconds=3))):
        frame(spark).where(batch).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}/{k}")
    source = spark.readStream.schema(watching.OBSERVED).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}/*")
    query = build(source).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name).collect()


def test_stability_stream(spark, tmp_path):
    got = streamed(spark, tmp_path, watching.stable, "stability")
    assert sorted(r.path for r in got) == ["a", "c"]


def test_stability_batch(spark):
    assert sorted(r.path for r in watching.stable_in_batch(frame(spark)).collect()) == ["a", "c"]


def test_once(spark, tmp_path):
    got = streamed(spark, tmp_path, watching.once, "once_each")
    assert len(got) == len({(p, s, c) for p, s, c, _ in SEEN})


def test_batches_and_sets(spark):
    made = spark.createDataFrame([("g", T0 + timedelta(seconds=s), i) for i, s in enumerate([0, 1, 2, 3, 4, 5, 50, 90])], "g string, ts timestamp, id int")
    got = watching.batches_by_count_or_time(made, "g", "ts", 5, 30).orderBy("id").collect()
    assert [r.batch for r in got] == [1, 1, 1, 1, 1, 2, 3, 4]
    some = frame(spark).select("path").distinct()
    assert {r.path for r in watching.vanished(some, some.where("path <> 'a'")).collect()} == {"a"}
    assert {r.path for r in watching.not_in_baseline(frame(spark), some.where("path = 'b'")).collect()} == {"a", "c"}


def test_batches_keep_groups_and_times_that_are_null(spark):
    made = [(None, T0, 0), (None, T0 + timedelta(seconds=30), 1), ("g", None, 2), ("g", T0, 3), ("g", T0 + timedelta(seconds=29), 4), ("h", T0, 5), ("h", T0 + timedelta(seconds=31), 6), ("h", T0 + timedelta(seconds=32), 7)]
    got = watching.batches_by_count_or_time(spark.createDataFrame(made, "g string, ts timestamp, id int"), "g", "ts", 5, 30, "id").collect()
    assert sorted((r.id, r.batch) for r in got) == [(0, 1), (1, 2), (2, 1), (3, 1), (4, 1), (5, 1), (6, 2), (7, 2)]


def test_many_groups_are_batched_in_one_pass(spark):
    made = spark.range(60_000).select((F.col("id") % 20_000).alias("g"), F.timestamp_seconds(F.col("id")).alias("ts"), "id")
    plan = watching.batches_by_count_or_time(made, "g", "ts", 5, 30, "id")
    assert plan.groupBy("batch").count().orderBy("batch").collect() == [(1, 20_000), (2, 20_000), (3, 20_000)]
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in text and text.count("Exchange") == 1
