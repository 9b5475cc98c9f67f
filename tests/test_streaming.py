"""Streams against the batch operators."""

import pytest
from pyspark.sql import functions as F

from eventloom.operators import assembly as batch
from eventloom.sources import synth
from eventloom.streaming import assembly, slices

KEY = ["trigger_number"]


def _stream(spark, df, path):
    df.coalesce(1).write.parquet(str(path))
    return spark.readStream.schema(df.schema).parquet(str(path))


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def _tables(spark):
    asked = spark.createDataFrame([(k, s, 1_000_000) for k in (1, 2, 3, 4) for s in (1, 65)], "trigger_number long, source_id long, created long")
    data = [(1, 1, 500_000), (1, 65, 2_000_000), (1, 65, 9_000_000), (2, 1, 1_500_000), (2, 1, 4_000_000), (2, 1, 5_000_000), (2, 65, 6_500_000), (3, 65, 20_000_000), (4, 2, 1_200_000)]
    return asked, spark.createDataFrame(data, "trigger_number long, source_id long, arrival long")


def test_sources_of_any_number_count(spark):
    asked, came = _tables(spark)
    got = assembly.updates(assembly.events(asked, came.where("trigger_number = 2 and source_id = 1"), KEY), KEY).where("trigger_number = 2")
    assert rows(got) == [(2, 2, 1, 1, "incomplete")]


@pytest.mark.parametrize("batches", [1, 3, 5])
@pytest.mark.parametrize("timeout", [0, 5_000_000])
def test_records_end_as_in_the_batch_however_many_micro_batches_there_are(spark, batches, timeout):
    asked, came = _tables(spark)
    want = batch.assemble_in_time(asked, came, timeout, KEY)
    got = assembly.replay_in_time(asked, came, timeout, KEY, batches)
    assert rows(got) == rows(want.select(*got.columns))


def test_a_record_that_keeps_getting_fragments_times_out(spark):
    asked, came = _tables(spark)
    one = assembly.timed_events(asked.where("trigger_number = 2"), came.where("trigger_number = 2"), KEY)
    end = assembly.timed_events(asked.limit(0), spark.createDataFrame([(9, 1, 60_000_000)], came.schema), KEY)
    stream = assembly.in_order(one.unionByName(end), "at", 6).withColumn("time", F.timestamp_micros("at")).withWatermark("time", "0 seconds")
    got = assembly.run_now(assembly.emitted(stream, 5_000_000, KEY)).drop("batch")
    assert rows(got.where("status <> 'late'")) == [(2, 2, 1, 1, 0, True, "incomplete")]
    assert [r.late for r in got.where("status = 'late'").collect()] == [1]


def test_an_ended_record_is_forgotten_after_a_while(spark):
    asked = spark.createDataFrame([(1, 1, 1_000_000)], "trigger_number long, source_id long, created long")
    came = spark.createDataFrame([(1, 1, 2_000_000), (1, 1, 3_000_000), (9, 1, 50_000_000), (1, 1, 60_000_000), (9, 1, 70_000_000)], "trigger_number long, source_id long, arrival long")
    stream = assembly.in_order(assembly.timed_events(asked, came, KEY), "at", 6).withColumn("time", F.timestamp_micros("at")).withWatermark("time", "0 seconds")
    got = assembly.run_now(assembly.emitted(stream, 0, KEY, remember=10_000_000)).drop("batch")
    assert sorted((r.status, r.late) for r in got.collect()) == [("complete", 0), ("late", 1)]


def test_records_share_keyed_states_and_end_as_in_the_batch(spark, monkeypatch):
    """Python is called for a bucket of records, not for each; a micro-batch is several files."""
    monkeypatch.setattr(assembly, "FILE_ROWS", 200, raising=False)
    n = spark.range(600)
    big = F.lit(1 << 60)
    key = F.when(F.col("id") % 200 == 7, None).otherwise(big + F.col("id") % 200).alias("trigger_number")
    created = 1_000_000 + (F.col("id") % 200) * 10_000
    asked = n.select(key, (F.col("id") % 3).alias("source_id"), created.alias("created"))
    came = n.select(key, (F.col("id") % 4).alias("source_id"), (created + F.pmod(F.xxhash64("id"), F.lit(3_000_000))).alias("arrival")).where("trigger_number is not null")
    stream = assembly.in_order(assembly.timed_events(asked, came, KEY), "at", 3).withColumn("time", F.timestamp_micros("at")).withWatermark("time", "0 seconds")
    got = assembly.run_now(assembly.emitted(stream, 1_500_000, KEY, buckets=5))
    assert got.select("batch").distinct().count() >= 3
    whole = got.where("status <> 'late'")
    want = batch.assemble_in_time(asked.where("trigger_number is not null"), came, 1_500_000, KEY)
    held = {r.trigger_number: r for r in want.collect()}
    ended = [r for r in whole.collect() if r.trigger_number is not None]
    assert len(ended) == len({r.trigger_number for r in ended}) > 100
    assert all((r.received, r.timed_out, r.status) == (held[r.trigger_number].received, held[r.trigger_number].timed_out, held[r.trigger_number].status) for r in ended)
    late = got.where("status = 'late'").groupBy("trigger_number").agg(F.sum("late").alias("n")).collect()
    assert late and all(r.n == held[r.trigger_number].late for r in late)


def test_what_comes_at_the_time_of_the_end_is_not_late(spark):
    asked = spark.createDataFrame([(1, 1, 2_000_000)], "trigger_number long, source_id long, created long")
    came = spark.createDataFrame([(1, 1, 1_000_000), (1, 1, 2_000_000), (1, 1, 3_000_000)], "trigger_number long, source_id long, arrival long")
    want = batch.assemble_in_time(asked, came, 5_000_000, KEY)
    got = assembly.replay_in_time(asked, came, 5_000_000, KEY, 1)
    assert rows(got) == rows(want.select(*got.columns)) and got.first().late == 1


def test_by_the_wall_clock(spark, tmp_path):
    asked, came = _tables(spark)
    run = assembly.emitted(_stream(spark, assembly.timed_events(asked, came, KEY), tmp_path / "in"), 3_600_000_000, KEY, clock="processing")
    # with the wall clock's timers there is always another batch, so only one is run
    run.writeStream.format("memory").queryName("walled").outputMode("append").trigger(once=True).option("checkpointLocation", str(tmp_path / "c")).start().awaitTermination(120)
    got = spark.table("walled")
    assert rows(got.where("status <> 'late'").select("trigger_number", "status")) == [(1, "complete"), (2, "complete")]
    with pytest.raises(ValueError):
        assembly.emitted(run, 0, clock="sun")


def test_the_rest_is_flushed(spark):
    asked, came = _tables(spark)
    done = assembly.updates(assembly.events(asked, came, KEY), KEY).where("trigger_number = 1")
    whole = assembly.flushed(assembly.events(asked, came, KEY), done, KEY)
    assert rows(whole.select("trigger_number", "status")) == [(1, "complete"), (2, "complete"), (3, "incomplete"), (4, "empty")]


def test_late_slices_are_not_written_twice(spark, tmp_path):
    path = str(tmp_path / "store")
    df = spark.createDataFrame([(1, 1, 8), (1, 1, 7), (1, 2, 9)], "run long, slice long, n long")
    assert slices.write_once(df, path, ["run", "slice"], 0) == 1
    assert slices.write_once(df, path, ["run", "slice"], 0) == 1  # the same batch again
    assert slices.write_once(df, path, ["run", "slice"], 1) == 3
    assert rows(spark.read.parquet(path).select("run", "slice", "n")) == [(1, 1, 7), (1, 2, 9)]


@pytest.mark.parametrize("batches", [1, 4])
def test_quiet_slices_close_and_the_rest_is_flushed(spark, batches):
    from eventloom.operators.slices import quiet_slices

    times = [0, 1, 2, 30, 31, 32, 33, 95, 96, 5, 6]
    df = spark.createDataFrame([(k % 2, t * 1_000_000, 1_000_000 + k * 1_500_000) for k, t in enumerate(times)], "run_number long, time_start long, arrival long")
    got = slices.replay_quiet(df, 60_000_000, 2_000_000, batches)
    assert rows(got) == rows(quiet_slices(df, 60_000_000, 2_000_000).drop("closing"))


def test_cooled_slices_close(spark, tmp_path):
    times = ["2024-01-01 00:00:01", "2024-01-01 00:00:02", "2024-01-01 00:05:00"]
    df = spark.createDataFrame([(t, 1) for t in times], "t string, origin long").select(F.to_timestamp("t").alias("time"), "origin")
    run = slices.closed(_stream(spark, df, tmp_path / "in"), 10_000_000, 60).writeStream.format("memory").queryName("closed").outputMode("append").trigger(availableNow=True)
    run.option("checkpointLocation", str(tmp_path / "c")).start().awaitTermination()
    assert [r.n_tps for r in spark.table("closed").collect()] == [2]


def test_time_syncs_have_a_clock(spark):
    df = synth.time_syncs(spark)
    assert df.isStreaming and df.columns == ["sequence_number", "daq_time", "system_time", "run_number"]
