"""Small cases for each rule and oddity of the core operators."""

import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from eventloom.functions import scalars
from eventloom.functions.ranking import grouped_rank, running
from eventloom.operators import assembly, balance, checks, decisions, metrics, sink, slices
from eventloom.sources import scratch, store, synth
from eventloom.sources.tables import RunConfig


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


# decisions


def test_a_window_that_ends_on_a_bound_is_in_both_slices(spark):
    asked = spark.createDataFrame([(1, 7, 1, 0, 100), (1, 7, 2, 0, 250)], "trigger_number long, run_number long, source_id long, window_begin long, window_end long")
    cut = decisions.slices(decisions.extents(asked), 100)
    assert rows(cut.select("sequence_number", "slice_begin", "slice_end")) == [(0, 0, 100), (1, 100, 200), (2, 200, 250)]
    got = decisions.data_requests(cut, asked).where("source_id = 1").select("sequence_number", "window_begin", "window_end")
    assert rows(got) == [(0, 0, 100), (1, 100, 100)]


def test_requests_meet_their_slices_in_as_many_tasks_as_they_need(spark, monkeypatch):
    monkeypatch.setattr(decisions, "TASK_REQUESTS", 50, raising=False)
    asked = spark.range(400).select((F.col("id") % 200).alias("trigger_number"), F.lit(7).cast("long").alias("run_number"), (F.col("id") % 2).alias("source_id"), F.lit(0).cast("long").alias("window_begin"), F.lit(300).cast("long").alias("window_end"))
    got = decisions.data_requests(decisions.slices(decisions.extents(asked), 100), asked)
    assert got.rdd.getNumPartitions() == 9
    # the third window of 100 ticks begins where the second one ends
    assert got.groupBy("sequence_number").count().orderBy("sequence_number").collect() == [(0, 400), (1, 400), (2, 400)]


def test_without_a_window_there_is_one_sequence(spark):
    asked = spark.createDataFrame([(1, 7, 1, 5, 5), (2, 7, 1, 0, 90)], "trigger_number long, run_number long, source_id long, window_begin long, window_end long")
    assert rows(decisions.slices(decisions.extents(asked), 0).select("trigger_number", "max_sequence_number", "slice_begin", "slice_end")) == [(1, 0, 5, 5), (2, 0, 0, 90)]
    assert rows(decisions.slices(decisions.extents(asked), 10).where("trigger_number = 1").select("sequence_number")) == [(0,)]


@settings(max_examples=20, deadline=None)
@given(st.integers(1, 500), st.integers(1, 60))
def test_slices_cover_the_extent(width, window):
    most = (width - 1) // window
    bounds = [(s * window, min(s * window + window, width)) for s in range(most + 1)]
    assert bounds[0][0] == 0 and bounds[-1][1] == width and all(a[1] == b[0] for a, b in zip(bounds, bounds[1:]))


def test_type_bits(spark):
    df = spark.createDataFrame([(0,), (5,), (-(2**63),), (None,)], "m long").select(decisions.type_bits(F.col("m")).alias("b"))
    assert [r.b for r in df.collect()] == [[], [0, 2], [63], []]


def test_run_filter_drops_null_runs(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "run_number long")
    assert decisions.of_run(df, 1).count() == 1 and decisions.foreign(df, 1).count() == 2


# assembly

KEY = ["trigger_number"]
FULL = "run_number long, trigger_number long, sequence_number long, source_id long"


def test_a_trigger_number_in_two_runs_makes_two_records(spark):
    asked = spark.createDataFrame([(1, 1, 0, 1), (2, 1, 0, 1), (2, 1, 1, 1), (None, 1, 0, 1)], FULL)
    came = spark.createDataFrame([(1, 1, 0, 1, 5, 1), (2, 1, 1, 1, 6, 1)], f"{FULL}, size_bytes long, arrival long")
    got = assembly.assemble(asked, came).select("run_number", "sequence_number", "received", "status")
    assert rows(got) == [(None, 0, 0, "empty"), (1, 0, 1, "complete"), (2, 0, 0, "empty"), (2, 1, 1, "complete")]
    assert rows(assembly.unexpected(asked.where("run_number = 1"), came).select("run_number")) == [(2,)]
    whole = assembly.with_fragments(asked, came, ["arrival"], ["size_bytes"]).where("run_number = 2").orderBy("sequence_number").collect()
    assert [[tuple(f) for f in r.fragments] for r in whole] == [[], [(1, 1, 6)]] and [r.received for r in whole] == [0, 1]


def test_extents_and_slices_keep_runs_apart(spark):
    asked = spark.createDataFrame([(1, 7, 1, 0, 100), (2, 7, 1, 500, 900)], "run_number long, trigger_number long, source_id long, window_begin long, window_end long")
    cut = decisions.slices(decisions.extents(asked), 250)
    assert rows(cut.select("run_number", "sequence_number", "slice_begin", "slice_end")) == [(1, 0, 0, 100), (2, 0, 500, 750), (2, 1, 750, 900)]
    assert decisions.data_requests(cut, asked).count() == 3


def test_a_record_fills_up_and_the_rest_is_late(spark):
    asked = spark.createDataFrame([(1, 1, 0, s) for s in (1, 2)], FULL)
    came = spark.createDataFrame([(1, 1, 0, 2, 5, 3), (1, 1, 0, 1, 6, 1), (1, 1, 0, 1, 7, 9), (1, 1, 0, 3, 8, 0)], f"{FULL}, size_bytes long, arrival long")
    whole = assembly.with_fragments(asked, came, ["arrival"], ["size_bytes"]).first()
    assert [tuple(f) for f in whole.fragments] == [(1, 1, 6), (2, 2, 5)] and whole.status == "complete"
    assert rows(assembly.placed_fragments(asked, came, ["arrival"]).select("arrival", "nth", "is_late")) == [(1, 1, False), (3, 2, False), (9, 3, True)]


def test_records_time_out_from_their_creation(spark):
    asked = spark.createDataFrame([(k, s, 100) for k in (1, 2, 3, 4) for s in (1, 2)], "trigger_number long, source_id long, created long")
    came = spark.createDataFrame([(1, 1, 90), (1, 2, 110), (1, 2, 111), (2, 1, 105), (2, 1, 109), (2, 2, 111), (3, 2, 500), (3, 9, 600)], "trigger_number long, source_id long, arrival long")
    got = assembly.assemble_in_time(asked, came, 10, KEY).select("trigger_number", "received", "ended", "timed_out", "late", "status")
    assert rows(got) == [(1, 2, 110, False, 1, "complete"), (2, 1, 110, True, 1, "incomplete"), (3, 0, 110, True, 1, "empty"), (4, 0, 110, True, 0, "empty")]
    never = assembly.assemble_in_time(asked, came, 0, KEY).select("trigger_number", "received", "ended", "timed_out")
    assert rows(never) == [(1, 2, 110, False), (2, 2, 111, False), (3, 1, None, False), (4, 0, None, False)]


def test_rows_without_a_group_stay(spark):
    df = spark.createDataFrame([(None, 1, 5), (None, 2, 6), (3, 1, 7)], "g long, k long, v long")
    assert rows(grouped_rank(df, ["g"], ["k"], "r", "n").select("g", "k", "r", "n")) == [(None, 1, 0, 2), (None, 2, 1, 2), (3, 1, 0, 1)]
    ran = running(df, ["g"], ["k"], {"s": ("sum", "v"), "b": ("max_before", "v"), "l": ("last", "v")})
    assert rows(ran.select("g", "k", "s", "b", "l")) == [(None, 1, 5, None, 5), (None, 2, 11, 5, 6), (3, 1, 7, None, 7)]
    assert sink.rollover(df, ["g"], ["k"], "v", 6).count() == 3 and sink.prescaled(df, ["g"], ["k"], 2).count() == 3
    assert sink.per_event_files(df.withColumnRenamed("v", "trigger_number"), ["g"], ["k"]).count() == 3


def test_last_value_and_earlier_maximum_cross_partitions(spark):
    df = spark.range(3000).select((F.col("id") % 2).alias("g"), F.col("id").alias("k"), F.when(F.col("id") % 17 == 0, F.col("id") * 7 % 101).alias("v")).repartition(5)
    pdf = df.toPandas().sort_values(["g", "k"])
    got = running(df, ["g"], ["k"], {"b": ("max_before", "v"), "l": ("last", "v")}).toPandas().sort_values(["g", "k"])
    assert got["l"].fillna(-1).tolist() == pdf.groupby("g")["v"].ffill().fillna(-1).tolist()
    want = pdf.groupby("g")["v"].apply(lambda x: x.cummax().ffill().shift()).fillna(-1)
    assert got["b"].fillna(-1).tolist() == want.tolist()


def _asked(spark):
    return spark.createDataFrame([(1, 9, 1), (1, 9, 2), (2, 9, 1)], "trigger_number long, run_number long, source_id long")


def _came(spark, data):
    return spark.createDataFrame(data, "trigger_number long, source_id long, size_bytes long, arrival long")


def test_a_source_counts_once_and_strangers_dont(spark):
    came = _came(spark, [(1, 1, 5, 1), (1, 1, 7, 2), (1, 3, 9, 3), (4, 1, 1, 1)])
    got = assembly.assemble(_asked(spark), came, KEY, ["run_number"]).select("trigger_number", "requested", "received", "missing", "record_bytes", "status")
    assert rows(got) == [(1, 2, 1, 1, 12, "incomplete"), (2, 1, 0, 1, 0, "empty")]
    assert rows(assembly.unexpected(_asked(spark), came, KEY).select("trigger_number", "source_id")) == [(1, 3), (4, 1)]


def test_by_count_a_repeated_source_closes_a_record_early(spark):
    came = _came(spark, [(1, 1, 5, 1), (1, 1, 7, 2), (1, 2, 9, 3)])
    got = assembly.assemble_by_count(_asked(spark), came, ["arrival"], KEY)
    assert rows(got) == [(1, 2, 2, 1, "complete"), (2, 1, 0, 0, "empty")]


def test_routing_uses_up_a_request(spark):
    asked = spark.createDataFrame([(1, 1, "a", 0), (1, 1, "b", 1), (2, 1, "c", 0)], "trigger_number long, source_id long, destination string, at int")
    came = _came(spark, [(1, 1, 5, 2), (1, 1, 6, 1), (3, 1, 7, 1)])
    got = assembly.route_fragments(asked, came, "at", ["arrival"], KEY)
    assert rows(got.select("trigger_number", "destination", "size_bytes", "outcome"), "trigger_number", "size_bytes") == [
        (1, None, 5, "unknown_destination"), (1, "b", 6, "sent"), (2, "c", None, "unanswered"), (3, None, 7, "unknown_destination"),
    ]


def test_monitor_takes_the_first_record_of_exactly_its_type(spark):
    records = spark.createDataFrame([(1, 4, 10), (2, 5, 11), (3, 4, 12)], "trigger_number long, trigger_type long, trigger_timestamp long")
    wanted = spark.createDataFrame([(0, 4, 11), (1, 4, 0), (2, 4, 99)], "request_id long, trigger_type long, since long")
    assert rows(assembly.monitor_samples(records, wanted).select("request_id", "trigger_number")) == [(0, 3), (1, 1), (2, None)]


# slices


def test_edges_of_slices(spark):
    sets = spark.createDataFrame([(0, 1, 7, 5, 25, [5, 12, 25]), (1, 1, 7, 12, 14, [12, 14]), (2, 1, 8, 3, 10, [3, 4])], "seqno long, run_number long, origin long, start_time long, end_time long, objects array<long>")
    got = slices.in_slices(sets, 10).select("seqno", "slice_index", "start_time", "end_time", "objects")
    assert rows(got, "seqno", "slice_index") == [(0, 0, 5, 5, [5]), (0, 1, 12, 12, [12]), (0, 2, 25, 25, [25]), (1, 1, 12, 14, [12, 14]), (2, 0, 3, 4, [3, 4])]
    kept = slices.first_windows(slices.in_slices(sets, 10))
    assert rows(kept.where("slice_index = 1").select("seqno", "start_time")) == [(0, 12)]
    bundled = slices.bundles(slices.in_slices(sets, 10)).where("slice_index = 1").select("origin", "n_sets", "objects")
    assert rows(bundled) == [(7, 2, [12, 12, 14])]


def test_slice_numbers_keep_gaps(spark):
    df = spark.createDataFrame([(1, 10), (1, 13), (2, 4)], "run_number long, slice_index long")
    assert rows(slices.numbered(df).select("run_number", "slice_number")) == [(1, 1), (1, 4), (2, 1)]


def test_slices_close_when_quiet_and_open_again(spark):
    df = spark.createDataFrame([(1, 5, 0), (1, 6, 10), (1, 7, 21), (1, 15, 3)], "run_number long, time_start long, arrival long")
    assert rows(slices.quiet_slices(df, 10, 10)) == [(1, 0, 0, 2, 5, 6), (1, 0, 1, 1, 7, 7), (1, 1, 0, 1, 15, 15)]


def test_what_comes_before_the_first_slice_is_tardy_once_one_was_emitted(spark):
    df = spark.createDataFrame([(1, 35, 0), (1, 45, 1), (1, 25, 9), (1, 55, 11), (1, 5, 12), (1, 26, 13), (2, 5, 0)], "run_number long, time_start long, arrival long")
    first = slices.first_emission(df, 10, 10)
    assert rows(first) == [(1, 11, 2)]
    assert rows(slices.mark_tardy(df, first, 10).where("is_tardy").select("time_start")) == [(5,)]
    again = spark.createDataFrame([(1, 35, 0), (1, 36, 10), (1, 5, 15), (1, 37, 21)], df.schema)
    assert rows(slices.first_emission(again, 10, 10)) == []


def test_the_rows_of_one_run_stay_in_many_tasks_when_tardy_ones_are_marked(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = spark.range(0, 800, 1, 8).select(F.lit(1).cast("long").alias("run_number"), (F.col("id") * 7 % 100).alias("time_start"), F.col("id").alias("arrival"))
        first = slices.first_emission(df, 10, 60)
        assert not re.search(r"SortMergeJoin \[run_number#\d+L\],", first._jdf.queryExecution().executedPlan().toString())
        marked = slices.mark_tardy(df, first, 10).withColumn("task", F.spark_partition_id())
        assert marked.select("task").distinct().count() == 8
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_tardiness(spark):
    df = spark.createDataFrame([(1, k, s) for k, s in enumerate([3, 5, 4, 6, 2])], "run long, n long, slice_index long")
    got = slices.tardiness(df, ["run"], ["n"], 10, 2.0).select("n", "largest_index", "tardy_seconds")
    assert rows(got) == [(0, 3, 0.0), (1, 5, 0.0), (2, 5, 5.0), (3, 6, 0.0), (4, 6, 20.0)]


# sink


def naive(sizes, most):
    index, held, out = 0, 0, []
    for s in sizes:
        if held > 0 and held + s > most:
            index, held = index + 1, 0
        out.append(index)
        held += s
    return out, held


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 30), max_size=40), st.integers(1, 40), st.integers(0, 50))
def test_fill_agrees_with_the_rule(sizes, most, held):
    want, rest = naive([held, *sizes], most) if held else naive(sizes, most)
    files = (want[-1] if want else 0)
    opened, last = sink.fill(np.array(sizes, np.int64), most, held)
    assert (len(opened), last) == (files, rest if sizes else held)
    own = want[1:] if held else want
    assert [sum(k <= at for k in opened) for at in range(len(sizes))] == own


@pytest.mark.parametrize("count,size,most,files", [(15, 500_000, 3_000_000, 3), (5, 500_000, 150_000, 5), (5, 30, 4_294_967_296, 1)])
def test_rollover_file_counts(spark, count, size, most, files):
    df = spark.createDataFrame([(1, k, size) for k in range(count)], "run_number long, n long, bytes long")
    got = sink.rollover(df, ["run_number"], ["n"], "bytes", most)
    assert got.select("file_index").distinct().count() == files and got.count() == count


def test_rollover_over_many_partitions(spark):
    rng = np.random.default_rng(3)
    sizes = [int(x) for x in rng.integers(0, 90, 3000)]
    df = spark.createDataFrame([(k % 2, k, s) for k, s in enumerate(sizes)], "run long, n long, bytes long").repartition(7)
    got = {r.n: r.file_index for r in sink.rollover(df, ["run"], ["n"], "bytes", 400).collect()}
    for run in (0, 1):
        want, _ = naive(sizes[run::2], 400)
        assert [got[k] for k in range(run, 3000, 2)] == want


def test_one_file_for_each_event(spark):
    df = spark.createDataFrame([(1, 5, 10), (1, 5, 10), (1, 9, 20), (2, 1, 1)], "run_number long, trigger_number long, at long")
    assert rows(sink.per_event_files(df, ["run_number"], ["at", "trigger_number"]).select("run_number", "trigger_number", "file_index")) == [(1, 5, 0), (1, 5, 0), (1, 9, 1), (2, 1, 0)]


def test_files_of_events_also_roll_by_size(spark):
    df = spark.createDataFrame([(1, t, k, 4) for t in (5, 3) for k in range(3)] + [(2, 5, 0, 99)], "run_number long, trigger_number long, n long, bytes long")
    got = sink.event_files(df, ["run_number"], ["n", "trigger_number"], "bytes", 8)
    assert rows(got.select("run_number", "trigger_number", "n", "file_index")) == [(1, 3, 0, 0), (1, 3, 1, 0), (1, 3, 2, 1), (1, 5, 0, 2), (1, 5, 1, 2), (1, 5, 2, 3), (2, 5, 0, 0)]


@pytest.fixture
def cut_finely(spark):
    """Stretches that stay small and batches of 7 rows, so that triggers and files go over their edges."""
    fine = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "9", "spark.sql.execution.arrow.maxRecordsPerBatch": "7"}
    kept = {k: spark.conf.get(k) for k in fine}
    for k, v in fine.items():
        spark.conf.set(k, v)
    yield
    for k, v in kept.items():
        spark.conf.set(k, v)


def naive_event_files(records, order, most):
    """records: (group, trigger, n, bytes)."""
    want, place = {}, (lambda v: (v is not None, v or 0))
    for g in {r[0] for r in records}:
        index, triggers = -1, {}
        for r in records:
            if r[0] == g:
                triggers.setdefault(r[1], []).append(r)
        for t in triggers.values():
            t.sort(key=lambda r: r[2])
        first = (lambda t: (place(t), triggers[t][0][2])) if order[0] == "trigger_number" else (lambda t: (triggers[t][0][2], place(t)))
        for t in sorted(triggers, key=first):
            held = None
            for r in triggers[t]:
                opens = held is None or held > 0 and held + (r[3] or 0) > most
                index, held = index + opens, (r[3] or 0) + (0 if opens else held)
                want[r[2]] = index
    return want


@pytest.mark.parametrize("groups", [["run_number"], []])
@pytest.mark.parametrize("order", [["trigger_number", "n"], ["n", "trigger_number"]])
def test_files_of_triggers_that_go_over_stretches(spark, cut_finely, groups, order):
    rng = np.random.default_rng(5)
    # trigger 4 has half of all rows; some sizes are nothing, unknown, or more than a file
    triggers = [None if t == 11 else 4 if t > 11 else int(t) for t in rng.integers(0, 24, 1500)]
    runs = [(1, 2, None)[k] for k in rng.integers(0, 3, 1500)] if groups else [1] * 1500
    sizes = [(0, None, 250)[int(x) % 3] if x < 12 else int(x) for x in rng.integers(0, 90, 1500)]
    records = [(r, t, n, b) for n, (r, t, b) in enumerate(zip(runs, triggers, sizes))]
    df = spark.createDataFrame(records, "run_number long, trigger_number long, n long, bytes long").repartition(5)
    got = sink.event_files(df, groups, order, "bytes", 200)
    assert got.columns == [*df.columns, "file_index"]
    assert {r.n: r.file_index for r in got.collect()} == naive_event_files(records, order, 200) and got.count() == 1500


def test_names_of_triggers_may_be_text(spark, cut_finely):
    df = spark.createDataFrame([("a", f"t{k // 50}", k, 4) for k in range(200)], "run_number string, trigger_number string, n long, bytes long")
    got = sink.event_files(df, ["run_number"], ["trigger_number", "n"], "bytes", 8)
    assert [r.file_index for r in got.orderBy("n").collect()] == [k // 2 for k in range(200)]


def test_no_events_no_files(spark):
    df = spark.createDataFrame([], "run_number long, trigger_number long, n long, bytes long")
    assert sink.event_files(df, ["run_number"], ["trigger_number", "n"], "bytes", 8).collect() == []


def test_files_of_events_are_counted_where_their_records_lie(spark, cut_finely):
    """After the one sort that lays them, records meet only a row of their stretch; triggers don't pass through tasks of their own."""
    df = spark.range(4000).select(F.lit(1).cast("long").alias("run_number"), F.expr("id div 2").alias("trigger_number"), F.col("id").alias("n"), F.lit(3).cast("long").alias("bytes"))
    with scratch.recording() as made:
        got = sink.event_files(df, ["run_number"], ["trigger_number", "n"], "bytes", 8)
    assert got.agg(F.max("file_index")).first()[0] == 1999
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" not in plan and "Window" not in plan
    rows = {p.rsplit("/", 1)[1].split("-")[0]: spark.read.parquet(p).count() for p in made}
    assert rows["event_files"] == 4000 and all(n < 40 for name, n in rows.items() if name != "event_files")


def test_records_of_other_runs_move_the_prescale_on(spark):
    df = spark.createDataFrame([(1, 0), (2, 1), (2, 2), (1, 3), (1, 4)], "run_number long, n long")
    assert rows(sink.prescaled_of_run(df, 1, ["n"], 2).select("n", "is_stored", "is_foreign")) == [(0, True, False), (1, False, True), (2, False, True), (3, False, False), (4, True, False)]


def test_prescale_keeps_the_first(spark):
    df = spark.range(7).select(F.lit(1).alias("g"), "id")
    assert [r.id for r in sink.prescaled(df, ["g"], ["id"], 3).where("is_stored").orderBy("id").collect()] == [0, 3, 6]
    assert sink.prescaled(df, ["g"], ["id"], 1).where("is_stored").count() == 7


def test_tokens_need_all_sequences(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (2, 1)], "trigger_number long, max_sequence_number long")
    assert rows(sink.tokens(df, F.lit("x"))) == [(1, "x")]


def test_names_pad_and_never_cut(spark):
    df = spark.createDataFrame([(53, 12345678)], "r long, i long")
    got = df.select(sink.file_name(F.col("r"), F.col("i"), F.lit("w"), RunConfig(), "/d", F.lit("T")).alias("n")).first().n
    assert got == "/d/test_raw_run000053_12345678_w_T.parquet"


def test_retry_waits(spark):
    df = spark.range(12).select(F.col("id").alias("attempt"))
    got = [r.wait_ms for r in sink.retry_waits(df, RunConfig()).orderBy("attempt").collect()]
    assert got[:3] == [1.0, 2.0, 4.0] and got[-1] == 1000.0


def test_slices_are_written_once(spark):
    fresh = spark.createDataFrame([(1, 1, 5), (1, 1, 6), (1, 2, 7)], "run long, slice long, seqno long")
    there = spark.createDataFrame([(1, 2)], "run long, slice long")
    assert rows(sink.once(fresh, there, ["run", "slice"]).select("slice", "seqno")) == [(1, 5)]


# balance


def test_round_robin_starts_at_the_second_app(spark):
    made = spark.range(5).withColumnRenamed("id", "trigger_number")
    apps = spark.createDataFrame([("b",), ("a",), ("c",)], "connection_name string")
    got = balance.round_robin(made, apps, ["trigger_number"])
    assert [r.connection_name for r in got.orderBy("trigger_number").collect()] == ["b", "c", "a", "b", "c"]
    assert balance.round_robin(made, apps.limit(0), ["trigger_number"]).count() == 0


def test_occupancy_and_busy(spark):
    data = [("x", 1, 1, 1), ("x", 2, 1, 2), ("x", 3, -1, 1), ("x", 3, 1, 3), ("x", 4, -1, 2)]
    at = balance.occupancy(spark.createDataFrame(data, "app string, time long, delta long, trigger_number long"))
    assert [r.slots for r in at.orderBy("time", "delta").collect()] == [1, 2, 1, 2, 1]
    assert [(r.time, r.busy) for r in balance.busy_changes(at, 2).orderBy("time", "delta").collect()] == [(2, True), (3, False), (3, True), (4, False)]


def test_balancer_scenario():
    b = balance.Balancer(["trb"], busy=2, free=1)
    assert b.assign(2)[1] == "sent" and not b.all_busy
    assert b.assign(3)[1] == "sent" and b.all_busy
    assert b.assign(4)[1] == "sent_to_busy"
    assert b.complete("other", 2) == "unknown_app" and b.complete("trb", 999) == "unknown_trigger"
    for t in (2, 3, 4):
        assert b.complete("trb", t) == "completed"
    assert not b.all_busy
    assert balance.Balancer([], 2).all_busy  # no app is all apps


def test_balancer_marks_unreachable_apps():
    b = balance.Balancer(["a", "b"], busy=5, retries=2)
    assert b.assign(1, lambda app, attempt: app == "a") == ("a", "sent", 3)
    assert b.error == {"a": False, "b": True}
    assert balance.Balancer(["a"], 5).assign(1, lambda *_: False) == (None, "unable", 5)
    b.register("b")
    assert not b.error["b"]
    with pytest.raises(ValueError):
        balance.Balancer(["a"], busy=10, free=15)


def test_hysteresis():
    import pandas as pd

    got = pd.concat(balance.hysteresis(iter([pd.DataFrame({"app": ["x"] * 5 + ["y"], "slots": [1, 3, 2, 1, 2, 2]})]), 3, 2))
    assert got["busy"].tolist() == [False, True, True, False, False, False]


def test_lag_inhibit(spark):
    df = spark.createDataFrame([("g", 1, 5, None), ("g", 2, None, 4), ("g", 3, 9, None), ("g", 4, None, 9)], "app string, time long, started long, ended long")
    got = balance.lag_inhibit(df, ["app"], ["time"], 2)
    assert [(r.lag, r.busy) for r in got.orderBy("time").collect()] == [(5, True), (1, False), (5, True), (0, False)]
    df = spark.createDataFrame([("g", 1, 5, None), ("g", 2, 6, None), ("g", 3, None, 5), ("g", 4, None, 4), ("h", 1, None, 1)], df.schema)
    assert rows(balance.inhibit_edges(df, ["app"], ["time"], 2).select("app", "time", "busy")) == [("g", 1, True), ("g", 3, False)]
    assert rows(balance.inhibit_edges(df, ["app"], ["time"], 1).select("app", "time", "busy")) == [("g", 1, True)]


def test_latency_of_the_newest(spark):
    df = spark.createDataFrame([("x", k, 10 * k, k) for k in range(1, 6)], "app string, completed long, latency_us long, trigger_number long")
    assert rows(balance.latencies(df, 2)) == [("x", 5, 10, 50, 45)]
    assert rows(balance.latencies(df, 3, since=4)) == [("x", 5, 10, 50, 45)] and rows(balance.latencies(df, 3, since=99)) == [("x", 5, 10, 50, None)]


def test_pool(spark):
    at = spark.createDataFrame([("x", 1, 1, 1, 1), ("x", 2, 1, 2, 2), ("y", 5, 1, 3, 1)], "app string, time long, delta long, trigger_number long, slots long")
    apps = spark.createDataFrame([("x",), ("y",)], "app string")
    assert rows(balance.used_slots(at, apps, 4, 2)) == [(2, False, False)] and rows(balance.used_slots(at, apps, 0, 2)) == [(0, False, True)]
    assert rows(balance.used_slots(at, apps.where("app = 'x'"), 4, 2)) == [(2, True, False)] and rows(balance.used_slots(at, apps.limit(0), 4, 2)) == [(0, True, True)]


def test_balanced_assignment_against_a_plain_replay(spark, small):
    from eventloom.plans import queries as q

    got = {(r.run_number, r.trigger_number): (r.app, r.outcome, r.slots) for r in q.balanced_assignment(spark, small).collect()}
    made = [(r.run_number, r.trigger_timestamp, 1, r.trigger_number) for r in q.tables.decisions(spark, small).collect()]
    over = [(r.run_number, r.completed, 0, r.trigger_number) for r in q._completions(spark, small).collect()]
    names, want = sorted(f"app-{k}" for k in range(q.APPS)), {}
    for run in {r[0] for r in made}:
        held, where, at = {a: 0 for a in names}, {}, 0
        for _, _, kind, trigger in sorted(x for x in made + over if x[0] == run):
            if kind == 0:
                if trigger in where:
                    held[where.pop(trigger)] -= 1
                continue
            turn = [names[(at + 1 + k) % len(names)] for k in range(len(names))]
            free = [a for a in turn if held[a] < q.BUSY]
            app = free[0] if free else min(turn, key=lambda a: (held[a], turn.index(a)))
            at, where[trigger] = names.index(app), app
            held[app] += 1
            want[run, trigger] = (app, "sent" if free else "sent_to_busy", held[app])
    assert got == want


def test_a_policy_of_ones_own(spark):
    class Last(balance.Balancer):
        def find(self):
            return self.apps[-1], False

    df = spark.createDataFrame([(1, 1, 1, 5), (1, 2, 1, 6)], "run_number long, time long, kind int, trigger_number long")
    got = balance.balanced(df, [], 1, policy=lambda: Last(["a", "z"], 1)).collect()
    assert [r.app for r in got] == ["z", "z"]


# checks, stores, ranks


def test_counts_of_fragments_and_files(spark):
    df = spark.createDataFrame([(1, 2, 2, 0), (1, 2, 3, 1), (2, 1, 1, 0)], "run_number long, requested long, received long, file_index long")
    assert rows(checks.record_checks(df)) == [(1, 2, 1, False), (2, 1, 0, True)]
    assert rows(checks.file_counts(df, F.lit(2)).select("run_number", "n_files", "passed")) == [(1, 2, True), (2, 1, False)]


def test_logs_pair_in_order(spark):
    lines = ["Sent 3 TDs.", "noise", "End of run 5", "Sent 8 TDs.", "Sent 9 TDs.", "End of run 6"]
    df = spark.createDataFrame([("f", k, x) for k, x in enumerate(lines)], "file string, line_number long, line string")
    assert rows(checks.log_counts(df)) == [(5, 3), (6, 9)]


def test_event_counts_within_tolerance(spark):
    df = spark.createDataFrame([(1,)] * 18 + [(2,)] * 17, "run_number long")
    assert rows(checks.event_counts(df, F.lit(20)).select("run_number", "passed")) == [(1, True), (2, False)]


def test_fragment_sizes_of_known_windows(spark):
    df = spark.createDataFrame([(1, 0, w) for w in (11_000_000, 26_000_000, 10_000_000)], "source_id long, window_begin long, window_end long")
    assert sorted(r.size_bytes for r in synth.fake_fragments(df, 2048, 7200).collect()) == [35_157_672, 38_678_472, 91_411_272]


def test_deltas(spark):
    df = spark.createDataFrame([(1, 1, 5), (1, 2, 9)], "run long, at long, n long")
    assert rows(metrics.deltas(df, ["run"], "at", ["n"])) == [(1, 1, 5), (1, 2, 4)]


def test_store_round_trip(spark, tmp_path):
    s = store.make_data_store("parquet", spark=spark, directory=str(tmp_path), config=RunConfig(max_file_size=1000))
    df = spark.createDataFrame([(5, 1, 600), (5, 2, 600), (6, 1, 10)], "run_number long, trigger_number long, record_bytes long")
    with pytest.raises(store.StoreProblem):
        s.write_records(df)
    s.prepare_for_run(5, True)
    s.write_records(df)
    s.write_records(df.where("trigger_number = 1").withColumns({"trigger_number": F.lit(3).cast("long"), "record_bytes": F.lit(300).cast("long")}))
    back = s.listed("records")
    assert rows(back.select("trigger_number", "file_index")) == [(1, 0), (2, 1), (3, 1)] and back.first().run_was_for_test_purposes
    assert s.written == {"records_written": 3, "bytes_output": 1500, "records_of_other_runs": 2} and s.at == (1, 900)
    cut = spark.createDataFrame([(5, 1)], "run_number long, slice_number long")
    s.write_slices(cut)
    with pytest.raises(store.IgnorableProblem):
        s.write_slices(cut)
    s.finish_with_run(5)
    assert s.run is None
    names = [r.path for r in store.dataset_paths(spark, str(tmp_path)).collect()]
    assert len(names) >= 3 and all(n.startswith(("records/run_number=5/", "slices/")) for n in names)
    for n in ("a_1.x", "b.x"):
        (tmp_path / n).touch()
    assert store.matching_files(spark, str(tmp_path), r"a_\d\.x") == ["a_1.x"]


def test_store_with_a_file_for_each_event(spark, tmp_path):
    s = store.make_data_store("parquet", spark=spark, directory=str(tmp_path), config=RunConfig(max_file_size=1000, mode="one-event-per-file"))
    s.prepare_for_run(5, False)
    df = spark.createDataFrame([(5, 1, 0, 700), (5, 1, 1, 700), (5, 2, 0, 10)], "run_number long, trigger_number long, sequence_number long, record_bytes long")
    s.write_records(df)
    s.write_records(df.where("trigger_number = 2").withColumn("trigger_number", F.lit(3).cast("long")))
    assert rows(s.listed("records").select("trigger_number", "sequence_number", "file_index")) == [(1, 0, 0), (1, 1, 1), (2, 0, 2), (3, 0, 3)]


def test_store_problems(spark):
    with pytest.raises(store.StoreProblem):
        store.make_data_store("no such")
    with pytest.raises(store.StoreProblem):
        store.make_data_store("parquet", spark=spark, directory="/no/such/place").prepare_for_run(1, False)
    with pytest.raises(store.RetryableProblem):
        store.require_space(100, 30, 5)
    store.require_space(100, 30, 0)
    for bad in ({"busy_threshold": 1, "free_threshold": 2}, {"mode": "other"}):
        with pytest.raises(ValueError):
            RunConfig(**bad)


def test_ranks_and_running_values_cross_partitions(spark):
    df = spark.range(2000).select((F.col("id") % 3 == 0).cast("int").alias("g"), F.col("id").alias("k"), (F.col("id") % 7).alias("v")).repartition(9)
    pdf = df.toPandas().sort_values(["g", "k"])
    ranked = grouped_rank(df, ["g"], ["k"], "r", "n").toPandas().sort_values(["g", "k"])
    assert ranked["r"].tolist() == pdf.groupby("g").cumcount().tolist()
    assert ranked["n"].tolist() == pdf.groupby("g")["k"].transform("size").tolist()
    ran = running(df, ["g"], ["k"], {"s": ("sum", "v"), "m": ("max", "v")}).toPandas().sort_values(["g", "k"])
    assert ran["s"].tolist() == pdf.groupby("g")["v"].cumsum().tolist() and ran["m"].tolist() == pdf.groupby("g")["v"].cummax().tolist()


def test_empty_tables(spark):
    none = spark.createDataFrame([], "g long, k long, v long")
    assert grouped_rank(none, ["g"], ["k"]).count() == 0 and running(none, ["g"], ["k"], {"s": ("sum", "v")}).count() == 0
    assert sink.rollover(none, ["g"], ["k"], "v", 10).count() == 0


def test_scalars(spark):
    df = spark.createDataFrame([(125, "b"), (-125, "z")], "t long, n string")
    names = {1: "a", 2: "b"}
    got = df.select(scalars.slice_index(F.col("t"), 100).alias("i"), scalars.seconds(F.col("t"), 50.0).alias("s"), scalars.value_of(F.col("n"), names).alias("v"), scalars.valid(F.col("t"), 125).alias("x"))
    assert [tuple(r) for r in got.collect()] == [(1, 2.5, 2, None), (-1, -2.5, None, -125)]
    assert [r.n for r in spark.range(1, 4).select(scalars.name_of(F.col("id").cast("int"), names).alias("n")).collect()] == ["a", "b", "unknown"]
    at = lambda f, *x: spark.range(1).select(f(*[F.lit(v) for v in x]).alias("v")).first().v
    assert at(scalars.overlaps, 0, 5, 5, 9) and not at(scalars.overlaps, 0, 4, 5, 9)
    assert at(scalars.inside, 5, 5, 6) and not at(scalars.inside, 6, 5, 6)


def test_rates_by_the_wall_clock(spark):
    df = spark.createDataFrame([(1, 0, 100, 0), (1, 1, 350, 500)], "run long, n long, t long, ms long")
    got = slices.rates(df, ["run"], "n", "t", "ms").first()
    assert (got.per_second, got.inferred_clock, got.elapsed_ms) == (4.0, 500.0, 500)
    assert slices.rates(df.limit(1), ["run"], "n", "t").first().per_second is None
