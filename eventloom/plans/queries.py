"""The registered queries of the record-assembly and stream-capture operators, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import assembly, balance, checks, decisions, metrics, sink, slices
from ..sources import synth, tables
from ..sources.tables import RunConfig
from ..streaming import assembly as stream_assembly_of
from ..streaming import slices as stream_slices_of
from .oracles import ORACLES

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CONFIG = RunConfig()
HOUR = CONFIG.tp_accumulation_interval
DAY = 24 * HOUR
APPS = 10
BUSY = 3
TRIGGER = ["trigger_number"]


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _requests(spark: SparkSession, d: str) -> DataFrame:
    return tables.requests(tables.decisions(spark, d))


def _records(spark: SparkSession, d: str) -> DataFrame:
    """The surrogate fragments carry no run and trigger numbers are unique there, so the trigger is the record's key."""
    return assembly.assemble(_requests(spark, d), tables.fragments(spark, d), TRIGGER, also=["run_number"])


def _run_keyed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Slices, requests by slice and fragments by slice, of trigger numbers that come again in every run; some fragments are of slices that aren't there."""
    decided, came = tables.run_keyed(tables.decisions(spark, d), tables.fragments(spark, d))
    asked = tables.requests(decided)
    sliced = decisions.slices(decisions.extents(asked), 250)
    return sliced, decisions.data_requests(sliced, asked), came.withColumn("sequence_number", F.col("part") % 4)


def _timed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    decided = tables.decisions(spark, d)
    asked = tables.requests(decided).join(decided.select("trigger_number", F.col("trigger_timestamp").alias("created")), "trigger_number")
    return asked, tables.fragments(spark, d)


def _sliced(spark: SparkSession, d: str, window: int = 250) -> DataFrame:
    return decisions.slices(decisions.extents(_requests(spark, d)), window)


def _routes(spark: SparkSession) -> DataFrame:
    """Routes are known for sources 1 to 5."""
    return spark.range(1, 6).select(F.col("id").alias("source_id"), F.concat(F.lit("readout-"), F.col("id").cast("string")).alias("destination"))


def _app() -> F.Column:
    return F.concat(F.lit("app-"), (F.col("customer") % APPS).cast("string"))


def _completions(spark: SparkSession, d: str) -> DataFrame:
    """A decision with fragments completes 1 to 10 days after it was made."""
    done = tables.fragments(spark, d).select("trigger_number").distinct()
    rows = tables.decisions(spark, d).join(done, "trigger_number").withColumn("app", _app())
    return rows.withColumn("latency_us", (1 + F.col("trigger_number") % 10) * DAY).withColumn("completed", F.col("trigger_timestamp") + F.col("latency_us"))


def _changes(spark: SparkSession, d: str) -> DataFrame:
    made = tables.decisions(spark, d).select(_app().alias("app"), F.col("trigger_timestamp").alias("time"), F.lit(1).cast("long").alias("delta"), "trigger_number")
    return made.unionByName(_completions(spark, d).select("app", F.col("completed").alias("time"), F.lit(-1).cast("long").alias("delta"), "trigger_number"))


def _sets(spark: SparkSession, d: str) -> DataFrame:
    return tables.sets(slices.payload(tables.primitives(spark, d)))


def _slices(spark: SparkSession, d: str) -> DataFrame:
    return slices.first_windows(slices.in_slices(_sets(spark, d), HOUR))


# records


@query
def record_assembly(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d).select("trigger_number", "run_number", "requested", "received", "missing", "record_bytes", "status")


@query
def incomplete_records(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d).where("missing > 0").select("trigger_number", "requested", "received", "missing")


@query
def unexpected_fragments(spark: SparkSession, d: str) -> DataFrame:
    return assembly.unexpected(_requests(spark, d), tables.fragments(spark, d), TRIGGER).select("trigger_number", "source_id", "part", "supplier", "size_bytes")


@query
def lost_fragments_by_run(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d).groupBy("run_number", "status").agg(F.count("*").alias("n_records"), F.sum("missing").alias("lost_fragments"))


@query
def count_mode_assembly(spark: SparkSession, d: str) -> DataFrame:
    return assembly.assemble_by_count(_requests(spark, d), tables.fragments(spark, d), ["arrival", "part", "supplier", "source_id"], TRIGGER)


@query
def sliced_assembly(spark: SparkSession, d: str) -> DataFrame:
    """Records of sliced decisions, keyed by run, trigger and sequence."""
    _, asked, came = _run_keyed(spark, d)
    return assembly.assemble(asked, came)


@query
def record_fragments(spark: SparkSession, d: str) -> DataFrame:
    """The fragments of each record in order of arrival, until it is full."""
    _, asked, came = _run_keyed(spark, d)
    whole = assembly.with_fragments(asked, came, ["arrival", "part", "supplier", "source_id"], ["size_bytes"])
    text = F.transform("fragments", lambda f: F.concat_ws(":", f["source_id"].cast("string"), f["size_bytes"].cast("string")))
    return whole.select(*assembly.RECORD, "requested", "received", "missing", "status", F.concat_ws(",", text).alias("fragments"))


@query
def timed_records(spark: SparkSession, d: str) -> DataFrame:
    """Records that end when whole, or more than 60 days after their decision."""
    return assembly.assemble_in_time(*_timed(spark, d), 60 * DAY, TRIGGER)


@query
def fragment_routing(spark: SparkSession, d: str) -> DataFrame:
    """Decisions of urgent types are asked for twice; the later request has another destination and wins."""
    asked = _requests(spark, d).join(tables.decisions(spark, d).select("trigger_number", "trigger_type", "customer"), "trigger_number")
    first = asked.select("trigger_number", "source_id", F.concat(F.lit("trb-"), (F.col("customer") % 3).cast("string")).alias("destination"), F.lit(0).alias("at"))
    again = asked.where(F.getbit("trigger_type", F.lit(0)) == 1).select("trigger_number", "source_id", F.lit("trb-urgent").alias("destination"), F.lit(1).alias("at"))
    return assembly.route_fragments(first.unionByName(again), tables.fragments(spark, d), "at", ["arrival", "part", "supplier"], TRIGGER)


@query
def monitor_samples(spark: SparkSession, d: str) -> DataFrame:
    """One request per nation, each for a type, from its own day of 1995 on."""
    begin = 788_918_400_000_000
    nations = tables.read(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("k"))
    wanted = nations.select(F.col("k").alias("request_id"), F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("k") % 5).cast("int")).alias("trigger_type"), (F.lit(begin) + F.col("k") * DAY).alias("since"))
    return assembly.monitor_samples(tables.decisions(spark, d), wanted)


@query
def source_geo(spark: SparkSession, d: str) -> DataFrame:
    met = tables.fragments(spark, d).join(F.broadcast(tables.source_map(spark)), "source_id", "left")
    return met.groupBy("source_id", "detector_id", "crate_id", "slot_id", "stream_id").agg(F.count("*").alias("n_fragments"), F.sum("size_bytes").alias("bytes"))


# decisions


@query
def decision_extent(spark: SparkSession, d: str) -> DataFrame:
    return decisions.extents(_requests(spark, d)).drop("run_number")


@query
def slice_windows(spark: SparkSession, d: str) -> DataFrame:
    return _sliced(spark, d).drop("run_number")


@query
def data_requests(spark: SparkSession, d: str) -> DataFrame:
    return decisions.data_requests(_sliced(spark, d), _requests(spark, d)).drop("run_number")


@query
def trigger_type_counts(spark: SparkSession, d: str) -> DataFrame:
    done = tables.fragments(spark, d).select("trigger_number")
    return metrics.type_info(tables.decisions(spark, d), done)


@query
def run_filter(spark: SparkSession, d: str) -> DataFrame:
    """Per run taken as the current one: decisions of it, and foreign ones that are dropped."""
    all_ = tables.decisions(spark, d)
    of = lambda run: decisions.of_run(all_, run).agg(F.lit(run).cast("long").alias("run_number"), F.count("*").alias("kept"))
    other = lambda run: decisions.foreign(all_, run).agg(F.lit(run).cast("long").alias("run_number"), F.count("*").alias("dropped"))
    kept, dropped = of(1995).unionByName(of(1997)), other(1995).unionByName(other(1997))
    return kept.join(dropped, "run_number")


@query
def unexpected_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Per run taken as the current one: decisions of it, and unexpected ones, which are counted and dropped."""
    rows = tables.decisions(spark, d)
    each = [decisions.filter_counts(rows, run, "received", "unexpected_trigger_decisions").withColumn("run_number", F.lit(run).cast("long")) for run in (1995, 1997)]
    return each[0].unionByName(each[1])


@query
def duplicate_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Lines of an order as repeated decisions of one sequence: the first to arrive counts."""
    rows = decisions.duplicates(tables.fragments(spark, d), ["trigger_number", "source_id"], ["arrival", "part", "supplier"])
    return rows.groupBy("source_id").agg(F.count(F.when(~F.col("is_duplicate"), 1)).alias("accepted"), F.count(F.when(F.col("is_duplicate"), 1)).alias("duplicated"))


@query
def invalid_requests(spark: SparkSession, d: str) -> DataFrame:
    return decisions.invalid(_requests(spark, d), F.broadcast(_routes(spark))).select("trigger_number", "source_id")


@query
def request_routes(spark: SparkSession, d: str) -> DataFrame:
    return decisions.routed(_requests(spark, d), F.broadcast(_routes(spark))).groupBy("destination").agg(F.count("*").alias("n_requests"))


# slices


@query
def tp_timeslices(spark: SparkSession, d: str) -> DataFrame:
    return _slices(spark, d).groupBy("slice_index").agg(F.count("*").alias("n_sets"), F.sum(F.size("objects")).alias("n_tps"), F.countDistinct("origin").alias("n_origins"))


@query
def tp_bundles(spark: SparkSession, d: str) -> DataFrame:
    rows = slices.bundles(_slices(spark, d))
    return rows.select("slice_index", "origin", "n_sets", F.size("objects").cast("long").alias("n_tps"), F.element_at("objects", 1).alias("first_time"), F.element_at("objects", -1).alias("last_time"))


@query
def tp_edge_replication(spark: SparkSession, d: str) -> DataFrame:
    """Sets by how many slices they were put in."""
    per_set = slices.in_slices(_sets(spark, d), HOUR).groupBy("seqno").agg(F.count("*").alias("n_slices"), F.sum(F.size("objects")).alias("n_tps"))
    return per_set.groupBy("n_slices").agg(F.count("*").alias("n_sets"), F.sum("n_tps").alias("n_tps"))


@query
def slice_numbers(spark: SparkSession, d: str) -> DataFrame:
    return slices.numbered(_slices(spark, d).select("run_number", "slice_index").distinct())


@query
def heartbeat_counts(spark: SparkSession, d: str) -> DataFrame:
    return tables.primitives(spark, d).groupBy("run_number", "type").agg(F.count("*").alias("n"))


@query
def tps_per_slice(spark: SparkSession, d: str) -> DataFrame:
    return _slices(spark, d).groupBy("run_number", "slice_index").agg(F.sum(F.size("objects")).alias("n_tps"))


@query
def tardy_slices(spark: SparkSession, d: str) -> DataFrame:
    """Shipments in slices of 30 days, in the order of their keys: how far behind each run's latest slice."""
    width = 30 * DAY
    rows = tables.fragments(spark, d).withColumn("slice_index", F.expr(f"arrival div {width}"))
    late = slices.tardiness(rows, ["source_id"], ["trigger_number", "part", "supplier"], width, 1e6).where("tardy_seconds > 0")
    return late.groupBy("source_id", "slice_index").agg(F.count("*").alias("n_tardy"), F.max("tardy_seconds").alias("largest_tardiness"))


def _arrivals(spark: SparkSession, d: str) -> DataFrame:
    """Shipments as primitives that arrive, a second for each order, out of the order of their times; a run for each return flag."""
    rows = tables.read(spark, d, "lineitem")
    return rows.select(F.ascii("l_returnflag").cast("long").alias("run_number"), tables.ticks("l_shipdate").alias("time_start"), (F.col("l_orderkey") * 1_000_000).alias("arrival"))


@query
def tardy_sets(spark: SparkSession, d: str) -> DataFrame:
    """Primitives of 30-day slices: what comes for a slice before the first one, once a slice was emitted after 20 seconds of silence, is dropped."""
    rows = _arrivals(spark, d)
    marked = slices.mark_tardy(rows, slices.first_emission(rows, 30 * DAY, 20_000_000), 30 * DAY)
    return marked.groupBy("run_number", "slice_index").agg(F.count(F.when(F.col("is_tardy"), 1)).alias("dropped"), F.count(F.when(~F.col("is_tardy"), 1)).alias("kept"))


@query
def quiet_slices(spark: SparkSession, d: str) -> DataFrame:
    """Hourly slices that close after ten minutes of silence."""
    rows = slices.payload(tables.primitives(spark, d)).withColumn("arrival", F.col("time_start"))
    return slices.quiet_slices(rows, HOUR, 600_000_000)


@query
def stream_rates(spark: SparkSession, d: str) -> DataFrame:
    return slices.rates(tables.primitives(spark, d), ["run_number", "type"], "seqno", "time_start")


# writing


@query
def prescale(spark: SparkSession, d: str) -> DataFrame:
    rows = sink.prescaled(tables.decisions(spark, d), ["run_number"], ["trigger_timestamp", "trigger_number"], 10)
    return rows.select("trigger_number", "run_number", "nth", "is_stored")


@query
def prescale_of_run(spark: SparkSession, d: str) -> DataFrame:
    """A writer of run 1995: records of other runs are dropped after they moved the prescale on."""
    rows = sink.prescaled_of_run(tables.decisions(spark, d), 1995, ["trigger_timestamp", "trigger_number"], 7)
    return rows.groupBy("is_foreign", "is_stored").agg(F.count("*").alias("n"), F.max("nth").alias("last_nth"))


@query
def sequence_completion(spark: SparkSession, d: str) -> DataFrame:
    written = tables.fragments(spark, d).select("trigger_number", "source_id").distinct()
    return sink.sequences(written.withColumn("max_sequence_number", F.col("trigger_number") % 4))


@query
def completion_tokens(spark: SparkSession, d: str) -> DataFrame:
    written = tables.fragments(spark, d).select("trigger_number", "source_id").distinct().withColumn("max_sequence_number", F.col("trigger_number") % 4)
    return sink.tokens(written, F.concat(F.lit("app-"), (F.col("trigger_number") % APPS).cast("string")))


@query
def file_per_event(spark: SparkSession, d: str) -> DataFrame:
    rows = tables.decisions(spark, d).select("trigger_number", "run_number", "trigger_timestamp")
    return sink.per_event_files(rows, ["run_number"], ["trigger_timestamp", "trigger_number"])


def _filled(spark: SparkSession, d: str) -> DataFrame:
    rows = _records(spark, d).join(tables.decisions(spark, d).select("trigger_number", "trigger_timestamp"), "trigger_number")
    return sink.rollover(rows.select("trigger_number", "run_number", "trigger_timestamp", "record_bytes"), ["run_number"], ["trigger_timestamp", "trigger_number"], "record_bytes", 1_000_000)


@query
def file_rollover(spark: SparkSession, d: str) -> DataFrame:
    return _filled(spark, d).select("trigger_number", "run_number", "record_bytes", "file_index")


@query
def event_files(spark: SparkSession, d: str) -> DataFrame:
    """Fragments in files of one trigger each, and of 60 kB at most."""
    decided, came = tables.run_keyed(tables.decisions(spark, d), tables.fragments(spark, d))
    rows = came.select("run_number", "trigger_number", "source_id", "part", "supplier", "size_bytes")
    filled = sink.event_files(rows, ["run_number"], ["trigger_number", "source_id", "part", "supplier"], "size_bytes", 60_000)
    return filled.groupBy("run_number", "file_index").agg(F.min("trigger_number").alias("trigger_number"), F.count("*").alias("n"), F.sum("size_bytes").alias("file_bytes"))


@query
def file_count_check(spark: SparkSession, d: str) -> DataFrame:
    return checks.file_counts(_filled(spark, d), F.lit(40))


@query
def file_sizes(spark: SparkSession, d: str) -> DataFrame:
    return sink.file_sizes(_filled(spark, d), ["run_number"], "record_bytes")


@query
def file_names(spark: SparkSession, d: str) -> DataFrame:
    rows = tables.decisions(spark, d)
    name = sink.file_name(F.col("run_number"), F.col("trigger_number"), F.lit("writer_0"), CONFIG, "/data")
    path = sink.record_path(F.col("trigger_number"), F.lit(0), F.col("trigger_type"), CONFIG)
    return rows.select("trigger_number", name.alias("file_name"), path.alias("record_path"))


@query
def retry_schedule(spark: SparkSession, d: str) -> DataFrame:
    attempts = tables.read(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("attempt"))
    return sink.retry_waits(attempts, CONFIG)


# balance


@query
def round_robin(spark: SparkSession, d: str) -> DataFrame:
    rows = balance.round_robin(tables.decisions(spark, d), tables.builders(spark, d), ["trigger_timestamp", "trigger_number"], ["run_number"])
    return rows.select("trigger_number", "run_number", "nth", "connection_name")


@query
def inflight_occupancy(spark: SparkSession, d: str) -> DataFrame:
    return balance.occupancy(_changes(spark, d)).select("app", "time", "delta", "trigger_number", "slots")


@query
def busy_transitions(spark: SparkSession, d: str) -> DataFrame:
    return balance.busy_changes(balance.occupancy(_changes(spark, d)), BUSY).select("app", "time", "trigger_number", "slots", "busy")


@query
def latency_stats(spark: SparkSession, d: str) -> DataFrame:
    return balance.latencies(_completions(spark, d))


@query
def recent_latency(spark: SparkSession, d: str) -> DataFrame:
    """The average of those of the newest 1000 completions of each app that are of 1998 or later."""
    return balance.latencies(_completions(spark, d), since=883_612_800_000_000).select("app", "n", "average_latency_us")


@query
def pool_state(spark: SparkSession, d: str) -> DataFrame:
    """Used slots of all apps at the begin of 1995."""
    apps = tables.decisions(spark, d).select(_app().alias("app"))
    return balance.used_slots(balance.occupancy(_changes(spark, d)), apps, 788_918_400_000_000, BUSY)


@query
def capacity_rate(spark: SparkSession, d: str) -> DataFrame:
    rows = balance.capacity(balance.latencies(_completions(spark, d)), CONFIG.busy_threshold, CONFIG.free_threshold)
    return rows.select("app", "min_latency_us", "max_latency_us", "capacity_rate")


@query
def remnants(spark: SparkSession, d: str) -> DataFrame:
    rows = tables.decisions(spark, d).withColumn("app", _app())
    return balance.remnants(rows, tables.fragments(spark, d)).select("trigger_number", "run_number", "app")


def _marks(spark: SparkSession, d: str) -> DataFrame:
    """Decisions start and completions end, by app and in order of time; the mark is the trigger number."""
    begun = tables.decisions(spark, d).select(_app().alias("app"), F.col("trigger_timestamp").alias("time"), F.lit(0).alias("kind"), F.col("trigger_number").alias("started"), F.lit(None).cast("long").alias("ended"), "trigger_number")
    over = _completions(spark, d).select("app", F.col("completed").alias("time"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("started"), F.col("trigger_number").alias("ended"), "trigger_number")
    return begun.unionByName(over)


@query
def lag_inhibit(spark: SparkSession, d: str) -> DataFrame:
    return balance.lag_inhibit(_marks(spark, d), ["app"], ["time", "kind", "trigger_number"], 100).select("app", "time", "kind", "trigger_number", "lag", "busy")


@query
def inhibit_edges(spark: SparkSession, d: str) -> DataFrame:
    return balance.inhibit_edges(_marks(spark, d), ["app"], ["time", "kind", "trigger_number"], 100).select("app", "time", "kind", "trigger_number", "lag", "busy")


@query
def balanced_assignment(spark: SparkSession, d: str) -> DataFrame:
    made = tables.decisions(spark, d).select("run_number", F.col("trigger_timestamp").alias("time"), F.lit(1).alias("kind"), "trigger_number")
    over = _completions(spark, d).select("run_number", F.col("completed").alias("time"), F.lit(0).alias("kind"), "trigger_number")
    return balance.balanced(made.unionByName(over), [f"app-{k}" for k in range(APPS)], BUSY)


# metrics


@query
def trb_info(spark: SparkSession, d: str) -> DataFrame:
    asked = _requests(spark, d)
    records = _records(spark, d).join(decisions.extents(asked).drop("run_number"), "trigger_number")
    sliced = _sliced(spark, d)
    return metrics.builder_info(records, sliced, decisions.data_requests(sliced, asked))


@query
def trb_errors(spark: SparkSession, d: str) -> DataFrame:
    asked = _requests(spark, d)
    runs = tables.decisions(spark, d).select("trigger_number", "run_number")
    odd = assembly.unexpected(asked, tables.fragments(spark, d), TRIGGER)
    return metrics.builder_errors(_records(spark, d), odd, runs, decisions.invalid(asked, F.broadcast(_routes(spark))))


@query
def trb_counters(spark: SparkSession, d: str) -> DataFrame:
    """Time-outs, late fragments, unexpected and repeated decisions and monitor requests, by run.

    Decisions reach builders as the lines of orders with the flag R do: several times, and those of customers divisible by 11 at the builder of the next run.
    """
    made = tables.decisions(spark, d)
    again = tables.read(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("trigger_number"))
    reached = made.join(again, "trigger_number").withColumn("builder_run", F.when(F.col("customer") % 11 == 0, F.col("run_number") + 1).otherwise(F.col("run_number")))
    asked, came = _timed(spark, d)
    timed = assembly.assemble_in_time(asked, came, 60 * DAY, TRIGGER).join(made.select("trigger_number", "run_number"), "trigger_number")
    samples = monitor_samples(spark, d).withColumns({"builder_run": F.lit(1995).cast("long"), "run_number": F.when(F.col("request_id") % 3 == 0, 1994).otherwise(1995).cast("long")})
    return metrics.builder_counters(reached, F.col("builder_run"), timed, samples, made)


@query
def dfo_info(spark: SparkSession, d: str) -> DataFrame:
    made = tables.decisions(spark, d)
    done = _completions(spark, d)
    return metrics.orchestrator_info(made, made, done)


@query
def application_info(spark: SparkSession, d: str) -> DataFrame:
    rows = tables.decisions(spark, d).select("trigger_number", _app().alias("app"), F.col("trigger_timestamp").alias("assigned"))
    return metrics.application_info(balance.remnants(rows, tables.fragments(spark, d)), 946_684_800_000_000)


@query
def complete_info(spark: SparkSession, d: str) -> DataFrame:
    return _completions(spark, d).select("trigger_number", "run_number", "trigger_type", F.col("latency_us").alias("completion_time"))


@query
def writer_info(spark: SparkSession, d: str) -> DataFrame:
    rows = _records(spark, d).join(tables.decisions(spark, d).select("trigger_number", "trigger_timestamp"), "trigger_number")
    return metrics.writer_info(sink.prescaled(rows, ["run_number"], ["trigger_timestamp", "trigger_number"], 10), "record_bytes")


@query
def store_info(spark: SparkSession, d: str) -> DataFrame:
    return metrics.store_info(_filled(spark, d), "record_bytes")


@query
def tp_writer_info(spark: SparkSession, d: str) -> DataFrame:
    return metrics.stream_info(tables.primitives(spark, d), _slices(spark, d))


@query
def scrape_deltas(spark: SparkSession, d: str) -> DataFrame:
    """Primitives by day as scrapes of a counter that only grows, and what each scrape adds."""
    days = slices.payload(tables.primitives(spark, d)).groupBy("run_number", F.expr(f"time_start div {DAY}").alias("scrape")).agg(F.count("*").alias("n"))
    from pyspark.sql import Window

    so_far = days.withColumn("tps_received", F.sum("n").over(Window.partitionBy("run_number").orderBy("scrape")))
    return metrics.deltas(so_far, ["run_number"], "scrape", ["tps_received"])


# checks


@query
def fragment_checks(spark: SparkSession, d: str) -> DataFrame:
    expected = spark.range(1, 8).select(F.col("id").alias("source_id"), (F.col("id") * 500).alias("min_size_bytes"), F.lit(45_000).cast("long").alias("max_size_bytes"))
    return checks.fragment_checks(tables.fragments(spark, d), expected)


@query
def record_check(spark: SparkSession, d: str) -> DataFrame:
    return checks.record_checks(_records(spark, d))


@query
def event_count_check(spark: SparkSession, d: str) -> DataFrame:
    """Against a seventh of all decisions in each run."""
    made = tables.decisions(spark, d)
    return checks.event_counts(made, F.lit(made.count() // 7))


@query
def log_run_counts(spark: SparkSession, d: str) -> DataFrame:
    """The logs that the runs would write, read back."""
    runs = tables.decisions(spark, d).groupBy("run_number").agg(F.count("*").alias("n"))
    line = lambda k, text: F.struct((F.col("run_number") * 10 + k).alias("line_number"), text.alias("line"))
    written = F.array(line(0, F.lit("Run started.")), line(1, F.concat(F.lit("INFO Sent "), F.col("n").cast("string"), F.lit(" TDs."))), line(2, F.concat(F.lit("End of run "), F.col("run_number").cast("string"))))
    return checks.log_counts(runs.select(F.lit("dfo.log").alias("file"), F.inline(written)))


@query
def fake_fragments(spark: SparkSession, d: str) -> DataFrame:
    return synth.fake_fragments(_requests(spark, d), 32, 7200).select("trigger_number", "source_id", "n_frames", "size_bytes")


# streams


@query
def stream_assembly(spark: SparkSession, d: str) -> DataFrame:
    return stream_assembly_of.replay(spark, d)


@query
def stream_timeouts(spark: SparkSession, d: str) -> DataFrame:
    """``timed_records`` as a stream in three micro-batches, and the drain at its end."""
    return stream_assembly_of.replay_in_time(*_timed(spark, d), 60 * DAY, TRIGGER)


@query
def stream_quiet_slices(spark: SparkSession, d: str) -> DataFrame:
    """``quiet_slices`` as a stream in four micro-batches, and the flush at its end."""
    rows = slices.payload(tables.primitives(spark, d)).withColumn("arrival", F.col("time_start"))
    return stream_slices_of.replay_quiet(rows, HOUR, 600_000_000)


@query
def stream_slices(spark: SparkSession, d: str) -> DataFrame:
    return stream_slices_of.replay(spark, d)


def entry(spark: SparkSession) -> DataFrame:
    return record_assembly(spark, "/root/testdata/sf0.001")


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, sql in ORACLES.items() if name in QUERIES}
