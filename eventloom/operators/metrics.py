"""Operational metrics: one row per run for each message, so that nothing is lost silently."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .decisions import by_type


def builder_info(records: DataFrame, sliced: DataFrame, asked: DataFrame) -> DataFrame:
    """records: run_number, width, requested, received. Decisions, records, requests and their widths by run."""
    a = records.groupBy("run_number").agg(F.count("*").alias("received_trigger_decisions"), F.sum("width").alias("trigger_decision_width"), F.sum("received").alias("fragments_in_the_book"), F.sum("missing").alias("pending_fragments"))
    b = sliced.groupBy("run_number").agg(F.count("*").alias("generated_trigger_records"))
    c = asked.groupBy("run_number").agg(F.count("*").alias("generated_data_requests"), F.sum(F.col("window_end") - F.col("window_begin")).alias("data_request_width"))
    return a.join(b, "run_number", "left").join(c, "run_number", "left")


def builder_errors(records: DataFrame, unexpected: DataFrame, runs: DataFrame, invalid: DataFrame) -> DataFrame:
    """Lost and unexpected fragments, abandoned records, and invalid requests by run.

    runs: trigger_number, run_number; an unexpected fragment of no known trigger is of run null.
    """
    lost = records.groupBy("run_number").agg(F.sum("missing").alias("lost_fragments"), F.count(F.when(F.col("missing") > 0, 1)).alias("abandoned_trigger_records"))
    odd = unexpected.join(runs, "trigger_number", "left").groupBy("run_number").agg(F.count("*").alias("unexpected_fragments"))
    bad = invalid.groupBy("run_number").agg(F.count("*").alias("invalid_requests"))
    out = lost.join(odd, "run_number", "left").join(bad, "run_number", "left")
    return out.na.fill(0, ["unexpected_fragments", "invalid_requests"])


def builder_counters(decided: DataFrame, run: Column, timed: DataFrame, samples: DataFrame, runs: DataFrame) -> DataFrame:
    """The builder's error and monitor counters by run.

    decided: run_number (as the decision says), builder_run (of the builder it reached), trigger_number; what is of another
    run is unexpected, and a trigger that comes again in its run is a duplicate.  timed: run_number, timed_out, late.
    samples: builder_run, run_number, trigger_number (null where no record was sent): all requests count, those of
    another run are ignored.
    """
    own = F.col("run_number").eqNullSafe(run)
    first = decided.where(own).groupBy("builder_run", "trigger_number").agg((F.count("*") - 1).alias("again")).groupBy("builder_run").agg(F.sum("again").alias("duplicated_trigger_ids"))
    odd = decided.groupBy("builder_run").agg(F.count(F.when(~own, 1)).alias("unexpected_trigger_decisions"))
    slow = timed.groupBy(F.col("run_number").alias("builder_run")).agg(F.count(F.when(F.col("timed_out"), 1)).alias("timed_out_trigger_records"), F.sum("late").alias("late_fragments"))
    asked = samples.groupBy("builder_run").agg(F.count("*").alias("received_trmon_requests"), F.count(F.when(own, F.col("trigger_number"))).alias("sent_trmon"))
    out = runs.select(F.col("run_number").alias("builder_run")).distinct()
    for part in (odd, first, slow, asked):
        out = out.join(part, "builder_run", "left")
    counters = [c for c in out.columns if c != "builder_run"]
    return out.na.fill(0, counters).withColumnRenamed("builder_run", "run_number")


def orchestrator_info(decided: DataFrame, sent: DataFrame, completed: DataFrame) -> DataFrame:
    a = decided.groupBy("run_number").agg(F.count("*").alias("decisions_received"))
    b = sent.groupBy("run_number").agg(F.count("*").alias("decisions_sent"))
    c = completed.groupBy("run_number").agg(F.count("*").alias("tokens_received"))
    return a.join(b, "run_number", "left").join(c, "run_number", "left").na.fill(0, ["decisions_sent", "tokens_received"])


def type_info(decided: DataFrame, completed: DataFrame) -> DataFrame:
    """Received and completed by run and type; a mask counts for each of its bits."""
    done = completed.select("trigger_number").distinct().withColumn("_done", F.lit(1))
    rows = by_type(decided).join(done, "trigger_number", "left")
    return rows.groupBy("run_number", "type").agg(F.count("*").alias("received"), F.count("_done").alias("completed"))


def application_info(outstanding: DataFrame, now: int) -> DataFrame:
    """outstanding: app, assigned. Decisions in flight and the time since their assignment."""
    since = F.lit(now).cast("long") - F.col("assigned")
    return outstanding.groupBy("app").agg(F.count("*").alias("outstanding_decisions"), F.sum(since).alias("total_time_since_assignment"), F.min(since).alias("min_time_since_assignment"), F.max(since).alias("max_time_since_assignment"))


def writer_info(prescaled: DataFrame, size: str) -> DataFrame:
    stored = F.col("is_stored")
    return prescaled.groupBy("run_number").agg(F.count("*").alias("records_received"), F.count(F.when(stored, 1)).alias("records_written"), F.coalesce(F.sum(F.when(stored, F.col(size))), F.lit(0)).alias("bytes_output"))


def store_info(filled: DataFrame, size: str) -> DataFrame:
    """written_files is the index of the last file, as the file counter is: 0 while on the first; bytes_in_file are those of the last file."""
    files = filled.groupBy("run_number", "file_index").agg(F.count("*").alias("n"), F.sum(size).alias("b"))
    return files.groupBy("run_number").agg(F.sum("n").alias("new_written_object"), F.sum("b").alias("new_bytes_output"), F.max("file_index").alias("written_files"), F.max_by("b", "file_index").alias("bytes_in_file"))


def stream_info(tps: DataFrame, sliced: DataFrame) -> DataFrame:
    """Heartbeats, sets and primitives received, slices and primitives written, by run."""
    beat = F.col("type") == "heartbeat"
    a = tps.groupBy("run_number").agg(F.count(F.when(beat, 1)).alias("heartbeats_received"), F.count(F.when(~beat, 1)).alias("tps_received"))
    each = sliced.groupBy("run_number", "slice_index").agg(F.sum(F.size("objects")).alias("tps"))
    b = each.groupBy("run_number").agg(F.count("*").alias("timeslices_written"), F.sum("tps").alias("tps_written"))
    return a.join(b, "run_number", "left")


def scrapes(rows: DataFrame, groups: list[str], scrape: Column, values: dict[str, Column]) -> DataFrame:
    """What each scrape interval adds to counters, one row per group and interval: the deltas of any message's totals.

    values: counter -> what a row adds to it.
    """
    return rows.groupBy(*groups, scrape.alias("scrape")).agg(*[F.sum(v).alias(c) for c, v in values.items()])


def deltas(cumulative: DataFrame, groups: list[str], order: str, values: list[str]) -> DataFrame:
    """What counters grew by since the scrape before; the first scrape counts whole. One row per scrape and group."""
    from pyspark.sql import Window

    each = Window.partitionBy(*groups).orderBy(order)
    return cumulative.select(*groups, order, *[(F.col(v) - F.coalesce(F.lag(v).over(each), F.lit(0))).alias(v) for v in values])
