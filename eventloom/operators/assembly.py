"""Event building: fragments join their records; records are complete, incomplete or empty.

A record's key is its run, trigger and sequence: a trigger number may come again in another run, and a long
decision is cut into sequences.  ``record`` names the key's columns for tables that have fewer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import first_rows, grouped_rank, running

RECORD = ["run_number", "trigger_number", "sequence_number"]


def status(requested: Column, received: Column) -> Column:
    return F.when(received == requested, "complete").when(received == 0, "empty").otherwise("incomplete")


def _per_source(requests: DataFrame, fragments: DataFrame, record: list[str], also: list[str]) -> DataFrame:
    """One row per record and source: whether asked for, fragments, bytes. One shuffle, combined before it."""
    key = [*record, "source_id"]
    none = F.lit(0).cast("long")
    asked = requests.select(*key, *also, F.lit(1).alias("asked"), none.alias("came"), none.alias("size_bytes"))
    came = fragments.select(*key, *[F.lit(None).cast(requests.schema[c].dataType).alias(c) for c in also], F.lit(0).alias("asked"), F.lit(1).cast("long").alias("came"), "size_bytes")
    return asked.unionByName(came).groupBy(*key).agg(*[F.max(c).alias(c) for c in also], F.max("asked").alias("asked"), F.sum("came").alias("came"), F.sum("size_bytes").alias("size_bytes"))


def assemble(requests: DataFrame, fragments: DataFrame, record: list[str] = RECORD, also: list[str] | None = None) -> DataFrame:
    """One row per record asked for: its key, columns ``also`` of its requests, requested, received (sources that sent), missing, record_bytes, status.

    A source counts once however many fragments it sends; fragments that nobody asked for don't count.
    """
    rows = _per_source(requests, fragments, record, also or []).where("asked = 1")
    received = F.count(F.when(F.col("came") > 0, 1))
    out = rows.groupBy(*record).agg(*[F.max(c).alias(c) for c in also or []], F.count("*").alias("requested"), received.alias("received"), F.sum("size_bytes").alias("record_bytes"))
    return out.withColumn("missing", F.col("requested") - F.col("received")).withColumn("status", status(F.col("requested"), F.col("received")))


def unexpected(requests: DataFrame, fragments: DataFrame, record: list[str] = RECORD) -> DataFrame:
    """Fragments whose record didn't ask for their source."""
    key = [*record, "source_id"]
    return fragments.join(requests.select(*key), key, "left_anti")


def placed_fragments(requests: DataFrame, fragments: DataFrame, order: list[str | Column], record: list[str] = RECORD) -> DataFrame:
    """Fragments of asked sources with ``nth`` (from 1, by arrival in their record) and ``is_late``: it came when the record was full.

    These are the rows of a record's children; nothing gathers a record, so one of any size is no trouble.
    """
    key = [*record, "source_id"]
    asked = requests.groupBy(*record).agg(F.count("*").alias("_requested"))
    known = fragments.join(requests.select(*key), key, "left_semi")
    nth = grouped_rank(known, record, order, "_rank").withColumn("nth", F.col("_rank") + 1).drop("_rank")
    return nth.join(asked, record).withColumn("is_late", F.col("nth") > F.col("_requested")).drop("_requested")


def assemble_by_count(requests: DataFrame, fragments: DataFrame, order: list[str | Column], record: list[str] = RECORD) -> DataFrame:
    """Completion by count: fragments of asked sources fill a record in order of arrival; what comes after it is full is late.

    One row per record: requested, received, late, status.  Two fragments of one source both count.
    """
    asked = requests.groupBy(*record).agg(F.count("*").alias("requested"))
    placed = placed_fragments(requests, fragments, order, record)
    each = placed.groupBy(*record).agg(F.count(F.when(~F.col("is_late"), 1)).alias("received"), F.count(F.when(F.col("is_late"), 1)).alias("late"))
    out = asked.join(each, record, "left").na.fill(0, ["received", "late"])
    return out.select(*record, "requested", "received", "late", status(F.col("requested"), F.col("received")).alias("status"))


def with_fragments(requests: DataFrame, fragments: DataFrame, order: list[str | Column], fields: list[str], record: list[str] = RECORD) -> DataFrame:
    """Whole records by count: requested, received, missing, status, and ``fragments``, an array of (nth, source_id, *fields) by arrival.

    A record holds at most as many fragments as it asked for, so its list is bounded by its own request.
    """
    asked = requests.groupBy(*record).agg(F.count("*").alias("requested"))
    own = placed_fragments(requests, fragments, order, record).where(~F.col("is_late"))
    lists = own.groupBy(*record).agg(F.sort_array(F.collect_list(F.struct("nth", "source_id", *fields))).alias("fragments"))
    out = asked.join(lists, record, "left")
    empty = F.array().cast(lists.schema["fragments"].dataType)
    received = F.coalesce(F.size("fragments"), F.lit(0)).cast("long")
    out = out.withColumns({"received": F.when(F.col("fragments").isNull(), F.lit(0).cast("long")).otherwise(received), "fragments": F.coalesce("fragments", empty)})
    return out.withColumns({"missing": F.col("requested") - F.col("received"), "status": status(F.col("requested"), F.col("received"))})


def assemble_in_time(requests: DataFrame, fragments: DataFrame, timeout: int, record: list[str] = RECORD) -> DataFrame:
    """Assembly with a time-out: requests have ``created``, fragments ``arrival``, in the same ticks.

    A record ends when its last source has come, or once more than ``timeout`` ticks have passed since it was
    created (0: never).  What comes later is late: it belongs to no record.  A source that came before the decision counts.
    One row per record: requested, received, missing, ended (null: still open), timed_out, late (fragments of asked sources), status.
    """
    key = [*record, "source_id"]
    none = F.lit(None).cast("long")
    asked = requests.select(*key, F.col("created").cast("long"), none.alias("arrival"), F.lit(0).alias("came"))
    came = fragments.select(*key, none.alias("created"), F.col("arrival").cast("long"), F.lit(1).alias("came"))
    sources = asked.unionByName(came).groupBy(*key).agg(F.max("created").alias("created"), F.min("arrival").alias("first"), F.count(F.when(F.col("came") == 1, 1)).alias("n")).where("created is not null")
    in_time = F.col("first") - F.col("created") <= timeout if timeout > 0 else F.col("first").isNotNull()
    each = sources.groupBy(*record).agg(
        F.max("created").alias("created"), F.count("*").alias("requested"), F.count(F.when(in_time, 1)).alias("received"), F.max(F.when(in_time, F.col("first"))).alias("_last"), F.sum("n").alias("_n")
    )
    whole = F.col("received") == F.col("requested")
    ended = F.when(whole, F.greatest("_last", "created"))
    if timeout > 0:
        ended = F.coalesce(ended, F.col("created") + timeout)
    each = each.withColumn("ended", ended)
    # a record without an end takes all that comes
    late = fragments.select(*key, F.col("arrival").cast("long").alias("arrival")).join(requests.select(*key), key, "left_semi")
    late = late.join(each.select(*record, "ended"), record).where("arrival > ended").groupBy(*record).agg(F.count("*").alias("late"))
    out = each.join(late, record, "left").withColumn("late", F.coalesce("late", F.lit(0)))
    return out.select(
        *record, "requested", "received", (F.col("requested") - F.col("received")).alias("missing"), "ended", (F.lit(timeout > 0) & ~whole).alias("timed_out"), "late", status(F.col("requested"), F.col("received")).alias("status")
    )


def route_fragments(requests: DataFrame, fragments: DataFrame, latest: str, fragment_order: list[str], record: list[str] = RECORD) -> DataFrame:
    """Consume-once routing: of a key's requests the one with the greatest ``latest`` takes the first fragment; ``outcome`` names what is left over.

    outcome: sent; unknown_destination (no request, or a later fragment of a key); unanswered (a request without fragment).
    The least destination settles requests that tie.
    """
    key = [*record, "source_id"]
    last = requests.groupBy(*key).agg(F.min_by("destination", F.struct(-F.col(latest), "destination")).alias("destination"))
    nth = grouped_rank(fragments, key, fragment_order, "_n")
    met = last.withColumn("_n", F.lit(0).cast("long")).join(nth, [*key, "_n"], "full")
    outcome = F.when(F.col("destination").isNull(), "unknown_destination").when(F.col("size_bytes").isNull(), "unanswered").otherwise("sent")
    return met.select(*key, "destination", "size_bytes", outcome.alias("outcome"))


def monitor_samples(records: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each request the first record of exactly its type at or after its time; one record may serve many.

    wanted: request_id, trigger_type, since.  Records and requests are sorted together by type and falling time,
    and each request takes the newest record seen so far: no record meets more than its neighbours.
    """
    at = F.struct(F.col("trigger_timestamp").alias("t"), F.col("trigger_number").alias("n"))
    none = F.lit(None)
    firsts = first_rows(records.select("trigger_type", "trigger_timestamp", "trigger_number"), ["trigger_type", "trigger_timestamp"], ["trigger_number"])
    a = firsts.select("trigger_type", F.col("trigger_timestamp").alias("time"), F.lit(0).alias("kind"), none.cast(wanted.schema["request_id"].dataType).alias("request_id"), at.alias("r"))
    b = wanted.select("trigger_type", F.col("since").alias("time"), F.lit(1).alias("kind"), "request_id", none.cast(a.schema["r"].dataType).alias("r"))
    met = running(a.unionByName(b), ["trigger_type"], [F.desc("time"), F.asc("kind"), F.asc("request_id")], {"first": ("last", "r")}).where("kind = 1")
    return met.select("request_id", "trigger_type", F.col("first.t").alias("trigger_timestamp"), F.col("first.n").alias("trigger_number"))
