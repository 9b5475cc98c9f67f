"""Record assembly over streams.

``updates`` keeps per record which sources were asked for and which came, as sets in Spark's own aggregation
state; ``emitted`` is the keyed state machine that emits a record once, when it is complete or when it is too
old, and tells late fragments apart.  Open state isn't flushed when a stream ends: ``flushed`` adds what is left.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.assembly import RECORD, assemble_in_time, status
from ..sources import tables
from ..sources.scratch import new_path, staged

#: A bucket's records as one value: key -> asked, came, created, ended, last.
_STATE = "records binary"
#: Keyed states over which the records of a stream are dealt.
BUCKETS = 2048
#: Rows of a file of a replayed stream.
FILE_ROWS = 1_000_000


def _as_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    kind = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    # a pattern, because the table may be a file or a folder of files
    return spark.readStream.schema(kind).parquet(f"{sf_dir}/{name}.parque[t]")


def events(requests: DataFrame, fragments: DataFrame, record: list[str] = RECORD) -> DataFrame:
    """Both inputs as one table: the record's key, asked and came (the source, in one of the two)."""
    none = F.lit(None).cast("long")
    asked = requests.select(*record, F.col("source_id").alias("asked"), none.alias("came"))
    came = fragments.select(*record, none.alias("asked"), F.col("source_id").alias("came"))
    return asked.unionByName(came)


def updates(rows: DataFrame, record: list[str] = RECORD) -> DataFrame:
    """A record's standing, again at every change (output mode update). Any source numbers; the sets are as large as a record's sources."""
    each = rows.groupBy(*record).agg(F.collect_set("asked").alias("_asked"), F.collect_set("came").alias("_came")).where("size(_asked) > 0")
    requested = F.size("_asked").cast("long")
    received = F.size(F.array_intersect("_asked", "_came")).cast("long")
    return each.select(*record, requested.alias("requested"), received.alias("received"), (requested - received).alias("missing"), status(requested, received).alias("status"))


def timed_events(requests: DataFrame, fragments: DataFrame, record: list[str] = RECORD) -> DataFrame:
    """Decisions and fragments as one table of messages: the record's key, asked (a decision's sources, one row each record), came (a source), at.

    ``at`` is when the decision was made (``created``) or the fragment came (``arrival``), in microseconds.
    """
    asked = requests.groupBy(*record).agg(F.array_sort(F.collect_set("source_id")).alias("asked"), F.lit(None).cast("long").alias("came"), F.min("created").alias("at"))
    came = fragments.select(*record, F.lit(None).cast("array<long>").alias("asked"), F.col("source_id").alias("came"), F.col("arrival").alias("at"))
    return asked.unionByName(came)


def emitted(rows: DataFrame, timeout: int, record: list[str] = RECORD, remember: int = 0, clock: str = "event", buckets: int = BUCKETS) -> DataFrame:
    """Emits each record once: complete when its last source comes, else as it stands once more than ``timeout`` microseconds have passed since it was created (0: never).

    rows: as from ``timed_events``.  The time-out counts from the decision, not from the last fragment.  What comes for a
    record that has ended is late and gives rows of status ``late`` at once, with their number.  That a record has
    ended is remembered for ``remember`` microseconds after its end (0: always); a fragment after that opens a state that holds
    it for a decision that may still come.

    clock ``event``: time is ``at``, as far as the watermark on the column ``time`` (a timestamp) has gone, so a replay gives
    the same; ``processing``: the wall clock, ``at`` is not used, and a record is created when its decision is read.

    Records are kept in ``buckets`` keyed states by their hash, so a micro-batch calls Python once for each bucket, not for each record.
    """
    if clock not in ("event", "processing"):
        raise ValueError(f"unknown clock {clock}")
    names = [*record, "requested", "received", "missing", "late", "timed_out", "status"]
    timed = timeout > 0 or remember > 0
    nothing = (frozenset(), frozenset(), None, False, None)

    def due(created: int | None, ended: bool, last: int | None) -> int | None:
        if ended:
            return last + remember if remember else None
        return created + timeout if created is not None and timeout > 0 else None

    def step(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = pickle.loads(zlib.decompress(state.get[0])) if state.exists else {}
        now = state.getCurrentProcessingTimeMs() * 1000
        # timers have gone off up to here, in milliseconds
        reached = None if not timed else state.getCurrentWatermarkMs() if clock == "event" else now // 1000
        out, touched = [], set()

        def end(key: tuple, asked: set, came: set, timed_out: bool) -> None:
            n, m = len(asked), len(asked & came)
            out.append((*key, n, m, n - m, 0, timed_out, "complete" if m == n else "incomplete" if m else "empty"))

        if not state.hasTimedOut:
            got = pd.concat(list(batches), ignore_index=True)
            # of one time, decisions go first
            got = got.sort_values(["at", "came"] if clock == "event" else ["came"], kind="stable")
            keys = zip(*(got[c] for c in record))
            if got["_nulls"].any():
                keys = (tuple(None if n >> k & 1 else x for k, x in enumerate(key)) for key, n in zip(keys, got["_nulls"]))
            messages: dict[tuple, list] = {}
            for key, a, c, at in zip(keys, got["asked"], got["came"], got["at"]):
                messages.setdefault(key, []).append((a, c, at))
            for key, each in messages.items():
                touched.add(key)
                asked, came, created, ended, last = held.get(key, nothing)
                asked, came, late = set(asked), set(came), 0
                for a, c, at in each:
                    at = int(at) if clock == "event" else now
                    if not ended and created is not None and timeout > 0 and at - created > timeout:
                        end(key, asked, came, True)
                        ended, last = True, created + timeout
                    if ended and remember and at - last > remember:
                        asked, came, created, ended, last = set(), set(), None, False, None
                    if a is not None:
                        if not ended:
                            asked.update(map(int, a))
                            created = at if created is None else created
                    elif ended:
                        # what comes at the very time of the end is in time
                        late += int(c) in asked and (clock != "event" or at > last)
                    else:
                        came.add(int(c))
                        last = at if last is None else max(last, at)
                    if not ended and asked and asked <= came:
                        end(key, asked, came, False)
                        ended, last = True, at
                if late:
                    out.append((*key, len(asked), 0, 0, late, False, "late"))
                held[key] = (frozenset(asked), frozenset() if ended else frozenset(came), created, ended, last)
        first = None
        if timed:
            for key, (asked, came, created, ended, last) in list(held.items()):
                at = due(created, ended, last)
                # a record that had messages waits for the next time at least, as one with a timer of its own would
                if at is not None and key not in touched and (at // 1000 < reached if clock == "event" else at // 1000 <= reached):
                    if ended:
                        del held[key]
                        continue
                    end(key, asked, came, True)
                    ended, last = True, created + timeout
                    held[key] = (asked, frozenset(), created, ended, last)
                    at = due(created, ended, last)
                if at is not None and (first is None or at < first):
                    first = at
        if held:
            state.update((zlib.compress(pickle.dumps(held, 5), 1),))
            if first is not None:
                if clock == "event":
                    state.setTimeoutTimestamp(max(first // 1000, reached + 1))
                else:
                    state.setTimeoutDuration(max(1, first // 1000 - reached))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=names, dtype=object)

    kinds = T.StructType([rows.schema[c] for c in record] + [T.StructField(n, T.LongType()) for n in names[len(record) : -2]] + [T.StructField("timed_out", T.BooleanType()), T.StructField("status", T.StringType())])
    mode = (GroupStateTimeout.EventTimeTimeout if clock == "event" else GroupStateTimeout.ProcessingTimeTimeout) if timed else GroupStateTimeout.NoTimeout
    # integers with nulls would be floats in pandas
    nulls = sum((F.when(F.col(c).isNull(), 1 << k).otherwise(0) for k, c in enumerate(record)), F.lit(0))
    dealt = rows.withColumns({"_bucket": F.pmod(F.xxhash64(*record), F.lit(buckets)), "_nulls": nulls})
    dealt = dealt.withColumns({c: F.coalesce(c, F.lit(0).cast(rows.schema[c].dataType)) for c in record if isinstance(rows.schema[c].dataType, T.IntegralType)})
    dealt = dealt.withColumn("came", F.coalesce("came", F.lit(-(1 << 63))))
    return dealt.groupBy("_bucket").applyInPandasWithState(step, kinds, _STATE, "append", mode)


def flushed(rows: DataFrame, done: DataFrame, record: list[str] = RECORD) -> DataFrame:
    """The drain at the end of a run, as a batch: emitted records, and all others as they stand."""
    rest = updates(rows.join(done.select(*record), record, "left_anti"), record)
    return done.unionByName(rest)


def run_now(stream: DataFrame, mode: str = "append", name: str = "emitted") -> DataFrame:
    """Runs a stream over what is there now, in as many micro-batches as its source makes, and returns all that it emitted."""
    spark = stream.sparkSession
    path = new_path(spark, name)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    run = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", new_path(spark, "offsets")).trigger(availableNow=True).start()
    run.awaitTermination()
    if run.lastProgress is None:
        return spark.createDataFrame([], stream.schema.add("batch", "long"))
    return spark.read.schema(stream.schema.add("batch", "long")).parquet(path)


def last_updates(stream: DataFrame, key: list[str]) -> DataFrame:
    """Runs an update-mode stream over what is there now and returns the last row of each key."""
    rest = [c for c in stream.columns if c not in key]
    back = run_now(stream, "update", "updates")
    return back.groupBy(*key).agg(F.max_by(F.struct(*rest), "batch").alias("_last")).select(*key, "_last.*")


def in_order(rows: DataFrame, at: str, files: int) -> DataFrame:
    """The rows as a stream of so many micro-batches in the order of ``at``; rows of one time are in one of them.

    The bounds are quantiles.  Each micro-batch is the same number of files, as many as the largest needs at ``FILE_ROWS`` rows each.
    """
    spark = rows.sparkSession
    path = new_path(spark, "stream")
    whole = staged(rows, "events")
    bounds = sorted(set(whole.approxQuantile(at, [k / files for k in range(1, files)], 0.001))) if files > 1 else []
    nth = sum((F.when(F.col(at) > b, 1).otherwise(0) for b in bounds), F.lit(0))
    laid = staged(whole.withColumn("_file", nth), "ordered", ["_file"])
    most = laid.groupBy("_file").count().agg(F.max("count")).first()[0] or 0
    each = max(1, -(-most // FILE_ROWS))
    for k in range(files):  # one after the other: a file source takes files in the order in which they were made
        laid.where(F.col("_file") == k).drop("_file").repartition(each).write.mode("append").parquet(path)
        # a task without rows writes no file
        for _ in range((k + 1) * each - len(spark.read.schema(rows.schema).parquet(path).inputFiles())):
            rows.limit(0).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", each).parquet(path)


def replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Record assembly with both tables read as streams."""
    orders, lines = _as_stream(spark, sf_dir, "orders"), _as_stream(spark, sf_dir, "lineitem")
    decided = orders.select(F.col("o_orderkey").alias("trigger_number"), F.year("o_orderdate").cast("long").alias("run_number"), tables.ticks("o_orderdate").alias("trigger_timestamp"))
    came = lines.select(F.col("l_orderkey").alias("trigger_number"), F.col("l_linenumber").cast("long").alias("source_id"))
    key = ["trigger_number"]
    return last_updates(updates(events(tables.requests(decided), came, key), key), key)


def replay_in_time(requests: DataFrame, fragments: DataFrame, timeout: int, record: list[str] = RECORD, batches: int = 3) -> DataFrame:
    """``emitted`` over a replay in micro-batches, and at its end the drain: the columns of ``assemble_in_time`` but ``ended``.

    The same whatever the number of micro-batches: files come in order of time, and within one the rows are sorted.
    Times must be after 1970-01-01, where Spark's watermark begins.
    """
    rows = timed_events(requests, fragments, record)
    stream = in_order(rows, "at", batches).withColumn("time", F.timestamp_micros("at")).withWatermark("time", "0 seconds")
    got = run_now(emitted(stream, timeout, record)).drop("batch")
    late = got.where("status = 'late'").groupBy(*record).agg(F.sum("late").alias("late"))
    done = got.where("status <> 'late'").drop("late").join(late, record, "left").withColumn("late", F.coalesce("late", F.lit(0).cast("long")))
    names = [*record, "requested", "received", "missing", "timed_out", "late", "status"]
    left = assemble_in_time(requests.join(done.select(*record), record, "left_anti"), fragments, timeout, record)
    return done.select(*names).unionByName(left.select(*names))
