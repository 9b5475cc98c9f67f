"""Load balance over builder apps: assignment, occupancy, back-pressure, latency."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import grouped_rank, running


def round_robin(decided: DataFrame, apps: DataFrame, order: list[str | Column], groups: list[str] | None = None) -> DataFrame:
    """Assigns in turn over apps in order of name; the cursor moves before it is used, so the first decision goes to the second app.

    Apps are numbered by a rank of their names and joined; only their count goes to the driver.
    """
    n = apps.select("connection_name").distinct().count()
    if not n:
        return decided.withColumns({"nth": F.lit(None).cast("long"), "connection_name": F.lit(None).cast("string")}).limit(0)
    ranked = grouped_rank(decided, groups or [], order, "_rank").withColumn("nth", F.col("_rank") + 1).drop("_rank")
    table = grouped_rank(apps.select("connection_name").distinct(), [], ["connection_name"], "_app")
    return ranked.withColumn("_app", F.col("nth") % n).join(table, "_app").drop("_app")


def occupancy(changes: DataFrame) -> DataFrame:
    """changes: app, time, delta (+1 assigned, -1 completed), trigger_number. Adds ``slots`` in use after each; completions of a time go first."""
    return running(changes, ["app"], ["time", "delta", "trigger_number"], {"slots": ("sum", "delta")})


def busy_changes(occupied: DataFrame, busy: int) -> DataFrame:
    """The rows at which an app turns busy (slots reach the threshold) or free (they fall under it)."""
    now, before = F.col("slots") >= busy, (F.col("slots") - F.col("delta")) >= busy
    return occupied.withColumn("busy", now).where(now != before)


def hysteresis(batches: Iterator[pd.DataFrame], busy: int, free: int) -> Iterator[pd.DataFrame]:
    """Fold for true hysteresis over rows sorted by app: busy from ``busy`` slots on until under ``free``."""
    app, state = None, False
    for rows in batches:
        out = []
        for a, slots in zip(rows["app"], rows["slots"]):
            if a != app:
                app, state = a, False
            state = slots >= busy or (state and slots >= free)
            out.append(state)
        yield rows.assign(busy=out)


def latencies(completions: DataFrame, most: int = 1000, since: int | Column | None = None) -> DataFrame:
    """completions: app, completed, latency_us, trigger_number. Per app: n, min, max, average of those of the newest ``most`` that completed at ``since`` or later.

    An app without completions has no row, and one without any since then has no average, so nothing is divided by zero.
    """
    newest = grouped_rank(completions, ["app"], [F.desc("completed"), F.desc("trigger_number")], "_rank").where(F.col("_rank") < most)
    if since is not None:
        newest = newest.where(F.col("completed") >= since)
    recent = newest.groupBy("app").agg(F.expr("sum(latency_us) div count(*)").alias("average_latency_us"))
    whole = completions.groupBy("app").agg(F.count("*").alias("n"), F.min("latency_us").alias("min_latency_us"), F.max("latency_us").alias("max_latency_us"))
    return whole.join(recent, "app", "left")


def used_slots(occupied: DataFrame, apps: DataFrame, at: int, busy: int) -> DataFrame:
    """The pool at a time, one row: used_slots, all_busy (true where there is no app), is_empty.

    occupied: rows of ``occupancy``, whose newest row of each app up to ``at`` counts. apps: app, a row each.
    """
    now = occupied.where(F.col("time") <= at).groupBy("app").agg(F.max_by("slots", F.struct("time", "delta", "trigger_number")).alias("_slots"))
    each = apps.select("app").distinct().join(now, "app", "left").select(F.coalesce("_slots", F.lit(0).cast("long")).alias("s"))
    return each.agg(
        F.coalesce(F.sum("s"), F.lit(0)).alias("used_slots"), F.coalesce(F.bool_and(F.col("s") >= busy), F.lit(True)).alias("all_busy"), F.coalesce(F.bool_and(F.col("s") == 0), F.lit(True)).alias("is_empty")
    )


def capacity(latency: DataFrame, busy: int, free: int) -> DataFrame:
    """Decisions a second that an app can take: 0.5 (busy + free) over half the sum of least and largest completion time."""
    rate = F.lit(0.5 * (busy + free)) / (F.lit(0.5e-6) * (F.col("min_latency_us") + F.col("max_latency_us")))
    return latency.withColumn("capacity_rate", F.when(F.col("min_latency_us") + F.col("max_latency_us") > 0, rate))


def remnants(assigned: DataFrame, completed: DataFrame) -> DataFrame:
    """Assignments that no token completes."""
    return assigned.join(completed.select("trigger_number").distinct(), "trigger_number", "left_anti")


def lag_inhibit(marks: DataFrame, groups: list[str], order: list[str], threshold: int) -> DataFrame:
    """marks: started, ended (each null where the row isn't of that kind). Every row with ``lag``, ``busy``, and ``turned`` where busy differs from before it.

    On iff the latest started isn't below the latest ended and leads by the threshold or more; off before the first row.
    """
    at = running(marks, groups, order, {"latest_started": ("max", "started"), "latest_ended": ("max", "ended"), "_started": ("max_before", "started"), "_ended": ("max_before", "ended")})
    lead = lambda a, b: F.coalesce(a, F.lit(0)) - F.coalesce(b, F.lit(0))
    busy = lambda x: (x >= 0) & (x >= threshold)
    now, before = lead("latest_started", "latest_ended"), lead("_started", "_ended")
    known = F.col("_started").isNotNull() | F.col("_ended").isNotNull()
    return at.withColumns({"lag": now, "busy": busy(now), "turned": busy(now) != (known & busy(before))}).drop("_started", "_ended")


def inhibit_edges(marks: DataFrame, groups: list[str], order: list[str], threshold: int) -> DataFrame:
    """The rows at which the inhibit turns on or off, which are the messages that are sent."""
    return lag_inhibit(marks, groups, order, threshold).where("turned").drop("turned")


class Balancer:
    """The orchestrator's sequential policy for one run: back-pressure, failed sends, reconnects.

    ``find`` moves the cursor before testing, skips apps in error, takes the first that isn't busy, else the
    least used (first seen wins); ``dispatch`` retries a failed send and then marks the app in error.
    """

    def __init__(self, apps: list[str], busy: int, free: int | None = None, retries: int = 5):
        if free is not None and busy < free:
            raise ValueError("busy_threshold is below free_threshold")
        self.apps = sorted(apps)
        self.limit, self.free, self.retries = busy, busy if free is None else free, retries
        self.held: dict[str, set[int]] = {a: set() for a in self.apps}
        self.error = dict.fromkeys(self.apps, False)
        self.full = dict.fromkeys(self.apps, False)
        self.cursor = 0

    def is_busy(self, app: str) -> bool:
        return self.error[app] or self.full[app]

    @property
    def all_busy(self) -> bool:
        return all(map(self.is_busy, self.apps))

    def _note(self, app: str) -> None:
        n = len(self.held[app])
        self.full[app] = n >= self.limit or (self.full[app] and n >= self.free)

    def register(self, app: str) -> None:
        if app not in self.held:
            self.apps = sorted([*self.apps, app])
            self.held[app], self.full[app] = set(), False
        self.error[app] = False

    def find(self) -> tuple[str | None, bool]:
        least: str | None = None
        for _ in self.apps:
            self.cursor = (self.cursor + 1) % len(self.apps)
            app = self.apps[self.cursor]
            if self.error[app]:
                continue
            if not self.is_busy(app):
                return app, False
            if least is None or len(self.held[app]) < len(self.held[least]):
                least = app
        if least is not None:
            self.cursor = self.apps.index(least)
        return least, least is not None

    def assign(self, trigger: int, reachable=lambda app, attempt: True) -> tuple[str | None, str, int]:
        """App, outcome (sent, sent_to_busy, unable), attempts."""
        attempts = 0
        while True:
            app, busy = self.find()
            if app is None:
                return None, "unable", attempts
            for k in range(max(1, self.retries)):
                attempts += 1
                if reachable(app, k):
                    self.held[app].add(trigger)
                    self._note(app)
                    return app, "sent_to_busy" if busy else "sent", attempts
            self.error[app] = True

    def complete(self, app: str, trigger: int) -> str:
        if app not in self.held:
            return "unknown_app"
        if trigger not in self.held[app]:
            return "unknown_trigger"
        self.held[app].remove(trigger)
        self.error[app] = False
        self._note(app)
        return "completed"


def balanced(events: DataFrame, apps: list[str], busy: int, free: int | None = None, policy: Callable[[], Balancer] | None = None) -> DataFrame:
    """events: run_number, time, kind (0 completion, 1 decision), trigger_number. Decisions with app, outcome, slots.

    ``policy`` makes a run's own balancer, as a class derived from ``Balancer`` with another ``find`` or ``is_busy``.

    A run has one orchestrator, whose next choice depends on all before: its events go in order through one
    task as a stream, with state only for what is outstanding.  Runs spread over tasks.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        make = policy or (lambda: Balancer(apps, busy, free))
        run, state, where = None, None, {}
        for rows in batches:
            out = []
            for r, t, kind, trigger in rows.itertuples(index=False):
                if r != run:
                    run, state, where = r, make(), {}
                if kind == 0:
                    if trigger in where:
                        state.complete(where.pop(trigger), trigger)
                    continue
                app, outcome, _ = state.assign(trigger)
                if app:
                    where[trigger] = app
                out.append((r, trigger, t, app, outcome, len(state.held[app]) if app else 0))
            yield pd.DataFrame(out, columns=["run_number", "trigger_number", "time", "app", "outcome", "slots"])

    order = ["run_number", "time", "kind", "trigger_number"]
    sorted_ = events.select(*order).repartition("run_number").sortWithinPartitions(*order)
    return sorted_.mapInPandas(fold, "run_number long, trigger_number long, time long, app string, outcome string, slots long")
