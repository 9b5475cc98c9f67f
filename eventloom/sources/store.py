"""Data stores by name, run preparation, the space guard, and listing of what was written."""

from __future__ import annotations

import re
import shutil
from abc import ABC, abstractmethod
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sink import event_files, rollover
from .scratch import staged
from .tables import RunConfig


class StoreProblem(Exception):
    """A store can't do what it is asked."""


class RetryableProblem(StoreProblem):
    """It may work later, as when space is short."""


class IgnorableProblem(StoreProblem):
    """Nothing is lost if this is passed over, as when a slice is there already."""


class DataStore(ABC):
    @abstractmethod
    def prepare_for_run(self, run: int, is_test: bool) -> None: ...

    @abstractmethod
    def write_records(self, records: DataFrame) -> None: ...

    @abstractmethod
    def write_slices(self, slices: DataFrame) -> None: ...

    @abstractmethod
    def finish_with_run(self, run: int) -> None: ...


_stores: dict[str, Callable[..., DataStore]] = {}


def register(name: str):
    def add(kind: Callable[..., DataStore]) -> Callable[..., DataStore]:
        _stores[name] = kind
        return kind

    return add


def make_data_store(name: str, **settings) -> DataStore:
    if name not in _stores:
        raise StoreProblem(f"unknown data store {name}")
    return _stores[name](**settings)


def free_space(path: str) -> int:
    """Free bytes of a local path; 0 if there is none."""
    try:
        return shutil.disk_usage(path.removeprefix("file://")).free
    except OSError:
        return 0


def require_space(free: int, size: int, factor: float) -> None:
    if free < max(factor, 1.1) * size:
        raise RetryableProblem(f"{free} bytes free, {size} to write")


@register("parquet")
@dataclass
class ParquetStore(DataStore):
    """Records and slices as Parquet, in folders by run and file index; Spark's commit publishes them at once.

    Local paths are checked for space before a run and before each write; other file systems check
    themselves.
    """

    spark: SparkSession
    directory: str
    config: RunConfig = field(default_factory=RunConfig)
    offline_data_stream: str = ""
    run: int | None = None
    is_test: bool = False
    #: Index of the file that is open, and the bytes in it; what was written in the run so far.
    at: tuple[int, int] = (0, 0)
    written: dict[str, int] = field(default_factory=dict)

    def _local(self) -> bool:
        return self.directory.startswith(("/", "file:"))

    def prepare_for_run(self, run: int, is_test: bool) -> None:
        if self._local():
            space = free_space(self.directory)
            if not space:
                raise StoreProblem(f"invalid path {self.directory}")
            require_space(space, self.config.max_file_size, 1.1)
        self.run, self.is_test, self.at = run, is_test, (0, 0)
        self.written = {"records_written": 0, "bytes_output": 0, "records_of_other_runs": 0}

    def _write(self, rows: DataFrame, kind: str, by: list[str]) -> None:
        if self.run is None:
            raise StoreProblem("no run is prepared")
        marks = {"op_env": F.lit(self.config.op_env), "offline_data_stream": F.lit(self.offline_data_stream), "run_was_for_test_purposes": F.lit(self.is_test)}
        rows.withColumns(marks).write.mode("append").partitionBy(*by).parquet(f"{self.directory}/{kind}")

    def write_records(self, records: DataFrame, order: list[str] | None = None, size: str = "record_bytes") -> None:
        """Checks the space, gives each record its file (by size, and by trigger in mode one-event-per-file), writes, and counts.

        Records of other runs aren't written, and are counted.  ``order``: arrival; by default the columns of the record's key
        that there are.  Files go on where the write before left off.
        """
        if self.run is None:
            raise StoreProblem("no run is prepared")
        order = order or [c for c in ("trigger_number", "sequence_number") if c in records.columns]
        own = F.col("run_number").eqNullSafe(self.run)
        n, other, largest, total = records.agg(F.count(F.when(own, 1)), F.count(F.when(~own, 1)), F.coalesce(F.max(F.when(own, F.col(size))), F.lit(0)), F.coalesce(F.sum(F.when(own, F.col(size))), F.lit(0))).first()
        self.written["records_of_other_runs"] += other
        if not n:
            return
        if self._local():
            require_space(free_space(self.directory), int(largest), self.config.free_space_safety_factor)
        most = self.config.max_file_size
        if self.config.mode == "one-event-per-file":
            filled = event_files(records.where(own), ["run_number"], order, size, most)
            opened = self.at[0] + (self.at[1] > 0)
            filled = filled.withColumn("file_index", F.col("file_index") + opened)
        else:
            filled = rollover(records.where(own), ["run_number"], order, size, most, self.at)
        filled = staged(filled, "filled")
        self._write(filled, "records", ["run_number", "file_index"])
        last = filled.groupBy("file_index").agg(F.sum(size).alias("b")).agg(F.max("file_index").alias("k"), F.max_by("b", "file_index").alias("b")).first()
        self.at = (last["k"], last["b"] + (self.at[1] if last["k"] == self.at[0] else 0))
        self.written["records_written"] += n
        self.written["bytes_output"] += int(total)

    def write_slices(self, slices: DataFrame) -> None:
        """Writes slices whose numbers their run hasn't yet; only that run's folder is looked at."""
        key = ["run_number", "slice_number"]
        there = self.listed("slices")
        runs = [r[0] for r in slices.select("run_number").distinct().collect()]
        if there is not None and slices.join(there.where(F.col("run_number").isin(runs)).select(*key), key, "left_semi").limit(1).count():
            raise IgnorableProblem("a slice of this number is there already")
        self._write(slices, "slices", ["run_number"])

    def listed(self, kind: str) -> DataFrame | None:
        """What is stored of a kind; None if nothing is yet."""
        try:
            return self.spark.read.parquet(f"{self.directory}/{kind}")
        except Exception as missing:
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            return None

    def finish_with_run(self, run: int) -> None:
        if run == self.run:
            self.run = None


def matching_files(spark: SparkSession, directory: str, pattern: str) -> list[str]:
    """Names of the files right in a folder that match a pattern as a whole, in order; a folder without files has none."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(directory)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(at) if s.isFile()]
    return sorted(n for n in names if re.fullmatch(pattern, n))


def dataset_paths(spark: SparkSession, directory: str) -> DataFrame:
    """Paths of all data files below a folder, relative to it, with their sizes."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(directory)
    return rows.select(F.regexp_extract("path", f"{re.escape(directory.removeprefix('file://').rstrip('/'))}/(.*)$", 1).alias("path"), "length")
