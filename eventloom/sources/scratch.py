"""Tables and files that a job keeps between two of its steps.

They live in the folder that the cluster names in ``spark.checkpoint.dir``, which the driver and
all executors share, so a lost executor loses nothing that a later step reads.  A folder of our own
is used only where that setting is absent, and only with a local master (as in tests).
"""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Rows that Python workers get at a time: texts are long, and a worker holds a batch in several forms.
ARROW_ROWS = 1500

_own: list[str] = []
_record: ContextVar[list[str] | None] = ContextVar("made", default=None)


def prepare(spark: SparkSession) -> None:
    """Settings of a job over long texts: small batches for Python workers, which find this package where the driver did."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    here = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    there = spark.sparkContext.environment.get("PYTHONPATH", "")
    if here not in there.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [here, there]))


def shared_folder(spark: SparkSession) -> str:
    """URI of the shared folder, without a slash at its end; a path without scheme is one of the default file system."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if there:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(there)
        whole = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString()
        return re.sub(r"^file:/(?!/)", "file:///", whole).rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="eventloom-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return f"file://{_own[0]}"


def new_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that nothing else uses."""
    path = f"{shared_folder(spark)}/scratch/{name}-{uuid.uuid4().hex}"
    if (made := _record.get()) is not None:
        made.append(path)
    return path


def staged(df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    """Writes df once and returns the table as read back: later steps start from it, not from df's lineage."""
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*by) if by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, path: str) -> None:
    """Deletes a scratch path through Hadoop's file system, wherever the shared folder is."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def recording() -> Iterator[list[str]]:
    """The scratch paths that are made inside, by this thread; whoever records owns them and may drop them when nothing reads them any more."""
    made: list[str] = []
    token = _record.set(made)
    try:
        yield made
    finally:
        _record.reset(token)
