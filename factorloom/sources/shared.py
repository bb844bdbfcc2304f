"""Tables written to the folder that the driver and all executors share, and views that are written once."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Where tables go in a local session that names no shared folder (tests).
LOCAL_SHARED = "/tmp/checkpoints"

View = Callable[[SparkSession, str], DataFrame]
_WRITTEN: dict[tuple, tuple[str, DataFrame]] = {}


def new_path(spark: SparkSession) -> str:
    """A new path under spark.checkpoint.dir. Only a local session may go without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{LOCAL_SHARED}"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def stored_path(spark: SparkSession, name: str) -> str:
    """The path under the shared folder that belongs to a name in this application: the same at every call."""
    own = uuid.uuid5(uuid.NAMESPACE_URL, f"{spark.sparkContext.applicationId} {name}").hex
    return f"{new_path(spark).rsplit('/', 1)[0]}/{own}"


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = path or new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def state(spark: SparkSession, path: str) -> tuple[int, int, int]:
    """Files, bytes and time of change of a table, by which a view knows that its input is another."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    summary = fs.getContentSummary(at)
    return summary.getFileCount(), summary.getLength(), fs.getFileStatus(at).getModificationTime()


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a table was written whole at a path."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def saved(*tables: str) -> Callable[[View], View]:
    """A view of these tables that is computed once a session and input, written, and read from then on.

    Such views are much smaller than the tables: daily and monthly sums by code or series. Building a query that
    reads one runs the job that writes it. If a table changes, the view is written anew; the old one stays in
    the shared folder until that is cleared.
    """

    def wrap(make: View) -> View:
        @functools.wraps(make)
        def view(spark: SparkSession, sf_dir: str) -> DataFrame:
            key = (spark.sparkContext.applicationId, make.__module__, make.__qualname__, sf_dir, *(state(spark, f"{sf_dir}/{t}.parquet") for t in tables))
            path, df = _WRITTEN.get(key, (None, None))
            if path is None or not exists(spark, path):  # the folder may have been cleared
                path = new_path(spark)
                df = written(make(spark, sf_dir), path)
                _WRITTEN[key] = (path, df)
            return df

        return view

    return wrap
