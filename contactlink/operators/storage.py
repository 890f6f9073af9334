"""Where intermediate tables go, and how lineage is cut."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

FOLDER_KEY = "spark.checkpoint.dir"


@functools.cache
def _own_folder() -> str:
    folder = tempfile.mkdtemp(prefix="contactlink-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def work_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Where it is unset, a session in one process (tests) gets a folder of its own, removed at exit; on a cluster
    that would be a folder other machines cannot see, so it is an error there.
    """
    folder = spark.conf.get(FOLDER_KEY, None)
    if folder:
        return folder.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if master == "local" or master.startswith("local["):
        return _own_folder()
    raise ValueError(f"set {FOLDER_KEY} to a folder that the driver and all executors share")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder."""
    return f"{work_dir(spark)}/contactlink/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write the table once and read it back.

    Cuts the lineage of iterative plans, survives lost executors, and gives the
    optimizer a real size, so a join with a small result is broadcast by measured size.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
