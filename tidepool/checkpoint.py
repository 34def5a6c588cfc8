"""Reliable checkpoints in a folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: While it is on, Spark drops a query's shuffle files as it ends. What is checkpointed needs them no more.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which checkpoints and other intermediate files go to.

    Only a local session without that setting gets a temporary folder, which goes when Python ends.
    """
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        shared = sc.getConf().get("spark.checkpoint.dir")
        if not shared:
            if sc.master != "local" and not sc.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            shared = tempfile.mkdtemp(prefix="tidepool-checkpoints-")
            atexit.register(shutil.rmtree, shared, ignore_errors=True)
        sc.setCheckpointDir(shared)
    return sc._jsc.sc().getCheckpointDir().get()


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for what is planned within."""
    was = {name: spark.conf.get(name, None) for name in values}
    try:
        for name, value in values.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in was.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def dropping_shuffles(spark: SparkSession):
    """Queries that are planned within drop their shuffle files as they end; for results that are stored whole."""
    return settings(spark, {_CLEANUP: "true"})


def cut(df: DataFrame) -> DataFrame:
    """Computes ``df`` once and cuts its lineage, in the shared folder."""
    shared_folder(df.sparkSession)
    with dropping_shuffles(df.sparkSession):
        return df.select("*").checkpoint(eager=True)  # the setting counts as a plan is made, so it is made here
