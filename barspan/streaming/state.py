"""Settings that stateful queries need while they start."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Queries that start within keep their state in RocksDB, which holds it on disk and not in the executors' heaps.

    A query takes the session's settings over as it starts, so they are put back at the end.
    """
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def has_batches(spark: SparkSession, checkpoint: str) -> bool:
    """Whether a query has finished a micro-batch under this checkpoint, so that its state no longer comes from a seed."""
    try:
        return not spark.read.text(f"{checkpoint}/commits").isEmpty()
    except AnalysisException:  # there is no such folder yet
        return False
