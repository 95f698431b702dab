"""Places that driver and executors share, for what streams write and remember."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under ``spark.checkpoint.dir``; where that is unset, a local one for a local master only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "ledgerloom-streams")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """The state store that processors with lists and timers need, for queries started inside."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(key, before)
