"""Results that later steps read more than once."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..streaming.shared import shared_path


def staged(rows: DataFrame) -> DataFrame:
    """``rows``, worked out once and kept under ``spark.checkpoint.dir``. What reads them is planned from there, so that plans do not multiply where one result feeds several steps."""
    context = rows.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_path(rows.sparkSession, "stages"))
    return rows.checkpoint()
