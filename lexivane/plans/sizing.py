"""Layout of small inputs. Joins carry no hints but that of a written table of bounded size: Spark broadcasts by the real sizes of tables and shuffles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPREAD_BYTES = 1024 * 1024 * 1024
SMALL_BYTES = 8 * 1024 * 1024


def planned_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the plan size; for a written table this is its file size."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def spread(df: DataFrame) -> DataFrame:
    """Spread a small input over all cores; a large one already has enough splits."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if planned_bytes(df) <= SPREAD_BYTES else df


def small(written: DataFrame) -> DataFrame:
    """A written table for a join with a far larger one: sent to all tasks up to 8 MB of files, else left to Spark."""
    return F.broadcast(written) if planned_bytes(written) <= SMALL_BYTES else written
