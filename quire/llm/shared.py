"""What the operators share: written intermediate tables, counted broadcasts, small inputs for all cores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators.lineage import cut

#: Narrow rows that are broadcast where they are counted to be no more.
BROADCAST_ROWS = 200_000


def counted(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """The rows, written once, and marked for a broadcast if they are counted to be few; beyond that they are joined by a shuffle."""
    held = cut(df)
    return F.broadcast(held) if held.count() <= most else held


#: Bytes a core for which an input in fewer files than cores is small enough to be dealt out.
SMALL = 4 << 20


def spread(df: DataFrame) -> DataFrame:
    """A small input that lies in fewer files than there are cores, dealt out to all of them; any other as it is.

    Only the planner's size estimate and the list of files are looked at; nothing is executed.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size <= cores * SMALL and len(df.inputFiles()) < cores else df
